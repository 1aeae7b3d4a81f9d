import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
# Names that operators use inside or return, as columns of the input.
CLASHING = ["size", "source_size", "target", "weight", "n_copies", "n_bytes", "n_tokens", "over_limit", "spans", "kept", "ids", "ids_sha256", "decoded_sha256", "n_words", "cleaned", "base_failed", "score", "predicted", "media", "key", "node", "print", "cell", "hub", "part", "path", "rank", "digit", "first", "payload", "url"]


def odd_rows():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijé") for _ in range(r.randint(1, 8)))
    long = " ".join(word() for _ in range(60_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, long, "b"), (5, "one", "b"), (6, "one two", None), (None, "no key here", "c"), (7, "same row", "a"), (7, "same row", "a"), (7, "other text, same key", "a"), (8, "x" * 50_000, ""), (9, "<|endoftext|> <s> \x00 ▁    日本", "\U0001f600")]
    return rows + [(100 + k, " ".join(word() for _ in range(r.randint(0, 60))), r.choice(["a", "b", None])) for k in range(30)]


@pytest.fixture(scope="session")
def odd(spark):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, source string").repartition(3)
    return docs.withColumns({c: F.lit("mine") for c in CLASHING} | {"lang": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")}).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()
