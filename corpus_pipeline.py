"""The corpus pipeline: from documents to the token ids of a training mix.

Toxic documents go, one document of each group of near duplicates stays (five-word shingles, a Jaccard similarity of
0.8 or more), passages of 50 words or more that stand in more than one place are cut out, sources are mixed to target
weights, and the mix is encoded. Each stage's result is a Parquet table in the shared folder; the next one reads it.

Documents need doc_id, text and source; other columns, n_chars among them, pass through whatever their names, up to the
last stage. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.llm import byte_bpe, jaccard_join, mixing, shared, suffix_dedup, toxicity


def _set_aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with names for its further columns that no operator uses, and the columns that give them back."""
    names = {c: c if c in ("doc_id", "text", "source") else f"own_{k}_column" for k, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), [F.col(new).alias(old) for old, new in names.items()]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels of sf_dir, doesn't predict to be toxic. Null and empty
    texts are scored as one empty window, long ones by all their windows; rows that repeat get equal scores. Without
    labels of both classes all documents stay."""
    rows, back = _set_aside(docs)
    model = toxicity.trained(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(rows, model).where("predicted = 0").select(*back)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that links of 0.8 or more connect. Texts without words
    (null, empty) link with nothing and stay; texts of one to four words link if they are equal; of rows that repeat id
    and text one stays, and a null id goes before others only where there are no others."""
    rows, back = _set_aside(docs)
    return jaccard_join.representatives(rows, width=5, num=80, den=100).select(*back)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that stand in a 50-word passage found elsewhere too. All documents stay, those
    that lose everything with an empty text; null texts stay null. A column n_chars gets the new text's length. Rows
    that repeat are repeats of each other: each loses what they share."""
    rows, back = _set_aside(docs)
    found = suffix_dedup.without_repeats(rows, unit="word", depth=50)
    text = F.when(F.size("spans") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))  # words are cut whole: it stays UTF-8
    return found.select(*[text.alias("text") if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else b for c, b in zip(docs.columns, back, strict=True)])


def in_the_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, copies as rows of their own. Null sources are a source, the last;
    documents without words come at their source's rate; equal ids of a source come equally often."""
    rows, back = _set_aside(docs)
    return mixing.mixed(rows).select(*back)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the token ids, their number and the digests of ids and of the text decoded from them, a row for
    each of docs. Null and empty texts have no ids; texts of any length are encoded whole."""
    import public_tokenizers

    found = byte_bpe.round_trips(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"), ids="ids")
    return found.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("near_duplicates", without_near_duplicates),
    ("passages", without_passages),
    ("mix", in_the_mix),
    ("tokens", as_tokens),
]
#: Compression, shingle joins and token ids aren't SQL: tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.written(spark, stage(spark, docs, sf_dir), name)
    return docs
