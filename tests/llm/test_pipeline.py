import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from fleetlake.llm import jaccard_join, queries, toxicity

SF = "/root/testdata/sf0.01"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "passages", "mix", "tokens"]


def test_toxic_documents_go(spark, documents):
    model = toxicity.trained(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.scored(documents, model).where("predicted = 1").collect()}
    kept = stage("toxicity")(spark, documents, SF)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in documents.collect()} - bad and kept.columns == documents.columns


def test_near_duplicates_and_passages(spark, documents):
    r = random.Random(4)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))
    passage, base = words(60), words(300)
    near = base.split()
    near[150] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, f"{words(80)} {passage} {words(30)}"), (5, f"{words(90)}\n{passage}\n{words(20)}"), (6, words(200))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], documents.schema)
    kept = stage("near_duplicates")(spark, docs, SF)
    assert sorted(x.doc_id for x in kept.collect()) == [1, 4, 5, 6] and kept.columns == documents.columns
    cut = {x.doc_id: x for x in stage("passages")(spark, kept, SF).collect()}
    assert all(passage.split()[7] not in cut[k].text.split() or len(cut[k].text.split()) == n for k, n in ((4, 110), (5, 110)))
    assert len(cut[4].text.split()) == 110 == len(cut[5].text.split()) and cut[4].n_chars == len(cut[4].text)
    assert cut[1].text == base and cut[6].text == rows[5][1]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert rows.where(F.size("ids") != F.col("n_tokens")).count() == 0 < rows.count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_and_empty(spark, odd, empty, name):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd.select(*columns), empty):
        out = stage(name)(spark, docs, SF)
        assert out.count() <= 2 * docs.count()
        assert name == "tokens" or out.columns == docs.columns


def test_columns_named_like_results_stay(spark, documents):
    clashing = ["score", "Predicted", "n_bytes", "spans", "kept", "__key", "__print", "__name", "size", "n_copies", "component_id"]
    docs = documents.limit(12).withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in clashing})
    for name, run in corpus_pipeline.STAGES[:-1]:
        out = run(spark, docs, SF)
        assert out.columns == docs.columns
        assert all(r[c] == f"{c}:{r['doc_id']}" for r in out.collect() for c in clashing), name


def test_queries_cover_all_operators():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
    assert jaccard_join.joined.__doc__
