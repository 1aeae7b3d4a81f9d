from fractions import Fraction

from pyspark.sql import functions as F

from fleetlake.llm import mixing


def filled(sizes, weights, budget=Fraction(3, 2), cap=2):
    """Targets by the rule as it is told: share by weight, stop at the cap, share what is above again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = budget * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level >= cap * sizes[s]}
        if not above:
            break
        out |= {s: Fraction(cap * sizes[s]) for s in above}
        left -= sum(cap * sizes[s] for s in above)
        open_ -= above
    return out | {s: weight[s] * level for s in open_}


def test_targets_follow_the_rule(spark, documents, odd):
    for docs in (documents, odd.select("doc_id", "text", "source"), documents.where("source IN ('src0', 'src1')")):
        rows = mixing.planned(docs).select("source", "size", "source_size", "target", mixing.COPIES).collect()
        sizes: dict = {}
        for r in rows:
            sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        want = filled(sizes, [5, 2, 1])
        for r in rows:
            assert r.source_size == sizes[r.source] and abs(r.target - float(want[r.source])) <= 1e-9 * max(1, r.target)
            assert 0 <= r[mixing.COPIES] <= 2


def test_mix_holds_the_planned_copies_and_repeats(documents):
    plan = {r.doc_id: r[mixing.COPIES] for r in mixing.planned(documents).collect()}
    got = {r.doc_id: r["count"] for r in mixing.mixed(documents).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in plan.items() if v}
    assert plan == {r.doc_id: r[mixing.COPIES] for r in mixing.planned(documents.repartition(7)).collect()}
    taken = mixing.planned(documents).groupBy("source").agg(F.sum(F.col(mixing.COPIES) * F.col("size")).alias("t"), F.max("target").alias("target")).collect()
    assert abs(sum(r.t for r in taken) / sum(r.target for r in taken) - 1) < 0.1


def test_weights_budget_and_many_sources(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 700).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 13).cast("int")).alias("text"))
    rows = mixing.planned(docs, weights=[1, 3], budget=(1, 2), cap=1).collect()
    sizes: dict = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = filled(sizes, [1, 3], Fraction(1, 2), 1)
    assert all(abs(r.target - float(want[r.source])) < 1e-6 for r in rows)


def test_odd_and_empty(odd, empty):
    assert mixing.planned(odd).count() == odd.count() and set(mixing.mixed(odd).columns) == set(odd.columns)
    assert mixing.planned(empty).count() == 0 == mixing.mixed(empty).count()
    assert mixing.mixed(empty.limit(0)).columns == empty.columns
