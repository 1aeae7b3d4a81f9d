"""Mixing sources to target weights: how often each document is repeated so that sources meet their shares.

Sizes are summed per source, targets follow from weights and a budget, a source's repetition rate is target over
size, and every document is emitted floor(rate) times plus once more with the probability of the rest, decided by
a seeded hash of its id. All of it is DataFrame work; nothing of the size of the sources comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WORD = r"[^\x20\x09-\x0D]+"
COPIES = "n_copies"


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only (null counts as the empty string)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def ranked_sources(sizes: DataFrame, source: str) -> DataFrame:
    """One row per source with its place in code point order (null last), 0 first. Ranks come from a range
    partitioning and the partitions' counts, so that any number of sources will do."""
    spark = sizes.sparkSession
    parts = shared.written(
        spark,
        sizes.repartitionByRange(F.col(source).isNull(), F.col(source).asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "sources",
    )
    before = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # a row per partition, not per source
    before = before.withColumn("skip", F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col(source).asc_nulls_last()))
    return (
        parts.withColumn("place", place)
        .join(before.select("part", F.coalesce("skip", F.lit(0)).alias("skip")), "part")
        .withColumn("rank", F.col("place") - 1 + F.col("skip"))
        .drop("part", "place", "skip")
    )


def targets(docs: DataFrame, source: str, size: str, weights: list[int], budget: tuple[int, int], cap: int) -> DataFrame:
    """Target of every source: ``budget`` (a fraction of all sizes) shared by weight, where no source gets more than
    ``cap`` times its size; what is above goes to the others by weight until none is above.

    Returns source, source_size, weight, target. Weights repeat over the sources in code point order, null last.
    A source of size 0 has target 0. Each round of the sharing is one aggregate over the sources.
    """
    sizes = docs.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    table = shared.written(
        docs.sparkSession,
        ranked_sources(sizes, source).select(source, "source_size", F.element_at(cycle, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).alias("weight")),
        "weights",
    )
    # level = numerator / denominator is the amount per weight; sources with weight * level >= cap * size are full
    up, down = budget
    total = table.agg(F.sum("source_size")).first()[0] or 0
    numerator, denominator, full = 0, 1, -1
    while True:
        is_full = F.col("weight").cast("decimal(38,0)") * F.lit(numerator).cast("decimal(38,0)") >= F.lit(cap * denominator).cast("decimal(38,0)") * F.col("source_size")
        got = table.agg(
            F.count(F.when(is_full, 1)).alias("n"),
            F.sum(F.when(is_full, F.col("source_size")).otherwise(0)).alias("held"),
            F.sum(F.when(is_full, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if got["n"] == full or not got["open"]:
            break
        full, numerator, denominator = got["n"], up * total - down * cap * got["held"], down * got["open"]
    share = (F.col("weight") * F.lit(numerator)).cast("double") / F.lit(float(denominator))
    most = F.col("source_size").cast("double") * F.lit(float(cap))
    return table.withColumn("target", F.least(share, most) if full >= 0 else most)


def planned(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: list[int] | None = None,
    budget: tuple[int, int] = (3, 2),
    cap: int = 2,
    seed: int = 17,
) -> DataFrame:
    """``docs`` with size, source_size, target and n_copies (how often the mix holds the document).

    Null or empty text has size 0; null source is a source of its own; an empty table gives an empty one. Rows that
    share a key get the same draw. Columns of ``docs`` with the names of results are replaced.
    """
    weights = weights or [5, 2, 1]
    results = ("size", "source_size", "target", COPIES)
    sized = docs.drop(*results).withColumn("size", word_count(F.col(text)))
    goal = targets(sized.select(source, "size"), source, "size", weights, budget, cap)
    goal = goal.select(F.col(source).alias("__source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = unit_hash(F.col(key), seed) < rate - F.floor(rate)
    return (
        sized.join(goal, F.col(source).eqNullSafe(F.col("__source")), "left")
        .withColumn(COPIES, F.floor(rate) + F.when(extra, 1).otherwise(0))
        .drop("__source")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as planned() says. Same columns as ``docs``."""
    names = {options.get(n, default) for n, default in (("text", "text"), ("source", "source"), ("key", "doc_id"))}
    plan = planned(docs.select(F.struct(*docs.columns).alias("__row"), *sorted(names)), **options)
    times = F.when(F.col(COPIES) > 0, F.sequence(F.lit(1), F.col(COPIES).cast("int"))).otherwise(F.array().cast("array<int>"))
    return plan.withColumn("__copy", F.explode(times)).select("__row.*")
