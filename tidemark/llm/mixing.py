"""Mixing sources to target weights by capped water-filling.

Targets.  Every source wants its share of the budget by weight but may be
repeated ``max_epochs`` times at most.  Pouring until a source is full,
clamping it and sharing the rest by weight ends at one water level; the level
is found from running totals over the sources in the order in which they fill
up, without iterating.  This part works on one row per source.

Sampling.  A source that needs e epochs takes every document floor(e) times
and a seeded sample once more.  The sample is the first stretch of the
source's documents in the order of a seeded hash: sums per hash bucket tell
the bucket in which the stretch ends, and only that bucket (1/4096 of a
source) is put in order.  No task sorts a source, however large it is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import settle, shared_if_small, stored, word_count

SEED = "mix-1"
WEIGHTS = (5, 2, 1)
BUDGET_TENTHS = 15  # of all sizes
MAX_EPOCHS = 2
BUCKET_SHIFT = 20  # of a 32-bit hash: 4096 buckets


def seeded_hash(key: Column, seed: str) -> Column:
    """32 bits of the MD5 of seed and key, as a bigint."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int], budget_tenths: int, max_epochs: int) -> DataFrame:
    """(source, source_size) -> adds weight, cap and target.

    Integers up to the last division, so that the result does not depend on
    the order of summation.
    """
    lcm = math.lcm(*weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", weight.cast("bigint").alias("weight"))
    # The level, times lcm, at which a source is full.
    full = F.lit(max_epochs) * F.col("source_size") * F.floor(F.lit(lcm) / F.col("weight"))
    by_level = Window.orderBy("full_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("full_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumn("cap", F.lit(max_epochs) * F.col("source_size")).withColumn("full_at", full.cast("bigint"))
    levels = levels.select(
        "*",
        F.sum("cap").over(by_level).alias("filled"),
        (F.sum("weight").over(everything) - F.sum("weight").over(by_level)).alias("open_weight"),
        (F.sum("source_size").over(everything) * budget_tenths).alias("budget10"),
    )
    # All in tenths of a word; decimals, for level times weight may pass 64 bits.
    poured = F.col("filled").cast("decimal(38,0)") * (10 * lcm) + F.col("full_at").cast("decimal(38,0)") * F.col("open_weight") * 10
    levels = levels.withColumn("clamped", poured <= F.col("budget10").cast("decimal(38,0)") * lcm)
    levels = levels.select(
        "*",
        F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(everything).alias("clamped_cap"),
        F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("weight"))).over(everything).alias("shared_weight"),
    )
    rest = (F.col("budget10") - F.col("clamped_cap") * 10) * F.col("weight")
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(rest.cast("double") / (F.col("shared_weight") * 10).cast("double"))
    return levels.select("source", "source_size", "weight", "cap", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    budget_tenths: int = BUDGET_TENTHS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: ``id_col``, source, size, source_size, target, times, taken.

    Size is the number of words (null text: 0).  Sources are ordered by code
    point with null last and weigh ``weights`` in turn; the null source is one
    source.  ``times`` is how often the mix takes the document, ``taken`` =
    times x size.  Taken words of a source miss its target by at most half of
    the document (or set of repeated rows) at which its sample ends.  Rows
    with equal identifier, source and size are taken alike, so repeated rows
    and reruns agree.  Documents without words, and tables without any, have
    taken 0.  Other columns are not read.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    sized = settle(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"))
        .withColumn("h", seeded_hash(F.col("key"), seed))
        .withColumn("bucket", F.shiftright("h", BUCKET_SHIFT).cast("int"))
    )
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, budget_tenths, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("whole", epochs.cast("bigint")).withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.withColumnRenamed("source", "p_source")
    same_source = F.col("source").eqNullSafe(F.col("p_source"))

    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = buckets.withColumn("upto", F.sum("words").over(upto)).join(plan, same_source)
    ends = reached.where((F.col("upto") - F.col("words") < F.col("goal")) & (F.col("upto") >= F.col("goal")))
    ends = ends.select("p_source", F.col("bucket").alias("end_bucket"), (F.col("upto") - F.col("words")).alias("before"), "goal")
    ends = shared_if_small(stored(ends, "mix-ends"))  # one row per source

    # The bucket in which the sample ends, put in order; repeated rows stand together.
    edge = sized.join(ends, same_source & (F.col("bucket") == F.col("end_bucket")))
    edge = edge.groupBy("source", "h", "key", "size", "end_bucket", "before", "goal").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("h", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before") + F.sum("words").over(order) - F.col("words") / 2
    taken_keys = F.when(F.col("middle") <= F.col("goal"), F.struct("h", "key", "size"))
    last = edge.withColumn("middle", middle).groupBy(F.col("source").alias("e_source"), "end_bucket").agg(F.max(taken_keys).alias("last"))
    plan = plan.join(last, F.col("p_source").eqNullSafe(F.col("e_source")), "left").select("p_source", "source_size", "target", "whole", "end_bucket", "last")
    plan = shared_if_small(stored(plan, "mix-plan"))  # one row per source; a hot source stays where it lies

    once_more = (F.col("bucket") < F.col("end_bucket")) | ((F.col("bucket") == F.col("end_bucket")) & (F.struct("h", "key", "size") <= F.col("last")))
    times = F.col("whole") + F.when(F.col("size") == 0, 0).when(once_more, 1).otherwise(0)
    out = sized.join(plan, same_source)
    return out.select(
        F.col("id").alias(id_col),
        F.col("source"),
        F.col("size"),
        F.col("source_size"),
        F.col("target"),
        times.cast("bigint").alias("times"),
        (times * F.col("size")).cast("bigint").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows taken 0 times go."""
    names = {k: options.get(k, k.removesuffix("_col")) for k in ("text_col", "source_col")}
    id_col, text_col, source_col = options.get("id_col", "doc_id"), names["text_col"], names["source_col"]
    plan = mix(docs, **options).groupBy(id_col, "source", "size").agg(F.first("times").alias("times")).where("times > 0")
    plan = plan.select(F.col(id_col).alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), F.col("times").alias("m_times"))
    packed = docs.select(F.struct("*").alias("row"))
    cond = (
        F.col(f"row.`{id_col}`").eqNullSafe(F.col("m_id"))
        & F.col(f"row.`{source_col}`").eqNullSafe(F.col("m_source"))
        & (word_count(F.col(f"row.`{text_col}`")) == F.col("m_size"))
    )
    return packed.join(plan, cond).select("row", F.explode(F.sequence(F.lit(1), F.col("m_times").cast("int")))).select("row.*")
