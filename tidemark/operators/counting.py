"""Exact counts and medians without pairs of rows and without a group's values in memory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 40  # more than the doublings of any number of positions


def dominance_counts(points: DataFrame, asks: DataFrame, size: Column) -> DataFrame:
    """(id, n): how many of the first ``upto`` points have a value of at most ``value``, per ask.

    ``points(pos, value)`` are numbered from 0; ``asks(id, upto, value)``;
    ``size`` is the number of points, a column of either.  A prefix of length
    ``upto`` is cut into blocks of 1, 2, 4, ... positions, one per set bit; a
    point lies in one block of each length.  Within a block, points and asks are
    read once in order of their values.  Work is n log n, whatever the lengths
    of the prefixes; blocks of all lengths spread over the tasks.
    """
    levels = F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.pow(F.lit(2.0), k) <= size)
    level = F.explode(levels).alias("level")
    # Blocks that begin at an odd number end no prefix of their level.
    held = points.select("pos", "value", level).select(
        F.col("level"), F.expr("shiftright(pos, level)").alias("block"), "value", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id")
    ).where("block % 2 = 0")
    asked = asks.select("id", "upto", "value", level).where("getbit(upto, level) = 1").select(
        F.col("level"), (F.expr("shiftright(upto, level)") - 1).alias("block"), "value", F.lit(1).alias("kind"), F.col("id").cast("string").alias("id")
    )
    order = Window.partitionBy("level", "block").orderBy("value", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    met = held.unionByName(asked).withColumn("n", F.sum(1 - F.col("kind")).over(order)).where("kind = 1")
    counted = met.groupBy("id").agg(F.sum("n").alias("n"))
    none = asks.select(F.col("id").cast("string").alias("id"), F.lit(0).cast("bigint").alias("n"))
    return none.unionByName(counted).groupBy("id").agg(F.max("n").alias("n"))


def grouped_medians(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], digits: int = 3) -> DataFrame:
    """One row per group with the exact median of each value; nulls do not count.

    A histogram of the values rounded to ``digits`` says which bin holds the
    middle one or two; only the values of those bins are counted one by one.
    Both steps combine equal values in the tasks, so a large group is never
    gathered.  Rounding keeps the order, so the result does not depend on
    ``digits``.
    """
    kinds = [F.struct(F.lit(name).alias("kind"), c.cast("double").alias("value")) for name, c in values.items()]
    group = F.struct(*[F.col(k) for k in keys]).alias("_group")
    long = df.select(group, F.explode(F.array(*kinds)).alias("v")).select("_group", "v.kind", "v.value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    long = long.withColumn("bin", F.round("value", digits))
    bins = long.groupBy("_group", "kind", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("_group", "kind").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("_group", "kind")
    ranked = bins.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(total)})
    first, second = F.expr("(total + 1) div 2"), F.expr("(total + 2) div 2")
    covers = (F.col("upto") >= first) & (F.col("upto") - F.col("n") < second)
    picked = ranked.where(covers).select(F.col("_group").alias("_g"), F.col("kind").alias("_k"), F.col("bin").alias("_b"), (F.col("upto") - F.col("n")).alias("before"), "total")
    # The bins that are picked lie next to each other: their values follow each other in order.
    inside = long.join(picked, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("kind") == F.col("_k")) & (F.col("bin") == F.col("_b")))
    counts = inside.groupBy("_group", "kind", "bin", "before", "total", "value").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("_group", "kind", "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.col("before") + F.sum("n").over(within))
    at = {name: (F.col("upto") >= place) & (F.col("upto") - F.col("n") < place) for name, place in (("low", first), ("high", second))}
    middle = placed.groupBy("_group", "kind").agg(*[F.max(F.when(c, F.col("value"))).alias(name) for name, c in at.items()])
    each = [F.max(F.when(F.col("kind") == name, F.col("low") + (F.col("high") - F.col("low")) * 0.5)).alias(name) for name in values]
    return middle.groupBy("_group").agg(*each).select("_group.*", *values)
