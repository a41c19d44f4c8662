"""Quarterly EPS, trailing sums and balance growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numbers import half_up
from tidemark.operators.asof import newest


def quarterly_eps(statements: DataFrame) -> DataFrame:
    """Single-quarter EPS from cumulative filings; the newest filing per quarter counts.

    ``statements(stock_id, period_end, origin_date, value)``.  Months that are
    not quarter ends are dropped.  A quarter subtracts the nearest earlier
    quarter of its year; without one the cumulative value stands.
    """
    month = F.month("period_end")
    filed = statements.where(month % 3 == 0).withColumns(
        {"year": F.year("period_end"), "quarter": (month / 3).cast("int")}
    )
    last = newest(filed, ["stock_id", "year", "quarter"], ["origin_date", "value"])
    w = Window.partitionBy("stock_id", "year").orderBy("quarter")
    single = F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0))
    return last.select(
        "stock_id",
        "period_end",
        F.col("origin_date").alias("available_at"),
        "year",
        "quarter",
        half_up(single, 2).alias("single_quarter_eps"),
    )


def ttm_eps(quarters: DataFrame, as_of: str) -> DataFrame:
    """Sum of the last four quarters known at the date, if they are consecutive."""
    known = quarters.where(F.col("available_at") <= F.lit(as_of).cast("date")).withColumn(
        "ordinal", F.col("year") * 4 + F.col("quarter")
    )
    w = Window.partitionBy("stock_id").orderBy(F.col("ordinal").desc())
    four = known.withColumn("_rn", F.row_number().over(w)).where("_rn <= 4")
    g = four.groupBy("stock_id").agg(
        F.count(F.lit(1)).alias("quarters"),
        (F.max("ordinal") - F.min("ordinal")).alias("span"),
        F.sum(F.col("single_quarter_eps").cast("decimal(18,4)")).alias("total"),
        F.max_by("period_end", "ordinal").alias("period_end"),
        F.max_by("available_at", "ordinal").alias("available_at"),
    )
    ok = (F.col("quarters") == 4) & (F.col("span") == 3)
    return g.select(
        "stock_id",
        F.when(ok, "available").otherwise("insufficient_data").alias("status"),
        F.when(F.col("quarters") < 4, "fewer_than_four_quarters")
        .when(F.col("span") != 3, "quarters_not_consecutive")
        .alias("reason"),
        F.when(ok, half_up("total", 2)).alias("ttm_eps"),
        F.when(ok, F.col("period_end")).alias("period_end"),
        F.when(ok, F.col("available_at")).alias("available_at"),
    )


def balance_growth(
    balances: DataFrame, rows: int = K.MARGIN_ROWS, minimum: int = K.MARGIN_MIN_ROWS, threshold: float = K.MARGIN_GROWTH
) -> DataFrame:
    """Growth from the first to the last of the newest rows per symbol."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    recent = balances.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= rows)
    g = recent.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.max_by("balance", "date").alias("recent_balance"),
        F.min_by("balance", "date").alias("past_balance"),
    )
    growth = F.when(
        F.col("past_balance") > 0, (F.col("recent_balance") - F.col("past_balance")) / F.col("past_balance")
    ).otherwise(0.0)
    ok = F.col("observation_count") >= minimum
    return g.select(
        "symbol",
        F.when(ok, "available").otherwise("insufficient_data").alias("status"),
        "observation_count",
        F.when(ok, F.col("recent_balance")).alias("recent_balance"),
        F.when(ok, half_up(growth, 4)).alias("growth_rate"),
        F.when(ok, growth >= threshold).alias("is_overheat"),
    )
