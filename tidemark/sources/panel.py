"""Scans of bar panels and reference calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.normalize import normalize_symbol
from tidemark.operators.indicators import by_symbol

BARS_SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"
LANDED_BARS_SCHEMA = "symbol string, date string, open string, high string, low string, close string, volume string"
NUMBERS = ("open", "high", "low", "close", "volume")
RANGE_TOLERANCE = 1e-10


def panel_scan(
    bars: DataFrame, symbols: Sequence[str] | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Symbols and inclusive dates as plain predicates, so that they reach the file scan."""
    out = bars
    if symbols:
        out = out.where(F.col("symbol").isin(*symbols))
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    return out


def read_panel(spark: SparkSession, path: str, **wanted) -> DataFrame:
    """Typed Parquet panel."""
    return panel_scan(spark.read.schema(BARS_SCHEMA).parquet(path), **wanted)


def coerce_panel(landed: DataFrame) -> DataFrame:
    """Text panel to typed columns; unreadable cells become null."""
    return landed.select(
        normalize_symbol(F.col("symbol")).alias("symbol"),
        F.col("date").try_cast("date").alias("date"),
        *[F.col(c).try_cast("double").alias(c) for c in NUMBERS],
    )


def read_snapshot_csv(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot CSV; a header that differs from the schema fails the scan."""
    return spark.read.csv(path, schema=BARS_SCHEMA, header=True, enforceSchema=False, mode="FAILFAST")


def snapshot_violations(panel: DataFrame) -> DataFrame:
    """Rows that break a snapshot's rules; an empty result means the file may be used."""
    w = by_symbol("_line") if "_line" in panel.columns else by_symbol("date")
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    bad: Column = F.lit(False)
    for p in prices:
        bad = bad | p.isNull() | F.isnan(p) | (p <= 0) | (p == float("inf"))
    slack = F.greatest(*[F.abs(p) for p in prices]) * RANGE_TOLERANCE
    low, high = F.col("low"), F.col("high")
    inconsistent = (
        (high + slack < F.greatest("open", "close", "low")) | (low - slack > F.least("open", "close", "high"))
    )
    backwards = F.lag("date").over(w) >= F.col("date")
    reasons = F.array_compact(
        F.array(
            F.when(bad, "price_not_positive"),
            F.when(~bad & inconsistent, "high_low_inconsistent"),
            F.when(F.coalesce(backwards, F.lit(False)), "date_not_increasing"),
        )
    )
    return panel.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def reference_calendar(bars: DataFrame, benchmark: str, start: str, end: str) -> DataFrame:
    """The benchmark's own days as trading calendar."""
    return panel_scan(bars, [benchmark], start, end).select("date").distinct()
