"""Panel cleaning, quality profiles and reconciliation against a calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numbers import half_up
from tidemark.operators.asof import newest
from tidemark.operators.indicators import by_symbol, falsy

PRICES = ("open", "high", "low", "close")
REQUIRED = (*PRICES, "volume")


def clean_ohlcv(raw: DataFrame, order: str = "ingest_order") -> DataFrame:
    """Complete, positive, consistent rows; the last landed one per symbol and date."""
    ok = F.col("high") >= F.col("low")
    for c in PRICES:
        ok = ok & (F.col(c) > 0)
    ok = ok & (F.col("volume") > 0)
    kept = raw.dropna(subset=list(REQUIRED)).where(ok)
    return newest(kept, ["symbol", "date"], [order]).drop(order)


def zero_volume_audit(raw: DataFrame) -> DataFrame:
    """Count and dates of rows without volume (dates per symbol are bounded by the calendar)."""
    empty = F.col("volume") <= 0
    return raw.groupBy("symbol").agg(
        F.count_if(empty).alias("zero_volume_rows"),
        F.array_sort(F.collect_set(F.when(empty, F.col("date")))).alias("zero_volume_dates"),
    )


def day_ranks(calendar: DataFrame, *others: DataFrame) -> DataFrame:
    """For every day of the inputs: calendar days up to it, and strictly before it.

    The table has one row per day, so its single ordered window stays small.
    """
    days = calendar.select("date").distinct().withColumn("_in", F.lit(1))
    for o in others:
        days = days.unionByName(o.select("date").distinct().withColumn("_in", F.lit(0)))
    spine = days.groupBy("date").agg(F.max("_in").alias("_in"))
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("_in").over(w)
    return spine.select("date", "_in", upto.alias("days_upto"), (upto - F.col("_in")).alias("days_before"))


def calendar_gaps(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar days inside a symbol's own range on which it has no row.

    Each row emits the calendar days between itself and the symbol's next row,
    so the work is one ordered pass plus the gaps themselves; the full
    symbol x day grid is never built.
    """
    seen = bars.select("symbol", "date").distinct()
    ranks = day_ranks(calendar, seen)
    placed = seen.join(ranks.select("date", "days_upto", "days_before"), "date")
    following = F.lead("days_before").over(by_symbol())
    spans = placed.select("symbol", (F.col("days_upto") + 1).alias("first"), following.alias("last"))
    holes = spans.where("last >= first").select("symbol", F.explode(F.sequence("first", "last")).alias("rank"))
    named = ranks.where("_in = 1").select(F.col("days_upto").alias("rank"), "date")
    return holes.join(named, "rank").select("symbol", "date")


def provider_only_days(bars: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Rows inside the requested range on days that are not in the calendar."""
    wanted = bars.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return wanted.select("symbol", "date").distinct().join(calendar, "date", "left_anti")


def month_audit(calendar: DataFrame, reference: DataFrame) -> DataFrame:
    """Per month: days only in the calendar, only in the reference series, and in both."""
    a = calendar.select("date").distinct().withColumn("_a", F.lit(True))
    b = reference.select("date").distinct().withColumn("_b", F.lit(True))
    both = a.join(b, "date", "full_outer")
    return both.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count_if(F.col("_b").isNull()).alias("calendar_only"),
        F.count_if(F.col("_a").isNull()).alias("reference_only"),
        F.count_if(F.col("_a") & F.col("_b")).alias("shared"),
    )


def bar_returns(raw: DataFrame, order: str = "ingest_order") -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date", order)
    return raw.withColumns(
        {
            "ret": F.try_divide(F.col("close"), F.lag("close").over(w)) - 1.0,
            "gap_days": F.datediff("date", F.lag("date").over(w)),
        }
    )


def landed_backwards(raw: DataFrame, order: str = "ingest_order") -> DataFrame:
    """Whether a symbol's days ever go back in landing order.

    Within one landing number days are in order, so only the ends of
    neighbouring numbers are compared.  A row without a day is no step.
    """
    ends = raw.groupBy("symbol", order).agg(F.max("date").alias("last"), F.when(F.count_if(F.col("date").isNull()) == 0, F.min("date")).alias("first"))
    before = F.lag("last").over(Window.partitionBy("symbol").orderBy(order))
    return ends.select("symbol", falsy(F.col("first") < before).alias("back")).groupBy("symbol").agg(F.bool_or("back").alias("non_monotonic_dates"))


def data_quality_profile(raw: DataFrame, calendar: DataFrame, order: str = "ingest_order", symbols: DataFrame | None = None) -> DataFrame:
    """One row of quality facts per symbol, and whether any of them is a warning.

    With ``symbols``, those without a row are kept as ``insufficient_data``.
    """
    invalid: Column = F.col("high") < F.col("low")
    for c in PRICES:
        invalid = invalid | (F.col(c) <= 0)
    # What a row says by itself is one number before rows are ordered.
    marks = [*[F.col(c).isNull() for c in REQUIRED], falsy(invalid), falsy(F.col("volume") <= 0)]
    said = sum((F.when(m, 1 << k).otherwise(0) for k, m in enumerate(marks)), F.lit(0))
    # Days between a row and the one before are counted in the same pass as its return; null days have no rank.
    ranked = raw.select("symbol", "date", order, "close", said.alias("_said")).join(day_ranks(calendar, raw).drop("_in"), "date", "left")
    passed = F.lag("days_upto").over(Window.partitionBy("symbol").orderBy("date", order))
    rows = bar_returns(ranked, order).withColumn("_missed", F.greatest(F.col("days_before") - passed, F.lit(0)))
    move = F.abs("ret")
    facts = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        # In order of days a repeat follows its day: no table of the days is needed.
        F.count_if(F.col("date").isNull() | falsy(F.col("gap_days") == 0)).alias("duplicate_dates"),
        *[F.count_if(F.col("_said").bitwiseAND(1 << k) > 0).alias(n) for k, n in enumerate([*[f"missing_{c}" for c in REQUIRED], "invalid_price_rows", "zero_volume_rows"])],
        F.count_if(move >= K.LARGE_RETURN).alias("large_return_rows"),
        half_up(F.max(move) * 100.0, 4).alias("max_abs_return_pct"),
        F.coalesce(F.max("gap_days"), F.lit(0)).alias("max_calendar_gap_days"),
        F.sum("_missed").alias("missing_reference_dates"),
    )
    steps = landed_backwards(raw, order).withColumnRenamed("symbol", "_symbol")
    out = facts.join(steps, F.col("symbol").eqNullSafe(F.col("_symbol"))).drop("_symbol")
    counts = ["duplicate_dates", "invalid_price_rows", "zero_volume_rows", "large_return_rows", "missing_reference_dates"]
    counts += [f"missing_{c}" for c in REQUIRED]
    warned = F.greatest(*counts) > 0
    out = out.withColumn("status", F.when(warned, "quality_warning").otherwise("available"))
    names = [c for c in out.columns if c not in ("non_monotonic_dates", "missing_reference_dates", "status")]
    out = out.select(*names, "non_monotonic_dates", "missing_reference_dates", "status")
    if symbols is None:
        return out
    known = symbols.select("symbol").distinct().join(out, "symbol", "left")
    return known.fillna(0, ["row_count"]).fillna("insufficient_data", ["status"]).select(*out.columns)


def quality_dates(raw: DataFrame, calendar: DataFrame) -> DataFrame:
    """The days behind the counts of ``data_quality_profile``, one row per symbol, finding and day."""
    by_day = raw.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("rows"), F.bool_or(falsy(F.col("volume") <= 0)).alias("empty"))
    found = F.array(F.when(F.col("empty"), "zero_volume"), F.when(F.col("rows") > 1, "duplicate_date"))
    present = by_day.select("symbol", F.explode(F.array_compact(found)).alias("finding"), "date")
    holes = calendar_gaps(raw, calendar).select("symbol", F.lit("missing_reference_date").alias("finding"), "date")
    return present.unionByName(holes)


def actions_by_day(actions: DataFrame) -> DataFrame:
    return actions.groupBy("symbol", F.col("event_date").alias("date")).agg(
        F.array_sort(F.collect_list("event_type")).alias("corporate_actions")
    )


def classify_gaps(gaps: DataFrame, official: DataFrame, actions: DataFrame) -> DataFrame:
    """What the official record says about each gap, with the day's corporate actions."""
    o = official.select("symbol", "date", *[F.col(c).alias(f"o_{c}") for c in REQUIRED], F.lit(True).alias("_hit"))
    no_price = F.lit(False)
    for c in PRICES:
        no_price = no_price | F.col(f"o_{c}").isNull()
    kind = (
        F.when(F.col("_hit").isNull(), "security_no_trade_or_suspended")
        .when(F.coalesce(F.col("o_volume"), F.lit(0.0)) <= 0, "official_zero_volume")
        .when(no_price, "official_trade_without_ohlc")
        .otherwise("provider_missing_official_trade")
    )
    return (
        gaps.join(o, ["symbol", "date"], "left")
        .join(actions_by_day(actions), ["symbol", "date"], "left")
        .select(
            "symbol",
            "date",
            kind.alias("classification"),
            F.col("o_volume").alias("official_volume"),
            F.coalesce("corporate_actions", F.array().cast("array<string>")).alias("corporate_actions"),
        )
    )


CLASSES = (
    "provider_missing_official_trade",
    "official_trade_without_ohlc",
    "security_no_trade_or_suspended",
    "official_zero_volume",
    "provider_row_on_non_market_day",
)
WARNING_CLASSES = (
    "provider_missing_official_trade",
    "official_trade_without_ohlc",
    "provider_row_on_non_market_day",
)


def audit_summary(symbols: DataFrame, classified: DataFrame, provider_only: DataFrame) -> DataFrame:
    """Counts per class and integrity status; symbols without findings are kept."""
    found = classified.select("symbol", "classification").unionByName(
        provider_only.select("symbol", F.lit("provider_row_on_non_market_day").alias("classification"))
    )
    counts = found.groupBy("symbol").agg(
        *[F.count_if(F.col("classification") == c).alias(c) for c in CLASSES]
    )
    out = symbols.select("symbol").distinct().join(counts, "symbol", "left").fillna(0, list(CLASSES))
    warned = F.greatest(*WARNING_CLASSES) > 0
    return out.withColumn("official_integrity_status", F.when(warned, "quality_warning").otherwise("available"))
