"""Per-symbol indicators over daily bars.

All windows are keyed by symbol and ordered by date.  A panel is unique on
(symbol, date), so one symbol's partition is bounded by the number of trading
days and the frames below are streamed, never collected.  Operators that share
the window specification share one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark import constants as K


def by_symbol(order: str = "date") -> WindowSpec:
    return Window.partitionBy("symbol").orderBy(order)


def rolling_means(df: DataFrame, column: str, means: Mapping[str, int], w: WindowSpec) -> DataFrame:
    """Add means over the last ``n`` rows, null until ``n`` values exist.

    Differences of running totals: every row costs the same however long the
    frame is, where a sliding frame would be summed anew for each row.  Totals
    are decimals, so a mean depends on its own rows only and equal values give
    equal means; values are taken to eight decimals, and non-finite ones or
    those of 1e18 and more count as missing.
    """
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_exact", F.col(column).try_cast("decimal(26,8)"))
    out = out.withColumns({"_sum": F.sum("_exact").over(run), "_cnt": F.count("_exact").over(run)})

    def part(total: str, n: int) -> Column:
        return F.col(total) - F.coalesce(F.lag(total, n).over(w), F.lit(0))

    out = out.withColumns({name: F.when(part("_cnt", n) == n, (part("_sum", n) / n).cast("double")) for name, n in means.items()})
    return out.drop("_exact", "_sum", "_cnt")


def falsy(c: Column) -> Column:
    """Null comparisons count as false."""
    return F.coalesce(c, F.lit(False))


def sma_deduction(bars: DataFrame, periods: tuple[int, ...] = K.MA_PERIODS) -> DataFrame:
    """SMA, deduction value and slope flag for every period; missing and non-finite closes are dropped."""
    w = by_symbol()
    known = bars.where(F.col("close").isNotNull() & ~F.isnan("close") & (F.abs("close") < float("inf")))
    out = rolling_means(known, "close", {f"sma_{n}": n for n in periods}, w)
    out = out.withColumns({f"deduct_{n}": F.lag("close", n - 1).over(w) for n in periods})
    return out.withColumns({f"slope_up_{n}": falsy(F.col("close") > F.col(f"deduct_{n}")) for n in periods})


def resonance_flag(available: list[str]) -> Column:
    """All slopes up and the shorter averages stacked above the longer ones.

    A missing input column makes the flag false, never an error.
    """
    needed = [f"slope_up_{n}" for n in K.RESONANCE_SLOPES] + [f"sma_{n}" for n in K.RESONANCE_ORDER]
    if not set(needed) <= set(available):
        return F.lit(False)
    slopes = [F.col(f"slope_up_{n}") for n in K.RESONANCE_SLOPES]
    stacked = [F.col(f"sma_{a}") > F.col(f"sma_{b}") for a, b in zip(K.RESONANCE_ORDER, K.RESONANCE_ORDER[1:])]
    return falsy(reduce(lambda a, b: a & b, slopes + stacked))


def with_resonance(bars: DataFrame) -> DataFrame:
    out = sma_deduction(bars)
    return out.withColumn("resonance", resonance_flag(out.columns))


def latest_row(bars: DataFrame, keys: tuple[str, ...] = ("symbol",), order: str = "date") -> DataFrame:
    """Newest row per key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return bars.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def breakdown_reversal(bars: DataFrame, lookback: int = 5, recovery: int = 3) -> DataFrame:
    """Support broken within the recovery span, reclaimed today on rising volume."""
    w = by_symbol()
    prior = w.rowsBetween(-lookback, -1)
    recent = w.rowsBetween(-recovery, -1)
    support = F.when(F.count("close").over(prior) == lookback, F.min("close").over(prior))
    out = bars.withColumn("support", support).withColumn(
        "broke", falsy(F.col("close") < F.col("support")).cast("int")
    )
    # The support series starts one row after its frame fills, hence the row-count guard.
    enough = F.count("broke").over(recent) == recovery
    flag = (
        enough
        & (F.max("broke").over(recent) == 1)
        & (F.col("close") >= F.lag("support").over(w))
        & (F.col("volume") > F.lag("volume").over(w))
    )
    return out.withColumn("breakdown_reversal", falsy(flag)).drop("broke")


def confirmed_pivots(
    bars: DataFrame, lookback: int = K.PIVOT_LOOKBACK, confirm: int = K.PIVOT_CONFIRM
) -> DataFrame:
    """Strict local extremes, published only at the bar that confirms them."""
    w = by_symbol()
    before, after = w.rowsBetween(-lookback, -1), w.rowsBetween(1, confirm)
    marked = bars.select(
        "symbol",
        "date",
        "low",
        "high",
        F.row_number().over(w).alias("idx"),
        F.lead("date", confirm).over(w).alias("confirmed_at"),
        ((F.col("low") < F.min("low").over(before)) & (F.min("low").over(after) > F.col("low"))).alias("is_low"),
        ((F.col("high") > F.max("high").over(before)) & (F.max("high").over(after) < F.col("high"))).alias("is_high"),
    ).where((F.col("idx") > lookback) & F.col("confirmed_at").isNotNull() & (F.col("is_low") | F.col("is_high")))
    sides = F.array(
        F.when(F.col("is_low"), F.struct(F.lit("low").alias("pivot_type"), F.col("low").alias("pivot_price"))),
        F.when(F.col("is_high"), F.struct(F.lit("high").alias("pivot_type"), F.col("high").alias("pivot_price"))),
    )
    return marked.select(
        "symbol",
        F.col("date").alias("pivot_date"),
        F.col("idx").alias("pivot_idx"),
        (F.col("idx") + confirm).alias("confirmed_idx"),
        "confirmed_at",
        F.explode(F.array_compact(sides)).alias("p"),
    ).select("symbol", "p.pivot_type", "pivot_date", "pivot_idx", "p.pivot_price", "confirmed_idx", "confirmed_at")


def latest_pivot_pair(pivots: DataFrame) -> DataFrame:
    """Latest low that has a later and higher high, with the latest such high.

    The highest later high decides whether a low qualifies, so one reverse
    running maximum replaces the low x high self-join; only the single chosen
    low per symbol is then joined to the highs.
    """
    back = Window.partitionBy("symbol").orderBy(F.col("pivot_idx").desc())
    is_high = F.col("pivot_type") == "high"
    # RANGE frame up to the previous index value: highs strictly later than this row.
    later = back.rangeBetween(Window.unboundedPreceding, -1)
    lows = (
        pivots.withColumn("best_later_high", F.max(F.when(is_high, F.col("pivot_price"))).over(later))
        .where(~is_high & (F.col("best_later_high") > F.col("pivot_price")))
        .withColumn("_rn", F.row_number().over(back))
        .where("_rn = 1")
        .select(
            "symbol",
            F.col("pivot_idx").alias("p0_idx"),
            F.col("pivot_date").alias("p0_date"),
            F.col("pivot_price").alias("p0"),
            F.col("confirmed_at").alias("p0_confirmed_at"),
        )
    )
    highs = pivots.where(is_high).select(
        "symbol",
        F.col("pivot_idx").alias("p1_idx"),
        F.col("pivot_date").alias("p1_date"),
        F.col("pivot_price").alias("p1"),
        F.col("confirmed_at").alias("p1_confirmed_at"),
    )
    pick = Window.partitionBy("symbol").orderBy(F.col("p1_idx").desc())
    return (
        lows.join(highs, "symbol")
        .where((F.col("p1_idx") > F.col("p0_idx")) & (F.col("p1") > F.col("p0")))
        .withColumn("_rn", F.row_number().over(pick))
        .where("_rn = 1")
        .drop("_rn")
    )


def wave_targets(waves: DataFrame, digits: int = 2) -> DataFrame:
    """Projection levels from p0, p1 and p2 (p2 defaults to the 0.618 retrace)."""
    leg = F.col("p1") - F.col("p0")
    p2 = F.col("p2") if "p2" in waves.columns else F.lit(None).cast("double")
    out = waves.withColumn("p2", F.coalesce(p2, F.col("p1") - leg * K.WAVE_DEFAULT_RETRACE))
    return out.select(
        *out.columns,
        F.round(leg, digits).alias("wave1_amplitude"),
        *[F.round(F.col(base) + leg * ratio, digits).alias(name) for name, base, ratio in K.WAVE_TARGETS],
    )


def fib_match(elapsed: Column) -> Column:
    """First count within the slack of the elapsed units, else null."""
    counts = F.array(*[F.lit(n) for n in K.FIB_COUNTS])
    near = F.filter(counts, lambda n: F.abs(elapsed - n) <= K.FIB_COUNT_SLACK)
    return F.get(near, F.lit(0))


def realtime_wave(bars: DataFrame, cutoff: str) -> DataFrame:
    """Waves from pivots confirmed by the cutoff; symbols without a pair report why."""
    seen = bars.where(F.col("date") <= F.lit(cutoff).cast("date"))
    pivots = confirmed_pivots(seen).where(F.col("confirmed_at") <= F.lit(cutoff).cast("date"))
    pair = latest_pivot_pair(pivots)
    last = seen.groupBy("symbol").agg(F.max("date").alias("latest_date"), F.count(F.lit(1)).alias("n_bars"))
    kinds = pivots.groupBy("symbol").agg(F.count_distinct("pivot_type").alias("kinds"))
    out = last.join(kinds, "symbol", "left").join(pair, "symbol", "left")
    elapsed = F.col("n_bars") - F.col("p0_idx") + 1
    out = (
        out.withColumn("p2", F.round(F.col("p1") - (F.col("p1") - F.col("p0")) * K.WAVE_RETRACE, 2))
        .withColumn("elapsed_bars", elapsed)
        .withColumn("matching_fib", fib_match(elapsed))
        .withColumn("is_in_window", F.when(F.col("p0").isNotNull(), F.col("matching_fib").isNotNull()))
        .withColumn("status", F.when(F.col("p0").isNotNull(), "available").otherwise("insufficient_data"))
        .withColumn(
            "reason",
            F.when(F.coalesce(F.col("kinds"), F.lit(0)) < 2, "insufficient_confirmed_pivots").when(
                F.col("p0").isNull(), "no_valid_pivot_sequence"
            ),
        )
    )
    return wave_targets(out).drop("kinds")


def hindsight_wave(bars: DataFrame) -> DataFrame:
    """First minimum close over the whole range and the highest close from there on."""
    whole = Window.partitionBy("symbol")
    rows = bars.where(F.col("close").isNotNull()).withColumns(
        {"p0": F.min("close").over(whole), "latest_date": F.max("date").over(whole)}
    )
    rows = rows.withColumn("pivot_date", F.min(F.when(F.col("close") == F.col("p0"), F.col("date"))).over(whole))
    g = rows.where(F.col("date") >= F.col("pivot_date")).groupBy("symbol", "p0", "pivot_date", "latest_date").agg(
        F.max("close").alias("p1"), F.count(F.lit(1)).alias("elapsed_bars")
    )
    g = g.withColumn("p2", F.round(F.col("p1") - (F.col("p1") - F.col("p0")) * K.WAVE_RETRACE, 2))
    return wave_targets(g).withColumn("matching_fib", fib_match(F.col("elapsed_bars")))


def fib_time_window(bars: DataFrame, pivots: DataFrame, monthly: bool = False) -> DataFrame:
    """Elapsed bars (or months) from each pivot to the symbol's last bar, and the hit."""
    w = by_symbol()
    indexed = bars.select("symbol", "date", F.row_number().over(w).alias("idx"))
    last = indexed.groupBy("symbol").agg(F.max("idx").alias("last_idx"), F.max("date").alias("latest_date"))
    out = pivots.join(last, "symbol")
    months = (F.year("latest_date") - F.year("pivot_date")) * 12 + F.month("latest_date") - F.month("pivot_date")
    elapsed = months if monthly else F.col("last_idx") - F.col("pivot_idx") + 1
    return (
        out.withColumn("elapsed_units", elapsed)
        .withColumn("matching_fib", fib_match(F.col("elapsed_units")))
        .withColumn("is_in_window", F.col("matching_fib").isNotNull())
        .drop("last_idx")
    )


def fib_marker_dates(bars: DataFrame, pivots: DataFrame) -> DataFrame:
    """Date of the n-th bar after each pivot, for every count that has been reached."""
    indexed = bars.select("symbol", "date", F.row_number().over(by_symbol()).alias("marker_idx"))
    marks = pivots.select(
        "symbol", "pivot_type", "pivot_idx", "pivot_date", F.explode(F.array(*[F.lit(n) for n in K.FIB_COUNTS])).alias("fib_n")
    ).withColumn("marker_idx", F.col("pivot_idx") + F.col("fib_n"))
    return marks.join(indexed.withColumnRenamed("date", "marker_date"), ["symbol", "marker_idx"]).drop("marker_idx")


def bar_deltas(bars: DataFrame) -> DataFrame:
    """Close-to-close return, calendar-day gap, and date monotonicity in ingest order."""
    w = by_symbol()
    prev = F.lag("close").over(w)
    return bars.select(
        *bars.columns,
        (F.try_divide(F.col("close"), prev) - 1.0).alias("ret"),
        F.datediff("date", F.lag("date").over(w)).alias("gap_days"),
    )


def equity_drawdown(curve: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Running peak, drawdown and simple return of an equity column."""
    w = Window.partitionBy(*keys).orderBy("date")
    peak = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return curve.select(
        *curve.columns,
        peak.alias("peak"),
        (F.try_divide(F.col("equity"), peak) - 1.0).alias("drawdown"),
        (F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1.0).alias("ret"),
    )
