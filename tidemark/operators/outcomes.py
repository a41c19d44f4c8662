"""Later evaluation of stored price ranges against the bars that followed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numbers import half_up
from tidemark.operators.asof import asof_lookup
from tidemark.operators.counting import grouped_medians


def session_index(calendar: DataFrame) -> DataFrame:
    """Sessions numbered from zero (one row per day, one small ordered partition)."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return calendar.select("date").distinct().withColumn("session", F.row_number().over(w) - 1)


def eligible_subjects(subjects: DataFrame) -> DataFrame:
    """Known families whose role fits: only the support family may be a support, plus clusters."""
    support = F.col("semantic_role") == "support"
    single = F.col("method_family").isin(*K.TARGET_FAMILIES, K.SUPPORT_FAMILY) & (
        (F.col("method_family") == K.SUPPORT_FAMILY) == support
    )
    return subjects.where(single | (F.col("method_family") == K.CLUSTER_FAMILY))


def forward_paths(bars: DataFrame, sessions: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """For every bar and horizon: extremes and last close of the sessions ahead, and their bars.

    All of it depends on symbol and day only, so it is built once however many
    subjects start there; a list is at most horizon + 1 long.
    """
    placed = bars.join(sessions, "date")
    w = Window.partitionBy("symbol").orderBy("session")
    bar = F.struct("session", "low", "high", "date")

    def ahead(h: int) -> Column:
        frame = w.rangeBetween(0, h)
        return F.struct(
            F.lit(h).alias("horizon_sessions"),
            F.count(F.lit(1)).over(frame).alias("bars"),
            F.max("high").over(frame).alias("top"),
            F.min("low").over(frame).alias("bottom"),
            F.last("close").over(frame).alias("last_close"),
            F.collect_list(bar).over(frame).alias("path"),
        )

    rows = placed.select("symbol", "date", "session", "open", F.array(*[ahead(h) for h in horizons]).alias("_a"))
    return rows.select("symbol", "date", "session", "open", F.explode("_a").alias("_a")).select(
        "symbol", F.col("date").alias("start_date"), F.col("session").alias("start_session"), F.col("open").alias("start_open"), "_a.*"
    )


def outcome_starts(subjects: DataFrame, bars: DataFrame) -> DataFrame:
    """First bar after each (symbol, cutoff day); asked once per distinct pair."""
    asks = subjects.select("symbol", "cutoff_date").distinct()
    have = bars.select("symbol", F.col("date").alias("start_date"))
    return asof_lookup(
        asks, have, "cutoff_date", "start_date", [], lambda t: F.trunc(t, "month"), keys=("symbol",), forward=True
    )


def evaluate_outcomes(
    subjects: DataFrame,
    bars: DataFrame,
    benchmark: DataFrame,
    calendar: DataFrame,
    quality: DataFrame,
    observed_through: str,
    horizons: Sequence[int] = K.HORIZONS,
) -> DataFrame:
    """One row per subject and horizon: excursions, returns, first touch, terminal outcome."""
    sessions = session_index(calendar)
    paths = forward_paths(bars, sessions, horizons)
    by_day = sessions.select(F.col("date").alias("end_date"), F.col("session").alias("end_session"))
    bench = benchmark.join(sessions, "date")
    b_start = bench.select(F.col("session").alias("start_session"), F.col("open").alias("b_open"))
    b_end = bench.select(F.col("session").alias("end_session"), F.col("close").alias("b_close"))
    rows = (
        eligible_subjects(subjects)
        .join(outcome_starts(subjects, bars.join(sessions, "date", "left_semi")), ["symbol", "cutoff_date"], "left")
        .withColumn("horizon_sessions", F.explode(F.array(*[F.lit(h) for h in horizons])))
        .join(paths, ["symbol", "start_date", "horizon_sessions"], "left")
        .withColumn("end_session", F.col("start_session") + F.col("horizon_sessions"))
        .join(by_day, "end_session", "left")
        .join(b_start, "start_session", "left")
        .join(b_end, "end_session", "left")
        .join(quality.select("symbol", F.col("status").alias("quality_status")), "symbol", "left")
    )
    lo, hi, start = F.col("price_low"), F.col("price_high"), F.col("start_open")
    touched = F.filter("path", lambda b: (b["low"] <= hi) & (b["high"] >= lo))
    rows = rows.withColumn("_touch", F.get(touched, F.lit(0)))
    state = (
        F.when(F.col("start_date").isNull() | F.col("end_date").isNull(), "insufficient_future_data")
        .when(F.col("end_date") > F.lit(observed_through).cast("date"), "pending")
        .when(F.col("bars") != F.col("horizon_sessions") + 1, "insufficient_future_data")
    )
    rows = rows.withColumn("_early", state)
    done = F.col("_early").isNull()
    position = (
        F.when(start.between(lo, hi), "already_in_range").when(start < lo, "above_start").otherwise("below_start")
    )
    up = F.col("top") / start - 1.0
    floor_price = F.col("bottom")
    down = floor_price / start - 1.0
    ret = F.col("last_close") / start - 1.0
    bret = F.col("b_close") / F.col("b_open") - 1.0
    support = F.col("semantic_role") == "support"
    reached = F.col("_touch").isNotNull()
    breached = F.when(start >= hi, floor_price < lo)
    warned = F.col("quality_status").eqNullSafe("quality_warning")
    in_range = position == "already_in_range"
    outcome = (
        F.when(~done, F.col("_early"))
        .when(support, "not_applicable")
        .when(in_range, "already_in_range")
        .when(warned, "quality_warning")
        .when(reached, "target_reached")
        .otherwise("expired")
    )
    directional = done & ~support & ~in_range
    rated = directional & ~warned
    above = position == "above_start"
    return rows.select(
        "snapshot_id",
        "subject_id",
        "symbol",
        F.when(F.col("capture_mode") == "live_refresh", "prospective_snapshot").otherwise("historical_reconstruction").alias("evaluation_origin"),
        "subject_type",
        "method_family",
        "semantic_role",
        "evidence_strength",
        "horizon_sessions",
        "quality_status",
        outcome.alias("terminal_outcome"),
        F.col("start_date").alias("evaluation_start_session"),
        F.when(F.col("start_date").isNotNull(), F.col("end_date")).alias("evaluation_end_session"),
        F.when(done, position).alias("target_position_at_start"),
        F.when(done, half_up(up, 6)).alias("maximum_upside_excursion"),
        F.when(done, half_up(down, 6)).alias("maximum_downside_excursion"),
        F.when(done, half_up(ret, 6)).alias("forward_return"),
        F.when(done, half_up(bret, 6)).alias("benchmark_return"),
        F.when(done, half_up(ret - bret, 6)).alias("excess_return"),
        F.when(done & bret.isNotNull(), "available").otherwise("insufficient_data").alias("benchmark_status"),
        F.when(rated, reached).when(done & ~support & in_range, F.lit(False)).alias("target_reached"),
        F.when(rated, F.col("_touch.date")).alias("first_target_reached_at"),
        F.when(rated, F.col("_touch.session") - F.col("start_session")).alias("sessions_to_target"),
        F.when(directional, half_up(F.when(above, up).otherwise(-down), 6)).alias("directional_mfe"),
        F.when(directional, half_up(F.when(above, down).otherwise(-up), 6)).alias("directional_mae"),
        F.when(done & support, reached).alias("support_touched"),
        F.when(done & support, reached & F.coalesce(~breached, F.lit(False))).alias("support_held"),
        F.when(done & support, breached).alias("support_breached"),
    )


def sessions_skipped(subjects: DataFrame, bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sessions between the cutoff day and the first bar, per subject."""
    sessions = session_index(calendar)
    s = outcome_starts(subjects, bars).join(sessions.withColumnRenamed("date", "start_date"), "start_date", "left")
    first = asof_lookup(
        s,
        sessions.select(F.col("date").alias("first_date"), F.col("session").alias("first_session")),
        "cutoff_date",
        "first_date",
        ["first_session"],
        lambda t: F.trunc(t, "month"),
        forward=True,
    )
    skipped = first.select("symbol", "cutoff_date", "start_date", (F.col("session") - F.col("first_session")).alias("market_sessions_skipped"))
    return subjects.select("subject_id", "symbol", "cutoff_date").join(skipped, ["symbol", "cutoff_date"], "left")


GROUP = ("evaluation_origin", "horizon_sessions", "method_family", "evidence_strength", "subject_type")


MEDIANS = {
    "median_forward_return": "forward_return",
    "median_excess_return": "excess_return",
    "median_upside_excursion": "maximum_upside_excursion",
    "median_downside_excursion": "maximum_downside_excursion",
}


def outcome_summary(results: DataFrame) -> DataFrame:
    """Counts, reach rate, medians and outcome counts per group.

    Counts combine in the tasks; medians are selected by histograms of the
    values, so no group's values are gathered.
    """
    rated = (
        (F.col("semantic_role") == "target")
        & F.col("terminal_outcome").isin("target_reached", "expired")
        & (F.col("quality_status") == "available")
    )
    won = rated & (F.col("terminal_outcome") == "target_reached")
    kinds = (
        "target_reached",
        "expired",
        "already_in_range",
        "not_applicable",
        "quality_warning",
        "insufficient_future_data",
        "pending",
    )
    counts = results.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(won).alias("numerator"),
        F.count_if(rated).alias("denominator"),
        half_up(F.try_divide(F.count_if(won).cast("double"), F.count_if(rated)), 8).alias("reach_rate"),
        *[F.count_if(F.col("terminal_outcome") == k).alias(f"n_{k}") for k in kinds],
    )
    middle = grouped_medians(results, GROUP, {name: F.when(rated, F.col(c)) for name, c in MEDIANS.items()})
    middle = middle.select(*[F.col(k).alias(f"_{k}") for k in GROUP], *[half_up(name, 8).alias(name) for name in MEDIANS])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in GROUP]
    first = ["n", "numerator", "denominator", "reach_rate"]
    return counts.join(middle, same, "left").select(*GROUP, *first, *MEDIANS, *[f"n_{k}" for k in kinds])


def outcome_coverage(results: DataFrame) -> DataFrame:
    """Distinct subjects, symbols and snapshots behind the results.

    Rows are first reduced to one per subject, so each distinct count runs on
    the reduced set and is combined on the map side.
    """
    per = results.groupBy("snapshot_id", "subject_type", "subject_id", "symbol").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("quality_status") == "quality_warning").alias("warned"),
    )
    per_snapshot = per.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("subjects"),
        F.sum("records").alias("records"),
        F.sum("warned").alias("warned"),
        *[F.count_if(F.col("subject_type") == t).alias(t) for t in ("target_candidate", "target_cluster", "support_candidate")],
    )
    return per_snapshot.agg(
        F.count(F.lit(1)).alias("snapshots"),
        F.sum("subjects").alias("subjects"),
        F.sum("records").alias("records"),
        F.sum("warned").alias("quality_warning_records"),
        F.count_if(F.col("warned") > 0).alias("quality_warning_snapshots"),
        F.first(per.select(F.count_distinct("symbol")).scalar()).alias("symbols"),
        F.sum("target_candidate").alias("target_candidates"),
        F.sum("target_cluster").alias("target_clusters"),
        F.sum("support_candidate").alias("support_candidates"),
    )
