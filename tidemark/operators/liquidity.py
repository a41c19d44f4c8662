"""Market turnover against money supply: pairing, as-of lookup, history, alert.

The turnover and money-supply tables hold one row per market day and a few rows
per month, whatever the number of trades behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numbers import half_up
from tidemark.operators.asof import newest, visible
from tidemark.operators.counting import dominance_counts


def turnover_status(markets: DataFrame, revoked_days: DataFrame | None = None) -> DataFrame:
    """Pair two markets per day: both give a total, one is partial without total."""
    paired = markets.groupBy("trade_date").agg(
        F.max(F.when(F.col("market") == "A", F.col("value"))).alias("market_a"),
        F.max(F.when(F.col("market") == "B", F.col("value"))).alias("market_b"),
    )
    both = F.col("market_a").isNotNull() & F.col("market_b").isNotNull()
    status = F.when(both, "available").otherwise("partial")
    if revoked_days is not None:
        gone = revoked_days.select("trade_date", F.lit(True).alias("_revoked")).distinct()
        paired = paired.join(gone, "trade_date", "left")
        status = F.when(F.col("_revoked").isNotNull(), "revoked").otherwise(status)
    out = paired.withColumn("status", status)
    total = F.when(F.col("status") == "available", F.col("market_a") + F.col("market_b"))
    return out.select("trade_date", "market_a", "market_b", total.alias("total"), "status")


def publication_binding(m1b: DataFrame, evidence: DataFrame, cutoff: str) -> DataFrame:
    """State of the link between a money-supply row and its publication evidence.

    ``m1b(..., period, publication_evidence_id)``;
    ``evidence(publication_evidence_id, period, revision_number, status, ingested_at)``.
    """
    seen = evidence.where(F.col("ingested_at") <= F.lit(cutoff).cast("timestamp"))
    latest = newest(seen, ["period"], ["revision_number", "ingested_at", "publication_evidence_id"]).select(
        "period", F.col("publication_evidence_id").alias("latest_id"), F.col("status").alias("latest_status")
    )
    bound = seen.select("publication_evidence_id", F.col("status").alias("bound_status"))
    out = m1b.join(latest, "period", "left").join(bound, "publication_evidence_id", "left")
    own = F.col("publication_evidence_id")
    state = (
        F.when(F.col("latest_id").isNull() & own.isNull(), "unbound_no_publication_evidence")
        .when((F.col("latest_status") == "accepted") & (F.col("latest_id") == own), "exact_accepted_binding")
        .when(F.col("latest_id").isNotNull() & ~F.col("latest_id").eqNullSafe(own), "binding_mismatch")
        .otherwise("bound_evidence_not_accepted")
    )
    out = out.withColumn("publication_binding_status", state)
    good = F.col("publication_binding_status").isin("unbound_no_publication_evidence", "exact_accepted_binding")
    return out.withColumn("eligible", good)


def m1b_spans(m1b: DataFrame, cutoff: str) -> DataFrame:
    """When each revision is the newest visible one of its period.

    A revision holds from its own publication until any higher revision is
    published; revoked revisions keep their span but are not offered.
    """
    seen = m1b.where(F.col("ingested_at") <= F.lit(cutoff).cast("timestamp"))
    series = [c for c in ("period", "dataset") if c in m1b.columns]  # datasets revise on their own
    higher = Window.partitionBy(*series).orderBy(F.col("revision").desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = seen.withColumn("held_until", F.min("available_at").over(higher))
    usable = F.col("status") == "available"
    if "eligible" in m1b.columns:  # result of publication_binding
        usable = usable & F.col("eligible")
    return spans.where(
        usable
        & (F.col("held_until").isNull() | (F.col("available_at") < F.col("held_until")))
    )


def asof_m1b(turnover: DataFrame, m1b: DataFrame, cutoff: str) -> DataFrame:
    """Money supply that was public when each turnover row became public.

    Spans are spread over the months they touch, so the lookup is an equi-join
    on the month followed by the exact time test.
    """
    c = F.lit(cutoff).cast("timestamp")
    rows = turnover.where((F.col("available_at") <= c) & (F.col("ingested_at") <= c)).withColumn(
        "public_at", F.least("available_at", c)
    )
    month = F.year("public_at") * 12 + F.month("public_at")
    spans = m1b_spans(m1b, cutoff)
    series = ["m1b_dataset"] if "dataset" in m1b.columns else []
    end = F.coalesce("held_until", c)
    first = F.year("available_at") * 12 + F.month("available_at")
    last = F.greatest(first, F.year(end) * 12 + F.month(end))
    spread = spans.select(
        F.explode(F.sequence(first, last)).alias("_month"),
        F.col("period").alias("m1b_period"),
        F.col("revision").alias("m1b_revision"),
        F.col("value_twd").alias("m1b_twd"),
        F.col("available_at").alias("m1b_available_at"),
        F.col("ingested_at").alias("_m1b_ingested_at"),
        "held_until",
        *[F.col("dataset").alias("m1b_dataset") for _ in series],
    )
    hit = (
        rows.withColumn("_month", month)
        .join(spread, "_month")
        .where(
            (F.col("m1b_available_at") <= F.col("public_at"))
            & (F.col("held_until").isNull() | (F.col("held_until") > F.col("public_at")))
        )
    )
    best = newest(hit, ["trade_date"], ["m1b_available_at", "m1b_period", "m1b_revision", "_m1b_ingested_at", *series])
    cols = ["trade_date", "m1b_period", "m1b_revision", "m1b_twd", "m1b_available_at", *series]
    return rows.join(best.select(*cols), "trade_date", "left")


def turnover_asof(ledger: DataFrame, cutoff: str) -> DataFrame:
    """Newest visible revision of each day, whatever its status."""
    return newest(visible(ledger, cutoff), ["trade_date"], ["revision", "available_at", "ingested_at"])


def asof_bound_m1b(ledger: DataFrame, m1b: DataFrame, evidence: DataFrame, cutoff: str) -> DataFrame:
    """``asof_m1b`` for the newest turnover revisions, over money supply whose publication evidence holds at the cutoff.

    Datasets of ``m1b`` revise on their own; among equal times the later
    period, revision, receipt and then dataset name wins.
    """
    bound = publication_binding(m1b, evidence, cutoff)
    return asof_m1b(turnover_asof(ledger, cutoff), bound, cutoff)


def ratio_observations(joined: DataFrame) -> DataFrame:
    """Complete days with turnover / money supply in percent."""
    ok = (F.col("status") == "available") & (F.col("total") > 0) & (F.col("m1b_twd") > 0)
    return joined.where(ok).withColumn("ratio_pct", half_up(F.col("total") / F.col("m1b_twd") * 100.0, 8))


def rolling_ratio(observations: DataFrame, windows: tuple[int, ...] = K.ROLLING_RATIO_WINDOWS) -> DataFrame:
    """Means over the last n complete days, null while fewer exist, with the counts.

    One row per market day is ordered in a single partition on purpose.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("trade_date")
    cols = []
    for n in windows:
        frame = w.rowsBetween(-(n - 1), 0)
        count = F.count("ratio_pct").over(frame)
        cols.append(F.when(count == n, half_up(F.avg("ratio_pct").over(frame), 8)).alias(f"rolling_mean_{n}"))
        cols.append(count.alias(f"rolling_count_{n}"))
    return observations.select(*observations.columns, *cols)


def trailing_percentiles(observations: DataFrame, spans: Sequence[tuple[int, int]]) -> DataFrame:
    """Share of the last years at or below today's ratio, per day, for several (years, minimum) at once.

    Columns percentile_<years> and observations_<years>.  A day's window holds
    the days up to it without those before its start: two prefixes of the
    ordered days, whose values at or below today's are counted offline for all
    days and spans in one pass.  History must reach back to the window start
    and hold the minimum number of days.
    """
    # One row per market day is numbered in a single small partition; starts are placed among the days by merging.
    one = Window.partitionBy(F.lit(0)).orderBy("at", "kind", "day")
    days = observations.select(F.col("trade_date").alias("at"), F.lit(1).alias("kind"), F.col("trade_date").alias("day"), F.col("ratio_pct").alias("value"), F.lit(0).alias("years"))
    marks = days
    for years, _ in spans:
        start = F.add_months("at", -12 * years)
        marks = marks.unionByName(days.select(start.alias("at"), F.lit(0).alias("kind"), "day", "value", F.lit(years).alias("years")))
    known = F.sum("kind").over(one.rowsBetween(Window.unboundedPreceding, 0))
    everything = Window.partitionBy(F.lit(0))
    marks = marks.withColumns({"known": known, "size": F.sum("kind").over(everything), "first_day": F.min(F.when(F.col("kind") == 1, F.col("at"))).over(everything)})
    # Days on the start belong to the window: known counts those before it, for starts sort before days.
    asks = marks.select(F.concat_ws("|", F.col("day").cast("string"), F.col("years").cast("string")).alias("id"), F.col("known").alias("upto"), "value", "size", "day", "years", "kind", "at", "first_day")
    points = marks.where("kind = 1").select((F.col("known") - 1).alias("pos"), "value", "size")
    counts = dominance_counts(points, asks, F.col("size"))
    placed = asks.join(counts, "id").groupBy("day").agg(
        F.max(F.when(F.col("kind") == 1, F.struct("n", "upto"))).alias("now"),
        *[F.max(F.when(F.col("years") == y, F.struct("n", "upto", "at", "first_day"))).alias(f"before_{y}") for y, _ in spans],
    )
    out = [F.col("day").alias("trade_date")]
    for years, minimum in spans:
        old = f"before_{years}"
        n, below = F.col("now.upto") - F.col(f"{old}.upto"), F.col("now.n") - F.col(f"{old}.n")
        ok = (F.col(f"{old}.first_day") <= F.col(f"{old}.at")) & (n >= minimum)
        out += [F.when(ok, half_up(below.cast("double") / n.cast("double") * 100.0, 4)).alias(f"percentile_{years}"), n.alias(f"observations_{years}")]
    return placed.select(*out)


def trailing_percentile(observations: DataFrame, years: int, minimum: int) -> DataFrame:
    """``trailing_percentiles`` for one span: trade_date, percentile, observations."""
    return trailing_percentiles(observations, [(years, minimum)]).withColumnsRenamed({f"percentile_{years}": "percentile", f"observations_{years}": "observations"})


def liquidity_history(
    observations: DataFrame, short: tuple[int, int] = (5, 1000), long: tuple[int, int] = (10, 2000)
) -> DataFrame:
    """Rolling means, both percentiles and the alert level for every complete day."""
    names = {f"{kind}_{span[0]}": f"{kind}_{name}" for name, span in (("short", short), ("long", long)) for kind in ("percentile", "observations")}
    both = trailing_percentiles(observations, [short, long]).withColumnsRenamed(names)
    out = rolling_ratio(observations).join(both, "trade_date")
    heat = F.coalesce("percentile_short", "percentile_long")
    alert = (
        F.when(F.col("ratio_pct").between(K.REFERENCE_RATIO_LOW, K.REFERENCE_RATIO_HIGH), "reference_extreme_case")
        .when(heat >= K.HIGH_PERCENTILE, "historically_high")
        .when(heat >= K.ELEVATED_PERCENTILE, "elevated")
        .otherwise("normal")
    )
    return out.withColumn("alert_level", alert)


def latest_liquidity(joined: DataFrame, history: DataFrame) -> DataFrame:
    """State of the newest turnover day: analysed, partial, revoked or without money supply."""
    last = joined.select("trade_date", "status", "total", "m1b_twd").orderBy(F.col("trade_date").desc()).limit(1)
    out = last.withColumnRenamed("status", "turnover_status").join(
        history.drop("status", "total", "m1b_twd", "market_a", "market_b", "available_at", "ingested_at"),
        "trade_date",
        "left",
    )
    status = F.col("turnover_status")
    reason = (
        F.when(status == "partial", "both_market_turnovers_are_required")
        .when(status == "revoked", "latest_market_turnover_revoked")
        .when(F.col("ratio_pct").isNull(), "m1b_unavailable_for_latest_turnover")
    )
    return out.select(
        "trade_date",
        F.when(reason.isNull(), "available").when(status == "partial", "partial").otherwise("insufficient_data").alias("status"),
        reason.alias("reason"),
        "ratio_pct",
        F.coalesce("alert_level", F.lit("insufficient_data")).alias("alert_level"),
    )


def latest_within_days(turnover: DataFrame, as_of: str, days: int = 10) -> DataFrame:
    """Newest complete turnover of the last calendar days."""
    end = F.lit(as_of).cast("date")
    inside = turnover.where(
        (F.col("status") == "available") & F.col("trade_date").between(F.date_sub(end, days), end)
    )
    return inside.agg(
        F.max("trade_date").alias("trade_date"), F.max_by("total", "trade_date").alias("total")
    ).where(F.col("trade_date").isNotNull())


def overheat(observations: DataFrame, threshold: float = K.TURNOVER_M1B_THRESHOLD) -> DataFrame:
    """Turnover share of money supply against a fixed bound; missing inputs stay undecided."""
    ok = F.coalesce((F.col("total") > 0) & (F.col("m1b_twd") > 0), F.lit(False))
    ratio = half_up(F.try_divide(F.col("total"), F.col("m1b_twd")), 6)
    return observations.select(
        "trade_date",
        F.when(ok, "available").otherwise("insufficient_data").alias("status"),
        F.when(ok, ratio).alias("ratio"),
        F.when(ok, ratio >= threshold).alias("is_overheat"),
    )
