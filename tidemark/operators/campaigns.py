"""Signal campaigns: next bar, conflicts, order of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import first_reason
from tidemark.operators.asof import asof_lookup

STAGES = 3


def next_bar(events: DataFrame, bars: DataFrame) -> DataFrame:
    """First bar strictly after each event, with its open."""
    usable = bars.where(F.col("open").isNotNull()).select("bar_at", "open")
    return asof_lookup(
        events, usable, "signal_at", "bar_at", ["open"], lambda t: F.date_trunc("day", t), forward=True
    )


def conflicting_instants(events: DataFrame) -> DataFrame:
    """(campaign, instant) pairs that carry more than one event."""
    g = events.groupBy("campaign_id", "signal_at").agg(F.count(F.lit(1)).alias("events"))
    return g.where("events > 1")


def stage_sequence(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Outcome of every event of every campaign.

    Conflicting, mismatched or bar-less events never change a campaign.  What is
    left has distinct instants per campaign, so the milestones are three chained
    minima and the first valid invalidation: aggregates with one row per
    campaign, joined back by campaign; no campaign is replayed in order.
    """
    clash = conflicting_instants(events).select("campaign_id", "signal_at", F.lit(True).alias("_clash"))
    rows = next_bar(events, bars).join(clash, ["campaign_id", "signal_at"], "left")
    trigger_ok = F.col("trigger_matches") if "trigger_matches" in events.columns else F.lit(True)
    entry = F.col("event_kind") == "entry"
    defect = first_reason(
        (F.col("_clash").isNotNull(), "ambiguous_same_time_events"),
        (entry & ~trigger_ok, "trigger_reference_mismatch"),
        (F.col("bar_at").isNull(), "no_next_available_bar"),
        (F.col("open") <= 0, "invalid_execution_open"),
    )
    rows = rows.withColumn("_defect", defect)
    valid = rows.where(F.col("_defect").isNull()).select("campaign_id", "event_kind", "stage", "signal_at")
    first = valid.groupBy("campaign_id").agg(
        F.min(F.when(F.col("event_kind") == "invalidation", F.col("signal_at"))).alias("ended_at"),
        F.min(F.when(F.col("stage") == 1, F.col("signal_at"))).alias("t1"),
    )
    marks = first.withColumn("t1", F.when(F.col("ended_at").isNull() | (F.col("t1") < F.col("ended_at")), F.col("t1")))
    for k in range(2, STAGES + 1):
        prev = F.col(f"t{k - 1}")
        later = (
            valid.where(F.col("stage") == k)
            .join(marks, "campaign_id")
            .where((F.col("signal_at") > prev) & (F.col("ended_at").isNull() | (F.col("signal_at") < F.col("ended_at"))))
            .groupBy("campaign_id")
            .agg(F.min("signal_at").alias(f"t{k}"))
        )
        marks = marks.join(later, "campaign_id", "left")
    out = rows.join(marks, "campaign_id", "left")
    at = F.col("signal_at")
    hit = F.lit(False)
    expected = F.lit(1)
    for k in range(1, STAGES + 1):
        hit = hit | ((F.col("stage") == k) & (at == F.col(f"t{k}")))
        expected = expected + F.coalesce((F.col(f"t{k}") < at).cast("int"), F.lit(0))
    hit = F.coalesce(hit, F.lit(False))
    over = F.coalesce(at > F.col("ended_at"), F.lit(False))
    clash_first = F.col("_defect").eqNullSafe("ambiguous_same_time_events")
    outcome = (
        F.when(clash_first, F.col("_defect"))
        .when(entry & over, "campaign_already_invalidated")
        .when(F.col("_defect").isNotNull(), F.col("_defect"))
        .when(entry & hit, "entry_confirmed")
        .when(entry, "stage_sequence_violation")
        .when((at == F.col("ended_at")) & F.col("t1").isNotNull(), "invalidation_confirmed")
        .otherwise("nothing_to_invalidate")
    )
    out = out.withColumn("outcome", outcome)
    return out.select(
        "event_id",
        "campaign_id",
        "signal_at",
        "event_kind",
        "stage",
        "outcome",
        F.when(F.col("outcome") == "stage_sequence_violation", expected).alias("expected_stage"),
    )
