"""Approved-anchor price scenarios, capital tranches, and status composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEC = "decimal(18,6)"


def _dec(c: str) -> Column:
    return F.col(c).cast(DEC)


def equal_amplitude(anchors: DataFrame) -> DataFrame:
    """C + (B - A) with the sign of the first move; zero moves and non-positive levels are rejected."""
    move = _dec("b") - _dec("a")
    level = _dec("c") + move
    reason = (
        F.when((F.col("a") <= 0) | (F.col("b") <= 0) | (F.col("c") <= 0), "anchor_price_invalid")
        .when(move == 0, "zero_move")
        .when(level <= 0, "level_not_positive")
    )
    ok = reason.isNull()
    return anchors.select(
        *anchors.columns,
        reason.alias("reason"),
        F.when(ok, F.when(move > 0, "upward").otherwise("downward")).alias("direction"),
        F.when(ok, F.round(move, 4)).alias("swing_amplitude"),
        F.when(ok, F.round(level, 4)).alias("calculated_level"),
    )


def retracement_0382(anchors: DataFrame) -> DataFrame:
    """B - 0.382 (B - A) of an upward swing."""
    move = _dec("b") - _dec("a")
    reason = F.when((F.col("a") <= 0) | (F.col("b") <= 0), "anchor_price_invalid").when(move <= 0, "not_an_upward_swing")
    ok = reason.isNull()
    return anchors.select(
        *anchors.columns,
        reason.alias("reason"),
        F.when(ok, F.round(move, 4)).alias("swing_amplitude"),
        F.when(ok, F.round(_dec("b") - F.lit("0.382").cast("decimal(4,3)") * move, 4)).alias("calculated_level"),
    )


def anchors_by_role(anchor_sets: DataFrame) -> DataFrame:
    """Anchor array to columns a (origin), b (swing end), c (projection origin)."""

    def price(role: str) -> Column:
        return F.get(F.filter("anchors", lambda x: x["role"] == role), F.lit(0))["price"]

    return anchor_sets.withColumns(
        {"a": price("origin"), "b": price("swing_end"), "c": price("projection_origin")}
    )


def scenario_status(states: DataFrame) -> DataFrame:
    """Per symbol: scenarios available, or why not.

    ``states(symbol, status, decision, ...)`` are latest anchor sets with their
    latest approvals.
    """
    revoked = (F.col("status") == "revoked") | F.col("decision").eqNullSafe("revoked")
    approved = ~revoked & F.col("decision").eqNullSafe("approved")
    g = states.groupBy("symbol").agg(
        F.count_if(approved).alias("scenario_count"),
        F.count_if(revoked).alias("revoked_anchor_sets"),
        F.count_if(~revoked & ~approved).alias("pending_anchor_sets"),
    )
    have = F.col("scenario_count") > 0
    only_revoked = (F.col("revoked_anchor_sets") > 0) & (F.col("pending_anchor_sets") == 0)
    return g.withColumns(
        {
            "status": F.when(have, "available").otherwise("needs_human_input"),
            "reason": F.when(
                ~have,
                F.when(only_revoked, "anchor_approval_revoked").otherwise("approved_manual_anchor_required"),
            ),
        }
    )


def tranche_plan(plans: DataFrame) -> DataFrame:
    """Three budgets per plan, cents half up, the residue in the third.

    ``plans(plan_id, planned_total_capital, trigger_stages array<int>, decision, rule_id)``.
    """
    total = F.round(F.col("planned_total_capital").cast("decimal(18,6)"), 2).cast("decimal(18,2)")
    third = F.round(total / F.lit(3).cast("decimal(2,0)"), 2).cast("decimal(18,2)")
    budget = F.when(F.col("stage") == 3, F.col("total") - 2 * F.col("third")).otherwise(F.col("third"))
    stages = F.col("trigger_stages")
    ordered = stages == F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), 1, F.size(stages))
    complete = F.size(stages) == 3
    approved = complete & F.col("decision").eqNullSafe("approved") & F.col("rule_id").eqNullSafe("ENT-02")
    reason = (
        F.when(total <= 0, "capital_not_positive")
        .when(F.size(stages) > 3, "fourth_entry_forbidden")
        .when(~ordered, "triggers_not_ordered")
        .when(~complete, "deployment_triggers_required")
        .when(~approved, "approved_deployment_plan_required")
    )
    base = plans.select(
        "plan_id",
        total.alias("total"),
        third.alias("third"),
        F.size(stages).alias("n_triggers"),
        F.when(reason.isNull(), "available").otherwise("needs_human_input").alias("status"),
        reason.alias("reason"),
        F.explode(F.sequence(F.lit(1), F.lit(3))).alias("stage"),
    )
    return base.select(
        "plan_id",
        "stage",
        F.col("total").alias("planned_total_capital"),
        budget.alias("capital_budget"),
        (F.lit(3) - F.col("stage")).alias("remaining_entries"),
        (F.col("stage") <= F.col("n_triggers")).alias("has_trigger"),
        "status",
        "reason",
    )


def plan_status(states: DataFrame) -> DataFrame:
    """Per symbol: any approved plan, else the most telling reason.

    ``states(symbol, status, decision, rule_id, n_triggers)``.
    """
    revoked = (F.col("status") == "revoked") | F.col("decision").eqNullSafe("revoked")
    complete = F.col("n_triggers") == 3
    good = ~revoked & complete & F.col("decision").eqNullSafe("approved") & F.col("rule_id").eqNullSafe("ENT-02")
    rank = F.when(good, 3).when(revoked, 2).when(~complete, 1).otherwise(0)
    g = states.groupBy("symbol").agg(F.max(rank).alias("r"), F.count(F.lit(1)).alias("plans"))
    reasons = F.create_map(
        F.lit(2), F.lit("deployment_plan_approval_revoked"),
        F.lit(1), F.lit("deployment_triggers_required"),
        F.lit(0), F.lit("approved_deployment_plan_required"),
    )
    return g.select(
        "symbol",
        "plans",
        F.when(F.col("r") == 3, "available").otherwise("needs_human_input").alias("status"),
        F.try_element_at(reasons, F.col("r")).alias("reason"),
    )


def compose_status(*sections: str) -> Column:
    """Overall status of section status columns."""
    s = F.array(*[F.col(c) for c in sections])
    complete = ("available", "not_applicable")
    usable = (*complete, "partial", "quality_warning")
    return (
        F.when(F.forall(s, lambda x: F.coalesce(x.isin(*complete), F.lit(False))), "available")
        .when(F.exists(s, lambda x: F.coalesce(x.isin(*usable), F.lit(False))), "partial")
        .when(F.exists(s, lambda x: F.coalesce(x == "needs_human_input", F.lit(False))), "needs_human_input")
        .otherwise("insufficient_data")
    )
