"""Row validation with reasons, and change-only revision filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numbers import first_reason
from tidemark.operators.asof import bucketed_lag, bucketed_rank

MIN_OBSERVATIONS = 20

ANCHOR_ROLES = {
    "FB-03": ("origin", "projection_origin", "swing_end"),
    "FB-04": ("origin", "swing_end"),
}
ROLE_ORDER = {
    "FB-03": ("origin", "swing_end", "projection_origin"),
    "FB-04": ("origin", "swing_end"),
}

# Policies that a profile must state, labels in rising order, states of a resource.
SYNTHESIS_POLICIES = {
    "role_compatibility_policy": "target_only_for_strength_support_alignment",
    "point_to_range_policy": "relative_ratio",
    "boundary_policy": "closed",
    "cluster_policy": "maximal_active_target_sets_v1",
    "dependency_policy_version": "connected_components_v1",
    "rounding_mode": "ROUND_HALF_UP",
}
EVALUATION_POLICIES = {
    "start_policy": "next_symbol_tradable_session_after_cutoff_local_date",
    "start_price_policy": "adjusted_open",
    "end_price_policy": "adjusted_close",
    "target_touch_policy": "closed_boundary_intraday",
    "already_in_range_policy": "separate_not_future_hit",
    "benchmark_policy": "taiwan_taiex_price_return",
    "outcome_completeness_policy": "complete_horizon_required",
}
STRENGTH_LABELS = ("low", "moderate", "high")
ELIGIBLE, AWAITING = "eligible", "awaiting_review"
USABLE_QUALITY = ("fresh", "quality_warning")
RESOURCE_IDENTITY = ("raw_resource_revision_id", "provider_id", "resource_id", "logical_revision_key", "parser_version")


def validate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``reasons``: names of all rules that are broken.  A rule is broken when its column is true."""
    checks = [F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*checks)))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their reasons."""
    good = F.size("reasons") == 0
    return checked.where(good).drop("reasons"), checked.where(~good)


def _positive(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) <= 0) | F.isnan(c)


def clock_rules(published: str = "published_at", available: str = "available_at", received: str = "ingested_at") -> dict[str, Column]:
    return {
        "published_after_available": F.col(published) > F.col(available),
        "available_after_received": F.col(available) > F.col(received),
        "clock_missing": F.col(available).isNull() | F.col(received).isNull(),
    }


def eps_rules() -> dict[str, Column]:
    low, base, high = F.col("eps_low"), F.col("eps_base"), F.col("eps_high")
    return {
        "symbol_missing": F.coalesce(F.trim("symbol"), F.lit("")) == "",
        "base_missing": base.isNull() | F.isnan(base),
        "scenario_order": (low > base) | (base > high) | (low > high),
        "revision_number_invalid": F.col("revision_number") < 1,
        "first_revision_has_parent": (F.col("revision_number") == 1) & F.col("revision_of").isNotNull(),
        "parent_missing": (F.col("revision_number") > 1) & F.col("revision_of").isNull(),
        **clock_rules(),
    }


def pe_rules() -> dict[str, Column]:
    named = [F.col(c).isNotNull().cast("int") for c in ("symbol", "industry", "market")]
    return {
        "pe_not_positive": _positive("pe_value"),
        "scope_not_exclusive": (named[0] + named[1] + named[2]) != 1,
        "scope_value_missing": F.when(F.col("scope") == "symbol", F.col("symbol").isNull())
        .when(F.col("scope") == "industry", F.col("industry").isNull())
        .when(F.col("scope") == "market", F.col("market").isNull())
        .otherwise(True),
        "validity_reversed": F.col("effective_from") >= F.col("effective_to"),
    }


def _anchor(role: str) -> Column:
    return F.get(F.filter("anchors", lambda a: a["role"] == role), F.lit(0))


def anchor_rules() -> dict[str, Column]:
    """Exactly the roles of the rule, positive prices, strictly rising dates in role order."""
    roles = F.array_sort(F.transform("anchors", lambda a: a["role"]))
    expected = F.lit(None).cast("array<string>")
    ordered = F.lit(None).cast("array<date>")
    for rule, names in ANCHOR_ROLES.items():
        dates = F.array(*[_anchor(r)["market_date"] for r in ROLE_ORDER[rule]])
        expected = F.when(F.col("rule_id") == rule, F.array(*[F.lit(n) for n in names])).otherwise(expected)
        ordered = F.when(F.col("rule_id") == rule, dates).otherwise(ordered)
    pairs = F.arrays_zip(F.slice(ordered, 1, F.size(ordered) - 1).alias("a"), F.slice(ordered, 2, F.size(ordered)).alias("b"))
    return {
        "rule_unknown": expected.isNull(),
        "anchor_roles": roles != expected,
        "anchor_price": F.exists("anchors", lambda a: a["price"].isNull() | (a["price"] <= 0)),
        "anchor_chronology": (F.size(ordered) > 1) & (roles == expected) & F.exists(pairs, lambda p: p["a"] >= p["b"]),
    }


def plan_rules() -> dict[str, Column]:
    stages = F.col("trigger_stages")
    return {
        "capital_not_positive": F.col("planned_total_capital").isNull() | (F.col("planned_total_capital") <= 0),
        "fourth_entry_forbidden": F.size(stages) > 3,
        "triggers_not_ordered": stages != F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), F.least(F.size(stages), F.lit(3))),
    }


def profile_rules(percentiles: Sequence[str] = ("pe_percentile_max", "pb_percentile_max", "dividend_yield_percentile_min")) -> dict[str, Column]:
    return {
        **{f"{p}_range": F.col(p).isNull() | ~F.col(p).between(0.0, 100.0) for p in percentiles},
        "minimum_observations": F.col("minimum_observations") < MIN_OBSERVATIONS,
        "history_years": F.col("history_years") < 1,
    }


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _profile_revision() -> dict[str, Column]:
    number = F.col("revision_number")
    return {
        "profile_id_missing": _blank("logical_profile_id"),
        "revision_number_invalid": number.isNull() | (number < 1),
        "first_revision_has_parent": (number == 1) & F.col("revision_of").isNotNull(),
        "parent_missing": (number > 1) & F.col("revision_of").isNull(),
    }


def _stated(policies: Mapping[str, str]) -> dict[str, Column]:
    return {f"{name}_not_fixed": ~F.col(name).eqNullSafe(value) for name, value in policies.items()}


def synthesis_profile_rules() -> dict[str, Column]:
    """Rules of a profile that joins target ranges.

    ``evidence_strength_policy`` is a list of (minimum, label): minimums from
    two on and labels, both strictly rising.
    """
    steps, families, tolerance = F.col("evidence_strength_policy"), F.col("allowed_method_families"), F.col("overlap_tolerance")
    minimums = F.transform(steps, lambda s: s["minimum"])
    labels = F.transform(steps, lambda s: s["label"])
    order = F.array(*[F.lit(x) for x in STRENGTH_LABELS])
    ranks = F.filter(F.transform(labels, lambda x: F.array_position(order, x)), lambda r: r > 0)
    supported = F.array(*[F.lit(x) for x in (*K.TARGET_FAMILIES, K.SUPPORT_FAMILY)])
    scope, value = F.col("scope"), _blank("scope_value")
    return {
        **_profile_revision(),
        "scope_unknown": ~F.coalesce(scope.isin("global", "symbol"), F.lit(False)),
        "global_scope_has_value": (scope == "global") & F.col("scope_value").isNotNull(),
        "scope_value_missing": (scope == "symbol") & value,
        "families_missing": families.isNull() | (F.size(families) == 0),
        "family_unsupported": F.size(F.array_except(families, supported)) > 0,
        "tolerance_range": tolerance.isNull() | F.isnan(tolerance.cast("double")) | (tolerance < 0) | (tolerance >= 1),
        "strength_missing": steps.isNull() | (F.size(steps) == 0),
        "strength_below_two": F.exists(minimums, lambda m: m.isNull() | (m < 2)),
        "strength_not_increasing": F.array_sort(F.array_distinct(minimums)) != minimums,
        "strength_label_invalid": F.exists(labels, lambda x: ~F.coalesce(x.isin(*STRENGTH_LABELS), F.lit(False))) | (F.size(F.array_distinct(labels)) < F.size(labels)),
        "strength_label_order": F.array_sort(F.array_distinct(ranks)) != ranks,
        **_stated(SYNTHESIS_POLICIES),
        "author_missing": _blank("created_by") | _blank("rationale"),
    }


def evaluation_profile_rules() -> dict[str, Column]:
    """Rules of a profile that measures outcomes: both horizons, in any order, and the stated policies."""
    horizons = F.array_sort(F.array_distinct("horizons_sessions"))
    return {
        **_profile_revision(),
        "horizons_not_fixed": ~horizons.eqNullSafe(F.array(*[F.lit(h) for h in K.HORIZONS])),
        **_stated(EVALUATION_POLICIES),
        "author_missing": _blank("created_by") | _blank("rationale"),
    }


def resource_revision_rules() -> dict[str, Column]:
    """Rules of publication evidence: identity, hashes, order of its clocks, quality fit for its use."""
    published, available = F.col("source_published_at"), F.col("available_at")
    received, ingested = F.col("received_at"), F.col("ingested_at")
    use, quality = F.col("eligibility_status"), F.col("quality_status")
    blank = F.lit(False)
    for c in RESOURCE_IDENTITY:
        blank = blank | _blank(c)
    hashes = [F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False)) for c in ("raw_payload_sha256", "schema_fingerprint")]
    return {
        "identity_missing": blank,
        "hash_invalid": ~(hashes[0] & hashes[1]),
        "clock_missing": received.isNull() | ingested.isNull(),
        "ingested_before_received": ingested < received,
        "available_before_published": available < published,
        "available_after_received": available > received,
        "eligible_without_available_at": (use == ELIGIBLE) & available.isNull(),
        "eligible_quality_unusable": (use == ELIGIBLE) & ~F.coalesce(quality.isin(*USABLE_QUALITY), F.lit(False)),
        "review_quality_mismatch": (use == AWAITING) & ~quality.eqNullSafe(AWAITING),
    }


def turnover_rules() -> dict[str, Column]:
    both = F.col("market_a").isNotNull() & F.col("market_b").isNotNull()
    neither = F.col("market_a").isNull() & F.col("market_b").isNull()
    st = F.col("status")
    return {
        "available_needs_both": (st == "available") & ~both,
        "partial_has_total": (st == "partial") & F.col("total").isNotNull(),
        "total_mismatch": (st == "available") & (F.col("total") != F.col("market_a") + F.col("market_b")),
        "no_market": neither & (st != "revoked"),
        "status_unknown": ~st.isin("available", "partial", "revoked"),
    }


def valuation_rules() -> dict[str, Column]:
    return {
        "no_metric": F.col("pe").isNull() & F.col("pb").isNull() & F.col("dividend_yield_ratio").isNull(),
        "yield_negative": F.col("dividend_yield_ratio") < 0,
        "yield_unit": F.col("dividend_yield_ratio") > 1,
    }


def changed_only(df: DataFrame, keys: Sequence[str], order: Sequence[str], watched: Sequence[str], bucket: str) -> DataFrame:
    """Drop revisions that repeat the previous state of their key; renumber what is left.

    ``bucket`` is a column monotone in the order (an hour, a day): the rows of
    one key are ordered per bucket, so a key of any size is spread.
    """
    rows = df.withColumn("_some", F.lit(True))
    rows = bucketed_lag(rows, keys, bucket, order, ["_some", *watched])
    same = F.struct(*watched).eqNullSafe(F.struct(*[F.col(f"prev_{c}").alias(c) for c in watched]))
    kept = rows.where(F.col("prev__some").isNull() | ~same).select(*df.columns)
    return bucketed_rank(kept, keys, bucket, order, "revision_number")


def supersession(
    raw: DataFrame, keys: Sequence[str], order: Sequence[str], watched: Sequence[str], bucket: str, id_col: str = "id"
) -> DataFrame:
    """Link each raw revision to the one it supersedes: the previous one, if anything watched changed."""
    rows = bucketed_lag(raw, keys, bucket, order, [id_col, *watched])
    same = F.struct(*watched).eqNullSafe(F.struct(*[F.col(f"prev_{c}").alias(c) for c in watched]))
    linked = F.when(F.col(f"prev_{id_col}").isNotNull() & ~same, F.col(f"prev_{id_col}"))
    return rows.select(*raw.columns, linked.alias("supersedes_id"))


def ingest_metrics(items: DataFrame) -> DataFrame:
    """Counts and health per run and resource, with the run's terminal status.

    ``items(run_id, resource_id, outcome)`` with outcome accepted or rejected.
    """
    per = items.groupBy("run_id", "resource_id").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(F.col("outcome") == "accepted").alias("accepted_count"),
        F.count_if(F.col("outcome") != "accepted").alias("rejected_count"),
    )
    health = first_reason(
        (F.col("accepted_count") == 0, "rejected"), (F.col("rejected_count") > 0, "partial")
    )
    per = per.withColumn("health", F.coalesce(health, F.lit("fresh")))
    run = per.groupBy("run_id").agg(
        F.bool_and(F.col("health") == "fresh").alias("_all"), F.bool_or(F.col("health") != "rejected").alias("_any")
    )
    status = F.when(F.col("_all"), "succeeded").when(F.col("_any"), "partial").otherwise("failed")
    return per.join(run.select("run_id", status.alias("run_status")), "run_id")
