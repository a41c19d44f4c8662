"""Percentile screening: metric components, technical gate, decision, profile choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import first_reason
from tidemark.operators.asof import approval_eligible, revision_with_approval, visible

INCOMPLETE = ("insufficient_data", "needs_human_input", "unsupported")

FACTS = ("rule_version", "evidence_level", "implementation_mode", "project_operationalization")

# component -> (column, lower is better, zero allowed)
METRICS = {
    "pe": ("pe", True, False),
    "pb": ("pb", True, False),
    "dividend_yield": ("dividend_yield_ratio", False, True),
}


def metric_percentile(
    valuations: DataFrame, cutoff: str, years: int, minimum: int, thresholds: dict[str, float], symbols: DataFrame | None = None
) -> DataFrame:
    """Percentile component per symbol and metric over the trailing years.

    The current row is found by aggregation and joined back on the symbol; the
    count of lower values is then a plain aggregate with map-side partials.
    More than one row on the newest day makes the symbol ambiguous.  With
    ``symbols``, those without history are kept as ``insufficient_data``.
    """
    end = F.to_date(F.lit(cutoff).cast("timestamp"))
    start = F.add_months(end, -12 * years)
    rows = valuations.where(F.col("metric_date").between(start, end))
    last = rows.groupBy("symbol").agg(F.max("metric_date").alias("metric_date"))
    newest = (
        rows.join(last, ["symbol", "metric_date"])
        .groupBy("symbol")
        .agg(
            F.max("metric_date").alias("current_date"),
            F.count(F.lit(1)).alias("current_rows"),
            *[F.max(c).alias(f"now_{name}") for name, (c, _, _) in METRICS.items()],
        )
    )

    def valid(c: Column, zero: bool) -> Column:
        fine = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        return fine & (c >= 0 if zero else c > 0)

    aggs = [F.max("current_date").alias("metric_date"), F.max("current_rows").alias("current_rows"), F.count(F.lit(1)).alias("rows")]
    for name, (c, _, zero) in METRICS.items():
        ok = valid(F.col(c), zero)
        aggs += [
            F.max(f"now_{name}").alias(f"now_{name}"),
            F.count_if(ok).alias(f"n_{name}"),
            F.count_if(ok & (F.col(c) <= F.col(f"now_{name}"))).alias(f"below_{name}"),
        ]
    counted = rows.join(newest, "symbol").groupBy("symbol").agg(*aggs)
    if symbols is not None:
        counts = ["rows", *[f"n_{name}" for name in METRICS], *[f"below_{name}" for name in METRICS]]
        counted = symbols.select("symbol").distinct().join(counted, "symbol", "left").fillna(0, counts)
    parts = []
    for name, (_, lower, zero) in METRICS.items():
        now, n = F.col(f"now_{name}"), F.col(f"n_{name}")
        reason = first_reason(
            (F.col("current_rows").isNull(), "no_valuation_history"),
            (F.col("current_rows") != 1, "ambiguous_current_valuation_observation"),
            (~valid(now, zero), f"invalid_{name}"),
            (n < minimum, f"{name}_minimum_observations_not_met"),
        )
        status = F.when(reason.isNull(), "available").when(reason == f"invalid_{name}", "invalid_metric").otherwise("insufficient_data")
        pct = F.when(reason.isNull(), F.col(f"below_{name}").cast("double") / n.cast("double") * 100.0)
        limit = F.lit(float(thresholds[name]))
        parts.append(
            F.struct(
                F.lit(name).alias("component"),
                status.alias("status"),
                reason.alias("reason"),
                now.alias("value"),
                n.alias("observation_count"),
                (F.col("rows") - n).alias("invalid_observation_count"),
                pct.alias("percentile"),
                F.coalesce(pct <= limit if lower else pct >= limit, F.lit(False)).alias("passed"),
            )
        )
    return counted.select("symbol", "metric_date", F.explode(F.array(*parts)).alias("c")).select("symbol", "metric_date", "c.*")


def rule_use_status(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether a rule may be used for a purpose: forbidden, unsupported, approval first, available."""
    out = requests.join(rules, "rule_id", "left")
    status = (
        F.when(F.col("implementation_mode").isNull(), "unknown_rule")
        .when(F.array_contains("forbidden_uses", F.col("usage")), "forbidden")
        .when(F.col("implementation_mode") == "unsupported", "unsupported")
        .when(F.col("human_approval_required") & F.col("approval_id").isNull(), "needs_human_input")
        .otherwise("available")
    )
    return out.select(*requests.columns, status.alias("use_status"))


def technical_component(results: DataFrame, rules: DataFrame, component: str, usage: str = "trend_confirmation") -> DataFrame:
    """Gate on a replaceable technical provider.

    ``results(symbol, status, component_name, turned_positive, rule_id)`` and
    any of the stated facts rule_version, evidence_level, implementation_mode
    and project_operationalization: any job may supply it.  Rule facts come
    from the registry; a provider that states other facts is rejected.
    """
    stated = [c for c in FACTS if c in results.columns]
    results = results.withColumnsRenamed({c: f"_said_{c}" for c in stated})
    facts = rules.select(
        "rule_id",
        *FACTS,
        "human_approval_required",
        "allowed_outputs",
        "forbidden_uses",
        F.lit(True).alias("_known"),
    )
    out = results.join(facts, "rule_id", "left")

    differs = F.lit(False)
    for c in stated:
        differs = differs | F.coalesce(F.col(f"_said_{c}") != F.col(c), F.lit(False))
    usable = (
        F.array_contains("forbidden_uses", usage) | (F.col("human_approval_required") & F.lit(True))
    )
    reason = F.when(F.col("status") != "available", F.lit("technical_confirmation_required")).otherwise(
        first_reason(
            (F.col("component_name") != component, "technical_component_mismatch"),
            (F.col("_known").isNull(), "unknown_technical_rule"),
            (
                (F.col("evidence_level") == "U") | F.col("implementation_mode").isin("legacy_experimental", "unsupported"),
                "legacy_or_unsupported_technical_component",
            ),
            (~F.array_contains("allowed_outputs", usage), "rule_not_allowed_for_technical_confirmation"),
            (usable, "technical_rule_not_available_for_confirmation"),
            (differs, "technical_rule_metadata_mismatch"),
        )
    )
    out = out.withColumn("reason", reason)
    status = (
        F.when(F.col("reason").isNull(), "available")
        .when(
            F.col("reason").isin(
                "unknown_technical_rule",
                "legacy_or_unsupported_technical_component",
                "rule_not_allowed_for_technical_confirmation",
            ),
            "unsupported",
        )
        .when(
            F.col("reason") == "technical_rule_not_available_for_confirmation",
            F.when(F.array_contains("forbidden_uses", usage), "forbidden").otherwise("needs_human_input"),
        )
        .otherwise("insufficient_data")
    )
    return out.select(
        "symbol",
        F.lit("technical_turn").alias("component"),
        status.alias("status"),
        "reason",
        (F.col("reason").isNull() & F.coalesce("turned_positive", F.lit(False))).alias("passed"),
    )


def screen_decision(components: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """Decide only when every expected component is there; pass only if all pass.

    A symbol has one row per component, so the collected list is as long as
    ``expected``.
    """
    item = F.struct("component", "status", "reason", "passed")
    g = components.groupBy("symbol").agg(F.array_sort(F.collect_list(item)).alias("items"))
    names = F.array(*[F.lit(n) for n in sorted(expected)])
    seen = F.transform(
        F.filter("items", lambda i: ~i["status"].isin(*INCOMPLETE)), lambda i: i["component"]
    )
    g = g.withColumn("missing_components", F.array_except(names, seen))
    lone = F.size("missing_components") == 1
    tech = F.get(F.filter("items", lambda i: i["component"] == "technical_turn"), F.lit(0))
    only_tech = lone & (F.get("missing_components", F.lit(0)) == "technical_turn")
    incomplete = F.size("missing_components") > 0
    return g.select(
        "symbol",
        F.when(incomplete, "insufficient_data").otherwise("available").alias("status"),
        F.when(only_tech, F.coalesce(tech["reason"], F.lit("technical_confirmation_required")))
        .when(incomplete, "required_screening_components_missing")
        .alias("reason"),
        F.when(
            ~incomplete,
            F.when(F.forall("items", lambda i: i["passed"]), "meets_approved_profile").otherwise(
                "does_not_meet_approved_profile"
            ),
        ).alias("research_result"),
        "missing_components",
    )


def profile_select(symbols: DataFrame, profiles: DataFrame, rule_id: str) -> DataFrame:
    """Approved profile that applies to each symbol: global or its own; more than one is ambiguous.

    ``profiles(id, scope, scope_value, status, decision, rule_id, ...)``.  The
    global profiles are counted once and attached to every symbol; only
    symbol-scoped ones are joined.
    """
    ok = profiles.where((F.col("status") == "available") & approval_eligible(rule_id))
    own = ok.where(F.col("scope") == "symbol").groupBy(F.col("scope_value").alias("symbol")).agg(
        F.count(F.lit(1)).alias("n_own"), F.min("id").alias("own_id")
    )
    everywhere = ok.where(F.col("scope") == "global")
    out = (
        symbols.select("symbol")
        .join(own, "symbol", "left")
        .fillna(0, ["n_own"])
        .withColumns(
            {
                "n_global": everywhere.agg(F.count(F.lit(1))).scalar(),
                "global_id": everywhere.agg(F.min("id")).scalar(),
            }
        )
    )
    n = F.col("n_own") + F.col("n_global")
    return out.select(
        "symbol",
        F.when(n == 1, "available").otherwise("needs_human_input").alias("status"),
        F.when(n == 0, "approved_screening_profile_required")
        .when(n > 1, "screening_profile_selection_required")
        .alias("reason"),
        n.alias("applicable"),
        F.when(n == 1, F.coalesce("own_id", "global_id")).alias("profile_id"),
    )


def profile_requests(requests: DataFrame, ledger: DataFrame, approvals: DataFrame, cutoff: str, rule_id: str, kind: str) -> DataFrame:
    """Profile for each request: named by revision, named by logical id, or the only one in scope.

    ``requests(request_id, symbol, logical_id, revision_id)``;
    ``ledger(logical_id, id, revision_number, scope, scope_value, status, available_at, ingested_at)``.
    Only the newest visible revision of a profile counts.  ``kind`` is
    ``screening`` (only approved profiles are candidates of a request without
    a name; an outdated name is no profile) or ``synthesis`` (all in scope are
    candidates; hidden and superseded revisions are told apart).  A request
    with both names needs the revision to be that profile's.  Requests by
    revision, by name and without either take separate joins, so missing names
    meet in no task (but revisions nobody has seen, which have no name).
    """
    if kind not in ("screening", "synthesis"):
        raise ValueError(f"unknown kind of profile: {kind}")
    approved = approval_eligible(rule_id) & (F.col("status") != "revoked")
    facts = F.struct("id", "scope", "scope_value", "status", "decision", approved.alias("approved"))
    states = revision_with_approval(ledger, approvals, cutoff).select("logical_id", facts.alias("_state"))
    asked = ["request_id", "symbol", "logical_id", "revision_id"]
    has_name = F.col("logical_id").isNotNull() | F.col("revision_id").isNotNull()
    known = visible(ledger, cutoff).groupBy(F.col("id").alias("revision_id")).agg(F.min("logical_id").alias("_of"))
    by_revision = requests.select(*asked).where(F.col("revision_id").isNotNull()).join(known, "revision_id", "left").select(*asked, "_of")
    by_name = requests.select(*asked, F.lit(None).cast("string").alias("_of")).where(F.col("revision_id").isNull() & F.col("logical_id").isNotNull())
    named = (
        by_revision.unionByName(by_name)
        .withColumns(
            {
                "_name": F.coalesce("logical_id", "_of"),
                "_hidden": F.col("revision_id").isNotNull() & F.col("_of").isNull(),
                "_clash": F.coalesce(F.col("logical_id") != F.col("_of"), F.lit(False)),
            }
        )
        .join(states.withColumnRenamed("logical_id", "_name"), "_name", "left")
        .withColumn("_n", F.col("_state").isNotNull().cast("bigint"))
    )
    candidates = states.where("_state.approved") if kind == "screening" else states
    counted = (F.count(F.lit(1)).alias("n"), F.min("_state").alias("state"))
    own = candidates.where("_state.scope = 'symbol'").groupBy(F.col("_state.scope_value").alias("symbol")).agg(F.struct(*counted).alias("_own"))
    everywhere = candidates.where("_state.scope = 'global'").agg(F.struct(*counted)).scalar()
    free = requests.select(*asked).where(~has_name).join(own, "symbol", "left").withColumn("_all", everywhere)
    n = F.coalesce("_own.n", F.lit(0)) + F.col("_all.n")
    free = free.withColumns(
        {
            "_n": n,
            "_state": F.when(n == 1, F.coalesce("_own.state", "_all.state")),
            "_hidden": F.lit(False),
            "_clash": F.lit(False),
        }
    )
    cols = [*asked, "_state", "_n", "_hidden", "_clash"]
    both = named.select(*cols).unionByName(free.select(*cols))

    state = F.col("_state")
    fits = F.coalesce((state["scope"] == "global") | ((state["scope"] == "symbol") & (state["scope_value"] == F.col("symbol"))), F.lit(False))
    outdated = F.coalesce(state["id"] != F.col("revision_id"), F.lit(False))
    required, mismatch, peers = f"approved_{kind}_profile_required", f"{kind}_profile_scope_mismatch", "industry_peer_data_required"
    several = (F.col("_n") > 1, f"{kind}_profile_selection_required")
    refused = (
        (state["status"] == "revoked", f"{kind}_profile_revoked"),
        (state["decision"].eqNullSafe("revoked"), f"{kind}_profile_approval_revoked"),
        (~state["approved"], required),
    )
    if kind == "screening":
        checks = (several, (state.isNull() | outdated | F.col("_clash"), required), *refused, (~fits & (state["scope"] == "industry"), peers), (~fits, mismatch))
    else:
        hidden = (F.col("_hidden"), f"{kind}_profile_revision_not_visible_at_cutoff")
        missing = (state.isNull() | F.col("_clash"), required)
        checks = (hidden, several, missing, (outdated, f"{kind}_profile_revision_superseded"), (~fits, mismatch), *refused)
    out = both.withColumn("reason", first_reason(*checks))
    reason = F.col("reason")
    return out.select(
        *asked,
        F.when(reason.isNull(), "available").when(reason.isin(mismatch, peers), "insufficient_data").otherwise("needs_human_input").alias("status"),
        "reason",
        F.col("_n").alias("applicable"),
        F.when(reason.isNull(), state["id"]).alias("profile_id"),
        state["id"].alias("effective_revision_id"),
    )
