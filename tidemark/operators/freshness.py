"""Whether stored dependencies are still current, and the health of providers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import first_reason
from tidemark.operators.asof import (
    REVISION_ORDER,
    approval_eligible,
    latest_approval_asof,
    newest,
    visible,
)


def dependency_freshness(
    dependencies: DataFrame,
    ledger: DataFrame,
    approvals: DataFrame,
    cutoff: str,
    rule_id: str,
    resource_type: str,
    active: str = "active",
    order: Sequence[str] = REVISION_ORDER,
) -> DataFrame:
    """State of every dependency at a cutoff, first failing test first.

    Dependencies of other types than the ledger's stay as ``unknown`` with the
    reason ``unsupported_resource_type``; ``freshness_over_ledgers`` answers
    several types at once.

    One set-based pipeline per ledger: visible revisions with their latest
    approvals give the newest visible and the newest eligible revision per
    logical id, and dependencies join to those; nothing is looked up per row.
    """
    app = latest_approval_asof(approvals, cutoff).select(
        F.col("resource_id").alias("id"), "decision", "rule_id", "evidence_level", "project_operationalization"
    )
    seen = visible(ledger, cutoff).join(app, "id", "left")
    good = (F.col("status") == active) & approval_eligible(rule_id)
    seen = seen.withColumn("_good", good)
    last = newest(seen, ["logical_id"], order).select(
        "logical_id",
        F.col("id").alias("latest_visible_id"),
        F.col("status").alias("_last_status"),
        approval_eligible(rule_id).alias("_last_approved"),
    )
    best = newest(seen.where("_good"), ["logical_id"], order).select(
        "logical_id",
        F.col("id").alias("latest_eligible_id"),
        F.col("revision_number").alias("latest_eligible_revision_number"),
    )
    exact = ledger.select(
        F.col("id").alias("resource_id"), "logical_id", F.col("status").alias("_exact_status"), F.lit(True).alias("_found")
    )
    exact_app = app.select(F.col("id").alias("resource_id"), F.col("decision").alias("_exact_decision"))
    rows = (
        dependencies.where(F.col("resource_type").eqNullSafe(F.lit(resource_type)))
        .join(exact, "resource_id", "left")
        .join(exact_app, "resource_id", "left")
        .join(last, "logical_id", "left")
        .join(best, "logical_id", "left")
    )
    reason = first_reason(
        (F.col("_found").isNull(), "snapshot_dependency_missing"),
        (
            F.col("logical_resource_id").isNotNull()
            & (F.col("logical_resource_id") != "")
            & (F.col("logical_resource_id") != F.col("logical_id")),
            "snapshot_dependency_logical_identity_mismatch",
        ),
        (F.col("_exact_status") != active, "dependency_revoked"),
        (F.col("_last_status") != active, "dependency_revoked"),
        (F.col("_exact_decision") == "revoked", "approval_revoked"),
        (F.col("latest_eligible_id").isNull(), "no_eligible_dependency_revision"),
        (F.col("latest_eligible_id") != F.col("resource_id"), f"newer_eligible_{resource_type}"),
    )
    rows = rows.withColumn("reason", reason)
    status = (
        F.when(F.col("reason").isNull(), "current")
        .when(F.col("reason").startswith("newer_eligible"), "stale")
        .when(F.col("reason") == "no_eligible_dependency_revision", "unknown")
        .otherwise("blocked")
    )
    decided = F.coalesce(~F.col("reason").isin("snapshot_dependency_missing", "snapshot_dependency_logical_identity_mismatch", "dependency_revoked", "approval_revoked"), F.lit(True))
    awaiting = (
        decided
        & F.col("latest_visible_id").isNotNull()
        & ~F.col("latest_visible_id").eqNullSafe(F.col("latest_eligible_id"))
        & ~F.coalesce(F.col("_last_approved"), F.lit(False))
    )
    known = rows.select(
        *dependencies.columns,
        status.alias("status"),
        "reason",
        F.when(decided, F.col("latest_eligible_id")).alias("latest_eligible_id"),
        F.when(decided, F.col("latest_eligible_revision_number")).alias("latest_eligible_revision_number"),
        awaiting.alias("candidate_awaiting_review"),
    )
    return known.unionByName(_unsupported(dependencies, [resource_type], known))


def _unsupported(dependencies: DataFrame, types: Sequence[str], like: DataFrame) -> DataFrame:
    """Dependencies of no known type, in the shape of ``like``."""
    fixed = {"status": F.lit("unknown"), "reason": F.lit("unsupported_resource_type"), "candidate_awaiting_review": F.lit(False)}
    other = dependencies.where(~F.coalesce(F.col("resource_type").isin(*types), F.lit(False)))
    return other.select(*[fixed.get(f.name, F.col(f.name) if f.name in dependencies.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in like.schema])


@dataclass(frozen=True)
class Ledger:
    """A ledger of dependencies and the tests its revisions must pass.

    ``rows`` has id, ``logical``, ``revision``, available_at, ingested_at.
    ``active`` is the status that counts, None where the ledger has none;
    ``valid`` and ``bound`` are further tests per row; ``rules`` are those of
    which one must have approved a revision, empty where none is needed;
    ``resources`` are the providers whose state the dependency shares.
    """

    rows: DataFrame
    logical: str = "logical_id"
    revision: str = "revision_number"
    active: str | None = "active"
    rules: tuple[str, ...] = ()
    valid: Column | None = None
    bound: Column | None = None
    resources: tuple[str, ...] = ()


def _entries(kind: str, ledger: Ledger) -> DataFrame:
    """The rows of a ledger in the shape that all ledgers share."""
    yes = F.lit(True)
    return ledger.rows.select(
        F.lit(kind).alias("resource_type"),
        F.col("id").cast("string").alias("id"),
        F.col(ledger.logical).cast("string").alias("logical_id"),
        F.col(ledger.revision).cast("bigint").alias("revision_number"),
        "available_at",
        "ingested_at",
        (yes if ledger.active is None else F.col("status").eqNullSafe(ledger.active)).alias("active"),
        (yes if ledger.valid is None else F.coalesce(ledger.valid, F.lit(False))).alias("valid"),
        (yes if ledger.bound is None else F.coalesce(ledger.bound, F.lit(False))).alias("bound"),
    )


def freshness_over_ledgers(dependencies: DataFrame, ledgers: Mapping[str, Ledger], approvals: DataFrame, cutoff: str, health: DataFrame | None = None) -> DataFrame:
    """State of dependencies of any type at a cutoff, first failing test first; every dependency gives one row.

    ``dependencies(resource_type, resource_id, logical_resource_id, ...)``;
    ``approvals`` are the events of all ledgers with their ``resource_type``;
    ``health(resource_id, status, freshness)`` as of ``provider_health``.

    All ledgers are one tagged table, read once.  Every revision meets its
    newest approval; the newest visible and the newest eligible revision of a
    logical resource are maxima over its revisions; dependencies then join to
    single revisions.  Types without a ledger are ``unknown``.
    """
    entries = None
    for kind, ledger in ledgers.items():
        part = _entries(kind, ledger)
        entries = part if entries is None else entries.unionByName(part)
    events = newest(visible(approvals, cutoff), ["resource_type", "resource_id"], ["available_at", "ingested_at", "approval_event_id"])
    events = events.select("resource_type", F.col("resource_id").cast("string").alias("id"), "decision", "rule_id", "evidence_level", "project_operationalization")
    judged = F.lit(None).cast("boolean")
    for kind, ledger in ledgers.items():
        any_rule = reduce(lambda a, b: a | b, [approval_eligible(r) for r in ledger.rules]) if ledger.rules else F.lit(True)
        judged = F.when(F.col("resource_type") == kind, any_rule).otherwise(judged)
    stamp = F.lit(cutoff).cast("timestamp")
    seen = (F.col("available_at") <= stamp) & (F.col("ingested_at") <= stamp)
    rows = entries.join(events, ["resource_type", "id"], "left").withColumn("approved", judged).withColumn("seen", F.coalesce(seen, F.lit(False)))
    own = Window.partitionBy("resource_type", "logical_id")
    order = ["revision_number", "available_at", "ingested_at", "id"]
    good = F.col("seen") & F.col("active") & F.col("valid") & F.col("bound") & F.col("approved")
    rows = rows.withColumns(
        {
            "last": F.max(F.when(F.col("seen"), F.struct(*order, "active", "approved"))).over(own),
            "best": F.max(F.when(good, F.struct(*order))).over(own),
        }
    )
    exact = rows.select("resource_type", F.col("id").alias("resource_id"), "logical_id", "active", "bound", F.col("decision").eqNullSafe("revoked").alias("taken_back"), "last", "best", F.lit(True).alias("found"))
    out = dependencies.withColumn("resource_id", F.col("resource_id").cast("string")).join(exact, ["resource_type", "resource_id"], "left")

    known = F.coalesce(F.col("resource_type").isin(*ledgers), F.lit(False))
    needs = F.col("resource_type").isin(*[k for k, v in ledgers.items() if v.rules] or [""])
    stated = F.col("logical_resource_id").isNotNull() & (F.col("logical_resource_id") != "")
    early = first_reason(
        (~known, "unsupported"),
        (F.col("found").isNull(), "snapshot_dependency_missing"),
        (stated & (F.col("logical_resource_id") != F.col("logical_id")), "snapshot_dependency_logical_identity_mismatch"),
        (~F.col("bound"), "publication_evidence_binding_invalid"),
        (~F.col("active"), "dependency_revoked"),
        (F.col("last").isNotNull() & ~F.col("last.active"), "dependency_revoked"),
        (needs & F.col("taken_back"), "approval_revoked"),
    )
    out = out.withColumn("early", early).withColumn("latest", F.when(F.col("early").isNull(), F.col("best")))
    supplied = [(k, r) for k, v in ledgers.items() for r in v.resources]
    if health is not None and supplied:
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("resource_type"), F.lit(r).alias("resource_id")) for k, r in supplied]))
        wanted = dependencies.sparkSession.range(1).select(pairs.alias("p")).select("p.*")
        state = wanted.join(health.select("resource_id", "status", "freshness"), "resource_id", "left").groupBy("resource_type").agg(
            F.bool_or(F.col("freshness") == "blocked").alias("h_blocked"),
            F.bool_or(F.col("status") == "provider_error").alias("h_error"),
            (F.bool_or(F.col("freshness") == "unknown") | (F.count("freshness") == 0)).alias("h_unknown"),
            F.bool_or(F.col("freshness") == "stale").alias("h_stale"),
        )
        out = out.join(state, "resource_type", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("boolean") for c in ("h_blocked", "h_error", "h_unknown", "h_stale")})
    late = first_reason(
        (F.col("latest").isNull(), "no_eligible_dependency_revision"),
        (F.col("h_blocked") & F.coalesce("h_error", F.lit(False)), "dependency_provider_error"),
        (F.col("h_blocked"), "dependency_operational_blocked"),
        (F.col("latest.id") != F.col("resource_id"), "newer_eligible"),
        (F.col("h_unknown"), "dependency_freshness_unknown"),
        (F.col("h_stale"), "dependency_source_stale"),
    )
    out = out.withColumn("why", F.coalesce("early", late))
    kind = F.coalesce(F.col("resource_type"), F.lit(""))
    reason = (
        F.when(F.col("why") == "unsupported", F.concat(F.lit("unsupported_dependency_type_"), F.when(kind == "", "missing").otherwise(kind)))
        .when(F.col("why") == "newer_eligible", F.concat(F.lit("newer_eligible_"), kind))
        .otherwise(F.col("why"))
    )
    status = (
        F.when(F.col("why").isNull(), "current")
        .when(F.col("why").isin("newer_eligible", "dependency_source_stale"), "stale")
        .when(F.col("why").isin("unsupported", "no_eligible_dependency_revision", "dependency_freshness_unknown"), "unknown")
        .otherwise("blocked")
    )
    awaiting = F.col("early").isNull() & needs & F.col("last").isNotNull() & ~F.col("last.id").eqNullSafe(F.col("latest.id")) & ~F.coalesce("last.approved", F.lit(False))
    given = dependencies.schema["resource_id"].dataType
    return out.withColumn("resource_id", F.col("resource_id").cast(given)).select(
        *dependencies.columns,
        status.alias("status"),
        reason.alias("reason"),
        F.col("latest.id").alias("latest_eligible_id"),
        F.col("latest.revision_number").alias("latest_eligible_revision_number"),
        F.coalesce(awaiting, F.lit(False)).alias("candidate_awaiting_review"),
    )


# Worst first.
SNAPSHOT_ORDER = ("blocked", "stale", "unknown", "current")
REVIEW_ORDER = ("blocked", "unknown", "stale", "current")


def rollup(status: Column, order: Sequence[str] = SNAPSHOT_ORDER) -> Column:
    """Aggregate: worst status of a group; nothing known counts as unknown."""
    rank = F.lit(None).cast("int")
    names = []
    for i, name in enumerate(reversed(order)):
        rank = F.when(status == name, i).otherwise(rank)
        names += [F.lit(i), F.lit(name)]
    return F.coalesce(F.try_element_at(F.create_map(*names), F.max(rank)), F.lit("unknown"))


def status_rollup(snapshots: DataFrame, states: DataFrame) -> DataFrame:
    """Freshness per snapshot; snapshots without dependencies are unknown."""
    g = states.groupBy("snapshot_id").agg(
        rollup(F.col("status")).alias("freshness_status"),
        F.count(F.lit(1)).alias("dependencies"),
        F.array_sort(F.collect_set("reason")).alias("reasons"),
    )
    out = snapshots.select("snapshot_id").distinct().join(g, "snapshot_id", "left")
    none = F.array(F.lit("snapshot_has_no_dependencies"))
    return out.select(
        "snapshot_id",
        F.coalesce("freshness_status", F.lit("unknown")).alias("freshness_status"),
        F.coalesce("dependencies", F.lit(0)).alias("dependencies"),
        F.coalesce("reasons", none).alias("reasons"),
    )


SUCCESS = ("accepted", "partial", "awaiting_review", "quality_warning")
BLOCKING = ("provider_error", "schema_changed", "rejected", "partial", "awaiting_review")


def expected_session(calendar_revisions: DataFrame, cutoff: str) -> DataFrame:
    """Newest open session known at the cutoff, as one row."""
    last = newest(
        visible(calendar_revisions, cutoff), ["trade_date"], ["revision_number", "available_at", "ingested_at", "id"]
    )
    open_days = last.where((F.col("status") == "available") & F.col("session_status").isin("trading", "special"))
    return open_days.agg(F.max("trade_date").alias("latest_expected_trade_date"))


def calendar_state_asof(calendar_revisions: DataFrame, cutoff: str) -> DataFrame:
    """Session state per day at the cutoff; a revoked newest revision leaves none."""
    last = newest(
        visible(calendar_revisions, cutoff), ["trade_date"], ["revision_number", "available_at", "ingested_at", "id"]
    )
    return last.where(F.col("status") != "revoked")


def provider_health(
    resources: DataFrame, items: DataFrame, raw: DataFrame, calendar_revisions: DataFrame, cutoff: str
) -> DataFrame:
    """Latest attempt, last success, newest eligible revision and freshness per resource.

    ``resources(resource_id, provider_id, expected_frequency)``;
    ``items(item_id, resource_id, started_at, completed_at, status)``;
    ``raw(id, resource_id, logical_key, available_at, ingested_at, eligibility)``.
    """
    c = F.lit(cutoff).cast("timestamp")
    latest = newest(items.where(F.col("started_at") <= c), ["resource_id"], ["started_at", "item_id"]).select(
        "resource_id", F.col("started_at").alias("last_attempt_at"), F.col("status").alias("operational_status")
    )
    success = items.where((F.col("completed_at") <= c) & F.col("status").isin(*SUCCESS)).groupBy("resource_id").agg(
        F.max("completed_at").alias("last_success_at")
    )
    effective = newest(
        visible(raw, cutoff), ["resource_id", "logical_key"], ["ingested_at", "available_at", "id"]
    ).where("eligibility = 'eligible'")
    eligible = effective.groupBy("resource_id").agg(
        F.max_by("available_at", "logical_key").alias("last_eligible_revision_at"),
        F.max("logical_key").alias("last_eligible_logical_key"),
    )
    out = (
        resources.join(latest, "resource_id", "left")
        .join(success, "resource_id", "left")
        .join(eligible, "resource_id", "left")
        .withColumn("latest_expected_trade_date", expected_session(calendar_revisions, cutoff).scalar())
    )
    return freshness_from_health(out, cutoff)


def freshness_from_health(health: DataFrame, cutoff: str) -> DataFrame:
    """Freshness class and reason from operational status and the expected session."""
    op = F.coalesce("operational_status", F.lit("unknown"))
    local_day = F.to_date(F.from_utc_timestamp(F.lit(cutoff).cast("timestamp"), "Asia/Taipei"))
    have, due = F.col("last_eligible_logical_key"), F.col("latest_expected_trade_date")
    daily = F.col("expected_frequency") == "daily"
    cases = [
        (op.isin(*BLOCKING), "blocked", F.concat(F.lit("latest_operational_status_"), op)),
        (F.col("last_attempt_at").isNull(), "unknown", F.lit("no_ingestion_attempt")),
        (F.col("last_eligible_revision_at").isNull(), "unknown", F.lit("no_eligible_revision")),
        (daily & due.isNull(), "unknown", F.lit("official_calendar_session_unavailable")),
        (daily & (have < due), "stale", F.lit("newer_official_session_expected")),
        (daily & (have == due) & (due == local_day), "current", F.lit(None).cast("string")),
        (daily, "unknown", F.lit("official_calendar_coverage_incomplete")),
        (F.col("expected_frequency") == "monthly_publication", "unknown", F.lit("publication_cadence_not_proven")),
        (F.col("expected_frequency") == "periodic", "unknown", F.lit("authoritative_periodic_cadence_not_proven")),
    ]
    (cond, state, reason), *rest = cases
    freshness, why = F.when(cond, state), F.when(cond, reason)
    for cond, state, reason in rest:
        freshness, why = freshness.when(cond, state), why.when(cond, reason)
    return health.withColumns(
        {
            "operational_status": op,
            "freshness": freshness.otherwise("unknown"),
            "freshness_reason": why.otherwise("manual_resource_has_no_freshness_proof"),
        }
    )


def review_queue(watchlist: DataFrame, latest_events: DataFrame, latest_snapshots: DataFrame, snapshots: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Review state of every watchlist item.

    ``watchlist(item_id, symbol)``; ``latest_events(item_id, acknowledged_snapshot_id)``;
    ``latest_snapshots(symbol, snapshot_id, integrity_ok)``; ``snapshots(snapshot_id, integrity_ok)``;
    ``comparisons(base_id, comparison_id, incomparable boolean, freshness, stored_deltas, context_deltas)``.
    """
    last = latest_snapshots.select("symbol", F.col("snapshot_id").alias("latest_id"), F.col("integrity_ok").alias("_last_ok"))
    base = snapshots.select(
        F.col("snapshot_id").alias("acknowledged_snapshot_id"), F.col("integrity_ok").alias("_base_ok")
    )
    cmp_ = comparisons.select(
        F.col("base_id").alias("acknowledged_snapshot_id"),
        F.col("comparison_id").alias("latest_id"),
        "incomparable",
        "freshness",
        "stored_deltas",
        "context_deltas",
    )
    out = (
        watchlist.join(latest_events, "item_id", "left")
        .join(last, "symbol", "left")
        .join(base, "acknowledged_snapshot_id", "left")
        .join(cmp_, ["acknowledged_snapshot_id", "latest_id"], "left")
    )
    deltas = F.col("stored_deltas") + F.col("context_deltas")
    state = (
        F.when(F.col("latest_id").isNull(), "no_snapshot")
        .when(F.col("acknowledged_snapshot_id").isNull(), "baseline_not_set")
        .when(~F.col("_last_ok") | F.coalesce(~F.col("_base_ok"), F.lit(False)), "snapshot_integrity_error")
        .when(F.col("_base_ok").isNull(), "blocked")
        .when(F.col("incomparable"), "incomparable_contract")
        .when(F.col("freshness") == "blocked", "blocked")
        .when(F.coalesce(F.col("freshness"), F.lit("unknown")) == "unknown", "unknown")
        .when(deltas > 0, "comparable_with_deltas")
        .otherwise("comparable_without_deltas")
    )
    out = out.withColumn("review_state", state)
    comparable = F.col("review_state").startswith("comparable")
    return out.select(
        "item_id",
        "symbol",
        F.col("latest_id").alias("latest_snapshot_id"),
        "acknowledged_snapshot_id",
        "review_state",
        F.when(comparable, F.col("stored_deltas")).otherwise(0).alias("stored_delta_count"),
        F.when(comparable, F.col("context_deltas")).otherwise(0).alias("context_delta_count"),
    )
