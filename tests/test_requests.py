import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import liquidity as lq, quality as qa, screening as sn, validate as va
from tidemark.sources import landed as ld

CUTOFF = "2024-03-01 00:00:00"


def t(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


LEDGER = "logical_id string, id int, revision_number int, scope string, scope_value string, status string, available_at timestamp, ingested_at timestamp"
EVENTS = "approval_event_id int, resource_id int, decision string, rule_id string, evidence_level string, project_operationalization int, available_at timestamp, ingested_at timestamp"


def _choose(request, ledger, events, kind):
    """One request after the other."""
    _, symbol, logical, revision = request
    cut = dt.datetime.fromisoformat(CUTOFF)
    seen = [r for r in ledger if r[6] <= cut and r[7] <= cut]
    states = {}
    for r in sorted(seen, key=lambda r: (r[2], r[6], r[7], r[1])):
        states[r[0]] = r
    told = {}
    for e in sorted(events, key=lambda e: (e[6], e[7], e[0])):
        if e[6] <= cut and e[7] <= cut:
            told[e[1]] = e

    def decision(r):
        return told[r[1]][2] if r[1] in told else None

    def approved(r):
        e = told.get(r[1])
        return r[5] != "revoked" and e is not None and e[2] == "approved" and e[3] == "R" and e[4] != "U" and (e[4] != "C" or e[5] == 1)

    def fits(r):
        return r[3] == "global" or (r[3] == "symbol" and r[4] == symbol)

    required = f"approved_{kind}_profile_required"
    if logical is None and revision is None:
        found = [r for r in states.values() if fits(r) and (kind == "synthesis" or approved(r))]
        if len(found) > 1:
            return f"{kind}_profile_selection_required", None
        state = found[0] if found else None
    else:
        of = next((r[0] for r in seen if r[1] == revision), None)
        if kind == "synthesis" and revision is not None and of is None:
            return "synthesis_profile_revision_not_visible_at_cutoff", None
        state = states.get(logical if logical is not None else of)
        if state is not None and revision is not None and state[1] != revision:
            if kind == "synthesis" and (logical is None or of == logical):
                return "synthesis_profile_revision_superseded", None
            state = None
    if state is None:
        return required, None
    outside = "industry_peer_data_required" if kind == "screening" and state[3] == "industry" else f"{kind}_profile_scope_mismatch"
    if kind == "synthesis" and not fits(state):
        return outside, None
    if state[5] == "revoked":
        return f"{kind}_profile_revoked", None
    if decision(state) == "revoked":
        return f"{kind}_profile_approval_revoked", None
    if not approved(state):
        return required, None
    if not fits(state):
        return outside, None
    return None, state[1]


@pytest.mark.parametrize("kind", ["screening", "synthesis"])
@pytest.mark.parametrize("world", [False, True])
def test_requests_match_a_choice_one_by_one(spark, kind, world):
    rng = random.Random(5 + world)
    ledger, events = [], []
    for i in range(90):
        name = f"P{rng.randint(0, 34)}"
        number = int(name[1:])
        scope = "industry" if number % 9 == 8 else "symbol"
        at = t(rng.randint(0, 70))
        ledger.append((name, i, rng.randint(1, 3), scope, f"S{number % 20}", rng.choice(["available"] * 5 + ["revoked"]), at, at + dt.timedelta(days=rng.randint(0, 3))))
        for j in range(rng.randint(0, 2)):
            when = at + dt.timedelta(days=rng.randint(0, 9))
            events.append((10 * i + j, i, rng.choice(["approved"] * 4 + ["revoked"]), rng.choice("RRRQ"), rng.choice("AACU"), rng.randint(0, 1), when, when))
    if world:
        ledger.append(("G", 500, 1, "global", None, "available", t(0), t(0)))
        events.append((5000, 500, "approved", "R", "A", 1, t(0), t(0)))
    requests = []
    for i in range(400):
        logical = f"P{rng.randint(0, 36)}" if rng.random() < 0.45 else None
        revision = rng.randint(0, 95) if rng.random() < 0.45 else None
        requests.append((i, f"S{rng.randint(0, 22)}" if rng.random() < 0.9 else None, logical, revision))
    out = sn.profile_requests(
        spark.createDataFrame(requests, "request_id int, symbol string, logical_id string, revision_id int"),
        spark.createDataFrame(ledger, LEDGER),
        spark.createDataFrame(events, EVENTS),
        CUTOFF,
        "R",
        kind,
    ).collect()
    assert len(out) == len(requests)
    got = {r["request_id"]: (r["reason"], r["profile_id"]) for r in out}
    want = {r[0]: _choose(r, ledger, events, kind) for r in requests}
    assert got == want
    assert len({reason for reason, _ in want.values()}) >= 6
    assert all((r["status"] == "available") == (r["profile_id"] is not None) for r in out)


def test_requests_on_empty_ledgers(spark):
    asked = spark.createDataFrame([(1, "A", None, None), (2, "A", "P", None), (3, None, None, 4)], "request_id int, symbol string, logical_id string, revision_id int")
    out = sn.profile_requests(asked, spark.createDataFrame([], LEDGER), spark.createDataFrame([], EVENTS), CUTOFF, "R", "synthesis")
    assert {r["request_id"]: (r["reason"], r["applicable"]) for r in out.collect()} == {
        1: ("approved_synthesis_profile_required", 0),
        2: ("approved_synthesis_profile_required", 0),
        3: ("synthesis_profile_revision_not_visible_at_cutoff", 0),
    }
    with pytest.raises(ValueError):
        sn.profile_requests(asked, asked, asked, CUTOFF, "R", "other")


def test_bound_money_supply_matches_a_scan(spark):
    rng = random.Random(8)
    cut = dt.datetime.fromisoformat(CUTOFF)
    turnover = [(t(n).date(), r, 100.0 + n + r, "available", t(n + 1 + 9 * (r - 1)), t(n + 1 + 9 * (r - 1))) for n in range(80) for r in range(1, 1 + rng.randint(1, 2))]
    money, evidence = [], []
    for p in range(12):
        for r in range(1, 4):
            for ds in "AB":
                at = t(p * 6 + rng.randint(0, 20))
                money.append((f"2023-{p + 1:02d}", r, ds, 1000.0 * p + 10 * r + (ds == "B"), at, at + dt.timedelta(days=1), rng.choice(["available"] * 4 + ["revoked"]), rng.choice([None, f"E{p}-{r}"])))
        if p % 4:
            for r in range(1, 4):
                evidence.append((f"E{p}-{r}", f"2023-{p + 1:02d}", r, rng.choice(["accepted", "accepted", "candidate"]), t(p * 6 + r)))
    tf = spark.createDataFrame(turnover, "trade_date date, revision int, total double, status string, available_at timestamp, ingested_at timestamp")
    mf = spark.createDataFrame(money, "period string, revision int, dataset string, value_twd double, available_at timestamp, ingested_at timestamp, status string, publication_evidence_id string")
    ef = spark.createDataFrame(evidence, "publication_evidence_id string, period string, revision_number int, status string, ingested_at timestamp")
    got = {r["trade_date"]: (r["revision"], r["m1b_period"], r["m1b_revision"], r["m1b_dataset"], r["m1b_twd"]) for r in lq.asof_bound_m1b(tf, mf, ef, CUTOFF).collect()}

    newest_evidence = {}
    for e in sorted(evidence, key=lambda e: (e[1], e[2])):
        if e[4] <= cut:
            newest_evidence[e[1]] = e

    def eligible(m):
        e = newest_evidence.get(m[0])
        return m[7] is None if e is None else e[3] == "accepted" and e[0] == m[7]

    want = {}
    for day in {r[0] for r in turnover}:
        seen = [r for r in turnover if r[0] == day and r[4] <= cut]
        if not seen:
            continue
        row = max(seen, key=lambda r: r[1])
        latest = {}
        for m in sorted(money, key=lambda m: (m[1], m[4])):
            if m[4] <= min(row[4], cut) and m[5] <= cut:
                latest[(m[0], m[2])] = m
        usable = [m for m in latest.values() if m[6] == "available" and eligible(m)]
        best = max(usable, key=lambda m: (m[4], m[0], m[1], m[5], m[2]), default=(None,) * 4)
        want[day] = (row[1], best[0], best[1], best[2], best[3])
    assert got == want
    assert len({v[3] for v in want.values()}) == 3


def test_quality_dates_are_the_days_behind_the_counts(spark):
    day = [dt.date(2024, 1, n) for n in range(1, 8)]
    raw = [("A", day[0], 1, 5.0), ("A", day[0], 2, 0.0), ("A", day[3], 1, None), ("A", day[5], 1, -1.0), ("B", day[2], 1, 1.0)]
    rf = spark.createDataFrame(raw, "symbol string, date date, ingest_order int, volume double")
    for c in ("open", "high", "low", "close"):
        rf = rf.withColumn(c, F.lit(1.0))
    calendar = spark.createDataFrame([(d,) for d in day], "date date")
    got = sorted(tuple(r) for r in qa.quality_dates(rf, calendar).collect())
    missing = [("A", "missing_reference_date", day[i]) for i in (1, 2, 4)]
    assert got == sorted([*missing, ("A", "duplicate_date", day[0]), ("A", "zero_volume", day[0]), ("A", "zero_volume", day[5])])
    facts = {r["symbol"]: r for r in qa.data_quality_profile(rf, calendar).collect()}
    assert facts["A"]["missing_reference_dates"] == 3 and facts["A"]["duplicate_dates"] == 1 and facts["A"]["zero_volume_rows"] == 2


def _reasons(spark, row, schema, rules):
    return va.validate(spark.createDataFrame([row], schema), rules).collect()[0]["reasons"]


def test_synthesis_profile_rules(spark):
    good = {
        "logical_profile_id": "L", "revision_number": 2, "revision_of": "r1", "scope": "symbol", "scope_value": "A", "allowed_method_families": ["VAL-01"],
        "overlap_tolerance": 0.05, "evidence_strength_policy": [(2, "low"), (3, "high")], "created_by": "a", "rationale": "b", **va.SYNTHESIS_POLICIES,
    }
    kinds = {"revision_number": "int", "allowed_method_families": "array<string>", "overlap_tolerance": "double", "evidence_strength_policy": "array<struct<minimum:int,label:string>>"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in good)

    def broken(**change):
        return _reasons(spark, tuple({**good, **change}.values()), schema, va.synthesis_profile_rules())

    assert broken() == []
    assert broken(scope="global") == ["global_scope_has_value"]
    assert broken(scope="global", scope_value=None) == []
    assert broken(scope=None) == ["scope_unknown"]
    assert broken(scope_value=" ") == ["scope_value_missing"]
    assert broken(overlap_tolerance=1.0) == broken(overlap_tolerance=float("nan")) == broken(overlap_tolerance=None) == ["tolerance_range"]
    assert broken(evidence_strength_policy=[]) == broken(evidence_strength_policy=None) == ["strength_missing"]
    assert broken(evidence_strength_policy=[(1, "low")]) == ["strength_below_two"]
    assert broken(evidence_strength_policy=[(3, "low"), (3, "high")]) == ["strength_not_increasing"]
    assert broken(evidence_strength_policy=[(2, "high"), (3, "low")]) == ["strength_label_order"]
    assert broken(evidence_strength_policy=[(2, "low"), (3, "low")]) == ["strength_label_invalid", "strength_label_order"]
    assert broken(evidence_strength_policy=[(2, None)]) == ["strength_label_invalid"]
    assert broken(allowed_method_families=["FB-04", None]) == ["family_unsupported"]
    assert broken(allowed_method_families=None) == ["families_missing"]
    assert broken(boundary_policy=None, rationale="") == ["boundary_policy_not_fixed", "author_missing"]


def test_evaluation_and_resource_rules(spark):
    good = {"logical_profile_id": "L", "revision_number": 1, "revision_of": None, "horizons_sessions": [60, 20, 20], "created_by": "a", "rationale": "b", **va.EVALUATION_POLICIES}
    kinds = {"revision_number": "int", "horizons_sessions": "array<int>"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in good)
    assert _reasons(spark, tuple(good.values()), schema, va.evaluation_profile_rules()) == []
    bad = {**good, "revision_number": None, "horizons_sessions": [20], "benchmark_policy": "x"}
    assert _reasons(spark, tuple(bad.values()), schema, va.evaluation_profile_rules()) == ["revision_number_invalid", "horizons_not_fixed", "benchmark_policy_not_fixed"]
    assert _reasons(spark, tuple({**good, "horizons_sessions": None}.values()), schema, va.evaluation_profile_rules()) == ["horizons_not_fixed"]

    fine = {
        **dict.fromkeys(va.RESOURCE_IDENTITY, "x"), "raw_payload_sha256": "a" * 64, "schema_fingerprint": "0" * 64, "source_published_at": t(1), "available_at": t(2),
        "received_at": t(3), "ingested_at": t(3), "eligibility_status": "eligible", "quality_status": "fresh",
    }
    schema = ", ".join(f"{c} {'timestamp' if c.endswith('_at') else 'string'}" for c in fine)

    def broken(**change):
        return _reasons(spark, tuple({**fine, **change}.values()), schema, va.resource_revision_rules())

    assert broken() == []
    assert broken(available_at=None) == ["eligible_without_available_at"]
    assert broken(quality_status=None) == broken(quality_status="stale") == ["eligible_quality_unusable"]
    assert broken(eligibility_status="awaiting_review") == ["review_quality_mismatch"]
    assert broken(eligibility_status="awaiting_review", quality_status="awaiting_review", available_at=None) == []
    assert broken(available_at=t(0)) == ["available_before_published"]
    assert broken(available_at=t(4)) == ["available_after_received"]
    assert broken(ingested_at=t(2)) == ["ingested_before_received"]
    assert broken(received_at=None) == ["clock_missing"]
    assert broken(schema_fingerprint="A" * 64, provider_id=None) == ["identity_missing", "hash_invalid"]


def test_money_supply_in_both_layouts_and_its_releases(spark, tmp_path):
    full = {"data": {"dataSets": [["2026M05", "1", "0", "13,000", "1.0"], ["2026M06", "1", "0"]], "structure": {"Table1": [{"data": "M1A"}, {"data": "Ｍ１Ｂ"}]}}}
    compact = {"result": {"structure": {"tables": [{"name": "Table0", "items": ["M1B"]}, {"name": "Table1", "items": ["M1A", "m1 b"]}]}, "data": [["2025M05", "1", "0", "7.5", "0"], ["2025M12", "1", "0", "9", "0"]]}}
    unnamed = {"result": {"structure": {"tables": [{"name": "Table0", "items": ["M1B"]}]}, "data": [["2025M05", "1"]]}}
    for name, doc in (("full", full), ("compact", compact), ("unnamed", unnamed), ("broken", "{")):
        (tmp_path / f"{name}.json").write_text(doc if isinstance(doc, str) else json.dumps(doc))
    documents = ld.one_money_layout(ld.read_json(spark, str(tmp_path), ld.MONEY_ANY))
    values = ld.money_supply(documents)
    assert {r["period"]: r["value_raw"] for r in values.collect()} == {"2026-05": 13000.0, "2026-06": None, "2025-05": 7.5, "2025-12": 9.0}
    assert sorted(r["reason"] for r in ld.money_supply_rejects(documents).collect()) == ["category_missing", "document_unreadable"]
    releases = spark.createDataFrame([("2026-05", t(3)), ("2026-05", t(1)), ("2026-06", t(2)), ("2025-05", None)], "period string, available_at timestamp")
    out = ld.released_money_supply(values, releases)
    assert {r["period"]: (r["available_at"], r["reason"]) for r in out.collect()} == {
        "2026-05": (t(1), None),
        "2026-06": (t(2), "value_missing"),
        "2025-05": (None, "official_release_timestamp_required"),
        "2025-12": (None, "official_release_timestamp_required"),
    }
    status = ld.release_status(out.withColumn("year", F.substring("period", 1, 4)), ["year"])
    assert {r["year"]: (r["status"], r["usable"], r["waiting_periods"]) for r in status.collect()} == {
        "2026": ("partial", 1, ["2026-06"]),
        "2025": ("needs_human_input", 0, ["2025-05", "2025-12"]),
    }
