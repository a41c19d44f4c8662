import datetime as dt
import random

from pyspark.sql import functions as F

from helpers import day, rows
from tidemark.operators import campaigns as cp, confluence as cf, gaps as gp, liquidity as lq, outcomes as oc


def t(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def _walk(events, bars):
    """One event after the other."""
    out, state = {}, {}
    seen = {}
    for e in events:
        seen[(e[1], e[2])] = seen.get((e[1], e[2]), 0) + 1
    for eid, camp, at, kind, stage in sorted(events, key=lambda e: (e[2], e[1], e[0])):
        s = state.setdefault(camp, {"next": 1, "held": 0, "end": False})
        bar = next((b for b in bars if b[0] > at), None)
        if seen[(camp, at)] > 1:
            out[eid] = "ambiguous_same_time_events"
        elif kind == "entry" and s["end"]:
            out[eid] = "campaign_already_invalidated"
        elif bar is None:
            out[eid] = "no_next_available_bar"
        elif kind == "entry" and stage != s["next"]:
            out[eid] = "stage_sequence_violation"
        elif kind == "entry":
            s["next"] += 1
            s["held"] += 1
            out[eid] = "entry_confirmed"
        else:
            s["end"] = True
            out[eid] = "invalidation_confirmed" if s["held"] else "nothing_to_invalidate"
            s["held"] = 0
    return out


def test_stage_sequence_matches_a_walk(spark):
    rng = random.Random(21)
    events = []
    for i in range(250):
        kind = "invalidation" if rng.random() < 0.08 else "entry"
        events.append((i, rng.randint(0, 14), t(rng.randint(0, 60)), kind, rng.randint(1, 3) if kind == "entry" else None))
    bars = [(t(h), 10.0 + h) for h in range(0, 58, 3)]
    ev = spark.createDataFrame(events, "event_id int, campaign_id int, signal_at timestamp, event_kind string, stage int")
    bf = spark.createDataFrame(bars, "bar_at timestamp, open double")
    got = {r.event_id: r.outcome for r in cp.stage_sequence(ev, bf).select("event_id", "outcome").collect()}
    assert got == _walk(events, bars)
    again = {r.event_id: r.outcome for r in cp.stage_sequence(ev.orderBy(F.rand(3)), bf).select("event_id", "outcome").collect()}
    assert again == got


CAND = "symbol string, candidate_id string, method_family string, semantic_role string, evidence_level string, price_low double, price_high double, price double, dependency_keys array<string>"


def test_maximal_sets_match_brute_force(spark):
    rng = random.Random(13)
    data = []
    for s in ("a", "b", "c"):
        for i in range(25):
            low = rng.randint(100, 300)
            data.append((s, f"{i:02d}", "VAL-01", "target", "A", float(low), float(low + rng.randint(1, 60)), None, ["d"]))
    norm = cf.normalize_candidates(spark.createDataFrame(data, CAND), "0.05")
    for width in (7.0, 50.0, 1000.0):
        got = {(r.symbol, tuple(r.candidate_ids)) for r in cf.maximal_sets(norm, width).collect()}
        want = set()
        for s in ("a", "b", "c"):
            iv = [(r[1], r[5], r[6]) for r in data if r[0] == s]
            sets = {frozenset(i for i, lo, hi in iv if lo <= p <= hi) for p in {x for _, lo, hi in iv for x in (lo, hi)}}
            want |= {(s, tuple(sorted(x))) for x in sets if not any(x < y for y in sets)}
        assert got == want


def test_clusters_need_independent_families(spark):
    data = [
        ("s", "1", "VAL-01", "target", "A", None, None, 100.0, ["k1"]),
        ("s", "2", "FB-03", "target", "A", None, None, 101.0, ["k2"]),
        ("u", "1", "VAL-01", "target", "A", None, None, 100.0, ["k1"]),
        ("u", "2", "FB-03", "target", "A", None, None, 101.0, ["k1", "k3"]),
        ("v", "1", "VAL-01", "target", "U", None, None, 100.0, ["k1"]),
        ("v", "2", "FB-03", "target", "A", None, None, 101.0, ["k2"]),
        ("s", "9", "FB-04", "support", "A", 98.0, 99.0, None, ["k9"]),
    ]
    norm = cf.normalize_candidates(spark.createDataFrame(data, CAND), "0.05")
    targets = norm.where("semantic_role = 'target'")
    c = {r.symbol: r for r in cf.overlap_clusters(targets, 10.0, ((2, "low"), (3, "moderate"))).collect()}
    assert set(c) == {"s", "u"}
    assert c["s"].status == "available" and c["s"].evidence_strength == "low" and c["s"].independent_method_count == 2
    assert c["u"].status != "available" and c["u"].shared_dependencies == ["k1"]
    good = cf.overlap_clusters(targets, 10.0, ((2, "low"),)).where("status = 'available'")
    assert [(r.cluster_id == c["s"].cluster_id, float(r.overlap_low), float(r.overlap_high)) for r in cf.support_overlap(good, norm.where("semantic_role = 'support'"), 10.0).collect()] == [(True, 98.0, 99.0)]
    assert rows(cf.unclustered(targets, good).select("symbol", "candidate_id"), "symbol", "candidate_id") == [("u", "1"), ("u", "2"), ("v", "2")]


def test_three_families_chain_into_one_component(spark):
    data = [("s", str(i), f, "target", "A", None, None, 100.0, deps) for i, (f, deps) in enumerate([("A", ["x"]), ("B", ["x", "y"]), ("C", ["y"]), ("D", ["z"])])]
    members = spark.createDataFrame(data, CAND)
    r = cf.independent_components(members, ("symbol",), ("A", "B", "C", "D")).first()
    assert r.independent_method_count == 2 and r.shared_dependencies == ["x", "y"]


def test_gap_row_needs_unique_consensus(spark):
    price = "symbol string, date date, open double, high double, low double, close double, volume double"

    def run(factors):
        off = [("A", day(i), 10.0, 10.0, 10.0, 10.0, 5.0) for i in range(len(factors) + 1)]
        prov = [("A", day(i + 1), 10 * f, 10 * f, 10 * f, 10 * f, 5.0) for i, f in enumerate(factors)]
        acts = spark.createDataFrame([], "symbol string, event_date date, event_type string")
        out = gp.adjusted_gap_rows(
            spark.createDataFrame([("A", day(0))], "symbol string, date date"), spark.createDataFrame(prov, price), spark.createDataFrame(off, price), acts
        ).first()
        return out.reason, out.close

    assert run([0.9, 0.9, 0.9]) == (None, 9.0)
    assert run([0.9, 0.9, 0.8]) == (None, 9.0)
    assert run([0.9]) == ("fewer_than_two_same_segment_anchors", None)
    assert run([0.9, 0.8]) == ("no_factor_consensus", None)
    assert run([0.9, 0.9, 0.8, 0.8]) == ("ambiguous_factor_consensus", None)


def test_m1b_never_falls_back_behind_a_revocation(spark):
    m = spark.createDataFrame(
        [("2024-01", 1, 100.0, dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 1), "available"),
         ("2024-02", 1, 200.0, dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 1), "available"),
         ("2024-02", 2, 210.0, dt.datetime(2024, 3, 10), dt.datetime(2024, 3, 10), "revoked")],
        "period string, revision int, value_twd double, available_at timestamp, ingested_at timestamp, status string",
    )
    tv = spark.createDataFrame(
        [(dt.date(2024, 1, 15), 1.0, "available"), (dt.date(2024, 2, 15), 1.0, "available"), (dt.date(2024, 3, 5), 1.0, "available"), (dt.date(2024, 3, 15), 1.0, "available")],
        "trade_date date, total double, status string",
    ).withColumns({"available_at": F.col("trade_date").cast("timestamp"), "ingested_at": F.col("trade_date").cast("timestamp")})
    got = [r[1] for r in rows(lq.asof_m1b(tv, m, "2024-04-01").select("trade_date", "m1b_period"), "trade_date")]
    # After the revocation the older period is what is left, never the revoked month's first revision.
    assert got == [None, "2024-01", "2024-02", "2024-01"]


def test_percentile_counts_ties_and_needs_coverage(spark):
    base = dt.date(2020, 1, 1)
    obs = spark.createDataFrame([(base + dt.timedelta(days=100 * i), float(v)) for i, v in enumerate([3, 1, 2, 2, 5])], "trade_date date, ratio_pct double")
    got = [r[1:] for r in rows(lq.trailing_percentile(obs, 1, 2), "trade_date")]
    assert got[:3] == [(None, 1), (None, 2), (None, 3)] and got[4] == (100.0, 4)


def test_outcomes_touch_pending_and_missing_sessions(spark):
    bars = [("A", day(i), 100.0, 101.0 if i != 5 else 121.0, 99.0, 100.0) for i in range(40)]
    bf = spark.createDataFrame(bars, "symbol string, date date, open double, high double, low double, close double")
    bench = spark.createDataFrame([(day(i), 10.0, 11.0) for i in range(40)], "date date, open double, close double")
    sub = spark.createDataFrame(
        [("s1", "t", "A", "live_refresh", "target_candidate", "VAL-01", "target", None, day(0), 120.0, 122.0),
         ("s1", "m", "A", "live_refresh", "target_candidate", "VAL-01", "target", None, day(0), 150.0, 160.0),
         ("s1", "x", "A", "live_refresh", "target_candidate", "FB-04", "target", None, day(0), 150.0, 160.0),
         ("s1", "p", "A", "live_refresh", "target_candidate", "VAL-01", "target", None, day(20), 150.0, 160.0)],
        "snapshot_id string, subject_id string, symbol string, capture_mode string, subject_type string, method_family string, semantic_role string, evidence_strength string, cutoff_date date, price_low double, price_high double",
    )
    q = spark.createDataFrame([("A", "available")], "symbol string, status string")

    def run(b, through):
        out = oc.evaluate_outcomes(sub, b, bench, bench.select("date"), q, through)
        return {r.subject_id: r for r in out.where("horizon_sessions = 20").collect()}

    got = run(bf, "2020-02-05")
    assert got["t"].terminal_outcome == "target_reached" and got["t"].sessions_to_target == 4 and got["t"].maximum_upside_excursion == 0.21
    assert got["m"].terminal_outcome == "expired" and got["m"].benchmark_return == 0.1 and "x" not in got
    assert got["p"].terminal_outcome == "insufficient_future_data"
    assert run(bf, "2020-01-10")["t"].terminal_outcome == "pending"
    assert run(bf.where(F.col("date") != F.lit(day(9))), "2020-02-05")["t"].terminal_outcome == "insufficient_future_data"
