"""Queries on campaigns, confluence and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.operators import campaigns as cp, confluence as cf, outcomes as oc, valuation as val
from tidemark.plans import domain as d
from tidemark.plans.domain_sql import exact, half_up, with_views
from tidemark.plans.q_ledger import PE_EFF, STATES, approved_eps, symbol_pe
from tidemark.plans.registry import query

EV = {
    "mb": "SELECT * FROM hourly WHERE hour(bar_at) BETWEEN 9 AND 15",
    "ce": "SELECT *, event_id % 10 <> 3 AS trig FROM campaign_events",
    "nx": """SELECT ce.*, (SELECT min(bar_at) FROM mb WHERE bar_at > ce.signal_at) AS bar_at FROM ce""",
    "nb": "SELECT nx.*, mb.open FROM nx LEFT JOIN mb ON mb.bar_at = nx.bar_at",
}
TS = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def _events(spark, sf_dir):
    return d.campaign_events(spark, sf_dir).withColumn("trigger_matches", F.col("event_id") % 10 != 3)


def _market(spark, sf_dir):
    return d.hourly_bars(spark, sf_dir).where(F.hour("bar_at").between(9, 15))


@query(
    "next_bar_match",
    with_views(
        "campaign_events",
        "hourly",
        extra=EV,
        body=f"SELECT event_id, {TS.format(c='signal_at')} AS signal_at, {TS.format(c='bar_at')} AS bar_at, open FROM nb",
    ),
)
def q_next_bar(spark, sf_dir):
    return cp.next_bar(_events(spark, sf_dir), _market(spark, sf_dir)).select("event_id", "signal_at", "bar_at", "open")


@query(
    "conflict_events",
    with_views(
        "campaign_events",
        body=f"""SELECT campaign_id, {TS.format(c='signal_at')} AS signal_at, count(*) AS events FROM campaign_events
            GROUP BY campaign_id, campaign_events.signal_at HAVING count(*) > 1""",
    ),
)
def q_conflicts(spark, sf_dir):
    return cp.conflicting_instants(d.campaign_events(spark, sf_dir))


SEQ = {
    **EV,
    "cl": "SELECT *, count(*) OVER (PARTITION BY campaign_id, signal_at) > 1 AS clash FROM nb",
    "df": """SELECT *, CASE WHEN clash THEN 'ambiguous_same_time_events' WHEN event_kind = 'entry' AND NOT trig THEN 'trigger_reference_mismatch'
        WHEN bar_at IS NULL THEN 'no_next_available_bar' WHEN open <= 0 THEN 'invalid_execution_open' END AS defect,
        row_number() OVER (PARTITION BY campaign_id ORDER BY signal_at, event_id) AS j FROM cl""",
    # The plain state machine, one event after the other.
    "sq": """WITH RECURSIVE r AS (
        SELECT campaign_id, 0::BIGINT AS j, NULL::BIGINT AS event_id, 1 AS nxt, false AS ended, 0 AS held, NULL::VARCHAR AS outcome, NULL::INT AS expected
        FROM (SELECT DISTINCT campaign_id FROM df)
        UNION ALL
        SELECT e.campaign_id, e.j, e.event_id,
            CASE WHEN e.defect IS NULL AND e.event_kind = 'entry' AND NOT r.ended AND e.stage = r.nxt THEN r.nxt + 1 ELSE r.nxt END,
            r.ended OR (e.defect IS NULL AND e.event_kind = 'invalidation'),
            CASE WHEN e.defect IS NULL AND e.event_kind = 'entry' AND NOT r.ended AND e.stage = r.nxt THEN r.held + 1
                 WHEN e.defect IS NULL AND e.event_kind = 'invalidation' THEN 0 ELSE r.held END,
            CASE WHEN e.defect = 'ambiguous_same_time_events' THEN e.defect
                 WHEN e.event_kind = 'entry' AND r.ended THEN 'campaign_already_invalidated'
                 WHEN e.defect IS NOT NULL THEN e.defect
                 WHEN e.event_kind = 'entry' AND e.stage = r.nxt THEN 'entry_confirmed'
                 WHEN e.event_kind = 'entry' THEN 'stage_sequence_violation'
                 WHEN r.held > 0 THEN 'invalidation_confirmed' ELSE 'nothing_to_invalidate' END,
            CASE WHEN e.defect IS NULL AND e.event_kind = 'entry' AND NOT r.ended AND e.stage IS DISTINCT FROM r.nxt THEN r.nxt END
        FROM r JOIN df e ON e.campaign_id = r.campaign_id AND e.j = r.j + 1)
        SELECT * FROM r WHERE j > 0""",
    "oc": """SELECT df.*, sq.outcome, sq.expected FROM sq JOIN df ON df.event_id = sq.event_id""",
}


def _sequence(spark, sf_dir):
    return cp.stage_sequence(_events(spark, sf_dir), _market(spark, sf_dir))


@query(
    "stage_sequence",
    with_views(
        "campaign_events",
        "hourly",
        extra=SEQ,
        body=f"""SELECT event_id, campaign_id, {TS.format(c='signal_at')} AS signal_at, event_kind, stage::BIGINT AS stage, outcome,
            expected::BIGINT AS expected_stage FROM oc""",
    ),
)
def q_sequence(spark, sf_dir):
    return _sequence(spark, sf_dir)


TOL, WIDTH = "0.02", 40.0
POLICY = ((2, "low"), (3, "moderate"), (4, "high"))
NORM = {
    "norm": """SELECT *, round(price * (1::DECIMAL(9,6) - 0.02::DECIMAL(9,6)), 4)::DECIMAL(20,4) AS lo,
        round(price * (1::DECIMAL(9,6) + 0.02::DECIMAL(9,6)), 4)::DECIMAL(20,4) AS hi FROM candidates WHERE evidence_level <> 'U' AND price > 0""",
    "tgt": "SELECT * FROM norm WHERE semantic_role = 'target'",
    "sup": "SELECT * FROM norm WHERE semantic_role = 'support'",
}
# Brute force on purpose: every bound is a probe, then sets inside larger sets are removed.
SETS = {
    **NORM,
    "probe": "SELECT DISTINCT symbol, lo AS p FROM tgt UNION SELECT DISTINCT symbol, hi FROM tgt",
    "act": """SELECT probe.symbol, p, list(candidate_id ORDER BY candidate_id) AS ids FROM probe JOIN tgt
        ON tgt.symbol = probe.symbol AND p BETWEEN lo AND hi GROUP BY ALL""",
    "ds": "SELECT DISTINCT symbol, ids FROM act",
    "mx": """SELECT a.symbol, a.ids FROM ds a WHERE NOT EXISTS (SELECT 1 FROM ds b WHERE b.symbol = a.symbol
        AND len(b.ids) > len(a.ids) AND list_has_all(b.ids, a.ids))""",
}
CLUST = {
    **SETS,
    "mm": "SELECT mx.symbol, mx.ids, t.candidate_id, method_family, dependency_keys, lo, hi FROM (SELECT symbol, ids, unnest(ids) AS cid FROM mx) mx JOIN tgt t ON t.symbol = mx.symbol AND t.candidate_id = cid",
    "dp": "SELECT symbol, ids, method_family, unnest(dependency_keys) AS dep FROM mm",
    "sh": "SELECT symbol, ids, dep FROM dp GROUP BY ALL HAVING count(DISTINCT method_family) > 1",
    "sl": "SELECT symbol, ids, string_agg(DISTINCT dep, ',' ORDER BY dep) AS shared FROM sh GROUP BY ALL",
    "sp": """SELECT symbol, ids, max(lo) AS lo, min(hi) AS hi, count(*) AS n, count(DISTINCT method_family) AS nf,
        string_agg(DISTINCT method_family, ',' ORDER BY method_family) AS families FROM mm GROUP BY ALL""",
    # Only two target families exist, so they are one component exactly when they share a dependency.
    "cl": """SELECT sp.*, coalesce(shared, '') AS shared, CASE WHEN nf = 2 AND shared IS NOT NULL THEN 1 ELSE nf END AS ni,
        'target_cluster_' || substr(sha256(array_to_string(sp.ids, '|')), 1, 20) AS cluster_id
        FROM sp LEFT JOIN sl ON sl.symbol = sp.symbol AND sl.ids = sp.ids WHERE nf >= 2""",
}


def _norm(spark, sf_dir, dealt=False):
    return cf.normalize_candidates(d.candidates(spark, sf_dir, dealt), TOL)


def _targets(spark, sf_dir, dealt=False):
    return _norm(spark, sf_dir, dealt).where("semantic_role = 'target'")


def _clusters(spark, sf_dir, dealt=False):
    return cf.overlap_clusters(_targets(spark, sf_dir, dealt), WIDTH, POLICY)


@query(
    "candidate_ranges",
    with_views("candidates", extra=NORM, body="SELECT symbol, candidate_id, semantic_role, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM norm"),
)
def q_ranges(spark, sf_dir):
    return _norm(spark, sf_dir).select("symbol", "candidate_id", "semantic_role", "lo", "hi")


@query(
    "rejected_candidates",
    with_views(
        "candidates",
        body=f"""SELECT * FROM (SELECT symbol, candidate_id, CASE
            WHEN NOT coalesce(method_family IN ({", ".join(f"'{f}'" for f in (*K.TARGET_FAMILIES, K.SUPPORT_FAMILY))}), false) THEN 'method_family_not_allowed_by_profile'
            WHEN evidence_level = 'U' THEN 'evidence_level_unverified' WHEN NOT coalesce(price > 0, false) THEN 'price_not_positive' END AS exclusion_reason
            FROM candidates) WHERE exclusion_reason IS NOT NULL""",
    ),
)
def q_rejected(spark, sf_dir):
    return cf.rejected_candidates(d.candidates(spark, sf_dir)).select("symbol", "candidate_id", "exclusion_reason")


@query(
    "candidate_extract",
    with_views(
        "eps",
        "approvals",
        "pe",
        extra={
            **STATES,
            **PE_EFF,
            "long": """SELECT symbol, id, unnest(['low', 'base', 'high']) AS sc, unnest([eps_low, eps_base, eps_high]) AS v FROM states WHERE status = 'active' AND eligible""",
            "cells": "SELECT l.symbol, l.id, sc, pe_id, " + half_up(exact("v") + " * " + exact("pe_value", 4, 11), 4)
            + " AS tp FROM long l JOIN pe_eff p ON p.scope = 'symbol' AND p.scope_value = l.symbol WHERE v > 0",
            "sce": """SELECT 'C' || o_custkey AS symbol, o_orderkey AS a, CASE o_orderkey % 3 WHEN 0 THEN 'FB-03' WHEN 1 THEN 'FB-04' ELSE 'FB-05' END AS r,
                (o_custkey % 100 + 50)::DOUBLE AS lv FROM orders""",
        },
        body="""SELECT symbol, 'valuation:' || id || ':' || sc || ':' || pe_id AS candidate_id, 'VAL-01' AS method_family, 'target' AS semantic_role, tp AS price,
                id || ',' || pe_id AS source_resource_ids, 'forward_eps_revision:' || id || ',pe_scenario_revision:' || pe_id AS dependency_keys FROM cells
            UNION ALL SELECT symbol, 'technical:' || a || ':' || r, r, CASE WHEN r = 'FB-04' THEN 'support' ELSE 'target' END, lv, a::VARCHAR, 'anchor_revision:' || a FROM sce WHERE r <> 'FB-05'""",
    ),
)
def q_extract(spark, sf_dir):
    matrix = val.eps_pe_matrix(approved_eps(spark, sf_dir), symbol_pe(spark, sf_dir))
    k = F.col("o_orderkey")
    scenarios = d.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        k.alias("anchor_set_id"),
        F.when(k % 3 == 0, "FB-03").when(k % 3 == 1, "FB-04").otherwise("FB-05").alias("rule_id"),
        (F.col("o_custkey") % 100 + 50).cast("double").alias("calculated_level"),
    )
    return cf.candidate_extract(matrix, scenarios)


@query(
    "maximal_sets",
    with_views("candidates", extra=SETS, body="SELECT symbol, array_to_string(ids, ',') AS candidate_ids FROM mx"),
)
def q_sets(spark, sf_dir):
    return cf.maximal_sets(_targets(spark, sf_dir), WIDTH).select("symbol", "candidate_ids")


@query(
    "overlap_clusters",
    with_views(
        "candidates",
        extra=CLUST,
        body="""SELECT symbol, cluster_id, lo::DOUBLE AS price_low, hi::DOUBLE AS price_high, n AS candidate_count, nf AS support_count,
            ni::BIGINT AS independent_method_count, CASE WHEN ni >= 2 THEN 'low' END AS evidence_strength, families,
            array_to_string(ids, ',') AS candidate_ids, shared AS shared_dependencies,
            CASE WHEN ni >= 2 THEN 'available' ELSE 'independent_target_methods_below_two' END AS status FROM cl""",
    ),
)
def q_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir)


@query(
    "independent_components",
    with_views(
        "candidates",
        extra={
            **NORM,
            # Reachability between families of one analysis over shared keys, to a fixed point.
            "nd": "SELECT DISTINCT symbol, method_family AS f, unnest(dependency_keys) AS dep FROM norm",
            "eg": "SELECT DISTINCT a.symbol, a.f AS x, b.f AS y FROM nd a JOIN nd b ON a.symbol = b.symbol AND a.dep = b.dep",
            "rc": """WITH RECURSIVE r AS (SELECT symbol, x, y FROM eg UNION SELECT r.symbol, r.x, eg.y FROM r
                JOIN eg ON eg.symbol = r.symbol AND eg.x = r.y) SELECT * FROM r""",
            "lb": "SELECT symbol, x, min(y) AS label FROM rc GROUP BY ALL",
            "sd": "SELECT symbol, dep FROM nd GROUP BY ALL HAVING count(*) > 1",
        },
        body="""SELECT l.symbol, string_agg(DISTINCT x, ',' ORDER BY x) AS families, count(DISTINCT label) AS independent_method_count,
            coalesce((SELECT string_agg(dep, ',' ORDER BY dep) FROM sd WHERE sd.symbol = l.symbol), '') AS shared_dependencies
            FROM lb l GROUP BY l.symbol""",
    ),
)
def q_components(spark, sf_dir):
    return cf.independent_components(_norm(spark, sf_dir), ("symbol",))


@query(
    "support_overlap",
    with_views(
        "candidates",
        extra=CLUST,
        body="""SELECT cl.symbol, cluster_id, sup.candidate_id AS support_candidate_id, greatest(cl.lo, sup.lo)::DOUBLE AS overlap_low,
            least(cl.hi, sup.hi)::DOUBLE AS overlap_high FROM cl JOIN sup ON sup.symbol = cl.symbol
            AND greatest(cl.lo, sup.lo) <= least(cl.hi, sup.hi) WHERE ni >= 2""",
    ),
)
def q_support(spark, sf_dir):
    supports = _norm(spark, sf_dir).where("semantic_role = 'support'")
    return cf.support_overlap(_clusters(spark, sf_dir).where("status = 'available'"), supports, WIDTH)


@query(
    "confluence_summary",
    with_views(
        "candidates",
        extra={
            **CLUST,
            "g": """SELECT symbol, count(*) AS c, max(n) AS n, max(nf) AS nf, max(ni) AS ni FROM cl WHERE ni >= 2 GROUP BY symbol""",
            "sy": "SELECT DISTINCT symbol FROM tgt",
        },
        body="""SELECT symbol, coalesce(c, 0) AS clusters, coalesce(n, 0) AS max_candidate_count, coalesce(nf, 0) AS max_support_count,
            coalesce(ni, 0)::BIGINT AS max_independent_method_count, CASE WHEN ni >= 2 THEN 'low' END AS max_evidence_strength,
            CASE WHEN c IS NULL THEN 'insufficient_data' ELSE 'available' END AS status,
            CASE WHEN c IS NULL THEN 'independent_target_methods_below_two' END AS reason FROM sy LEFT JOIN g USING (symbol)""",
    ),
)
def q_confluence_summary(spark, sf_dir):
    t = _targets(spark, sf_dir)
    return cf.confluence_summary(t, cf.overlap_clusters(t, WIDTH, POLICY), POLICY)


@query(
    "unclustered_targets",
    with_views(
        "candidates",
        extra={**CLUST, "us": "SELECT DISTINCT symbol, unnest(ids) AS cid FROM cl WHERE ni >= 2"},
        body="""SELECT t.symbol, t.candidate_id, t.method_family FROM tgt t
            ANTI JOIN us ON us.symbol = t.symbol AND us.cid = t.candidate_id""",
    ),
)
def q_unclustered(spark, sf_dir):
    t = _targets(spark, sf_dir)
    out = cf.unclustered(t, cf.overlap_clusters(t, WIDTH, POLICY))
    return out.select("symbol", "candidate_id", "method_family")


OBSERVED = "2001-08-31"
OUT = {
    "ses": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM bench",
    "db": "SELECT dense.*, i FROM dense JOIN ses USING (date)",
    "s0": """SELECT s.*, (SELECT min(date) FROM db WHERE db.symbol = s.symbol AND db.date > s.cutoff_date) AS sd FROM subjects s""",
    "s1": """SELECT s0.*, b.i AS si, b.open AS so, h AS horizon, si + h AS ei FROM s0 LEFT JOIN db b ON b.symbol = s0.symbol AND b.date = s0.sd
        CROSS JOIN (SELECT unnest([20, 60]) AS h)""",
    "s2": """SELECT s1.*, e.date AS ed, bs.open AS bo, be.close AS bc, CASE WHEN s1.symbol = 'RF' THEN 'quality_warning' ELSE 'available' END AS quality
        FROM s1 LEFT JOIN ses e ON e.i = s1.ei LEFT JOIN bench bs ON bs.date = s1.sd LEFT JOIN bench be ON be.date = e.date""",
    "s3": """SELECT s2.subject_id, s2.horizon, count(*) AS nb, max(b.high) AS mh, min(b.low) AS ml, arg_max(b.close, b.i) AS lc,
        min(b.i) FILTER (b.low <= price_high AND b.high >= price_low) AS ti,
        min(b.date) FILTER (b.low <= price_high AND b.high >= price_low) AS td
        FROM s2 JOIN db b ON b.symbol = s2.symbol AND b.i BETWEEN s2.si AND s2.ei GROUP BY ALL""",
    "s4": f"""SELECT s2.*, nb, mh / so - 1 AS up, ml / so - 1 AS down, ml, lc / so - 1 AS ret, bc / bo - 1 AS bret, ti, td,
        CASE WHEN sd IS NULL OR ed IS NULL THEN 'insufficient_future_data' WHEN ed > DATE '{OBSERVED}' THEN 'pending'
             WHEN nb <> s2.horizon + 1 THEN 'insufficient_future_data' END AS early,
        CASE WHEN so BETWEEN price_low AND price_high THEN 'already_in_range' WHEN so < price_low THEN 'above_start' ELSE 'below_start' END AS pos,
        semantic_role = 'support' AS sup FROM s2 LEFT JOIN s3 ON s3.subject_id = s2.subject_id AND s3.horizon = s2.horizon""",
    "res": f"""SELECT snapshot_id, subject_id, symbol,
        CASE WHEN capture_mode = 'live_refresh' THEN 'prospective_snapshot' ELSE 'historical_reconstruction' END AS evaluation_origin,
        subject_type, method_family, semantic_role, evidence_strength, horizon::BIGINT AS horizon_sessions, quality AS quality_status,
        CASE WHEN early IS NOT NULL THEN early WHEN sup THEN 'not_applicable' WHEN pos = 'already_in_range' THEN pos
             WHEN quality = 'quality_warning' THEN 'quality_warning' WHEN ti IS NOT NULL THEN 'target_reached' ELSE 'expired' END AS terminal_outcome,
        sd::VARCHAR AS evaluation_start_session, CASE WHEN sd IS NOT NULL THEN ed::VARCHAR END AS evaluation_end_session,
        CASE WHEN early IS NULL THEN pos END AS target_position_at_start,
        CASE WHEN early IS NULL THEN {half_up('up', 6)} END AS maximum_upside_excursion,
        CASE WHEN early IS NULL THEN {half_up('down', 6)} END AS maximum_downside_excursion,
        CASE WHEN early IS NULL THEN {half_up('ret', 6)} END AS forward_return,
        CASE WHEN early IS NULL THEN {half_up('bret', 6)} END AS benchmark_return,
        CASE WHEN early IS NULL THEN {half_up('ret - bret', 6)} END AS excess_return,
        CASE WHEN early IS NULL AND bret IS NOT NULL THEN 'available' ELSE 'insufficient_data' END AS benchmark_status,
        CASE WHEN early IS NULL AND NOT sup AND pos <> 'already_in_range' AND quality = 'available' THEN ti IS NOT NULL
             WHEN early IS NULL AND NOT sup AND pos = 'already_in_range' THEN false END AS target_reached,
        CASE WHEN early IS NULL AND NOT sup AND pos <> 'already_in_range' AND quality = 'available' THEN td::VARCHAR END AS first_target_reached_at,
        CASE WHEN early IS NULL AND NOT sup AND pos <> 'already_in_range' AND quality = 'available' THEN (ti - si)::BIGINT END AS sessions_to_target,
        CASE WHEN early IS NULL AND NOT sup AND pos <> 'already_in_range' THEN CASE WHEN pos = 'above_start' THEN {half_up('up', 6)} ELSE {half_up('-down', 6)} END END AS directional_mfe,
        CASE WHEN early IS NULL AND NOT sup AND pos <> 'already_in_range' THEN CASE WHEN pos = 'above_start' THEN {half_up('down', 6)} ELSE {half_up('-up', 6)} END END AS directional_mae,
        CASE WHEN early IS NULL AND sup THEN ti IS NOT NULL END AS support_touched,
        CASE WHEN early IS NULL AND sup THEN ti IS NOT NULL AND coalesce(so >= price_high AND NOT ml < price_low, false) END AS support_held,
        CASE WHEN early IS NULL AND sup AND so >= price_high THEN ml < price_low END AS support_breached FROM s4""",
}


def _results(spark, sf_dir):
    bars = d.dense_bars(spark, sf_dir)
    bench = d.benchmark(spark, sf_dir)
    quality = bars.select("symbol").distinct().withColumn(
        "status", F.when(F.col("symbol") == "RF", "quality_warning").otherwise("available")
    )
    return oc.evaluate_outcomes(d.subjects(spark, sf_dir), bars, bench, bench, quality, OBSERVED)


@query("scenario_outcomes", with_views("dense", "subjects", "bench", extra=OUT, body="SELECT * FROM res"))
def q_outcomes(spark, sf_dir):
    return _results(spark, sf_dir)


@query(
    "session_offsets",
    with_views(
        "dense",
        "subjects",
        "bench",
        extra={k: OUT[k] for k in ("ses", "db", "s0")},
        body="""SELECT subject_id, s0.symbol, cutoff_date::VARCHAR AS cutoff_date, sd::VARCHAR AS start_date,
            ses.i - (SELECT min(i) FROM ses x WHERE x.date > cutoff_date) AS market_sessions_skipped
            FROM s0 LEFT JOIN ses ON ses.date = s0.sd""",
    ),
)
def q_offsets(spark, sf_dir):
    return oc.sessions_skipped(d.subjects(spark, sf_dir), d.dense_bars(spark, sf_dir), d.benchmark(spark, sf_dir))


_RATED = "semantic_role = 'target' AND terminal_outcome IN ('target_reached', 'expired') AND quality_status = 'available'"
_KINDS = (
    "target_reached expired already_in_range not_applicable quality_warning insufficient_future_data pending".split()
)


@query(
    "outcome_summary",
    with_views(
        "dense",
        "subjects",
        "bench",
        extra=OUT,
        body=f"""SELECT {', '.join(oc.GROUP)}, count(*) AS n,
            count(*) FILTER ({_RATED} AND terminal_outcome = 'target_reached') AS numerator, count(*) FILTER ({_RATED}) AS denominator,
            {half_up(f"count(*) FILTER ({_RATED} AND terminal_outcome = 'target_reached')::DOUBLE / nullif(count(*) FILTER ({_RATED}), 0)", 8)} AS reach_rate,
            """
        + ", ".join(
            half_up(f"median({c}) FILTER ({_RATED})", 8) + f" AS {n}"
            for c, n in (
                ("forward_return", "median_forward_return"),
                ("excess_return", "median_excess_return"),
                ("maximum_upside_excursion", "median_upside_excursion"),
                ("maximum_downside_excursion", "median_downside_excursion"),
            )
        )
        + ", "
        + ", ".join(f"count(*) FILTER (terminal_outcome = '{k}') AS n_{k}" for k in _KINDS)
        + f" FROM res GROUP BY {', '.join(oc.GROUP)}",
    ),
)
def q_outcome_summary(spark, sf_dir):
    return oc.outcome_summary(_results(spark, sf_dir))


@query(
    "outcome_coverage",
    with_views(
        "dense",
        "subjects",
        "bench",
        extra=OUT,
        body="""SELECT count(DISTINCT snapshot_id) AS snapshots, count(DISTINCT subject_id) AS subjects, count(*) AS records,
            count(*) FILTER (quality_status = 'quality_warning') AS quality_warning_records,
            count(DISTINCT snapshot_id) FILTER (quality_status = 'quality_warning') AS quality_warning_snapshots,
            count(DISTINCT symbol) AS symbols, count(DISTINCT subject_id) FILTER (subject_type = 'target_candidate') AS target_candidates,
            count(DISTINCT subject_id) FILTER (subject_type = 'target_cluster') AS target_clusters,
            count(DISTINCT subject_id) FILTER (subject_type = 'support_candidate') AS support_candidates FROM res""",
    ),
)
def q_coverage(spark, sf_dir):
    return oc.outcome_coverage(_results(spark, sf_dir))
