"""Queries on screening, scenarios and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.operators import asof, indicators as ind, scenarios as sc, screening as sn, valuation as val
from tidemark.plans import domain as d
from tidemark.plans.domain_sql import ASKED, CUTOFF, with_views
from tidemark.plans.q_ledger import STATES, approved_eps
from tidemark.plans.q_panel import pivots_cte
from tidemark.plans.registry import ORACLES, query
from tidemark.sources.dimensions import dimension_defects

THRESHOLDS = {"pe": 40.0, "pb": 60.0, "dividend_yield": 30.0}
YEARS, MINIMUM = 3, 150


def _list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"



VALS = {
    "vals": """SELECT symbol, metric_date, unnest(CASE WHEN (substr(symbol, 2)::BIGINT + date_diff('day', DATE '1995-01-01', metric_date)) % 40 = 0
        THEN [pe, pe + 1] ELSE [pe] END) AS pe, pb, dividend_yield_ratio FROM valuations""",
}


def _valuations(spark, sf_dir):
    v = d.valuations(spark, sf_dir)
    twice = (d.symbol_number() + d.day_number("metric_date")) % 40 == 0
    both = F.array(F.col("pe"), F.col("pe") + 1)
    return v.select(
        "symbol",
        "metric_date",
        F.explode(F.when(twice, both).otherwise(F.array("pe"))).alias("pe"),
        "pb",
        "dividend_yield_ratio",
    )


def _component_sql(name: str) -> str:
    col, lower, zero = sn.METRICS[name]
    ok = f"{col} >= 0" if zero else f"{col} > 0"
    now_ok = ok.replace(col, "now")
    op = "<=" if lower else ">="
    return f"""SELECT symbol, metric_date, '{name}' AS component, value, observation_count, invalid_observation_count, reason,
        CASE WHEN reason IS NULL THEN 'available' WHEN reason = 'invalid_{name}' THEN 'invalid_metric' ELSE 'insufficient_data' END AS status,
        CASE WHEN reason IS NULL THEN below::DOUBLE / observation_count::DOUBLE * 1e2 END AS percentile,
        coalesce(reason IS NULL AND below::DOUBLE / observation_count::DOUBLE * 1e2 {op} {THRESHOLDS[name]}, false) AS passed
        FROM (SELECT *, CASE WHEN cr <> 1 THEN 'ambiguous_current_valuation_observation'
                WHEN NOT coalesce({now_ok}, false) THEN 'invalid_{name}'
                WHEN observation_count < {MINIMUM} THEN '{name}_minimum_observations_not_met' END AS reason, now AS value
              FROM (SELECT r.symbol, max(cd) AS metric_date, max(cr) AS cr, max(now) AS now,
                      count(*) FILTER ({ok}) AS observation_count, count(*) - count(*) FILTER ({ok}) AS invalid_observation_count,
                      count(*) FILTER ({ok} AND {col} <= now) AS below
                    FROM rw r JOIN (SELECT a.symbol, max(a.metric_date) AS cd, count(*) AS cr, max(a.{col}) AS now FROM rw a
                          JOIN lastd l ON l.symbol = a.symbol AND l.cd = a.metric_date GROUP BY a.symbol) n ON n.symbol = r.symbol
                    GROUP BY r.symbol))"""


METRIC = {
    **VALS,
    "rw": f"""SELECT * FROM vals WHERE metric_date BETWEEN ({CUTOFF} - INTERVAL {YEARS} YEAR)::DATE AND {CUTOFF}::DATE""",
    "lastd": "SELECT symbol, max(metric_date) AS cd FROM rw GROUP BY symbol",
    "metric": " UNION ALL ".join(_component_sql(n) for n in sn.METRICS),
}


def _metric(spark, sf_dir, symbols=None):
    return sn.metric_percentile(_valuations(spark, sf_dir), d.CUTOFF, YEARS, MINIMUM, THRESHOLDS, symbols)


@query(
    "metric_percentile",
    with_views(
        "valuations",
        extra=METRIC,
        body="""SELECT symbol, metric_date::VARCHAR AS metric_date, component, status, reason, round(value, 6) AS value,
            observation_count, invalid_observation_count, round(percentile, 6) AS percentile, passed FROM metric""",
    ),
)
def q_metric(spark, sf_dir):
    return _metric(spark, sf_dir).withColumns({"value": F.round("value", 6), "percentile": F.round("percentile", 6)})


@query(
    "metric_percentile_asked",
    f"""WITH m AS ({ORACLES["metric_percentile"]})
        SELECT * FROM m UNION ALL
        SELECT symbol, NULL, component, 'insufficient_data', 'no_valuation_history', NULL, 0, 0, NULL, false
        FROM ({ASKED}) CROSS JOIN (SELECT unnest({_list(sn.METRICS)}) AS component) WHERE symbol NOT IN (SELECT symbol FROM m)""",
)
def q_metric_asked(spark, sf_dir):
    rows = _metric(spark, sf_dir, d.asked_symbols(spark, sf_dir))
    return rows.withColumns({"value": F.round("value", 6), "percentile": F.round("percentile", 6)})


TECH = {
    "tb": """SELECT symbol, date, close, CASE WHEN count(close) OVER w = 21 THEN avg(close) OVER w END AS sma,
        row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars
        WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""",
    "tech": """SELECT symbol, substr(symbol, 2)::BIGINT AS k, CASE WHEN k % 11 = 0 THEN 'insufficient_data' ELSE 'available' END AS status,
        CASE WHEN k % 13 = 0 THEN 'other' ELSE 'annual_line' END AS component_name, coalesce(close > sma, false) AS turned_positive,
        CASE WHEN k % 19 = 0 THEN 'X' ELSE 'R' END || k AS rule_id, CASE WHEN k % 4 = 0 THEN '1.1' END AS rule_version,
        CASE WHEN k % 5 = 1 THEN 'A' END AS evidence_level, CASE WHEN k % 6 = 2 THEN 'verified_core' END AS implementation_mode,
        CASE WHEN k % 5 = 2 THEN false END AS project_operationalization FROM tb WHERE rn = 1""",
    "tg": """SELECT t.symbol, turned_positive, CASE WHEN t.status <> 'available' THEN 'technical_confirmation_required'
        WHEN component_name <> 'annual_line' THEN 'technical_component_mismatch'
        WHEN r.rule_id IS NULL THEN 'unknown_technical_rule'
        WHEN r.evidence_level = 'U' OR r.implementation_mode IN ('legacy_experimental', 'unsupported') THEN 'legacy_or_unsupported_technical_component'
        WHEN NOT list_contains(allowed_outputs, 'trend_confirmation') THEN 'rule_not_allowed_for_technical_confirmation'
        WHEN list_contains(forbidden_uses, 'trend_confirmation') OR human_approval_required THEN 'technical_rule_not_available_for_confirmation'
        WHEN t.rule_version <> r.rule_version OR t.evidence_level <> r.evidence_level OR t.implementation_mode <> r.implementation_mode
            OR t.project_operationalization <> r.project_operationalization THEN 'technical_rule_metadata_mismatch' END AS reason,
        list_contains(forbidden_uses, 'trend_confirmation') AS never
        FROM tech t LEFT JOIN rules r ON r.rule_id = t.rule_id""",
    "techc": """SELECT symbol, 'technical_turn' AS component, CASE WHEN reason IS NULL THEN 'available'
        WHEN reason IN ('unknown_technical_rule', 'legacy_or_unsupported_technical_component', 'rule_not_allowed_for_technical_confirmation')
        THEN 'unsupported' WHEN reason = 'technical_rule_not_available_for_confirmation' THEN CASE WHEN never THEN 'forbidden' ELSE 'needs_human_input' END
        ELSE 'insufficient_data' END AS status, reason, reason IS NULL AND turned_positive AS passed FROM tg""",
}


def _technical(spark, sf_dir):
    w = ind.by_symbol()
    k = d.symbol_number()
    b = d.bars(spark, sf_dir).select("symbol", "date", "close")
    b = ind.rolling_means(b, "close", {"sma": 21}, w)
    last = ind.latest_row(b)
    results = last.select(
        "symbol",
        F.when(k % 11 == 0, "insufficient_data").otherwise("available").alias("status"),
        F.when(k % 13 == 0, "other").otherwise("annual_line").alias("component_name"),
        F.coalesce(F.col("close") > F.col("sma"), F.lit(False)).alias("turned_positive"),
        F.concat(F.when(k % 19 == 0, "X").otherwise("R"), k.cast("string")).alias("rule_id"),
        F.when(k % 4 == 0, "1.1").alias("rule_version"),
        F.when(k % 5 == 1, "A").alias("evidence_level"),
        F.when(k % 6 == 2, "verified_core").alias("implementation_mode"),
        F.when(k % 5 == 2, F.lit(False)).alias("project_operationalization"),
    )
    return sn.technical_component(results, d.rules(spark, sf_dir), "annual_line")


@query(
    "technical_component_gate",
    with_views("bars", "rules", extra=TECH, body="SELECT symbol, component, status, reason, passed FROM techc"),
)
def q_technical(spark, sf_dir):
    return _technical(spark, sf_dir)


GROWTH = {
    **STATES,
    "gy": """SELECT symbol, fiscal_year, count(*) AS n, max(eps_base) AS e FROM states
        WHERE status = 'active' AND eligible GROUP BY ALL""",
    "gz": """SELECT *, lead(fiscal_year) OVER w AS ey, lead(n) OVER w AS en, lead(e) OVER w AS ee, row_number() OVER w AS rn
        FROM gy WINDOW w AS (PARTITION BY symbol ORDER BY fiscal_year DESC)""",
    "growth": """SELECT 'S' || substr(symbol, 2) AS symbol, 'forward_eps_growth' AS component,
        CASE WHEN reason IS NULL THEN 'available' ELSE 'insufficient_data' END AS status, reason,
        coalesce(reason IS NULL AND (e - ee) / ee >= 0, false) AS passed
        FROM (SELECT *, CASE WHEN ey IS NULL THEN 'forward_eps_growth_requires_two_years'
            WHEN n <> 1 OR en <> 1 THEN 'forward_eps_source_selection_ambiguous'
            WHEN fiscal_year <> ey + 1 THEN 'forward_eps_growth_requires_consecutive_years'
            WHEN ee <= 0 THEN 'non_comparable_forward_eps' END AS reason FROM gz WHERE rn = 1)""",
}


@query(
    "screen_decision",
    with_views(
        "valuations",
        "bars",
        "eps",
        "approvals",
        "rules",
        extra={
            **METRIC,
            **TECH,
            **GROWTH,
            "comp": """SELECT symbol, component, status, reason, passed FROM metric UNION ALL SELECT * FROM techc
                UNION ALL SELECT g.* FROM growth g WHERE symbol IN (SELECT 'S' || s_suppkey FROM supplier)""",
            "names": "SELECT unnest(['dividend_yield', 'forward_eps_growth', 'pb', 'pe', 'technical_turn']) AS name",
            "sy": "SELECT DISTINCT symbol FROM comp",
            "miss": """SELECT sy.symbol, count(*) AS nm, string_agg(name, ',' ORDER BY name) AS names FROM sy CROSS JOIN names
                ANTI JOIN comp c ON c.symbol = sy.symbol AND c.component = name
                  AND c.status NOT IN ('insufficient_data', 'needs_human_input', 'unsupported') GROUP BY 1""",
            "allp": "SELECT symbol, bool_and(passed) AS ok, max(reason) FILTER (component = 'technical_turn') AS tr FROM comp GROUP BY 1",
        },
        body="""SELECT a.symbol, CASE WHEN nm > 0 THEN 'insufficient_data' ELSE 'available' END AS status,
            CASE WHEN names = 'technical_turn' THEN coalesce(tr, 'technical_confirmation_required')
                 WHEN nm > 0 THEN 'required_screening_components_missing' END AS reason,
            CASE WHEN nm IS NULL THEN CASE WHEN ok THEN 'meets_approved_profile' ELSE 'does_not_meet_approved_profile' END END AS research_result,
            coalesce(names, '') AS missing_components FROM allp a LEFT JOIN miss m ON m.symbol = a.symbol""",
    ),
)
def q_decision(spark, sf_dir):
    growth = val.eps_growth(approved_eps(spark, sf_dir), ("symbol",)).select(
        F.concat(F.lit("S"), F.substring("symbol", 2, 20)).alias("symbol"),
        F.lit("forward_eps_growth").alias("component"),
        "status",
        "reason",
        "passed",
    )
    known = d.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"))
    growth = growth.join(known, "symbol", "left_semi")
    cols = ["symbol", "component", "status", "reason", "passed"]
    parts = _metric(spark, sf_dir).select(*cols).unionByName(_technical(spark, sf_dir)).unionByName(growth)
    return sn.screen_decision(parts, ("pe", "pb", "dividend_yield", "forward_eps_growth", "technical_turn"))


@query(
    "rule_use_status",
    with_views(
        "rules",
        extra={
            "req": """SELECT o_orderkey AS request_id, 'R' || o_orderkey % 2500 AS rule_id, CASE o_custkey % 3 WHEN 0 THEN 'automatic_order'
                WHEN 1 THEN 'trend_confirmation' ELSE 'price_scenario' END AS usage,
                CASE WHEN o_orderstatus = 'F' THEN 'A' || o_orderkey END AS approval_id FROM orders""",
        },
        body="""SELECT request_id, q.rule_id, usage, approval_id, CASE WHEN implementation_mode IS NULL THEN 'unknown_rule' WHEN list_contains(forbidden_uses, usage) THEN 'forbidden'
            WHEN implementation_mode = 'unsupported' THEN 'unsupported'
            WHEN human_approval_required AND approval_id IS NULL THEN 'needs_human_input' ELSE 'available' END AS use_status
            FROM req q LEFT JOIN rules r ON r.rule_id = q.rule_id""",
    ),
)
def q_rule_use(spark, sf_dir):
    requests = d.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("R"), (F.col("o_orderkey") % 2500).cast("string")).alias("rule_id"),
        F.when(F.col("o_custkey") % 3 == 0, "automatic_order")
        .when(F.col("o_custkey") % 3 == 1, "trend_confirmation")
        .otherwise("price_scenario")
        .alias("usage"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("A"), F.col("o_orderkey").cast("string"))).alias("approval_id"),
    )
    return sn.rule_use_status(requests, d.rules(spark, sf_dir))


@query(
    "dimension_defects",
    """SELECT p_name, count(*) AS rows, bool_or(p_size % 10 = 0) AS lacks_required FROM part
       GROUP BY p_name HAVING count(*) > 1 OR bool_or(p_size % 10 = 0)""",
)
def q_dimension(spark, sf_dir):
    p = d.table(spark, sf_dir, "part").select("p_name", F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("size"))
    return dimension_defects(p, "p_name", ("size",))


@query(
    "profile_select",
    """WITH p AS (SELECT 'PR' || c_custkey AS id, 'C' || (c_custkey - c_custkey % 3) AS scope_value,
            CASE WHEN c_custkey % 4 <> 0 THEN 'available' ELSE 'revoked' END AS status,
            CASE WHEN c_custkey % 5 = 0 THEN 'revoked' ELSE 'approved' END AS decision FROM customer),
        own AS (SELECT scope_value AS symbol, count(*) AS n, min(id) AS pid FROM p WHERE status = 'available' AND decision = 'approved' GROUP BY 1),
        s AS (SELECT 'C' || c_custkey AS symbol FROM customer)
       SELECT symbol, CASE WHEN coalesce(n, 0) = 1 THEN 'available' ELSE 'needs_human_input' END AS status,
           CASE WHEN coalesce(n, 0) = 0 THEN 'approved_screening_profile_required'
                WHEN n > 1 THEN 'screening_profile_selection_required' END AS reason,
           coalesce(n, 0) AS applicable, CASE WHEN n = 1 THEN pid END AS profile_id FROM s LEFT JOIN own USING (symbol)""",
)
def q_profile(spark, sf_dir):
    c = d.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    profiles = c.select(
        F.concat(F.lit("PR"), k.cast("string")).alias("id"),
        F.lit("symbol").alias("scope"),
        F.concat(F.lit("C"), (k - k % 3).cast("string")).alias("scope_value"),
        F.when(k % 4 != 0, "available").otherwise("revoked").alias("status"),
        F.when(k % 5 == 0, "revoked").otherwise("approved").alias("decision"),
        F.lit("SEL-01").alias("rule_id"),
        F.lit("C").alias("evidence_level"),
        F.lit(1).alias("project_operationalization"),
    )
    symbols = c.select(F.concat(F.lit("C"), k.cast("string")).alias("symbol"))
    return sn.profile_select(symbols, profiles, "SEL-01")


PAIRS = {
    **pivots_cte("bars"),
    "seq": """SELECT symbol, pivot_idx, pivot_type, pivot_price AS c, lag(pivot_price) OVER w AS b, lag(pivot_price, 2) OVER w AS a
        FROM pivots WINDOW w AS (PARTITION BY symbol ORDER BY pivot_idx, pivot_type)""",
}


def _triples(spark, sf_dir):
    from pyspark.sql import Window

    p = ind.confirmed_pivots(d.bars(spark, sf_dir))
    w = Window.partitionBy("symbol").orderBy("pivot_idx", "pivot_type")
    return p.select(
        "symbol",
        "pivot_idx",
        "pivot_type",
        F.col("pivot_price").alias("c"),
        F.lag("pivot_price").over(w).alias("b"),
        F.lag("pivot_price", 2).over(w).alias("a"),
    ).where(F.col("a").isNotNull())


@query(
    "equal_amplitude_levels",
    with_views(
        "bars",
        extra={
            **PAIRS,
            "r": """SELECT *, CASE WHEN a <= 0 OR b <= 0 OR c <= 0 THEN 'anchor_price_invalid' WHEN b = a THEN 'zero_move'
                WHEN c + b - a <= 0 THEN 'level_not_positive' END AS reason FROM seq WHERE a IS NOT NULL""",
        },
        body="""SELECT symbol, pivot_idx, pivot_type, a, b, c, reason,
            CASE WHEN reason IS NULL THEN CASE WHEN b > a THEN 'upward' ELSE 'downward' END END AS direction,
            CASE WHEN reason IS NULL THEN b - a END AS swing_amplitude,
            CASE WHEN reason IS NULL THEN c + b - a END AS calculated_level FROM r""",
    ),
)
def q_equal_amplitude(spark, sf_dir):
    return sc.equal_amplitude(_triples(spark, sf_dir))


@query(
    "retracement_levels",
    with_views(
        "bars",
        extra={
            **PAIRS,
            "r": """SELECT *, CASE WHEN a <= 0 OR b <= 0 THEN 'anchor_price_invalid' WHEN b <= a THEN 'not_an_upward_swing' END AS reason
                FROM seq WHERE a IS NOT NULL""",
        },
        body="""SELECT symbol, pivot_idx, pivot_type, a, b, reason, CASE WHEN reason IS NULL THEN b - a END AS swing_amplitude,
            CASE WHEN reason IS NULL THEN round(b::DECIMAL(18,6) - 0.382::DECIMAL(4,3) * (b - a)::DECIMAL(18,6), 4)::DOUBLE END AS calculated_level
            FROM r""",
    ),
)
def q_retracement(spark, sf_dir):
    return sc.retracement_0382(_triples(spark, sf_dir).drop("c"))


@query(
    "scenario_status",
    with_views(
        "eps",
        "approvals",
        extra=STATES,
        body="""SELECT symbol, count(*) FILTER (ok) AS scenario_count, count(*) FILTER (rv) AS revoked_anchor_sets,
            count(*) FILTER (NOT rv AND NOT ok) AS pending_anchor_sets,
            CASE WHEN count(*) FILTER (ok) > 0 THEN 'available' ELSE 'needs_human_input' END AS status,
            CASE WHEN count(*) FILTER (ok) = 0 THEN CASE WHEN count(*) FILTER (rv) > 0 AND count(*) FILTER (NOT rv AND NOT ok) = 0
                THEN 'anchor_approval_revoked' ELSE 'approved_manual_anchor_required' END END AS reason
            FROM (SELECT *, status = 'revoked' OR coalesce(decision = 'revoked', false) AS rv,
                  NOT (status = 'revoked' OR coalesce(decision = 'revoked', false)) AND coalesce(decision = 'approved', false) AS ok FROM states)
            GROUP BY symbol""",
    ),
)
def q_scenario_status(spark, sf_dir):
    states = asof.revision_with_approval(d.eps_ledger(spark, sf_dir), d.approvals(spark, sf_dir), d.CUTOFF)
    return sc.scenario_status(states)


PLANS = """SELECT o_orderkey AS plan_id, 'C' || o_custkey AS symbol, round(o_totalprice * 100)::BIGINT AS cents,
    CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS nt, o_orderkey % 7 = 0 AS shuffled,
    CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'revoked' END AS decision FROM orders"""


def _plans(spark, sf_dir):
    o = d.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    n = F.when(k % 5 == 0, 1).when(k % 5 == 1, 2).otherwise(3)
    stages = F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), n)
    return o.select(
        k.alias("plan_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        (d.cents("o_totalprice").cast("decimal(18,2)") / 100).alias("planned_total_capital"),
        F.when(k % 7 == 0, F.reverse(F.transform(stages, lambda s: s + 1))).otherwise(stages).alias("trigger_stages"),
        n.alias("n_triggers"),
        F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "revoked").alias("decision"),
        F.lit("ENT-02").alias("rule_id"),
        F.lit("available").alias("status"),
    )


@query(
    "tranche_plan",
    with_views(
        extra={
            "p": PLANS,
            "s": "SELECT *, unnest([1, 2, 3]) AS stage, (2 * cents + 3) // 6 AS third FROM p",
        },
        body="""SELECT plan_id, stage::BIGINT AS stage, cents::DOUBLE / 1e2 AS planned_total_capital,
            (CASE WHEN stage = 3 THEN cents - 2 * third ELSE third END)::DOUBLE / 1e2 AS capital_budget,
            (3 - stage)::BIGINT AS remaining_entries, stage <= nt AS has_trigger,
            CASE WHEN NOT shuffled AND nt = 3 AND coalesce(decision = 'approved', false) THEN 'available' ELSE 'needs_human_input' END AS status,
            CASE WHEN shuffled THEN 'triggers_not_ordered' WHEN nt < 3 THEN 'deployment_triggers_required'
                 WHEN NOT coalesce(decision = 'approved', false) THEN 'approved_deployment_plan_required' END AS reason FROM s""",
    ),
)
def q_tranche(spark, sf_dir):
    return sc.tranche_plan(_plans(spark, sf_dir))


@query(
    "plan_status",
    with_views(
        extra={
            "p": PLANS,
            "r": """SELECT symbol, CASE WHEN decision = 'revoked' THEN 2 WHEN nt = 3 AND decision = 'approved' THEN 3
                WHEN nt <> 3 THEN 1 ELSE 0 END AS r FROM p""",
        },
        body="""SELECT symbol, count(*) AS plans, CASE WHEN max(r) = 3 THEN 'available' ELSE 'needs_human_input' END AS status,
            CASE max(r) WHEN 2 THEN 'deployment_plan_approval_revoked' WHEN 1 THEN 'deployment_triggers_required'
                WHEN 0 THEN 'approved_deployment_plan_required' END AS reason FROM r GROUP BY symbol""",
    ),
)
def q_plan_status(spark, sf_dir):
    return sc.plan_status(_plans(spark, sf_dir))


_ST = ["available", "partial", "needs_human_input", "insufficient_data", "not_applicable"]


@query(
    "compose_status",
    f"""WITH s AS (SELECT o_orderkey AS id, [{_list(_ST)}[o_orderkey % 5 + 1], {_list(_ST)}[o_custkey % 5 + 1],
            {_list(_ST)}[(o_orderkey // 5) % 5 + 1]] AS v FROM orders)
        SELECT id, CASE WHEN len(list_filter(v, lambda x: x IN ('available', 'not_applicable'))) = 3 THEN 'available'
            WHEN len(list_filter(v, lambda x: x IN ('available', 'not_applicable', 'partial', 'quality_warning'))) > 0 THEN 'partial'
            WHEN list_contains(v, 'needs_human_input') THEN 'needs_human_input' ELSE 'insufficient_data' END AS status FROM s""",
)
def q_compose(spark, sf_dir):
    st = F.array(*[F.lit(x) for x in _ST])
    o = d.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.get(st, (F.col("o_orderkey") % 5).cast("int")).alias("valuation"),
        F.get(st, (F.col("o_custkey") % 5).cast("int")).alias("liquidity"),
        F.get(st, F.expr("cast((o_orderkey div 5) % 5 as int)")).alias("screening"),
    )
    return o.select("id", sc.compose_status("valuation", "liquidity", "screening").alias("status"))
