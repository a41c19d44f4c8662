"""Queries over bitemporal ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, valuation as val
from tidemark.plans import domain as d
from tidemark.plans.domain_sql import CUTOFF, exact, half_up, with_views
from tidemark.plans.registry import query

VIS = f"available_at <= {CUTOFF} AND ingested_at <= {CUTOFF}"
REV = {
    "rev": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY revision_number DESC,
        available_at DESC, ingested_at DESC, id DESC) AS rn FROM eps WHERE {VIS}) WHERE rn = 1""",
}
APP = {
    "app": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY available_at DESC,
        ingested_at DESC, approval_event_id DESC) AS rn FROM approvals WHERE {VIS}) WHERE rn = 1""",
}
STATES = {
    **REV,
    **APP,
    "states": """SELECT r.*, a.approval_event_id, a.decision, a.rule_id, a.evidence_level, a.project_operationalization,
        coalesce(a.decision = 'approved' AND a.rule_id = 'VAL-02' AND a.evidence_level <> 'U'
                 AND (a.evidence_level <> 'C' OR a.project_operationalization = 1), false) AS eligible
        FROM rev r LEFT JOIN app a ON a.resource_id = r.id""",
}
PE_LEDGER = {
    "pe_n": "SELECT *, CASE WHEN scope = 'symbol' THEN substr(scope_value, 2)::BIGINT ELSE length(scope_value) END AS n, unnest([1, 2, 3]) AS r FROM pe",
    "pe_revisions": """SELECT pe_id || '@' || r AS id, pe_id AS logical_id, r AS revision_number, label, scope, scope_value, pe_value + r - 1 AS pe_value,
        effective_from, effective_to, (effective_from::DATE + (r * 40 - 60))::TIMESTAMP AS available_at,
        (effective_from::DATE + (r * 40 - 59))::TIMESTAMP AS ingested_at, n, n + r AS k FROM pe_n WHERE r = 1 OR (r = 2 AND n % 3 = 0) OR (r = 3 AND n % 9 = 0)""",
    "pe_events": "SELECT *, unnest(CASE WHEN k % 13 = 0 THEN [] WHEN k % 7 = 0 THEN [0, 200] ELSE [0] END) AS later FROM pe_revisions",
    "pe_approvals": """SELECT id || '#' || later AS approval_event_id, id AS resource_id, CASE WHEN later > 0 THEN 'revoked' ELSE 'approved' END AS decision,
        CASE WHEN k % 11 = 0 THEN 'VAL-02' ELSE 'VAL-04' END AS rule_id, CASE WHEN k % 4 = 0 THEN 'C' ELSE 'A' END AS evidence_level,
        (k % 8 = 0)::INT AS project_operationalization, (available_at::DATE + (k % 5)::INT + later)::TIMESTAMP AS available_at,
        (available_at::DATE + (k % 5)::INT + later + 1)::TIMESTAMP AS ingested_at FROM pe_events""",
}
PE_EFF = {
    **PE_LEDGER,
    "pe_rev": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY revision_number DESC, available_at DESC, ingested_at DESC, id DESC) AS rn
        FROM pe_revisions WHERE available_at <= {CUTOFF} AND ingested_at <= {CUTOFF}) WHERE rn = 1""",
    "pe_app": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY available_at DESC, ingested_at DESC, approval_event_id DESC) AS rn
        FROM pe_approvals WHERE available_at <= {CUTOFF} AND ingested_at <= {CUTOFF}) WHERE rn = 1""",
    "pe_eff": f"""SELECT r.id AS pe_id, r.* EXCLUDE (id, rn) FROM pe_rev r JOIN pe_app a ON a.resource_id = r.id
        WHERE a.decision = 'approved' AND a.rule_id = 'VAL-04' AND (a.evidence_level <> 'C' OR a.project_operationalization = 1)
          AND (effective_from IS NULL OR effective_from <= {CUTOFF}) AND (effective_to IS NULL OR effective_to > {CUTOFF})""",
}


@query(
    "latest_revision_asof",
    with_views(
        "eps",
        extra=REV,
        body="""SELECT logical_id, id, revision_number::BIGINT AS revision_number, symbol, fiscal_year::BIGINT AS fiscal_year,
            status, eps_base, strftime(available_at, '%Y-%m-%d %H:%M:%S.%f') AS available_at FROM rev""",
    ),
)
def q_latest_revision(spark, sf_dir):
    out = asof.latest_revision_asof(d.eps_ledger(spark, sf_dir), d.CUTOFF)
    return out.select(
        "logical_id", "id", "revision_number", "symbol", "fiscal_year", "status", "eps_base", "available_at"
    )


MANY = ("1996-12-31", "1998-06-30", "1999-06-30", "2000-12-31")


@query(
    "latest_revision_many_cutoffs",
    with_views(
        "eps",
        extra={
            "cuts": "SELECT unnest([" + ", ".join(f"TIMESTAMP '{c}'" for c in MANY) + "]) AS cutoff",
            "r": """SELECT e.*, cutoff, row_number() OVER (PARTITION BY cutoff, logical_id ORDER BY revision_number DESC,
                available_at DESC, ingested_at DESC, id DESC) AS rn
                FROM eps e JOIN cuts ON e.available_at <= cutoff AND e.ingested_at <= cutoff""",
        },
        body="""SELECT strftime(cutoff, '%Y-%m-%d %H:%M:%S.%f') AS cutoff, logical_id, id,
            revision_number::BIGINT AS revision_number, status FROM r WHERE rn = 1""",
    ),
)
def q_latest_revision_many(spark, sf_dir):
    out = asof.latest_revision_at_cutoffs(d.eps_ledger(spark, sf_dir), MANY)
    return out.select("cutoff", "logical_id", "id", "revision_number", "status")


@query(
    "latest_approval_asof",
    with_views(
        "approvals",
        extra=APP,
        body="""SELECT resource_id, approval_event_id, decision, rule_id, evidence_level,
            project_operationalization::BIGINT AS project_operationalization FROM app""",
    ),
)
def q_latest_approval(spark, sf_dir):
    return asof.latest_approval_asof(d.approvals(spark, sf_dir), d.CUTOFF).drop("available_at", "ingested_at")


@query(
    "revision_with_approval",
    with_views(
        "eps",
        "approvals",
        extra=STATES,
        body="""SELECT logical_id, id, status, decision, rule_id, evidence_level, eligible,
            coalesce(decision, 'draft') AS effective_approval_status FROM states""",
    ),
)
def q_revision_with_approval(spark, sf_dir):
    out = asof.revision_with_approval(d.eps_ledger(spark, sf_dir), d.approvals(spark, sf_dir), d.CUTOFF)
    return out.select(
        "logical_id",
        "id",
        "status",
        "decision",
        "rule_id",
        "evidence_level",
        asof.approval_eligible("VAL-02").alias("eligible"),
        F.coalesce("decision", F.lit("draft")).alias("effective_approval_status"),
    )


@query(
    "pe_effective_scoped",
    with_views(
        "pe",
        "symbols",
        extra=PE_EFF,
        body="""SELECT s.symbol, pe_id, label, scope, pe_value,
            CASE scope WHEN 'symbol' THEN 1 WHEN 'industry' THEN 2 ELSE 3 END::BIGINT AS scope_rank
            FROM symbols s JOIN pe_eff p ON (scope = 'symbol' AND scope_value = s.symbol)
              OR (scope = 'industry' AND scope_value = s.industry) OR (scope = 'market' AND scope_value = s.market)""",
    ),
)
def q_pe_scoped(spark, sf_dir):
    out = val.scope_dispatch(d.symbols(spark, sf_dir), _pe_effective(spark, sf_dir))
    return out.select("symbol", "pe_id", "label", "scope", "pe_value", "scope_rank")


def _states(spark, sf_dir):
    return asof.revision_with_approval(d.eps_ledger(spark, sf_dir), d.approvals(spark, sf_dir), d.CUTOFF)


def approved_eps(spark, sf_dir):
    return _states(spark, sf_dir).where((F.col("status") == "active") & asof.approval_eligible("VAL-02"))


def symbol_pe(spark, sf_dir):
    return _pe_effective(spark, sf_dir).where("scope = 'symbol'").withColumnRenamed("scope_value", "symbol")


def _pe_effective(spark, sf_dir):
    return val.pe_effective(d.pe_revisions(spark, sf_dir), d.pe_approvals(spark, sf_dir), d.CUTOFF)


@query(
    "eps_pe_matrix",
    with_views(
        "eps",
        "approvals",
        "pe",
        extra={
            **STATES,
            **PE_EFF,
            "long": """SELECT symbol, id, fiscal_year, unnest(['low', 'base', 'high']) AS eps_scenario,
                unnest([eps_low, eps_base, eps_high]) AS eps_value FROM states WHERE status = 'active' AND eligible""",
        },
        body="""SELECT l.symbol, l.id, l.fiscal_year::BIGINT AS fiscal_year, eps_scenario, eps_value, pe_id, label, pe_value,
            CASE WHEN eps_value > 0 THEN 'available' ELSE 'not_applicable' END AS status,
            CASE WHEN eps_value > 0 THEN """ + half_up(exact('eps_value') + ' * ' + exact('pe_value', 4, 11), 4) + """ END AS target_price
            FROM long l JOIN pe_eff p ON p.scope = 'symbol' AND p.scope_value = l.symbol""",
    ),
)
def q_eps_pe_matrix(spark, sf_dir):
    return val.eps_pe_matrix(approved_eps(spark, sf_dir), symbol_pe(spark, sf_dir))


@query(
    "eps_pe_status",
    with_views(
        "eps",
        "approvals",
        "pe",
        extra={
            **STATES,
            **PE_EFF,
            "g": """SELECT symbol, count(*) FILTER (eligible AND status = 'active') AS approved,
                bool_and(status = 'revoked' OR coalesce(decision = 'revoked', false)) AS all_revoked,
                max(eps_high) FILTER (eligible AND status = 'active') AS best FROM states GROUP BY symbol""",
            "h": "SELECT scope_value AS symbol, count(*) AS n FROM pe_eff WHERE scope = 'symbol' GROUP BY 1",
            "x": """SELECT symbol, approved, CASE WHEN approved = 0 AND all_revoked THEN 'forward_eps_approval_revoked'
                WHEN approved = 0 THEN 'approved_forward_eps_required'
                WHEN n IS NULL THEN 'approved_symbol_pe_missing_at_knowledge_cutoff'
                WHEN best <= 0 THEN 'forward_eps_is_zero_or_negative' END AS reason FROM g LEFT JOIN h USING (symbol)""",
        },
        body="""SELECT symbol, approved, CASE WHEN reason IS NULL THEN 'available'
            WHEN reason = 'forward_eps_approval_revoked' THEN 'insufficient_data'
            WHEN reason = 'forward_eps_is_zero_or_negative' THEN 'not_applicable'
            ELSE 'needs_human_input' END AS status, reason FROM x""",
    ),
)
def q_eps_pe_status(spark, sf_dir):
    return val.eps_pe_status(_states(spark, sf_dir), symbol_pe(spark, sf_dir))


@query(
    "eps_growth",
    with_views(
        "eps",
        "approvals",
        extra={
            **STATES,
            "y": """SELECT symbol, source_name, fiscal_year, count(*) AS n, max(eps_base) AS e FROM states
                WHERE status = 'active' AND eligible GROUP BY ALL""",
            "z": """SELECT *, lead(fiscal_year) OVER w AS ey, lead(n) OVER w AS en, lead(e) OVER w AS ee,
                row_number() OVER w AS rn FROM y
                WINDOW w AS (PARTITION BY symbol, source_name ORDER BY fiscal_year DESC)""",
            "q": """SELECT *, CASE WHEN ey IS NULL THEN 'forward_eps_growth_requires_two_years'
                WHEN n <> 1 OR en <> 1 THEN 'forward_eps_source_selection_ambiguous'
                WHEN fiscal_year <> ey + 1 THEN 'forward_eps_growth_requires_consecutive_years'
                WHEN ee <= 0 THEN 'non_comparable_forward_eps' END AS reason FROM z WHERE rn = 1""",
        },
        body="""SELECT symbol, source_name, CASE WHEN reason IS NULL THEN 'available' ELSE 'insufficient_data' END AS status,
            reason, ey::BIGINT AS earlier_fiscal_year,
            CASE WHEN ey IS NOT NULL THEN fiscal_year::BIGINT END AS later_fiscal_year,
            CASE WHEN reason IS NULL THEN round((e - ee) / ee, 6) END AS growth_ratio,
            coalesce(reason IS NULL AND (e - ee) / ee >= 0, false) AS passed FROM q""",
    ),
)
def q_eps_growth(spark, sf_dir):
    out = val.eps_growth(approved_eps(spark, sf_dir))
    return out.withColumn("growth_ratio", F.round("growth_ratio", 6))


@query(
    "revision_chain_check",
    with_views(
        "eps",
        "approvals",
        extra={
            "c": """SELECT id, id // 4 AS logical_id, id % 4 + 1 AS revision_number, ingested_at,
                CASE WHEN id % 4 > 0 THEN CASE WHEN id % 37 = 0 THEN id - 2 WHEN id % 53 = 0 THEN -1 ELSE id - 1 END
                     WHEN id % 59 = 0 THEN id - 1 END AS revision_of,
                CASE WHEN id % 41 = 0 THEN 'T' ELSE 'S' END AS source FROM eps""",
            "p": "SELECT id AS pid, logical_id AS pl, revision_number AS pn, source AS ps FROM c",
            "a": "SELECT resource_id AS id, min(available_at) AS fa FROM approvals GROUP BY 1",
            "x": """SELECT c.id, c.logical_id, revision_number, concat_ws(',',
                CASE WHEN revision_number = 1 AND revision_of IS NOT NULL THEN 'first_revision_has_parent' END,
                CASE WHEN revision_number <> 1 AND revision_of IS NULL THEN 'parent_missing' END,
                CASE WHEN revision_of IS NOT NULL AND pl IS NULL THEN 'parent_unknown' END,
                CASE WHEN pl <> logical_id THEN 'parent_of_other_series' END,
                CASE WHEN pn + 1 <> revision_number THEN 'revision_number_not_consecutive' END,
                CASE WHEN pl IS NOT NULL AND ps <> source THEN 'identity_changed' END,
                CASE WHEN fa < ingested_at THEN 'approval_back_dated' END) AS reasons
                FROM c LEFT JOIN p ON pid = revision_of LEFT JOIN a ON a.id = c.id""",
        },
        body="SELECT id, logical_id, revision_number, reasons FROM x WHERE reasons <> ''",
    ),
)
def q_chain_check(spark, sf_dir):
    i = F.col("id")
    parent = (
        F.when((i % 4 > 0) & (i % 37 == 0), i - 2)
        .when((i % 4 > 0) & (i % 53 == 0), F.lit(-1))
        .when(i % 4 > 0, i - 1)
        .when(i % 59 == 0, i - 1)
    )
    ledger = d.eps_ledger(spark, sf_dir).select(
        "id",
        F.expr("id div 4").alias("logical_id"),
        (i % 4 + 1).alias("revision_number"),
        "ingested_at",
        parent.alias("revision_of"),
        F.when(i % 41 == 0, "T").otherwise("S").alias("source"),
    )
    return val.revision_chain_check(ledger, ("source",), d.approvals(spark, sf_dir))


@query(
    "approved_effective_eps",
    with_views(
        "eps",
        "approvals",
        extra=STATES,
        body="""SELECT logical_id, id, symbol, fiscal_year::BIGINT AS fiscal_year, eps_base, approval_event_id
            FROM states WHERE status = 'active' AND eligible""",
    ),
)
def q_approved_effective(spark, sf_dir):
    return approved_eps(spark, sf_dir).select(
        "logical_id", "id", "symbol", "fiscal_year", "eps_base", "approval_event_id"
    )


@query(
    "pe_bands",
    with_views(
        "eps",
        body="""SELECT id, round(eps_base - 2e1, 6) AS eps, CASE WHEN eps_base - 2e1 > 0 THEN 'available' ELSE 'not_applicable' END AS status,
            CASE WHEN eps_base - 2e1 > 0 THEN """ + half_up(exact('eps_base - 2e1') + ' * ' + exact('1e1', 4, 11), 2) + """ END AS cheap_price,
            CASE WHEN eps_base - 2e1 > 0 THEN """ + half_up(exact('eps_base - 2e1') + ' * ' + exact('2e1', 4, 11), 2) + """ END AS fair_price,
            CASE WHEN eps_base - 2e1 > 0 THEN """ + half_up(exact('eps_base - 2e1') + ' * ' + exact('25e0', 4, 11), 2) + """ END AS expensive_price FROM eps""",
    ),
)
def q_pe_bands(spark, sf_dir):
    rows = d.eps_ledger(spark, sf_dir).select("id", (F.col("eps_base") - 20.0).alias("eps"))
    return val.pe_bands(rows).withColumn("eps", F.round("eps", 6))


@query(
    "eps_dual_track",
    with_views(
        "eps",
        body="""SELECT id, round(coalesce(CASE WHEN id % 3 = 0 AND eps_base > 0 THEN eps_base END,
            CASE WHEN eps_low - 1e1 > 0 THEN (eps_low - 1e1) * 1.1e0 END, 0e0), 6) AS future_eps FROM eps""",
    ),
)
def q_eps_dual(spark, sf_dir):
    inst = F.when(F.col("id") % 3 == 0, F.col("eps_base"))
    return d.eps_ledger(spark, sf_dir).select(
        "id", F.round(val.eps_dual_track(inst, F.col("eps_low") - 10.0), 6).alias("future_eps")
    )


@query(
    "eva_floor",
    f"""WITH x AS (SELECT o_orderkey AS id, (round(o_totalprice * 100)::BIGINT * 1000)::DOUBLE AS nopat,
           (o_custkey % 500)::DOUBLE AS invested_capital, (o_orderkey % 4)::DOUBLE AS shares FROM orders),
       e AS (SELECT *, {half_up(exact('nopat', 8, 22) + ' - ' + exact('invested_capital', 4, 22) + ' * ' + exact('7e-2', 6, 5), 2)} AS eva FROM x),
       f AS (SELECT *, 100::HUGEINT * (invested_capital::HUGEINT * 10000 * 70000 + round(eva * 100)::HUGEINT * 100000000) AS above,
           70000::HUGEINT * shares::HUGEINT * 10000 AS below FROM e)
       SELECT id, CASE WHEN shares > 0 THEN 'available' ELSE 'not_applicable' END AS status,
           CASE WHEN shares > 0 THEN eva END AS eva,
           CASE WHEN shares > 0 THEN (CASE WHEN above < 0 THEN -1 ELSE 1 END * ((2 * abs(above) + below) // (2 * below)))::DOUBLE / 100 END AS eva_floor_price FROM f""",
)
def q_eva_floor(spark, sf_dir):
    rows = d.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (d.cents("o_totalprice") * 1000).cast("double").alias("nopat"),  # up to 5e10
        (F.col("o_custkey") % 500).cast("double").alias("invested_capital"),
        (F.col("o_orderkey") % 4).cast("double").alias("shares"),
    )
    return val.eva_floor(rows).select("id", "status", "eva", "eva_floor_price")


@query(
    "valuation_beyond_limits",
    """WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 2e14 WHEN o_orderkey % 3 = 1 THEN 5e-1 END AS eps FROM orders)
       SELECT id, eps, CASE WHEN eps > 1e14 THEN 'value_out_of_range' WHEN eps > 0 THEN 'available' ELSE 'not_applicable' END AS status,
           CASE WHEN eps < 1 THEN 5e0 END AS cheap_price, CASE WHEN eps < 1 THEN 10e0 END AS fair_price, CASE WHEN eps < 1 THEN 125e-1 END AS expensive_price FROM x""",
)
def q_beyond_limits(spark, sf_dir):
    """Values that exact decimals cannot hold have a status, no price and no silent null."""
    eps = F.when(F.col("o_orderkey") % 3 == 0, 2e14).when(F.col("o_orderkey") % 3 == 1, 0.5)
    return val.pe_bands(d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), eps.alias("eps")))


@query(
    "fixed_threshold_screen",
    with_views(
        "valuations",
        body="""SELECT symbol, metric_date::VARCHAR AS metric_date, coalesce(pe < 15, false) AS pe_below_avg,
            coalesce(pb < 1.5e0, false) AS pb_below_max, coalesce(dividend_yield_ratio >= 4e-2, false) AS yield_above_min,
            coalesce(pe < 15, false) AND coalesce(pb < 1.5e0, false) AND coalesce(dividend_yield_ratio >= 4e-2, false) AS passed
            FROM valuations""",
    ),
)
def q_fixed_screen(spark, sf_dir):
    return val.fixed_threshold_screen(d.valuations(spark, sf_dir)).drop("pe", "pb", "dividend_yield_ratio")
