"""Queries on snapshots: differences, freshness, provider health, paging, canonical text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.canonical import canonical_json, canonical_map, dataset_hash, fingerprint, path_get
from tidemark.functions.numbers import canonical_decimal
from tidemark.operators import asof, diff as df_, freshness as fr, liquidity as lq, scenarios as sc, snapshots as sn, valuation as val
from tidemark.plans import domain as d
from tidemark.plans.domain_sql import CUTOFF, LATER_CUTOFF, cents, with_views
from tidemark.plans.q_ledger import PE_EFF, PE_LEDGER, STATES, _states, symbol_pe
from tidemark.plans.q_screening import PLANS, _plans
from tidemark.plans.registry import query

TS = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
COLS = "pair_id, change_type, section, resource_type, identity, field_path, before, after, absolute_delta"


def _rev_sql(name: str, cutoff: str) -> dict[str, str]:
    return {
        f"{name}r": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY revision_number DESC,
            available_at DESC, ingested_at DESC, id DESC) AS rn FROM eps WHERE available_at <= {cutoff} AND ingested_at <= {cutoff}) WHERE rn = 1""",
        f"{name}a": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY available_at DESC,
            ingested_at DESC, approval_event_id DESC) AS rn FROM approvals WHERE available_at <= {cutoff} AND ingested_at <= {cutoff}) WHERE rn = 1""",
        f"{name}d": f"""SELECT symbol AS pair_id, 'valuation|forward_eps_revision|' || logical_id AS identity,
            '{{"resource_id":"' || id || '","revision_number":"' || revision_number || '"}}' AS rv,
            coalesce(approval_event_id, '') AS ap FROM {name}r LEFT JOIN {name}a ON {name}a.resource_id = {name}r.id""",
    }


def _deps(spark, sf_dir, cutoff):
    s = asof.revision_with_approval(d.eps_ledger(spark, sf_dir), d.approvals(spark, sf_dir), cutoff)
    return s.select(
        F.col("symbol").alias("pair_id"),
        F.lit("valuation").alias("section"),
        F.lit("forward_eps_revision").alias("resource_type"),
        F.col("id").cast("string").alias("resource_id"),
        F.col("logical_id").alias("logical_resource_id"),
        "revision_number",
        F.array_compact(F.array("approval_event_id")).alias("approval_ids"),
    )


@query(
    "dependency_diff",
    with_views(
        "eps",
        "approvals",
        extra={
            **_rev_sql("x", CUTOFF),
            **_rev_sql("y", LATER_CUTOFF),
            "j": """SELECT coalesce(x.pair_id, y.pair_id) AS pair_id, coalesce(x.identity, y.identity) AS identity,
                x.rv AS xr, y.rv AS yr, x.ap AS xa, y.ap AS ya FROM xd x FULL JOIN yd y ON x.pair_id = y.pair_id AND x.identity = y.identity""",
            "u": """SELECT pair_id, identity, 'dependency_added' AS change_type, 'source_resource_versions' AS field_path, xr AS before, yr AS after FROM j WHERE xr IS NULL
                UNION ALL SELECT pair_id, identity, 'dependency_removed', 'source_resource_versions', xr, yr FROM j WHERE yr IS NULL
                UNION ALL SELECT pair_id, identity, 'resource_revision_changed', 'source_resource_versions.revision', xr, yr FROM j WHERE xr <> yr
                UNION ALL SELECT pair_id, identity, 'approval_reference_changed', 'source_resource_versions.approval_ids', xa, ya FROM j WHERE xa <> ya""",
        },
        body="""SELECT pair_id, change_type, 'valuation' AS section, 'forward_eps_revision' AS resource_type, identity, field_path,
            before, after, NULL::VARCHAR AS absolute_delta FROM u""",
    ),
)
def q_dependency_diff(spark, sf_dir):
    return df_.dependency_diff(_deps(spark, sf_dir, d.CUTOFF), _deps(spark, sf_dir, d.LATER_CUTOFF))


MAPS = {
    "mx": f"""SELECT symbol AS pair_id, 'R' || (fiscal_year % 5) AS k, 'v' || max(revision_number) AS v FROM eps
        WHERE available_at <= {CUTOFF} AND ingested_at <= {CUTOFF} GROUP BY ALL""",
    "my": f"""SELECT symbol AS pair_id, 'R' || (fiscal_year % 5) AS k, 'v' || max(revision_number) AS v FROM eps
        WHERE available_at > {CUTOFF} AND available_at <= {LATER_CUTOFF} AND ingested_at <= {LATER_CUTOFF} GROUP BY ALL""",
}


def _rule_maps(rows):
    """Rule-version map per symbol; the keys are five at most."""
    g = rows.groupBy("symbol", F.concat(F.lit("R"), (F.col("fiscal_year") % 5).cast("string")).alias("k")).agg(
        F.concat(F.lit("v"), F.max("revision_number").cast("string")).alias("v")
    )
    return g.groupBy(F.col("symbol").alias("pair_id")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("used_rule_versions")
    )


def _two_maps(spark, sf_dir):
    e = d.eps_ledger(spark, sf_dir)
    cut = F.lit(d.CUTOFF).cast("timestamp")
    first = asof.visible(e, d.CUTOFF)
    second = asof.visible(e, d.LATER_CUTOFF).where(F.col("available_at") > cut)
    return _rule_maps(first), _rule_maps(second)


@query(
    "map_diff",
    with_views(
        "eps",
        extra=MAPS,
        body="""SELECT coalesce(mx.pair_id, my.pair_id) AS pair_id, 'rule_version_reference_changed' AS change_type, 'rules' AS section,
            NULL::VARCHAR AS resource_type, coalesce(mx.k, my.k) AS identity, 'used_rule_versions.' || coalesce(mx.k, my.k) AS field_path,
            mx.v AS before, my.v AS after, NULL::VARCHAR AS absolute_delta
            FROM mx FULL JOIN my ON mx.pair_id = my.pair_id AND mx.k = my.k WHERE mx.v IS DISTINCT FROM my.v""",
    ),
)
def q_map_diff(spark, sf_dir):
    a, b = _two_maps(spark, sf_dir)
    return df_.map_diff(a, b, "used_rule_versions", "rule_version_reference_changed", "rules")


RECORDS = {
    "rx": f"""SELECT symbol AS pair_id, fiscal_year::VARCHAR AS k, '{{"month":"' || revision_number || '"}}' AS text FROM eps
        WHERE available_at <= {CUTOFF}""",
    "ry": f"""SELECT symbol AS pair_id, fiscal_year::VARCHAR AS k, '{{"month":"' || revision_number || '"}}' AS text FROM eps
        WHERE available_at <= {LATER_CUTOFF} AND id % 9 <> 0""",
    "cn": """SELECT pair_id, k, text, sum(l) AS nl, sum(r) AS nr FROM (SELECT *, 1 AS l, 0 AS r FROM rx UNION ALL SELECT *, 0, 1 FROM ry) GROUP BY ALL""",
    "gs": "SELECT *, sum(nl) OVER g = 1 AND sum(nr) OVER g = 1 AS single FROM cn WINDOW g AS (PARTITION BY pair_id, k)",
    "sp": """SELECT pair_id, k AS identity, max(text) FILTER (nl > 0) AS before, max(text) FILTER (nr > 0) AS after FROM gs WHERE single
        GROUP BY pair_id, k HAVING max(text) FILTER (nl > 0) IS DISTINCT FROM max(text) FILTER (nr > 0)""",
    "le": """SELECT pair_id, k || '|exact:' || o AS identity, CASE WHEN nl > 0 THEN text END AS before, CASE WHEN nr > 0 THEN text END AS after
        FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, k ORDER BY text) - 1 AS o FROM gs WHERE NOT single) WHERE nl = 0 OR nr = 0""",
    "ms": """SELECT pair_id, k || '|' || kind || ':' || (row_number() OVER (PARTITION BY pair_id, k, kind ORDER BY text) - 1) AS identity,
        CASE WHEN kind = 'removed' THEN text END AS before, CASE WHEN kind = 'added' THEN text END AS after
        FROM (SELECT pair_id, k, text, CASE WHEN nl > nr THEN 'removed' ELSE 'added' END AS kind, unnest(range(abs(nl - nr)::BIGINT)) AS c
              FROM gs WHERE NOT single AND nl <> nr)""",
}


def _records(spark, sf_dir):
    e = d.eps_ledger(spark, sf_dir)
    text = canonical_json({"month": F.col("revision_number").cast("string")})
    shape = [F.col("symbol").alias("pair_id"), F.col("fiscal_year").cast("string").alias("k"), text.alias("text")]
    cut, later = (F.lit(c).cast("timestamp") for c in (d.CUTOFF, d.LATER_CUTOFF))
    a = e.where(F.col("available_at") <= cut).select(*shape)
    b = e.where((F.col("available_at") <= later) & (F.col("id") % 9 != 0)).select(*shape)
    return a, b


def _record_sql(source: str, change: str) -> str:
    return f"""SELECT pair_id, '{change}' AS change_type, 'valuation' AS section, NULL::VARCHAR AS resource_type, identity,
        'valuation.target_matrix' AS field_path, before, after, NULL::VARCHAR AS absolute_delta
        FROM (SELECT * FROM sp UNION ALL SELECT * FROM {source})"""


@query("record_list_diff", with_views("eps", extra=RECORDS, body=_record_sql("le", "valuation_range_changed")))
def q_record_list(spark, sf_dir):
    a, b = _records(spark, sf_dir)
    return df_.record_list_diff(a, b, "valuation_range_changed", "valuation", "valuation.target_matrix")


@query("multiset_diff", with_views("eps", extra=RECORDS, body=_record_sql("ms", "target_range_changed")))
def q_multiset(spark, sf_dir):
    a, b = _records(spark, sf_dir)
    return df_.multiset_diff(a, b, "target_range_changed", "valuation", "valuation.target_matrix")


CLUSTERS = {
    "cx": "SELECT 'C' || o_custkey AS pair_id, o_orderpriority AS cluster_id, count(*)::VARCHAR AS text FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2",
    "cy": "SELECT 'C' || o_custkey AS pair_id, o_orderpriority AS cluster_id, count(*)::VARCHAR AS text FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1, 2",
}


@query(
    "cluster_diff",
    with_views(
        extra={
            **CLUSTERS,
            "j": """SELECT coalesce(cx.pair_id, cy.pair_id) AS pair_id, coalesce(cx.cluster_id, cy.cluster_id) AS identity, cx.text AS before, cy.text AS after
                FROM cx FULL JOIN cy ON cx.pair_id = cy.pair_id AND cx.cluster_id = cy.cluster_id""",
        },
        body="""SELECT pair_id, CASE WHEN before IS NULL THEN 'confluence_cluster_added' WHEN after IS NULL THEN 'confluence_cluster_removed'
            ELSE 'confluence_cluster_changed' END AS change_type, 'target_confluence' AS section, NULL::VARCHAR AS resource_type, identity,
            'target_confluence.overlap_ranges' AS field_path, before, after, NULL::VARCHAR AS absolute_delta
            FROM j WHERE before IS DISTINCT FROM after""",
    ),
)
def q_cluster_diff(spark, sf_dir):
    o = d.table(spark, sf_dir, "orders").withColumn("pair_id", F.concat(F.lit("C"), F.col("o_custkey").cast("string")))

    def side(gone):
        rows = o.where(F.col("o_orderstatus") != gone)
        return rows.groupBy("pair_id", F.col("o_orderpriority").alias("cluster_id")).agg(
            F.count(F.lit(1)).cast("string").alias("text")
        )

    return df_.cluster_diff(side("F"), side("O"))


# One order is one pair: the order's own fields against those of its document twin.
FIELDS = {
    "fx": f"""SELECT 'P' || o_orderkey AS pair_id, unnest(['liquidity.trade_date', 'liquidity.ratio_pct', 'liquidity.alert_level', 'screening.reason']) AS field_path,
        unnest([true, true, o_orderkey % 6 <> 0, true]) AS present,
        unnest([o_orderdate::DATE::VARCHAR, ({cents('o_totalprice')} % 1000)::VARCHAR, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus END,
            CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END]) AS value FROM orders""",
    "fy": f"""SELECT 'P' || o_orderkey AS pair_id, unnest(['liquidity.trade_date', 'liquidity.ratio_pct', 'liquidity.alert_level', 'screening.reason']) AS field_path,
        unnest([true, true, true, o_orderkey % 8 <> 0]) AS present,
        unnest([o_orderdate::DATE::VARCHAR, ({cents('o_totalprice')} % 997)::VARCHAR, CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END,
            CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END]) AS value FROM orders""",
}


def _snapshot_docs(spark, sf_dir):
    """Two JSON documents per order; absent fields are left out, stored nulls are written."""
    o = d.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    c = d.cents("o_totalprice")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    reason = F.when(k % 4 != 0, F.col("o_orderpriority"))

    def quoted(v):
        return F.when(v.isNull(), "null").otherwise(F.concat(F.lit('"'), v, F.lit('"')))

    def doc(fields):
        liquidity = F.concat_ws(",", *[F.when(p, F.concat(F.lit(f'"{n}":'), quoted(v))) for n, p, v in fields[:3]])
        name, present, v = fields[3]
        screening = F.when(present, F.concat(F.lit(f'"{name}":'), quoted(v))).otherwise("")
        return F.concat(F.lit('{"liquidity":{'), liquidity, F.lit('},"screening":{'), screening, F.lit("}}"))

    yes = F.lit(True)
    a = doc([("trade_date", yes, day), ("ratio_pct", yes, (c % 1000).cast("string")), ("alert_level", k % 6 != 0, F.col("o_orderstatus")), ("reason", yes, reason)])
    b = doc(
        [
            ("trade_date", yes, day),
            ("ratio_pct", yes, (c % 997).cast("string")),
            ("alert_level", yes, F.when(k % 5 == 0, "F").otherwise(F.col("o_orderstatus"))),
            ("reason", k % 8 != 0, reason),
        ]
    )
    pair = F.concat(F.lit("P"), k.cast("string")).alias("pair_id")
    return o.select(pair, a.alias("doc")), o.select(pair, b.alias("doc"))


CHANGE_TYPES = {
    "liquidity.trade_date": "liquidity_context_changed",
    "liquidity.ratio_pct": "liquidity_context_changed",
    "liquidity.alert_level": "liquidity_context_changed",
    "screening.reason": "screening_result_changed",
}


@query(
    "field_diff",
    with_views(
        extra={
            **FIELDS,
            "j": """SELECT fx.pair_id, fx.field_path, fx.value AS before, fy.value AS after FROM fx JOIN fy ON fx.pair_id = fy.pair_id AND fx.field_path = fy.field_path
                WHERE fx.present <> fy.present OR fx.value IS DISTINCT FROM fy.value""",
        },
        body="""SELECT pair_id, CASE WHEN field_path LIKE 'liq%' THEN 'liquidity_context_changed' ELSE 'screening_result_changed' END AS change_type,
            split_part(field_path, '.', 1) AS section, NULL::VARCHAR AS resource_type, split_part(field_path, '.', 1) AS identity, field_path, before, after,
            CASE WHEN field_path = 'liquidity.ratio_pct' THEN (after::BIGINT - before::BIGINT)::VARCHAR END AS absolute_delta FROM j""",
    ),
)
def q_field_diff(spark, sf_dir):
    a, b = _snapshot_docs(spark, sf_dir)
    fields = {p: path_get("doc", p) for p in CHANGE_TYPES}
    return df_.field_diff(
        df_.unpivot_fields(a, fields), df_.unpivot_fields(b, fields), CHANGE_TYPES, ("liquidity.ratio_pct",)
    )


@query(
    "path_get",
    with_views(
        extra=FIELDS,
        body="SELECT pair_id, field_path, present, value FROM fy",
    ),
)
def q_path_get(spark, sf_dir):
    _, b = _snapshot_docs(spark, sf_dir)
    return df_.unpivot_fields(b, {p: path_get("doc", p) for p in CHANGE_TYPES})


PAIRS_SQL = f"""SELECT o_orderkey AS pair_id, 'C' || o_custkey AS b_symbol, 'C' || (CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END) AS c_symbol,
    CASE WHEN o_orderkey % 7 = 0 THEN '1.0' ELSE '2.0' END AS b_model_version, '2.0' AS c_model_version,
    CASE WHEN o_orderkey % 6 = 0 THEN 'live' ELSE 'historical' END AS b_capture_mode, 'historical' AS c_capture_mode,
    o_orderdate AS b_cutoff, o_orderdate + INTERVAL 30 DAY AS c_cutoff, {CUTOFF} AS comparison_cutoff,
    o_orderkey % 11 <> 0 AS b_contract_ok, true AS c_contract_ok FROM orders"""


@query(
    "comparable_gate",
    f"""WITH p AS ({PAIRS_SQL}), r AS (SELECT pair_id, CASE WHEN NOT (b_contract_ok AND c_contract_ok) THEN 'unsupported_comparison_snapshot_contract'
        WHEN b_symbol <> c_symbol THEN 'different_symbol' WHEN b_model_version <> c_model_version THEN 'different_model_version'
        WHEN b_capture_mode <> c_capture_mode THEN 'different_capture_mode'
        WHEN comparison_cutoff < greatest(b_cutoff, c_cutoff) THEN 'comparison_cutoff_precedes_snapshot_cutoff' END AS reason FROM p)
        SELECT pair_id, reason, reason IS NULL AS comparable FROM r""",
)
def q_gate(spark, sf_dir):
    o = d.table(spark, sf_dir, "orders")
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("timestamp")
    pairs = o.select(
        k.alias("pair_id"),
        F.concat(F.lit("C"), cust.cast("string")).alias("b_symbol"),
        F.concat(F.lit("C"), F.when(k % 10 == 0, cust + 1).otherwise(cust).cast("string")).alias("c_symbol"),
        F.when(k % 7 == 0, "1.0").otherwise("2.0").alias("b_model_version"),
        F.lit("2.0").alias("c_model_version"),
        F.when(k % 6 == 0, "live").otherwise("historical").alias("b_capture_mode"),
        F.lit("historical").alias("c_capture_mode"),
        day.alias("b_cutoff"),
        (day + F.make_dt_interval(days=F.lit(30))).alias("c_cutoff"),
        F.lit(d.CUTOFF).cast("timestamp").alias("comparison_cutoff"),
        (k % 11 != 0).alias("b_contract_ok"),
        F.lit(True).alias("c_contract_ok"),
    )
    return df_.comparable_gate(pairs).select("pair_id", "reason", "comparable")


ST = "['current', 'stale', 'unknown', 'blocked']"
CTX = {
    "ux": f"""SELECT 'C' || o_custkey AS pair_id, 'valuation|' || o_orderkey AS identity, 'valuation' AS section, 'eps' AS resource_type,
        {ST}[o_orderkey % 4 + 1] AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'approved' END AS effective_approval_status,
        o_orderkey % 5 = 0 AS candidate_awaiting_review, 'E' || (o_orderkey % 9) AS publication FROM orders WHERE o_orderstatus <> 'F'""",
    "uy": f"""SELECT 'C' || o_custkey AS pair_id, 'valuation|' || o_orderkey AS identity, 'valuation' AS section, 'eps' AS resource_type,
        {ST}[(o_orderkey // 2) % 4 + 1] AS status, CASE WHEN o_orderkey % 6 = 0 THEN 'revoked' WHEN o_orderkey % 3 = 0 THEN 'approved' END AS effective_approval_status,
        o_orderkey % 10 = 0 AS candidate_awaiting_review, 'E' || (o_orderkey % 8) AS publication FROM orders WHERE o_orderstatus <> 'O'""",
    "cj": """SELECT coalesce(x.pair_id, y.pair_id) AS pair_id, coalesce(x.identity, y.identity) AS identity,
        x.status AS xs, y.status AS ys, x.effective_approval_status AS xe, y.effective_approval_status AS ye,
        x.candidate_awaiting_review::VARCHAR AS xc, y.candidate_awaiting_review::VARCHAR AS yc, x.publication AS xp, y.publication AS yp
        FROM ux x FULL JOIN uy y ON x.pair_id = y.pair_id AND x.identity = y.identity""",
    "cu": """SELECT pair_id, identity, CASE ys WHEN 'blocked' THEN 'dependency_blocked' WHEN 'unknown' THEN 'dependency_unknown' ELSE 'freshness_status_changed' END AS change_type,
            'status' AS f, xs AS before, ys AS after FROM cj WHERE xs IS DISTINCT FROM ys
        UNION ALL SELECT pair_id, identity, CASE ye WHEN 'revoked' THEN 'approval_revoked' ELSE 'approval_eligibility_changed' END, 'effective_approval_status', xe, ye FROM cj WHERE xe IS DISTINCT FROM ye
        UNION ALL SELECT pair_id, identity, 'approval_eligibility_changed', 'candidate_awaiting_review', xc, yc FROM cj WHERE xc IS DISTINCT FROM yc
        UNION ALL SELECT pair_id, identity, 'publication_evidence_changed', 'publication', xp, yp FROM cj WHERE xp IS DISTINCT FROM yp""",
}


@query(
    "context_diff",
    with_views(
        extra=CTX,
        body="""SELECT pair_id, change_type, 'valuation' AS section, 'eps' AS resource_type, identity, 'checked_dependencies.' || f AS field_path,
            before, after, NULL::VARCHAR AS absolute_delta FROM cu""",
    ),
)
def q_context_diff(spark, sf_dir):
    o = d.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    st = F.array(*[F.lit(s) for s in ("current", "stale", "unknown", "blocked")])

    def side(gone, status_at, revoked, waiting, pub):
        return o.where(F.col("o_orderstatus") != gone).select(
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("pair_id"),
            F.concat(F.lit("valuation|"), k.cast("string")).alias("identity"),
            F.lit("valuation").alias("section"),
            F.lit("eps").alias("resource_type"),
            F.get(st, status_at.cast("int")).alias("status"),
            F.when(revoked, "revoked").when(k % 3 == 0, "approved").alias("effective_approval_status"),
            (k % waiting == 0).alias("candidate_awaiting_review"),
            F.concat(F.lit("E"), (k % pub).cast("string")).alias("publication"),
        )

    a = side("F", k % 4, F.lit(False), 5, 9)
    b = side("O", F.expr("(o_orderkey div 2) % 4"), k % 6 == 0, 10, 8)
    return df_.context_diff(a, b)


FRESH = {
    **_rev_sql("x", CUTOFF),
    "deps": """SELECT 'SN' || symbol AS snapshot_id, CASE WHEN id % 97 = 0 THEN -id ELSE id END AS resource_id,
        CASE WHEN id % 89 = 0 THEN 'other' ELSE logical_id END AS logical_resource_id FROM xr""",
    "ya": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY available_at DESC, ingested_at DESC, approval_event_id DESC) AS rn
        FROM approvals WHERE available_at <= {LATER_CUTOFF} AND ingested_at <= {LATER_CUTOFF}) WHERE rn = 1""",
    "seen": f"""SELECT eps.*, coalesce(a.decision = 'approved' AND a.rule_id = 'VAL-02' AND (a.evidence_level <> 'C' OR a.project_operationalization = 1), false) AS appr
        FROM eps LEFT JOIN ya a ON a.resource_id = eps.id WHERE eps.available_at <= {LATER_CUTOFF} AND eps.ingested_at <= {LATER_CUTOFF}""",
    "lastv": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY revision_number DESC, available_at DESC, ingested_at DESC, id DESC) AS rn FROM seen) WHERE rn = 1""",
    "bestv": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY revision_number DESC, available_at DESC, ingested_at DESC, id DESC) AS rn
        FROM seen WHERE status = 'active' AND appr) WHERE rn = 1""",
    "fr": """SELECT d.*, l.id AS lv, b.id AS bv, b.revision_number AS brn, l.appr AS lappr, CASE WHEN e.id IS NULL THEN 'snapshot_dependency_missing'
        WHEN d.logical_resource_id <> e.logical_id THEN 'snapshot_dependency_logical_identity_mismatch'
        WHEN e.status <> 'active' OR l.status <> 'active' THEN 'dependency_revoked'
        WHEN a.decision = 'revoked' THEN 'approval_revoked' WHEN b.id IS NULL THEN 'no_eligible_dependency_revision'
        WHEN b.id <> d.resource_id THEN 'newer_eligible_forward_eps_revision' END AS reason
        FROM deps d LEFT JOIN eps e ON e.id = d.resource_id LEFT JOIN ya a ON a.resource_id = d.resource_id
        LEFT JOIN lastv l ON l.logical_id = e.logical_id LEFT JOIN bestv b ON b.logical_id = e.logical_id""",
    "fs": """SELECT *, CASE WHEN reason IS NULL THEN 'current' WHEN reason LIKE 'newer%' THEN 'stale'
        WHEN reason LIKE 'no_elig%' THEN 'unknown' ELSE 'blocked' END AS status,
        reason IS NULL OR reason LIKE 'newer%' OR reason LIKE 'no_elig%' AS dec FROM fr""",
}


def _freshness(spark, sf_dir):
    deps = asof.latest_revision_asof(d.eps_ledger(spark, sf_dir), d.CUTOFF).select(
        F.concat(F.lit("SN"), "symbol").alias("snapshot_id"),
        F.lit("forward_eps_revision").alias("resource_type"),
        F.when(F.col("id") % 97 == 0, -F.col("id")).otherwise(F.col("id")).alias("resource_id"),
        F.when(F.col("id") % 89 == 0, "other").otherwise(F.col("logical_id")).alias("logical_resource_id"),
    )
    return fr.dependency_freshness(
        deps, d.eps_ledger(spark, sf_dir), d.approvals(spark, sf_dir), d.LATER_CUTOFF, "VAL-02", "forward_eps_revision"
    )


@query(
    "dependency_freshness",
    with_views(
        "eps",
        "approvals",
        extra=FRESH,
        body="""SELECT snapshot_id, 'forward_eps_revision' AS resource_type, resource_id, logical_resource_id, status, reason,
            CASE WHEN dec THEN bv END AS latest_eligible_id, CASE WHEN dec THEN brn::BIGINT END AS latest_eligible_revision_number,
            dec AND lv IS NOT NULL AND lv IS DISTINCT FROM bv AND NOT coalesce(lappr, false) AS candidate_awaiting_review FROM fs""",
    ),
)
def q_freshness(spark, sf_dir):
    return _freshness(spark, sf_dir)


L = LATER_CUTOFF
NEWEST = "revision_number DESC, available_at DESC, ingested_at DESC, id DESC"
ALL_LEDGERS = {
    **PE_LEDGER,
    "ev": """SELECT period || '-' || revision AS pid, period, revision, available_at AS ing, CASE WHEN revision % 3 = 0 THEN 'candidate' ELSE 'accepted' END AS st
        FROM m1b WHERE substr(period, 6, 2) <> '07'""",
    "mb": "SELECT *, CASE WHEN substr(period, 6, 2)::INT % 4 <> 3 THEN period || '-' || revision END AS bid FROM m1b",
    "la": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY revision DESC, ing DESC, pid DESC) AS rn FROM ev WHERE ing <= {L}) WHERE rn = 1",
    "led": f"""SELECT 'forward_eps_revision' AS resource_type, id::VARCHAR AS id, logical_id, revision_number::BIGINT AS revision_number, available_at, ingested_at,
            status = 'active' AS active, true AS valid, true AS bound FROM eps
        UNION ALL SELECT 'pe_scenario_revision', id, logical_id, revision_number, available_at, ingested_at, true,
            (effective_from IS NULL OR effective_from <= {L}) AND (effective_to IS NULL OR effective_to > {L}), true FROM pe_revisions
        UNION ALL SELECT 'm1b_revision', mb.period || '-' || mb.revision, mb.period, mb.revision, mb.available_at, mb.ingested_at, mb.status = 'available', true,
            (la.pid IS NULL AND bid IS NULL) OR coalesce(la.st = 'accepted' AND la.pid = bid, false) FROM mb LEFT JOIN la ON la.period = mb.period
        UNION ALL SELECT 'market_turnover_revision', 'T' || trade_date, trade_date::VARCHAR, 1, (trade_date + 1)::TIMESTAMP, (trade_date + 1)::TIMESTAMP,
            date_diff('day', DATE '1995-01-01', trade_date) % 41 <> 0, true, true FROM (SELECT DISTINCT trade_date FROM turnover_markets)""",
    "apps": """SELECT 'forward_eps_revision' AS resource_type, resource_id::VARCHAR AS id, approval_event_id, decision, rule_id, evidence_level,
            project_operationalization, available_at, ingested_at FROM approvals
        UNION ALL SELECT 'pe_scenario_revision', resource_id, approval_event_id, decision, rule_id, evidence_level, project_operationalization, available_at, ingested_at FROM pe_approvals""",
    "ap": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resource_type, id ORDER BY available_at DESC, ingested_at DESC, approval_event_id DESC) AS rn
        FROM apps WHERE available_at <= {L} AND ingested_at <= {L}) WHERE rn = 1""",
    "jl": f"""SELECT led.*, a.decision, led.available_at <= {L} AND led.ingested_at <= {L} AS seen, led.resource_type NOT IN ('forward_eps_revision', 'pe_scenario_revision')
        OR coalesce(a.decision = 'approved' AND a.rule_id = CASE led.resource_type WHEN 'pe_scenario_revision' THEN 'VAL-04' ELSE 'VAL-02' END
            AND (a.evidence_level <> 'C' OR a.project_operationalization = 1), false) AS approved
        FROM led LEFT JOIN ap a ON a.resource_type = led.resource_type AND a.id = led.id""",
    "lv": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resource_type, logical_id ORDER BY {NEWEST}) AS rn FROM jl WHERE seen) WHERE rn = 1",
    "bv": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resource_type, logical_id ORDER BY {NEWEST}) AS rn FROM jl
        WHERE seen AND active AND valid AND bound AND approved) WHERE rn = 1""",
    "dep": """SELECT resource_type, CASE WHEN hash_n % 19 = 0 THEN id || '?' ELSE id END AS resource_id, CASE WHEN hash_n % 23 = 0 THEN 'other' WHEN hash_n % 5 = 0 THEN '' ELSE logical_id END AS logical_resource_id
            FROM (SELECT *, length(logical_id) * 31 + revision_number * 7 + ascii(right(id, 1)) AS hash_n FROM led)
        UNION ALL SELECT CASE WHEN r_regionkey = 0 THEN NULL ELSE 'report' END, r_name, NULL FROM region""",
    "hs": """SELECT CASE r_regionkey WHEN 0 THEN 'x.market-turnover' WHEN 1 THEN 'y.market-turnover' ELSE 'z.m1b' END AS rid, CASE r_regionkey WHEN 2 THEN 'provider_error' ELSE 'accepted' END AS st,
        CASE r_regionkey WHEN 0 THEN 'stale' WHEN 1 THEN 'current' ELSE 'current' END AS fresh FROM region WHERE r_regionkey < 3""",
    "op": """SELECT rt, bool_or(fresh = 'stale') AS stale FROM (SELECT CASE rid WHEN 'z.m1b' THEN 'm1b_revision' ELSE 'market_turnover_revision' END AS rt, fresh FROM hs) GROUP BY 1""",
    "fr": """SELECT d.*, l.id AS lid, b.id AS bid, b.revision_number AS brn, coalesce(l.approved, false) AS lap, d.resource_type IN ('forward_eps_revision', 'pe_scenario_revision') AS needs,
        CASE WHEN d.resource_type IS NULL THEN 'unsupported_dependency_type_missing' WHEN d.resource_type = 'report' THEN 'unsupported_dependency_type_report'
            WHEN e.id IS NULL THEN 'snapshot_dependency_missing'
            WHEN d.logical_resource_id <> '' AND d.logical_resource_id <> e.logical_id THEN 'snapshot_dependency_logical_identity_mismatch'
            WHEN NOT e.bound THEN 'publication_evidence_binding_invalid' WHEN NOT e.active OR NOT l.active THEN 'dependency_revoked'
            WHEN d.resource_type IN ('forward_eps_revision', 'pe_scenario_revision') AND e.decision = 'revoked' THEN 'approval_revoked' END AS early,
        CASE WHEN b.id IS NULL THEN 'no_eligible_dependency_revision' WHEN b.id <> d.resource_id THEN 'newer_eligible_' || d.resource_type
            WHEN op.stale THEN 'dependency_source_stale' END AS late
        FROM dep d LEFT JOIN jl e ON e.resource_type = d.resource_type AND e.id = d.resource_id
        LEFT JOIN lv l ON l.resource_type = e.resource_type AND l.logical_id = e.logical_id
        LEFT JOIN bv b ON b.resource_type = e.resource_type AND b.logical_id = e.logical_id LEFT JOIN op ON op.rt = d.resource_type""",
}


@query(
    "freshness_over_ledgers",
    with_views(
        "eps",
        "approvals",
        "pe",
        "m1b",
        "turnover_markets",
        extra=ALL_LEDGERS,
        body="""SELECT resource_type, resource_id, logical_resource_id, CASE WHEN coalesce(early, late) IS NULL THEN 'current'
            WHEN early LIKE 'unsupported%' OR (early IS NULL AND late LIKE 'no_elig%') THEN 'unknown' WHEN early IS NULL THEN 'stale' ELSE 'blocked' END AS status,
            coalesce(early, late) AS reason, CASE WHEN early IS NULL THEN bid END AS latest_eligible_id, CASE WHEN early IS NULL THEN brn END AS latest_eligible_revision_number,
            coalesce(early IS NULL AND needs AND lid IS NOT NULL AND lid IS DISTINCT FROM bid AND NOT lap, false) AS candidate_awaiting_review FROM fr""",
    ),
)
def q_freshness_ledgers(spark, sf_dir):
    """Dependencies on four ledgers, on types nobody knows and on none, with bindings, validity and provider states."""
    money = d.m1b(spark, sf_dir)
    pid, month = F.concat_ws("-", "period", F.col("revision").cast("string")), F.substring("period", 6, 2)
    evidence = money.where(month != "07").select(
        pid.alias("publication_evidence_id"), "period", F.col("revision").alias("revision_number"),
        F.when(F.col("revision") % 3 == 0, "candidate").otherwise("accepted").alias("status"), F.col("available_at").alias("ingested_at"),
    )
    money = lq.publication_binding(money.withColumn("publication_evidence_id", F.when(month.cast("int") % 4 != 3, pid)), evidence, d.LATER_CUTOFF).withColumn("id", pid)
    day = F.col("trade_date")
    ready = F.date_add(day, 1).cast("timestamp")
    turnover = d.turnover_markets(spark, sf_dir).select("trade_date").distinct().select(
        F.concat(F.lit("T"), day.cast("string")).alias("id"), "trade_date", F.lit(1).alias("revision"),
        F.when(d.day_number("trade_date") % 41 != 0, "available").otherwise("revoked").alias("status"), ready.alias("available_at"), ready.alias("ingested_at"),
    )
    ledgers = {
        "forward_eps_revision": fr.Ledger(d.eps_ledger(spark, sf_dir), rules=("VAL-02",)),
        "pe_scenario_revision": fr.Ledger(d.pe_revisions(spark, sf_dir), active=None, rules=("VAL-04",), valid=val.effective_at(d.LATER_CUTOFF)),
        "m1b_revision": fr.Ledger(money, "period", "revision", "available", bound=F.col("eligible"), resources=("z.m1b",)),
        "market_turnover_revision": fr.Ledger(turnover, "trade_date", "revision", "available", resources=("x.market-turnover", "y.market-turnover")),
    }
    events = d.approvals(spark, sf_dir).withColumn("resource_id", F.col("resource_id").cast("string")).withColumn("resource_type", F.lit("forward_eps_revision"))
    events = events.unionByName(d.pe_approvals(spark, sf_dir).withColumn("resource_type", F.lit("pe_scenario_revision")))
    rows = None
    for kind, ledger in ledgers.items():
        part = ledger.rows.select(
            F.lit(kind).alias("resource_type"), F.col("id").cast("string").alias("id"),
            F.col(ledger.logical).cast("string").alias("logical_id"), F.col(ledger.revision).alias("revision_number"),
        )
        rows = part if rows is None else rows.unionByName(part)
    n = F.length("logical_id") * 31 + F.col("revision_number") * 7 + F.ascii(F.right("id", F.lit(1)))
    deps = rows.withColumn("n", n).select(
        "resource_type",
        F.when(F.col("n") % 19 == 0, F.concat("id", F.lit("?"))).otherwise(F.col("id")).alias("resource_id"),
        F.when(F.col("n") % 23 == 0, "other").when(F.col("n") % 5 == 0, "").otherwise(F.col("logical_id")).alias("logical_resource_id"),
    )
    region, k = d.table(spark, sf_dir, "region"), F.col("r_regionkey")
    odd = region.select(F.when(k != 0, "report").alias("resource_type"), F.col("r_name").alias("resource_id"), F.lit(None).cast("string").alias("logical_resource_id"))
    health = region.where(k < 3).select(
        F.when(k == 0, "x.market-turnover").when(k == 1, "y.market-turnover").otherwise("z.m1b").alias("resource_id"),
        F.when(k == 2, "provider_error").otherwise("accepted").alias("status"), F.when(k == 0, "stale").otherwise("current").alias("freshness"),
    )
    return fr.freshness_over_ledgers(deps.unionByName(odd), ledgers, events, d.LATER_CUTOFF, health)


@query(
    "status_rollup",
    with_views(
        "eps",
        "approvals",
        extra={
            **FRESH,
            "g": """SELECT snapshot_id, max(CASE status WHEN 'blocked' THEN 3 WHEN 'stale' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END) AS m, count(*) AS n,
                coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM fs GROUP BY 1""",
            "sn": "SELECT DISTINCT 'SNC' || c_custkey AS snapshot_id FROM customer",
        },
        body="""SELECT snapshot_id, CASE m WHEN 3 THEN 'blocked' WHEN 2 THEN 'stale' WHEN 0 THEN 'current' ELSE 'unknown' END AS freshness_status,
            coalesce(n, 0) AS dependencies, coalesce(reasons, 'snapshot_has_no_dependencies') AS reasons FROM sn LEFT JOIN g USING (snapshot_id)""",
    ),
)
def q_rollup(spark, sf_dir):
    snaps = d.table(spark, sf_dir, "customer").select(F.concat(F.lit("SNC"), F.col("c_custkey").cast("string")).alias("snapshot_id"))
    return fr.status_rollup(snaps, _freshness(spark, sf_dir))


HEALTH_CUTOFF = "2024-01-20 12:00:00"
HC = "TIMESTAMP '2024-01-20 12:00:00'"
HEALTH = {
    "cal": """SELECT item_id AS id, started_at::DATE AS trade_date, item_id AS revision_number, started_at AS available_at, completed_at AS ingested_at,
        CASE WHEN k >= 95 THEN 'revoked' ELSE 'available' END AS status, CASE WHEN k % 3 = 0 THEN 'holiday' ELSE 'trading' END AS session_status FROM run_items""",
    "cv": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY revision_number DESC, available_at DESC, ingested_at DESC, id DESC) AS rn
        FROM cal WHERE available_at <= {HC} AND ingested_at <= {HC}) WHERE rn = 1""",
    "res": """SELECT DISTINCT resource_id, provider_id, CASE provider_id WHEN 'click' THEN 'monthly_publication' WHEN 'purchase' THEN 'periodic'
        WHEN 'signup' THEN 'manual' ELSE 'daily' END AS expected_frequency FROM run_items""",
    "li": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY started_at DESC, item_id DESC) AS rn
        FROM run_items WHERE started_at <= {HC}) WHERE rn = 1""",
    "su": f"""SELECT resource_id, max(completed_at) AS last_success_at FROM run_items WHERE completed_at <= {HC}
        AND status IN ('accepted', 'partial', 'awaiting_review', 'quality_warning') GROUP BY 1""",
    "rw": f"""SELECT * FROM (SELECT *, started_at::DATE AS lk, row_number() OVER (PARTITION BY resource_id, started_at::DATE
        ORDER BY completed_at DESC, started_at DESC, item_id DESC) AS rn FROM run_items WHERE started_at <= {HC} AND completed_at <= {HC})
        WHERE rn = 1 AND k >= 20""",
    "el": "SELECT resource_id, max(lk) AS lk, arg_max(started_at, lk) AS at FROM rw GROUP BY 1",
    "h": """SELECT res.*, li.started_at AS la, coalesce(li.status, 'unknown') AS op, last_success_at AS ls, el.at AS le, el.lk AS lk,
        (SELECT max(trade_date) FROM cv WHERE status = 'available' AND session_status IN ('trading', 'special')) AS due
        FROM res LEFT JOIN li USING (resource_id) LEFT JOIN su USING (resource_id) LEFT JOIN el USING (resource_id)""",
}


def _calendar_revisions(spark, sf_dir):
    r = d.run_items(spark, sf_dir)
    return r.select(
        F.col("item_id").alias("id"),
        F.col("started_at").cast("date").alias("trade_date"),
        F.col("item_id").alias("revision_number"),
        F.col("started_at").alias("available_at"),
        F.col("completed_at").alias("ingested_at"),
        F.when(F.col("k") >= 95, "revoked").otherwise("available").alias("status"),
        F.when(F.col("k") % 3 == 0, "holiday").otherwise("trading").alias("session_status"),
    )


@query(
    "provider_health",
    with_views(
        "run_items",
        extra=HEALTH,
        body=f"""SELECT resource_id, provider_id, expected_frequency, {TS.format(c='la')} AS last_attempt_at, op AS operational_status,
            {TS.format(c='ls')} AS last_success_at, {TS.format(c='le')} AS last_eligible_revision_at, lk::VARCHAR AS last_eligible_logical_key,
            due::VARCHAR AS latest_expected_trade_date,
            CASE WHEN op IN ('provider_error', 'partial', 'awaiting_review') THEN 'blocked' WHEN la IS NULL OR le IS NULL THEN 'unknown'
                 WHEN expected_frequency <> 'daily' THEN 'unknown' WHEN due IS NULL THEN 'unknown' WHEN lk < due THEN 'stale'
                 WHEN lk = due AND due = DATE '2024-01-20' THEN 'current' ELSE 'unknown' END AS freshness,
            CASE WHEN op IN ('provider_error', 'partial', 'awaiting_review') THEN 'latest_operational_status_' || op
                 WHEN la IS NULL THEN 'no_ingestion_attempt' WHEN le IS NULL THEN 'no_eligible_revision'
                 WHEN expected_frequency = 'monthly_publication' THEN 'publication_cadence_not_proven'
                 WHEN expected_frequency = 'periodic' THEN 'authoritative_periodic_cadence_not_proven'
                 WHEN expected_frequency = 'manual' THEN 'manual_resource_has_no_freshness_proof'
                 WHEN due IS NULL THEN 'official_calendar_session_unavailable' WHEN lk < due THEN 'newer_official_session_expected'
                 WHEN lk = due AND due = DATE '2024-01-20' THEN NULL ELSE 'official_calendar_coverage_incomplete' END AS freshness_reason FROM h""",
    ),
)
def q_health(spark, sf_dir):
    r = d.run_items(spark, sf_dir)
    resources = r.select("resource_id", "provider_id").distinct().withColumn(
        "expected_frequency",
        F.when(F.col("provider_id") == "click", "monthly_publication")
        .when(F.col("provider_id") == "purchase", "periodic")
        .when(F.col("provider_id") == "signup", "manual")
        .otherwise("daily"),
    )
    raw = r.select(
        F.col("item_id").alias("id"),
        "resource_id",
        F.col("started_at").cast("date").alias("logical_key"),
        F.col("started_at").alias("available_at"),
        F.col("completed_at").alias("ingested_at"),
        F.when(F.col("k") >= 20, "eligible").otherwise("blocked").alias("eligibility"),
    )
    return fr.provider_health(resources, r, raw, _calendar_revisions(spark, sf_dir), HEALTH_CUTOFF)


@query(
    "calendar_state_asof",
    with_views("run_items", extra=HEALTH, body="SELECT trade_date::VARCHAR AS trade_date, id, status, session_status FROM cv WHERE status <> 'revoked'"),
)
def q_calendar_state(spark, sf_dir):
    out = fr.calendar_state_asof(_calendar_revisions(spark, sf_dir), HEALTH_CUTOFF)
    return out.select("trade_date", "id", "status", "session_status")


SNAPS = {
    "sn": """SELECT 'SN' || lpad(o_orderkey::VARCHAR, 12, '0') AS snapshot_id, o_orderkey, 'C' || o_custkey AS symbol, o_orderdate::DATE::TIMESTAMP AS created_at,
        '{"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}' AS document, o_orderkey % 23 <> 0 AS ok,
        CASE WHEN o_orderkey % 5 = 0 THEN '1.0' ELSE '2.0' END AS mv FROM orders""",
    "ls": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY created_at DESC, snapshot_id DESC) AS rn FROM sn WHERE created_at <= {LATER_CUTOFF}) WHERE rn = 1""",
}


def _snaps(spark, sf_dir):
    o = d.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    doc = F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('","priority":"'), "o_orderpriority", F.lit('"}'))
    return o.select(
        F.concat(F.lit("SN"), F.lpad(k.cast("string"), 12, "0")).alias("snapshot_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.col("o_orderdate").cast("date").cast("timestamp").alias("created_at"),
        doc.alias("document"),
        F.when(k % 23 != 0, F.sha2(doc, 256)).otherwise("damaged").alias("document_sha256"),
        F.when(k % 5 == 0, "1.0").otherwise("2.0").alias("model_version"),
        k.alias("order_no"),
    )


@query(
    "latest_per_symbol",
    with_views(extra=SNAPS, body=f"SELECT symbol, snapshot_id, {TS.format(c='created_at')} AS created_at, ok AS integrity_ok FROM ls"),
)
def q_latest_snap(spark, sf_dir):
    out = sn.latest_per_symbol(_snaps(spark, sf_dir), d.LATER_CUTOFF)
    return out.select("symbol", "snapshot_id", "created_at", "integrity_ok")


REVIEW = {
    **SNAPS,
    "ev": f"""SELECT * FROM (SELECT o_custkey, CASE WHEN o_orderkey % 33 = 0 THEN 'missing' ELSE 'SN' || lpad(o_orderkey::VARCHAR, 12, '0') END AS ack,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders
        WHERE o_orderkey % 3 = 0 AND o_orderdate <= {CUTOFF}) WHERE rn = 1""",
    "q": """SELECT c_custkey AS item_id, 'C' || c_custkey AS symbol, ls.snapshot_id AS lid, ev.ack, ls.ok AS lok, b.ok AS bok,
        b.mv <> ls.mv AS incomparable, (ls.o_orderkey + b.o_orderkey) % 4 AS f,
        (b.document <> ls.document)::INT AS sd, (ls.o_orderkey % 3)::INT AS cd
        FROM customer LEFT JOIN ls ON ls.symbol = 'C' || c_custkey LEFT JOIN ev ON ev.o_custkey = c_custkey LEFT JOIN sn b ON b.snapshot_id = ev.ack""",
    "qs": """SELECT *, CASE WHEN lid IS NULL THEN 'no_snapshot' WHEN ack IS NULL THEN 'baseline_not_set'
        WHEN NOT lok OR NOT coalesce(bok, true) THEN 'snapshot_integrity_error' WHEN bok IS NULL THEN 'blocked'
        WHEN incomparable THEN 'incomparable_contract' WHEN f = 0 THEN 'blocked' WHEN f = 1 THEN 'unknown'
        WHEN sd + cd > 0 THEN 'comparable_with_deltas' ELSE 'comparable_without_deltas' END AS state FROM q""",
}


@query(
    "review_queue",
    with_views(
        extra=REVIEW,
        body="""SELECT item_id, symbol, lid AS latest_snapshot_id, ack AS acknowledged_snapshot_id, state AS review_state,
            (CASE WHEN state LIKE 'comparable%' THEN sd ELSE 0 END)::BIGINT AS stored_delta_count,
            (CASE WHEN state LIKE 'comparable%' THEN cd ELSE 0 END)::BIGINT AS context_delta_count FROM qs""",
    ),
)
def q_review(spark, sf_dir):
    snaps = _snaps(spark, sf_dir).withColumn("integrity_ok", F.sha2("document", 256) == F.col("document_sha256"))
    last = sn.latest_per_symbol(_snaps(spark, sf_dir), d.LATER_CUTOFF)
    watch = d.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("item_id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol")
    )
    k = F.col("o_orderkey")
    events = (
        d.table(spark, sf_dir, "orders")
        .where((k % 3 == 0) & (F.col("o_orderdate") <= F.lit(d.CUTOFF).cast("timestamp_ntz")))
        .select(
            F.col("o_custkey").alias("item_id"),
            F.col("o_orderdate").alias("event_at"),
            k.alias("event_id"),
            F.when(k % 33 == 0, "missing").otherwise(F.concat(F.lit("SN"), F.lpad(k.cast("string"), 12, "0"))).alias("acknowledged_snapshot_id"),
        )
    )
    newest_events = sn.latest_event_per_item(events).select("item_id", "acknowledged_snapshot_id")
    # Compare only the pairs the queue asks for.
    base = snaps.select(F.col("snapshot_id").alias("base_id"), F.col("model_version").alias("bm"), F.col("document").alias("bd"), F.col("order_no").alias("bn"))
    pairs = (
        watch.join(newest_events, "item_id")
        .join(last.select("symbol", F.col("snapshot_id").alias("comparison_id"), "model_version", "document", "order_no"), "symbol")
        .withColumnRenamed("acknowledged_snapshot_id", "base_id")
        .join(base, "base_id")
    )
    state = (F.col("order_no") + F.col("bn")) % 4
    comparisons = pairs.select(
        "base_id",
        "comparison_id",
        (F.col("bm") != F.col("model_version")).alias("incomparable"),
        F.when(state == 0, "blocked").when(state == 1, "unknown").when(state == 2, "stale").otherwise("current").alias("freshness"),
        (F.col("bd") != F.col("document")).cast("int").alias("stored_deltas"),
        (F.col("order_no") % 3).cast("int").alias("context_deltas"),
    )
    return fr.review_queue(watch, newest_events, last, snaps, comparisons)


@query(
    "latest_event_per_item",
    """SELECT campaign_id AS item_id, arg_max(event_id, (ts, event_id)) AS event_id FROM (SELECT user_id AS campaign_id, ts, event_id FROM events) GROUP BY 1""",
)
def q_latest_event(spark, sf_dir):
    e = d.table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.col("ts").alias("event_at"), "event_id")
    return sn.latest_event_per_item(e).select("item_id", "event_id")


@query(
    "keyset_page",
    f"""SELECT o_orderkey AS id, {TS.format(c='o_orderdate::DATE::TIMESTAMP')} AS created_at FROM orders
        WHERE o_orderdate < TIMESTAMP '2000-06-15' OR (o_orderdate = TIMESTAMP '2000-06-15' AND o_orderkey < 5000)
        ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51""",
)
def q_page(spark, sf_dir):
    rows = d.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").cast("timestamp").alias("created_at")
    )
    return sn.keyset_page(rows, 50, ("2000-06-15 00:00:00", 5000))


@query(
    "queue_page",
    "SELECT c_custkey AS item_id, 'C' || c_custkey AS symbol FROM customer WHERE c_custkey % 9 <> 0 ORDER BY 'C' || c_custkey, c_custkey LIMIT 50",
)
def q_queue(spark, sf_dir):
    w = d.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("item_id"),
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"),
        (F.col("c_custkey") % 9 == 0).alias("archived"),
    )
    return sn.queue_page(w).select("item_id", "symbol")


@query(
    "dependency_dedupe",
    """WITH x AS (SELECT l_orderkey AS snapshot_id, 'S' || (l_linenumber % 3) AS section, l_returnflag AS resource_type, l_suppkey % 5 AS resource_id,
            l_linenumber::BIGINT * 1000000 + l_partkey AS position FROM lineitem)
        SELECT snapshot_id, section, resource_type, resource_id, max(position) AS position FROM x GROUP BY ALL""",
)
def q_dedupe(spark, sf_dir):
    li = d.table(spark, sf_dir, "lineitem")
    deps = li.select(
        F.col("l_orderkey").alias("snapshot_id"),
        F.concat(F.lit("S"), (F.col("l_linenumber") % 3).cast("string")).alias("section"),
        F.col("l_returnflag").alias("resource_type"),
        (F.col("l_suppkey") % 5).alias("resource_id"),
        (F.col("l_linenumber").cast("bigint") * 1000000 + F.col("l_partkey")).alias("position"),
    )
    return sn.dependency_dedupe(deps)


@query(
    "provenance_union",
    """WITH x AS (SELECT o_custkey AS snapshot_id, 'valuation' AS section, 0::BIGINT AS section_number, o_orderstatus AS resource_type, o_orderkey % 50 AS resource_id, o_orderkey AS position FROM orders
            UNION ALL SELECT o_custkey, 'screening', 1, o_orderpriority, o_orderkey % 20, o_orderkey FROM orders)
        SELECT snapshot_id, section, section_number, resource_type, resource_id, max(position) AS position FROM x GROUP BY ALL""",
)
def q_provenance(spark, sf_dir):
    o = d.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")

    def part(kind, n):
        return o.select(F.col("o_custkey").alias("snapshot_id"), F.col(kind).alias("resource_type"), (k % n).alias("resource_id"), k.alias("position"))

    return sn.provenance_union({"valuation": part("o_orderstatus", 50), "screening": part("o_orderpriority", 20)})


@query(
    "section_document",
    with_views(
        "eps",
        "approvals",
        "pe",
        extra={
            **STATES,
            **PE_EFF,
            "pg": """SELECT symbol, max(CASE WHEN decision = 'revoked' THEN 2 WHEN nt = 3 AND decision = 'approved' THEN 3 WHEN nt <> 3 THEN 1 ELSE 0 END) AS r,
                count(*) AS plans FROM (""" + PLANS + """) GROUP BY symbol""",
            "pl": """SELECT symbol, {'plans': plans, 'reason': CASE r WHEN 2 THEN 'deployment_plan_approval_revoked' WHEN 1 THEN 'deployment_triggers_required'
                WHEN 0 THEN 'approved_deployment_plan_required' END, 'status': CASE WHEN r = 3 THEN 'available' ELSE 'needs_human_input' END} AS s FROM pg""",
            "g": """SELECT symbol, count(*) FILTER (eligible AND status = 'active') AS approved,
                bool_and(status = 'revoked' OR coalesce(decision = 'revoked', false)) AS all_revoked,
                max(eps_high) FILTER (eligible AND status = 'active') AS best FROM states GROUP BY symbol""",
            "h": "SELECT scope_value AS symbol, count(*) AS n FROM pe_eff WHERE scope = 'symbol' GROUP BY 1",
            "x": """SELECT symbol, approved, CASE WHEN approved = 0 AND all_revoked THEN 'forward_eps_approval_revoked'
                WHEN approved = 0 THEN 'approved_forward_eps_required' WHEN n IS NULL THEN 'approved_symbol_pe_missing_at_knowledge_cutoff'
                WHEN best <= 0 THEN 'forward_eps_is_zero_or_negative' END AS reason FROM g LEFT JOIN h USING (symbol)""",
            "va": """SELECT symbol, {'approved': approved, 'reason': reason, 'status': CASE WHEN reason IS NULL THEN 'available'
                WHEN reason = 'forward_eps_approval_revoked' THEN 'insufficient_data' WHEN reason = 'forward_eps_is_zero_or_negative' THEN 'not_applicable'
                ELSE 'needs_human_input' END} AS s FROM x""",
            "dc": """SELECT 'C' || c_custkey AS symbol, to_json({'symbol': 'C' || c_custkey, 'deployment_plan': pl.s, 'valuation': va.s})::VARCHAR AS document
                FROM customer LEFT JOIN pl ON pl.symbol = 'C' || c_custkey LEFT JOIN va ON va.symbol = 'C' || c_custkey""",
        },
        body="SELECT symbol, document, 'analysis_' || substr(sha256(document), 1, 24) AS document_id FROM dc",
    ),
)
def q_document(spark, sf_dir):
    symbols = d.table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"))
    return sn.section_document(
        symbols,
        {
            "valuation": val.eps_pe_status(_states(spark, sf_dir), symbol_pe(spark, sf_dir)),
            "deployment_plan": sc.plan_status(_plans(spark, sf_dir)),
        },
    )


@query(
    "canonical_decimal",
    f"""WITH x AS (SELECT o_orderkey AS id, ({cents('o_totalprice')} - 20000000)::DECIMAL(28,4) / 1 AS v, {cents('o_totalprice')} - 20000000 AS c FROM orders)
        SELECT id, CASE WHEN c = 0 THEN '0' ELSE (CASE WHEN c < 0 THEN '-' ELSE '' END) || (abs(c) // 100)::VARCHAR ||
            CASE WHEN abs(c) % 100 = 0 THEN '' WHEN abs(c) % 10 = 0 THEN '.' || (abs(c) % 100 // 10)::VARCHAR
                 ELSE '.' || lpad((abs(c) % 100)::VARCHAR, 2, '0') END END AS text FROM x""",
)
def q_canonical(spark, sf_dir):
    c = (d.cents("o_totalprice") - 20000000).cast("decimal(20,2)") / F.lit(100).cast("decimal(3,0)")
    return d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), canonical_decimal(c).alias("text"))


@query(
    "ledger_fingerprint",
    with_views(
        "eps",
        body="""SELECT id, 'eps_' || substr(sha256('{"fiscal_year":"' || fiscal_year || '","logical_id":"' || logical_id || '","revision":"' || revision_number
            || '","status":"' || status || '"}'), 1, 24) AS fingerprint FROM eps""",
    ),
)
def q_fingerprint(spark, sf_dir):
    text = canonical_json(
        {
            "fiscal_year": F.col("fiscal_year").cast("string"),
            "logical_id": F.col("logical_id"),
            "status": F.col("status"),
            "revision": F.col("revision_number").cast("string"),
        }
    )
    return d.eps_ledger(spark, sf_dir).select("id", fingerprint(text, "eps_", 24).alias("fingerprint"))


@query(
    "dataset_hash",
    with_views(
        "bars",
        body="""SELECT symbol, count(*) AS rows, sha256(string_agg(date::VARCHAR || ',' || close::BIGINT || ',' || volume::BIGINT, chr(10) ORDER BY date)) AS sha256
            FROM bars GROUP BY symbol""",
    ),
)
def q_dataset_hash(spark, sf_dir):
    line = F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), F.col("close").cast("bigint").cast("string"), F.col("volume").cast("bigint").cast("string"))
    return d.bars(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), dataset_hash(line).alias("sha256"))


@query(
    "canonical_map",
    with_views(
        "eps",
        extra=MAPS,
        body="""SELECT pair_id, '{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}' AS text FROM mx GROUP BY pair_id""",
    ),
)
def q_canonical_map(spark, sf_dir):
    a, _ = _two_maps(spark, sf_dir)
    return a.select("pair_id", F.to_json(canonical_map("used_rule_versions")).alias("text"))
