"""Queries on profiles asked for by name, money supply with all its keys, dates of findings and profile rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import liquidity as lq, quality as qa, screening as sn, validate as va
from tidemark.plans import domain as d
from tidemark.plans.domain_sql import CUTOFF, with_views
from tidemark.plans.q_market import LC, LIQ_CUTOFF, TURN, _turnover
from tidemark.plans.registry import query

RULE = "VAL-02"
GLOBAL_FROM = "1995-01-01 00:00:00"

PROFILES = """SELECT o_orderkey AS id, 'P' || o_custkey || '-' || CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 2 ELSE 0 END AS logical_id,
    year(o_orderdate) * 12 + month(o_orderdate) AS revision_number, CASE WHEN o_custkey % 7 = 0 THEN 'industry' ELSE 'symbol' END AS scope,
    'C' || o_custkey AS scope_value, CASE WHEN o_orderstatus = 'P' THEN 'revoked' ELSE 'available' END AS status,
    o_orderdate::DATE::TIMESTAMP AS available_at, (o_orderdate::DATE + (o_orderkey % 5)::INT)::TIMESTAMP AS ingested_at FROM orders"""
GLOBAL = f"""SELECT -1 - count(*), 'G' || count(*), 1, 'global', NULL, 'available', TIMESTAMP '{GLOBAL_FROM}', TIMESTAMP '{GLOBAL_FROM}' FROM nation"""
GLOBAL_EVENT = f"""SELECT 'G' || count(*), -1 - count(*), 'approved', '{RULE}', 'A', 1, TIMESTAMP '{GLOBAL_FROM}', TIMESTAMP '{GLOBAL_FROM}' FROM nation"""


def _requests_sql(kind: str) -> str:
    screening = kind == "screening"
    only = "AND approved" if screening else ""
    required = f"approved_{kind}_profile_required"
    refused = f"""WHEN status = 'revoked' THEN '{kind}_profile_revoked' WHEN decision = 'revoked' THEN '{kind}_profile_approval_revoked'
        WHEN NOT approved THEN '{required}'"""
    outside = f"WHEN NOT fits THEN '{kind}_profile_scope_mismatch'"
    if screening:
        chain = f"""WHEN n > 1 THEN 'screening_profile_selection_required' WHEN id IS NULL OR id <> revision_id THEN '{required}'
            {refused} WHEN NOT fits AND scope = 'industry' THEN 'industry_peer_data_required' {outside}"""
    else:
        chain = f"""WHEN hidden THEN '{kind}_profile_revision_not_visible_at_cutoff' WHEN n > 1 THEN '{kind}_profile_selection_required'
            WHEN id IS NULL THEN '{required}' WHEN id <> revision_id THEN '{kind}_profile_revision_superseded' {outside} {refused}"""
    return with_views(
        "approvals",
        extra={
            "prof": f"{PROFILES} UNION ALL {GLOBAL}" if screening else PROFILES,
            "events": f"SELECT * FROM approvals UNION ALL {GLOBAL_EVENT}" if screening else "SELECT * FROM approvals",
            "vis": f"SELECT * FROM prof WHERE available_at <= {CUTOFF} AND ingested_at <= {CUTOFF}",
            "lp": "SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY revision_number DESC, available_at DESC, ingested_at DESC, id DESC) AS rn FROM vis",
            "la": f"""SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY available_at DESC, ingested_at DESC, approval_event_id DESC) AS rn
                FROM events WHERE available_at <= {CUTOFF} AND ingested_at <= {CUTOFF}""",
            "st": f"""SELECT p.id, p.logical_id, p.scope, p.scope_value, p.status, a.decision, coalesce(p.status <> 'revoked' AND a.decision = 'approved'
                AND a.rule_id = '{RULE}' AND a.evidence_level <> 'U' AND (a.evidence_level <> 'C' OR a.project_operationalization = 1), false) AS approved
                FROM lp p LEFT JOIN la a ON a.resource_id = p.id AND a.rn = 1 WHERE p.rn = 1""",
            "req": """SELECT o_orderkey AS request_id, 'C' || o_custkey AS symbol,
                CASE o_orderkey % 5 WHEN 1 THEN 'P' || o_custkey || '-0' WHEN 3 THEN 'P' || (o_custkey + 1) || '-0' END AS logical_id,
                CASE o_orderkey % 5 WHEN 2 THEN o_orderkey WHEN 4 THEN CASE WHEN o_orderkey % 2 = 0 THEN -26 ELSE o_orderkey + 1 END END AS revision_id FROM orders""",
            "own": f"SELECT scope_value AS symbol, count(*) AS n, min(id) AS pid FROM st WHERE scope = 'symbol' {only} GROUP BY 1",
            "gl": f"SELECT count(*) AS n, min(id) AS pid FROM st WHERE scope = 'global' {only}",
            "pick": """SELECT r.*, r.revision_id IS NOT NULL AND k.id IS NULL AS hidden, s.id AS sid, (s.id IS NOT NULL)::INT AS n FROM req r
                LEFT JOIN vis k ON k.id = r.revision_id LEFT JOIN st s ON s.logical_id = coalesce(r.logical_id, k.logical_id)
                WHERE r.logical_id IS NOT NULL OR r.revision_id IS NOT NULL
                UNION ALL SELECT r.*, false, CASE WHEN coalesce(o.n, 0) + gl.n = 1 THEN coalesce(o.pid, gl.pid) END, coalesce(o.n, 0) + gl.n
                FROM req r CROSS JOIN gl LEFT JOIN own o ON o.symbol = r.symbol WHERE r.logical_id IS NULL AND r.revision_id IS NULL""",
            "j": """SELECT p.request_id, p.symbol, p.revision_id, p.hidden, p.n, s.*, coalesce(s.scope = 'global' OR (s.scope = 'symbol' AND s.scope_value = p.symbol), false) AS fits
                FROM pick p LEFT JOIN st s ON s.id = p.sid""",
            "o": f"SELECT *, CASE {chain} END AS reason FROM j",
        },
        body=f"""SELECT request_id, symbol, CASE WHEN reason IS NULL THEN 'available'
            WHEN reason IN ('{kind}_profile_scope_mismatch', 'industry_peer_data_required') THEN 'insufficient_data' ELSE 'needs_human_input' END AS status,
            reason, n::BIGINT AS applicable, CASE WHEN reason IS NULL THEN id END AS profile_id, id AS effective_revision_id FROM o""",
    )


def _profile_requests(spark, sf_dir, kind):
    o = d.table(spark, sf_dir, "orders")
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    ledger = o.select(
        k.alias("id"),
        F.concat(F.lit("P"), c.cast("string"), F.lit("-"), F.when(c % 3 == 0, k % 2).otherwise(0).cast("string")).alias("logical_id"),
        (F.year(day) * 12 + F.month(day)).alias("revision_number"),
        F.when(c % 7 == 0, "industry").otherwise("symbol").alias("scope"),
        F.concat(F.lit("C"), c.cast("string")).alias("scope_value"),
        F.when(F.col("o_orderstatus") == "P", "revoked").otherwise("available").alias("status"),
        day.cast("timestamp").alias("available_at"),
        F.date_add(day, (k % 5).cast("int")).cast("timestamp").alias("ingested_at"),
    )
    events = d.approvals(spark, sf_dir)
    if kind == "screening":
        start = F.lit(GLOBAL_FROM).cast("timestamp")
        world = d.table(spark, sf_dir, "nation").agg(F.count(F.lit(1)).alias("n"))
        key, name = (-1 - F.col("n")).cast("bigint"), F.concat(F.lit("G"), F.col("n").cast("string"))
        ledger = ledger.unionByName(
            world.select(
                key.alias("id"),
                name.alias("logical_id"),
                F.lit(1).alias("revision_number"),
                F.lit("global").alias("scope"),
                F.lit(None).cast("string").alias("scope_value"),
                F.lit("available").alias("status"),
                start.alias("available_at"),
                start.alias("ingested_at"),
            )
        )
        events = events.unionByName(
            world.select(
                name.alias("approval_event_id"),
                key.alias("resource_id"),
                F.lit("approved").alias("decision"),
                F.lit(RULE).alias("rule_id"),
                F.lit("A").alias("evidence_level"),
                F.lit(1).alias("project_operationalization"),
                start.alias("available_at"),
                start.alias("ingested_at"),
            )
        )
    case = k % 5
    own = F.concat(F.lit("P"), c.cast("string"), F.lit("-0"))
    other = F.concat(F.lit("P"), (c + 1).cast("string"), F.lit("-0"))
    requests = o.select(
        k.alias("request_id"),
        F.concat(F.lit("C"), c.cast("string")).alias("symbol"),
        F.when(case == 1, own).when(case == 3, other).alias("logical_id"),
        F.when(case == 2, k).when(case == 4, F.when(k % 2 == 0, F.lit(-26)).otherwise(k + 1)).alias("revision_id"),
    )
    out = sn.profile_requests(requests, ledger, events, d.CUTOFF, RULE, kind)
    return out.drop("logical_id", "revision_id")


@query("screening_profile_requests", _requests_sql("screening"))
def q_screening_requests(spark, sf_dir):
    """Screening profiles by logical id, by revision or by scope, with a global one."""
    return _profile_requests(spark, sf_dir, "screening")


@query("synthesis_profile_requests", _requests_sql("synthesis"))
def q_synthesis_requests(spark, sf_dir):
    """Synthesis profiles: hidden, superseded, revoked and out-of-scope revisions tell themselves apart."""
    return _profile_requests(spark, sf_dir, "synthesis")


BOUND = {
    **TURN,
    "tl": """SELECT trade_date, market_a, market_b, r AS revision, CASE WHEN r = 2 AND n % 35 = 0 THEN 'revoked' ELSE status END AS status,
        CASE WHEN r = 2 AND n % 35 = 0 THEN NULL WHEN r = 2 THEN total + 1e3 ELSE total END AS total,
        CASE WHEN r = 2 THEN available_at + INTERVAL 40 DAY ELSE available_at END AS available_at
        FROM (SELECT *, date_diff('day', DATE '1995-01-01', trade_date) AS n, unnest(CASE WHEN n % 5 = 0 THEN [1, 2] ELSE [1] END) AS r FROM turnover)""",
    "t": f"""SELECT *, least(available_at, {LC}) AS public_at FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY revision DESC, available_at DESC) AS rn
        FROM tl WHERE available_at <= {LC}) WHERE rn = 1""",
    "ev": """SELECT period || '-' || revision AS pid, period, revision, available_at AS ing,
        CASE WHEN revision % 3 = 0 THEN 'candidate' ELSE 'accepted' END AS st FROM m1b WHERE substr(period, 6, 2) <> '07'""",
    "la": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY revision DESC, ing DESC, pid DESC) AS rn
        FROM ev WHERE ing <= {LC}) WHERE rn = 1""",
    "md": """SELECT period, revision, dataset, CASE WHEN dataset = 'B' THEN value_twd * 2e0 ELSE value_twd END AS value_twd, status,
        CASE WHEN dataset = 'B' THEN available_at + INTERVAL 1 DAY ELSE available_at END AS available_at,
        CASE WHEN dataset = 'B' THEN ingested_at + INTERVAL 1 DAY ELSE ingested_at END AS ingested_at,
        CASE WHEN substr(period, 6, 2)::INT % 4 <> 3 THEN period || '-' || revision END AS bid
        FROM (SELECT *, unnest(CASE WHEN substr(period, 6, 2)::INT % 3 = 0 THEN ['A', 'B'] ELSE ['A'] END) AS dataset FROM m1b)""",
    "mb": """SELECT md.*, (la.pid IS NULL AND bid IS NULL) OR coalesce(la.st = 'accepted' AND la.pid = bid, false) AS eligible
        FROM md LEFT JOIN la ON la.period = md.period""",
    "seen": f"""SELECT t.trade_date, m.*, row_number() OVER (PARTITION BY t.trade_date, m.period, m.dataset ORDER BY m.revision DESC, m.available_at DESC) AS rn
        FROM t JOIN mb m ON m.available_at <= t.public_at AND m.ingested_at <= {LC}""",
    "best": """SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY available_at DESC, period DESC, revision DESC, ingested_at DESC, dataset DESC) AS r2
        FROM seen WHERE rn = 1 AND status = 'available' AND eligible""",
}


@query(
    "asof_m1b_bound",
    with_views(
        "turnover_markets",
        "m1b",
        extra=BOUND,
        body="""SELECT t.trade_date::VARCHAR AS trade_date, t.revision::BIGINT AS revision, t.status, t.total, b.dataset AS m1b_dataset, b.period AS m1b_period,
            b.revision::BIGINT AS m1b_revision, b.value_twd AS m1b_twd, strftime(b.available_at, '%Y-%m-%d %H:%M:%S.%f') AS m1b_available_at
            FROM t LEFT JOIN (SELECT * FROM best WHERE r2 = 1) b ON b.trade_date = t.trade_date""",
    ),
)
def q_asof_bound(spark, sf_dir):
    """Newest turnover revision of each day with the money supply public then: datasets, revocations and bindings apply."""
    n = d.day_number("trade_date")
    later = F.col("revision") == 2
    gone = later & (n % 35 == 0)
    turnover = _turnover(spark, sf_dir).withColumn("revision", F.explode(F.when(n % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    moved = F.when(later, F.col("available_at") + F.expr("interval 40 days")).otherwise(F.col("available_at"))
    turnover = turnover.withColumns(
        {
            "status": F.when(gone, "revoked").otherwise(F.col("status")),
            "total": F.when(~gone, F.when(later, F.col("total") + 1000.0).otherwise(F.col("total"))),
            "available_at": moved,
            "ingested_at": moved,
        }
    )
    m = d.m1b(spark, sf_dir)
    month = F.substring("period", 6, 2).cast("int")
    pid = F.concat_ws("-", "period", F.col("revision").cast("string"))
    evidence = m.where(month != 7).select(
        pid.alias("publication_evidence_id"),
        "period",
        F.col("revision").alias("revision_number"),
        F.when(F.col("revision") % 3 == 0, "candidate").otherwise("accepted").alias("status"),
        F.col("available_at").alias("ingested_at"),
    )
    second = F.col("dataset") == "B"
    rows = m.withColumn("dataset", F.explode(F.when(month % 3 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))))
    rows = rows.withColumns(
        {
            "value_twd": F.when(second, F.col("value_twd") * 2.0).otherwise(F.col("value_twd")),
            **{c: F.when(second, F.col(c) + F.expr("interval 1 day")).otherwise(F.col(c)) for c in ("available_at", "ingested_at")},
            "publication_evidence_id": F.when(month % 4 != 3, pid),
        }
    )
    out = lq.asof_bound_m1b(turnover, rows, evidence, LIQ_CUTOFF)
    return out.select("trade_date", "revision", "status", "total", "m1b_dataset", "m1b_period", "m1b_revision", "m1b_twd", "m1b_available_at")


@query(
    "data_quality_dates",
    with_views(
        "raw_bars",
        "calendar",
        extra={
            "bounds": "SELECT symbol, min(date) AS lo, max(date) AS hi FROM raw_bars GROUP BY symbol",
            "holes": """SELECT b.symbol, c.date FROM bounds b JOIN calendar c ON c.date BETWEEN b.lo AND b.hi
                ANTI JOIN raw_bars p ON p.symbol = b.symbol AND p.date = c.date""",
        },
        body="""SELECT symbol, 'missing_reference_date' AS finding, date::VARCHAR AS date FROM holes
            UNION ALL SELECT DISTINCT symbol, 'zero_volume', date::VARCHAR FROM raw_bars WHERE volume <= 0
            UNION ALL SELECT symbol, 'duplicate_date', date::VARCHAR FROM raw_bars GROUP BY symbol, date HAVING count(*) > 1""",
    ),
)
def q_quality_dates(spark, sf_dir):
    return qa.quality_dates(d.raw_bars(spark, sf_dir), d.calendar(spark, sf_dir))


def _reasons(*checks: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in checks) + ")"


REVISION_CHECKS = (
    ("profile_id_missing", "k % 29 = 0"),
    ("revision_number_invalid", "k % 4 = 0"),
    ("first_revision_has_parent", "k % 4 = 1 AND k % 3 = 0"),
    ("parent_missing", "k % 4 > 1 AND k % 3 <> 0"),
)


def _revision_columns(k):
    return [
        F.when(k % 29 == 0, " ").otherwise(F.concat(F.lit("L"), k.cast("string"))).alias("logical_profile_id"),
        (k % 4).alias("revision_number"),
        F.when(k % 3 == 0, "parent").alias("revision_of"),
        F.when(k % 19 == 0, "").otherwise("analyst").alias("created_by"),
        F.lit("reviewed").alias("rationale"),
    ]


@query(
    "synthesis_profile_validation",
    with_views(
        extra={
            "c": """SELECT c_custkey AS k, 1 + k % 3 AS m1, 2 + k % 2 AS m2, k % 4 AS r1, (k // 4) % 4 AS r2, k % 8 <> 0 AS filled FROM customer""",
        },
        body=f"""SELECT k, {_reasons(
            *REVISION_CHECKS,
            ("global_scope_has_value", "k % 5 = 0 AND k % 2 = 0"),
            ("scope_value_missing", "k % 5 <> 0 AND k % 11 = 0"),
            ("families_missing", "k % 6 = 0"),
            ("family_unsupported", "k % 6 = 1"),
            ("tolerance_range", "k % 13 IN (0, 11, 12)"),
            ("strength_missing", "NOT filled"),
            ("strength_below_two", "filled AND (m1 < 2 OR m2 < 2)"),
            ("strength_not_increasing", "filled AND m2 <= m1"),
            ("strength_label_invalid", "filled AND (r1 = 3 OR r2 = 3 OR r1 = r2)"),
            ("strength_label_order", "filled AND r1 <> 3 AND r2 <> 3 AND r2 <= r1"),
            ("rounding_mode_not_fixed", "k % 17 = 0"),
            ("author_missing", "k % 19 = 0"),
        )} AS reasons FROM c""",
    ),
)
def q_synthesis_validation(spark, sf_dir):
    k = F.col("c_custkey")
    label = F.array(*[F.lit(x) for x in (*va.STRENGTH_LABELS, "odd")])
    steps = F.array(
        F.struct((1 + k % 3).alias("minimum"), F.get(label, (k % 4).cast("int")).alias("label")),
        F.struct((2 + k % 2).alias("minimum"), F.get(label, F.expr("cast((c_custkey div 4) % 4 as int)")).alias("label")),
    )
    usual = F.array(F.lit("VAL-01"), F.lit("FB-03"))
    rows = d.table(spark, sf_dir, "customer").select(
        k.alias("k"),
        *_revision_columns(k),
        F.when(k % 5 == 0, "global").otherwise("symbol").alias("scope"),
        F.when(k % 5 == 0, F.when(k % 2 == 0, "X")).when(k % 11 != 0, F.concat(F.lit("C"), k.cast("string"))).alias("scope_value"),
        F.when(k % 6 == 0, F.slice(usual, 1, 0)).when(k % 6 == 1, F.array(F.lit("VAL-01"), F.lit("XX-01"))).otherwise(usual).alias("allowed_method_families"),
        ((k % 13 - 1) / 10.0).alias("overlap_tolerance"),
        F.when(k % 8 == 0, F.slice(steps, 1, 0)).otherwise(steps).alias("evidence_strength_policy"),
        *[F.lit(v).alias(name) for name, v in va.SYNTHESIS_POLICIES.items() if name != "rounding_mode"],
        F.when(k % 17 == 0, "ROUND_DOWN").otherwise(va.SYNTHESIS_POLICIES["rounding_mode"]).alias("rounding_mode"),
    )
    return va.validate(rows, va.synthesis_profile_rules()).select("k", "reasons")


@query(
    "evaluation_profile_validation",
    with_views(
        extra={"c": "SELECT c_custkey AS k FROM customer"},
        body=f"""SELECT k, {_reasons(
            *REVISION_CHECKS,
            ("horizons_not_fixed", "k % 7 IN (0, 1)"),
            ("start_policy_not_fixed", "k % 17 = 0"),
            ("author_missing", "k % 19 = 0"),
        )} AS reasons FROM c""",
    ),
)
def q_evaluation_validation(spark, sf_dir):
    k = F.col("c_custkey")
    horizons = F.when(k % 7 == 0, F.array(F.lit(20))).when(k % 7 == 1, F.array(F.lit(20), F.lit(60), F.lit(90)))
    rows = d.table(spark, sf_dir, "customer").select(
        k.alias("k"),
        *_revision_columns(k),
        horizons.when(k % 7 == 2, F.array(F.lit(60), F.lit(20), F.lit(60))).otherwise(F.array(F.lit(20), F.lit(60))).alias("horizons_sessions"),
        *[F.lit(v).alias(name) for name, v in va.EVALUATION_POLICIES.items() if name != "start_policy"],
        F.when(k % 17 == 0, "same_session").otherwise(va.EVALUATION_POLICIES["start_policy"]).alias("start_policy"),
    )
    return va.validate(rows, va.evaluation_profile_rules()).select("k", "reasons")


@query(
    "resource_revision_validation",
    with_views(
        extra={
            "r": """SELECT o_orderkey AS k, o_orderkey % 9 AS e, o_orderkey % 4 AS q, CASE WHEN k % 6 <> 0 THEN k % 5 END AS av, CASE WHEN k % 4 <> 0 THEN k % 3 END AS pub,
                k % 7 AS rec, k % 8 AS ing FROM orders""",
        },
        body=f"""SELECT k, {_reasons(
            ("identity_missing", "k % 23 = 0"),
            ("hash_invalid", "k % 31 = 0"),
            ("ingested_before_received", "ing < rec"),
            ("available_before_published", "av < pub"),
            ("available_after_received", "av > rec"),
            ("eligible_without_available_at", "e > 2 AND av IS NULL"),
            ("eligible_quality_unusable", "e > 2 AND q > 1"),
            ("review_quality_mismatch", "e BETWEEN 1 AND 2 AND q <> 2"),
        )} AS reasons FROM r""",
    ),
)
def q_resource_validation(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")

    def after(n):
        return F.date_add(day, (k % n).cast("int")).cast("timestamp")

    digest = F.sha2(k.cast("string"), 256)
    quality = F.array(*[F.lit(x) for x in (*va.USABLE_QUALITY, va.AWAITING, "stale")])
    rows = d.table(spark, sf_dir, "orders").select(
        k.alias("k"),
        *[F.concat(F.lit(c[:3]), k.cast("string")).alias(c) for c in va.RESOURCE_IDENTITY if c != "parser_version"],
        F.when(k % 23 == 0, "  ").otherwise("1").alias("parser_version"),
        F.when(k % 31 == 0, F.upper(F.concat(F.lit("x"), digest))).otherwise(digest).alias("raw_payload_sha256"),
        digest.alias("schema_fingerprint"),
        after(7).alias("received_at"),
        after(8).alias("ingested_at"),
        F.when(k % 4 != 0, after(3)).alias("source_published_at"),
        F.when(k % 6 != 0, after(5)).alias("available_at"),
        F.when(k % 9 == 0, "blocked").when(k % 9 <= 2, va.AWAITING).otherwise(va.ELIGIBLE).alias("eligibility_status"),
        F.get(quality, (k % 4).cast("int")).alias("quality_status"),
    )
    return va.validate(rows, va.resource_revision_rules()).select("k", "reasons")
