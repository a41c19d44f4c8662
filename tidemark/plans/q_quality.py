"""Queries on panel quality, reconciliation and gap reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import gaps as gp, quality as qa
from tidemark.plans import domain as d
from tidemark.plans.domain_sql import ASKED, half_up, with_views
from tidemark.plans.registry import ORACLES, query

START, END = "1995-01-01", "2001-12-31"

GAPS = {
    "bounds": "SELECT symbol, min(date) AS lo, max(date) AS hi FROM provider GROUP BY symbol",
    "gaps": """SELECT b.symbol, c.date FROM bounds b JOIN calendar c ON c.date BETWEEN b.lo AND b.hi
        ANTI JOIN provider p ON p.symbol = b.symbol AND p.date = c.date""",
}
CLASSIFIED = {
    **GAPS,
    "acts": """SELECT symbol, event_date AS date, string_agg(event_type, ',' ORDER BY event_type) AS corporate_actions
        FROM actions GROUP BY ALL""",
    "classified": """SELECT g.symbol, g.date, CASE WHEN o.symbol IS NULL THEN 'security_no_trade_or_suspended'
        WHEN coalesce(o.volume, 0) <= 0 THEN 'official_zero_volume'
        WHEN o.open IS NULL OR o.high IS NULL OR o.low IS NULL OR o.close IS NULL THEN 'official_trade_without_ohlc'
        ELSE 'provider_missing_official_trade' END AS classification, o.volume AS official_volume,
        coalesce(a.corporate_actions, '') AS corporate_actions
        FROM gaps g LEFT JOIN official o ON o.symbol = g.symbol AND o.date = g.date
        LEFT JOIN acts a ON a.symbol = g.symbol AND a.date = g.date""",
}
PONLY = {
    "ponly": f"""SELECT DISTINCT symbol, date FROM provider p ANTI JOIN calendar c ON c.date = p.date
        WHERE date BETWEEN DATE '{START}' AND DATE '{END}'""",
}


def _gaps(spark, sf_dir):
    return qa.calendar_gaps(d.provider(spark, sf_dir), d.calendar(spark, sf_dir))


def _classified(spark, sf_dir):
    return qa.classify_gaps(_gaps(spark, sf_dir), d.official(spark, sf_dir), d.actions(spark, sf_dir))


@query(
    "clean_panel",
    with_views("clean", body="SELECT symbol, date::VARCHAR AS date, open, high, low, close, volume FROM clean"),
)
def q_clean(spark, sf_dir):
    return qa.clean_ohlcv(d.raw_bars(spark, sf_dir))


@query(
    "zero_volume_audit",
    with_views(
        "raw_bars",
        body="""SELECT symbol, count(*) FILTER (volume <= 0) AS zero_volume_rows,
            coalesce(string_agg(DISTINCT date::VARCHAR, ',' ORDER BY date::VARCHAR) FILTER (volume <= 0), '') AS zero_volume_dates
            FROM raw_bars GROUP BY symbol""",
    ),
)
def q_zero_volume(spark, sf_dir):
    return qa.zero_volume_audit(d.raw_bars(spark, sf_dir))


@query(
    "data_quality_profile",
    with_views(
        "raw_bars",
        "calendar",
        extra={
            "r": """SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, date_diff('day', lag(date) OVER w, date) AS gap,
                coalesce(date < lag(date) OVER (PARTITION BY symbol ORDER BY ingest_order, date), false) AS back
                FROM raw_bars WINDOW w AS (PARTITION BY symbol ORDER BY date, ingest_order)""",
            "f": f"""SELECT symbol, count(*) AS row_count, min(date) AS lo, max(date) AS hi,
                count(*) - count(DISTINCT date) AS duplicate_dates,
                count(*) FILTER (open IS NULL) AS missing_open, count(*) FILTER (high IS NULL) AS missing_high,
                count(*) FILTER (low IS NULL) AS missing_low, count(*) FILTER (close IS NULL) AS missing_close,
                count(*) FILTER (volume IS NULL) AS missing_volume,
                count(*) FILTER (high < low OR open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS invalid_price_rows,
                count(*) FILTER (volume <= 0) AS zero_volume_rows, count(*) FILTER (abs(ret) >= 25e-2) AS large_return_rows,
                {half_up('max(abs(ret)) * 1e2', 4)} AS max_abs_return_pct, coalesce(max(gap), 0) AS max_calendar_gap_days,
                bool_or(back) AS non_monotonic_dates FROM r GROUP BY symbol""",
            "m": """SELECT f.symbol, count(*) AS n FROM f JOIN calendar c ON c.date BETWEEN f.lo AND f.hi
                ANTI JOIN raw_bars p ON p.symbol = f.symbol AND p.date = c.date GROUP BY 1""",
        },
        body="""SELECT symbol, row_count, lo::VARCHAR AS start_date, hi::VARCHAR AS end_date, duplicate_dates, missing_open,
            missing_high, missing_low, missing_close, missing_volume, invalid_price_rows, zero_volume_rows, large_return_rows,
            max_abs_return_pct, max_calendar_gap_days, non_monotonic_dates, coalesce(n, 0) AS missing_reference_dates,
            CASE WHEN greatest(duplicate_dates, invalid_price_rows, zero_volume_rows, large_return_rows, coalesce(n, 0),
                missing_open, missing_high, missing_low, missing_close, missing_volume) > 0
                THEN 'quality_warning' ELSE 'available' END AS status FROM f LEFT JOIN m USING (symbol)""",
    ),
)
def q_quality(spark, sf_dir):
    return qa.data_quality_profile(d.raw_bars(spark, sf_dir), d.calendar(spark, sf_dir))


@query(
    "data_quality_profile_asked",
    f"""SELECT a.symbol, q.* EXCLUDE (symbol) REPLACE (coalesce(row_count, 0) AS row_count, coalesce(status, 'insufficient_data') AS status)
        FROM ({ASKED}) a LEFT JOIN ({ORACLES["data_quality_profile"]}) q ON q.symbol = a.symbol""",
)
def q_quality_asked(spark, sf_dir):
    return qa.data_quality_profile(d.raw_bars(spark, sf_dir), d.calendar(spark, sf_dir), symbols=d.asked_symbols(spark, sf_dir))


@query(
    "calendar_gaps",
    with_views("provider", "calendar", extra=GAPS, body="SELECT symbol, date::VARCHAR AS date FROM gaps"),
)
def q_gaps(spark, sf_dir):
    return _gaps(spark, sf_dir)


@query(
    "provider_only_days",
    with_views("provider", "calendar", extra=PONLY, body="SELECT symbol, date::VARCHAR AS date FROM ponly"),
)
def q_provider_only(spark, sf_dir):
    return qa.provider_only_days(d.provider(spark, sf_dir), d.calendar(spark, sf_dir), START, END)


@query(
    "month_audit",
    with_views(
        "calendar",
        "bench",
        extra={
            "b": """SELECT DISTINCT date FROM bench WHERE date_diff('day', DATE '1995-01-01', date) % 19 <> 0""",
            "j": "SELECT coalesce(c.date, b.date) AS date, c.date AS cd, b.date AS bd FROM calendar c FULL JOIN b ON b.date = c.date",
        },
        body="""SELECT strftime(date, '%Y-%m') AS month, count(*) FILTER (bd IS NULL) AS calendar_only,
            count(*) FILTER (cd IS NULL) AS reference_only, count(*) FILTER (cd IS NOT NULL AND bd IS NOT NULL) AS shared
            FROM j GROUP BY 1""",
    ),
)
def q_month_audit(spark, sf_dir):
    ref = d.benchmark(spark, sf_dir).where(d.day_number() % 19 != 0)
    return qa.month_audit(d.calendar(spark, sf_dir), ref)


@query(
    "gap_classification",
    with_views(
        "provider",
        "official",
        "calendar",
        "actions",
        extra=CLASSIFIED,
        body="SELECT symbol, date::VARCHAR AS date, classification, official_volume, corporate_actions FROM classified",
    ),
)
def q_classified(spark, sf_dir):
    return _classified(spark, sf_dir)


_COUNTS = ", ".join(f"count(*) FILTER (classification = '{c}') AS {c}" for c in qa.CLASSES)
_WARN = ", ".join(f"coalesce({c}, 0)" for c in qa.WARNING_CLASSES)


@query(
    "audit_summary",
    with_views(
        "provider",
        "official",
        "calendar",
        "actions",
        extra={
            **CLASSIFIED,
            **PONLY,
            "found": "SELECT symbol, classification FROM classified UNION ALL SELECT symbol, 'provider_row_on_non_market_day' FROM ponly",
            "c": f"SELECT symbol, {_COUNTS} FROM found GROUP BY symbol",
        },
        body="SELECT s.symbol, "
        + ", ".join(f"coalesce({c}, 0) AS {c}" for c in qa.CLASSES)
        + f", CASE WHEN greatest({_WARN}) > 0 THEN 'quality_warning' ELSE 'available' END AS official_integrity_status"
        + " FROM (SELECT 'S' || s_suppkey AS symbol FROM supplier) s LEFT JOIN c ON c.symbol = s.symbol",
    ),
)
def q_audit(spark, sf_dir):
    symbols = d.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol")
    )
    only = qa.provider_only_days(d.provider(spark, sf_dir), d.calendar(spark, sf_dir), START, END)
    return qa.audit_summary(symbols, _classified(spark, sf_dir), only)


SEG = """coalesce((SELECT max(event_date)::VARCHAR FROM actions a WHERE a.symbol = {t}.symbol AND a.event_date <= {t}.date),
    'before_first_known_action')"""


@query(
    "action_segments",
    with_views(
        "official",
        "actions",
        body=f"SELECT symbol, date::VARCHAR AS date, {SEG.format(t='official')} AS segment FROM official",
    ),
)
def q_segments(spark, sf_dir):
    return gp.action_segments(d.official(spark, sf_dir).select("symbol", "date"), d.actions(spark, sf_dir))


CONSENSUS = {
    "anc0": """SELECT o.symbol, o.date, p.close / o.close AS factor FROM official o JOIN provider p
        ON p.symbol = o.symbol AND p.date = o.date WHERE o.close > 0 AND p.close IS NOT NULL""",
    "anc": f"SELECT *, strftime(date, '%Y-%m') AS month, {SEG.format(t='anc0')} AS segment FROM anc0",
    "mem": """SELECT c.symbol, c.month, c.segment, c.date AS center, string_agg(m.date::VARCHAR, ',' ORDER BY m.date) AS members,
        count(*) AS n, median(m.factor) AS factor
        FROM anc c JOIN anc m ON c.symbol = m.symbol AND c.month = m.month AND c.segment = m.segment
          AND abs(m.factor - c.factor) / greatest(abs(m.factor), abs(c.factor)) <= 1e-6 GROUP BY ALL""",
    "sets": "SELECT DISTINCT symbol, month, segment, members, n, factor FROM mem",
    "top": "SELECT *, max(n) OVER (PARTITION BY symbol, month, segment) AS big FROM sets",
    "cnt": "SELECT symbol, month, segment, count(*) AS anchors FROM anc GROUP BY ALL",
    "cons": """SELECT symbol, month, segment, any_value(anchors) AS candidate_anchor_count, any_value(big) AS largest_consensus_size,
        count(*) AS largest_consensus_group_count,
        CASE WHEN count(*) = 1 AND any_value(big) >= 2 THEN any_value(factor) END AS adjustment_factor,
        CASE WHEN count(*) = 1 AND any_value(big) >= 2 THEN any_value(members) END AS selected_anchors
        FROM top JOIN cnt USING (symbol, month, segment) WHERE n = big GROUP BY ALL""",
}


@query(
    "factor_consensus",
    with_views(
        "official",
        "provider",
        "actions",
        extra=CONSENSUS,
        body="""SELECT symbol, month, segment, candidate_anchor_count, largest_consensus_size, largest_consensus_group_count,
            round(adjustment_factor, 8) AS adjustment_factor, selected_anchors FROM cons""",
    ),
)
def q_consensus(spark, sf_dir):
    anchors = gp.action_segments(
        gp.factor_anchors(d.official(spark, sf_dir), d.provider(spark, sf_dir)), d.actions(spark, sf_dir)
    ).withColumn("month", F.date_format("date", "yyyy-MM"))
    return gp.factor_consensus(anchors).withColumn("adjustment_factor", F.round("adjustment_factor", 8))


GAP_ROWS = {
    **CONSENSUS,
    "tg0": """SELECT o.symbol, o.date FROM official o JOIN numbered n ON n.symbol = o.symbol AND n.date = o.date
        WHERE n.n % 17 = 0 OR n.n % 23 = 0 OR n.n % 29 = 0 OR n.n % 31 = 0
        UNION SELECT 'S' || s_suppkey, DATE '1994-12-01' FROM supplier""",
    "tg": f"SELECT *, strftime(date, '%Y-%m') AS month, {SEG.format(t='tg0')} AS segment FROM tg0",
    "gr": """SELECT t.symbol, t.date, t.segment, o.open AS ro, o.high AS rh, o.low AS rl, o.close AS rc, o.volume AS rv,
        c.adjustment_factor AS f,
        CASE WHEN p.symbol IS NOT NULL THEN 'target_date_already_exists'
             WHEN o.symbol IS NULL THEN 'official_raw_row_unavailable'
             WHEN coalesce(o.volume, 0) <= 0 THEN 'official_raw_volume_not_positive'
             WHEN o.open IS NULL OR o.high IS NULL OR o.low IS NULL OR o.close IS NULL THEN 'official_raw_price_invalid'
             WHEN coalesce(c.candidate_anchor_count, 0) < 2 THEN 'fewer_than_two_same_segment_anchors'
             WHEN c.largest_consensus_size < 2 THEN 'no_factor_consensus'
             WHEN c.largest_consensus_group_count <> 1 THEN 'ambiguous_factor_consensus' END AS reason
        FROM tg t LEFT JOIN provider p ON p.symbol = t.symbol AND p.date = t.date
        LEFT JOIN official o ON o.symbol = t.symbol AND o.date = t.date
        LEFT JOIN cons c ON c.symbol = t.symbol AND c.month = t.month AND c.segment = t.segment""",
}


def _targets(spark, sf_dir):
    n = d.day_number()
    holes = d.official(spark, sf_dir).where((n % 17 == 0) | (n % 23 == 0) | (n % 29 == 0) | (n % 31 == 0))
    early = d.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"),
        F.lit("1994-12-01").cast("date").alias("date"),
    )
    return holes.select("symbol", "date").unionByName(early)


def _gap_rows(spark, sf_dir):
    return gp.adjusted_gap_rows(
        _targets(spark, sf_dir), d.provider(spark, sf_dir), d.official(spark, sf_dir), d.actions(spark, sf_dir)
    )


@query(
    "gap_rows",
    with_views(
        "numbered",
        "official",
        "provider",
        "actions",
        extra=GAP_ROWS,
        body="""SELECT symbol, date::VARCHAR AS date, segment, CASE WHEN reason IS NULL THEN 'available' ELSE 'insufficient_data' END AS status,
            reason, CASE WHEN reason IS NULL THEN round(f, 8) END AS adjustment_factor,
            CASE WHEN reason IS NULL THEN round(ro * f, 4) END AS open, CASE WHEN reason IS NULL THEN round(rh * f, 4) END AS high,
            CASE WHEN reason IS NULL THEN round(rl * f, 4) END AS low, CASE WHEN reason IS NULL THEN round(rc * f, 4) END AS close,
            CASE WHEN reason IS NULL THEN rv END AS volume FROM gr""",
    ),
)
def q_gap_rows(spark, sf_dir):
    out = _gap_rows(spark, sf_dir)
    return out.withColumns(
        {"adjustment_factor": F.round("adjustment_factor", 8), **{c: F.round(c, 4) for c in qa.PRICES}}
    )


PANEL = {
    **GAP_ROWS,
    "panel": """SELECT symbol, date, close, volume, false AS derived FROM provider
        WHERE least(open, high, low, close) > 0 AND high >= low AND volume > 0
        UNION ALL SELECT symbol, date, rc * f, rv, true FROM gr WHERE reason IS NULL AND rh >= rl""",
}


@query(
    "reconciled_panel",
    with_views(
        "numbered",
        "official",
        "provider",
        "actions",
        extra=PANEL,
        body="SELECT symbol, date::VARCHAR AS date, round(close, 4) AS close, volume, derived FROM panel",
    ),
)
def q_reconciled(spark, sf_dir):
    out = gp.reconciled_panel(d.provider(spark, sf_dir), _gap_rows(spark, sf_dir))
    return out.select("symbol", "date", F.round("close", 4).alias("close"), "volume", "derived")


@query(
    "reconcile_status",
    with_views(
        "numbered",
        "official",
        "provider",
        "actions",
        extra={
            **PANEL,
            "a": "SELECT symbol, count(*) AS rows, count(*) FILTER (derived) AS derived_rows FROM panel GROUP BY symbol",
            "b": "SELECT symbol, count(*) FILTER (reason IS NOT NULL) AS unresolved_rows FROM gr GROUP BY symbol",
        },
        body="""SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(rows, 0) AS rows, coalesce(derived_rows, 0) AS derived_rows,
            coalesce(unresolved_rows, 0) AS unresolved_rows,
            CASE WHEN coalesce(unresolved_rows, 0) > 0 THEN 'quality_warning' ELSE 'available' END AS integrity_status
            FROM a FULL JOIN b ON a.symbol = b.symbol""",
    ),
)
def q_reconcile_status(spark, sf_dir):
    derived = _gap_rows(spark, sf_dir)
    return gp.reconcile_status(gp.reconciled_panel(d.provider(spark, sf_dir), derived), derived)


@query(
    "zero_volume_reconcile",
    with_views(
        "raw_bars",
        "provider",
        "calendar",
        extra={
            "off": """SELECT symbol, date, CASE WHEN n % 23 = 0 THEN 0e0 ELSE volume END AS volume FROM numbered WHERE k % 4 <> 0""",
            "z": "SELECT DISTINCT symbol, date FROM raw_bars WHERE volume <= 0",
            "pv": "SELECT DISTINCT symbol, date FROM provider",
        },
        body="""SELECT z.symbol, z.date::VARCHAR AS date, CASE WHEN c.date IS NULL THEN 'provider_non_market_zero_volume_artifact'
            WHEN o.symbol IS NULL THEN 'security_no_trade_or_suspended'
            WHEN coalesce(o.volume, 0) <= 0 THEN 'official_zero_volume'
            WHEN p.symbol IS NOT NULL THEN 'replaced_with_official_positive_volume_row'
            ELSE 'unresolved_official_positive_volume_row' END AS classification,
            c.date IS NULL OR o.symbol IS NULL OR coalesce(o.volume, 0) <= 0 OR p.symbol IS NOT NULL AS resolved,
            o.volume AS official_volume
            FROM z LEFT JOIN calendar c ON c.date = z.date LEFT JOIN off o ON o.symbol = z.symbol AND o.date = z.date
            LEFT JOIN pv p ON p.symbol = z.symbol AND p.date = z.date""",
    ),
)
def q_zero_reconcile(spark, sf_dir):
    removed = d.raw_bars(spark, sf_dir).where("volume <= 0")
    official = d.official(spark, sf_dir).where(d.symbol_number() % 4 != 0)
    return gp.zero_volume_reconcile(removed, d.calendar(spark, sf_dir), official, d.provider(spark, sf_dir))


OVERRIDE_F = "CASE WHEN date < DATE '1998-01-05' THEN 9e-1 ELSE 1e0 END"


@query(
    "override_insert",
    with_views(
        "numbered",
        "official",
        "provider",
        extra={
            "ov": f"""SELECT symbol, date, close, high, low, volume, {OVERRIDE_F} AS f, strftime(date, '%Y-%m') AS month
                FROM numbered WHERE n % 17 = 0 OR n % 31 = 0""",
            "an": """SELECT ov.symbol, ov.date, ov.f, o.date AS ad, o.close AS rc FROM ov JOIN official o
                ON o.symbol = ov.symbol AND strftime(o.date, '%Y-%m') = ov.month
                SEMI JOIN provider p ON p.symbol = o.symbol AND p.date = o.date""",
            "ok": """SELECT an.symbol, an.date, bool_and(coalesce(abs(p.close / an.rc - an.f) <= 1e-6, false)) AS ok
                FROM an LEFT JOIN provider p ON p.symbol = an.symbol AND p.date = an.ad GROUP BY ALL""",
        },
        body="""SELECT ov.symbol, ov.date::VARCHAR AS date, round(ov.close * ov.f, 4) AS close, ov.volume FROM ov
            JOIN ok ON ok.symbol = ov.symbol AND ok.date = ov.date AND ok.ok
            ANTI JOIN provider p ON p.symbol = ov.symbol AND p.date = ov.date""",
    ),
)
def q_override(spark, sf_dir):
    n = d.day_number()
    factor = F.when(F.col("date") < F.lit("1998-01-05").cast("date"), 0.9).otherwise(1.0)
    overrides = d.bars(spark, sf_dir).where((n % 17 == 0) | (n % 31 == 0)).withColumn("adjustment_factor", factor)
    provider = d.provider(spark, sf_dir)
    month = F.date_format("date", "yyyy-MM")
    known = (
        d.official(spark, sf_dir)
        .join(provider.select("symbol", "date"), ["symbol", "date"], "left_semi")
        .select("symbol", month.alias("month"), F.col("date").alias("anchor_date"), F.col("close").alias("raw_close"))
    )
    anchors = overrides.select("symbol", "date", month.alias("month")).join(known, ["symbol", "month"]).drop("month")
    out = gp.override_insert(provider, overrides, anchors)
    return out.select("symbol", "date", F.round("close", 4).alias("close"), "volume")


@query(
    "reference_exemption",
    with_views(
        "provider",
        "official",
        "calendar",
        "actions",
        extra={
            **CLASSIFIED,
            "x": """SELECT symbol, date FROM classified WHERE (classification = 'security_no_trade_or_suspended'
                AND substr(symbol, 2)::INT % 2 = 0) OR (classification = 'official_zero_volume' AND substr(symbol, 2)::INT % 10 = 0)""",
            "m": "SELECT symbol, count(*) AS missing_days FROM gaps GROUP BY 1",
            "v": """SELECT x.symbol, count(*) AS nx, count(*) FILTER (classification <> 'security_no_trade_or_suspended') AS bad
                FROM x JOIN classified c ON c.symbol = x.symbol AND c.date = x.date GROUP BY 1""",
        },
        body="""SELECT symbol, coalesce(bad, 0) = 0 AS exemption_valid, missing_days,
            CASE WHEN coalesce(bad, 0) = 0 THEN missing_days - coalesce(nx, 0) ELSE missing_days END AS unexplained_days,
            CASE WHEN coalesce(bad, 0) > 0 THEN 'exemption_not_evidenced'
                 WHEN missing_days - coalesce(nx, 0) > 0 THEN 'missing_reference_dates' END AS reason
            FROM m LEFT JOIN v USING (symbol)""",
    ),
)
def q_exemption(spark, sf_dir):
    c = _classified(spark, sf_dir)
    k = d.symbol_number()
    quiet = F.col("classification") == "security_no_trade_or_suspended"
    exempt = c.where((quiet & (k % 2 == 0)) | ((F.col("classification") == "official_zero_volume") & (k % 10 == 0)))
    return gp.reference_exemption(c.select("symbol", "date"), exempt, c.where(quiet))


@query(
    "explained_days",
    with_views(
        "calendar",
        "bench",
        body="""SELECT date::VARCHAR AS date FROM (
            SELECT date FROM calendar WHERE date_diff('day', DATE '1995-01-01', date) % 13 = 0
            UNION SELECT date FROM bench WHERE date BETWEEN DATE '1996-01-01' AND DATE '2001-12-31'
              AND date NOT IN (SELECT date FROM calendar))""",
    ),
)
def q_explained(spark, sf_dir):
    cal = d.calendar(spark, sf_dir)
    only = d.benchmark(spark, sf_dir).select("date").join(cal, "date", "left_anti")
    return gp.explained_days(cal.where(d.day_number() % 13 == 0), only, "1996-01-01", "2001-12-31")
