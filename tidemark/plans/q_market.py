"""Queries on market liquidity and fundamentals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import fundamentals as fu, liquidity as lq
from tidemark.plans import domain as d
from tidemark.plans.domain_sql import half_up, with_views
from tidemark.plans.registry import query

LIQ_CUTOFF = "2001-06-30 00:00:00"
LC = "TIMESTAMP '2001-06-30'"
SHORT, LONG = (1, 200), (3, 600)

TURN = {
    "tv": """SELECT trade_date, max(value) FILTER (market = 'A') AS market_a, max(value) FILTER (market = 'B') AS market_b,
        date_diff('day', DATE '1995-01-01', trade_date) % 41 = 0 AS revoked FROM turnover_markets GROUP BY trade_date""",
    "turnover": """SELECT trade_date, market_a, market_b,
        CASE WHEN NOT revoked AND market_a IS NOT NULL AND market_b IS NOT NULL THEN market_a + market_b END AS total,
        CASE WHEN revoked THEN 'revoked' WHEN market_a IS NOT NULL AND market_b IS NOT NULL THEN 'available'
             ELSE 'partial' END AS status, (trade_date + 1)::TIMESTAMP AS available_at FROM tv""",
}
ASOF = {
    **TURN,
    "t": f"SELECT *, least(available_at, {LC}) AS public_at FROM turnover WHERE available_at <= {LC}",
    "vis": f"""SELECT t.trade_date, m.*, row_number() OVER (PARTITION BY t.trade_date, period
        ORDER BY revision DESC, m.available_at DESC) AS rn
        FROM t JOIN m1b m ON m.available_at <= t.public_at AND m.ingested_at <= {LC}""",
    "best": """SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY available_at DESC, period DESC, revision DESC) AS r2
        FROM vis WHERE rn = 1 AND status = 'available'""",
    "joined": """SELECT t.trade_date, t.status, t.total, b.period AS m1b_period, b.revision AS m1b_revision,
        b.value_twd AS m1b_twd, b.available_at AS m1b_available_at
        FROM t LEFT JOIN (SELECT * FROM best WHERE r2 = 1) b ON b.trade_date = t.trade_date""",
}
OBS = {
    **ASOF,
    "obs": f"""SELECT trade_date, total, m1b_twd, {half_up('total / m1b_twd * 1e2', 8)} AS ratio_pct FROM joined
        WHERE status = 'available' AND total > 0 AND m1b_twd > 0""",
}


def _pct(name: str, years: int, minimum: int) -> dict[str, str]:
    return {
        f"{name}0": f"""SELECT o.trade_date, count(*) AS n, count(*) FILTER (h.ratio_pct <= o.ratio_pct) AS below,
            (SELECT min(trade_date) FROM obs) <= (o.trade_date - INTERVAL {years} YEAR)::DATE AS covers
            FROM obs o JOIN obs h ON h.trade_date BETWEEN (o.trade_date - INTERVAL {years} YEAR)::DATE AND o.trade_date
            GROUP BY o.trade_date""",
        name: f"""SELECT trade_date, n, CASE WHEN covers AND n >= {minimum}
            THEN {half_up('below::DOUBLE / n::DOUBLE * 1e2', 4)} END AS pct FROM {name}0""",
    }


HIST = {
    **OBS,
    **_pct("ps", *SHORT),
    **_pct("pl", *LONG),
    "hist": """SELECT o.trade_date, o.ratio_pct, ps.pct AS percentile_short, ps.n AS observations_short,
        pl.pct AS percentile_long, pl.n AS observations_long,
        CASE WHEN o.ratio_pct BETWEEN 3.3e0 AND 3.4e0 THEN 'reference_extreme_case'
             WHEN coalesce(ps.pct, pl.pct) >= 95 THEN 'historically_high'
             WHEN coalesce(ps.pct, pl.pct) >= 80 THEN 'elevated' ELSE 'normal' END AS alert_level
        FROM obs o JOIN ps ON ps.trade_date = o.trade_date JOIN pl ON pl.trade_date = o.trade_date""",
}


def _turnover(spark, sf_dir):
    markets = d.turnover_markets(spark, sf_dir)
    revoked = markets.where(d.day_number("trade_date") % 41 == 0)
    out = lq.turnover_status(markets, revoked)
    ready = F.date_add("trade_date", 1).cast("timestamp")
    return out.withColumns({"available_at": ready, "ingested_at": ready})


def _joined(spark, sf_dir):
    return lq.asof_m1b(_turnover(spark, sf_dir), d.m1b(spark, sf_dir), LIQ_CUTOFF)


def _obs(spark, sf_dir):
    return lq.ratio_observations(_joined(spark, sf_dir))


@query(
    "turnover_status",
    with_views(
        "turnover_markets",
        extra=TURN,
        body="SELECT trade_date::VARCHAR AS trade_date, market_a, market_b, total, status FROM turnover",
    ),
)
def q_turnover(spark, sf_dir):
    return _turnover(spark, sf_dir).drop("available_at", "ingested_at")


@query(
    "asof_m1b",
    with_views(
        "turnover_markets",
        "m1b",
        extra=ASOF,
        body="""SELECT trade_date::VARCHAR AS trade_date, status, total, m1b_period, m1b_revision::BIGINT AS m1b_revision, m1b_twd,
            strftime(m1b_available_at, '%Y-%m-%d %H:%M:%S.%f') AS m1b_available_at FROM joined""",
    ),
)
def q_asof_m1b(spark, sf_dir):
    return _joined(spark, sf_dir).select(
        "trade_date", "status", "total", "m1b_period", "m1b_revision", "m1b_twd", "m1b_available_at"
    )


@query(
    "publication_binding",
    with_views(
        "m1b",
        extra={
            "ev": """SELECT period || '-' || revision AS pid, period, revision, available_at AS ing,
                CASE WHEN revision % 3 = 0 THEN 'candidate' ELSE 'accepted' END AS st FROM m1b WHERE substr(period, 6, 2) <> '07'""",
            "mb": """SELECT *, CASE WHEN substr(period, 6, 2)::INT % 4 <> 3 THEN period || '-' || revision END AS bid FROM m1b""",
            "la": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY revision DESC, ing DESC, pid DESC) AS rn
                FROM ev WHERE ing <= {LC}) WHERE rn = 1""",
            "st": """SELECT mb.period, mb.revision, CASE WHEN la.pid IS NULL AND bid IS NULL THEN 'unbound_no_publication_evidence'
                WHEN la.st = 'accepted' AND la.pid = bid THEN 'exact_accepted_binding'
                WHEN la.pid IS NOT NULL AND la.pid IS DISTINCT FROM bid THEN 'binding_mismatch'
                ELSE 'bound_evidence_not_accepted' END AS s FROM mb LEFT JOIN la ON la.period = mb.period""",
        },
        body="""SELECT period, revision::BIGINT AS revision, s AS publication_binding_status,
            s IN ('unbound_no_publication_evidence', 'exact_accepted_binding') AS eligible FROM st""",
    ),
)
def q_binding(spark, sf_dir):
    m = d.m1b(spark, sf_dir)
    pid = F.concat_ws("-", "period", F.col("revision").cast("string"))
    month = F.substring("period", 6, 2)
    evidence = m.where(month != "07").select(
        pid.alias("publication_evidence_id"),
        "period",
        F.col("revision").alias("revision_number"),
        F.when(F.col("revision") % 3 == 0, "candidate").otherwise("accepted").alias("status"),
        F.col("available_at").alias("ingested_at"),
    )
    rows = m.withColumn("publication_evidence_id", F.when(month.cast("int") % 4 != 3, pid))
    out = lq.publication_binding(rows, evidence, LIQ_CUTOFF)
    return out.select("period", "revision", "publication_binding_status", "eligible")


@query(
    "liquidity_ratio_rolling",
    with_views(
        "turnover_markets",
        "m1b",
        extra=OBS,
        body=f"""SELECT trade_date::VARCHAR AS trade_date, ratio_pct,
            CASE WHEN count(*) OVER a = 20 THEN {half_up('avg(ratio_pct) OVER a', 8)} END AS rolling_mean_20, count(*) OVER a AS rolling_count_20,
            CASE WHEN count(*) OVER b = 60 THEN {half_up('avg(ratio_pct) OVER b', 8)} END AS rolling_mean_60, count(*) OVER b AS rolling_count_60
            FROM obs WINDOW a AS (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
              b AS (ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    ),
)
def q_rolling(spark, sf_dir):
    out = lq.rolling_ratio(_obs(spark, sf_dir))
    return out.select(
        "trade_date", "ratio_pct", "rolling_mean_20", "rolling_count_20", "rolling_mean_60", "rolling_count_60"
    )


@query(
    "liquidity_percentile",
    with_views(
        "turnover_markets",
        "m1b",
        extra=HIST,
        body="SELECT trade_date::VARCHAR AS trade_date, pct AS percentile, n AS observations FROM ps",
    ),
)
def q_percentile(spark, sf_dir):
    return lq.trailing_percentile(_obs(spark, sf_dir), *SHORT)


@query(
    "liquidity_alert",
    with_views(
        "turnover_markets",
        "m1b",
        extra=HIST,
        body="""SELECT trade_date::VARCHAR AS trade_date, ratio_pct, percentile_short, observations_short, percentile_long,
            observations_long, alert_level FROM hist""",
    ),
)
def q_alert(spark, sf_dir):
    out = lq.liquidity_history(_obs(spark, sf_dir), SHORT, LONG)
    return out.select(
        "trade_date",
        "ratio_pct",
        "percentile_short",
        "observations_short",
        "percentile_long",
        "observations_long",
        "alert_level",
    )


@query(
    "liquidity_latest",
    with_views(
        "turnover_markets",
        "m1b",
        extra={
            **HIST,
            "x": """SELECT j.trade_date, j.status AS ts, h.ratio_pct, h.alert_level FROM joined j
                LEFT JOIN hist h ON h.trade_date = j.trade_date ORDER BY j.trade_date DESC LIMIT 1""",
        },
        body="""SELECT trade_date::VARCHAR AS trade_date, CASE WHEN ts = 'partial' THEN 'partial'
            WHEN ts = 'revoked' OR ratio_pct IS NULL THEN 'insufficient_data' ELSE 'available' END AS status,
            CASE WHEN ts = 'partial' THEN 'both_market_turnovers_are_required' WHEN ts = 'revoked' THEN 'latest_market_turnover_revoked'
                 WHEN ratio_pct IS NULL THEN 'm1b_unavailable_for_latest_turnover' END AS reason,
            ratio_pct, coalesce(alert_level, 'insufficient_data') AS alert_level FROM x""",
    ),
)
def q_latest(spark, sf_dir):
    joined = _joined(spark, sf_dir)
    return lq.latest_liquidity(joined, lq.liquidity_history(lq.ratio_observations(joined), SHORT, LONG))


@query(
    "turnover_overheat",
    with_views(
        "turnover_markets",
        "m1b",
        extra=ASOF,
        body=f"""SELECT trade_date::VARCHAR AS trade_date,
            CASE WHEN coalesce(total > 0 AND m1b_twd > 0, false) THEN 'available' ELSE 'insufficient_data' END AS status,
            CASE WHEN total > 0 AND m1b_twd > 0 THEN {half_up('total / m1b_twd', 6)} END AS ratio,
            CASE WHEN total > 0 AND m1b_twd > 0 THEN {half_up('total / m1b_twd', 6)} >= 2e-2 END AS is_overheat FROM joined""",
    ),
)
def q_overheat(spark, sf_dir):
    return lq.overheat(_joined(spark, sf_dir))


@query(
    "latest_within_days",
    with_views(
        "turnover_markets",
        extra=TURN,
        body="""SELECT trade_date::VARCHAR AS trade_date, total FROM turnover WHERE status = 'available'
            AND trade_date BETWEEN DATE '1999-06-20' AND DATE '1999-06-30' ORDER BY trade_date DESC LIMIT 1""",
    ),
)
def q_within(spark, sf_dir):
    return lq.latest_within_days(_turnover(spark, sf_dir), "1999-06-30")


STMT = {
    "stmt": """SELECT 'S' || l_suppkey AS stock_id, last_day(l_shipdate::DATE) AS period_end,
        l_shipdate::DATE + 30 AS origin_date,
        round(l_extendedprice * 100)::BIGINT::DOUBLE / 1e6 * month(l_shipdate) / 3e0 AS value FROM lineitem""",
    "fl": """SELECT *, year(period_end) AS year, month(period_end) // 3 AS quarter,
        row_number() OVER (PARTITION BY stock_id, period_end ORDER BY origin_date DESC, value DESC) AS rn
        FROM stmt WHERE month(period_end) % 3 = 0""",
    "qt": f"""SELECT stock_id, period_end, origin_date AS available_at, year, quarter,
        {half_up('value - coalesce(lag(value) OVER (PARTITION BY stock_id, year ORDER BY quarter), 0)', 2)} AS single_quarter_eps
        FROM fl WHERE rn = 1""",
}


def _quarters(spark, sf_dir):
    li = d.table(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate").cast("date")
    statements = li.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("stock_id"),
        F.last_day(day).alias("period_end"),
        F.date_add(day, 30).alias("origin_date"),
        (d.cents("l_extendedprice").cast("double") / 1000000.0 * F.month(day) / 3.0).alias("value"),
    )
    return fu.quarterly_eps(statements)


@query(
    "decumulated_quarters",
    with_views(
        extra=STMT,
        body="""SELECT stock_id, period_end::VARCHAR AS period_end, available_at::VARCHAR AS available_at, year::BIGINT AS year,
            quarter::BIGINT AS quarter, single_quarter_eps FROM qt""",
    ),
)
def q_quarters(spark, sf_dir):
    return _quarters(spark, sf_dir)


@query(
    "ttm_sum",
    with_views(
        extra={
            **STMT,
            "k": """SELECT *, year * 4 + quarter AS o, row_number() OVER (PARTITION BY stock_id ORDER BY year * 4 + quarter DESC) AS rk
                FROM qt WHERE available_at <= DATE '1999-06-30'""",
            "g": """SELECT stock_id, count(*) AS n, max(o) - min(o) AS span, sum(single_quarter_eps::DECIMAL(18,4)) AS s,
                arg_max(period_end, o) AS pe, arg_max(available_at, o) AS av FROM k WHERE rk <= 4 GROUP BY 1""",
        },
        body=f"""SELECT stock_id, CASE WHEN n = 4 AND span = 3 THEN 'available' ELSE 'insufficient_data' END AS status,
            CASE WHEN n < 4 THEN 'fewer_than_four_quarters' WHEN span <> 3 THEN 'quarters_not_consecutive' END AS reason,
            CASE WHEN n = 4 AND span = 3 THEN {half_up('s', 2)} END AS ttm_eps,
            CASE WHEN n = 4 AND span = 3 THEN pe::VARCHAR END AS period_end,
            CASE WHEN n = 4 AND span = 3 THEN av::VARCHAR END AS available_at FROM g""",
    ),
)
def q_ttm(spark, sf_dir):
    return fu.ttm_eps(_quarters(spark, sf_dir), "1999-06-30")


@query(
    "balance_growth",
    with_views(
        "bars",
        extra={
            "r": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars",
            "g": """SELECT symbol, count(*) AS n, arg_max(volume, date) AS last, arg_min(volume, date) AS first
                FROM r WHERE rn <= 60 GROUP BY 1""",
        },
        body=f"""SELECT symbol, CASE WHEN n >= 20 THEN 'available' ELSE 'insufficient_data' END AS status, n AS observation_count,
            CASE WHEN n >= 20 THEN last END AS recent_balance, CASE WHEN n >= 20 THEN {half_up('(last - first) / first', 4)} END AS growth_rate,
            CASE WHEN n >= 20 THEN (last - first) / first >= 8e-2 END AS is_overheat FROM g""",
    ),
)
def q_growth(spark, sf_dir):
    balances = d.bars(spark, sf_dir).select("symbol", "date", F.col("volume").alias("balance"))
    return fu.balance_growth(balances)
