"""Queries over daily bars: averages, pivots, waves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.operators import indicators as ind
from tidemark.plans import domain as d
from tidemark.plans.domain_sql import with_views
from tidemark.plans.registry import query

WAVE_CUTOFF = "2000-12-31"


def _r(c: str, digits: int = 6) -> F.Column:
    return F.round(F.col(c), digits).alias(c)


_SMA_SQL = ",\n".join(
    [
        f"round(CASE WHEN count(close) OVER w{n} = {n} THEN avg(close) OVER w{n} END, 6) AS sma_{n}"
        for n in K.MA_PERIODS
    ]
    + [f"round(lag(close, {n - 1}) OVER w, 6) AS deduct_{n}" for n in K.MA_PERIODS]
    + [f"coalesce(close > lag(close, {n - 1}) OVER w, false) AS slope_up_{n}" for n in K.MA_PERIODS]
)
_SMA_WINDOWS = "WINDOW w AS (PARTITION BY symbol ORDER BY date), " + ", ".join(
    f"w{n} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in K.MA_PERIODS
)
_SMA_CTE = f"SELECT symbol, date, close, {_SMA_SQL} FROM bars {_SMA_WINDOWS}"
_RES = (
    " AND ".join(f"slope_up_{n}" for n in K.RESONANCE_SLOPES)
    + " AND coalesce("
    + " AND ".join(f"sma_{a} > sma_{b}" for a, b in zip(K.RESONANCE_ORDER, K.RESONANCE_ORDER[1:]))
    + ", false)"
)


@query(
    "sma_deduction",
    with_views(
        "bars",
        extra={"s": _SMA_CTE},
        body="SELECT symbol, date::VARCHAR AS date, round(close, 6) AS close, "
        + ", ".join(f"sma_{n}, deduct_{n}, slope_up_{n}" for n in K.MA_PERIODS)
        + " FROM s",
    ),
)
def q_sma_deduction(spark, sf_dir):
    out = ind.sma_deduction(d.bars(spark, sf_dir).select("symbol", "date", "close"))
    cols = ["close"] + [f"{p}_{n}" for n in K.MA_PERIODS for p in ("sma", "deduct")]
    return out.select("symbol", "date", *[_r(c) for c in cols], *[f"slope_up_{n}" for n in K.MA_PERIODS])


@query(
    "resonance_latest",
    with_views(
        "bars",
        extra={
            "s": _SMA_CTE,
            "r": f"SELECT *, ({_RES}) AS resonance FROM s",
            "l": "SELECT *, sum(resonance::INT) OVER (PARTITION BY symbol) AS n_res, "
            "row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM r",
        },
        body="SELECT symbol, date::VARCHAR AS date, round(close, 6) AS close, sma_8, sma_13, sma_21, sma_55, "
        "resonance, n_res::BIGINT AS resonance_bars FROM l WHERE rn = 1",
    ),
)
def q_resonance_latest(spark, sf_dir):
    out = ind.with_resonance(d.bars(spark, sf_dir).select("symbol", "date", "close"))
    tail = F.struct("close", "sma_8", "sma_13", "sma_21", "sma_55", "resonance")
    g = out.groupBy("symbol").agg(
        F.max("date").alias("date"),
        F.max_by(tail, "date").alias("t"),
        F.count_if("resonance").alias("resonance_bars"),
    )
    return g.select(
        "symbol",
        "date",
        *[F.round(f"t.{c}", 6).alias(c) for c in ("close", "sma_8", "sma_13", "sma_21", "sma_55")],
        F.col("t.resonance").alias("resonance"),
        "resonance_bars",
    )


_ADJUSTED = """SELECT symbol, date, close * CASE WHEN date < DATE '1997-01-05' THEN 9.87654e-3 WHEN date < DATE '1999-01-05' THEN 9.91e-3 ELSE 1e-2 END AS close FROM bars"""
_EXACT_SQL = ", ".join(
    f"CASE WHEN count(c) OVER w{n} = {n} THEN ((20 * sum(u) OVER w{n} + {n}) // {2 * n})::DOUBLE / 1e9 END AS sma_{n}, "
    f"coalesce(c > lag(c, {n - 1}) OVER w, false) AS slope_up_{n}"
    for n in K.MA_PERIODS
)


@query(
    "sma_adjusted_prices",
    with_views(
        "bars",
        extra={
            "adj": _ADJUSTED,
            "dec": "SELECT symbol, date, close, c, (c * 100000000)::HUGEINT AS u FROM (SELECT *, close::DECIMAL(26,8) AS c FROM adj)",
            "s": f"SELECT symbol, date, close, {_EXACT_SQL} FROM dec {_SMA_WINDOWS}",
        },
        body=f"SELECT symbol, date::VARCHAR AS date, close, {', '.join(f'sma_{n}' for n in K.MA_PERIODS)}, ({_RES}) AS resonance FROM s",
    ),
)
def q_sma_adjusted(spark, sf_dir):
    """Averages and resonance on fractional, adjusted prices."""
    factor = F.when(F.col("date") < F.lit("1997-01-05").cast("date"), 0.00987654).when(F.col("date") < F.lit("1999-01-05").cast("date"), 0.00991).otherwise(0.01)
    bars = d.bars(spark, sf_dir).select("symbol", "date", (F.col("close") * factor).alias("close"))
    return ind.with_resonance(bars).select("symbol", "date", "close", *[f"sma_{n}" for n in K.MA_PERIODS], "resonance")


@query(
    "breakdown_reversal",
    with_views(
        "bars",
        extra={
            "s": """SELECT symbol, date, close, volume,
                CASE WHEN count(close) OVER p = 5 THEN min(close) OVER p END AS support
                FROM bars WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
            "b": "SELECT *, coalesce(close < support, false)::INT AS broke FROM s",
            "f": """SELECT *, coalesce(count(broke) OVER r = 3 AND max(broke) OVER r = 1 AND close >= lag(support) OVER w
                AND volume > lag(volume) OVER w, false) AS hit FROM b
                WINDOW w AS (PARTITION BY symbol ORDER BY date),
                       r AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
        },
        body="SELECT symbol, date::VARCHAR AS date, round(close, 6) AS close, round(support, 6) AS support, volume FROM f WHERE hit",
    ),
)
def q_breakdown_reversal(spark, sf_dir):
    out = ind.breakdown_reversal(d.bars(spark, sf_dir).select("symbol", "date", "close", "volume"))
    return out.where("breakdown_reversal").select("symbol", "date", _r("close"), _r("support"), "volume")


def pivots_cte(source: str) -> dict[str, str]:
    return {
        "pm": f"""SELECT symbol, date, low, high, row_number() OVER w AS idx, lead(date, 3) OVER w AS confirmed_at,
            low < min(low) OVER b AND min(low) OVER a > low AS is_low,
            high > max(high) OVER b AND max(high) OVER a < high AS is_high
            FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY date),
              b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
              a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""",
        "pivots": """SELECT symbol, 'low' AS pivot_type, date AS pivot_date, idx AS pivot_idx, low AS pivot_price,
              idx + 3 AS confirmed_idx, confirmed_at FROM pm WHERE idx > 5 AND confirmed_at IS NOT NULL AND is_low
            UNION ALL SELECT symbol, 'high', date, idx, high, idx + 3, confirmed_at
              FROM pm WHERE idx > 5 AND confirmed_at IS NOT NULL AND is_high""",
    }


@query(
    "confirmed_pivots",
    with_views(
        "bars",
        extra=pivots_cte("bars"),
        body="""SELECT symbol, pivot_type, pivot_date::VARCHAR AS pivot_date, pivot_idx, pivot_price,
            confirmed_idx, confirmed_at::VARCHAR AS confirmed_at FROM pivots""",
    ),
)
def q_confirmed_pivots(spark, sf_dir):
    return ind.confirmed_pivots(d.bars(spark, sf_dir))


_TARGET_SQL = ", ".join(f"round({base} + (p1 - p0) * {ratio}e0, 2) AS {name}" for name, base, ratio in K.WAVE_TARGETS)
_FIB_CASE = "CASE " + " ".join(f"WHEN abs({{e}} - {n}) <= 1 THEN {n}" for n in K.FIB_COUNTS) + " END"


@query(
    "realtime_wave_targets",
    with_views(
        "bars",
        extra={
            "seen": f"SELECT * FROM bars WHERE date <= DATE '{WAVE_CUTOFF}'",
            **pivots_cte("seen"),
            "pr": """SELECT l.symbol, l.pivot_price AS p0, l.pivot_date AS p0_date, l.pivot_idx AS p0_idx,
                l.confirmed_at AS p0_confirmed_at, h.pivot_price AS p1, h.pivot_date AS p1_date, h.confirmed_at AS p1_confirmed_at,
                row_number() OVER (PARTITION BY l.symbol ORDER BY l.pivot_idx DESC, h.pivot_idx DESC) AS rn
                FROM pivots l JOIN pivots h ON l.symbol = h.symbol AND l.pivot_type = 'low' AND h.pivot_type = 'high'
                  AND h.pivot_idx > l.pivot_idx AND h.pivot_price > l.pivot_price""",
            "la": "SELECT symbol, max(date) AS latest_date, count(*) AS n_bars FROM seen GROUP BY symbol",
            "kd": "SELECT symbol, count(DISTINCT pivot_type) AS kinds FROM pivots GROUP BY symbol",
            "j": """SELECT la.*, kinds, p0, p0_date, p0_confirmed_at, p1, p1_date, p1_confirmed_at,
                n_bars - p0_idx + 1 AS elapsed_bars, round(p1 - (p1 - p0) * 382e-3, 2) AS p2
                FROM la LEFT JOIN kd USING (symbol) LEFT JOIN (SELECT * FROM pr WHERE rn = 1) USING (symbol)""",
        },
        body=f"""SELECT symbol, latest_date::VARCHAR AS latest_date, CASE WHEN p0 IS NULL THEN 'insufficient_data' ELSE 'available' END AS status,
            CASE WHEN coalesce(kinds, 0) < 2 THEN 'insufficient_confirmed_pivots'
                 WHEN p0 IS NULL THEN 'no_valid_pivot_sequence' END AS reason,
            p0, p0_date::VARCHAR AS p0_date, p0_confirmed_at::VARCHAR AS p0_confirmed_at,
            p1, p1_date::VARCHAR AS p1_date, p1_confirmed_at::VARCHAR AS p1_confirmed_at, p2,
            round(p1 - p0, 2) AS wave1_amplitude, {_TARGET_SQL}, elapsed_bars,
            ({_FIB_CASE.format(e='elapsed_bars')})::BIGINT AS matching_fib,
            CASE WHEN p0 IS NOT NULL THEN ({_FIB_CASE.format(e='elapsed_bars')}) IS NOT NULL END AS is_in_window FROM j""",
    ),
)
def q_realtime_wave_targets(spark, sf_dir):
    out = ind.realtime_wave(d.bars(spark, sf_dir), WAVE_CUTOFF)
    return out.drop("p0_idx", "p1_idx", "n_bars")


@query(
    "hindsight_wave",
    with_views(
        "bars",
        extra={
            "m": """SELECT symbol, close AS p0, date AS pivot_date FROM (SELECT *, row_number() OVER
                (PARTITION BY symbol ORDER BY close, date) AS rn FROM bars) WHERE rn = 1""",
            "g": """SELECT b.symbol, p0, pivot_date, max(close) AS p1, count(*) AS elapsed_bars, max(b.date) AS latest_date
                FROM bars b JOIN m ON b.symbol = m.symbol AND b.date >= m.pivot_date GROUP BY ALL""",
            "h": "SELECT *, round(p1 - (p1 - p0) * 382e-3, 2) AS p2 FROM g",
        },
        body=f"""SELECT symbol, round(p0, 6) AS p0, pivot_date::VARCHAR AS pivot_date, latest_date::VARCHAR AS latest_date,
            round(p1, 6) AS p1, elapsed_bars, p2, round(p1 - p0, 2) AS wave1_amplitude, {_TARGET_SQL},
            ({_FIB_CASE.format(e='elapsed_bars')})::BIGINT AS matching_fib FROM h""",
    ),
)
def q_hindsight_wave(spark, sf_dir):
    out = ind.hindsight_wave(d.bars(spark, sf_dir).select("symbol", "date", "close"))
    return out.withColumns({"p0": F.round("p0", 6), "p1": F.round("p1", 6)})


def _fib_window_sql(elapsed: str) -> str:
    return with_views(
        "bars",
        extra={
            **pivots_cte("bars"),
            "la": "SELECT symbol, max(date) AS latest_date, count(*) AS last_idx FROM bars GROUP BY symbol",
            "e": f"SELECT p.*, latest_date, {elapsed} AS elapsed_units FROM pivots p JOIN la USING (symbol)",
        },
        body=f"""SELECT symbol, pivot_type, pivot_date::VARCHAR AS pivot_date, latest_date::VARCHAR AS latest_date,
            elapsed_units::BIGINT AS elapsed_units, ({_FIB_CASE.format(e='elapsed_units')})::BIGINT AS matching_fib,
            ({_FIB_CASE.format(e='elapsed_units')}) IS NOT NULL AS is_in_window FROM e""",
    )


_FIB_COLS = ("symbol", "pivot_type", "pivot_date", "latest_date", "elapsed_units", "matching_fib", "is_in_window")


@query("fib_time_window", _fib_window_sql("last_idx - pivot_idx + 1"))
def q_fib_time_window(spark, sf_dir):
    b = d.bars(spark, sf_dir)
    return ind.fib_time_window(b, ind.confirmed_pivots(b)).select(*_FIB_COLS)


@query(
    "fib_month_window",
    _fib_window_sql("(year(latest_date) - year(pivot_date)) * 12 + month(latest_date) - month(pivot_date)"),
)
def q_fib_month_window(spark, sf_dir):
    b = d.bars(spark, sf_dir)
    return ind.fib_time_window(b, ind.confirmed_pivots(b), monthly=True).select(*_FIB_COLS)


@query(
    "fib_marker_dates",
    with_views(
        "bars",
        extra={
            **pivots_cte("bars"),
            "ix": "SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS idx FROM bars",
            "mk": f"SELECT *, unnest({list(K.FIB_COUNTS)}) AS fib_n FROM pivots",
        },
        body="""SELECT mk.symbol, pivot_type, pivot_idx, pivot_date::VARCHAR AS pivot_date, fib_n::BIGINT AS fib_n,
            ix.date::VARCHAR AS marker_date
            FROM mk JOIN ix ON mk.symbol = ix.symbol AND ix.idx = mk.pivot_idx + mk.fib_n""",
    ),
)
def q_fib_marker_dates(spark, sf_dir):
    b = d.bars(spark, sf_dir)
    return ind.fib_marker_dates(b, ind.confirmed_pivots(b))


@query(
    "bar_deltas",
    with_views(
        "bars",
        body="""SELECT symbol, date::VARCHAR AS date, round(close / lag(close) OVER w - 1, 6) AS ret,
            date_diff('day', lag(date) OVER w, date) AS gap_days FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    ),
)
def q_bar_deltas(spark, sf_dir):
    out = ind.bar_deltas(d.bars(spark, sf_dir).select("symbol", "date", "close"))
    return out.select("symbol", "date", _r("ret"), "gap_days")


@query(
    "equity_drawdown",
    with_views(
        "bars",
        extra={
            "q": """SELECT symbol, date, close AS equity, max(close) OVER (PARTITION BY symbol ORDER BY date
                ROWS UNBOUNDED PRECEDING) AS peak, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM bars"""
        },
        body="""SELECT symbol, date::VARCHAR AS date, round(peak, 6) AS peak, round(equity / peak - 1, 6) AS drawdown,
            round(equity / prev - 1, 6) AS ret FROM q""",
    ),
)
def q_equity_drawdown(spark, sf_dir):
    curve = d.bars(spark, sf_dir).select("symbol", "date", F.col("close").alias("equity"))
    return ind.equity_drawdown(curve).select("symbol", "date", _r("peak"), _r("drawdown"), _r("ret"))
