"""Queries of the walk-forward study."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.operators import walkforward as wf
from tidemark.plans import domain as d
from tidemark.plans.domain_sql import ASKED, half_up, with_views
from tidemark.plans.q_panel import _RES, _SMA_CTE
from tidemark.plans.registry import ORACLES, query
from tidemark.session import settle

# The panel has about 80 bars a year per symbol, so the bar counts are scaled.
MONTHS, WARMUP, MIN_BARS = 12, 144, 60
TRAIN, TRAIN_WARM, TRAIN_MIN = 160, 60, 100
CASH = 1e9
CANDIDATES = (("sma_8_21", 8, 21), ("sma_5_13", 5, 13), ("sma_13_34", 13, 34))
LEGACY = "sma_8_21"
MAX_DD, MIN_TRADES = 20.0, 2
REGIME_LIMIT = 0.005

BUY = f"(1e0 + {K.SLIPPAGE_RATE}e0) * (1e0 + {K.COMMISSION_RATE}e0)"
KEEP = f"(1e0 - {K.SLIPPAGE_RATE}e0) * (1e0 - {K.COMMISSION_RATE}e0 - {K.STOCK_TAX_RATE}e0)"

WB = {
    "ix": f"""SELECT *, row_number() OVER w - 1 AS idx, lag(date, {WARMUP}) OVER w AS context_start FROM bars
        WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "sb": f"SELECT symbol, min(date) FILTER (idx >= {WARMUP}) AS s0, max(date) AS s9 FROM ix GROUP BY symbol",
    "ws": """WITH RECURSIVE r AS (SELECT symbol, 0 AS step, s0 AS st, s9 FROM sb WHERE s0 IS NOT NULL
        UNION ALL SELECT symbol, step + 1, (st + INTERVAL 12 MONTH)::DATE, s9 FROM r WHERE (st + INTERVAL 12 MONTH)::DATE <= s9)
        SELECT symbol, step, st, lead(st) OVER (PARTITION BY symbol ORDER BY step) AS nx FROM r""",
    "wn": f"""SELECT symbol, step, st, nx, dense_rank() OVER (PARTITION BY symbol ORDER BY step) AS window_no FROM (
        SELECT ws.symbol, step, st, nx, count(*) AS n FROM ws JOIN ix ON ix.symbol = ws.symbol AND ix.date >= st AND (nx IS NULL OR ix.date < nx)
        GROUP BY ALL HAVING count(*) >= {MIN_BARS})""",
    "wb": """SELECT ix.*, window_no FROM ix JOIN wn ON wn.symbol = ix.symbol AND ix.date >= st AND (nx IS NULL OR ix.date < nx)""",
    "windows": """SELECT symbol, window_no, min(idx) AS first_idx, max(idx) AS last_idx, arg_min(context_start, idx) AS context_start,
        min(date) AS validation_start, max(date) AS validation_end, count(*) AS validation_bars, min(close) AS minimum_close
        FROM wb GROUP BY ALL""",
}


def _signals(spark, sf_dir):
    """All bars with their place and every candidate's position."""
    return wf.crossover_signals(wf.indexed(d.bars(spark, sf_dir).select("symbol", "date", "open", "close")), CANDIDATES)


def _windowed(signals):
    return wf.windowed_bars(signals, MONTHS, WARMUP, MIN_BARS)


def _study(spark, sf_dir):
    """Bars of all validation windows with every candidate's position."""
    return _windowed(_signals(spark, sf_dir))


def _shared_study(spark, sf_dir):
    """The same, written once because several models and tables read it."""
    return settle(_study(spark, sf_dir))


def _windows(study):
    return wf.walk_forward_windows(study, WARMUP)


@query(
    "walk_forward_windows",
    with_views(
        "bars",
        extra=WB,
        body=f"""SELECT symbol, window_no, first_idx, last_idx, context_start::VARCHAR AS context_start,
            validation_start::VARCHAR AS validation_start, validation_end::VARCHAR AS validation_end, validation_bars,
            minimum_close, first_idx - {WARMUP} AS context_start_idx, {WARMUP}::BIGINT AS warmup_bars FROM windows""",
    ),
)
def q_windows(spark, sf_dir):
    return _windows(_study(spark, sf_dir))


SLICES = {
    **WB,
    "slices": f"""SELECT * FROM (SELECT symbol, window_no, greatest(0, first_idx - {TRAIN}) AS train_start_idx, first_idx - 1 AS train_end_idx,
        greatest(0, greatest(0, first_idx - {TRAIN}) - {TRAIN_WARM}) AS context_start_idx,
        first_idx - greatest(0, first_idx - {TRAIN}) AS training_bars FROM windows) WHERE training_bars >= {TRAIN_MIN}""",
}


@query(
    "training_slices",
    with_views("bars", extra=SLICES, body="SELECT * FROM slices"),
)
def q_slices(spark, sf_dir):
    return wf.training_slices(_windows(_study(spark, sf_dir)), TRAIN, TRAIN_WARM, TRAIN_MIN)


@query(
    "capital_feasibility",
    with_views(
        "bars",
        extra=WB,
        body=f"""SELECT symbol, window_no, minimum_close,
            round(minimum_close::DECIMAL(14,2) * 1000::DECIMAL(6,0) * {1 + K.COMMISSION_RATE:.6f}::DECIMAL(9,6) * 5, 2)::DOUBLE AS stage1_minimum_cash,
            minimum_close::DECIMAL(14,2) * 1000::DECIMAL(6,0) * {1 + K.COMMISSION_RATE:.6f}::DECIMAL(9,6) * 5 <= {CASH} AS stage1_feasible FROM windows""",
    ),
)
def q_feasible(spark, sf_dir):
    return wf.capital_feasibility(_windows(_study(spark, sf_dir)), CASH)


def _positions_sql() -> dict[str, str]:
    means, picks = [], []
    for name, a, b in CANDIDATES:
        picks.append(
            f"""SELECT symbol, date, open, close, '{name}' AS candidate_id,
            coalesce(lag(m{a} > m{b}) OVER (PARTITION BY symbol ORDER BY date), false)::INT AS pos FROM mn"""
        )
    for n in sorted({n for _, a, b in CANDIDATES for n in (a, b)}):
        f = f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        means.append(f"CASE WHEN count(close) OVER {f} = {n} THEN avg(close) OVER {f} END AS m{n}")
    return {
        "mn": f"SELECT symbol, date, open, close, {', '.join(means)} FROM bars",
        "ps": " UNION ALL ".join(picks),
    }


def _equity_sql(source: str, keys: str, tag: str) -> dict[str, str]:
    w = f"PARTITION BY {keys} ORDER BY date"
    run = f"{w} ROWS UNBOUNDED PRECEDING"
    return {
        f"{tag}a": f"SELECT *, coalesce(lag(pos) OVER ({w}), 0) AS bf, lead(date) OVER ({w}) IS NULL AS fin FROM {source}",
        f"{tag}b": f"""SELECT *, sum((pos = 1 AND bf = 0)::INT) OVER ({run}) AS segment,
            last_value(CASE WHEN pos = 1 AND bf = 0 THEN open * {BUY} END IGNORE NULLS) OVER ({run}) AS paid FROM {tag}a""",
        f"{tag}c": f"SELECT *, CASE WHEN pos = 0 AND bf = 1 THEN open * ({KEEP}) / paid END AS closed FROM {tag}b",
        f"{tag}": f"""SELECT *, coalesce(product(closed) OVER ({run}), 1) * CASE WHEN pos = 1
                THEN CASE WHEN fin THEN close * ({KEEP}) ELSE close END / paid ELSE 1 END AS equity,
            coalesce(closed, CASE WHEN fin AND pos = 1 THEN close * ({KEEP}) / paid END) AS trade_factor FROM {tag}c""",
    }


def _risk_sql(source: str, keys: str, tag: str) -> dict[str, str]:
    w = f"PARTITION BY {keys} ORDER BY date"
    return {
        f"{tag}0": f"""SELECT *, equity / max(equity) OVER ({w} ROWS UNBOUNDED PRECEDING) - 1 AS dd,
            equity / lag(equity) OVER ({w}) - 1 AS ret FROM {source}""",
        f"{tag}1": f"""SELECT {keys}, arg_max(equity, date) AS fin, min(dd) AS dd, avg(ret) AS mean, stddev_samp(ret) AS sd,
            count(ret) AS nr, count(trade_factor) AS total_trades, count(*) FILTER (trade_factor > 1) AS won, sum(pos) AS held,
            count(*) AS observation_days FROM {tag}0 GROUP BY ALL""",
        tag: f"""SELECT {keys}, {half_up('(fin - 1) * 1e2', 4)} AS total_return_pct, {half_up('abs(dd) * 1e2', 4)} AS max_drawdown_pct,
            {half_up('CASE WHEN nr >= 2 AND sd > 1e-12 THEN mean / sd * sqrt(252) END', 4)} AS sharpe_ratio, total_trades,
            {half_up('CASE WHEN total_trades > 0 THEN won * 1e2 / total_trades ELSE 0 END', 2)} AS win_rate_pct,
            {half_up('held * 1e2 / observation_days', 2)} AS exposure_pct, observation_days FROM {tag}1""",
    }


NAMES = [name for name, _, _ in CANDIDATES]
KEYS = ["symbol", "window_no", "candidate_id"]
K3 = "symbol, window_no, candidate_id"
VALID = {
    **WB,
    **_positions_sql(),
    "vp": """SELECT ps.symbol, wb.window_no, ps.candidate_id, ps.date, ps.open, ps.close, ps.pos FROM ps
        JOIN wb ON wb.symbol = ps.symbol AND wb.date = ps.date""",
    **_equity_sql("vp", K3, "ve"),
    **_risk_sql("ve", K3, "vr"),
}


def _validation_equity(study):
    rows, tags = wf.side_by_side(study.select("symbol", "window_no", "date", "open", "close", "candidates"), len(NAMES))
    equity = wf.position_equity(rows, KEYS[:2], tags)
    return wf.by_candidate(equity, ["symbol", "window_no", "date"], NAMES, tags, ("pos", "segment", "trade_factor"))


def _validation_metrics(study):
    return wf.candidate_metrics(study, KEYS[:2], NAMES)


@query(
    "crossover_segments",
    with_views(
        "bars",
        extra=VALID,
        body=f"""SELECT {K3}, segment::BIGINT AS segment, min(date)::VARCHAR AS entry_date,
            max(date) FILTER (trade_factor IS NOT NULL)::VARCHAR AS exit_date, count(*) FILTER (pos = 1) AS bars_held,
            {half_up('max(trade_factor) - 1', 6)} AS trade_return FROM ve WHERE segment > 0 GROUP BY {K3}, segment""",
    ),
)
def q_segments(spark, sf_dir):
    out = wf.crossover_trades(_validation_equity(_study(spark, sf_dir)), KEYS)
    return out.withColumn("trade_return", wf.half_up("trade_return", 6))


@query("risk_metrics", with_views("bars", extra=VALID, body="SELECT * FROM vr"))
def q_risk(spark, sf_dir):
    return _validation_metrics(_study(spark, sf_dir))


BH = {
    **WB,
    "h0": f"""SELECT *, first_value(open) OVER (PARTITION BY symbol, window_no ORDER BY date) * (1e0 + {K.SLIPPAGE_RATE}e0) AS price,
        lead(date) OVER (PARTITION BY symbol, window_no ORDER BY date) IS NULL AS fin FROM wb""",
    "h1": f"SELECT *, floor({CASH} / (price * (1e0 + {K.COMMISSION_RATE}e0) * 1000)) * 1000 AS shares FROM h0",
    "h2": f"""SELECT symbol, window_no, date, 1 AS pos, fin, ({CASH} - shares * price * (1e0 + {K.COMMISSION_RATE}e0)
        + shares * CASE WHEN fin THEN close * ({KEEP}) ELSE close END) / {CASH} AS equity FROM h1 WHERE shares > 0""",
    "h3": "SELECT *, CASE WHEN fin THEN equity END AS trade_factor FROM h2",
    **_risk_sql("h3", "symbol, window_no", "hr"),
}


def _bh_metrics(study):
    rows = study.select("symbol", "window_no", "date", "open", "close")
    return wf.risk_metrics(wf.buy_and_hold_equity(rows, CASH), ["symbol", "window_no"])


@query("buy_and_hold_eval", with_views("bars", extra=BH, body="SELECT * FROM hr"))
def q_bh(spark, sf_dir):
    return _bh_metrics(_study(spark, sf_dir))


BH_ASKED = f"""SELECT a.symbol, w.window_no, hr.* EXCLUDE (symbol, window_no),
    CASE WHEN w.window_no IS NULL THEN 'insufficient_data' WHEN hr.symbol IS NULL THEN 'cash_below_one_lot' ELSE 'available' END AS status
    FROM ({ASKED}) a LEFT JOIN windows w ON w.symbol = a.symbol LEFT JOIN hr ON hr.symbol = w.symbol AND hr.window_no = w.window_no"""


@query("buy_and_hold_asked", with_views("bars", extra=BH, body=BH_ASKED))
def q_bh_asked(spark, sf_dir):
    study = _shared_study(spark, sf_dir)
    return wf.buy_and_hold_status(d.asked_symbols(spark, sf_dir), _windows(study), _bh_metrics(study))


REGIME = {
    **WB,
    "rg0": """SELECT w.symbol, w.window_no, count(b.date) AS benchmark_rows, arg_max(b.close, b.date) / arg_min(b.close, b.date) - 1 AS r
        FROM windows w LEFT JOIN bench b ON b.date BETWEEN w.validation_start AND w.validation_end GROUP BY ALL""",
    "regimes": f"""SELECT symbol, window_no, benchmark_rows, CASE WHEN benchmark_rows >= 2 THEN {half_up('r * 1e2', 4)} END AS benchmark_return_pct,
        CASE WHEN benchmark_rows < 2 THEN 'unknown' WHEN r >= {REGIME_LIMIT} THEN 'bull' WHEN r <= -{REGIME_LIMIT} THEN 'bear' ELSE 'sideways' END AS regime FROM rg0""",
}


def _regimes(spark, sf_dir, study):
    return wf.market_regime(_windows(study), d.benchmark(spark, sf_dir), REGIME_LIMIT)


@query("market_regime", with_views("bars", "bench", extra=REGIME, body="SELECT * FROM regimes"))
def q_regime(spark, sf_dir):
    return _regimes(spark, sf_dir, _shared_study(spark, sf_dir))


AGG = f"""count(total_return_pct) AS window_count, count(*) AS requested_window_count,
    {half_up('(product(1 + total_return_pct / 1e2) - 1) * 1e2', 4)} AS compounded_return_pct,
    max(max_drawdown_pct) AS worst_window_drawdown_pct, {half_up('avg(sharpe_ratio)', 4)} AS average_window_sharpe,
    sum(total_trades)::BIGINT AS total_trades,
    {half_up('CASE WHEN sum(total_trades) > 0 THEN sum(round(total_trades * win_rate_pct / 1e2)) * 1e2 / sum(total_trades) ELSE 0 END', 2)} AS win_rate_pct,
    {half_up('sum(exposure_pct * observation_days) / sum(observation_days)', 2)} AS exposure_pct,
    sum(observation_days)::BIGINT AS observation_days,
    CASE WHEN count(total_return_pct) = 0 THEN 'insufficient_data' WHEN count(total_return_pct) = count(*) THEN 'available' ELSE 'partial' END AS status"""

MODELS = {
    **VALID,
    **{k: v for k, v in BH.items() if k not in WB},
    "results": """SELECT symbol, window_no, candidate_id AS model, * EXCLUDE (symbol, window_no, candidate_id) FROM vr
        UNION ALL SELECT w.symbol, w.window_no, 'buy_and_hold', hr.* EXCLUDE (symbol, window_no)
        FROM windows w LEFT JOIN hr ON hr.symbol = w.symbol AND hr.window_no = w.window_no""",
}


def _results(study):
    """Metrics of all models per window; a window a model cannot trade keeps an empty row."""
    cross = _validation_metrics(study).withColumnRenamed("candidate_id", "model")
    hold = _windows(study).select("symbol", "window_no").join(_bh_metrics(study), ["symbol", "window_no"], "left")
    return cross.unionByName(hold.withColumn("model", F.lit("buy_and_hold")))


@query(
    "window_aggregate",
    with_views("bars", extra=MODELS, body=f"SELECT symbol, model, {AGG} FROM results GROUP BY symbol, model"),
)
def q_aggregate(spark, sf_dir):
    return wf.window_aggregate(_results(_shared_study(spark, sf_dir)))


BYREG = {
    **MODELS,
    **{k: v for k, v in REGIME.items() if k not in WB},
    "rr": "SELECT results.*, regime FROM results JOIN regimes USING (symbol, window_no)",
    "byreg": f"""SELECT symbol, model, regime, {AGG} FROM rr GROUP BY symbol, model, regime
        UNION ALL SELECT symbol, model, 'all', {AGG} FROM rr GROUP BY symbol, model""",
}


@query("regime_aggregate", with_views("bars", "bench", extra=BYREG, body="SELECT * FROM byreg"))
def q_regime_aggregate(spark, sf_dir):
    study = _shared_study(spark, sf_dir)
    return wf.regime_aggregate(_results(study), _regimes(spark, sf_dir, study))


@query(
    "excess_returns",
    with_views(
        "bars",
        extra={
            **MODELS,
            "ag": f"SELECT symbol, model, {AGG} FROM results GROUP BY symbol, model",
            "pv": """SELECT symbol, max(compounded_return_pct) FILTER (model = 'sma_8_21' AND status = 'available') AS a,
                max(compounded_return_pct) FILTER (model = 'buy_and_hold' AND status = 'available') AS b,
                max(compounded_return_pct) FILTER (model = 'sma_5_13' AND status = 'available') AS c FROM ag GROUP BY symbol""",
        },
        body=f"""SELECT symbol, CASE WHEN c IS NOT NULL THEN {half_up('a - b', 4)} END AS excess_vs_buy_and_hold_pct,
            CASE WHEN b IS NOT NULL THEN {half_up('a - c', 4)} END AS excess_vs_sma_5_13_pct FROM pv""",
    ),
)
def q_excess(spark, sf_dir):
    agg = wf.window_aggregate(_results(_shared_study(spark, sf_dir)))
    return wf.excess_returns(agg, "sma_8_21", ("buy_and_hold", "sma_5_13"))


TRAINED = {
    **SLICES,
    **_positions_sql(),
    "pi": "SELECT ps.*, idx FROM ps JOIN ix ON ix.symbol = ps.symbol AND ix.date = ps.date",
    "tp": """SELECT pi.symbol, window_no, candidate_id, date, open, close, pos FROM pi JOIN slices s
        ON s.symbol = pi.symbol AND pi.idx BETWEEN train_start_idx AND train_end_idx""",
    **_equity_sql("tp", K3, "te"),
    **_risk_sql("te", K3, "tr"),
}


def _training_metrics(signals, study):
    slices = wf.training_slices(_windows(study), TRAIN, TRAIN_WARM, TRAIN_MIN)
    return wf.candidate_metrics(wf.slice_bars(signals, slices), KEYS[:2], NAMES)


def _sensitivity(spark, sf_dir, asked=None):
    signals = _signals(spark, sf_dir)
    return wf.sensitivity_summary(_training_metrics(signals, _windowed(signals)), asked)


SENS = {
    **TRAINED,
    "sens": f"""SELECT symbol, candidate_id, count(*) AS training_window_count, {half_up('avg(total_return_pct)', 4)} AS average_return_pct,
        {half_up('median(total_return_pct)', 4)} AS median_return_pct,
        {half_up('avg((total_return_pct > 0)::INT::DOUBLE)', 4)} AS positive_window_fraction,
        max(max_drawdown_pct) AS worst_drawdown_pct, sum(total_trades)::BIGINT AS total_trades FROM tr GROUP BY ALL""",
}


@query("sensitivity_summary", with_views("bars", extra=SENS, body="SELECT * FROM sens"))
def q_sensitivity(spark, sf_dir):
    return _sensitivity(spark, sf_dir)


@query(
    "sensitivity_spread",
    with_views(
        "bars",
        extra=SENS,
        body=f"""SELECT symbol, count(*) AS candidate_count,
            {half_up('max(average_return_pct) - min(average_return_pct)', 4)} AS average_return_range_pct,
            {half_up('avg((average_return_pct > 0)::INT::DOUBLE)', 4)} AS positive_candidate_fraction FROM sens GROUP BY symbol""",
    ),
)
def q_spread(spark, sf_dir):
    return wf.sensitivity_spread(_sensitivity(spark, sf_dir))


SENS_ASKED = f"""SELECT a.symbol, c.candidate_id, q.* EXCLUDE (symbol, candidate_id) REPLACE (coalesce(training_window_count, 0) AS training_window_count)
    FROM ({ASKED}) a CROSS JOIN (SELECT unnest([{", ".join(f"'{c[0]}'" for c in CANDIDATES)}]) AS candidate_id) c
    LEFT JOIN ({ORACLES["sensitivity_summary"]}) q ON q.symbol = a.symbol AND q.candidate_id = c.candidate_id"""


def _asked_sensitivity(spark, sf_dir):
    asked = d.asked_symbols(spark, sf_dir).withColumn("candidate_id", F.explode(F.array(*[F.lit(c[0]) for c in CANDIDATES])))
    return _sensitivity(spark, sf_dir, asked)


@query("sensitivity_summary_asked", SENS_ASKED)
def q_sensitivity_asked(spark, sf_dir):
    return _asked_sensitivity(spark, sf_dir)


@query(
    "sensitivity_spread_asked",
    f"""SELECT symbol, count(*) AS candidate_count,
        {half_up('max(average_return_pct) - min(average_return_pct)', 4)} AS average_return_range_pct,
        {half_up('avg((average_return_pct > 0)::INT::DOUBLE)', 4)} AS positive_candidate_fraction FROM ({SENS_ASKED}) GROUP BY symbol""",
)
def q_spread_asked(spark, sf_dir):
    return wf.sensitivity_spread(_asked_sensitivity(spark, sf_dir))


SELECTED = {
    **TRAINED,
    "el": f"""SELECT *, row_number() OVER (PARTITION BY symbol, window_no ORDER BY total_return_pct DESC, max_drawdown_pct, candidate_id) AS rn
        FROM tr WHERE total_return_pct > 0 AND max_drawdown_pct <= {MAX_DD} AND total_trades >= {MIN_TRADES}""",
    "tw": "SELECT DISTINCT symbol, window_no FROM tr",
    "selected": f"""SELECT w.symbol, w.window_no, CASE WHEN el.candidate_id IS NULL THEN 'fallback' ELSE 'selected' END AS status,
        CASE WHEN tw.symbol IS NULL THEN 'insufficient_pre_validation_training_data'
             WHEN el.candidate_id IS NULL THEN 'no_profile_passed_training_risk_guardrails'
             ELSE 'highest_positive_training_return_within_risk_guardrails' END AS reason,
        coalesce(el.candidate_id, '{LEGACY}') AS candidate_id
        FROM windows w LEFT JOIN tw ON tw.symbol = w.symbol AND tw.window_no = w.window_no
        LEFT JOIN el ON el.symbol = w.symbol AND el.window_no = w.window_no AND el.rn = 1""",
}


def _selected(signals, study):
    return wf.profile_selection(_windows(study), _training_metrics(signals, study), LEGACY, MAX_DD, MIN_TRADES)


@query("profile_selection", with_views("bars", extra=SELECTED, body="SELECT * FROM selected"))
def q_selection(spark, sf_dir):
    signals = settle(_signals(spark, sf_dir))
    return _selected(signals, _windowed(signals))


GATE_LIMITS = {"max_mdd": 45.0, "min_bear_return": -20.0, "max_bear_mdd": 30.0}
GATE = {
    **SELECTED,
    **{k: v for k, v in VALID.items() if k not in SELECTED},
    **{k: v for k, v in REGIME.items() if k not in WB},
    "gres": """SELECT symbol, window_no, candidate_id AS model, * EXCLUDE (symbol, window_no, candidate_id) FROM vr WHERE candidate_id = 'sma_8_21'
        UNION ALL SELECT vr.symbol, vr.window_no, 'adaptive', vr.* EXCLUDE (symbol, window_no, candidate_id) FROM vr JOIN selected s
        ON s.symbol = vr.symbol AND s.window_no = vr.window_no AND s.candidate_id = vr.candidate_id""",
    "grr": "SELECT gres.*, regime FROM gres JOIN regimes USING (symbol, window_no)",
    "gby": f"""SELECT symbol, model, regime, {AGG} FROM grr GROUP BY symbol, model, regime
        UNION ALL SELECT symbol, model, 'all', {AGG} FROM grr GROUP BY symbol, model""",
    "gp": """SELECT symbol, max(compounded_return_pct) FILTER (model = 'adaptive' AND regime = 'all' AND status = 'available') AS a_ret,
        max(worst_window_drawdown_pct) FILTER (model = 'adaptive' AND regime = 'all' AND status = 'available') AS a_mdd,
        max(compounded_return_pct) FILTER (model = 'sma_8_21' AND regime = 'all' AND status = 'available') AS l_ret,
        max(compounded_return_pct) FILTER (model = 'adaptive' AND regime = 'bear' AND status = 'available') AS b_ret,
        max(worst_window_drawdown_pct) FILTER (model = 'adaptive' AND regime = 'bear' AND status = 'available') AS b_mdd FROM gby GROUP BY symbol""",
    "gate0": f"""SELECT symbol, substr(symbol, 2)::INT % 5 <> 0 AS data_quality_available, coalesce(a_ret > l_ret, false) AS return_improves_legacy,
        coalesce(a_mdd <= {GATE_LIMITS['max_mdd']}, false) AS worst_window_mdd_ok, b_ret IS NOT NULL AS bear_window_present,
        coalesce(b_ret > {GATE_LIMITS['min_bear_return']}, false) AS bear_return_ok,
        coalesce(b_mdd <= {GATE_LIMITS['max_bear_mdd']}, false) AS bear_mdd_ok, a_mdd AS adaptive_mdd_pct FROM gp""",
    "gate": """SELECT *, data_quality_available AND return_improves_legacy AND worst_window_mdd_ok AND bear_window_present
        AND bear_return_ok AND bear_mdd_ok AS passed FROM gate0""",
}


def _gate(spark, sf_dir):
    signals = settle(_signals(spark, sf_dir))
    study = settle(_windowed(signals))
    chosen = _selected(signals, study).select("symbol", "window_no", F.col("candidate_id").alias("_chosen"))
    # A candidate's result serves as the fixed model, as the selected one, or as both.
    roles = F.array_compact(
        F.array(
            F.when(F.col("candidate_id") == LEGACY, F.lit(LEGACY)),
            F.when(F.col("candidate_id") == F.col("_chosen"), F.lit("adaptive")),
        )
    )
    models = (
        _validation_metrics(study)
        .join(chosen, ["symbol", "window_no"])
        .withColumn("model", F.explode(roles))
        .drop("candidate_id", "_chosen")
    )
    regimes = _regimes(spark, sf_dir, study)
    by_regime = wf.regime_aggregate(models, regimes)
    quality = d.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"),
        F.when(F.col("s_suppkey") % 5 != 0, "available").otherwise("quality_warning").alias("status"),
    )
    return wf.research_gate(by_regime, quality, "adaptive", LEGACY, **GATE_LIMITS)


_GATE_COLS = ", ".join(wf.GATE_CHECKS)


@query(
    "research_gate",
    with_views("bars", "bench", extra=GATE, body=f"SELECT symbol, {_GATE_COLS}, passed, adaptive_mdd_pct FROM gate"),
)
def q_gate(spark, sf_dir):
    return _gate(spark, sf_dir)


UNIVERSE = {
    **GATE,
    "uni": "SELECT 'S' || s_suppkey AS symbol, 'N' || (s_nationkey % 5) AS category FROM supplier",
    "ug": """SELECT category, coalesce(data_quality_available, false) AS usable,
        coalesce(data_quality_available AND passed, false) AS passed, adaptive_mdd_pct FROM uni LEFT JOIN gate ON gate.symbol = uni.symbol""",
    "summary": f"""SELECT *, {half_up('passed_symbols::DOUBLE / total_symbols', 6)} AS gate_pass_rate FROM (
        SELECT category, count(*) AS total_symbols, count(*) FILTER (usable) AS usable_symbols, count(*) FILTER (passed) AS passed_symbols,
            max(adaptive_mdd_pct) FILTER (usable) AS maximum_mdd_pct FROM ug GROUP BY category
        UNION ALL SELECT 'all', count(*), count(*) FILTER (usable), count(*) FILTER (passed), max(adaptive_mdd_pct) FILTER (usable) FROM ug)""",
}


def _universe(spark, sf_dir):
    uni = d.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"),
        F.concat(F.lit("N"), (F.col("s_nationkey") % 5).cast("string")).alias("category"),
    )
    return wf.universe_gate(uni, _gate(spark, sf_dir))


@query("universe_gate", with_views("bars", "bench", extra=UNIVERSE, body="SELECT * FROM summary"))
def q_universe(spark, sf_dir):
    return _universe(spark, sf_dir)


@query(
    "universe_decision",
    with_views(
        "bars",
        "bench",
        extra=UNIVERSE,
        body="""SELECT total_symbols, usable_symbols >= 5 AS minimum_usable_symbols_met, gate_pass_rate >= 2e-2 AS minimum_gate_pass_rate_met,
            coalesce(maximum_mdd_pct <= 99, false) AS maximum_symbol_mdd_met,
            CASE WHEN usable_symbols >= 5 AND gate_pass_rate >= 2e-2 AND coalesce(maximum_mdd_pct <= 99, false)
                THEN 'candidate_for_next_phase' ELSE 'hold_for_revision' END AS status FROM summary WHERE category = 'all'""",
    ),
)
def q_universe_decision(spark, sf_dir):
    return wf.universe_decision(_universe(spark, sf_dir), 5, 0.02, 99.0)


def _latch_steps() -> dict[str, str]:
    """Recursive walk over each symbol's bars: the plain state machine as the check."""
    return {
        "sm": _SMA_CTE.replace("FROM bars", "FROM bars").replace("SELECT symbol, date, close,", "SELECT symbol, date, open, high, close, volume,"),
        "sg": f"""SELECT symbol, date, high, close, volume, sma_55, ({_RES}) AS ent, coalesce(close < sma_55 OR sma_8 < sma_21, false) AS ext,
            row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM sm""",
        "ev": """SELECT symbol, i, ent, ext, row_number() OVER (PARTITION BY symbol ORDER BY i) AS j FROM sg WHERE ent OR ext""",
        "fs": """WITH RECURSIVE r AS (SELECT symbol, j, i, ent AS st FROM ev WHERE j = 1
            UNION ALL SELECT ev.symbol, ev.j, ev.i, CASE WHEN r.st THEN NOT ev.ext ELSE ev.ent END FROM r
            JOIN ev ON ev.symbol = r.symbol AND ev.j = r.j + 1) SELECT * FROM r""",
        "st": """SELECT sg.*, coalesce(last_value(fs.st IGNORE NULLS) OVER (PARTITION BY sg.symbol ORDER BY sg.i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)::INT AS pos
            FROM sg LEFT JOIN fs ON fs.symbol = sg.symbol AND fs.i = sg.i""",
    }


@query(
    "resonance_latch",
    with_views(
        "bars",
        extra=_latch_steps(),
        body="SELECT symbol, date::VARCHAR AS date, ent AS resonance, ext AS exit_signal, pos::BIGINT AS pos FROM st WHERE pos = 1 OR ent",
    ),
)
def q_latch(spark, sf_dir):
    out = wf.latch_positions(d.bars(spark, sf_dir)).where((F.col("pos") == 1) | F.col("resonance"))
    return out.select("symbol", "date", "resonance", "exit_signal", "pos")


@query(
    "pullback_tranches",
    with_views(
        "bars",
        extra={
            **_latch_steps(),
            "s1": """SELECT *, sum((pos = 1 AND coalesce(lagp, 0) = 0)::INT) OVER (PARTITION BY symbol ORDER BY date) AS segment FROM (
                SELECT *, lag(pos) OVER (PARTITION BY symbol ORDER BY date) AS lagp,
                CASE WHEN count(*) OVER v5 = 5 THEN avg(volume) OVER v5 END AS va,
                CASE WHEN count(*) OVER v20 = 20 THEN avg(volume) OVER v20 END AS vb FROM st
                WINDOW v5 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
                  v20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
            "s2": """SELECT *, max(high) OVER (PARTITION BY symbol, segment ORDER BY date) AS peak FROM s1 WHERE pos = 1""",
            "s3": """SELECT *, (peak - close) / peak AS back, max((NOT ext AND (peak - close) / peak > 11e-2)::INT)
                OVER (PARTITION BY symbol, segment ORDER BY date) AS broken FROM s2""",
            "s4": """SELECT *, min(date) FILTER (NOT ext AND broken = 0 AND back BETWEEN 7e-2 AND 11e-2 AND coalesce(close > sma_55, false))
                OVER (PARTITION BY symbol, segment) AS d2 FROM s3""",
            "s5": "SELECT *, max(CASE WHEN date = d2 THEN peak END) OVER (PARTITION BY symbol, segment) AS frozen FROM s4",
        },
        body="""SELECT symbol, segment::BIGINT AS segment, min(date)::VARCHAR AS stage1_date, max(date)::VARCHAR AS last_date,
            max(d2)::VARCHAR AS stage2_signal, max(frozen) AS frozen_high,
            min(date) FILTER (NOT ext AND date > d2 AND close > frozen AND coalesce(va > vb, false))::VARCHAR AS stage3_signal
            FROM s5 GROUP BY symbol, segment""",
    ),
)
def q_pullback(spark, sf_dir):
    return wf.pullback_tranches(d.bars(spark, sf_dir))
