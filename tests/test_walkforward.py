import datetime as dt
import random

from pyspark.sql import functions as F

from helpers import day, panel, rows
from tidemark import constants as K
from tidemark.operators import indicators as ind, walkforward as wf


def test_windows_step_from_the_previous_start_with_clamped_month_ends(spark):
    start = dt.date(2019, 1, 31)
    data = [("A", start + dt.timedelta(days=i), 1.0, 1.0, 1.0, 10.0, 1.0) for i in range(200)]
    df = spark.createDataFrame(data, "symbol string, date date, open double, high double, low double, close double, volume double")
    got = rows(wf.walk_forward_windows(wf.windowed_bars(df, months=1, warmup=0, min_bars=5), 0).select("window_no", "validation_start"), "window_no")
    assert [g[1] for g in got[:4]] == [dt.date(2019, 1, 31), dt.date(2019, 2, 28), dt.date(2019, 3, 28), dt.date(2019, 4, 28)]


def test_short_windows_are_dropped_and_numbers_have_no_gaps(spark):
    df = panel(spark, range(100, 900)).where(~F.col("date").between(F.lit(day(400)), F.lit(day(740))))
    got = rows(wf.walk_forward_windows(wf.windowed_bars(df, months=6, warmup=50, min_bars=60), 50).select("window_no", "validation_bars", "first_idx"), "window_no")
    assert [g[0] for g in got] == list(range(1, len(got) + 1)) and all(g[1] >= 60 for g in got) and got[0][2] == 50


def _equity(bars, pos, tax):
    """Order by order: fully invested, fractional shares."""
    cash, shares, curve, trades, paid = 1.0, 0.0, [], [], None
    for i, ((o, c), p) in enumerate(zip(bars, pos)):
        if p and not shares:
            paid = o * (1 + K.SLIPPAGE_RATE) * (1 + K.COMMISSION_RATE)
            shares, cash = cash / paid, 0.0
        elif not p and shares:
            price = o * (1 - K.SLIPPAGE_RATE) * (1 - K.COMMISSION_RATE - tax)
            trades.append(price / paid)
            cash, shares = shares * price, 0.0
        if i == len(bars) - 1 and shares:
            price = c * (1 - K.SLIPPAGE_RATE) * (1 - K.COMMISSION_RATE - tax)
            trades.append(price / paid)
            cash, shares = shares * price, 0.0
        curve.append(cash + shares * c)
    return curve, trades


def test_position_equity_matches_an_order_by_order_walk(spark):
    rng = random.Random(4)
    for trial in range(3):
        bars = [(50 + rng.random() * 10, 50 + rng.random() * 10) for _ in range(40)]
        pos = [rng.randint(0, 1) for _ in range(40)]
        df = spark.createDataFrame([("2330", 1, day(i), o, c, p) for i, ((o, c), p) in enumerate(zip(bars, pos))], "symbol string, window_no int, date date, open double, close double, pos int")
        out = rows(wf.position_equity(df, ["symbol", "window_no"]).select("date", "equity", "trade_factor"), "date")
        curve, trades = _equity(bars, pos, K.STOCK_TAX_RATE)
        assert all(abs(a[1] - b) < 1e-9 for a, b in zip(out, curve))
        assert [round(t[2], 9) for t in out if t[2] is not None] == [round(t, 9) for t in trades]


def test_risk_metrics_on_a_flat_and_a_falling_curve(spark):
    data = [("F", 1, day(i), 1.0, 0, None) for i in range(5)] + [("D", 1, day(i), 1.0 - 0.1 * i, 1, None) for i in range(5)]
    df = spark.createDataFrame(data, "symbol string, window_no int, date date, equity double, pos int, trade_factor double")
    got = {r.symbol: r for r in wf.risk_metrics(df, ["symbol", "window_no"]).collect()}
    assert got["F"].sharpe_ratio is None and got["F"].max_drawdown_pct == 0.0 and got["F"].exposure_pct == 0.0
    assert got["D"].max_drawdown_pct == 40.0 and got["D"].total_return_pct == -40.0 and got["D"].win_rate_pct == 0.0


def test_latch_matches_the_state_machine(spark):
    rng = random.Random(8)
    closes = [100.0]
    for _ in range(500):
        closes.append(max(20.0, closes[-1] * (1 + rng.gauss(0.001, 0.01))))
    df = panel(spark, closes)
    sig = rows(ind.with_resonance(df).select("date", "resonance", "close", "sma_55", "sma_8", "sma_21"), "date")
    state, want = 0, []
    for _, res, c, s55, s8, s21 in sig:
        want.append(state)
        leave = (s55 is not None and c < s55) or (s8 is not None and s21 is not None and s8 < s21)
        state = (0 if leave else 1) if state else (1 if res else 0)
    assert [r[1] for r in rows(wf.latch_positions(df).select("date", "pos"), "date")] == want and sum(want) > 0


def test_selection_uses_training_only_and_falls_back(spark):
    win = spark.createDataFrame([("A", 1), ("A", 2), ("A", 3)], "symbol string, window_no int")
    res = spark.createDataFrame(
        [("A", 1, "x", 5.0, 3.0, 4), ("A", 1, "y", 9.0, 30.0, 4), ("A", 2, "x", -1.0, 3.0, 4)],
        "symbol string, window_no int, candidate_id string, total_return_pct double, max_drawdown_pct double, total_trades int",
    )
    got = rows(wf.profile_selection(win, res, "legacy").select("window_no", "status", "candidate_id"), "window_no")
    assert got == [(1, "selected", "x"), (2, "fallback", "legacy"), (3, "fallback", "legacy")]


def test_universe_keeps_failed_symbols(spark):
    uni = spark.createDataFrame([("A", "big"), ("B", "big"), ("C", "small")], "symbol string, category string")
    gate = spark.createDataFrame([("A", True, True, 5.0), ("B", False, False, 40.0)], "symbol string, data_quality_available boolean, passed boolean, adaptive_mdd_pct double")
    got = {r.category: (r.total_symbols, r.usable_symbols, r.passed_symbols, r.maximum_mdd_pct) for r in wf.universe_gate(uni, gate).collect()}
    assert got == {"all": (3, 1, 1, 5.0), "big": (2, 1, 1, 5.0), "small": (1, 0, 0, None)}
