"""Counts, medians and slices against brute force, and the plans they promise."""

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from helpers import day, rows
from tidemark.operators import counting as ct, liquidity as lq, walkforward as wf


def test_dominance_counts(spark):
    rng = random.Random(1)
    for size in (1, 2, 7, 64, 100):
        values = [rng.choice([0.5, 1.0, 1.5, 2.0, rng.random()]) for _ in range(size)]
        asks = [(f"a{k}", rng.randint(0, size), rng.choice(values)) for k in range(40)]
        points = spark.createDataFrame(list(enumerate(values)), "pos long, value double").withColumn("size", F.lit(size))
        asked = spark.createDataFrame(asks, "id string, upto long, value double").withColumn("size", F.lit(size))
        got = {r.id: r.n for r in ct.dominance_counts(points, asked, F.col("size")).collect()}
        assert got == {i: sum(v <= x for v in values[:k]) for i, k, x in asks}


def test_trailing_percentiles_of_several_spans(spark):
    rng = random.Random(2)
    start = dt.date(2000, 2, 29)
    days = sorted({start + dt.timedelta(days=rng.randint(0, 2500)) for _ in range(400)} | {start})
    obs = [(d, round(rng.uniform(1, 2), 2)) for d in days]
    got = {r.trade_date: r for r in lq.trailing_percentiles(spark.createDataFrame(obs, "trade_date date, ratio_pct double"), [(1, 20), (3, 60)]).collect()}
    assert len(got) == len(obs)
    for d, x in obs:
        for years, minimum in ((1, 20), (3, 60)):
            end = 28 if (d.month, d.day) == (2, 29) and (d.year - years) % 4 else d.day
            begin = d.replace(year=d.year - years, day=end)
            held = [v for t, v in obs if begin <= t <= d]
            ok = days[0] <= begin and len(held) >= minimum
            assert got[d][f"observations_{years}"] == len(held)
            want = round(sum(v <= x for v in held) / len(held) * 100, 4) if ok else None
            assert (got[d][f"percentile_{years}"] is None) == (want is None)
            assert want is None or abs(got[d][f"percentile_{years}"] - want) <= 1e-4


def test_medians_of_even_odd_and_empty_groups(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, 1, 2]), rng.choice([None, -0.5, 0.25, rng.uniform(-1, 1)]), float(rng.randint(0, 3))) for _ in range(500)]
    data += [("even", 1, 1.0, 0.0), ("even", 1, 2.0, 1.0), ("none", 1, None, float("nan")), ("one", 9, 7.0, None)]
    df = spark.createDataFrame(data, "g string, h int, x double, y double")
    out = ct.grouped_medians(df, ["g", "h"], {"mx": F.col("x"), "my": F.col("y")}, digits=1)
    got = {(r.g, r.h): (r.mx, r.my) for r in out.collect()}
    groups = {}
    for g, h, x, y in data:
        own = groups.setdefault((g, h), ([], []))
        for values, v in zip(own, (x, y), strict=True):
            if v is not None and v == v:
                values.append(v)
    want = {k: tuple(statistics.median(v) if v else None for v in own) for k, own in groups.items() if any(own)}
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "percentile" not in plan and "median" not in plan


def test_slices_hold_their_bars_and_no_others(spark):
    bars = spark.createDataFrame([(s, i, float(i), "x") for s in ("A", "B") for i in range(100)], "symbol string, idx int, close double, window string")
    slices = [("A", w, max(0, 7 * w - 20), 7 * w + 3) for w in range(14)] + [("B", 0, 0, 0), ("B", 5, 99, 99)]
    out = wf.slice_bars(bars, spark.createDataFrame(slices, "symbol string, window_no int, train_start_idx int, train_end_idx int"))
    got = sorted((r.symbol, r.window_no, r.idx) for r in out.collect())
    assert got == sorted((s, w, i) for s, w, a, b in slices for i in range(a, min(b, 99) + 1))
    assert "BETWEEN" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert rows(out.where("symbol = 'B'").select("close", "train_end_idx"), "close") == [(0.0, 0), (99.0, 99)]
    assert day(0) == dt.date(2020, 1, 1)
