import random

from pyspark.sql import functions as F

from helpers import day, panel, rows
from tidemark.operators import indicators as ind


def test_sma_and_deduction_against_plain_loops(spark):
    rng = random.Random(7)
    closes = [round(50 + rng.random() * 20, 2) for _ in range(60)]
    out = rows(ind.sma_deduction(panel(spark, closes), (8, 13)).select("sma_8", "deduct_8", "slope_up_8", "sma_13"), "date")
    for i, (sma8, ded8, up8, sma13) in enumerate(out):
        if i < 7:
            assert sma8 is None and ded8 is None and up8 is False
        else:
            assert abs(sma8 - sum(closes[i - 7 : i + 1]) / 8) < 1e-9
            assert ded8 == closes[i - 7]
            assert up8 == (closes[i] > closes[i - 7])
        assert (sma13 is None) == (i < 12)


def test_null_closes_are_dropped_before_averaging(spark):
    df = panel(spark, range(10, 30)).withColumn("close", F.when(F.col("date") != day(5), F.col("close")))
    out = ind.sma_deduction(df, (8,))
    assert out.count() == 19
    assert out.where("sma_8 is not null").count() == 12


def test_resonance_on_a_ramp_and_closed_without_columns(spark):
    out = ind.with_resonance(panel(spark, range(100, 400)))
    assert out.where("resonance").count() == 300 - 143
    assert rows(ind.with_resonance(panel(spark, range(400, 100, -1))).where("resonance")) == []
    bare = panel(spark, [1, 2, 3])
    assert bare.select(ind.resonance_flag(bare.columns).alias("r")).where("r").count() == 0


def test_breakdown_reversal_fixture(spark):
    closes = [100, 98, 96, 95, 94, 92, 90, 88, 85, 82, 80, 87, 91, 93, 95]
    volumes = [1000] * 11 + [5000] * 4
    out = rows(ind.breakdown_reversal(panel(spark, closes, volumes=volumes)).select("date", "breakdown_reversal"), "date")
    support = [None if i < 5 else min(closes[i - 5 : i]) for i in range(15)]
    broke = [s is not None and c < s for c, s in zip(closes, support)]
    expected = [
        i >= 3 and any(broke[i - 3 : i]) and support[i - 1] is not None and closes[i] >= support[i - 1] and volumes[i] > volumes[i - 1]
        for i in range(15)
    ]
    assert [r[1] for r in out] == expected
    assert any(expected)


def _pivots(lows, highs, back=5, ahead=3):
    found = []
    for i in range(back, len(lows) - ahead):
        if lows[i] < min(lows[i - back : i]) and min(lows[i + 1 : i + 1 + ahead]) > lows[i]:
            found.append(("low", i + 1))
        if highs[i] > max(highs[i - back : i]) and max(highs[i + 1 : i + 1 + ahead]) < highs[i]:
            found.append(("high", i + 1))
    return sorted(found)


def test_pivots_match_loops_and_do_not_repaint(spark):
    rng = random.Random(3)
    base = [100 + rng.randint(-9, 9) for _ in range(120)]
    df = panel(spark, base)
    lows, highs = [c - 1 for c in base], [c + 1 for c in base]
    full = ind.confirmed_pivots(df)
    assert sorted((r[0], r[1]) for r in rows(full.select("pivot_type", "pivot_idx"))) == _pivots(lows, highs)
    for cut in (40, 77):
        early = ind.confirmed_pivots(df.where(F.col("date") < F.lit(day(cut))))
        known = full.where(F.col("confirmed_idx") <= cut)
        assert sorted(rows(early)) == sorted(rows(known))


def test_latest_pivot_pair_matches_loops(spark):
    rng = random.Random(11)
    for seed in range(3):
        p = [("low" if rng.random() < 0.5 else "high", i, float(rng.randint(1, 30))) for i in range(2, 30)]
        df = spark.createDataFrame([("A", t, day(i), i, v, i + 3, day(i + 3)) for t, i, v in p],
                                   "symbol string, pivot_type string, pivot_date date, pivot_idx int, pivot_price double, confirmed_idx int, confirmed_at date")
        want = None
        for lt, li, lv in reversed(p):
            if lt != "low":
                continue
            good = [hi for ht, hi, hv in p if ht == "high" and hi > li and hv > lv]
            if good:
                want = (li, max(good))
                break
        got = rows(ind.latest_pivot_pair(df).select("p0_idx", "p1_idx"))
        assert got == ([want] if want else [])


def test_wave_targets_and_fib_counts(spark):
    df = spark.createDataFrame([(100.0, 200.0)], "p0 double, p1 double")
    r = ind.wave_targets(df).first()
    assert r.p2 == 200 - 100 * 0.618
    assert r.wave1_amplitude == 100.0 and r.wave5_3236 == 423.6 and r.wave3_2000 == 338.2
    n = spark.createDataFrame([(i,) for i in (6, 7, 9, 12, 15, 22, 56, 300)], "n int")
    assert [x[1] for x in rows(n.select("n", ind.fib_match(F.col("n"))), "n")] == [None, 8, 8, 13, None, 21, 55, None]


def test_input_order_and_partitions_do_not_matter(spark):
    df = panel(spark, [100 + (i * 37) % 23 for i in range(90)])
    want = rows(ind.with_resonance(df), "date")
    assert rows(ind.with_resonance(df.orderBy(F.rand(1)).repartition(7)), "date") == want
