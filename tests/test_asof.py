import datetime as dt
import random

from pyspark.sql import functions as F

from helpers import day, rows
from tidemark.operators import asof, valuation as val

LEDGER = "id int, logical_id string, revision_number int, available_at timestamp, ingested_at timestamp, status string"


def ts(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def test_revoked_latest_hides_older_and_both_clocks_count(spark):
    led = spark.createDataFrame(
        [(1, "L", 1, ts(0), ts(0), "active"), (2, "L", 2, ts(5), ts(9), "revoked"), (3, "M", 1, ts(1), ts(1), "active")], LEDGER
    )
    at = lambda n: rows(asof.latest_revision_asof(led, str(ts(n))).select("logical_id", "id"), "logical_id")
    assert at(6) == [("L", 1), ("M", 3)]  # revision 2 is public but not yet ingested
    assert at(9) == [("L", 2), ("M", 3)]
    assert asof.latest_revision_asof(led, str(ts(9))).where("status = 'active' and logical_id = 'L'").count() == 0


def test_many_cutoffs_equal_single_cutoffs(spark):
    rng = random.Random(5)
    data = [(i, f"L{rng.randint(0, 5)}", rng.randint(1, 6), ts(a := rng.randint(0, 40)), ts(a + rng.randint(0, 8)), "active") for i in range(120)]
    led = spark.createDataFrame(data, LEDGER)
    cuts = [str(ts(n)) for n in (3, 11, 12, 30, 60)]
    many = asof.latest_revision_at_cutoffs(led, cuts)
    for c in cuts:
        one = rows(asof.latest_revision_asof(led, c).select("logical_id", "id"))
        got = rows(many.where(F.col("cutoff") == F.lit(c).cast("timestamp")).select("logical_id", "id"))
        assert sorted(one) == sorted(got)


def _brute(left, right, forward):
    out = []
    for k, t, i in left:
        c = [r for r in right if r[0] == k and (r[1] > t if forward else r[1] <= t)]
        out.append((i, (min if forward else max)(c, key=lambda r: r[1])[2] if c else None))
    return sorted(out)


def test_asof_joins_match_brute_force(spark):
    rng = random.Random(9)
    left = [(rng.choice("ab"), ts(rng.randint(0, 400)), i) for i in range(150)]
    right = [(k, ts(n), f"{k}{n}") for k in "ab" for n in sorted(rng.sample(range(400), 25))]
    lf = spark.createDataFrame(left, "k string, t timestamp, i int")
    rf = spark.createDataFrame(right, "k string, rt timestamp, v string")
    month = lambda t: F.date_trunc("month", t)
    for forward in (False, True):
        want = _brute(left, right, forward)
        for fn in (asof.asof_join, asof.asof_lookup):
            got = fn(lf, rf, "t", "rt", ["v"], month, keys=("k",), forward=forward)
            assert sorted(rows(got.select("i", "v"))) == want, (fn.__name__, forward)


def test_bucketed_lag_equals_plain_lag(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab"), x, x // 10) for x in rng.sample(range(300), 120)]
    df = spark.createDataFrame(data, "k string, x int, b int")
    got = {(r[0], r[1]): r[2] for r in rows(asof.bucketed_lag(df, ["k"], "b", ["x"], ["x"]).select("k", "x", "prev_x"))}
    for k in "ab":
        xs = sorted(x for kk, x, _ in data if kk == k)
        assert [got[(k, x)] for x in xs] == [None, *xs[:-1]]


def test_bucketed_lag_moves_dealt_rows_once(spark):
    """Without a join, whatever is null: rows dealt by key stay, and buckets of a key that is null inherit nothing."""
    data = [("a", None, None, "n"), ("a", 1, 0, "p"), ("a", 25, 2, None), ("a", 27, 2, "q"), ("a", 41, 4, "r"), ("b", 3, 0, "s"), (None, 1, 0, "t"), (None, 2, 0, "u"), (None, 15, 1, "v")]
    df = spark.createDataFrame(data, "k string, x int, b int, v string")
    got = asof.bucketed_lag(df.repartition(3, "k"), ["k"], "b", ["x"], ["v", "b", "k"])
    none = (None, None, None)
    prev = {r.v: (r.prev_v, r.prev_b, r.prev_k) for r in got.collect()}
    assert prev == {"n": none, "p": ("n", None, "a"), None: ("p", 0, "a"), "q": (None, 2, "a"), "r": ("q", 2, "a"), "s": none, "t": none, "u": ("t", 0, None), "v": none}
    assert got.columns == ["k", "x", "b", "v", "prev_v", "prev_b", "prev_k"] and got.count() == len(data)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ENSURE_REQUIREMENTS" not in plan


def test_approval_rules(spark):
    df = spark.createDataFrame(
        [("approved", "R", "A", 0, True), ("approved", "R", "C", 0, False), ("approved", "R", "C", 1, True),
         ("approved", "X", "A", 0, False), ("revoked", "R", "A", 0, False), (None, None, None, None, False), ("approved", "R", "U", 1, False)],
        "decision string, rule_id string, evidence_level string, project_operationalization int, want boolean",
    )
    assert df.where(asof.approval_eligible("R") != F.col("want")).count() == 0


def test_eps_growth_reasons(spark):
    df = spark.createDataFrame(
        [("A", 2020, 10.0), ("A", 2021, 12.0), ("B", 2020, 1.0), ("C", 2019, 1.0), ("C", 2021, 2.0), ("D", 2020, 1.0), ("D", 2021, 1.0), ("D", 2021, 2.0), ("E", 2020, -1.0), ("E", 2021, 2.0)],
        "symbol string, fiscal_year int, eps_base double",
    )
    got = {r[0]: (r[1], r[2], r[3]) for r in rows(val.eps_growth(df, ("symbol",)).select("symbol", "reason", "growth_ratio", "passed"))}
    assert got["A"][0] is None and abs(got["A"][1] - 0.2) < 1e-12 and got["A"][2]
    assert got["B"][0] == "forward_eps_growth_requires_two_years"
    assert got["C"][0] == "forward_eps_growth_requires_consecutive_years"
    assert got["D"][0] == "forward_eps_source_selection_ambiguous"
    assert got["E"][0] == "non_comparable_forward_eps"


def test_half_open_validity_and_scopes(spark):
    pe = spark.createDataFrame([("p1", "base", "symbol", "A", 10.0, ts(0), ts(5)), ("p2", "base", "industry", "I", 11.0, ts(0), None)],
                               "pe_id string, label string, scope string, scope_value string, pe_value double, effective_from timestamp, effective_to timestamp")
    assert pe.where(val.effective_at(str(ts(5)))).count() == 1
    assert pe.where(val.effective_at(str(ts(4)))).count() == 2
    sym = spark.createDataFrame([("A", "I", "M"), ("B", "I", "M")], "symbol string, industry string, market string")
    assert rows(val.scope_dispatch(sym, pe).select("symbol", "pe_id", "scope_rank"), "symbol", "scope_rank") == [("A", "p1", 1), ("A", "p2", 2), ("B", "p2", 2)]
