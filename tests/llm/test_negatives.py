"""Hard negatives against plain sorting, and the threshold algorithm by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as hn


def plain(rows, asked, positives=5, negatives=3):
    """(anchor, positive, rank, negative, positive score, negative score) by sorting all scores."""
    whole = sorted({(i, lab, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)) for i, lab, v in rows if v and lab is not None and i is not None and all(c is not None and np.isfinite(c) for c in v)})
    out = []
    for a, lab, x in whole:
        if not asked(a):
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), i, m) for i, m, y in whole if i != a and len(y) == len(x)]
        for s, p, _ in sorted(t for t in scored if t[2] == lab)[:positives]:
            fits = sorted(t for t in scored if t[2] != lab and 50 * -s <= 100 * -t[0] <= 95 * -s)
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, 0.5, [1]) for r in rows], "vec_id long, label int, embedding array<float>, block int, score double, x array<int>")
    return sorted(map(tuple, hn.hard_negatives(table, F.col("vec_id") % 5 == 0, **options).collect()))


@pytest.fixture
def small_units(monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 40)
    monkeypatch.setattr(hn, "ANCHORS", 7)


def test_equal_to_sorting(spark, small_units):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(4)), [float(c) for c in rng.normal(0, 0.3, 6).astype(np.float32)]) for i in range(260)]
    found = mined(spark, rows)
    assert found == plain(rows, lambda i: i % 5 == 0)
    assert len(found) > 300


def test_ties_copies_and_odd_rows(spark, small_units):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), [float(c) for c in rng.integers(-2, 3, 5) / 4]) for i in range(150)]
    rows += [(1000 + i, 1, [0.5, 0.5, 0.25, 0.0, -0.5]) for i in range(90)]  # a vector in a third of all rows
    rows += rows[:9] + [(300, 1, [0.0] * 5), (301, None, [1.0] * 5), (302, 2, None), (303, 2, [1.0, None, 1.0, 1.0, 1.0]), (304, 2, [float("inf")] * 5)]
    rows += [(305, 2, [float("nan")] * 5), (306, 2, []), (None, 1, [1.0] * 5), (310, 1, [0.5, 0.5]), (311, 2, [0.4, 0.4]), (315, 1, [0.6, 0.5])]
    assert mined(spark, rows) == plain(rows, lambda i: i % 5 == 0)
    assert mined(spark, []) == []
    assert mined(spark, rows[:1]) == []


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(2)), [float(np.float32(c)) for c in rng.normal(0, 3e5, 4)]) for i in range(60)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 5 == 0)


@pytest.mark.parametrize("width", [1, 3, 20])
def test_threshold_algorithm(width):
    rng = np.random.default_rng(width)
    x = rng.integers(-9, 10, (500, width))
    ids = rng.permutation(500)
    lists = hn.SortedLists(x)
    for _ in range(20):
        a = rng.integers(-5, 6, width)
        eligible = rng.random(500) < 0.5
        windows = [(-(2**63), 2**63 - 1), (0, 10), (20, 15), (-30, -4), (10**6, 10**7)]
        scores = x @ a
        for (low, high), (at, got) in zip(windows, lists.search(a, eligible, ids, windows, 4), strict=True):
            order = sorted((-scores[i], ids[i]) for i in range(500) if eligible[i] and low <= scores[i] <= high)[:4]
            assert [(-s, i) for s, i in zip(got, ids[at], strict=True)] == order


def test_search_stops_early():
    """Long lists are read in part where one dimension decides."""
    x = np.zeros((4096, 2), np.int64)
    x[:, 0] = np.arange(4096)
    lists, scored = hn.SortedLists(x), []
    lists._score = lambda m, a, new, scores: (scored.append(int(new.sum())), hn.SortedLists._score(m, a, new, scores))
    (best,) = lists.search(np.array([3, 0]), np.ones(4096, bool), np.arange(4096), [(-(2**63), 2**63 - 1)], 5)
    assert list(best[0]) == [4095, 4094, 4093, 4092, 4091]
    assert sum(scored) == 4096 // hn.STEPS
