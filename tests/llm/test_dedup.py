"""Exact copies, line copies and shingle sets against brute force."""

import hashlib
import random
import re

import pytest

from tidemark.llm import exact_dedup as ed
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.graph import components
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.ngram_join import ngram_components

SPACE = r"[\x20\x09-\x0D]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(SPACE, " ", t or ""), []).append(i)
    out = []
    for i, t in rows:
        key = re.sub(SPACE, " ", t or "")
        keep = min((x for x in groups[key] if x is not None), default=None)
        out.append((i, keep, len(groups[key]), i == keep, sha(key)))
    return sorted(out, key=repr)


def test_exact_dedup(spark, odd_docs):
    extra = spark.createDataFrame([(i, "same  text\nhere" if i % 3 else "same text here", None, 0, "", 0.0, "") for i in range(100, 400)], odd_docs.schema)
    docs = odd_docs.unionByName(extra).repartition(5)
    got = sorted((tuple(r) for r in exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)
    assert got == brute_exact(rows_of(docs))
    assert exact_dedup(docs.limit(0)).count() == 0
    assert sorted((tuple(r) for r in exact_dedup(docs, fan_in_bits=1, levels=4).collect()), key=repr) == got


def test_exact_dedup_merges_sorted_runs(spark, odd_docs):
    """Every level deals pieces of runs, sorts them and aggregates in that order; nothing is hashed together."""
    runs = ed.leaf_runs(ed.digests(odd_docs, "doc_id", "text", 8))
    for level in (1, 2, 3):
        runs = ed.merge_round(runs, 1, level)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan.replace("ObjectHashAggregate", "HashAggregate")
    assert plan.count("SortAggregate") >= 4 and plan.count("Sort [run") >= 4
    assert len(re.findall(r"Exchange hashpartitioning\(run#\d+, piece#\d+L", plan)) == 3
    rows = runs.orderBy("run", "piece").collect()
    assert {r.run for r in rows} == {0} and {r.piece for r in rows} <= set(range(8))
    assert [r.piece for r in rows] == [r.digest[0] >> 5 for r in rows]
    assert len({bytes(r.digest) for r in rows}) == len(rows)
    assert sum(r.n for r in rows) == odd_docs.count()
    assert (ed.levels_for(0), ed.levels_for(10**7), ed.levels_for(10**10)) == (2, 3, 6)


def brute_lines(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    last = 2**63 - 1
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), last), last if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or (last if i is None else i) <= owner[key(x)]]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark, odd_docs):
    rng = random.Random(3)
    pool = ["A common line here", " a COMMON line here\r", "short", "", "ünïcode line ten", "another shared line"] + [f"line number {k} of many" for k in range(30)]
    extra = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))), None, 0, "", 0.0, "") for i in range(100, 300)]
    docs = odd_docs.unionByName(spark.createDataFrame(extra, odd_docs.schema)).repartition(6)
    got = sorted((tuple(r) for r in dedup_lines(docs).select("doc_id", "_n_lines", "_n_dropped", "_kept").collect()), key=repr)
    assert got == brute_lines(rows_of(docs))
    assert dedup_lines(docs.limit(0)).count() == 0
    assert set(docs.columns) < set(dedup_lines(docs).columns)


def test_line_dedup_hot_line_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.createDataFrame([(i, f"the very same line\nline of its own {i}") for i in range(500, 0, -1)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r._n_dropped for r in dedup_lines(docs).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: int(i != 1) for i in range(1, 501)}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute_components(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).add(shingle_set(t))
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(s and u and 100 * len(s & u) >= 75 * len(s | u) for s in sets[a] for u in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def near_rows(prose):
    """Chains of edits of many sizes, copies, and texts sharing one passage only."""
    rng = random.Random(11)
    rows, i = [], 1000
    passage = prose(999, 70)
    for base in range(14):
        words = prose(50 + base, rng.choice((3, 4, 5, 6, 9, 17, 40, 64, 70, 150, 300))).split()
        for _ in range(7):
            rows.append((i, " ".join(words)))
            i += 1
            for _ in range(max(1, len(words) // rng.choice((15, 25, 60)))):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                words = words + prose(i, max(1, len(words) // 8)).split()
    for k in range(160):
        rows.append((i + k, f"{prose(5000 + k, 30)} {passage} {prose(7000 + k, 25)}"))
    return rows


@pytest.fixture
def near_docs(spark, odd_docs, prose):
    extra = spark.createDataFrame([(*r, None, 0, "", 0.0, "") for r in near_rows(prose)], odd_docs.schema)
    return odd_docs.unionByName(extra).repartition(5)


def test_ngram_components(near_docs):
    rows = rows_of(near_docs)
    want = brute_components(rows)
    got = ngram_components(near_docs).collect()
    assert len(got) == len(rows)
    assert sorted((repr(r.doc_id), r.n_shingles) for r in got) == sorted((repr(i), len(shingle_set(t))) for i, t in rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_ngram_components_with_frequent_hashes(near_docs, monkeypatch):
    """Small limits: the shared passage counts as frequent, and groups are cut into several blocks."""
    from tidemark.llm import ngram_join

    monkeypatch.setattr(ngram_join, "HOT", 5)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "STAR", 3)
    got = {r.doc_id: r.component_id for r in ngram_components(near_docs).collect() if r.doc_id is not None}
    assert got == brute_components(rows_of(near_docs))


def test_ngram_components_through_repeated_identifiers(spark, prose):
    a, b, c = (prose(k, 40) for k in (71, 72, 73))
    docs = spark.createDataFrame([(3, a), (7, a), (7, b), (9, b), (8, c), (7, None), (6, prose(74, 40))], "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_shingles > 0): r.component_id for r in ngram_components(docs).collect()}
    assert got == {(3, True): 3, (7, True): 3, (9, True): 3, (8, True): 8, (7, False): 7, (6, True): 6}


def test_ngram_components_of_nothing(odd_docs):
    assert ngram_components(odd_docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    rng = random.Random(5)
    names = rng.sample(range(10_000), 300)
    edges = [(a, b) for a, b in zip(names, names[1:], strict=False)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(names, min(names))
