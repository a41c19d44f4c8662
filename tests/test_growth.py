"""Steps that must not be repeated, and rows a task may hold."""

import re

from pyspark.sql import functions as F

from tests.helpers import day, rows
from tidemark.operators import confluence as cf, documents as dc, quality as qa, walkforward as wf
from tidemark.plans import catalog
from tidemark.sources import landed as ld, sinks as sk


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def shuffles(df):
    return re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_stored_documents_are_parsed_once(spark):
    text = '{"output":{"target_confluence":{"supporting_methods":[{"candidate_id":"a","method_family":"VAL-01","semantic_role":"target","price":"5"}],"overlap_ranges":[{"cluster_id":"c","price_low":"1","price_high":"2"}]}}}'
    out = dc.scenario_subjects(spark.createDataFrame([("S", text), ("T", None)], "symbol string, document string").repartition(2))
    assert {(r.symbol, r.subject_id, float(r.price_low)) for r in out.collect()} == {("S", "a", 5.0), ("S", "c", 1.0)}
    assert plan(out).count("parseJson") == 1


def test_documents_of_a_pair_meet_before_their_fields_become_rows(spark):
    a = spark.createDataFrame([(1, '{"output":{"liquidity":{"status":"x"}}}'), (2, None)], "pair_id long, document string")
    c = spark.createDataFrame([(1, '{"output":{"liquidity":{"status":null}}}'), (3, '{"output":{"data_quality":{"status":"y"}}}')], "pair_id long, document string")
    out = dc.document_diff(a, c)
    assert {(r.pair_id, r.field_path, r.before, r.after) for r in out.collect()} == {(1, "liquidity.status", "x", None), (3, "data_quality.status", None, "y")}
    assert not [s for s in shuffles(out) if "field_path" in s]


def test_envelopes_are_parsed_once(spark):
    texts = spark.createDataFrame([("S", '{"stat":"OK","data":[["1,5",null],null]}'), ("T", '{"stat":"NO","data":[["2"]]}')], "symbol string, text string").repartition(2)
    out = ld.envelope_rows(texts.select("symbol", F.from_json("text", ld.ENVELOPE).alias("e")).select("symbol", "e.*"))
    assert sorted((r.symbol, r.row is None) for r in out.collect()) == [("S", False), ("S", True)]
    assert plan(out).count("from_json") == 1


def test_members_of_a_point_are_not_dealt_again(spark):
    def target(c, family, lo, hi):
        return ("O", c, family, "target", lo, hi, ["k" + c])

    df = spark.createDataFrame([target("a", "VAL-01", 1.0, 3.0), target("b", "FB-03", 2.0, 90.0), target("z", "FB-04", 2.5, 2.6)], "symbol string, candidate_id string, method_family string, semantic_role string, lo double, hi double, dependency_keys array<string>")
    df = df.withColumns({c: F.col(c).cast("decimal(20,4)") for c in ("lo", "hi")}).repartition(2)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = cf.overlap_clusters(df, 40.0, ((2, "low"),), ("VAL-01", "FB-03"))
        assert not [s for s in shuffles(out) if "point" in s]
        assert [(list(r.candidate_ids), float(r.price_low)) for r in out.collect()] == [(["a", "b"], 2.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_lines_of_a_document_are_dealt_once(spark, tmp_path):
    """The methods of a document are gathered where its lines were dealt; repeated lines count once."""
    lines = [(1, 100, 5, 3, 2.0), (1, 111, 6, 1, 1.0), (1, 111, 6, 1, 1.0), (1, 950, 7, 4, 1.0), (1, 101, 8, 2, 3.0), (1, 11, 9, 6, 1.0), (None, 100, 5, 1, 1.0), (2, 100, 5, 2, 1.0)]
    frame = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
    spark.createDataFrame(lines, frame).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = catalog.QUERIES["snapshot_subjects"](spark, str(tmp_path))
        # By the planner's need only targets of a price bucket, points and finished clusters are moved.
        assert out._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS") == 3
        got = sorted((r.symbol or "", r.subject_type, r.subject_id if r.evidence_strength is None else "", float(r.price_low), float(r.price_high)) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = [
        ("O1", "target_candidate", "1-3-100-5-2", 891.8, 928.2), ("O1", "target_candidate", "1-1-111-6-1", 892.878, 892.878), ("O1", "target_candidate", "1-4-950-7-1", 975.1, 975.1),
        ("O1", "support_candidate", "1-2-101-8-3", 891.898, 891.898), ("O1", "target_cluster", "", 892.878, 928.2),
        ("O2", "support_candidate", "2-2-100-5-1", 891.8, 891.8), ("", "target_candidate", "1-100-5-1", 891.8, 891.8),
    ]
    assert got == sorted(want)


def test_candidates_side_by_side_give_the_figures_of_each(spark):
    bars = spark.range(60).select(
        F.lit("A").alias("symbol"), F.lit(1).alias("window_no"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        (100 + F.col("id") % 7).cast("double").alias("open"), (100 + F.col("id") % 5).cast("double").alias("close"),
        F.array(*[F.struct(F.lit(n).alias("candidate_id"), (F.col("id") % k < 2).cast("int").alias("pos")) for n, k in (("x", 4), ("y", 9))]).alias("candidates"),
    )
    keys = ["symbol", "window_no", "candidate_id"]
    one = wf.risk_metrics(wf.position_equity(wf.each_candidate(bars), keys), keys)
    both = wf.candidate_metrics(bars, keys[:2], ["x", "y"])
    assert rows(one.select(both.columns), "candidate_id") == rows(both, "candidate_id")
    text = plan(both)
    assert text.index("Generate") < text.index("Window")


def test_a_batch_is_dealt_by_key_and_by_content_only(spark):
    frame = "idempotency_key string, fingerprint string"
    old = spark.createDataFrame([("k1", "f1"), ("k2", "f9")], frame)
    new = spark.createDataFrame([("k1", "f1"), ("k2", "f2"), ("k3", "f3"), ("k3", "f3"), ("k4", "f3"), ("k5", "f4"), ("k5", "f5")], frame)
    out = sk.append_decision(old, new)
    want = {("k1", "f1", "unchanged"), ("k2", "f2", "conflict"), ("k3", "f3", "append"), ("k4", "f3", "unchanged"), ("k5", "f4", "append"), ("k5", "f5", "conflict")}
    assert {tuple(r) for r in out.select("idempotency_key", "fingerprint", "decision").collect()} == want
    assert not [s for s in shuffles(out) if "fingerprint" in s and "idempotency_key" in s]


def test_a_profile_orders_its_rows_once_and_builds_no_gaps(spark):
    def bar(symbol, n, order, close):
        return (symbol, None if n is None else day(n), order, 1.0, 2.0, 1.0, close, 5.0)

    data = [bar("A", 0, 1, 1.0), bar("A", 4, 2, 2.0), bar("A", 4, 3, 2.0), bar("A", 2, 4, 0.0), bar("A", None, 5, 1.0)]
    data += [bar("B", 1, 1, 1.0), bar("B", 3, 1, None), bar("B", 7, 1, 1.0), bar(None, 0, 2, 1.0), bar(None, 1, 1, 1.0)]
    raw = spark.createDataFrame(data, "symbol string, date date, ingest_order int, open double, high double, low double, close double, volume double").repartition(3)
    out = qa.data_quality_profile(raw, spark.createDataFrame([(day(n),) for n in range(0, 10, 2)] + [(day(3),)], "date date"))
    got = {r.symbol: (r.row_count, r.duplicate_dates, r.missing_close, r.invalid_price_rows, r.large_return_rows, r.max_calendar_gap_days, r.non_monotonic_dates, r.missing_reference_dates) for r in out.collect()}
    # Of the calendar (0, 2, 3, 4, 6, 8) A lacks 3, and B, from 1 to 7, lacks 2, 4 and 6.
    assert got == {"A": (5, 2, 0, 1, 1, 2, True, 1), "B": (3, 0, 1, 0, 0, 4, False, 3), None: (2, 0, 0, 0, 0, 1, True, 0)}
    text = plan(out)
    assert "Generate" not in text and "Expand" not in text
    assert len(re.findall(r"\+- Window \[.*symbol#\d+\], \[date#\d+", text)) == 1
