import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from helpers import day, rows
from tidemark.functions.canonical import fingerprint
from tidemark.operators import diff, freshness as fr, scenarios as sc, validate as va
from tidemark.sources import dimensions as dm, landed as ld, panel as pn, sinks as sk
from tidemark.streaming import ledger as st


def _write(path, obj):
    path.write_text(json.dumps(obj, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_landed_envelopes_from_files(spark, tmp_path):
    good = {"stat": "OK", "title": "x", "data": [["103/01/02", "4,462", "92,115", "910", "8,612.54", "--"]]}
    bad = {"stat": "ERROR", "data": []}
    _write(tmp_path / "a.json", good)
    _write(tmp_path / "b.json", bad)
    env = ld.read_json(spark, str(tmp_path), ld.ENVELOPE)
    assert rows(ld.market_month(env)) == [(dt.date(2014, 1, 2), 4462, 92115, 910, 8612.54, None)]
    assert ld.envelope_rejects(env).count() == 1
    short = spark.createDataFrame([("1301", "OK", [["114/08/01", "50", "2", "41.8", "--", "40", "40.7", "-1.95", "27"]])], f"symbol string, {ld.ENVELOPE}")
    r = ld.stock_day(short).first()
    assert (r.volume, r.high, r.note, r.trade_date) == (50, None, "", dt.date(2025, 8, 1))


def test_money_supply_finds_the_category(spark, tmp_path):
    doc = {"data": {"dataSets": [["2026M05", "1", "0", "13,000", "1.0", "9", "0"]], "structure": {"Table1": [{"data": "Ｍ１Ａ"}, {"data": "x Ｍ１ Ｂ"}, {"data": "Ｍ２"}]}}}
    m = ld.money_supply(ld.read_json(spark, _write(tmp_path / "m.json", doc), ld.MONEY))
    assert rows(m) == [("2026-05", dt.date(2026, 5, 31), 13000.0, "TWD_million")]


def test_snapshot_csv_header_and_rules(spark, tmp_path):
    head = "symbol,date,open,high,low,close,volume\n"
    (tmp_path / "ok.csv").write_text(head + "A,2020-01-01,1,2,0.5,1.5,10\nA,2020-01-02,1,0.9,0.5,1.5,10\n")
    (tmp_path / "bad.csv").write_text(head.replace("volume", "vol") + "A,2020-01-01,1,2,0.5,1.5,10\n")
    v = pn.snapshot_violations(pn.read_snapshot_csv(spark, str(tmp_path / "ok.csv")))
    assert rows(v.select("date", "reasons")) == [(dt.date(2020, 1, 2), ["high_low_inconsistent"])]
    with pytest.raises(Exception):
        pn.read_snapshot_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "o"), ("b", 5, "o")], "k string, fetched_at int, v string")
    new = spark.createDataFrame([("a", 1, "n"), ("b", 4, "n"), ("c", 1, "n")], "k string, fetched_at int, v string")
    merged = sk.keyed_upsert(old, new, ["k"])
    assert rows(merged.select("k", "v"), "k") == [("a", "n"), ("b", "o"), ("c", "n")]
    sk.write_version(merged, str(tmp_path / "t"), "1")
    with pytest.raises(Exception):
        sk.write_version(merged, str(tmp_path / "t"), "1")
    sk.write_results({"x": merged}, str(tmp_path / "r"), "run1")
    sk.write_results({"x": merged}, str(tmp_path / "r"), "run2")
    assert spark.read.parquet(str(tmp_path / "r" / "x")).groupBy("run_id").count().count() == 2
    panel = spark.createDataFrame([("A", day(0), 1.0), ("A", day(400), 2.0)], "symbol string, date date, close double")
    sk.write_snapshot(panel, {"unresolved": merged}, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap" / "panel")).where("year = 2021").count() == 1


def test_append_decisions(spark):
    shape = "idempotency_key string, fingerprint string"
    old = spark.createDataFrame([("k1", "f1")], shape)
    new = spark.createDataFrame([("k1", "f1"), ("k1", "f2"), ("k2", "f3"), ("k2", "f3"), ("k3", "f4"), ("k3", "f5")], shape)
    got = {(r[0], r[1]): r[2] for r in rows(sk.append_decision(old, new))}
    assert got == {("k1", "f1"): "unchanged", ("k1", "f2"): "conflict", ("k2", "f3"): "append", ("k3", "f4"): "append", ("k3", "f5"): "conflict"}


def test_dimensions(spark, tmp_path):
    facts = {"evidence_level": "A", "implementation_mode": "verified_core", "human_approval_required": False, "project_operationalization": False}
    lines = [json.dumps({"rule_id": r, **facts, "allowed_outputs": ["x"], "forbidden_uses": [], "rule_version": "1"}) for r in ("R1", "R2")]
    (tmp_path / "rules.json").write_text("\n".join(lines))
    rules = dm.rule_registry(spark, str(tmp_path / "rules.json"))
    assert dm.dimension_defects(rules, "rule_id", ("evidence_level",)).count() == 0
    assert dm.dimension_defects(rules.union(rules.limit(1)), "rule_id").count() == 1


@pytest.mark.parametrize("delay", [None, "1 hour"])
def test_stream_append_is_idempotent_over_restarts(spark, tmp_path, delay):
    schema = "id int, value double, ingested_at timestamp"
    base = str(tmp_path)

    def land(data):
        spark.createDataFrame(data, schema).write.mode("append").parquet(f"{base}/in")

    def run():
        s = st.file_stream(spark, f"{base}/in", schema)
        s = s.withColumns({"fingerprint": fingerprint(F.concat_ws("|", "id", "value")), "idempotency_key": F.col("id").cast("string")})
        st.ledger_append(s, {"value_not_positive": F.col("value") <= 0}, f"{base}/ledger", f"{base}/rejects", f"{base}/ck", delay).awaitTermination()

    at = dt.datetime(2024, 1, 1)
    land([(1, 1.0, at), (2, -1.0, at), (1, 1.0, at)])
    run()
    land([(1, 1.0, at + dt.timedelta(days=9)), (1, 7.0, at + dt.timedelta(days=9)), (3, 3.0, at + dt.timedelta(days=9))])
    run()
    run()
    assert rows(spark.read.parquet(f"{base}/ledger").select("id", "value"), "id") == [(1, 1.0), (3, 3.0)]
    assert rows(spark.read.parquet(f"{base}/rejects").select("id", "value", "reasons"), "id", "value") == [(1, 7.0, ["idempotency_conflict"]), (2, -1.0, ["value_not_positive"])]


def test_diffs(spark):
    shape = "pair_id string, k string, text string"
    a = spark.createDataFrame([("p", "x", "1"), ("p", "y", "a"), ("p", "y", "a"), ("p", "y", "b"), ("p", "z", "9")], shape)
    b = spark.createDataFrame([("p", "x", "2"), ("p", "y", "a"), ("p", "y", "c"), ("p", "z", "9")], shape)
    pick = lambda df: sorted((r.identity, r.before, r.after) for r in df.collect())
    assert pick(diff.record_list_diff(a, b, "c", "s", "f")) == [("x", "1", "2"), ("y|exact:1", "b", None), ("y|exact:2", None, "c")]
    assert pick(diff.multiset_diff(a, b, "c", "s", "f")) == [("x", "1", "2"), ("y|added:0", None, "c"), ("y|removed:0", "a", None), ("y|removed:1", "b", None)]
    assert pick(diff.multiset_diff(a.orderBy(F.rand(5)), b, "c", "s", "f")) == pick(diff.multiset_diff(a, b, "c", "s", "f"))
    dep = "pair_id string, section string, resource_type string, resource_id string, logical_resource_id string, revision_number int, approval_ids array<string>"
    x = spark.createDataFrame([("p", "s", "t", "r1", "L", 1, ["a"]), ("p", "s", "t", "r9", None, 1, [])], dep)
    y = spark.createDataFrame([("p", "s", "t", "r2", "L", 2, ["a"]), ("p", "s", "t", "r8", "", 1, [])], dep)
    assert sorted((r.change_type, r.identity) for r in diff.dependency_diff(x, y).collect()) == [
        ("dependency_added", "s|t|r8"), ("dependency_removed", "s|t|r9"), ("resource_revision_changed", "s|t|L")]


def test_rollup_orders(spark):
    df = spark.createDataFrame([("a", "stale"), ("a", "unknown"), ("b", "current"), ("c", None)], "g string, s string")
    snap = {r[0]: r[1] for r in rows(df.groupBy("g").agg(fr.rollup(F.col("s"))))}
    rev = {r[0]: r[1] for r in rows(df.groupBy("g").agg(fr.rollup(F.col("s"), fr.REVIEW_ORDER)))}
    assert snap == {"a": "stale", "b": "current", "c": "unknown"} and rev["a"] == "unknown"


def test_tranches_and_levels(spark):
    plan = spark.createDataFrame([(1, "100.00", [1, 2, 3], "approved", "ENT-02"), (2, "0.05", [1], None, None)], "plan_id int, planned_total_capital string, trigger_stages array<int>, decision string, rule_id string")
    got = rows(sc.tranche_plan(plan).select("plan_id", "stage", F.col("capital_budget").cast("string"), "status"), "plan_id", "stage")
    assert [g[2] for g in got] == ["33.33", "33.33", "33.34", "0.02", "0.02", "0.01"] and got[0][3] == "available" and got[3][3] == "needs_human_input"
    lv = spark.createDataFrame([(100.0, 150.0, 120.0), (150.0, 100.0, 40.0), (5.0, 5.0, 9.0)], "a double, b double, c double")
    assert [None if r[0] is None else float(r[0]) for r in sc.equal_amplitude(lv).select("calculated_level").collect()] == [170.0, None, None]
    assert [None if r[0] is None else float(r[0]) for r in sc.retracement_0382(lv).select("calculated_level").collect()] == [130.9, None, None]


def test_noop_and_supersession(spark):
    df = spark.createDataFrame([(1, "d", "x"), (2, "d", "x"), (3, "d", None), (4, "d", None), (5, "d", "x")], "id int, k string, s string").withColumn("b", F.expr("id div 2"))
    assert rows(va.changed_only(df, ["k"], ["id"], ["s"], "b").select("id", "revision_number"), "id") == [(1, 1), (3, 2), (5, 3)]
    assert rows(va.supersession(df, ["k"], ["id"], ["s"], "b").select("id", "supersedes_id"), "id") == [(1, None), (2, None), (3, 2), (4, None), (5, 4)]
