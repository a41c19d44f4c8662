"""Streams with state, and tables of which only touched parts are read and written."""

import datetime as dt
import os
import re

from pyspark.sql import functions as F

from helpers import rows
from tidemark.functions.canonical import fingerprint
from tidemark.sources import sinks as sk
from tidemark.streaming import ledger as st

EVENT = "id int, value double, ingested_at timestamp"
AT = dt.datetime(2024, 1, 1)


def land(spark, path, data, schema):
    spark.createDataFrame(data, schema).write.mode("append").parquet(path)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_append_drops_late_copies_and_lets_late_rows_in(spark, tmp_path):
    """Copies in later batches meet in the state; rows older than all others are no copies and enter."""
    base = str(tmp_path)
    for data in ([(1, 1.0, AT), (2, 2.0, AT)], [(1, 1.0, AT), (3, 3.0, AT - dt.timedelta(days=900)), (3, 3.0, AT)], [(2, 2.0, AT), (3, 4.0, AT)]):
        land(spark, f"{base}/in", data, EVENT)
        s = st.file_stream(spark, f"{base}/in", EVENT).withColumns({"fingerprint": fingerprint(F.concat_ws("|", "id", "value")), "idempotency_key": F.col("id").cast("string")})
        query = st.ledger_append(s, {}, f"{base}/ledger", f"{base}/rejects", f"{base}/ck", parts=4)
        query.awaitTermination()
        assert "dedupe" in str(query.lastProgress).lower()
    assert rows(spark.read.parquet(f"{base}/ledger").select("id", "value"), "id") == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert rows(spark.read.parquet(f"{base}/rejects").select("id", "value")) == [(3, 4.0)]


def test_a_batch_asks_the_state_once(spark, tmp_path):
    """Rows for the ledger and rejects come from one reading of the stream; the steps after it run where shuffles adapt."""
    base, shape = str(tmp_path), "id int, value double"
    for first, new in ((0, 100), (50, 50)):
        land(spark, f"{base}/in", [(i, float(i % 7)) for i in range(first, first + 100)], shape)
        s = st.file_stream(spark, f"{base}/in", shape).withColumns({"fingerprint": fingerprint(F.concat_ws("|", "id", "value")), "idempotency_key": F.col("id").cast("string")})
        query = st.ledger_append(s, {"small": F.col("value") < 2}, f"{base}/ledger", f"{base}/rejects", f"{base}/ck", parts=4)
        query.awaitTermination()
        assert [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]] == [new]
    assert rows(spark.read.parquet(f"{base}/ledger").select("id"), "id") == [(i,) for i in range(150) if i % 7 >= 2]
    assert rows(spark.read.parquet(f"{base}/rejects").select("id"), "id") == [(i,) for i in range(150) if i % 7 < 2]


def test_reads_touched_parts_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = sk.with_part(spark.range(1000), "id", 16)
    df.repartition("part").write.partitionBy("part").parquet(path)
    few = df.where("id < 2")
    got = sk.read_parts(spark, path, few, sk.parts_of(few))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part", plan)
    assert len({os.path.dirname(f) for f in got.select("id").inputFiles()}) <= 2 or got.select(F.input_file_name()).distinct().count() <= 2
    assert {r.id for r in got.collect()} >= {0, 1}


def test_upsert_leaves_other_parts_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    shape = "k int, v string, fetched_at int"
    sk.upsert_into(path, spark.createDataFrame([(k, "old", 1) for k in range(200)], shape), ["k"], parts=16)
    before = files(path)
    touched = sk.upsert_into(path, spark.createDataFrame([(3, "new", 2), (3, "late", 0), (500, "new", 1)], shape), ["k"], parts=16)
    after = files(path)
    assert 1 <= len(touched) <= 2
    for f in set(before) | set(after):
        same = int(re.search(r"part=(\d+)/", f).group(1)) not in touched
        assert same == (before.get(f) == after.get(f))
    got = {r.k: r.v for r in sk.stored_rows(spark, path).collect()}
    assert got == {k: "old" for k in range(200)} | {3: "new", 500: "new"}


def test_range_replace_leaves_other_months_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(120)]
    shape = "symbol string, date date, close double"
    old = spark.createDataFrame([(s, d, 1.0) for s in "AB" for d in days], shape)
    sk.replace_parts(old.withColumn("part", sk.month_of(F.col("date"))), path, [])
    before = files(path)
    ranges = spark.createDataFrame([("A", dt.date(2024, 2, 1), dt.date(2024, 2, 29))], "symbol string, start date, end date")
    new = spark.createDataFrame([("A", dt.date(2024, 2, 5), 2.0), ("B", dt.date(2024, 2, 5), 9.0), ("A", dt.date(2024, 3, 1), 9.0)], shape)
    assert sk.replace_ranges_in(path, new, ranges) == ["2024-02"]
    after = files(path)
    assert {f for f in before if "2024-02" not in f} == {f for f in after if "2024-02" not in f}
    got = {(r.symbol, r.date): r.close for r in sk.stored_rows(spark, path).collect()}
    want = {("A", d): 1.0 for d in days if d.month != 2} | {("B", d): 1.0 for d in days} | {("A", dt.date(2024, 2, 5)): 2.0}
    assert got == want
    # A month that loses all its rows is empty, not as before.
    sk.replace_ranges_in(path, new.limit(0), spark.createDataFrame([(s, dt.date(2024, 1, 1), dt.date(2024, 1, 31)) for s in "AB"], "symbol string, start date, end date"))
    assert sk.stored_rows(spark, path).where("date < '2024-02-01'").count() == 0


def test_three_changes_of_a_day(spark, tmp_path):
    base, shape = str(tmp_path), "trade_date date, market string, value double, ingested_at timestamp"
    day, other = dt.date(2024, 1, 2), dt.date(2024, 1, 3)
    batches = [
        [(day, "A", 10.0, AT)],
        [(day, "B", 5.0, AT), (day, "A", 10.0, AT), (other, "B", 1.0, AT)],
        [(day, "A", 10.0, AT), (day, "B", 5.0, AT)],
        [(day, "A", 9.0, AT + dt.timedelta(hours=2)), (day, "A", 12.0, AT), (day, "C", 3.0, AT), (other, "A", None, AT)],
    ]
    for data in batches:
        land(spark, f"{base}/in", data, shape)
        query = st.turnover_pairing(st.file_stream(spark, f"{base}/in", shape), f"{base}/ledger", f"{base}/ck")
        query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    got = rows(spark.read.parquet(f"{base}/ledger").where(F.col("trade_date") == day), "revision")
    assert got == [(day, 10.0, None, None, "partial", 1), (day, 10.0, 5.0, 15.0, "available", 2), (day, 9.0, 5.0, 14.0, "available", 3)]
    assert rows(spark.read.parquet(f"{base}/ledger").where(F.col("trade_date") == other)) == [(other, None, 1.0, None, "partial", 1)]


def test_gate_releases_waiting_rows_and_names_clashes(spark, tmp_path):
    base, shape, proof = str(tmp_path), "period string, revision int, value double", "period string, revision int, status string"
    steps = [
        ([("p", 1, 2.0), ("p", 1, 1.0), ("p", 2, 5.0)], []),
        ([("p", 1, 1.0)], [("q", 1, "accepted"), ("p", 2, "pending")]),
        ([("q", 1, 7.0)], [("p", 1, "accepted")]),
        ([("p", 1, 3.0)], [("p", 1, "accepted")]),
    ]
    seen = []
    for arrived, proven in steps:
        land(spark, f"{base}/in", arrived, shape)
        land(spark, f"{base}/proof", proven, proof)
        st.evidence_gate(st.file_stream(spark, f"{base}/in", shape), st.file_stream(spark, f"{base}/proof", proof), f"{base}/ledger", f"{base}/wait", f"{base}/clash", f"{base}/ck", parts=4).awaitTermination()
        seen.append(rows(sk.stored_rows(spark, f"{base}/wait"), "period", "revision"))
    assert seen == [[("p", 1, 1.0), ("p", 2, 5.0)]] * 2 + [[("p", 2, 5.0)]] * 2
    cols = ["period", "revision", "value"]
    assert rows(spark.read.parquet(f"{base}/ledger").select(*cols), "period") == [("p", 1, 1.0), ("q", 1, 7.0)]
    assert rows(spark.read.parquet(f"{base}/clash").select(*cols), "value") == [("p", 1, 2.0), ("p", 1, 3.0)]
