"""Sizes, odd values and rows that must not vanish."""

import datetime as dt

from pathlib import Path

from pyspark.sql import functions as F

from tidemark.operators import confluence as cf, freshness as fr, indicators as ind, quality as ql, screening as sg, snapshots as sn, valuation as val, walkforward as wf
from tidemark.plans import catalog
from tidemark.sources import landed as ld, sinks as sk


def test_queries_over_the_whole_dimension_keep_symbols_without_rows(spark, tmp_path):
    for source in Path("/root/testdata/sf0.001").glob("*.parquet"):
        (tmp_path / source.name).symlink_to(source)
    (tmp_path / "supplier.parquet").unlink()
    known = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet")
    more = known.limit(1).withColumn("s_suppkey", F.lit(999999).cast(known.schema["s_suppkey"].dataType))
    known.unionByName(more).write.parquet(f"{tmp_path}/supplier.parquet")
    for name, rows in (("metric_percentile_asked", 3), ("data_quality_profile_asked", 1), ("buy_and_hold_asked", 1)):
        got = catalog.QUERIES[name](spark, str(tmp_path)).where("symbol = 'S999999'").collect()
        assert len(got) == rows and {r.status for r in got} == {"insufficient_data"}
    assert [r.candidate_count for r in catalog.QUERIES["sensitivity_spread_asked"](spark, str(tmp_path)).where("symbol = 'S999999'").collect()] == [3]


def test_windows_without_a_lot_have_a_status(spark):
    bars = spark.createDataFrame([("A", 1, f"2020-01-0{k}", p, p) for k in (1, 2, 3) for p in (10.0,)] + [("A", 2, f"2021-01-0{k}", 1e6, 1e6) for k in (1, 2, 3)], "symbol string, window_no int, date string, open double, close double")
    metrics = wf.risk_metrics(wf.buy_and_hold_equity(bars, 1e5), ["symbol", "window_no"])
    asked = spark.createDataFrame([("A",), ("Z",)], "symbol string")
    got = wf.buy_and_hold_status(asked, bars.select("symbol", "window_no").distinct(), metrics).collect()
    assert {(r.symbol, r.window_no, r.status) for r in got} == {("A", 1, "available"), ("A", 2, "cash_below_one_lot"), ("Z", None, "insufficient_data")}


def test_large_and_non_finite_amounts(spark):
    df = spark.createDataFrame([(1.2e12, 5e11, 1e6), (float("inf"), 0.0, 1.0), (float("nan"), 0.0, 1.0)], "nopat double, invested_capital double, shares double")
    got = [r.eva for r in val.eva_floor(df, 0.07).collect()]
    assert got == [1.2e12 - 3.5e10, None, None]
    bands = val.pe_bands(spark.createDataFrame([(2e10,), (1e30,)], "eps double"), (10.0, 15.0, 20.0)).collect()
    assert [r.expensive_price for r in bands] == [4e11, None]


def test_moving_averages_depend_on_their_own_rows_only(spark):
    flat = spark.range(400).select(F.lit("A").alias("symbol"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.lit(33.35).alias("close"))
    odd = flat.withColumn("close", F.when(F.dayofyear("date") == 3, 1e15).otherwise(F.col("close"))).withColumn("symbol", F.lit("B"))
    wild = flat.withColumn("close", F.when(F.dayofyear("date") == 3, float("inf")).otherwise(F.col("close"))).withColumn("symbol", F.lit("C"))
    rows = ind.with_resonance(flat.unionByName(odd).unionByName(wild)).where("date > '2020-11-01' and date < '2020-12-31'").collect()
    assert rows and all(r.sma_8 == r.sma_13 == r.sma_21 == r.sma_55 == 33.35 and not r.resonance for r in rows)


def test_every_dependency_is_answered(spark):
    ledger = spark.createDataFrame([], "id long, logical_id string, revision_number int, available_at timestamp, ingested_at timestamp, status string")
    approvals = spark.createDataFrame(
        [], "approval_event_id string, resource_id long, decision string, rule_id string, evidence_level string, project_operationalization int, available_at timestamp, ingested_at timestamp"
    )
    deps = spark.createDataFrame([("S", "eps", 1, "x"), ("S", "other", 2, "y"), ("S", None, 3, "z")], "snapshot_id string, resource_type string, resource_id long, logical_resource_id string")
    got = {r.resource_id: (r.status, r.reason) for r in fr.dependency_freshness(deps, ledger, approvals, "2020-01-01", "VAL-02", "eps").collect()}
    want = {1: ("blocked", "snapshot_dependency_missing"), 2: ("unknown", "unsupported_resource_type"), 3: ("unknown", "unsupported_resource_type")}
    assert got == want
    ledgers = {"eps": fr.Ledger(ledger, rules=("VAL-02",)), "pe": fr.Ledger(ledger, rules=("VAL-04",))}
    both = fr.freshness_over_ledgers(deps, ledgers, approvals.withColumn("resource_type", F.lit("eps")), "2020-01-01")
    named = {1: want[1], 2: ("unknown", "unsupported_dependency_type_other"), 3: ("unknown", "unsupported_dependency_type_missing")}
    assert {r.resource_id: (r.status, r.reason) for r in both.collect()} == named


def test_freshness_of_providers_bindings_and_validity(spark):
    shape = "id string, logical_id string, revision_number int, available_at timestamp, ingested_at timestamp, status string, eligible boolean, until int"
    at = dt.datetime(2020, 1, 1)
    rows = [("a1", "a", 1, at, at, "active", True, 9), ("a2", "a", 2, at, at, "active", False, 9), ("b1", "b", 1, at, at, "active", True, 0), ("c1", "c", 1, at, at, "active", True, 9), ("c2", "c", 2, at, at, "gone", True, 9)]
    ledger = spark.createDataFrame(rows, shape)
    none = spark.createDataFrame([], "approval_event_id string, resource_type string, resource_id string, decision string, rule_id string, evidence_level string, project_operationalization int, available_at timestamp, ingested_at timestamp")
    deps = spark.createDataFrame([("k", r[0], r[1]) for r in rows], "resource_type string, resource_id string, logical_resource_id string")
    own = {"k": fr.Ledger(ledger, valid=F.col("until") > 5, bound=F.col("eligible"), resources=("p", "q"))}

    def states(*health):
        table = spark.createDataFrame(list(health), "resource_id string, status string, freshness string")
        got = fr.freshness_over_ledgers(deps, own, none, "2021-01-01", table).collect()
        assert {r.resource_id: r.reason for r in got if r.resource_id != "a1"} == {
            "a2": "publication_evidence_binding_invalid", "b1": "no_eligible_dependency_revision", "c1": "dependency_revoked", "c2": "dependency_revoked"}
        return next((r.status, r.reason) for r in got if r.resource_id == "a1")

    good = ("p", "accepted", "current")
    assert states(good, ("q", "accepted", "current")) == ("current", None)
    assert states(good, ("q", "accepted", "stale")) == ("stale", "dependency_source_stale")
    assert states(good, ("q", "x", "unknown")) == ("unknown", "dependency_freshness_unknown")
    assert states() == ("unknown", "dependency_freshness_unknown")
    assert states(good, ("q", "provider_error", "blocked")) == ("blocked", "dependency_provider_error")
    assert states(good, ("q", "rejected", "blocked")) == ("blocked", "dependency_operational_blocked")
    plan = fr.freshness_over_ledgers(deps, own, none, "2021-01-01")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 3  # dependencies, the ledger and the events: each read once


def test_one_decision_per_incoming_row(spark):
    shape = "fingerprint string, idempotency_key string"
    old = spark.createDataFrame([("f0", "k0")], shape)
    new = spark.createDataFrame([("f1", "k1"), ("f1", "k2"), ("f2", "k0"), ("f0", "k9")], shape)
    got = {(r.fingerprint, r.idempotency_key): r.decision for r in sk.append_decision(old, new).collect()}
    assert got == {("f1", "k1"): "append", ("f1", "k2"): "unchanged", ("f2", "k0"): "conflict", ("f0", "k9"): "unchanged"}


def test_writing_a_run_again_replaces_it(spark, tmp_path):
    df = spark.range(3)
    for _ in range(2):
        sk.write_results({"x": df}, str(tmp_path), "r1")
    sk.write_results({"x": df}, str(tmp_path), "r2")
    assert spark.read.parquet(f"{tmp_path}/x").groupBy("run_id").count().orderBy("run_id").collect() == [("r1", 3), ("r2", 3)]


def test_rejected_candidates_and_a_third_family(spark):
    shape = "symbol string, candidate_id string, method_family string, evidence_level string, price decimal(18,4), dependency_keys array<string>"
    rows = [("A", c, f, lv, p, [c]) for c, f, lv, p in (("a", "F1", "A", 10), ("b", "F2", "A", 10), ("c", "F3", "A", 10), ("d", "F9", "A", 10), ("e", "F1", "U", 10), ("g", "F1", "A", -1))]
    df = spark.createDataFrame(spark.createDataFrame(rows, shape.replace("decimal(18,4)", "int")).withColumn("price", F.col("price").cast("decimal(18,4)")).collect(), shape)
    families = ("F1", "F2", "F3")
    bad = {r.candidate_id: r.exclusion_reason for r in cf.rejected_candidates(df, families).collect()}
    assert bad == {"d": "method_family_not_allowed_by_profile", "e": "evidence_level_unverified", "g": "price_not_positive"}
    good = cf.normalize_candidates(df, "0.02", families)
    assert good.count() + len(bad) == len(rows)
    (cluster,) = cf.overlap_clusters(good, 40.0, ((2, "low"), (3, "moderate")), families).collect()
    assert (cluster.independent_method_count, cluster.status) == (3, "available")


def test_landed_documents_without_data_are_rejects(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"stat": "OK"}')
    (tmp_path / "b.json").write_text('{"stat": "no"}')
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text('{"stat": "OK", "data": [["103/01/02", "1", "2", "3", "4", "5"]]}')
    env = ld.read_json(spark, str(tmp_path), ld.ENVELOPE)
    assert sorted(r.reason for r in ld.envelope_rejects(env).collect()) == ["accepted_without_data", "document_unreadable", "response_not_ok:no"]
    assert ld.market_month(env).count() == 1
    docs = spark.createDataFrame([(([["103M01", "1", "2"]], ([("M2",)],)),), (([["103M01", "1", "2"]], ([("M1B",)],)),)], ld.MONEY)
    assert [r.reason for r in ld.money_supply_rejects(docs).collect()] == ["category_missing"]
    assert ld.money_supply(docs).count() == 1


def test_queue_page_takes_its_limit_and_breaks_ties_by_symbol(spark):
    df = spark.range(80).select(F.col("id").alias("item_id"), F.format_string("S%02d", 79 - F.col("id")).alias("symbol"), F.lit("2020-01-01").cast("timestamp").alias("updated_at"), F.lit(False).alias("archived"))
    page = sn.queue_page(df, "updated", limit=80).collect()
    assert len(page) == 80 and [r.symbol for r in page] == sorted(r.symbol for r in page)


def test_symbols_without_rows_are_kept_as_insufficient(spark):
    asked = spark.createDataFrame([("A", "c1"), ("Z", "c1")], "symbol string, candidate_id string")
    values = spark.createDataFrame([("A", "2020-01-01", 10.0, 1.0, 0.02)], "symbol string, metric_date string, pe double, pb double, dividend_yield_ratio double")
    values = values.withColumn("metric_date", F.col("metric_date").cast("date"))
    got = sg.metric_percentile(values, "2020-06-01", 5, 1, {"pe": 50, "pb": 50, "dividend_yield": 50}, asked).where("symbol = 'Z'").collect()
    assert {(r.status, r.reason) for r in got} == {("insufficient_data", "no_valuation_history")} and len(got) == 3
    results = spark.createDataFrame([("A", "c1", 1.0, 2.0, 3)], "symbol string, candidate_id string, total_return_pct double, max_drawdown_pct double, total_trades long")
    assert {r.symbol: r.training_window_count for r in wf.sensitivity_summary(results, asked).collect()} == {"A": 1, "Z": 0}
    bars = spark.createDataFrame([("A", "2020-01-01", 1, 1.0, 1.0, 1.0, 1.0, 1.0)], "symbol string, date string, ingest_order int, open double, high double, low double, close double, volume double")
    bars = bars.withColumn("date", F.col("date").cast("date"))
    profile = ql.data_quality_profile(bars, bars.select("date"), symbols=asked).collect()
    assert {r.symbol: (r.row_count, r.status) for r in profile} == {"A": (1, "available"), "Z": (0, "insufficient_data")}
