"""Stored documents: subjects, registered paths, sections."""

import json

from helpers import rows
from tidemark import constants as K
from tidemark.operators import documents as dc, snapshots as sn


def test_subjects_of_documents(spark):
    methods = [
        {"candidate_id": "a", "method_family": "VAL-01", "semantic_role": "target", "price": 10},
        {"candidate_id": "b", "method_family": "FB-04", "semantic_role": "support", "price_low": 1.25, "price_high": 2, "price": 9},
        {"candidate_id": "c", "method_family": "FB-04", "semantic_role": "target", "price": 1},
        {"candidate_id": "d", "method_family": "FB-03", "semantic_role": "support", "price": 1},
        {"candidate_id": "e", "method_family": "OLD", "semantic_role": "target", "price": 1},
        {"candidate_id": "f", "method_family": "FB-03", "semantic_role": "target", "price_low": None, "price": 3},
    ]
    ranges = [{"cluster_id": "k", "price_low": 1, "price_high": 2.5, "evidence_strength": "low"}, {"cluster_id": "m", "price_low": 1, "price_high": 1}]
    docs = [
        (1, json.dumps({"output": {"target_confluence": {"supporting_methods": methods, "overlap_ranges": ranges}}})),
        (2, json.dumps({"output": {}})),
        (3, "{broken"),
        (4, None),
        (5, "[1]"),
        (6, json.dumps({"output": {"target_confluence": {"supporting_methods": {"not": "a list"}}}})),
    ]
    df = spark.createDataFrame(docs, "snapshot_id int, document string")
    got = [(r.snapshot_id, r.subject_type, r.subject_id, None if r.price_low is None else float(r.price_low), float(r.price_high), r.evidence_strength) for r in dc.scenario_subjects(df).orderBy("subject_id").collect()]
    assert got == [
        (1, "target_candidate", "a", 10.0, 10.0, None), (1, "support_candidate", "b", 1.25, 2.0, None), (1, "target_candidate", "f", None, 3.0, None),
        (1, "target_cluster", "k", 1.0, 2.5, "low"), (1, "target_cluster", "m", 1.0, 1.0, None)]
    bad = {r.snapshot_id: r.reason for r in dc.unreadable_documents(df).collect()}
    assert bad == {3: "document_unreadable", 4: "document_missing", 5: "document_is_no_object"}


def test_all_registered_paths_are_compared(spark):
    a = {"liquidity": {"turnover_twd": {"total": 5}, "alert_level": None}, "screening": {"components": [{"b": 1, "a": 2}], "status": "x"}, "data_quality": {"status": "ok"}}
    b = {"liquidity": {"turnover_twd": {"total": 7.5}}, "screening": {"components": [{"a": 2, "b": 1}], "status": "y"}, "valuation": {"status": None}}
    left, right = (spark.createDataFrame([(1, json.dumps({"output": x}))], "pair_id int, document string") for x in (a, b))
    got = {r.field_path: (r.change_type, r.identity, r.before, r.after, r.absolute_delta) for r in dc.document_diff(left, right).collect()}
    assert got == {
        "liquidity.turnover_twd.total": ("liquidity_context_changed", "market_liquidity", "5", "7.5", "2.5"),
        "liquidity.alert_level": ("liquidity_context_changed", "market_liquidity", None, None, None),
        "screening.status": ("section_status_changed", "screening", "x", "y", None),
        "valuation.status": ("section_status_changed", "valuation", None, None, None),
        "data_quality.status": ("data_quality_status_changed", "data_quality", "ok", None, None),
    }
    assert len(dc.registered_paths()) == len(K.LIQUIDITY_PATHS) + len(K.SCREENING_PATHS) + len(K.DOCUMENT_SECTIONS) + 1 == 21


def test_sections_are_folded_by_one_grouping(spark):
    keys = spark.createDataFrame([("A", 1), ("A", 2), ('B"', 1)], "symbol string, cutoff int")
    sections = {f"s{i}": spark.createDataFrame([("A", 1, i, None), ("Z", 1, 9, "x")], "symbol string, cutoff int, v int, t string") for i in range(8)}
    out = sn.section_document(keys, sections, ("symbol", "cutoff"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Exchange hashpartitioning") == 2  # the fold, and the keys asked for
    got = [json.loads(r.document) for r in out.orderBy("symbol", "cutoff").collect()]
    assert [(g["symbol"], g["cutoff"]) for g in got] == [("A", 1), ("A", 2), ('B"', 1)]
    assert got[0]["s3"] == {"t": None, "v": 3} and got[1]["s3"] is None
    assert rows(sn.section_document(keys, {}, ("symbol", "cutoff")).select("document"), "document")[0] == ('{"symbol":"A","cutoff":1}',)
