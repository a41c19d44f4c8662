"""Every stage of the pipeline on the rows its predecessor kept."""

import corpus_pipeline
from test_dedup import brute_components, brute_lines, rows_of

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs)
        if name != "tokens":
            assert docs.dtypes == before.dtypes
    before, after = seen["quality"]
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in after.collect()}
    assert len(good & {r.doc_id for r in before.collect()} - kept) <= 0.03 * len(good)
    before, after = seen["line_dedup"]
    assert sorted(rows_of(after), key=repr) == sorted(((i, t) for i, *_, t in brute_lines(rows_of(before))), key=repr)
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["near_dedup"]
    assert {i for i, _ in rows_of(after)} == set(brute_components(rows_of(before)).values())
    before, after = seen["source_mix"]
    assert set(rows_of(after)) <= set(rows_of(before))
    before, after = seen["tokens"]
    assert after.count() == before.count() and after.where("size(ids) != n_tokens").count() == 0


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "ids", "n_tokens", "decoded"]


def test_stages_bear_odd_rows(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "source", "row", "run")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.collect()
