"""Queries of this package, by name, with their check SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, quality, toxicity
from tidemark.llm.embedding_dedup import embedding_near_dups
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.hard_negatives import hard_negatives
from tidemark.llm.html_extract import extract_main_text
from tidemark.llm.language_id import identify_languages
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_join import ngram_components
from tidemark.llm.secret_scan import kind_count, scan_secrets, scan_sql, spans_text
from tidemark.llm.tables import table
from tidemark.llm.whitening import whiten


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, toxicity.train(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return quality.score_quality(docs, quality.train(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    shared = bpe.share_vocabulary(spark, vocabulary or default_vocabulary())
    both = table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip(F.col("text"), shared).alias("r")).select("doc_id", "r.ids", "r.decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(bpe.ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dups(table(spark, sf_dir, "embeddings"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s.kind.isin("assign", "access", "hex"))
    counts = [kind_count(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(spans).alias("spans"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_bpe": op3_bpe,
    "op4_source_mix": op4_source_mix,
    "op5_quality": op5_quality,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language_id": op7_language_id,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_html_extract": op9_html_extract,
    "op10_ngram_join": op10_ngram_join,
    "op11_secret_scan": op11_secret_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES = {
    "op11_secret_scan": scan_sql(),
    "op12_hard_negatives": r"""
with whole as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         [floor(256 * cast(x as double)) for x in embedding] as v
  from embeddings where vec_id is not null and label is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from whole a join whole b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id) as integer) as rank,
       n.vec_id as negative_id, p.positive_score, n.score as negative_score
from positives p join scored n on p.anchor_id = n.anchor_id and not n.same
  and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id) <= 3
""",
    "op2_line_dedup": r"""
with lines as (
  select doc_id, coalesce(text, '') as body, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
owners as (select k, min(doc_id) as owner from keyed where length(k) >= 10 group by k),
flagged as (
  select doc_id, pos, line, coalesce(length(keyed.k) >= 10 and doc_id > owner, false) as gone
  from keyed left join owners on keyed.k = owners.k)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from flagged group by doc_id
""",
    "op4_source_mix": r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         coalesce(cast(doc_id as varchar), 'null') as k from documents),
hashed as (select *, cast('0x' || substr(md5('mix-1|' || k), 1, 8) as bigint) as h from sized),
sizes as (select source, cast(sum(size) as bigint) as source_size from hashed group by source),
ranked as (
  select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as w, 2 * source_size as cap from sizes),
leveled as (
  select *, cap * (10 // w) as full_at, sum(source_size) over () * 15 as budget10 from ranked),
poured as (
  select *, sum(cap) over (order by full_at) as filled, sum(w) over () - sum(w) over (order by full_at) as open_w from leveled),
marked as (select *, filled * 100 + full_at * open_w * 10 <= budget10 * 10 as clamped from poured),
targets as (
  select source, source_size,
         case when clamped then cast(cap as double)
              else cast((budget10 - 10 * sum(case when clamped then cap else 0 end) over ()) * w as double)
                   / cast(10 * sum(case when clamped then 0 else w end) over () as double) end as target
  from marked),
goals as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from targets),
groups as (select source, h, k, size, sum(size) as words from hashed group by source, h, k, size),
placed as (
  select *, sum(words) over (partition by source order by h, k, size rows unbounded preceding) - words / 2.0 as middle from groups),
extra as (
  select p.source, p.k, p.size, p.middle <= g.target - g.whole * g.source_size as more
  from placed p join goals g on p.source is not distinct from g.source)
select s.doc_id, s.size, g.source_size, g.target,
       cast(s.size * (g.whole + case when e.more then 1 else 0 end) as bigint) as taken
from sized s join goals g on s.source is not distinct from g.source
join extra e on s.source is not distinct from e.source and s.k = e.k and s.size = e.size
""",
    "op6_exact_dedup": r"""
with folded as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id is not distinct from min(doc_id) over (partition by text_sha256) as kept, text_sha256
from folded
""",
}
