"""Language of web pages by fusing evidence with Bayes' rule.

Evidence of a page:
* its text: hashed byte trigrams under a multinomial model per language, fitted
  on a bounded sample of documents with known language; tempered, because
  neighbouring trigrams are not independent;
* the language its markup declares, and the language code in its address
  (first path segment, host label or top-level domain): P(code | language) is
  estimated over all pages from the text evidence, so a code that says little
  weighs little;
* its host: the languages of the host's other pages, smoothed by those of its
  domain, these by its top-level domain, and these by all pages.

The text is read once.  Everything behind it is grouped sums over one row per
page with one number per language; a host with a third of all pages is summed
on the map side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import settle

SAMPLE = 4000  # documents the text model is fitted on at most
BUCKETS = 1 << 15
SMOOTHING = 0.5
EVIDENCE = 40.0  # a text counts as so many independent trigrams at most
STRENGTH = 5.0  # pages that the level above a host, domain or top-level domain counts for
CODE_PRIOR = 1.0

_MARKUP = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>", re.S | re.I)
_DECLARED = (re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", re.I), re.compile(r"content-language[\"'][^>]*?content\s*=\s*[\"']([a-zA-Z]{2,3})\b", re.I))


def buckets(text: str) -> np.ndarray:
    """Trigram buckets of the letters of a text; other signs count as one space."""
    letters = " ".join("".join(c if c.isalpha() else " " for c in text).split()) if not text.isascii() else re.sub(r"[^A-Za-z]+", " ", text)
    raw = np.frombuffer(f" {letters.strip().lower()} ".encode(errors="replace"), np.uint8).astype(np.uint32)
    code = raw[:-2] * 65_536 + raw[1:-1] * 256 + raw[2:]
    return ((code * np.uint32(2_654_435_761)) >> np.uint32(17)).astype(np.int64)


@dataclass
class TextModel:
    langs: list[str]
    log_p: np.ndarray  # (BUCKETS, languages)

    def log_likelihoods(self, text: str) -> np.ndarray:
        """Tempered log-likelihood per language; zeros without letters."""
        if not any(c.isalpha() for c in text[:1000]) and not any(c.isalpha() for c in text):
            return np.zeros(len(self.langs))
        found = buckets(text)
        counts = np.bincount(found, minlength=BUCKETS)
        used = np.flatnonzero(counts)
        return counts[used] @ self.log_p[used] * min(1.0, EVIDENCE / len(found))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            total[lang] += np.bincount(buckets(text), minlength=BUCKETS)
    for lang, counts in total.items():
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array([lang] * len(used)), pa.array(used), pa.array(counts[used])], names=["lang", "bucket", "n"])


def fit_text_model(docs: DataFrame, limit: int = SAMPLE) -> TextModel:
    """From (doc_id, text, lang).  The sample is the first ``limit`` documents in hash order."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang")
    picked = known.groupBy("doc_id").agg(F.min("lang").alias("lang")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.where("text is not null").select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = texts.select("lang", "text").mapInArrow(_count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.full((BUCKETS, len(langs)), SMOOTHING)
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        counts[own["bucket"].to_numpy(np.int64), i] += own["n"].to_numpy(float)
    return TextModel(langs, np.log(counts / counts.sum(axis=0)))


def page_evidence(pages: DataFrame, model: TextModel, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, address, host, domain, tld, declared, code, text_ll) per page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("declared string, text_ll array<double>")
    def look(sources: pa.Array) -> pa.Array:
        declared, likely = [], []
        for source in sources.to_pylist():
            found = next((m for m in (p.search(source) for p in _DECLARED) if m), None)
            declared.append(found.group(1).lower() if found else None)
            likely.append(shared.value.log_likelihoods(_MARKUP.sub(" ", source)).tolist())
        return pa.StructArray.from_arrays([pa.array(declared, pa.string()), pa.array(likely, pa.list_(pa.float64()))], names=["declared", "text_ll"])

    address = F.col(url_col)
    host = F.lower(F.nullif(F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    known = F.array(*[F.lit(x) for x in model.langs]) if model.langs else F.array().cast("array<string>")
    segment = F.lower(F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]+/([a-zA-Z]{2,3})(?:[-_][a-zA-Z]+)?(?:[/?#]|$)", 1))
    rows = pages.select(F.col(id_col).alias("id"), address.alias("address"), host.alias("host"), segment.alias("segment"), look(F.coalesce(html_col, F.lit(""))).alias("e"))
    first, last = F.regexp_extract("host", r"^([^.]+)\.", 1), F.regexp_extract("host", r"\.([^.]+)$", 1)
    codes = F.filter(F.array("segment", first, last), lambda x: F.array_contains(known, x))
    return rows.select(
        "id",
        "address",
        "host",
        F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"),
        last.alias("tld"),
        F.col("e.declared").alias("declared"),
        F.get(codes, F.lit(0)).alias("code"),
        F.col("e.text_ll").alias("text_ll"),
    )


def _softmax(log: Column) -> Column:
    shifted = F.transform(log, lambda x: F.exp(x - F.array_max(log)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def _sums(vector: str, n: int) -> list[Column]:
    return [F.sum(F.get(vector, F.lit(i))).alias(f"s{i}") for i in range(n)]


def _vector(n: int) -> Column:
    return F.array(*[F.col(f"s{i}") for i in range(n)])


def _code_likelihood(rows: DataFrame, column: str, n: int) -> DataFrame:
    """(column, ll): log P(code | language) for each code, from text posteriors of all pages."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(*_sums("text_p", n))
    *totals, codes = counts.agg(*[F.sum(f"s{i}") for i in range(n)], F.count(F.lit(1))).first()
    parts = [F.log((F.col(f"s{i}") + CODE_PRIOR) / F.lit((t or 0.0) + CODE_PRIOR * max(codes, 1))) for i, t in enumerate(totals)]
    return counts.select(column, F.array(*parts).alias(f"{column}_ll"))


def identify_languages(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", limit: int = SAMPLE) -> DataFrame:
    """One row per page: ``id_col``, ``url_col``, lang, confidence, text_lang, declared, address_code.

    ``docs`` (doc_id, text, lang) teaches the languages.  Null or empty pages
    are judged by declaration, address and host; a page without any evidence
    gets the prior of all pages.  Ties go to the first language in alphabetical
    order.  Repeated rows give repeated rows and count repeatedly for their
    host.  Without labelled documents lang is null and confidence 0.  Other
    columns are not read.
    """
    model = fit_text_model(docs, limit)
    n = len(model.langs)
    rows = page_evidence(pages, model, id_col, url_col, html_col)
    if not n:
        nothing = F.lit(None).cast("string")
        return rows.select(F.col("id").alias(id_col), F.col("address").alias(url_col), nothing.alias("lang"), F.lit(0.0).alias("confidence"), nothing.alias("text_lang"), "declared", F.col("code").alias("address_code"))
    rows = settle(rows.withColumn("text_p", _softmax(F.col("text_ll"))))

    for column in ("declared", "code"):
        rows = rows.join(_code_likelihood(rows, column, n), column, "left")
    zero = F.array(*[F.lit(0.0)] * n)
    total = F.zip_with(F.zip_with("text_ll", F.coalesce("declared_ll", zero), lambda a, b: a + b), F.coalesce("code_ll", zero), lambda a, b: a + b)
    rows = settle(rows.withColumn("evidence", total).withColumn("own", _softmax(F.col("evidence"))))

    # Sums per host, smoothed by domain, top-level domain and all pages; a page does not vote for itself.
    levels = {"host": ["host", "domain", "tld"], "domain": ["domain", "tld"], "tld": ["tld"]}
    sums = rows.groupBy("host", "domain", "tld").agg(*_sums("own", n))
    whole = sums.agg(*[F.sum(f"s{i}") for i in range(n)]).first()
    prior = sums.select("host", "domain", "tld", _vector(n).alias("host_n"))
    for level in ("domain", "tld"):
        part = sums.groupBy(*[F.col(c).alias(f"{level}_{c}") for c in levels[level]]).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)])
        part = part.select(*[f"{level}_{c}" for c in levels[level]], _vector(n).alias(f"{level}_n"))
        same = [F.col(c).eqNullSafe(F.col(f"{level}_{c}")) for c in levels[level]]
        prior = prior.join(part, same, "left").drop(*[f"{level}_{c}" for c in levels[level]])
    everywhere = F.array(*[F.lit(float(x or 0.0)) for x in whole])
    prior = prior.select(F.col("host").alias("p_host"), "host_n", "domain_n", "tld_n", everywhere.alias("all_n"))
    met = rows.join(prior, F.col("host").eqNullSafe(F.col("p_host")), "left")

    def smoothed(level: str, above: Column) -> Column:
        votes = F.zip_with(f"{level}_n", "own", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        size = F.aggregate(votes, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(votes, above, lambda a, b: (a + STRENGTH * b) / (size + STRENGTH))

    p = smoothed("all", F.array(*[F.lit(1.0 / n)] * n))
    for level in ("tld", "domain"):
        met = met.withColumn("p_above", p)
        p = smoothed(level, F.col("p_above"))
    # A page without a host has no host, domain or top-level domain to learn from.
    met = met.withColumn("p_above", p).withColumn("p_host_smooth", smoothed("host", F.col("p_above")))
    general = smoothed("all", F.array(*[F.lit(1.0 / n)] * n))
    met = met.withColumn("p", F.when(F.col("host").isNull(), general).otherwise(F.col("p_host_smooth")))
    met = met.withColumn("posterior", _softmax(F.zip_with("evidence", "p", lambda a, b: a + F.log(b))))
    langs = F.array(*[F.lit(x) for x in model.langs])
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    text_best = F.array_position("text_p", F.array_max("text_p")).cast("int")
    return met.select(
        F.col("id").alias(id_col),
        F.col("address").alias(url_col),
        F.element_at(langs, best).alias("lang"),
        F.array_max("posterior").alias("confidence"),
        F.element_at(langs, text_best).alias("text_lang"),
        "declared",
        F.col("code").alias("address_code"),
    )
