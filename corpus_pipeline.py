"""The corpus pipeline: quality, line dedup, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of their input.  Stages work on every row their
predecessor kept and read nothing but the columns doc_id, text, source and
n_chars of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, quality
from tidemark.llm.catalog import default_vocabulary
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.ngram_join import ngram_components
from tidemark.llm.tables import table
from tidemark.session import work_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality field accepts; rejected ones go.

    The field learns from the labels of the rows that are not held out and
    from ``docs`` itself.  Empty texts are judged like any other.
    """
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    return quality.score_quality(packed, field).where("predicted = 1").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller doc_id holds; text and n_chars change, no row goes.

    A document all of whose lines go stays with an empty text.
    """
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    lines = dedup_lines(packed)
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("_kept"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return lines.select(row.alias("row")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id.

    Documents without words are no copies of each other and stay, as do rows
    without an identifier.
    An identifier with several rows is one document with the links of all its
    texts: its rows stay or go together, and repeats of a kept one all stay.
    """
    found = ngram_components(docs.select("doc_id", "text")).where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those it takes 0 times go."""
    return mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and decoded of every row."""
    shared = bpe.share_vocabulary(spark, default_vocabulary())
    done = docs.select("doc_id", bpe.round_trip(F.col("text"), shared).alias("r"))
    return done.select("doc_id", "r.ids", F.size("r.ids").cast("bigint").alias("n_tokens"), "r.decoded")


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("tokens", tokenize),
]

# Trained scores and components cannot be said in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = work_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
