"""Bounded samples of labelled documents, and the split into learning and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels must not be learnt from; a null identifier counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % FOLDS == HELD_OUT


def learning_sample(docs: DataFrame, labels: DataFrame, label_col: str, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled documents that may be learnt from.

    The sample is the first ``limit`` labelled identifiers in hash order, so
    reruns agree.  Rows without identifier or with a label other than 0 and 1
    are left out, the larger one of several labels counts, and of repeated
    documents one text is used.
    """
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    picked = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id")
    return texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
