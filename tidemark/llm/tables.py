"""Reading the given tables, shared column expressions and lineage cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import settle, work_dir

__all__ = ["ascii_lower", "settle", "shared_if_small", "stored", "table", "trimmed", "whole_text", "word_count"]

BROADCAST_ROWS = 500_000  # of a few numbers each: 30 MB at most

# White space as all contracts of this package define it.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step's table below the shared folder and read it again: smaller than a checkpoint."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table of numbers for broadcast if it has at most ``rows`` rows; else Spark shuffles it."""
    return F.broadcast(df) if df.count() <= rows else df


def whole_text(text: Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null counts 0."""
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint")
