"""Exact deduplication by a tree merge of sorted digest runs.

Every document is reduced to the digest of its text with white space folded, the
length of that text and a second hash of it.  Documents are dealt to
``fan_in ** levels`` leaf runs, so the copies of one text lie in many runs
however many there are.  A run is sorted by digest and holds one row per text:
the smallest identifier and the number of documents.

In each round ``fan_in`` neighbouring runs become one.  A run of round k is cut
into ``fan_in ** k`` pieces by the leading bits of the digest, and one task
receives a piece of all the runs that are merged: the number of pieces in all,
and the rows of a piece, stay the same from round to round, and no task holds a
whole run.  A piece is put in order and passes through an aggregate that reads
it in that order; equal digests stand together, are verified by length and
second hash, and keep the smallest identifier.  After the last round one run is
left, in order from piece to piece.

The way down goes through the leaves again: a group of the root meets at most
one row per leaf, and a document meets its own leaf only.  A text that a third
of all documents share is therefore spread over all leaves in every join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import settle, whole_text

FAN_IN_BITS = 3
LEAF_ROWS = 65_536  # documents of a leaf, about
TEXT = ["digest", "size", "check"]  # what equal texts have in common


def folded(text: Column) -> Column:
    """The text with each run of white space as one space.

    Only runs that are not a single space already are matched.
    """
    return F.regexp_replace(whole_text(text), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def levels_for(rows: int, fan_in_bits: int = FAN_IN_BITS) -> int:
    """Rounds until leaves of ``LEAF_ROWS`` rows are one run; two at least."""
    levels = 2
    while LEAF_ROWS * 2 ** (fan_in_bits * levels) < rows:
        levels += 1
    return levels


def digests(docs: DataFrame, id_col: str, text_col: str, leaves: int) -> DataFrame:
    text = docs.select(F.col(id_col).alias("id"), folded(F.col(text_col)).alias("body"))
    marked = text.select("id", F.unhex(F.sha2("body", 256)).alias("digest"), F.octet_length("body").alias("size"), F.xxhash64("body").alias("check"))
    return marked.withColumn("run", F.pmod(F.xxhash64("id", "check"), F.lit(leaves)).cast("int"))


def merged(rows: DataFrame) -> DataFrame:
    """One row per run, piece and text of rows that are dealt by run and piece, sorted as they were.

    The smallest identifier is taken with its null flag in one struct, for
    which Spark aggregates in sort order and does not hash.
    """
    ordered = rows.sortWithinPartitions("run", "piece", *TEXT)
    least = F.min(F.struct(F.isnull("keep_id").alias("unknown"), F.col("keep_id").alias("id")))
    return ordered.groupBy("run", "piece", *TEXT).agg(least.alias("least"), F.sum("n").alias("n")).select("run", "piece", *TEXT, F.col("least.id").alias("keep_id"), "n")


def leaf_runs(rows: DataFrame) -> DataFrame:
    """The sorted run of each leaf."""
    single = rows.select("run", F.lit(0).cast("bigint").alias("piece"), *TEXT, F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("n"))
    return merged(single.repartition("run"))


def merge_round(runs: DataFrame, bits: int, level: int) -> DataFrame:
    """Round ``level`` (from 1): 2**bits runs become one, cut into pieces by the leading bits of the digest."""
    head = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("bigint")
    piece = F.shiftright(head, max(0, 56 - bits * level))
    dealt = runs.withColumn("run", F.shiftright("run", bits)).withColumn("piece", piece)
    return merged(dealt.repartition("run", "piece"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in_bits: int = FAN_IN_BITS, levels: int | None = None) -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after folding white space; null
    counts as empty, and all empty texts form one group.  The smallest
    identifier of a group stays.  A null identifier never wins against another
    one; a group of null identifiers only has keep_id null and keeps its rows.
    Rows that repeat the kept identifier are the same document and are all
    kept.  Other columns are not read.  An empty table gives no rows.

    ``levels`` defaults to what the number of rows asks for.
    """
    levels = levels or levels_for(docs.count(), fan_in_bits)
    rows = settle(digests(docs, id_col, text_col, 2 ** (fan_in_bits * levels)))
    runs = leaves = settle(leaf_runs(rows))
    for level in range(1, levels + 1):
        runs = merge_round(runs, fan_in_bits, level)
    groups = runs.where("n > 1").select(*TEXT, "keep_id", "n")
    down = leaves.select("run", *TEXT).join(groups, TEXT)
    out = rows.join(down, ["run", *TEXT], "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
