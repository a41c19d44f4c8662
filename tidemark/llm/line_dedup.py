"""Line deduplication over range-partitioned line hashes.

Lines become (hash, document, row, position) without their text.  The rows
are range-partitioned on all of these, sorted inside the partition and
streamed: the first document of a run of equal hashes owns the line, rows of
later documents are dropped.  Partition bounds may cut a run, so a hash in a
third of all documents is spread over many tasks; each partition also reports
the owner of its last run, and the few rows at the start of a partition are
settled against those reports (one row per partition).

What leaves the shuffle are positions of dropped lines only.  They are packed
into one compressed keep bitmap per document, and the bitmap meets the text
once, to write the document without its dropped lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.tables import ascii_lower, settle, trimmed, whole_text

MIN_KEY = 10
LAST_ID = 2**63 - 1  # orders rows without an identifier behind all others

MARKS = "kind int, h1 bigint, h2 bigint, doc bigint, fp bigint, pos int"
DROP, MAYBE, OWNER = 0, 1, 2
KEPT = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_key: int) -> DataFrame:
    """(h1, h2, doc, fp, pos) of every line whose key is long enough to count."""
    text = whole_text(F.col(text_col))
    lines = docs.select(F.coalesce(F.col(id_col), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("fp"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    key = ascii_lower(trimmed(F.col("line")))
    keyed = lines.select("doc", "fp", "pos", key.alias("key")).where(F.length("key") >= min_key)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"), "doc", "fp", "pos")


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream one sorted partition; see MARKS for what comes out."""
    schema = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("fp", pa.int64()), ("pos", pa.int32())])
    last: tuple[int, int] | None = None
    owner, head = 0, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2, doc, fp, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        new = np.empty(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = last is not None and (int(h1[0]), int(h2[0])) != last
        run = np.cumsum(new)
        starts = np.flatnonzero(new)
        owners = np.concatenate(([doc[0] if last is None else owner], doc[starts]))
        dropped = doc > owners[run]
        in_head = run == 0 if head else np.zeros(n, bool)
        kind = np.where(dropped, DROP, np.where(in_head, MAYBE, -1)).astype(np.int32)
        out = kind >= 0
        if out.any():
            yield pa.record_batch([pa.array(x[out]) for x in (kind, h1, h2, doc, fp, pos.astype(np.int32))], schema=schema)
        last, owner, head = (int(h1[-1]), int(h2[-1])), int(owners[run[-1]]), head and not len(starts)
    if last is not None:
        yield pa.record_batch([pa.array([v], t) for v, t in zip((OWNER, *last, owner, 0, 0), schema.types, strict=True)], schema=schema)


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_key: int) -> DataFrame:
    """(doc, fp, pos) of every line to drop, possibly repeated."""
    order = ["h1", "h2", "doc", "fp", "pos"]
    lines = line_hashes(docs, id_col, text_col, min_key).repartitionByRange(*order).sortWithinPartitions(*order)
    marks = settle(lines.mapInArrow(_mark_runs, MARKS))
    owners = marks.where(F.col("kind") == OWNER).groupBy("h1", "h2").agg(F.min("doc").alias("owner"))
    late = marks.where(F.col("kind") == MAYBE).join(owners, ["h1", "h2"]).where("doc > owner")
    return marks.where(F.col("kind") == DROP).select("doc", "fp", "pos").unionByName(late.select("doc", "fp", "pos"))


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, fp, n_dropped, bitmap): bit i is 0 if line i goes; deflated, lines behind the last bit stay."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, counts = [], []
            for at in batch.column("at"):
                pos = np.array(at.as_py(), np.int64)
                bits = np.ones(pos.max() + 1, np.uint8)
                bits[pos] = 0
                padded = np.pad(bits, (0, -len(bits) % 8), constant_values=1)
                maps.append(zlib.compress(np.packbits(padded).tobytes()))
                counts.append(len(pos))
            yield pa.record_batch([batch.column("doc"), batch.column("fp"), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], names=["doc", "fp", "n_dropped", "bitmap"])

    # A set per document: as long as its number of lines at most, however often the row is repeated.
    grouped = dropped.groupBy("doc", "fp").agg(F.collect_set("pos").alias("at"))
    return grouped.mapInArrow(pack, "doc bigint, fp bigint, n_dropped bigint, bitmap binary")


def kept_text(text: str, bitmap: bytes | None) -> tuple[str, int, int]:
    """(text without its dropped lines, lines before, lines dropped)."""
    lines = text.split("\n")
    if bitmap is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    keep = np.ones(len(lines), bool)
    keep[: len(bits)] = bits[: len(lines)].astype(bool)
    kept = list(compress(lines, keep.tolist()))
    return "\n".join(kept), len(lines), len(lines) - len(kept)


@F.pandas_udf(KEPT)
def apply_bitmap(text: pd.Series, bitmap: pd.Series) -> pd.DataFrame:
    rows = [kept_text(t, b) for t, b in zip(text, bitmap, strict=True)]
    return pd.DataFrame({"n_lines": [r[1] for r in rows], "n_dropped": [r[2] for r in rows], "kept": [r[0] for r in rows]})


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """The rows of ``docs`` plus _n_lines, _n_dropped and _kept (the text that stays).

    A line's key is the line trimmed of white space, with A-Z lower-cased.
    Keys of at least ``min_key`` code points found in two or more documents
    stay in the smallest identifier only.  Null or empty text is one empty
    line.  Rows with one identifier are one document.  A null identifier comes
    behind all others, and rows without one count as one document.  If all
    lines go, the kept text is empty.  Other columns pass through untouched,
    whatever their names, unless they have one of the three new names.
    """
    text = whole_text(F.col(text_col))
    packed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("fp"))
    bitmaps = keep_bitmaps(dropped_lines(docs, id_col, text_col, min_key))
    met = packed.join(bitmaps.drop("n_dropped"), ["doc", "fp"], "left")
    kept = apply_bitmap(whole_text(F.col(f"row.`{text_col}`")), F.col("bitmap"))
    return met.withColumn("out", kept).select("row.*", F.col("out.n_lines").alias("_n_lines"), F.col("out.n_dropped").alias("_n_dropped"), F.col("out.kept").alias("_kept"))
