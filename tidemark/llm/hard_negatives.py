"""Hard negatives by Fagin's threshold algorithm over blocks of candidates.

Scores are integer inner products.  A search asks for the best ``k`` candidates
of an anchor in windows of scores.  Candidates lie in blocks; each block has one
list per dimension, sorted by the component.  A list is read from its upper end
where the anchor's component is positive, from its lower end where it is
negative, and not at all where it is zero.  All lists are read to the same depth;
what is met for the first time is scored by random access.  The products of the
anchor with the components at that depth add up to the threshold, the most that
a candidate not yet met can score.  A search of a block ends once the threshold
is strictly below the ``k``-th score of every window, or below the lower end of
a window that holds fewer, or when all candidates were met.

First the positives are searched, in blocks of the anchor's label; they set the
windows of the negatives, searched in blocks of all rows.  A pair of a block and
a group of anchors is one unit of work, so no task holds a label or all anchors,
and what leaves a unit is at most ``k`` rows per window.  The best rows of all
units are taken by rank per window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import shared_if_small, stored

BLOCK = 16_384
ANCHORS = 512
STEPS = 16  # the first depth is this share of a block; it doubles from there
LARGEST = float(2**62)  # of a squared length, so that scores are longs
EXACT = 2**53


class SortedLists:
    """The candidates of a block, sorted by each dimension."""

    def __init__(self, x: np.ndarray):
        self.x, self.real = x, x.astype(np.float64)
        self.order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(self.real, self.order, axis=0)
        self.peak = int(np.abs(x).max()) if x.size else 0

    def search(self, anchor: np.ndarray, eligible: np.ndarray, ids: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window (low, high): places and scores of the best ``k`` eligible candidates, ties by smaller identifier."""
        size = len(self.x)
        exact = self.x.shape[1] * self.peak * int(np.abs(anchor).max(initial=0)) < EXACT
        x, a = (self.real, anchor.astype(np.float64)) if exact else (self.x, anchor)
        up, down = np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
        met = np.zeros(size, bool)
        scores = np.zeros(size, x.dtype)
        depth, reached = 0, max(1, size // STEPS)
        while depth < size:
            depth, before = min(size, reached), depth
            reached = 2 * depth
            if not (len(up) or len(down)):  # every score is zero
                depth = size
            if depth == size:
                new = ~met
            else:
                new = np.zeros(size, bool)
                new[self.order[before:depth, up].ravel()] = True
                new[self.order[size - depth : size - before, down].ravel()] = True
                new &= ~met
            self._score(x, a, new, scores)
            met |= new
            if met.all():
                break
            at = self.values[depth - 1, up] * anchor[up], self.values[size - depth, down] * anchor[down]
            threshold = float(at[0].sum() + at[1].sum())
            if not exact:  # never below the true sum
                threshold += 1e-9 * float(np.abs(at[0]).sum() + np.abs(at[1]).sum())
            if all(threshold < self._kth(scores, met & eligible, w, k) for w in windows):
                break
        return [self._best(scores, met & eligible, ids, w, k) for w in windows]

    @staticmethod
    def _score(x: np.ndarray, a: np.ndarray, new: np.ndarray, scores: np.ndarray) -> None:
        some = np.flatnonzero(new)
        if 4 * len(some) > len(new):
            scores[some] = (x @ a)[some]
        else:
            scores[some] = x[some] @ a

    @staticmethod
    def _inside(scores: np.ndarray, known: np.ndarray, window: tuple[int, int]) -> np.ndarray:
        return np.flatnonzero(known & (scores >= window[0]) & (scores <= window[1]))

    def _kth(self, scores: np.ndarray, known: np.ndarray, window: tuple[int, int], k: int) -> float:
        if window[0] > window[1]:
            return float("inf")
        found = scores[self._inside(scores, known, window)]
        return float(np.partition(found, len(found) - k)[len(found) - k]) if len(found) >= k else float(window[0])

    def _best(self, scores: np.ndarray, known: np.ndarray, ids: np.ndarray, window: tuple[int, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        at = self._inside(scores, known, window)
        if len(at) > k:
            at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
        at = at[np.lexsort((ids[at], -scores[at]))][:k]
        return at, scores[at].astype(np.int64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _search_unit(k: int, same_label: bool, low: tuple[int, int], high: tuple[int, int]):
    """Search one block for one group of anchors."""
    schema = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def run(block: pa.Table, anchors: pa.Table) -> pa.Table:
        if not block.num_rows or not anchors.num_rows:
            return schema.empty_table()
        lists = SortedLists(_matrix(block.column("x")))
        ids, labels = block.column("id").to_numpy(), block.column("label").to_numpy()
        vectors = _matrix(anchors.column("x"))
        found: list[tuple] = []
        for row, vector in zip(anchors.drop_columns(["x"]).to_pylist(), vectors, strict=True):
            if same_label:
                eligible, windows = ids != row["id"], [(-(2**63), 2**63 - 1)]
            else:
                eligible = labels != row["label"]
                windows = [(-(-low[0] * s // low[1]), high[0] * s // high[1]) for s in row["scores"]]
            for w, (at, scores) in enumerate(lists.search(vector, eligible, ids, windows, k)):
                found += [(row["anchor"], w, int(i), int(s)) for i, s in zip(ids[at], scores, strict=True)]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _units(rows: DataFrame, anchors: DataFrame, same_label: bool) -> tuple[DataFrame, DataFrame]:
    """Candidates and anchors, each with the units (part, length, block, team) it belongs to."""
    part = F.col("label") if same_label else F.lit(0).cast("bigint")
    rows, anchors = (t.withColumns({"part": part, "length": F.size("x")}) for t in (rows, anchors))
    have = rows.groupBy("part", "length").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    ask = anchors.groupBy("part", "length").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("teams"))
    sizes = shared_if_small(stored(have.join(ask, ["part", "length"]), "negative-sizes"))
    place = F.xxhash64("id", "x")
    rows = rows.join(sizes, ["part", "length"]).withColumn("block", F.pmod(place, F.col("blocks")).cast("int"))
    rows = rows.withColumn("team", F.explode(F.sequence(F.lit(0), F.col("teams") - 1))).drop("blocks", "teams")
    anchors = anchors.join(sizes, ["part", "length"]).withColumn("team", F.pmod("anchor", F.col("teams")).cast("int"))
    anchors = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "teams")
    return rows, anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns of its own beside those of the rows


def _searched(rows: DataFrame, anchors: DataFrame, same_label: bool, k: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """(anchor, window, id, score, place): the best ``k`` of each window over all blocks."""
    block, asked = _units(rows, anchors, same_label)
    unit = ["part", "length", "block", "team"]
    found = block.groupBy(*unit).cogroup(asked.groupBy(*unit)).applyInArrow(_search_unit(k, same_label, low, high), "anchor long, window int, id long, score long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(
    vectors: DataFrame,
    asked: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: tuple[int, int] = (50, 100),
    high: tuple[int, int] = (95, 100),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows for which ``asked`` holds are anchors.  A component x counts as
    floor(scale * x).  The positives of an anchor are its best ``positives``
    other rows of one label; per positive the best ``negatives`` rows of other
    labels are given whose score is at least low[0]/low[1] and at most
    high[0]/high[1] of the positive's, ranked from 1.  Higher scores come
    first, ties by smaller identifier.

    Rows without identifier, label or vector, with null or non-finite
    components, without components, or of a squared length above 2**62 after
    scaling (scores would leave the range of longs) take no part.  Vectors of
    different lengths are not compared.  Repeats of a whole row count once; a
    row with the anchor's identifier is not another row.  Rows of one
    identifier that differ are candidates, and anchors, each for itself.  Other
    columns are not read; an empty table gives no rows.
    """
    own = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**40))
    length = F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite)
    own = own.select("id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("bigint")).alias("x"), "asked").where(length <= LARGEST)
    own = stored(own.groupBy("id", "label", "x").agg(F.max("asked").alias("asked")), "negative-rows")
    rows = own.select("id", "label", "x")
    anchors = own.where("asked").select("id", "label", "x").withColumn("anchor", F.xxhash64("id", "label", "x"))

    best = stored(_searched(rows, anchors, True, positives, low, high), "negative-positives")
    scores = F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda s: s.score)
    searching = anchors.join(best.groupBy("anchor").agg(scores.alias("scores")), "anchor")
    found = _searched(rows, searching, False, negatives, low, high)
    positive = best.select("anchor", (F.col("place") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = found.join(positive, ["anchor", "window"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
