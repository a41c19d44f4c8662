"""Whitening of embeddings with eigenvectors found by FEAST contour integration.

Entries become whole numbers, so the sums of the fit list and of the products of
its centred entries are exact; both are added up in the tasks, one small table
per task.  What reaches the driver is a matrix of the width of a vector, whatever
the number of rows.

The covariance is reduced to a tridiagonal matrix once.  The number of negative
pivots of its shifted factorisation (Sylvester's law of inertia) says how many
eigenvalues lie above any point; bisection with these counts finds borders, in
gaps of the spectrum, of slices with a few eigenvalues each.  Every slice is a
row of a Spark table, and FEAST runs on each of them in a task: the resolvent of
the covariance, integrated along a circle around the slice by Gauss-Legendre
quadrature, projects random vectors onto the slice's eigenvectors; each node of
the quadrature is a solve of the covariance shifted by a complex number.
Rayleigh-Ritz in that subspace gives eigenvalues and vectors, which are projected
again until the residuals are at rounding.  A slice that finds another number of
eigenvalues than inertia counted is an error, never a silent loss.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = 8  # of the quadrature on the upper half of the circle
SLICE = 4  # eigenvalues of a slice, unless no gap parts them
MAX_ROUNDS = 40
LARGEST = 2.0**30  # entries at or beyond it are outside the exact range
FLAT = 1e-13  # eigenvalues below this share of the largest count as zero
GAP = 1e-9  # width of a gap between slices, as a share of the largest eigenvalue


# -- counting eigenvalues -----------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a similar tridiagonal matrix, by Householder reflections."""
    a = matrix.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if not size or not np.any(x[1:]):
            continue
        x[0] += math.copysign(size, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :, :] -= 2.0 * np.outer(x, x @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2.0 * np.outer(a[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(tri: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Number of eigenvalues larger than ``shift``: the positive pivots of the shifted factorisation."""
    diagonal, beside = tri
    count, pivot = 0, 1.0
    tiny = np.finfo(float).tiny * 1e4 + np.finfo(float).eps ** 2 * float(np.abs(diagonal).max(initial=0.0))
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shift - (beside[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot > 0
    return int(count)


def bracket(tri: tuple[np.ndarray, np.ndarray], k: int, low: float, high: float) -> tuple[float, float]:
    """A narrow interval around the ``k``-th largest eigenvalue."""
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        low, high = (middle, high) if above(tri, middle) >= k else (low, middle)
    return low, high


def slices(tri: tuple[np.ndarray, np.ndarray], wanted: int, top: float, width: int = SLICE) -> list[tuple[float, float, int]]:
    """(low, high, count) of intervals that hold the ``wanted`` largest eigenvalues, borders in gaps.

    A slice has ``width`` eigenvalues, and as many more as are not parted from them by a gap.
    """
    size = len(tri[0])
    bottom = -top
    found, done = [], 0
    at = {}

    def value(k: int) -> float:
        if k not in at:
            at[k] = sum(bracket(tri, k, bottom, 1.5 * top)) / 2
        return at[k]

    high = value(1)
    while done < wanted:
        last = min(done + width, size, max(wanted, done + 1))
        while last < size and value(last) - value(last + 1) <= GAP * top:
            last += 1
        low = (value(last) + value(last + 1)) / 2 if last < size else min(0.0, value(last)) - GAP * top
        if not done:
            high += max((high - low) / 4, GAP * top)  # a tight circle, with room above the largest
        found.append((low, high, last - done))
        done, high = last, low
    return found


# -- FEAST ---------------------------------------------------------------------


def feast(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues of a symmetric matrix between ``low`` and ``high``, falling, and their vectors as columns."""
    size = len(matrix)
    width = min(size, max(count + 4, 2 * count))
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(-0.5j * np.pi * (points - 1.0))
    scale = float(np.abs(matrix).max()) * size
    base = np.random.default_rng(seed).standard_normal((size, width))
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for _ in range(MAX_ROUNDS):
        projected = np.zeros_like(base)
        for turn, weight in zip(turns, weights, strict=True):
            solved = np.linalg.solve((centre + radius * turn) * np.eye(size) - matrix, base)
            projected += 0.5 * weight * (radius * turn * solved).real
        # An orthonormal base of the subspace, then Rayleigh-Ritz in it.
        left, sizes, _ = np.linalg.svd(projected, full_matrices=False)
        space = left[:, sizes > sizes[0] * 1e-14]
        values, turned = np.linalg.eigh(space.T @ matrix @ space)
        vectors = space @ turned
        inside = np.flatnonzero((values > low) & (values <= high))[::-1]
        if len(inside) == count:
            own, e = vectors[:, inside], values[inside]
            off = float(np.linalg.norm(matrix @ own - own * e, axis=0).max()) / scale
            if best is not None and off >= best[0]:
                break  # no better than the round before: at rounding
            best = off, e, own
        base = vectors if vectors.shape[1] == width else np.hstack([vectors, np.random.default_rng(seed + 1).standard_normal((size, width - vectors.shape[1]))])
    if best is None or best[0] > 1e-10:
        raise ArithmeticError(f"inertia counts {count} eigenvalues in a slice; FEAST did not find as many")
    return best[1], best[2]


def _feast_slices(matrix: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values, vectors = feast(matrix, row["low"], row["high"], row["count"])
                yield pa.record_batch([pa.array(values), pa.array(list(vectors.T), pa.list_(pa.float64()))], names=["value", "vector"])

    return run


def leading(df: DataFrame, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a covariance, those of them that are not zero, and their vectors as rows."""
    tri = tridiagonal(matrix)
    top = float(np.trace(matrix))
    if not top > 0:
        return np.zeros(0), np.zeros((0, len(matrix)))
    wanted = min(wanted, above(tri, FLAT * top))
    spark = df.sparkSession
    found = slices(tri, wanted, top)
    rows = spark.createDataFrame(found, "low double, high double, count int").repartition(len(found))
    parts = sorted(rows.mapInArrow(_feast_slices(matrix), "value double, vector array<double>").collect(), key=lambda r: -r.value)[:wanted]
    return np.array([r.value for r in parts]), np.array([r.vector for r in parts]).reshape(len(parts), len(matrix))


# -- sums over the rows ----------------------------------------------------------


def _whole(batch: pa.RecordBatch, scale: int, offset: int) -> np.ndarray:
    lists = batch.column("v")
    v = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    return np.floor(scale * v).astype(np.int64) + offset


def _exact_product(y: np.ndarray) -> np.ndarray:
    """y'y without rounding: as doubles, longs or Python's whole numbers, whatever holds it."""
    bound = int(np.abs(y).max(initial=0)) ** 2 * max(1, len(y))
    if bound < 2**53:
        z = y.astype(float)
        return (z.T @ z).astype(np.int64)
    y = y if bound < 2**63 else y.astype(object)
    return y.T @ y


def _sums(width: int, scale: int, offset: int, centre: list[int] | None):
    """Per task: the sums of the entries, or with ``centre`` those of the products of centred entries, as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = _whole(batch, scale, offset)
            n += len(x)
            if centre is None:
                part = x.sum(axis=0).astype(object)
            else:
                part = _exact_product(x - np.array(centre)).astype(object).ravel()
            total = part if total is None else total + part
        if n:
            cells = range(len(total))
            yield pa.record_batch([pa.array([k for k in cells], pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([str(t) for t in total])], names=["cell", "n", "total"])

    return run


def _added(rows: DataFrame, task, cells: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sums of all tasks, a value per cell."""
    parts = rows.mapInArrow(task, "cell int, n long, total string")
    added = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = [0] * cells
    for row in added:
        total[row.cell] = int(row.total)
    return (added[0].n if added else 0), total


def covariance(n: int, mean: list[Fraction], centre: list[int], products: list[int]) -> np.ndarray:
    """The covariance from exact sums of products around whole numbers near the mean."""
    d = len(mean)
    off = [m - c for m, c in zip(mean, centre, strict=True)]
    return np.array([[float(Fraction(products[i * d + j], n) - off[i] * off[j]) for j in range(d)] for i in range(d)])


# -- the operator ------------------------------------------------------------------


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """``id_col``, component, n, deviation, whitened, explained, identity_error: a row per vector and component.

    An entry c counts as floor(scale * c) + offset.  Components are the unit
    eigenvectors of the covariance of all rows, numbered by falling eigenvalue;
    the entry of largest size of each is positive.  whitened is the centred
    vector projected on the component over the root of its eigenvalue,
    explained the eigenvalue's share of the trace, identity_error the largest
    entry of the covariance of whitened minus the identity, taken from the rows
    themselves.  deviation is the sum over dimensions of (n * x - sum)^2, null
    where it passes the range of longs.

    Vectors that are null, empty, hold null or non-finite entries or entries of
    2**30 and more in size are dropped, and of vectors of several lengths all
    but those of the most frequent length (of equals the longer).  There are
    fewer components where the covariance has fewer eigenvalues above zero: a
    table of one row, or of equal rows, gives none and no rows.  Rows without
    identifier and repeated rows are rows like any other.  Equal eigenvalues
    have no vectors of their own; any base of their space is given.  Other
    columns are not read.
    """
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    own = own.where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)))
    usual = own.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    d = usual.width if usual else 1
    own = own.where(F.size("v") == d)
    n, sums = _added(own.select("v"), _sums(d, scale, offset, None), d)
    mean = [Fraction(s, max(n, 1)) for s in sums]
    centre = [round(m) for m in mean]
    matrix = np.zeros((d, d))
    if n:
        _, products = _added(own.select("v"), _sums(d, scale, offset, centre), d * d)
        matrix = covariance(n, mean, centre, products)
    values, axes = leading(vectors, matrix, min(components, d))
    axes = np.array([a * np.sign(a[np.abs(a).argmax()]) for a in axes]).reshape(axes.shape)
    pull = (axes / np.sqrt(values)[:, None]).T  # from centred entries to whitened ones
    off = np.array([float(m - c) for m, c in zip(mean, centre, strict=True)])
    centre_row, shares = np.array(centre, np.int64), values / max(float(np.trace(matrix)), 1e-300)

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - centre_row) - off) @ pull

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(values) + 1, len(values)))
        for batch in batches:
            w = projected(_whole(batch, scale, offset))
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        yield pa.record_batch([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "total"])

    def far(x: np.ndarray) -> list[int | None]:
        shift = [n * c - s for c, s in zip(centre, sums, strict=True)]  # n * x - sum = n * (x - centre) + shift
        y = x - centre_row
        if d * (n * int(np.abs(y).max(initial=0)) + max(map(abs, shift), default=0)) ** 2 < 2**63:
            y = n * y + np.array(shift, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = n * y.astype(object) + np.array(shift, object)
        return [t if t < 2**63 else None for t in (y * y).sum(axis=1).tolist()]

    kind = own.schema["id"].dataType.simpleString()
    if not len(values):
        return own.where("false").select(F.col("id").alias(id_col), *[F.lit(0).cast(t).alias(c) for c, t in OUT])
    parts = own.select("v").mapInArrow(spread, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    moments = np.array([r.total for r in sorted(parts, key=lambda r: r.cell)]).reshape(len(values) + 1, len(values)) / n
    error = float(np.abs(moments[1:] - np.outer(moments[0], moments[0]) - np.eye(len(values))).max())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            x = _whole(batch, scale, offset)
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(x)), k)))
            deviation = pa.array(far(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
            component = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)))
            whitened = pa.array(projected(x).ravel())
            yield pa.record_batch([ids, component, deviation, whitened, pa.array(np.tile(shares, len(x)))], names=["id", "component", "deviation", "whitened", "explained"])

    found = own.mapInArrow(rows, f"id {kind}, component int, deviation long, whitened double, explained double")
    return found.select(F.col("id").alias(id_col), "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))


OUT = (("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))
