"""Linear algebra from sums of products: principal components, concept erasure and ridge residuals.

One pass over the rows makes a partial sum in each task and adds these up; the driver sees only
``width x width`` numbers for each group (fold), whatever the number of rows.  Vectors that are null, of another
width or not finite, and rows without a fold, are left out of the sums and get a null result; an empty table has sums of 0.  Components have a fixed sign: the entry of
greatest size is positive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import share_package


@dataclass
class Moments:
    """Number of rows, their sum, and the sum of their outer products."""

    n: float
    total: np.ndarray
    products: np.ndarray

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.total - other.total, self.products - other.products)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.total + other.total, self.products + other.products)

    @property
    def mean(self) -> np.ndarray:
        return self.total / max(self.n, 1)

    @property
    def scatter(self) -> np.ndarray:
        return self.products - np.outer(self.total, self.total) / max(self.n, 1)

    @property
    def sd(self) -> np.ndarray:
        """Population deviation, 1 where a column is constant."""
        sd = np.sqrt(np.maximum(np.diag(self.scatter) / max(self.n, 1), 0))
        return np.where(sd > 1e-12 * (1 + np.abs(self.mean)), sd, 1.0)


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows as a matrix, and which of them are whole."""
    good = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    values = column.filter(good).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)  # null entries become NaN
    good = good.to_numpy(zero_copy_only=False).astype(bool)
    out = np.zeros((len(good), width))
    out[good] = values.reshape(-1, width)
    good &= np.isfinite(out).all(1)
    out[~good] = 0
    return out, good


def _flat_frame(partial: DataFrame) -> DataFrame:
    """Partial sums ``(k, s)``, ``s`` the bytes of numbers, added by ``k``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(s.as_py(), float)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["k", "s"])

    return partial.repartition("k").mapInArrow(add, "k long, s binary")


def _flat_sums(partial: DataFrame) -> dict[int, np.ndarray]:
    """The same, collected: one row for each ``k``."""
    return {r.k: np.frombuffer(r.s, float) for r in _flat_frame(partial).collect()}


def _summed(partial: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Partial sums ``(k, s)`` of ``(width + 1)`` squared numbers, added by ``k``."""
    return {k: s.reshape(width + 1, width + 1) for k, s in _flat_sums(partial).items()}


def weighted_moments(df: DataFrame, vector: str, width: int, weights: str, count: int) -> list[Moments]:
    """Moments of a vector column under each of ``count`` weights of a row (an array column): resampling, labels by draw, or fitted rates.

    All weights are taken in one pass, and no row is repeated; ``count`` times ``width`` squared numbers reach the driver.
    Rows whose vector or weights are not whole are left out.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((count, width + 1, width + 1))
        for batch in batches:
            x, good = matrix(batch.column(0), width)
            w, also = matrix(batch.column(1), count)
            good &= also
            z = np.concatenate([np.ones((int(good.sum()), 1)), x[good]], 1)
            for k, v in enumerate(w[good].T):
                sums[k] += (z * v[:, None]).T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(count), pa.int64()), pa.array([s.tobytes() for s in sums], pa.binary())], names=["k", "s"])

    share_package(df.sparkSession)
    rows = df.select(F.col(vector).cast("array<double>").alias("v"), F.col(weights).cast("array<double>").alias("w")).mapInArrow(partial, "k long, s binary")
    found = _summed(rows, width)
    none = np.zeros((width + 1, width + 1))
    return [Moments(float(s[0, 0]), s[0, 1:], s[1:, 1:]) for s in (found.get(k, none) for k in range(count))]


def moments(df: DataFrame, vector: str, width: int, by: str | None = None) -> dict[int | None, Moments]:
    """Moments of a vector column for each value of the integer column ``by`` (few: folds or conditions), or of all rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            x, good = matrix(batch.column(1), width)
            z = np.concatenate([np.ones((len(x), 1)), x], 1)
            keys = np.array(batch.column(0).to_pylist(), np.int64)
            for k in np.unique(keys[good]).tolist():
                part = z[good & (keys == k)]
                sums[k] = sums.get(k, 0) + part.T @ part
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * (width + 1), pa.int64()), pa.array(range(width + 1), pa.int32()), pa.array(s.tolist(), pa.list_(pa.float64()))], names=["k", "i", "s"])

    share_package(df.sparkSession)
    key = F.col(by).cast("long") if by else F.lit(0).cast("long")
    rows = df.select(key.alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("k is not null").mapInArrow(partial, "k long, i int, s array<double>")
    added = rows.select("k", "i", F.posexplode("s").alias("j", "x")).groupBy("k", "i", "j").agg(F.sum("x").alias("x"))
    out: dict = {} if by else {None: np.zeros((width + 1, width + 1))}
    for r in added.collect():  # width squared numbers a group
        out.setdefault(r.k if by else None, np.zeros((width + 1, width + 1)))[r.i, r.j] = r.x
    return {k: Moments(float(s[0, 0]), s[0, 1:], s[1:, 1:]) for k, s in out.items()}


@dataclass
class Affine:
    """``y = (x - centre) @ weights``."""

    centre: np.ndarray
    weights: np.ndarray


def principal(m: Moments, k: int, standardise: bool = False) -> Affine:
    """The first ``k`` components; with ``standardise`` of columns scaled to unit deviation, and scores scaled likewise."""
    scale = m.sd if standardise else np.ones(len(m.total))
    values, vectors = np.linalg.eigh(m.scatter / scale[:, None] / scale[None, :])
    w = vectors[:, ::-1][:, :k]
    w = w * np.sign(w[np.abs(w).argmax(0), range(w.shape[1])])
    if standardise:
        sd = np.sqrt(np.maximum(values[::-1][:k], 0) / max(m.n, 1))
        w = w / np.where(sd > 1e-9, sd, 1.0)
    return Affine(m.mean, w / scale[:, None])


def leading(df: DataFrame, vector: str, width: int, k: int, standardise: bool = False, oversample: int = 10, powers: int = 2, seed: str = "range") -> Affine:
    """The first ``k`` components of vectors too wide for a matrix of their products, by a randomised range finder.

    ``k + oversample`` test vectors come from hashes.  Each of the ``powers`` passes, and one more for the values, adds up ``x (x' q)`` over the rows, ``width`` times
    ``k + oversample`` numbers a task; centre and scale are worked in afterwards.  Signs and scaling are those of :func:`principal`.
    """
    wide = min(k + oversample, width)

    def pass_over(q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, their sum, the sum of squares, and ``X' X q``."""
        held = df.sparkSession.sparkContext.broadcast(q)  # width times (k + oversample) numbers

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, squares, inner = 0.0, np.zeros(width), np.zeros(width), np.zeros(held.value.shape)
            for batch in batches:
                x, good = matrix(batch.column(0), width)
                x = x[good]
                n, total, squares, inner = n + len(x), total + x.sum(0), squares + (x * x).sum(0), inner + x.T @ (x @ held.value)
            flat = np.concatenate([[n], total, squares, inner.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["k", "s"])

        rows = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(partial, "k long, s binary")
        # tasks are added up in some groups first, so that one task never has the sums of all
        salted = rows.withColumn("k", F.spark_partition_id().cast("long") % 64)
        flat = sum((v for v in _flat_sums(_flat_frame(salted).withColumn("k", F.lit(0).cast("long"))).values()), np.zeros(1 + 2 * width + q.size))
        held.unpersist()
        return flat[0], flat[1 : 1 + width], flat[1 + width : 1 + 2 * width], flat[1 + 2 * width :].reshape(q.shape)

    share_package(df.sparkSession)
    q = np.linalg.qr(np.array([[int(hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()[:8], 16) / 2**31 - 1 for j in range(wide)] for i in range(width)]))[0]
    scale = np.ones(width)
    for step in range(powers + 1):
        if standardise and not step:
            n, total, squares, _ = pass_over(q)
            mean = total / max(n, 1)
            sd = np.sqrt(np.maximum(squares / max(n, 1) - mean**2, 0))
            scale = np.where(sd > 1e-7 * (1 + np.abs(mean)), sd, 1.0)
        n, total, _, inner = pass_over(q / scale[:, None])
        mean = total / max(n, 1)
        # products of centred, scaled rows with q
        moved = (inner - n * np.outer(mean, mean @ (q / scale[:, None]))) / scale[:, None]
        if step < powers:
            q = np.linalg.qr(moved)[0]
    values, vectors = np.linalg.eigh((q.T @ moved + moved.T @ q) / 2)
    w = (q @ vectors[:, ::-1])[:, :k]
    w = w * np.sign(w[np.abs(w).argmax(0), range(w.shape[1])])
    if standardise:
        sd = np.sqrt(np.maximum(values[::-1][:k], 0) / max(n, 1))
        w = w / np.where(sd > 1e-9, sd, 1.0)
    return Affine(mean, w / scale[:, None])


def eraser(m: Moments, concepts: int) -> Affine:
    """For vectors whose last ``concepts`` entries are the concept: the least change of the others after which none correlates with it.

    The result is ``x - erased``: subtract ``(x - mean) @ weights`` from the features.
    """
    p = len(m.total) - concepts
    cov = m.scatter / max(m.n, 1)
    values, vectors = np.linalg.eigh(cov[:p, :p])
    live = values > 1e-10 * max(values.max(initial=0), 1e-300)
    root = np.sqrt(np.where(live, values, 1.0))
    whiten = (vectors * np.where(live, 1 / root, 0)) @ vectors.T
    colour = (vectors * np.where(live, root, 0)) @ vectors.T
    u, s, _ = np.linalg.svd(whiten @ cov[:p, p:], full_matrices=False)
    u = u[:, s > 1e-10 * max(s.max(initial=0), 1e-300)]
    project = colour @ u @ u.T @ whiten
    return Affine(m.mean[:p], project.T)


def ridge_map(m: Moments, controls: int, alpha: float) -> Affine:
    """For vectors of ``controls`` columns followed by targets: ridge coefficients of centred targets on centred controls, targets by column."""
    s = m.scatter
    return Affine(m.mean, np.linalg.solve(s[:controls, :controls] + alpha * np.eye(controls), s[:controls, controls:]))


def applied(df: DataFrame, vector: str, width: int, maps: dict, out: str, by: str | None = None, then=None) -> DataFrame:
    """Adds ``out``, ``(x - centre) @ weights`` with the map of the row's ``by``; ``then(x, centre, y)`` may go on from it.  Null without a map or whole vector."""
    columns = df.columns
    held = df.sparkSession.sparkContext.broadcast(maps)  # width squared numbers a group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = matrix(batch.column(batch.num_columns - 1), width)
            keys = batch.column(batch.num_columns - 2)
            good &= keys.is_valid().to_numpy(zero_copy_only=False)
            keys = keys.fill_null(0).to_numpy(zero_copy_only=False)
            rows: list = [None] * len(x)
            for k in np.unique(keys[good]).tolist():
                a = held.value.get(k if by else None)
                at = np.flatnonzero(good & (keys == k))
                if a is None or not len(at):
                    continue
                p = len(a.centre) if len(a.centre) <= len(a.weights) else len(a.weights)
                y = (x[at, :p] - a.centre[:p]) @ a.weights
                y = y if then is None else then(x[at], a.centre, y)
                for i, r in zip(at.tolist(), y.tolist(), strict=True):
                    rows[i] = r
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(rows, pa.list_(pa.float64()))], names=[*columns, out])

    share_package(df.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    key = F.col(by).cast("long") if by else F.lit(0).cast("long")
    return df.select("*", key.alias("_k"), F.col(vector).cast("array<double>").alias("_v")).mapInArrow(run, f"{fields}, `{out}` array<double>")
