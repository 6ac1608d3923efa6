"""How two conditions place the same items: spectra, shared subspaces, rotations and stability, with nulls.

Each item has one mean vector in each condition (:func:`item_means`, an aggregation over all rows); the items of a unit, a shared vocabulary, then are one
small matrix for each condition.  Draws (permutations, half splits, subsets) are dealt to tasks in chunks: ``units x chunks`` groups, in each of which the
matrices come once, so that no draw is a copy of the rows.  All draws follow from digests, not from the order of rows.

Subspaces belong to the centred matrix of cosines between items: its eigenvectors are the left singular vectors of the item vectors, scaled to one length and
centred, so that a matrix of items by items is never made.

Defined results: items without a vector in both conditions, or with a null, short, or zero vector in one, are left out; a unit with fewer than three items has a ``drop_reason`` and no numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decoders import hash_permutation
from .tables import share_package


@dataclass(frozen=True)
class Settings:
    """``share``: of variance that a subspace holds; ``cap``: most dimensions of one; ``rotated``: dimensions of the common space in which one condition is turned onto the other."""

    share: float = 0.95
    cap: int = 150
    rotated: int = 50
    seed: str = "geometry"


def item_means(df: DataFrame, unit: str, item: str, condition: str, vector: str, width: int) -> DataFrame:
    """``(unit, item, a, b)``: mean vectors of each item in conditions 0 and 1."""
    rows = df.select(F.col(unit).cast("string").alias("unit"), F.col(item).cast("string").alias("item"), F.col(condition).cast("int").alias("c"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.dropna().filter((F.size("v") == width) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.col("c").isin(0, 1))
    mean = lambda c: F.array(*(F.avg(F.when(F.col("c") == c, F.get("v", F.lit(i)))) for i in range(width)))
    both = rows.groupBy("unit", "item").agg(mean(0).alias("a"), mean(1).alias("b"))
    length = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return both.filter((length("a") > 0) & (length("b") > 0))  # null where a condition lacks the item


def centred(a: np.ndarray) -> np.ndarray:
    """Rows of length one, less their mean: its products are the centred cosines."""
    a = a / np.linalg.norm(a, axis=1, keepdims=True)
    return a - a.mean(0)


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors and eigenvalues, the greatest first, of the centred cosines."""
    u, s, _ = np.linalg.svd(centred(a), full_matrices=False)
    return u, s * s


def dimensions(values: np.ndarray, share: float) -> int:
    """Fewest leading eigenvalues that hold ``share`` of all."""
    return int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share - 1e-12) + 1)


def participation(values: np.ndarray) -> float:
    return float(values.sum() ** 2 / max((values**2).sum(), 1e-300))


def principal_angles(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Degrees between two subspaces with orthonormal bases, the smallest first; small ones from sines, which are exact there."""
    left, cosines, _ = np.linalg.svd(u.T @ v)
    sines = np.linalg.svd(v - u @ (u.T @ v), compute_uv=False)[::-1]
    small = cosines**2 > 0.5
    return np.degrees(np.where(small, np.arcsin(np.clip(sines, 0, 1)), np.arccos(np.clip(cosines, 0, 1))))


def alignment(a: np.ndarray, basis: np.ndarray, values: np.ndarray) -> float:
    """Variance of ``a`` (centred) in a subspace, against the most that as many dimensions can hold."""
    top = values[: basis.shape[1]].sum()
    return float((((basis.T @ a) ** 2).sum()) / top) if top > 0 else math.nan


def distances(a: np.ndarray) -> np.ndarray:
    """Cosine distances of all pairs, as a vector."""
    a = a / np.linalg.norm(a, axis=1, keepdims=True)
    i, j = np.triu_indices(len(a), 1)
    return 1 - (a @ a.T)[i, j]


def correlation(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x - x.mean(), y - y.mean()
    size = math.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / size) if size > 0 else math.nan


def ranks(x: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def common_space(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Both conditions in the leading components of all their vectors, each centred."""
    both = np.concatenate([a, b])
    v = np.linalg.svd(both - both.mean(0), full_matrices=False)[2][: min(k, len(a) - 1, a.shape[1])].T
    return (a - a.mean(0)) @ v, (b - b.mean(0)) @ v


def turned(a: np.ndarray, b: np.ndarray) -> float:
    """Share of ``a`` that the best rotation or reflection of ``b`` explains."""
    whole = (a * a).sum()
    return float((2 * np.linalg.svd(b.T @ a, compute_uv=False).sum() - (b * b).sum()) / whole) if whole > 0 else math.nan


class Pair:
    """The two conditions of one unit."""

    def __init__(self, a: np.ndarray, b: np.ndarray, cfg: Settings) -> None:
        self.cfg, self.raw = cfg, (a, b)
        self.a, self.b = centred(a), centred(b)
        (self.u, self.values_a), (self.v, self.values_b) = spectrum(a), spectrum(b)
        self.dims = dimensions(self.values_a, cfg.share), dimensions(self.values_b, cfg.share)
        self.k = max(1, min(*self.dims, cfg.cap))

    def aligned(self, order: np.ndarray | slice = slice(None)) -> float:
        """Mean alignment both ways, with the items of the second condition in another order."""
        u, v = self.u[:, : self.k], self.v[order, : self.k]
        return (alignment(self.a, v, self.values_a) + alignment(self.b[order], u, self.values_b)) / 2


def halves(a: np.ndarray, cfg: Settings, draw: str) -> float:
    """Alignment of one condition with itself, over two halves of the coordinates."""
    order = hash_permutation([str(i) for i in range(a.shape[1])], draw)
    one, two = a[:, order[: len(order) // 2]], a[:, order[len(order) // 2 :]]
    if not len(order) // 2 or (np.linalg.norm(one, axis=1) == 0).any() or (np.linalg.norm(two, axis=1) == 0).any():
        return math.nan
    return Pair(one, two, cfg).aligned()


def _drawn(items: DataFrame, draws: int, chunk: int, values: Callable[[list[str], np.ndarray, np.ndarray, int], tuple], names: list[str]) -> DataFrame:
    """``(unit, draw, *names)``: ``values(items, a, b, draw)`` for each draw of each unit with three items or more."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        a, b = (np.stack(pdf[c].to_numpy()).astype(float) for c in "ab")
        at = range(key[1], min(key[1] + chunk, draws)) if len(pdf) > 2 else ()
        out = [(key[0], i, *values(pdf["item"].tolist(), a, b, i)) for i in at]
        return pd.DataFrame(out, columns=["unit", "draw", *names])

    share_package(items.sparkSession)
    first = F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(chunk)))
    return items.withColumn("first", first).groupBy("unit", "first").applyInPandas(run, "unit string, draw int, " + ", ".join(f"{n} double" for n in names))


def subspaces(items: DataFrame, permutations: int = 200, splits: int = 100, cfg: Settings = Settings(), chunk: int = 50) -> DataFrame:
    """One row a unit: spectra, principal angles, alignment, rotation, and how these stand against permuted items and half splits of the coordinates.

    ``p_align`` and ``p_turn``: with the items of the second condition permuted; ``p_below_a`` and ``p_below_b``: share of half splits of one condition
    that are aligned no better than the two conditions are.
    """

    def seen(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        out = dict.fromkeys(columns) | {"unit": key[0], "n_items": len(pdf), "drop_reason": "fewer than three items"}
        if len(pdf) > 2:
            a, b = (np.stack(pdf[c].to_numpy()).astype(float) for c in "ab")
            p = Pair(a, b, cfg)
            angles = principal_angles(p.u[:, : p.k], p.v[:, : p.k])
            out |= {"trace_a": p.values_a.sum(), "trace_b": p.values_b.sum(), "participation_a": participation(p.values_a), "participation_b": participation(p.values_b), "k_a": p.dims[0], "k_b": p.dims[1], "k": p.k, "angles": angles.tolist()}
            out |= {"a_by_b": alignment(p.a, p.v[:, : p.k], p.values_a), "b_by_a": alignment(p.b, p.u[:, : p.k], p.values_b), "align": p.aligned(), "turn": turned(*common_space(a, b, cfg.rotated)), "drop_reason": None}
        return pd.DataFrame([out])[columns]

    def permuted(names: list[str], a: np.ndarray, b: np.ndarray, i: int) -> tuple:
        order = hash_permutation(names, f"{cfg.seed}:{i}")
        x, y = common_space(a, b, cfg.rotated)
        return Pair(a, b, cfg).aligned(order), turned(x, y[order])

    def split(names: list[str], a: np.ndarray, b: np.ndarray, i: int) -> tuple:
        return halves(a, cfg, f"{cfg.seed}:half:{i}"), halves(b, cfg, f"{cfg.seed}:half:{i}")

    kinds = {"unit": "string", "n_items": "long", "trace_a": "double", "trace_b": "double", "participation_a": "double", "participation_b": "double", "k_a": "int", "k_b": "int", "k": "int", "angles": "array<double>", "a_by_b": "double", "b_by_a": "double", "align": "double", "turn": "double", "drop_reason": "string"}
    columns = list(kinds)
    share_package(items.sparkSession)
    real = items.groupBy("unit").applyInPandas(seen, ", ".join(f"{k} {v}" for k, v in kinds.items()))
    null = _drawn(items, permutations, chunk, permuted, ["x", "y"]).join(real.select("unit", "align", "turn"), "unit")
    at_least = lambda x, s: (1 + F.count(F.when(F.col(x) >= F.col(s), 1))) / (1 + F.count(F.lit(1)))
    null = null.groupBy("unit").agg(at_least("x", "align").alias("p_align"), at_least("y", "turn").alias("p_turn"), F.avg("x").alias("null_align"), F.avg("y").alias("null_turn"))
    ceiling = _drawn(items, splits, chunk, split, ["x", "y"]).join(real.select("unit", "align"), "unit")
    under = lambda x: (1 + F.count(F.when(F.col(x) <= F.col("align"), 1))) / (1 + F.count(F.when(~F.isnan(x), 1)))
    whole = lambda x: F.avg(F.when(~F.isnan(x), F.col(x)))
    ceiling = ceiling.groupBy("unit").agg(whole("x").alias("half_a"), whole("y").alias("half_b"), under("x").alias("p_below_a"), under("y").alias("p_below_b"))
    return real.join(null, "unit", "left").join(ceiling, "unit", "left")


def pairs_needed(r: float = 0.2, alpha: float = 0.05, power: float = 0.8) -> int:
    """Pairs at which a correlation of ``r`` is found, by Fisher's transform."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return math.ceil((z / math.atanh(r)) ** 2 + 3)


def stability(items: DataFrame, draws: int = 1000, item_share: float = 0.8, coordinate_share: float = 1.0, rank: bool = False, seed: str = "stability", chunk: int = 100) -> DataFrame:
    """Correlation of both conditions' distances over subsets of items (without) and coordinates (with replacement): a row a unit and draw, ``(unit, draw, r)``.

    Units that :func:`gate` turns away should not be read.
    """

    def one(names: list[str], a: np.ndarray, b: np.ndarray, i: int) -> tuple:
        kept = np.sort(hash_permutation(names, f"{seed}:{i}")[: max(3, math.ceil(item_share * len(names)))])
        d = a.shape[1]
        at = [int(hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()[:7], 16) % d for j in range(max(3, math.ceil(coordinate_share * d)))]
        a, b = a[np.ix_(kept, at)], b[np.ix_(kept, at)]
        live = (np.linalg.norm(a, axis=1) > 0) & (np.linalg.norm(b, axis=1) > 0)
        x, y = distances(a[live]), distances(b[live])
        return (correlation(ranks(x), ranks(y)) if rank else correlation(x, y) if len(x) else math.nan,)

    return _drawn(items, draws, chunk, one, ["r"])


def gate(items: DataFrame, width: int, least_items: int = 10, least_coordinates: int = 5, r: float = 0.2) -> DataFrame:
    """``(unit, n_items, n_pairs, drop_reason)``: whether a unit has items, coordinates and pairs enough to find a correlation of ``r``."""
    need = pairs_needed(r)
    n, pairs = F.col("n_items"), F.col("n_pairs")
    few = F.when(F.lit(width < least_coordinates), "too few coordinates").when(n < least_items, "too few items").when(pairs < need, f"fewer than {need} pairs")
    counts = items.groupBy("unit").agg(F.count(F.lit(1)).alias("n_items"))
    return counts.withColumn("n_pairs", (n * (n - 1) / 2).cast("long")).withColumn("drop_reason", few)


def classical_scaling(pairs: DataFrame, k: int, rounds: int = 60, tolerance: float = 1e-9, extra: int = 4) -> tuple[DataFrame, np.ndarray]:
    """Coordinates ``(item, y)`` of items in ``k`` dimensions from ``pairs(i, j, d)``, each pair once, and the leading eigenvalues.

    The doubly centred matrix of squares is never made: a power step for ``k + extra`` vectors joins them to the pairs and sums by item, and its centring is that of the vectors before and after.
    Only products of vectors, ``k + extra`` squared numbers, reach the driver.  Steps go through ``checkpoint``.  Negative eigenvalues count as 0; pairs with nulls are ignored.
    """
    spark, m = pairs.sparkSession, k + extra
    pairs = pairs.dropna().filter("i <> j")
    both = pairs.select("i", "j", (F.col("d") * F.col("d")).alias("s")).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("d") * F.col("d")).alias("s"))).checkpoint()
    names = [f"v{c}" for c in range(m)]
    start = [F.xxhash64("item", F.lit(c)).cast("double") / F.lit(2.0**63) for c in range(m)]
    v = both.select(F.col("i").alias("item")).distinct().select("item", *(s.alias(c) for s, c in zip(start, names, strict=True))).checkpoint()

    def less_mean(df: DataFrame) -> DataFrame:
        means = df.agg(*(F.avg(c).alias(c) for c in names)).first()
        return df.select("item", *((F.col(c) - F.lit(means[c] or 0.0)).alias(c) for c in names))

    def products(df: DataFrame, right: list[str], left: list[str]) -> np.ndarray:
        row = df.agg(*(F.sum(F.col(a) * F.col(b)) for a in left for b in right)).first()
        return np.array(row, float).reshape(len(left), len(right))

    def changed(df: DataFrame, by: np.ndarray) -> DataFrame:
        mix = [sum((F.col(c) * float(by[r, j]) for r, c in enumerate(names)), F.lit(0.0)).alias(names[j]) for j in range(m)]
        return df.select("item", *mix)

    def unit(df: DataFrame) -> DataFrame:
        """Orthonormal vectors of the same space; directions that are not there become 0."""
        values, vectors = np.linalg.eigh(products(df, names, names))
        scale = np.where(values > 1e-13 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        return changed(df, vectors * scale)

    if v.isEmpty():
        return spark.createDataFrame([], f"item {v.schema['item'].dataType.simpleString()}, y array<double>"), np.zeros(k)
    v, last = unit(unit(less_mean(v)).checkpoint()).checkpoint(), np.zeros(m)
    for _ in range(rounds):
        stepped = both.join(v.withColumnRenamed("item", "j"), "j").groupBy(F.col("i").alias("item")).agg(*(F.sum(F.col("s") * F.col(c) * F.lit(-0.5)).alias("w" + c[1:]) for c in names)).checkpoint()
        means = stepped.agg(*(F.avg("w" + c[1:]).alias(c) for c in names)).first()
        held = v.join(stepped, "item").select("item", *names, *((F.col("w" + c[1:]) - F.lit(means[c])).alias("w" + c[1:]) for c in names)).checkpoint()
        inner = products(held, ["w" + c[1:] for c in names], names)
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(values)[::-1]
        values, vectors = values[order], vectors[:, order]
        v = held.select("item", *names)
        if np.abs(values[:k] - last[:k]).max() <= tolerance * max(abs(values).max(), 1e-300):
            break
        last = values
        v = unit(unit(held.select("item", *(F.col("w" + c[1:]).alias(c) for c in names))).checkpoint()).checkpoint()
    top = np.maximum(values[:k], 0)
    return changed(v, vectors).select("item", F.array(*(F.col(c) * float(math.sqrt(top[i])) for i, c in enumerate(names[:k]))).alias("y")), top
