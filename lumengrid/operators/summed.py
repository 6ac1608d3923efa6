"""Decoders of a unit of many rows, fitted from sums: rows stay in blocks over the tasks, and a pass over them gives losses and slopes of all fits that still move.

All models, grid points, outer and inner folds of the unit move together, so that the passes are as many as the slowest fit needs and each
row is read once in a pass.  A pass sends coefficients to the blocks and brings back one sum for each fit, added in the blocks' order.
Penalties, steps and choices are those of :mod:`decoders`; final fits start at the chosen grid point's.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decoders
from .quasi import minimise

#: Rows of a block, and doubles of scores that a block's fits hold at a time.
BLOCK, HELD = 4096, 2_000_000


@dataclass(frozen=True)
class Fit:
    """Training rows are those of neither fold; class ``weights`` are divided by their total ``weight`` over the rows."""

    kind: str
    outer: int
    inner: int | None
    strength: float
    mix: float
    weights: np.ndarray
    weight: float


def _packed(own: DataFrame, classes: list[str], parts: int, ordered: bool) -> RDD:
    """Blocks: ``fold -> (features, class, times)``, persisted."""
    place = {c: i for i, c in enumerate(classes)}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low in range(0, len(pdf), BLOCK):
                part = pdf.iloc[low : low + BLOCK]
                x, f = np.stack(part["x"].to_numpy()).astype(float), part["f"].to_numpy()
                y, t = part["y"].map(place).to_numpy(), part["t"].to_numpy(float)
                yield pd.DataFrame({"block": [pickle.dumps({int(g): (x[f == g], y[f == g], t[f == g]) for g in np.unique(f)})]})

    keys = ["o"] if ordered else ["f", "y", "x"]
    dealt = own.select("y", "x", "f", "t", "o").repartition(parts, *keys).sortWithinPartitions("f", *keys)
    return dealt.mapInPandas(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)


def _sums(blocks: RDD, of: Callable, sent: object, rows: int) -> np.ndarray:
    """Sum over blocks of arrays with ``rows`` rows that ``of(block, sent)`` gives, added in the order of the partitions."""
    held, cut = blocks.context.broadcast(sent), np.linspace(0, rows, min(rows, 8) + 1).astype(int)

    def part(i: int, own: Iterator[dict]) -> Iterator[tuple]:
        total = reduce(np.add, (of(b, held.value) for b in own), np.zeros(()))
        if total.ndim:
            yield from ((j, (i, total[cut[j] : cut[j + 1]])) for j in range(len(cut) - 1))

    added = blocks.mapPartitionsWithIndex(part).groupByKey(len(cut) - 1).mapValues(lambda v: reduce(np.add, (a for _, a in sorted(v, key=lambda z: z[0]))))
    out = np.concatenate([a for _, a in sorted(added.collect(), key=lambda z: z[0])])
    held.destroy()
    return out


def _design(x: np.ndarray, scale: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), (x - scale[0]) / scale[1]], 1)


def _lots(at: list[int], rows: int, classes: int) -> Iterator[list[int]]:
    size = max(1, HELD // max(rows * classes, 1))
    return (at[low : low + size] for low in range(0, len(at), size))


def _losses(block: dict, sent: tuple) -> np.ndarray:
    """``(fit, 1 + coefficients)``: weighted loss and slope."""
    fits, w, scales = sent
    p, k = w.shape[1:]
    out = np.zeros((len(fits), 1 + p * k))
    for g, (x, y, t) in block.items():
        one = np.eye(k)[y][:, None]
        for o in sorted({f.outer for f in fits} - {g}):
            z = _design(x, scales[o])
            for kind in ("softmax", "svm"):
                own = [i for i, f in enumerate(fits) if f.outer == o and f.inner != g and (f.kind == "svm") == (kind == "svm")]
                for at in _lots(own, len(x), k):
                    eta = (z @ w[at].transpose(1, 0, 2).reshape(p, -1)).reshape(len(x), len(at), k)
                    u = np.stack([fits[i].weights[y] * t for i in at], 1)
                    if kind == "svm":
                        sign = 2 * one - 1
                        short = np.maximum(0, 1 - sign * eta)
                        loss, turn = (u * (short**2).sum(2)).sum(0), -2 * u[:, :, None] * sign * short
                    else:
                        log_sum, share = decoders._softmax(eta)
                        loss, turn = (u * (log_sum - (eta * one).sum(2))).sum(0), u[:, :, None] * (share - one)
                    out[at, 0] += loss
                    out[at, 1:] += (z.T @ turn.reshape(len(x), -1)).reshape(p, len(at), k).transpose(1, 0, 2).reshape(len(at), -1)
    return out


def _hits(block: dict, sent: tuple) -> np.ndarray:
    """``(fit, class)``: held-out rows of each class that are told right."""
    fits, w, scales, seen = sent
    p, k = w.shape[1:]
    out = np.zeros((len(fits), k))
    for i, f in enumerate(fits):
        x, y, t = block.get(f.outer if f.inner is None else f.inner, (np.zeros((0, p - 1)), np.zeros(0, int), np.zeros(0)))
        if len(x):
            guess = decoders.predicted(w[i], (x - scales[f.outer][0]) / scales[f.outer][1], seen[i])
            out[i] = np.bincount(y, t * (guess == y), k)
    return out


def majorised(losses: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, grams: np.ndarray, ridge: np.ndarray, lasso: np.ndarray, passes: int = 300, tolerance: float = 1e-7) -> np.ndarray:
    """Elastic fits by quadratic models of the losses, so that a pass is spent on a model's minimum and not on each of the small steps to it.

    A model's curvature is ``bend (I - 1/k) x gram``, which lies above the loss's for ``bend`` 1/2; less is tried first, and more where a loss came out above its model.
    """
    w, k = start.copy(), start.shape[2]
    bend, top = np.full(len(w), 1 / k), np.linalg.eigvalsh(grams)[:, -1]
    centred = lambda v: v - v.mean(2, keepdims=True)
    live = np.arange(len(w))
    f, g = np.empty(len(w)), np.empty_like(w)
    out = losses(w, live)
    f[:], g[:] = out[:, 0], out[:, 1:].reshape(w.shape)
    for _ in range(passes):
        # the end is that of the small steps
        size = 1 / (0.5 * top[live] + ridge[live])
        new = decoders.proximal(lambda v, which: g[live[which]], w[live], size, ridge[live], lasso[live], steps=1)  # noqa: B023
        live = live[(np.abs(w[live] - new) / size[:, None, None]).max((1, 2)) >= tolerance]
        if not len(live):
            break
        turned = lambda v, which: g[live[which]] + bend[live[which], None, None] * centred(grams[live[which]] @ (v - w[live[which]]))  # noqa: B023, E731
        tried = decoders.proximal(turned, w[live], 1 / (bend[live] * top[live] + ridge[live]), ridge[live], lasso[live], tolerance=tolerance / 10)
        out, move = losses(tried, live), tried - w[live]
        model = f[live] + (g[live] * move).sum((1, 2)) + 0.5 * bend[live] * (centred(grams[live] @ move) * move).sum((1, 2))
        fine = (out[:, 0] <= model + 1e-13 * (1 + np.abs(f[live]))) | (bend[live] >= 0.5)
        at = live[fine]
        w[at], f[at], g[at] = tried[fine], out[fine, 0], out[fine, 1:].reshape(-1, *w.shape[1:])
        bend[live[~fine]] = np.minimum(1.5 * bend[live[~fine]], 0.5)
    return w


def fit_all(blocks: RDD, fits: list[Fit], scales: dict, start: np.ndarray, grams: Callable[[Fit], np.ndarray]) -> np.ndarray:
    """Coefficients ``(fit, 1 + features, classes)``; ``grams`` gives the weighted products of a fit's design."""
    w = start.copy()
    p, k = w.shape[1:]
    lam = np.array([0.0 if np.isinf(f.strength) else 1 / (f.strength * f.weight) for f in fits])

    def losses(at: np.ndarray, points: np.ndarray) -> np.ndarray:
        return _sums(blocks, _losses, ([fits[i] for i in at], points.reshape(-1, p, k), scales), len(at))

    smooth = np.array([i for i, f in enumerate(fits) if f.kind != "elastic"], int)
    free = np.array([0.0 if f.kind == "svm" else 1.0 for f in fits])

    def value_and_slope(points: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, v = smooth[which], points.reshape(-1, p, k)
        out = losses(at, points)
        # the intercept is penalised where it is not free
        held = v.copy()
        held[:, 0] *= 1 - free[at, None]
        return out[:, 0] + 0.5 * lam[at] * (held**2).sum((1, 2)), out[:, 1:] + (lam[at, None, None] * held).reshape(len(at), -1)

    if len(smooth):
        w[smooth] = minimise(value_and_slope, w[smooth].reshape(len(smooth), -1), tolerance=1e-8).reshape(-1, p, k)
    thin = np.array([i for i, f in enumerate(fits) if f.kind == "elastic"], int)
    if len(thin):
        mix = np.array([fits[i].mix for i in thin])
        ridge, lasso = lam[thin] * (1 - mix), lam[thin] * mix
        w[thin] = majorised(lambda v, which: losses(thin[which], v), w[thin], np.stack([grams(fits[i]) for i in thin]), ridge, lasso)
    return w


def _ends(a: dict, b: dict) -> dict:
    """Least and greatest values, sums and counts of each fold, of two parts."""
    both = {g: (np.minimum(a[g][0], b[g][0]), np.maximum(a[g][1], b[g][1]), a[g][2] + b[g][2], a[g][3] + b[g][3]) for g in a.keys() & b.keys()}
    return a | b | both


def _products(block: dict, sent: tuple) -> np.ndarray:
    """``(fold and class, products of the design about the common mean)``."""
    folds, k, mean = sent
    out = np.zeros((len(folds) * k, (1 + len(mean)) ** 2))
    for g, (x, y, t) in block.items():
        z = _design(x, (mean, np.ones(len(mean))))
        for c in np.unique(y):
            own = z[y == c]
            out[folds.index(g) * k + c] += ((own * t[y == c, None]).T @ own).ravel()
    return out


def _fourth(block: dict, sent: tuple) -> np.ndarray:
    """``(outer fold, 1)``: weighted sum of the squared squared lengths of training rows about their class's mean."""
    scales, means, weights = sent
    out = np.zeros((len(scales), 1))
    for g, (x, y, t) in block.items():
        for i, (o, (mean, sd)) in enumerate(scales.items()):
            if o != g:
                out[i] += (t * weights[o][y]) @ (((x - mean) / sd - means[o][y]) ** 2).sum(1) ** 2
    return out


def decode(own: DataFrame, unit: str, models: tuple[decoders.Model, ...], rows: int, ordered: bool) -> list[dict]:
    """Rows of :func:`decoders.decode` for one unit; ``own`` has its ``y``, ``x``, ``f``, ``t`` and ``o``."""
    classes = sorted(r[0] for r in own.select("y").distinct().collect())
    parts = max(1, min(-(-rows // BLOCK), 3 * own.sparkSession.sparkContext.defaultParallelism))
    blocks = _packed(own, classes, parts, ordered)
    try:
        return _decoded(blocks, unit, models, len(classes))
    finally:
        blocks.unpersist()


def _decoded(blocks: RDD, unit: str, models: tuple[decoders.Model, ...], k: int) -> list[dict]:
    ends = blocks.map(lambda b: {g: (x.min(0), x.max(0), t @ x, t.sum()) for g, (x, _, t) in b.items()}).reduce(_ends)
    folds = sorted(ends)
    mean = sum(e[2] for e in ends.values()) / sum(e[3] for e in ends.values())
    p = 1 + len(mean)
    gram = dict(zip(folds, _sums(blocks, _products, (folds, k, mean), len(folds) * k).reshape(len(folds), k, p, p), strict=True))
    count = {g: gram[g][:, 0, 0] for g in folds}

    def rest(*out: int | None) -> list[int]:
        return [g for g in folds if g not in out]

    def over(values: dict, *out: int | None) -> np.ndarray:
        return sum((values[g] for g in rest(*out)), np.zeros_like(values[folds[0]]))

    scales, turn, base = {}, {}, []
    for o in folds:
        n = over(count, o)
        one = {"unit": unit, "model": None, "fold": o, "n_train": int(n.sum()), "n_test": int(count[o].sum()), "strength": None, "mix": None, "accuracy": None, "balanced": None, "coefficients": None, "drop_reason": None}
        if (n > 0).sum() < 2:
            base.append(one | {"drop_reason": "one class in training" if rest(o) else "no held-out rows"})
            continue
        base.append(one)
        every = over(gram, o).sum(0) / n.sum()
        wide = np.max([ends[g][1] for g in rest(o)], 0) > np.min([ends[g][0] for g in rest(o)], 0)
        sd = np.where(wide, np.sqrt(np.maximum(np.diag(every)[1:] - every[0, 1:] ** 2, 0)), 1.0)
        scales[o] = (mean + every[0, 1:], np.where(sd > 0, sd, 1.0))
        # from the design about the common mean to the standardised one
        turn[o] = np.diag(np.concatenate([[1.0], 1 / scales[o][1]]))
        turn[o][1:, 0] = -every[0, 1:] / scales[o][1]

    def fit(model: decoders.Model, o: int, j: int | None, point: tuple[float, float]) -> Fit:
        n = over(count, o, j)
        weights = np.divide(n.sum(), (n > 0).sum() * n, out=np.zeros(k), where=n > 0) if model.balanced else np.ones(k)
        total = float(weights @ n)
        return Fit(model.kind, o, j, np.inf if model.kind == "free" else point[0], point[1], weights / total, total)

    def products(f: Fit) -> np.ndarray:
        return turn[f.outer] @ np.tensordot(f.weights, over(gram, f.outer, f.inner), 1) @ turn[f.outer].T

    def seen(fits: list[Fit]) -> list[np.ndarray]:
        return [over(count, f.outer, f.inner) > 0 for f in fits]

    def scored(fits: list[Fit], w: np.ndarray) -> np.ndarray:
        return _sums(blocks, _hits, (fits, w, scales, seen(fits)), len(fits)) if fits else np.zeros((0, k))

    def balanced(hit: np.ndarray, n: np.ndarray) -> float:
        return float(np.mean(hit[n > 0] / n[n > 0]))

    steps, tries = [m for m in models if m.kind != "lda"], []
    for m, o in ((m, o) for m in steps if len(m.grid) > 1 for o in scales):
        inner = [j for j in rest(o) if (over(count, o, j) > 0).sum() > 1]
        tries += [(m, o, point, len(inner), fit(m, o, j, point)) for point in m.grid for j in inner]
    fits = [t[-1] for t in tries]
    tried = fit_all(blocks, fits, scales, np.zeros((len(fits), p, k)), products) if fits else np.zeros((0, p, k))
    score: dict = {}
    begun: dict = {}
    for (m, o, point, inner, f), hit, w in zip(tries, scored(fits, tried), tried, strict=True):
        score[m.name, o, point] = score.get((m.name, o, point), 0.0) + balanced(hit, count[f.inner]) / inner
        begun[m.name, o, point] = begun.get((m.name, o, point), 0.0) + w / inner
    best = {(m.name, o): max(m.grid, key=lambda g: score.get((m.name, o, g), 0.0)) for m in models for o in scales}  # noqa: B023
    last = [(m, o, fit(m, o, None, best[m.name, o])) for m in steps for o in scales]
    start = np.array([begun.get((m.name, o, best[m.name, o]), np.zeros((p, k))) for m, o, _ in last]).reshape(-1, p, k)
    done = list(fit_all(blocks, [f for *_, f in last], scales, start, products)) if last else []
    for m in (m for m in models if m.kind == "lda"):
        own = {o: turn[o] @ over(gram, o) @ turn[o].T for o in scales}
        means = {o: np.divide(own[o][:, 0, 1:], own[o][:, :1, 0], out=np.zeros((k, p - 1)), where=own[o][:, :1, 0] > 0) for o in scales}
        held = {o: fit(m, o, None, best[m.name, o]) for o in scales}
        fourth = _sums(blocks, _fourth, (scales, means, {o: f.weights for o, f in held.items()}), len(scales))[:, 0] if scales else []
        for (o, mu), most in zip(means.items(), fourth, strict=True):
            n = held[o].weights * own[o][:, 0, 0]  # one in all
            last.append((m, o, held[o]))
            done.append(decoders.discriminant_of(n * held[o].weight, mu, np.tensordot(held[o].weights, own[o][:, 1:, 1:], 1) - (mu * n[:, None]).T @ mu, most))
    found = {}
    for (m, o, _), w, hit in zip(last, done, scored([f for *_, f in last], np.array(done)), strict=True):
        n = count[o]
        found[m.name, o] = {"strength": best[m.name, o][0], "mix": best[m.name, o][1], "accuracy": float(hit.sum() / n.sum()), "balanced": balanced(hit, n), "coefficients": w.ravel().tolist()}
    return [one | {"model": m.name} | found.get((m.name, one["fold"]), {}) for m in models for one in base]
