"""Linear decoders of labels with chosen penalties, fitted for many units, folds and models in parallel.

A unit's rows (some thousand trials) go to one task for each outer fold and model, so ``units x folds x models`` tasks share the work.
In a task the grid of the model is tried on the inner folds, all grid points and folds as one batch of fits; the best by mean
balanced accuracy (the first of equals) is fitted on the outer training rows and scored on the held-out ones.

Models: ``logistic`` (multinomial, L2), ``free`` (multinomial, no penalty), ``elastic`` (multinomial, L1 and L2), ``svm`` (one against the rest, squared hinge, L2)
and ``lda`` (common covariance, shrunk by an estimated share).  Features are standardised by the training rows; with ``balanced``, classes weigh alike.

Defined results: rows with a null label, fold, unit or feature are left out; a fold whose training rows have fewer than two classes, or without held-out rows, gives a ``drop_reason`` and null scores.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .digests import leading_ten
from .quasi import minimise
from .tables import share_package, starts_of


@dataclass(frozen=True)
class Model:
    """``strengths``: inverse penalties C that are tried; ``mixes``: shares of L1 in the penalty (``elastic``)."""

    name: str
    kind: str
    strengths: tuple[float, ...] = (1.0,)
    mixes: tuple[float, ...] = (0.0,)
    balanced: bool = True

    @property
    def grid(self) -> list[tuple[float, float]]:
        return list(product(self.strengths, self.mixes))


#: Rows beyond which a unit is not one task for each fold and model.
LARGE = 12_000

#: The linear models that are compared.
MODELS = (
    Model("logistic", "logistic", tuple(float(c) for c in np.logspace(-2, 4, 9))),
    Model("logistic_unweighted", "logistic", tuple(float(c) for c in np.logspace(-4, 3, 15)), balanced=False),
    Model("free", "free"),
    Model("elastic", "elastic", tuple(float(c) for c in np.logspace(-2, 1, 5)), (0.0, 0.2, 0.5, 0.8)),
    Model("svm", "svm", tuple(float(c) for c in np.logspace(-3, 3, 7))),
    Model("lda", "lda", balanced=False),
)


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the sum and shares, over the last axis."""
    top = z.max(-1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(-1, keepdims=True)
    return (np.log(total) + top)[..., 0], e / total


def logistic(x: np.ndarray, y: np.ndarray, use: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Multinomial fits ``(fit, 1 + features, classes)``: ``C sum(use loss) + |w|^2 / 2``, the intercepts free.

    ``y`` is one-hot, ``use`` ``(fit, rows)`` weighs rows; an infinite ``strength`` is no penalty.
    """
    z = np.concatenate([np.ones((len(x), 1)), x], 1)
    b, p, k = len(use), z.shape[1], y.shape[1]
    # the loss is divided by its weight, so that slopes have one scale
    total = use.sum(1)
    lam = np.where(np.isinf(strength), 0.0, 1 / (strength * total))

    def value_and_slope(w: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = w.reshape(-1, p, k)
        eta = z @ w
        log_sum, share = _softmax(eta)
        u = use[which] / total[which, None]
        loss = (u * (log_sum - (eta * y).sum(2))).sum(1) + 0.5 * lam[which] * (w[:, 1:] ** 2).sum((1, 2))
        slope = z.T @ (u[:, :, None] * (share - y))
        slope[:, 1:] += lam[which, None, None] * w[:, 1:]
        return loss, slope.reshape(len(w), -1)

    return minimise(value_and_slope, np.zeros((b, p * k)), tolerance=1e-8).reshape(b, p, k)


def elastic(x: np.ndarray, y: np.ndarray, use: np.ndarray, strength: np.ndarray, mix: np.ndarray, steps: int = 3000, tolerance: float = 1e-7) -> np.ndarray:
    """As :func:`logistic`, with the penalty ``mix |w|_1 + (1 - mix) |w|^2 / 2``, by accelerated proximal steps of one length."""
    z = np.concatenate([np.ones((len(x), 1)), x], 1)
    b, p, k = len(use), z.shape[1], y.shape[1]
    total = use.sum(1)
    lam = 1 / (strength * total)
    ridge, lasso = (lam * (1 - mix))[:, None, None], (lam * mix)[:, None, None]
    u = (use / total[:, None])[:, :, None]
    # the curvature of the loss is at most half of the greatest one of the weighted design
    size = 1 / (0.5 * np.array([np.linalg.eigvalsh((z * v).T @ z)[-1] for v in u]) + ridge[:, 0, 0])[:, None, None]

    def slope(at: np.ndarray, live: np.ndarray) -> np.ndarray:
        _, share = _softmax(z @ at)
        return z.T @ (u[live] * (share - y))

    return proximal(slope, np.zeros((b, p, k)), size[:, 0, 0], ridge[:, 0, 0], lasso[:, 0, 0], steps, tolerance)


def proximal(slope_of: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, size: np.ndarray, ridge: np.ndarray, lasso: np.ndarray, steps: int = 3000, tolerance: float = 1e-7) -> np.ndarray:
    """Accelerated proximal steps of many fits from ``start (fit, 1 + features, classes)``; ``slope_of(points, which)`` gives slopes of the losses of the fits ``which``."""
    size, ridge, lasso = size[:, None, None], ridge[:, None, None], lasso[:, None, None]
    w = start.copy()
    ahead, t, live = w.copy(), np.ones(len(w)), np.arange(len(w))
    for _ in range(steps):
        slope = slope_of(ahead[live], live)
        slope[:, 1:] += ridge[live] * ahead[live][:, 1:]
        new = ahead[live] - size[live] * slope
        cut = new[:, 1:]
        new[:, 1:] = np.sign(cut) * np.maximum(np.abs(cut) - size[live] * lasso[live], 0)
        move = new - w[live]
        # speed is lost where it leads uphill
        t[live] = np.where(((ahead[live] - new) * move).sum((1, 2)) > 0, 1.0, t[live])
        t_next = (1 + np.sqrt(1 + 4 * t[live] ** 2)) / 2
        rest = (np.abs(ahead[live] - new) / size[live]).max((1, 2)) < tolerance
        ahead[live] = new + ((t[live] - 1) / t_next)[:, None, None] * move
        w[live], t[live] = new, t_next
        live = live[~rest]
        if not len(live):
            break
    return w


def squared_hinge(x: np.ndarray, y: np.ndarray, use: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """One class against the rest: ``C sum(use max(0, 1 - s eta)^2) + |w|^2 / 2``, the intercept penalised as well."""
    z = np.concatenate([np.ones((len(x), 1)), x], 1)
    b, p, k = len(use), z.shape[1], y.shape[1]
    sign = 2 * y - 1
    lam = 1 / (strength * use.sum(1))
    u = (use / use.sum(1)[:, None])[:, :, None]

    def value_and_slope(w: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = w.reshape(-1, p, k)
        short = np.maximum(0, 1 - sign * (z @ w))
        loss = (u[which] * short**2).sum((1, 2)) + 0.5 * lam[which] * (w**2).sum((1, 2))
        slope = z.T @ (-2 * u[which] * sign * short) + lam[which, None, None] * w
        return loss, slope.reshape(len(w), -1)

    return minimise(value_and_slope, np.zeros((b, p * k)), tolerance=1e-8).reshape(b, p, k)


def discriminant(x: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Scores of a common covariance, shrunk towards a multiple of the identity by the share that is estimated to lessen its error most."""
    n = use.sum()
    counts = use @ y
    means = np.divide((y * use[:, None]).T @ x, counts[:, None], out=np.zeros((y.shape[1], x.shape[1])), where=counts[:, None] > 0)
    r, u = (x - y @ means)[use > 0], use[use > 0]
    return discriminant_of(counts, means, (r * u[:, None]).T @ r / n, (u * (r**2).sum(1) ** 2).sum() / n)


def discriminant_of(counts: np.ndarray, means: np.ndarray, cov: np.ndarray, fourth: float) -> np.ndarray:
    """The same from each class's weight and mean, the common covariance, and the mean squared squared length ``fourth`` about the means."""
    n = counts.sum()
    level = np.trace(cov) / len(cov)
    spread = ((cov - level * np.eye(len(cov))) ** 2).sum()
    noise = (fourth - (cov**2).sum()) / n
    share = 0.0 if spread <= 0 else min(1.0, max(0.0, noise / spread))
    w = np.linalg.lstsq((1 - share) * cov + share * level * np.eye(len(cov)), means.T, rcond=None)[0]
    bias = -0.5 * (means.T * w).sum(0) + np.log(np.maximum(counts, 1e-300) / n)
    return np.concatenate([bias[None], w])


def fits(model: Model, x: np.ndarray, y: np.ndarray, train: np.ndarray, points: list[tuple[float, float]], times: np.ndarray | None = None) -> np.ndarray:
    """Coefficients ``(fit, 1 + features, classes)`` on the rows that ``train`` ``(fit, rows)`` marks, each counted ``times``."""
    use = train.astype(float) if times is None else train * times
    if model.balanced:
        counts = use @ y
        present = (counts > 0).sum(1)
        use = use * ((np.divide(use.sum(1)[:, None], present[:, None] * counts, out=np.zeros_like(counts), where=counts > 0)) @ y.T)
    strength, mix = (np.array(v, float) for v in zip(*points, strict=True))
    if model.kind == "elastic":
        return elastic(x, y, use, strength, mix)
    if model.kind == "svm":
        return squared_hinge(x, y, use, strength)
    if model.kind == "lda":
        return np.stack([discriminant(x, y, u) for u in use])
    return logistic(x, y, use, np.full(len(points), np.inf) if model.kind == "free" else strength)


def predicted(w: np.ndarray, x: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The class of the greatest score among those ``seen`` in training; scores as close as the fits are exact tie, and the first class has them."""
    scores = np.where(seen, x @ w[1:] + w[0], -np.inf)
    return (scores >= scores.max(1, keepdims=True) - 1e-6).argmax(1)


def balanced_accuracy(truth: np.ndarray, guess: np.ndarray, times: np.ndarray | None = None) -> float:
    times = np.ones(len(truth)) if times is None else times
    return float(np.mean([times[(truth == c) & (guess == c)].sum() / times[truth == c].sum() for c in np.unique(truth)]))


def _chosen(model: Model, x: np.ndarray, y: np.ndarray, truth: np.ndarray, train: np.ndarray, fold: np.ndarray, times: np.ndarray) -> tuple[tuple[float, float], float | None]:
    """The best grid point over the folds of the training rows (the first of equals), and its mean score there."""
    inner = [j for j in np.unique(fold[train]) if len(np.unique(truth[train & (fold != j)])) > 1]
    if not inner:
        return model.grid[0], None
    tries = [(g, j) for g in model.grid for j in inner]
    w = fits(model, x, y, np.array([train & (fold != j) for _, j in tries]), [g for g, _ in tries], times)
    score = dict.fromkeys(model.grid, 0.0)
    for (g, j), v in zip(tries, w, strict=True):
        at = train & (fold == j)
        score[g] += balanced_accuracy(truth[at], predicted(v, x[at], y[train & (fold != j)].any(0)), times[at]) / len(inner)
    best = max(model.grid, key=lambda g: score[g])
    return best, score[best]


def _scaled(x: np.ndarray, train: np.ndarray, times: np.ndarray) -> np.ndarray:
    u = times[train] / times[train].sum()
    mean = u @ x[train]
    sd = np.sqrt(u @ (x[train] - mean) ** 2)
    # a constant may differ from its mean by rounding
    return (x - mean) / np.where(np.ptp(x[train], 0) > 0, sd, 1.0)


def _counted(own: DataFrame, *keys: str) -> DataFrame:
    """Equal rows as one with the number ``t`` of them: they are one to any fit, and a unit of few distinct rows is small however many it has."""
    return own.groupBy(*keys).agg(F.count(F.lit(1)).alias("t"))


def _own(rows: DataFrame, **columns) -> DataFrame:
    own = rows.select(*(c.alias(k) for k, c in columns.items()))
    return own.dropna(subset=[k for k in columns if k != "o"]).filter("not exists(x, v -> v is null or isnan(v))")


def decode(rows: DataFrame, unit: str, label: str, features: str, fold: str, models: tuple[Model, ...] = MODELS, order: str | None = None, large: int = LARGE) -> DataFrame:
    """Scores of each unit, model and outer fold: ``(unit, model, fold, n_train, n_test, strength, mix, accuracy, balanced, coefficients, drop_reason)``.

    ``features`` is an array column, ``fold`` an integer one; inner folds are the other outer folds.  ``order`` (or the features) puts equal runs in one order.
    Units of more than ``large`` (distinct) rows are fitted from sums over blocks of their rows, one such unit after the other.
    """
    from . import summed

    names = {m.name: m for m in models}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        u, name, k = key
        model = names[name]
        # rows in one order, so that equal runs have equal sums
        pdf = pdf.sort_values("o") if order else pdf.iloc[sorted(range(len(pdf)), key=lambda i: (pdf["f"].iat[i], pdf["y"].iat[i], tuple(pdf["x"].iat[i])))]
        x, f, times = np.stack(pdf["x"].to_numpy()).astype(float), pdf["f"].to_numpy(), pdf["t"].to_numpy(float)
        classes, truth = np.unique(pdf["y"].to_numpy(), return_inverse=True)
        train = f != k
        out = {"unit": u, "model": name, "fold": k, "n_train": int(times[train].sum()), "n_test": int(times[~train].sum()), "strength": None, "mix": None, "accuracy": None, "balanced": None, "coefficients": None, "drop_reason": None}
        if len(np.unique(truth[train])) < 2 or train.all():
            out["drop_reason"] = "no held-out rows" if train.all() else "one class in training"
            return pd.DataFrame([out])[list(out)]
        x, y = _scaled(x, train, times), np.eye(len(classes))[truth]
        best = _chosen(model, x, y, truth, train, f, times)[0] if len(model.grid) > 1 else model.grid[0]
        w = fits(model, x, y, train[None], [best], times)[0]
        guess = predicted(w, x[~train], y[train].any(0))
        out |= {"strength": best[0], "mix": best[1], "accuracy": float(times[~train] @ (guess == truth[~train]) / times[~train].sum()), "balanced": balanced_accuracy(truth[~train], guess, times[~train]), "coefficients": w.ravel().tolist()}
        return pd.DataFrame([out])[list(out)]

    share_package(rows.sparkSession)
    text, whole = lambda c: F.col(c).cast("string"), F.col(features).cast("array<double>")
    own = _own(rows, unit=text(unit), y=text(label), x=whole, f=F.col(fold).cast("int"), o=F.col(order) if order else F.lit(0))
    own = own.withColumn("t", F.lit(1).cast("long")) if order else _counted(own, "unit", "y", "x", "f")
    columns = ("unit", "model", "fold", "n_train", "n_test", "strength", "mix", "accuracy", "balanced", "coefficients", "drop_reason")
    many = {r["unit"]: r["n"] for r in own.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).collect()}
    found = [tuple(r[c] for c in columns) for u, n in sorted(many.items()) for r in summed.decode(own.filter(F.col("unit") == F.lit(u)), u, models, n, order is not None)]
    own = own.filter(~F.col("unit").isin(list(many))) if many else own
    folds = own.select("unit", F.col("f").alias("fold")).distinct().withColumn("model", F.explode(F.array(*map(F.lit, names))))
    schema = "unit string, model string, fold int, n_train long, n_test long, strength double, mix double, accuracy double, balanced double, coefficients array<double>, drop_reason string"
    out = own.join(folds, "unit").groupBy("unit", "model", "fold").applyInPandas(run, schema)
    return out.unionByName(rows.sparkSession.createDataFrame(found, schema)) if found else out


def hash_permutation(keys: list[str], seed: str) -> np.ndarray:
    """Places in the order of the digests of ``seed:key``."""
    start = hashlib.md5(f"{seed}:".encode())
    digests = []
    for key in keys:
        digest = start.copy()
        digest.update(key.encode())
        digests.append(digest.digest())
    return np.array(sorted(range(len(keys)), key=digests.__getitem__), int)


_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_WORDS = [(a * i + b) % 16 for a, b in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)


def _digests(blocks: np.ndarray) -> np.ndarray:
    """MD5 of messages of one padded block each, ``(message, 64)`` bytes, as two big-endian halves ``(message, 2)``."""
    w = np.ascontiguousarray(blocks.view("<u4").T)
    first = [np.full(w.shape[1], v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = first
    for i in range(64):
        mixed = _mixed(i // 16, b, c, d) + a + w[_WORDS[i]] + _SINES[i]
        turn = np.uint32(_TURNS[i])
        a, d, c, b = d, c, b, b + ((mixed << turn) | (mixed >> (np.uint32(32) - turn)))
    return np.stack([v + u for v, u in zip((a, b, c, d), first, strict=True)], 1).astype("<u4").view(">u8").astype(np.uint64)


def _mixed(part: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if part == 0:
        return d ^ (b & (c ^ d))
    if part == 1:
        return c ^ (d & (b ^ c))
    return b ^ c ^ d if part == 2 else c ^ (b | ~d)


def hash_permutations(keys: list[str], seeds: list[str]) -> list[np.ndarray]:
    """:func:`hash_permutation` for each seed, digests of many short keys at once."""
    coded, starts = [k.encode() for k in keys], [f"{s}:".encode() for s in seeds]
    if not coded or not starts or max(map(len, coded)) + max(map(len, starts)) > 55:
        return [hash_permutation(keys, s) for s in seeds]
    size = np.array([len(k) for k in coded])
    blocks = np.empty((len(starts), len(coded), 64), np.uint8)
    for begin in {len(s) for s in starts}:
        # starts of one length share where keys lie
        laid = np.zeros((len(coded), 64), np.uint8)
        for length in np.unique(size):
            at, n = np.flatnonzero(size == length), begin + int(length)
            laid[at, begin:n] = np.frombuffer(b"".join(coded[i] for i in at), np.uint8).reshape(len(at), length)
            laid[at, n], laid[at, 56], laid[at, 57] = 0x80, 8 * n % 256, 8 * n // 256
        own = [i for i, s in enumerate(starts) if len(s) == begin]
        blocks[own] = laid
        blocks[own, :, :begin] = np.frombuffer(b"".join(starts[i] for i in own), np.uint8).reshape(len(own), 1, begin)
    high, low = _digests(blocks.reshape(-1, 64)).reshape(len(starts), len(coded), 2).transpose(2, 0, 1)
    order = np.argsort(high, 1, kind="stable")
    ordered = np.take_along_axis(high, order, 1)
    same = (ordered[:, 1:] == ordered[:, :-1]).any(1)
    return [np.lexsort((low[i], high[i])) if same[i] else order[i] for i in range(len(starts))]


#: Rows of a condition of a unit beyond which they are not put in order in one task; rows in a task's memory, and in a stretch of digests.
_WINDOW, _HELD, _STRETCH = 20_000, 1 << 18, 1 << 17


def _shuffled_cells(laid: DataFrame, permutations: int, chunk: int, most: int) -> DataFrame:
    """Counts ``(unit, q, c, x, y, t)`` of features that meet labels in hash order, for cells (conditions of a unit) of any size.

    ``laid`` has ranges of ``o`` as its partitions ``p``, each cell in order.  A cell's digests go to tasks in stretches of equal digests' width, as packed numbers; the sizes of all
    stretches and of all runs of features say which features a stretch meets.  Inside a stretch digests are told apart by their next 64 bits (in all, two of a cell of ``n`` rows
    are alike in one of 2^48 / n cells).
    """
    bits = min(16, max(0, math.ceil(math.log2(most / _STRETCH))))
    stretches = 1 << bits
    cell = ["unit", "c"]

    def held(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, pd.DataFrame]]:
        """Runs of a cell's rows in order, by the number of what was held together."""
        frames, n, s = [], 0, 0
        for pdf in chain(parts, [None]):
            if pdf is not None:
                frames.append(pdf)
                n += len(pdf)
            if n and (pdf is None or n >= _HELD):
                every = pd.concat(frames, ignore_index=True)
                starts = starts_of(every["unit"].to_numpy(object), every["c"].to_numpy())
                for i, j in zip(starts, [*starts[1:], n], strict=True):
                    yield int(every["p"].iat[i]), s, every.iloc[i:j]
                frames, n, s = [], 0, s + 1

    def digests(run: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Each permutation's digests behind the bits of their stretch, the rows in the order of their stretches, and the ends of these."""
        keys = run["o"].tolist()
        for first in range(0, permutations, chunk):
            draws = range(first, min(first + chunk, permutations))
            for q, high, low in zip(draws, *leading_ten(keys, [str(q) for q in draws]), strict=True):
                at = (high >> np.uint64(48)).astype(np.uint16) >> np.uint16(16 - bits) if bits else np.zeros(len(high), np.uint16)
                ends = np.cumsum(np.bincount(at, minlength=stretches))
                yield q, np.argsort(at, kind="stable"), ends, high << np.uint64(bits) | (low.astype(np.uint64) >> np.uint64(16 - bits))

    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, s, run in held(parts):
            u, c = run["unit"].iat[0], run["c"].iat[0]
            out = [(u, c, -1, p, s, len(run))]
            for q, _, ends, _ in digests(run):
                out += [(u, c, q, b, 0, n) for b, n in enumerate(np.diff(ends, prepend=0).tolist()) if n]
            yield pd.DataFrame(out, columns=["unit", "c", "q", "b", "s", "n"])

    def coded(values: list) -> tuple[np.ndarray, list]:
        code, kinds = pd.factorize(np.array([*values, None], object)[:-1])
        return code.astype(np.uint8 if len(kinds) <= 256 else np.uint32), list(kinds)

    def runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, s, run in held(parts):
            code, kinds = coded([v.tobytes() for v in run["x"]])
            yield pd.DataFrame({"unit": [run["unit"].iat[0]], "c": [run["c"].iat[0]], "p": [p], "s": [s], "codes": [code.tobytes()], "width": [code.itemsize], "xs": [[np.frombuffer(k) for k in kinds]]})

    def sent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, run in held(parts):
            code, kinds = coded(run["y"].tolist())
            two = len(kinds) <= 2
            for q, rows, ends, digest in digests(run):
                out, digest, own = [], digest[rows], code[rows]
                for b, (i, j) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                    if j > i:
                        out.append((q, b, digest[i:j].tobytes(), (np.packbits(own[i:j]) if two else own[i:j]).tobytes(), 0 if two else own.itemsize))
                yield pd.DataFrame(out, columns=["q", "b", "digests", "codes", "width"]).assign(unit=run["unit"].iat[0], c=run["c"].iat[0], ys=[kinds] * len(out))

    def together(kinds: dict, part: pd.DataFrame, names: str, key: Callable, sizes: list) -> np.ndarray:
        out = []
        for codes, width, own, n in zip(part["codes"], part["width"], part[names], sizes, strict=True):
            numbers = np.array([kinds.setdefault(key(k), len(kinds)) for k in own], np.int64)
            out.append(numbers[np.unpackbits(np.frombuffer(codes, np.uint8), count=n) if width == 0 else np.frombuffer(codes, np.uint8 if width == 1 else np.uint32)])
        return np.concatenate(out)

    def met(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        moved = pdf["digests"].notna()
        still, moved, x_kinds, y_kinds = pdf[~moved].sort_values("at"), pdf[moved], {}, {}
        x = together(x_kinds, still, "xs", lambda k: np.asarray(k, float).tobytes(), [0] * len(still))
        y = together(y_kinds, moved, "ys", str, [len(v) // 8 for v in moved["digests"]])
        digests = np.frombuffer(b"".join(moved["digests"]), np.uint64)
        order = np.argsort(digests)
        if (np.diff(digests[order]) == 0).any():
            order = np.lexsort((y, digests))
        times = np.bincount(x * len(y_kinds) + y[order], minlength=len(x_kinds) * len(y_kinds)).reshape(len(x_kinds), -1)
        xs, ys = list(x_kinds), list(y_kinds)
        return pd.DataFrame([(key[0], key[2], key[1], np.frombuffer(xs[i]), ys[j], times[i, j]) for i, j in zip(*np.nonzero(times), strict=True)], columns=["unit", "q", "c", "x", "y", "t"])

    own = laid.select("unit", "c", "p", F.col("o").cast("string").alias("o"), "x", "y")
    sizes = own.select("unit", "c", "p", "o").mapInPandas(measured, "unit string, c int, q int, b int, s int, n long").groupBy("unit", "c", "q", "b", "s").agg(F.sum("n").alias("n"))
    starts = sizes.withColumn("low", F.sum("n").over(Window.partitionBy("unit", "c", "q").orderBy("b", "s")) - F.col("n"))  # a row for each stretch or run of a cell
    stretch = starts.filter("q >= 0").select("unit", "c", "q", "b", F.col("low").alias("from"), (F.col("low") + F.col("n")).alias("to"))
    run = starts.filter("q < 0").select("unit", "c", F.col("b").alias("p"), "s", "low", (F.col("low") + F.col("n")).alias("high"))
    cuts = stretch.join(run, cell).filter("from < high and low < to").select(
        "unit", "c", "q", "b", "p", "s", F.greatest("from", "low").alias("at"), (F.greatest("from", "low") - F.col("low")).alias("skip"), (F.least("to", "high") - F.greatest("from", "low")).alias("take")
    )
    features = own.select("unit", "c", "p", "x").mapInPandas(runs, "unit string, c int, p int, s int, codes binary, width int, xs array<array<double>>").hint("merge").join(cuts, ["unit", "c", "p", "s"])
    features = features.select("unit", "c", "q", "b", "at", F.expr("substring(codes, cast(skip * width + 1 as int), cast(take * width as int))").alias("codes"), "width", "xs")
    moved = own.select("unit", "c", "p", "o", "y").mapInPandas(sent, "unit string, c int, q int, b int, digests binary, codes binary, width int, ys array<string>")
    pieces = moved.unionByName(features, allowMissingColumns=True)
    return pieces.groupBy("unit", "c", "q", "b").applyInPandas(met, "unit string, q int, c int, x array<double>, y string, t long").groupBy("unit", "q", "c", "x", "y").agg(F.sum("t").alias("t")).withColumn("f", F.lit(0))


def cross_decode(rows: DataFrame, unit: str, label: str, features: str, condition: str, fold: str, order: str, models: tuple[Model, ...] = MODELS, permutations: int = 0, chunk: int = 20, window: int = _WINDOW) -> DataFrame:
    """Decoders trained in one condition (0 or 1) and tested in the other, both ways, beside their ceilings within each condition.

    A row for each unit and model: mean balanced accuracy across (``across``, ``from_0``, ``from_1``), ``ceiling_0`` and ``ceiling_1`` (mean over the condition's folds at the chosen
    grid point), the ``permutations`` tried and ``p`` with labels put in hash order within each condition, grid points kept.  Labels are put in
    order by Spark, ``chunk`` permutations to a shuffle of the rows (or, if a unit has more than ``window`` rows of a condition, in stretches of digests), and equal rows are counted before they are fitted.
    A condition without two classes gives null scores.
    """
    names = {m.name: m for m in models}

    def prepared(pdf: pd.DataFrame):
        pdf = pdf.iloc[sorted(range(len(pdf)), key=lambda i: (pdf["c"].iat[i], pdf["f"].iat[i], pdf["y"].iat[i], tuple(pdf["x"].iat[i])))]
        x, f, c, times = np.stack(pdf["x"].to_numpy()).astype(float), pdf["f"].to_numpy(), pdf["c"].to_numpy(), pdf["t"].to_numpy(float)
        classes, truth = np.unique(pdf["y"].to_numpy(), return_inverse=True)
        fine = all(len(np.unique(truth[c == side])) > 1 for side in (0, 1))
        return x, f, c, classes, truth, times, fine

    def across(model: Model, x: np.ndarray, c: np.ndarray, k: int, truth: np.ndarray, side: int, best: tuple, times: np.ndarray) -> float:
        train = c == side
        x, y = _scaled(x, train, times), np.eye(k)[truth]
        w = fits(model, x, y, train[None], [best], times)[0]
        return balanced_accuracy(truth[~train], predicted(w, x[~train], y[train].any(0)), times[~train])

    def observed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        model = names[key[1]]
        x, f, c, classes, truth, times, fine = prepared(pdf)
        out = {"unit": key[0], "model": key[1], "n": int(times.sum()), "across": None, "from_0": None, "from_1": None, "ceiling_0": None, "ceiling_1": None, "points": None}
        if fine:
            points = []
            for side in (0, 1):
                train = c == side
                best, score = _chosen(model, _scaled(x, train, times), np.eye(len(classes))[truth], truth, train, f, times)
                out |= {f"from_{side}": across(model, x, c, len(classes), truth, side, best, times), f"ceiling_{side}": score}
                points += best
            out |= {"across": (out["from_0"] + out["from_1"]) / 2, "points": points}
        return pd.DataFrame([out])[list(out)]

    def shuffled(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        model, points, seen = names[key[1]], pdf["points"].iloc[0], float(pdf["across"].iloc[0])
        x, _, c, classes, truth, times, _ = prepared(pdf)
        null = sum(across(model, x, c, len(classes), truth, side, tuple(points[2 * side : 2 * side + 2]), times) for side in (0, 1)) / 2
        return pd.DataFrame({"unit": [key[0]], "model": [key[1]], "more": [int(null >= seen - 1e-12)]})

    def drawn(own: DataFrame, first: int) -> DataFrame:
        """Rows of a chunk of permutations ``q``, counted: places are found, and rows of one place meet, where a condition's rows lie."""
        cell, draws = Window.partitionBy("unit", "c"), range(first, min(first + chunk, permutations))
        placed = own.withColumn("i", F.row_number().over(cell.orderBy("o")))
        for q in draws:
            placed = placed.withColumn(f"i{q}", F.row_number().over(cell.orderBy(F.md5(F.concat(F.lit(f"{q}:"), F.col("o").cast("string"))), "i")))
        still = F.struct("i", F.lit(-1).alias("q"), F.lit(None).cast("string").alias("y"), "x")
        moved = [F.struct(F.col(f"i{q}").alias("i"), F.lit(q).alias("q"), "y", F.lit(None).cast("array<double>").alias("x")) for q in draws]
        laid = placed.select("unit", "c", F.explode(F.array(still, *moved)).alias("z")).select("unit", "c", "z.*")
        met = laid.groupBy("unit", "c", "i").agg(F.max("x").alias("x"), *(F.max(F.when(F.col("q") == q, F.col("y"))).alias(f"y{q}") for q in draws))
        each = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"y{q}").alias("y")) for q in draws))).alias("z")
        return _counted(met.select("unit", "c", "x", each).select("unit", "c", "x", "z.q", "z.y"), "unit", "q", "c", "x", "y").withColumn("f", F.lit(0))

    share_package(rows.sparkSession)
    text = lambda c: F.col(c).cast("string")
    own = _own(rows, unit=text(unit), y=text(label), x=F.col(features).cast("array<double>"), f=F.col(fold).cast("int"), c=F.col(condition).cast("int"), o=F.col(order))
    model = F.explode(F.array(*map(F.lit, names)))
    schema = "unit string, model string, n long, across double, from_0 double, from_1 double, ceiling_0 double, ceiling_1 double, points array<double>"
    if permutations:
        # rows lie in ranges of their order, once for all that is done with them
        own = own.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "o").sortWithinPartitions("unit", "c", "o").withColumn("p", F.spark_partition_id()).persist()
    real = _counted(own, "unit", "y", "x", "f", "c").withColumn("model", model).groupBy("unit", "model").applyInPandas(observed, schema).persist()  # one row a unit and model
    if not permutations:
        return real.drop("points").withColumn("permutations", F.lit(0)).withColumn("p", F.lit(None).cast("double"))
    fine = real.filter("across is not null").select("unit", "model", "across", "points")
    most = own.groupBy("unit", "c").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    placed = _shuffled_cells(own, permutations, chunk, most) if most > window else reduce(DataFrame.unionByName, (drawn(own, first) for first in range(0, permutations, chunk)))
    tasks = placed.join(fine, "unit")
    null = tasks.groupBy("unit", "model", "q").applyInPandas(shuffled, "unit string, model string, more long").groupBy("unit", "model").agg(F.sum("more").alias("more"))
    return real.drop("points").join(null, ["unit", "model"], "left").withColumn("permutations", F.lit(permutations)).withColumn("p", (1 + F.col("more")) / F.lit(1 + permutations)).drop("more")
