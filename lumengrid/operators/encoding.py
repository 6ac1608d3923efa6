"""Encoding models of many units: penalised Poisson fits by batched Newton steps, penalties by inner folds in two stages, and refitted circular-shift nulls.

Fits of many units, folds, penalties or shifts move together, in batches of bounded size; a unit's fits share its design, as a shift turns the
responses instead.  A unit's observed fit is one task (its rows belong together: some thousand bins), which takes many units; its shifts are dealt to tasks in chunks.

Defined results: rows with a null in any column used are left out; a unit with fewer than ``least`` rows, fewer than three folds or a
constant response has a ``drop_reason`` and no numbers; features that are constant in a unit are 0.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import share_package, spread, starts_of, whole

#: Numbers of a design that are worked on at once.
CHUNK = 1 << 20
#: Coarse penalties; fine ones are laid over one decade on each side of the best of them.
COARSE = tuple(float(a) for a in np.logspace(-5, 3, 9))
FINE = 10
#: Rows whose units are worked on together.
ROWS = 10_000


@dataclass
class Sets:
    """Many data sets of equal length: designs ``(set, row, feature)``, counts, log exposures, and weights of rows (0 where a row is not used)."""

    x: np.ndarray
    y: np.ndarray
    offset: np.ndarray
    use: np.ndarray

    def parts(self, which: np.ndarray):
        """Slices of sets and rows of at most ``CHUNK`` numbers."""
        n, p = self.x.shape[1:]
        rows = max(1, min(n, CHUNK // max(p, 1)))
        sets = max(1, CHUNK // max(rows * p, 1))
        for i in range(0, len(which), sets):
            for j in range(0, n, rows):
                yield slice(i, i + sets), which[i : i + sets], slice(j, j + rows)


def quasi_ridges(sets: Sets, alpha: np.ndarray, start: np.ndarray | None = None, steps: int = 100) -> np.ndarray:
    """Coefficients, the intercept first, that minimise ``sum(use (mu - y eta)) + alpha/2 |w|^2`` for each set, by Newton steps that are halved until they lessen it; intercepts are free."""
    b, _, p = sets.x.shape
    if start is None:
        start = np.zeros((b, p + 1))
        start[:, 0] = np.log(np.maximum((sets.use * sets.y).sum(1), 0.5) / np.maximum((sets.use * np.exp(sets.offset)).sum(1), 1e-300))
    size = np.maximum((sets.use * sets.y).sum(1), 1.0)

    def derivatives(w: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        loss = 0.5 * alpha[which] * (w[:, 1:] ** 2).sum(1)
        slope = np.concatenate([np.zeros((len(w), 1)), alpha[which, None] * w[:, 1:]], 1)
        curve = np.zeros((len(w), p + 1, p + 1))
        curve[:, np.arange(1, p + 1), np.arange(1, p + 1)] = alpha[which, None]
        for at, own, rows in sets.parts(which):
            x, y, use = sets.x[own, rows], sets.y[own, rows], sets.use[own, rows]
            eta = np.clip((x @ w[at, 1:, None])[:, :, 0] + w[at, :1] + sets.offset[own, rows], -20, 20)
            mu = np.exp(eta)
            loss[at] += (use * (mu - y * eta)).sum(1)
            r, mu = use * (mu - y), use * mu
            slope[at, 0] += r.sum(1)
            slope[at, 1:] += (r[:, None, :] @ x)[:, 0]
            turned = x.transpose(0, 2, 1) * mu[:, None, :]
            curve[at, 0, 0] += mu.sum(1)
            side = turned.sum(2)
            curve[at, 0, 1:] += side
            curve[at, 1:, 0] += side
            curve[at, 1:, 1:] += turned @ x
        return loss / size[which], slope / size[which, None], curve / size[which, None, None]

    w, live = start.copy(), np.arange(b)
    if not b:
        return w
    f, g, h = derivatives(w, live)
    for _ in range(steps):
        # a direction without curvature has no slope either and is not gone
        d = np.linalg.solve(h + np.eye(p + 1) * (1e-10 * np.einsum("bii->bi", h).max(1) + 1e-300)[:, None, None], g[:, :, None])[:, :, 0]
        gain, near = (d * g).sum(1), np.abs(d).max(1) <= 1e-7 * (1 + np.abs(w[live]).max(1))
        # a step this small leaves an error of its square
        ends = near | (gain <= 1e-15 * (1 + np.abs(f)))
        w[live[near]] -= d[near]
        live, d, f, g, h, gain = (v[~ends] for v in (live, d, f, g, h, gain))
        if not len(live):
            break
        length, todo = np.ones(len(live)), np.arange(len(live))
        for _ in range(40):
            tried = w[live[todo]] - length[todo, None] * d[todo]
            value, slope, curve = derivatives(tried, live[todo])
            good = value <= f[todo] - 1e-4 * length[todo] * gain[todo] + 1e-14 * (1 + np.abs(f[todo]))
            at = todo[good]
            w[live[at]], f[at], g[at], h[at] = tried[good], value[good], slope[good], curve[good]
            todo = todo[~good]
            length[todo] *= 0.4
            if not len(todo):
                break
        if len(todo):
            live, f, g, h = (np.delete(v, todo, 0) for v in (live, f, g, h))
            if not len(live):
                break
    return w


def _solved(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Solutions of many small positive systems ``h (i, j, system)``, ``g (i, system)``, by Cholesky's steps taken for all of them together."""
    k = len(g)
    low, x = np.zeros_like(h), np.empty_like(g)
    for j in range(k):
        d = np.sqrt(h[j, j] - sum((low[j, m] ** 2 for m in range(j)), 0.0))
        low[j, j] = d
        for i in range(j + 1, k):
            low[i, j] = (h[i, j] - sum((low[i, m] * low[j, m] for m in range(j)), 0.0)) / d
    for i in range(k):
        x[i] = (g[i] - sum((low[i, m] * x[m] for m in range(i)), 0.0)) / low[i, i]
    for i in reversed(range(k)):
        x[i] = (x[i] - sum((low[m, i] * x[m] for m in range(i + 1, k)), 0.0)) / low[i, i]
    return x


def shared_ridges(x: np.ndarray, y: np.ndarray, offset: np.ndarray, use: np.ndarray, alpha: np.ndarray, steps: int = 30) -> np.ndarray:
    """:func:`quasi_ridges` of many fits for each of many units, whose fits share its design: ``x (unit, row, feature)``, ``y``, ``offset`` and ``use (unit, fit, row)``, ``alpha (unit, fit)``.

    Slopes and curvatures of a unit's fits are then products of whole matrices.  The last axis holds fits; those that whole steps do not bring to rest are left to :func:`quasi_ridges`.
    """
    units, fits, n = use.shape
    p = x.shape[2]
    z = np.concatenate([np.ones((units, n, 1)), x], 2)
    i, j = np.triu_indices(p + 1)
    pairs = z[:, :, i] * z[:, :, j]
    counts = use * y
    size = np.maximum(counts.sum(2), 1.0)
    w = np.zeros((units, fits, p + 1))
    w[:, :, 0] = np.log(np.maximum(counts.sum(2), 0.5) / np.maximum((use * np.exp(offset)).sum(2), 1e-300))
    target = counts @ z
    penalty = np.zeros((units, fits, p + 1))
    penalty[:, :, 1:] = alpha[:, :, None]
    plain = not offset.any()
    done, todo, last = np.zeros((units, fits), bool), np.arange(units), np.full((units, fits), np.inf)
    h = np.empty((p + 1, p + 1, 0))
    for _ in range(steps):
        eta = w[todo] @ z[todo].transpose(0, 2, 1)
        if not plain:
            eta += offset[todo]
        np.clip(eta, -20, 20, out=eta)
        mu = np.exp(eta)
        mu *= use[todo]
        g = (mu @ z[todo] - target[todo] + penalty[todo] * w[todo]) / size[todo, :, None]
        loss = (mu.sum(2) - np.einsum("ufn,ufn->uf", counts[todo], eta) + 0.5 * (penalty[todo] * w[todo] ** 2).sum(2)) / size[todo]
        flat = (mu @ pairs[todo]) / size[todo, :, None]
        h = np.empty((p + 1, p + 1, len(todo), fits))
        h[i, j] = h[j, i] = flat.transpose(2, 0, 1)
        for k in range(1, p + 1):
            h[k, k] += alpha[todo] / size[todo]
        ridge = 1e-10 * h[np.arange(p + 1), np.arange(p + 1)].max(0) + 1e-300
        for k in range(p + 1):
            h[k, k] += ridge
        with np.errstate(invalid="ignore", divide="ignore"):
            d = _solved(h, np.ascontiguousarray(g.transpose(2, 0, 1))).transpose(1, 2, 0)
        fine = np.isfinite(d).all(2)
        # a step that did not lessen the loss is not one to go on from
        fine &= loss <= last[todo] + 1e-14 * (1 + np.abs(loss))
        near = fine & (np.abs(d).max(2) <= 1e-7 * (1 + np.abs(w[todo]).max(2)))
        small = fine & ((d * g).sum(2) <= 1e-15 * (1 + np.abs(loss)))
        before = done[todo]
        w[todo] -= np.where((fine & ~before)[:, :, None], d, 0.0)
        last[todo] = np.where(fine, loss, -np.inf)
        done[todo] = before | near | small
        # fits without a step stay as they are and are taken up below
        stuck = np.isneginf(last[todo])
        todo = todo[~(done[todo] | stuck).all(1)]
        if not len(todo):
            break
    for u in np.flatnonzero(~done.all(1)):
        f = np.flatnonzero(~done[u])
        sets = Sets(np.broadcast_to(x[u], (len(f), n, p)), y[u, f], offset[u, f], use[u, f])
        w[u, f] = quasi_ridges(sets, alpha[u, f])
    return w


def held_out(sets: Sets, w: np.ndarray, test: np.ndarray, constant: np.ndarray) -> np.ndarray:
    """Log likelihood of the rows that ``test`` marks, for each set; ``constant`` is the log-gamma term of each row."""
    out = np.zeros(len(w))
    for at, own, rows in sets.parts(np.arange(len(w))):
        eta = np.clip((sets.x[own, rows] @ w[at, 1:, None])[:, :, 0] + w[at, :1] + sets.offset[own, rows], -20, 20)
        out[at] += (test[own, rows] * (sets.y[own, rows] * eta - np.exp(eta) - constant[own, rows])).sum(1)
    return out


def timescale(y: np.ndarray) -> int:
    """The first lag at which the autocovariance is negative, at most half of the length."""
    d, half = y - y.mean(), len(y) // 2
    return next((k for k in range(1, half + 1) if (d[k:] * d[:-k]).sum() < -1e-9), half)


def shift_of(seed: str, unit, i: int, n: int, folds: int, tau: int) -> int:
    """Lag of the ``i``-th circular shift: drawn by hash from those no nearer to none than the timescale and half a fold."""
    low = max(tau, n // (2 * folds), 1)
    high = n - low
    if high <= low:
        return max(1, n // 2)
    return low + int(hashlib.md5(f"{seed}:{unit}:{i}".encode()).hexdigest()[:7], 16) % (high - low)


class Unit:
    """The rows of one unit in order, standardised, with their folds."""

    def __init__(self, pdf: pd.DataFrame, features: list[str]) -> None:
        pdf = pdf.sort_values("_o")
        self.take(pdf[features].to_numpy(float), pdf["_y"].to_numpy(float), pdf["_e"].to_numpy(float), pdf["_f"].to_numpy())

    def take(self, x: np.ndarray, y: np.ndarray, offset: np.ndarray, fold: np.ndarray) -> Unit:
        sd = x.std(0)
        self.x = (x - x.mean(0)) / np.where(sd > 1e-12, sd, 1.0)
        self.y, self.offset, self.fold, self.folds = y, offset, fold, np.unique(fold)
        self.constant = np.array([math.lgamma(v + 1) for v in y])
        return self

    @classmethod
    def all_of(cls, pdf: pd.DataFrame, features: list[str], *keys: str) -> Iterator[tuple[int, Unit]]:
        """The units of a frame whose rows lie unit by unit and in order, with the place of each one's first row."""
        x, y, offset, fold = pdf[features].to_numpy(float), pdf["_y"].to_numpy(float), pdf["_e"].to_numpy(float), pdf["_f"].to_numpy()
        starts = starts_of(*(pdf[k].to_numpy() for k in keys))
        for i, j in zip(starts, [*starts[1:], len(pdf)], strict=True):
            yield int(i), cls.__new__(cls).take(x[i:j], y[i:j], offset[i:j], fold[i:j])

    def sets(self, use: np.ndarray, x: np.ndarray | None = None) -> Sets:
        b, n = use.shape
        wide = lambda v: np.broadcast_to(v, (b, n))
        return Sets(np.broadcast_to(self.x[None], (b, *self.x.shape)) if x is None else x, wide(self.y), wide(self.offset), use)

    def chosen(self, grid: tuple[float, ...] | None) -> np.ndarray:
        """The penalty of each outer fold, by held-out likelihood over the other folds; in two stages without a grid."""
        pairs = [(k, j) for k in self.folds for j in self.folds if j != k]
        use = np.array([(self.fold != k) & (self.fold != j) for k, j in pairs], float)
        test = np.array([self.fold == j for _, j in pairs], float)
        sets = self.sets(use)
        constant = np.broadcast_to(self.constant, use.shape)

        def best(alphas: np.ndarray) -> np.ndarray:
            """The best of each fold's row of ``alphas``, strongest first."""
            w, score = None, []
            for a in alphas.T:
                w = quasi_ridges(sets, np.repeat(a, len(self.folds) - 1), w)
                score.append(held_out(sets, w, test, constant).reshape(len(self.folds), -1).sum(1))
            return alphas[np.arange(len(self.folds)), np.argmax(score, 0)]

        coarse = best(np.tile(np.sort(grid or COARSE)[::-1], (len(self.folds), 1)))
        if grid:
            return coarse
        return best(coarse[:, None] * np.logspace(1, -1, FINE)[None])

    def likelihood(self, alpha: np.ndarray, lags: list[int]) -> np.ndarray:
        """Held-out log likelihood over all folds, refitted with the design turned by each lag."""
        test = np.tile(np.array([self.fold == k for k in self.folds], float), (len(lags), 1))
        x = np.repeat(np.stack([np.roll(self.x, lag, 0) for lag in lags]), len(self.folds), 0)
        sets = self.sets(1 - test, x)
        w = quasi_ridges(sets, np.tile(alpha, len(lags)))
        return held_out(sets, w, test, np.broadcast_to(self.constant, test.shape)).reshape(len(lags), -1).sum(1)

    def null(self) -> float:
        out = 0.0
        for k in self.folds:
            at = self.fold == k
            mu = max(self.y[~at].sum(), 0.5) / np.exp(self.offset[~at]).sum() * np.exp(self.offset[at])
            out += float((self.y[at] * np.log(mu) - mu - self.constant[at]).sum())
        return out


class Units:
    """Units of nearly equal length whose fits move together: rows of :class:`Unit` side by side, filled up with rows that nothing uses."""

    def __init__(self, units: list[Unit]) -> None:
        self.units, self.longest, self.most = units, max(len(u.y) for u in units), max(len(u.folds) for u in units)
        self.x = np.zeros((len(units), self.longest, units[0].x.shape[1]))
        self.lengths = np.array([len(u.y) for u in units])
        for i, u in enumerate(units):
            self.x[i, : len(u.y)] = u.x

    def _laid(self, fits: int) -> np.ndarray:
        return np.zeros((len(self.units), fits, self.longest))

    def chosen(self, grid: tuple[float, ...] | None) -> list[np.ndarray]:
        """:meth:`Unit.chosen` of each unit; all inner folds and penalties at once."""
        k = self.most
        use, test = self._laid(k * (k - 1)), self._laid(k * (k - 1))
        for i, u in enumerate(self.units):
            for m, a in enumerate(u.folds):
                for f, b in enumerate((b for b in u.folds if b != a), m * (k - 1)):
                    use[i, f, : len(u.y)], test[i, f, : len(u.y)] = (u.fold != a) & (u.fold != b), u.fold == b

        def best(alphas: np.ndarray) -> np.ndarray:
            """The best of each row of ``alphas (unit, fold, penalty)``, strongest first."""
            tries = alphas.shape[2]
            score = self._held(use, test, np.repeat(np.arange(k * (k - 1)), tries), np.repeat(alphas, k - 1, 1).reshape(len(alphas), -1))
            score = score.reshape(len(alphas), k, k - 1, tries).sum(2)
            return np.take_along_axis(alphas, np.argmax(score, 2)[:, :, None], 2)[:, :, 0]

        strongest = np.sort(grid or COARSE)[::-1]
        coarse = best(np.broadcast_to(strongest, (len(self.units), k, len(strongest))))
        fine = coarse if grid else best(coarse[:, :, None] * np.logspace(1, -1, FINE))
        return [f[: len(u.folds)] for f, u in zip(fine, self.units, strict=True)]

    def _held(self, use: np.ndarray, test: np.ndarray, which: np.ndarray, alpha: np.ndarray, lags: list[np.ndarray] | None = None) -> np.ndarray:
        """Held-out log likelihood of fits to the rows that ``use[:, which]`` marks; with ``lags`` of each fit's design against its responses."""
        y, offset, constant = self._laid(1), self._laid(1), self._laid(1)
        for i, u in enumerate(self.units):
            y[i, 0, : len(u.y)], offset[i, 0, : len(u.y)], constant[i, 0, : len(u.y)] = u.y, u.offset, u.constant
        out, step = np.empty(alpha.shape), max(1, CHUNK // (self.longest * len(self.units)))
        for low in range(0, len(which), step):
            fits = slice(low, low + step)
            own = [np.broadcast_to(v, (len(v), len(which[fits]), self.longest)) for v in (y, offset, constant)] + [v[:, which[fits]] for v in (use, test)]
            if lags is not None:
                # turning the design by a lag is turning all else back by it, so that fits go on sharing one design
                at = np.empty(own[0].shape, np.int64)
                at[:] = np.arange(self.longest)
                for i, u in enumerate(self.units):
                    at[i, :, : len(u.y)] = (np.arange(len(u.y)) + lags[i][fits, None]) % len(u.y)
                own = [np.take_along_axis(v, at, 2) for v in own]
            counts, exposed, log_gamma, used, tested = own
            w = shared_ridges(self.x, counts, exposed, used, alpha[:, fits])
            eta = np.clip(w[:, :, 1:] @ self.x.transpose(0, 2, 1) + w[:, :, :1] + exposed, -20, 20)
            out[:, fits] = (tested * (counts * eta - np.exp(eta) - log_gamma)).sum(2)
        return out

    def likelihood(self, alphas: list[np.ndarray], lags: list[list[int]]) -> np.ndarray:
        """:meth:`Unit.likelihood` of each unit, ``(unit, lag)``."""
        k, draws = self.most, len(lags[0])
        test, use, alpha = self._laid(k), self._laid(k), np.ones((len(self.units), k))
        for i, u in enumerate(self.units):
            for f, fold in enumerate(u.folds):
                test[i, f, : len(u.y)], use[i, f, : len(u.y)] = u.fold == fold, u.fold != fold
            alpha[i, : len(u.folds)] = alphas[i]
        turned = [np.repeat(v, k) for v in lags]
        return self._held(use, test, np.tile(np.arange(k), draws), np.tile(alpha, (1, draws)), turned).reshape(len(self.units), draws, k).sum(2)

    def coefficients(self, alpha: np.ndarray) -> np.ndarray:
        """Fits to all rows, intercepts first."""
        y, offset, use = self._laid(1), self._laid(1), self._laid(1)
        for i, u in enumerate(self.units):
            y[i, 0, : len(u.y)], offset[i, 0, : len(u.y)], use[i, 0, : len(u.y)] = u.y, u.offset, 1.0
        return shared_ridges(self.x, y, offset, use, alpha[:, None])[:, 0]


def together(units: list[Unit], fits: int) -> Iterator[Units]:
    """Units by length, as many at once as have ``CHUNK`` numbers in ``fits`` fits."""
    units, at = sorted(units, key=lambda u: len(u.y)), 0
    while at < len(units):
        end = at + 1
        while end < len(units) and (end + 1 - at) * fits * len(units[end].y) <= CHUNK // 4:
            end += 1
        yield Units(units[at:end])
        at = end


def encode(rows: DataFrame, unit: str, features: list[str], y: str, log_exposure: str, fold: str, order: str, grid: tuple[float, ...] | None = None, permutations: int = 100, chunk: int = 50, least: int = 12, seed: str = "m16") -> DataFrame:
    """One row a unit: ``(unit, n, tau, ll, ll_null, r2, alpha, permutations, p_perm, intercept, coefficients, drop_reason)``.

    ``grid``: penalties, or two stages if none.  ``alpha`` is the median over folds; ``p_perm`` is ``(1 + shifts at least as good) / (1 + shifts)``, refitted with the penalties kept; ``r2`` is ``1 - ll / ll_null``.
    """

    def observed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole(parts, ["unit"], ROWS):
            out, fitted = [], {}
            for i, u in Unit.all_of(pdf, features, "unit"):
                out.append(dict.fromkeys(columns) | {"unit": pdf["unit"].iat[i], "n": len(u.y)})
                if len(u.y) < least or len(u.folds) < 3 or u.y.std() == 0:
                    out[-1]["drop_reason"] = "too few rows" if len(u.y) < least else "too few folds or constant response"
                else:
                    fitted[id(u)] = u, out[-1]
            for some in together([u for u, _ in fitted.values()], 6 * FINE):
                alphas = some.chosen(grid) if grid is None or len(grid) > 1 else [np.full(len(u.folds), grid[0]) for u in some.units]
                middle = np.array([np.median(a) for a in alphas])
                found = zip(some.units, alphas, some.likelihood(alphas, [np.zeros(1, np.int64)] * len(alphas))[:, 0].tolist(), middle.tolist(), some.coefficients(middle).tolist(), strict=True)
                for u, alpha, ll, a, w in found:
                    null = u.null()
                    fitted[id(u)][1].update({"tau": timescale(u.y), "ll": ll, "ll_null": null, "r2": 1 - ll / null if null < -0.1 else None, "alpha": a, "alphas": alpha.tolist(), "intercept": w[0], "coefficients": w[1:]})
            yield pd.DataFrame(out, columns=columns)

    def shifted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole(parts, ["unit", "first"], ROWS):
            own, out = {}, []
            for i, u in Unit.all_of(pdf, features, "unit", "first"):
                name, first = pdf["unit"].iat[i], int(pdf["first"].iat[i])
                lags = [shift_of(seed, name, k, len(u.y), len(u.folds), int(pdf["tau"].iat[i])) for k in range(first, min(first + chunk, permutations))]
                own[id(u)] = u, name, float(pdf["ll"].iat[i]), np.array(pdf["alphas"].iat[i], float), np.array(lags)
            # the last chunk of a unit may be shorter
            for draws in sorted({len(v[-1]) for v in own.values()}):
                for some in together([u for u, *_, lags in own.values() if len(lags) == draws], 4 * draws):
                    found = some.likelihood([own[id(u)][3] for u in some.units], [own[id(u)][4] for u in some.units])
                    for u, like in zip(some.units, found, strict=True):
                        _, name, ll, *_ = own[id(u)]
                        out.append((name, int((like >= ll - 1e-7 * (1 + abs(ll))).sum())))
            yield pd.DataFrame(out, columns=["unit", "better"])

    kinds = {"unit": "string", "n": "long", "tau": "int", "ll": "double", "ll_null": "double", "r2": "double", "alpha": "double", "alphas": "array<double>", "intercept": "double", "coefficients": "array<double>", "drop_reason": "string"}
    columns = list(kinds)
    share_package(rows.sparkSession)
    own = rows.select(F.col(unit).cast("string").alias("unit"), *(F.col(c).cast("double").alias(c) for c in features), F.col(y).alias("_y"), F.col(log_exposure).alias("_e"), F.col(fold).alias("_f"), F.col(order).alias("_o")).dropna()
    real = spread(own, "unit").sortWithinPartitions("unit", "_o").mapInPandas(observed, ", ".join(f"{k} {v}" for k, v in kinds.items())).persist()  # one row a unit
    first = F.explode(F.sequence(F.lit(0), F.lit(permutations - 1), F.lit(chunk)))
    tasks = own.join(real.filter("ll is not null").select("unit", "ll", "tau", "alphas"), "unit").withColumn("first", first)
    null = spread(tasks, "unit", "first").sortWithinPartitions("unit", "first", "_o").mapInPandas(shifted, "unit string, better long").groupBy("unit").agg(F.sum("better").alias("better"))
    out = real.drop("alphas").join(null, "unit", "left").withColumn("permutations", F.when(F.col("ll").isNotNull(), F.lit(permutations))).withColumn("p_perm", (1 + F.col("better")) / (1 + F.col("permutations")))
    return out.select("unit", "n", "tau", "ll", "ll_null", "r2", "alpha", "permutations", "p_perm", "intercept", "coefficients", "drop_reason")
