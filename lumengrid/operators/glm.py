"""Penalised Poisson regression for many units in parallel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .tables import share_package, spread


def poisson_ridges(x: np.ndarray, y: np.ndarray, use: np.ndarray, alpha: np.ndarray, offset: np.ndarray, steps: int = 50) -> np.ndarray:
    """Coefficients, the intercept first, of many fits at once: fit ``b`` minimises ``sum(mu - y eta) + alpha_b/2 |w|^2`` over the rows that ``use[b]`` marks.

    ``x`` is ``(b or 1, rows, features)``.  Newton steps with halving, for all fits together; the intercept is free.
    """
    b, (_, n, p) = len(alpha), x.shape
    z = np.broadcast_to(np.concatenate([np.ones((len(x), n, 1)), x], 2), (b, n, p + 1))
    penalty = np.concatenate([np.zeros((b, 1)), np.repeat(alpha[:, None], p, 1)], 1)
    ridge = np.eye(p + 1) * (penalty + 1e-9)[:, :, None]
    w = np.zeros((b, p + 1))
    w[:, 0] = np.log(np.maximum(use @ y, 0.5) / (use @ np.exp(offset)))

    def line(v: np.ndarray) -> np.ndarray:
        return np.clip((z @ v[:, :, None])[:, :, 0] + offset, -20, 20)

    def loss(v: np.ndarray) -> np.ndarray:
        eta = line(v)
        return (use * (np.exp(eta) - y * eta)).sum(1) + 0.5 * (penalty * v * v).sum(1)

    now, live = loss(w), np.ones(b, bool)
    for _ in range(steps):
        mu = np.exp(line(w))
        back = z.transpose(0, 2, 1)
        grad = (back @ (use * (mu - y))[:, :, None])[:, :, 0] + penalty * w
        step = np.linalg.solve(back @ (z * (use * mu)[:, :, None]) + ridge, grad[:, :, None])[:, :, 0]
        size = live.astype(float)
        then = loss(w - size[:, None] * step)
        while (bad := (then > now) & (size > 1e-4)).any():
            size[bad] /= 2
            then = loss(w - size[:, None] * step)
        w, live, now = w - size[:, None] * step, live & (now - then >= 1e-10 * (1 + np.abs(then))), then
        if not live.any():
            break
    return w


def poisson_ridge(x: np.ndarray, y: np.ndarray, alpha: float, log_exposure: np.ndarray | None = None, steps: int = 50) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of one fit."""
    offset = np.zeros(len(x)) if log_exposure is None else log_exposure
    w = poisson_ridges(x[None], y, np.ones((1, len(x))), np.array([alpha], float), offset, steps)[0]
    return w[1:], float(w[0])


def log_likelihoods(x: np.ndarray, y: np.ndarray, w: np.ndarray, use: np.ndarray, offset: np.ndarray, constant: np.ndarray) -> np.ndarray:
    """Log likelihood of the rows that ``use`` marks, for each fit; ``constant`` is the log-gamma term of each row."""
    eta = np.clip((x @ w[:, 1:, None])[:, :, 0] + w[:, :1] + offset, -20, 20)
    return (use * (y * eta - np.exp(eta) - constant)).sum(1)


def _fold_scores(x, y, off, fold, alphas):
    """Held-out log-likelihood of the model with its inner choice of alpha, and of the mean rate; the alpha of the middle fold."""
    constant = np.array([math.lgamma(v + 1) for v in y])
    folds = np.unique(fold)
    inner = [(k, j, a) for k in folds for a in alphas for j in folds if j != k]
    use = np.array([(fold != k) & (fold != j) for k, j, _ in inner], float)
    w = poisson_ridges(x[None], y, use, np.array([a for *_, a in inner], float), off)
    held = log_likelihoods(x[None], y, w, np.array([fold == j for _, j, _ in inner], float), off, constant)
    chosen = np.array(alphas, float)[held.reshape(len(folds), len(alphas), -1).sum(2).argmax(1)]
    ll = _outer(x[None], y, off, fold, chosen, constant)[0]
    null = 0.0
    for k in folds:
        rate = max(y[fold != k].sum(), 0.5) / np.exp(off[fold != k]).sum()
        mu = rate * np.exp(off[fold == k])
        null += float((y[fold == k] * np.log(mu) - mu - constant[fold == k]).sum())
    return float(ll), null, float(np.median(chosen))


def _outer(x, y, off, fold, alpha, constant):
    """Held-out log likelihood over all folds for each design in ``x``; ``alpha`` by fold."""
    folds = np.unique(fold)
    test = np.array([fold == k for k in folds], float)
    many = np.repeat(x, len(folds), 0)
    tests = np.tile(test, (len(x), 1))
    w = poisson_ridges(many, y, 1 - tests, np.tile(alpha, len(x)), off)
    return log_likelihoods(many, y, w, tests, off, constant).reshape(len(x), -1).sum(1)


def encode_units(rows: DataFrame, unit: str, features: list[str], y: str, log_exposure: str, fold: str, order: str, alphas: tuple[float, ...] = (0.1, 1.0, 10.0), permutations: int = 20, least: int = 12) -> DataFrame:
    """One nested-cross-validated Poisson ridge per unit, with a circular-shift null.

    Features are standardised by unit (population deviation, constants to 0).  A unit's rows are one
    group in one task, as its fit needs them together (a recording: some thousand rows); units run in parallel,
    and all folds, alphas and shifts of a unit are fitted at once.  A unit with fewer than ``least`` rows has a ``drop_reason`` and no fit.
    ``p_perm`` is ``(1 + nulls at least as good) / (1 + permutations)``; ``r2`` is ``1 - ll / ll_null``.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[features].to_numpy(float)
        sd = x.std(0)
        x = (x - x.mean(0)) / np.where(sd > 0, sd, 1.0)
        y_, off, f = pdf[y].to_numpy(float), pdf[log_exposure].to_numpy(float), pdf[fold].to_numpy()
        if len(x) < least or len(np.unique(f)) < 3 or y_.std() == 0:
            reason = "too few rows" if len(x) < least else "too few folds or constant response"
            none = dict.fromkeys(columns, [None]) | {unit: [pdf[unit].iloc[0]], "n": [len(pdf)], "drop_reason": [reason]}
            return pd.DataFrame(none)
        ll, null, alpha = _fold_scores(x, y_, off, f, alphas)
        shifted = np.stack([np.roll(x, (k + 1) * len(x) // (permutations + 1), 0) for k in range(permutations)])
        constant = np.array([math.lgamma(v + 1) for v in y_])
        better = int((_outer(shifted, y_, off, f, np.full(len(np.unique(f)), alpha), constant) >= ll).sum())
        w, b = poisson_ridge(x, y_, alpha, off)
        return pd.DataFrame({
            unit: [pdf[unit].iloc[0]], "n": [len(pdf)], "ll": [ll], "ll_null": [null], "r2": [1 - ll / null if null < -0.1 else None], "alpha": [alpha],
            "p_perm": [(1 + better) / (1 + permutations)], "intercept": [b], "coefficients": [w.tolist()], "drop_reason": [None],
        })[columns]

    share_package(rows.sparkSession)
    columns = [unit, "n", "ll", "ll_null", "r2", "alpha", "p_perm", "intercept", "coefficients", "drop_reason"]
    schema = f"{unit} long, n long, ll double, ll_null double, r2 double, alpha double, p_perm double, intercept double, coefficients array<double>, drop_reason string"
    return spread(rows, unit).groupBy(unit).applyInPandas(fit, schema)
