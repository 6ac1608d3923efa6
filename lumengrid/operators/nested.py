"""Nested Poisson models of each unit, compared on held-out rows and by draws from the smaller one.

Models are lists of feature columns, each within the next: ``null``, ``reduced`` and ``full``.  Held-out likelihoods take penalties by inner folds.
The bootstrap draws counts from the reduced fit, refits both models to each draw with their penalties kept, and compares twice their gain in
likelihood; draws are dealt to tasks in chunks and follow from a digest of unit and draw.

Defined results: as in :mod:`.encoding`; a unit without three folds, with too few rows or a constant response has a ``drop_reason``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import Sets, Unit, held_out, quasi_ridges
from .tables import share_package, spread


#: Log likelihoods nearer than this count as equal.
CLOSE = 1e-6


@dataclass(frozen=True)
class Models:
    null: tuple[str, ...]
    reduced: tuple[str, ...]
    full: tuple[str, ...]


def _own(rows: DataFrame, unit: str, models: Models, y: str, fold: str, order: str) -> DataFrame:
    features = sorted({*models.null, *models.reduced, *models.full})
    return rows.select(F.col(unit).cast("string").alias("unit"), *(F.col(c).cast("double").alias(c) for c in features), F.col(y).cast("double").alias("_y"), F.lit(0.0).alias("_e"), F.col(fold).alias("_f"), F.col(order).alias("_o")).dropna()


def _too_small(u: Unit, least: int) -> str | None:
    if len(u.y) < least:
        return "too few rows"
    return "too few folds or constant response" if len(u.folds) < 3 or u.y.std() == 0 else None


def _penalties(u: Unit, grid: tuple[float, ...] | None) -> np.ndarray:
    return np.full(len(u.folds), grid[0]) if grid and len(grid) == 1 or not u.x.shape[1] else u.chosen(grid)


def compare(rows: DataFrame, unit: str, models: Models, y: str, fold: str, order: str, grid: tuple[float, ...] | None = None, least: int = 12) -> DataFrame:
    """``(unit, n, ll_null, ll_reduced, ll_full, gain, interaction, positive_folds, interaction_folds, drop_reason)``; the last two numbers are shares of folds in which the full model beats the null and the reduced one."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = dict.fromkeys(columns) | {"unit": key[0], "n": len(pdf)}
        units = [Unit(pdf, list(m)) for m in (models.null, models.reduced, models.full)]
        out["drop_reason"] = _too_small(units[0], least)
        if out["drop_reason"] is None:
            folds = []
            for u in units:
                test = np.array([u.fold == k for k in u.folds], float)
                sets = u.sets(1 - test)
                folds.append(held_out(sets, quasi_ridges(sets, _penalties(u, grid)), test, np.broadcast_to(u.constant, test.shape)))
            null, reduced, full = (float(f.sum()) for f in folds)
            out |= {"ll_null": null, "ll_reduced": reduced, "ll_full": full, "gain": full - null, "interaction": full - reduced, "positive_folds": float((folds[2] > folds[0] + CLOSE).mean()), "interaction_folds": float((folds[2] > folds[1] + CLOSE).mean())}
        return pd.DataFrame([out])[columns]

    columns = ["unit", "n", "ll_null", "ll_reduced", "ll_full", "gain", "interaction", "positive_folds", "interaction_folds", "drop_reason"]
    share_package(rows.sparkSession)
    return spread(_own(rows, unit, models, y, fold, order), "unit").groupBy("unit").applyInPandas(run, "unit string, n long, " + ", ".join(f"{c} double" for c in columns[2:-1]) + ", drop_reason string")


def _gain(reduced: Unit, full: Unit, y: np.ndarray, alpha: tuple[float, float]) -> np.ndarray:
    """Twice the gain in likelihood for each row of ``y`` (draws)."""
    ll = []
    for u, a in zip((reduced, full), alpha, strict=True):
        use = np.ones(y.shape)
        sets = Sets(np.broadcast_to(u.x[None], (len(y), *u.x.shape)), y, np.zeros(y.shape), use)
        ll.append(held_out(sets, quasi_ridges(sets, np.full(len(y), a)), use, np.zeros(y.shape)))
    return 2 * (ll[1] - ll[0])


def bootstrap(rows: DataFrame, unit: str, models: Models, y: str, fold: str, order: str, alpha: tuple[float, float] = (1e-3, 1e-3), draws: int = 200, chunk: int = 100, least: int = 12, seed: str = "n17") -> DataFrame:
    """``(unit, deviance, draws, p)``: the gain of the full over the reduced model (penalties ``alpha`` of reduced and full), and the share of draws from the reduced fit with no less of it."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, first = key
        reduced, full = Unit(pdf, list(models.reduced)), Unit(pdf, list(models.full))
        if _too_small(reduced, least):
            return pd.DataFrame({"unit": [name], "deviance": [None], "more": [0]})
        seen = _gain(reduced, full, reduced.y[None], alpha)[0]
        w = quasi_ridges(reduced.sets(np.ones((1, len(pdf)))), np.array([alpha[0]]))[0]
        mu = np.exp(np.clip(reduced.x @ w[1:] + w[0], -20, 13))
        drawn = [np.random.default_rng(int(hashlib.md5(f"{seed}:{name}:{i}".encode()).hexdigest()[:15], 16)).poisson(mu) for i in range(first, min(first + chunk, draws))]
        more = _gain(reduced, full, np.array(drawn, float), alpha) >= seen - 1e-7
        return pd.DataFrame({"unit": [name], "deviance": [float(seen)], "more": [int(more.sum())]})

    share_package(rows.sparkSession)
    tasks = _own(rows, unit, models, y, fold, order).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(chunk))))
    out = spread(tasks, "unit", "first").groupBy("unit", "first").applyInPandas(run, "unit string, deviance double, more long").groupBy("unit").agg(F.first("deviance").alias("deviance"), F.sum("more").alias("more"))
    seen = F.col("deviance").isNotNull()
    return out.select("unit", "deviance", F.when(seen, F.lit(draws)).alias("draws"), F.when(seen, (1 + F.col("more")) / (1 + F.lit(draws))).alias("p"))
