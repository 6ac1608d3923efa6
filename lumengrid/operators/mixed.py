"""Crossed random effects by (restricted) maximum likelihood, from sums per level.

``y = X beta + a level of a small factor + a level of a large factor + error``.  For a given ratio of variances the large factor is
eliminated level by level: a level with ``n`` rows and sums ``a`` lessens the sums of products by ``a a' / (n + ratio)``.
So one pass over the large factor's levels (one vector each) gives the equations of fixed effects and the small factor for many ratios
at once, and the driver holds matrices as wide as these, whatever the number of rows or levels.
The ratio of the large factor is found by narrowing a bracket of such passes, that of the small one within them.

Defined results: rows with a null factor, response or fixed effect are left out; variances on the boundary are 0;
no rows, or one level or fewer of a factor, raise ``ValueError``; so does a small factor of more than ``LEVELS`` levels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import weighted_moments

#: Levels that the small factor may have.
LEVELS = 500
#: Logarithms of the ratios of error to effect variance between which they are sought; at the upper end the effect counts as none.
LOW, HIGH = -16.0, 20.0


@dataclass
class Fit:
    """``blups``: predicted deviation of each level of the small factor; ``deviance``: -2 log (restricted) likelihood."""

    n: int
    beta: np.ndarray
    small_variance: float
    large_variance: float
    error_variance: float
    blups: dict
    deviance: float


@dataclass
class _Sums:
    n: int
    fixed: int
    levels: list
    large: int
    products: np.ndarray  # of fixed effects, small levels and response


def _inner(s: _Sums, lessened: np.ndarray, log_det: float, log_ratio: float, reml: bool, small: bool) -> Fit:
    """The best fit for one ratio of the large factor."""
    p, c = s.fixed, len(s.levels) if small else 0
    keep = [*range(p + c), len(lessened) - 1]
    m = (s.products - lessened)[np.ix_(keep, keep)]
    free = s.n - p if reml else s.n

    def at(log_small: float) -> tuple[float, np.ndarray, float]:
        a = m[:-1, :-1].copy()
        a[range(p, p + c), range(p, p + c)] += math.exp(log_small)
        solved = np.linalg.solve(a, m[:-1, -1])
        q = max(m[-1, -1] - m[:-1, -1] @ solved, 1e-300)
        det = np.linalg.slogdet(a)[1] if reml else (np.linalg.slogdet(a[p:, p:])[1] if c else 0.0)
        # the likelihood for the error variance that suits the ratios best
        return free * (math.log(q / free) + 1 + math.log(2 * math.pi)) + det + log_det - c * log_small - s.large * log_ratio, solved, q / free

    best = HIGH
    if c:
        grid = np.linspace(LOW, HIGH, 37)
        for _ in range(11):
            best = float(min(grid, key=lambda t: at(t)[0]))
            step = (grid[1] - grid[0]) * 1.0
            grid = np.clip(np.linspace(best - step, best + step, 13), LOW, HIGH)
    deviance, solved, error = at(best)
    variance = lambda t: 0.0 if t > HIGH - 1 else error * math.exp(-t)
    return Fit(s.n, solved[:p], variance(best) if c else 0.0, variance(log_ratio), error, dict(zip(s.levels, solved[p:].tolist(), strict=False)), deviance)


def crossed_effects(df: DataFrame, y: str, fixed: list[str], small: str, large: str, reml: bool = True, with_small: bool = True) -> Fit:
    """Fits an intercept, the ``fixed`` columns and both factors; without the small factor's effect if not ``with_small``."""
    x = ["_one", *fixed]
    rows = df.withColumn("_one", F.lit(1.0)).select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)), F.col(y).cast("double").alias("y"), F.col(small).alias("c"), F.col(large).alias("u")).dropna()
    names = [f"x{i}" for i in range(len(x))]
    per = rows.groupBy("c").agg(*(F.sum(v).alias(v) for v in (*names, "y"))).limit(LEVELS + 1).collect()
    if len(per) > LEVELS:
        raise ValueError(f"the small factor has more than {LEVELS} levels")
    levels = sorted(r.c for r in per)
    if len(levels) < 2:
        raise ValueError("a factor needs two levels")
    p, q = len(x), len(x) + len(levels) + 1
    # sums of all levels of the large factor, a vector each
    one_of = [F.sum(F.when(F.col("c") == v, 1.0).otherwise(0.0)) for v in levels]
    units = rows.groupBy("u").agg(F.array(*(F.sum(v) for v in names), *one_of, F.sum("y")).alias("v")).persist()
    try:
        large_levels = units.count()
        if large_levels < 2:
            raise ValueError("a factor needs two levels")
        products = np.zeros((q, q))
        whole = [*names, "y"]
        pairs = [(a, b) for i, a in enumerate(whole) for b in whole[i:]]
        total = rows.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs)).first()
        place = {v: i if v != "y" else q - 1 for i, v in enumerate(whole)}
        for a, b in pairs:
            products[place[a], place[b]] = products[place[b], place[a]] = total[f"{a}_{b}"]
        for r in per:
            k = p + levels.index(r.c)
            products[k, k] = r.x0
            for v in whole:
                products[k, place[v]] = products[place[v], k] = r[v]
        sums = _Sums(int(total["x0_x0"]), p, levels, large_levels, products)

        def tried(grid: np.ndarray) -> list[Fit]:
            """One pass for all ratios of the grid."""
            n = F.get("v", F.lit(0))
            ratios = [float(math.exp(t)) for t in grid]
            weighted = units.select("v", F.array(*(1 / (n + r) for r in ratios)).alias("w"))
            found = weighted_moments(weighted, "v", q, "w", len(grid))
            dets = units.agg(*(F.sum(F.ln(n + r)).alias(str(i)) for i, r in enumerate(ratios))).first()
            return [_inner(sums, m.products, dets[i], float(t), reml, with_small) for i, (t, m) in enumerate(zip(grid, found, strict=True))]

        grid, best = np.linspace(LOW, HIGH, 37), None
        for _ in range(8):
            fits = tried(grid)
            i = min(range(len(grid)), key=lambda k: fits[k].deviance)
            best, step = fits[i], grid[1] - grid[0]
            grid = np.clip(np.linspace(grid[i] - step, grid[i] + step, 25), LOW, HIGH)
        return best
    finally:
        units.unpersist()


def small_factor_test(df: DataFrame, y: str, fixed: list[str], small: str, large: str) -> tuple[float, float]:
    """Likelihood ratio of the small factor's variance, and its p: without the effect the variance lies on the boundary, so half of the law is at 0."""
    whole = crossed_effects(df, y, fixed, small, large, reml=False)
    without = crossed_effects(df, y, fixed, small, large, reml=False, with_small=False)
    ratio = max(0.0, without.deviance - whole.deviance)
    return ratio, 0.5 * math.erfc(math.sqrt(ratio / 2))
