"""Per-unit fits from sums alone: Poisson rates by reweighted steps, residuals under these weights, and effective degrees of freedom.

A step is one aggregation by unit whose sums combine before the shuffle, so a unit may have any number of rows; what is solved is one small row a unit.

Defined results: rows with a null in a column used are left out; a unit whose equations have no single solution gets the least one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import share_package


def _sums(left: list[Column], right: list[Column], weight: Column, name: str) -> Column:
    """Weighted products of two lists of columns, row by row, as one array."""
    return F.array(*(F.sum(weight * a * b) for a in left for b in right)).alias(name)


def _solved(sums: DataFrame, q: int, p: int, key: str, alpha: float, free: int = 0) -> DataFrame:
    """``(..., b)`` for rows with ``a`` (q squared) and ``c`` (q times p): ``(a + alpha I) b = c``, the first ``free`` not penalised."""
    ridge = np.diag([0.0] * free + [alpha] * (q - free))
    keys = [f"`{n}` {t}" for n, t in sums.drop("a", "c").dtypes]
    names = sums.drop("a", "c").columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            a = np.stack(pdf["a"].to_numpy()).reshape(-1, q, q) + ridge if len(pdf) else np.zeros((0, q, q))
            c = np.stack(pdf["c"].to_numpy()).reshape(-1, q, p) if len(pdf) else np.zeros((0, q, p))
            yield pdf[names].assign(b=list((np.linalg.pinv(a, hermitian=True) @ c).reshape(-1, q * p)))

    share_package(sums.sparkSession)
    return sums.mapInPandas(run, ", ".join([*keys, "b array<double>"]))


def fitted_rates(rows: DataFrame, unit: str, controls: list[str], y: str, out: str, alpha: float = 0.0, steps: int = 12) -> DataFrame:
    """Adds each unit's fitted Poisson rate of ``y`` on an intercept (free) and the ``controls`` (penalised by ``alpha``), after ``steps`` reweighted steps.

    The units' coefficients are checkpointed after each step; rows are laid by unit once and kept, so that a step shuffles no rows.
    """
    rows = rows.dropna(subset=[unit, *controls, y]).repartition(unit).persist()
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in controls)]
    q, count = len(x), F.col(y).cast("double")
    eta = lambda b: F.greatest(F.least(sum((x[i] * F.get(b, F.lit(i)) for i in range(q)), F.lit(0.0)), F.lit(20.0)), F.lit(-20.0))
    start = rows.groupBy(unit).agg(F.array(F.ln(F.greatest(F.avg(count), F.lit(1e-3))), *[F.lit(0.0)] * (q - 1)).alias("_b"))
    for _ in range(steps):
        at = rows.join(start, unit).withColumn("_eta", eta("_b")).withColumn("_mu", F.exp("_eta"))
        working = F.col("_eta") + (count - F.col("_mu")) / F.col("_mu")
        sums = at.groupBy(unit).agg(_sums(x, x, F.col("_mu"), "a"), _sums(x, [working], F.col("_mu"), "c"))
        start = _solved(sums, q, 1, unit, alpha, 1).select(unit, F.col("b").alias("_b")).checkpoint()
    return rows.join(start, unit).withColumn(out, F.exp(eta("_b"))).drop("_b")


def rates_of(x: np.ndarray, y: np.ndarray, starts: np.ndarray, alpha: float = 0.0, steps: int = 12) -> np.ndarray:
    """As :func:`fitted_rates` for rows ``x (row, control)`` that a task has: groups begin at ``starts`` and move together."""
    z = np.concatenate([np.ones((len(x), 1)), x], 1)
    q, group = z.shape[1], np.repeat(np.arange(len(starts)), np.diff([*starts, len(x)]))
    ridge = np.diag([0.0] + [alpha] * (q - 1))
    b = np.zeros((len(starts), q))
    b[:, 0] = np.log(np.maximum(np.add.reduceat(y, starts) / np.bincount(group), 1e-3))
    eta = lambda: np.clip((z * b[group]).sum(1), -20.0, 20.0)
    for _ in range(steps):
        at = eta()
        mu = np.exp(at)
        working = at + (y - mu) / mu
        sums = np.add.reduceat(np.stack([*(mu * z[:, i] * z[:, j] for i in range(q) for j in range(q)), *(mu * z[:, i] * working for i in range(q))], 1), starts)
        b = (np.linalg.pinv(sums[:, : q * q].reshape(-1, q, q) + ridge, hermitian=True) @ sums[:, q * q :, None])[:, :, 0]
    return np.exp(eta())


def weighted_residuals(rows: DataFrame, unit: str, fold: str, controls: list[str], targets: list[str], weight: str, alpha: float) -> DataFrame:
    """Adds ``residual_...`` of each target: less its weighted ridge on the controls, by unit, fitted without the row's own fold."""
    rows = rows.dropna(subset=[unit, fold, *controls, *targets, weight])
    c, t, w = [F.col(x).cast("double") for x in controls], [F.col(x).cast("double") for x in targets], F.col(weight)
    q, p = len(c), len(t)
    own = rows.groupBy(unit, fold).agg(_sums(c, c, w, "a"), _sums(c, t, w, "c"))
    added: Callable = lambda name, n: F.array(*(F.sum(F.get(name, F.lit(i))) for i in range(n)))
    every = own.groupBy(unit).agg(added("a", q * q).alias("_a"), added("c", q * p).alias("_c"))
    rest = lambda x, y: F.zip_with(x, y, lambda u, v: u - v)
    train = own.join(every, unit).select(unit, fold, rest("_a", "a").alias("a"), rest("_c", "c").alias("c"))
    fitted = _solved(train, q, p, unit, alpha).withColumnRenamed("b", "_b")
    out = rows.join(fitted, [unit, fold])
    for j, name in enumerate(targets):
        out = out.withColumn(f"residual_{name}", t[j] - sum((c[i] * F.get("_b", F.lit(i * p + j)) for i in range(q)), F.lit(0.0)))
    return out.drop("_b")


def probes(width: int, count: int, seed: str) -> np.ndarray:
    """Signs ``(width, count)`` by hash."""
    return np.array([[1.0 if hashlib.md5(f"{seed}:{i}:{j}".encode()).digest()[0] & 1 else -1.0 for j in range(count)] for i in range(width)])


def effective_freedom(rows: DataFrame, unit: str, features: list[str], weight: str | None, alpha: float, tries: int = 64, seed: str = "edf") -> DataFrame:
    """``(unit, exact, estimated)``: trace of ``B (B + alpha I)^-1`` for the weighted products ``B`` of each unit's features, and its estimate from random signs.

    Without ``weight`` it is that of a linear ridge.
    """
    rows = rows.dropna(subset=[unit, *features, *([weight] if weight else [])])
    x, q = [F.col(c).cast("double") for c in features], len(features)
    sums = rows.groupBy(F.col(unit).alias("unit")).agg(_sums(x, x, F.col(weight) if weight else F.lit(1.0), "a"))
    z = probes(q, tries, seed)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            exact, estimated = [], []
            for flat in pdf["a"]:
                b = np.array(flat).reshape(q, q)
                inverse = np.linalg.pinv(b + alpha * np.eye(q), hermitian=True)
                exact.append(float(np.trace(inverse @ b)))
                estimated.append(float((z * (b @ (inverse @ z))).sum(0).mean()))
            yield pd.DataFrame({"unit": pdf["unit"], "exact": exact, "estimated": estimated})

    share_package(rows.sparkSession)
    return sums.mapInPandas(run, f"unit {sums.schema['unit'].dataType.simpleString()}, exact double, estimated double")
