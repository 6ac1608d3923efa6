"""Reading tables, and times as plain numbers."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a mount that executors see, or ship it)."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows by key in as many tasks as shuffles have: groups whose work outweighs their bytes are not to be joined into a few tasks for being small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows by key in tasks of about ``rows`` rows, as many as the table needs and no fewer than shuffles have, so that what a task sorts does not grow with the table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)


def whole(parts: Iterable[pd.DataFrame], keys: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Frames of whole groups, about ``rows`` rows or one larger group, of a task's rows that lie group by group: many small groups are worked on together."""
    held, n, least = [], 0, rows
    for pdf in parts:
        held.append(pdf)
        n += len(pdf)
        if n < least:
            continue
        pdf = pd.concat(held, ignore_index=True)
        last = pdf[keys].iloc[-1].tolist()
        cut = int(np.logical_and.reduce([(pdf[k] == v).to_numpy() for k, v in zip(keys, last, strict=True)]).argmax())
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
        held, n = [pdf.iloc[cut:]], len(pdf) - cut
        least = max(rows, 2 * n)
    if n:
        yield pd.concat(held, ignore_index=True)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Places at which groups of equal values begin."""
    n = len(columns[0])
    return np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def r6(column: Column) -> Column:
    """Six decimals, never a negative zero."""
    return F.round(column.cast("double"), 6) + F.lit(0.0)


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation of the rows with both values, as SQL has it: NaN where a side does not vary (``corr`` divides by zero there), null without rows."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spreads = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    return F.when(F.count(F.when(both, 1)) > 0, F.coalesce(F.try_divide(F.covar_pop(x, y), spreads), F.lit(float("nan"))))
