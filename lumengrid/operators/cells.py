"""Cells of similar rows by k-means, and shuffles inside cells.

Centroids (``k`` times the columns' number) are all that reaches the driver; every step is one aggregation whose sums
combine before the shuffle, with the assignment as an expression of the row.  First centroids are the rows of least hash, so that a run repeats.

Defined results: rows with a null column or key are left out; a cell without rows keeps its centroid; equal distances go to the first cell;
fewer rows than ``k`` give as many cells as there are rows; a constant column has deviation 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import shuffle_key


@dataclass
class Cells:
    """Scale of the columns, centroids of scaled values, and the sum of squared distances after each step."""

    columns: list[str]
    mean: list[float]
    sd: list[float]
    centroids: list[list[float]]
    inertia: list[float] = field(default_factory=list)

    def scaled(self) -> list[Column]:
        return [(F.col(c).cast("double") - m) / s for c, m, s in zip(self.columns, self.mean, self.sd, strict=True)]

    def nearest(self) -> Column:
        """``(squared distance, cell)`` of a row."""
        x = self.scaled()
        distance = lambda at: sum(((v - c) * (v - c) for v, c in zip(x, at, strict=True)), F.lit(0.0))
        return F.array_min(F.array(*(F.struct(distance(at).alias("distance"), F.lit(i).alias("cell")) for i, at in enumerate(self.centroids))))


def kmeans(df: DataFrame, columns: list[str], k: int, key: list[str], seed: str, steps: int = 25) -> Cells:
    """Cells of standardised columns, by at most ``steps`` rounds or until no centroid moves."""
    rows = df.dropna(subset=[*columns, *key]).select(*columns, *key)
    value = lambda c: F.col(c).cast("double")
    scale = rows.agg(*(F.avg(value(c)).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(value(c)).alias(f"s{i}") for i, c in enumerate(columns))).first()
    n = range(len(columns))
    out = Cells(columns, [scale[f"m{i}"] or 0.0 for i in n], [scale[f"s{i}"] or 1.0 for i in n], [])
    first = rows.orderBy(shuffle_key(seed, *key), *key, *columns).limit(k)
    out.centroids = [list(r) for r in first.select(*(c.alias(f"x{i}") for i, c in enumerate(out.scaled()))).collect()]
    if not out.centroids:
        return out
    held = rows.select(*columns).persist()
    try:
        for _ in range(steps):
            at = held.select(out.nearest().alias("at"), *(c.alias(f"x{i}") for i, c in enumerate(out.scaled())))
            found = at.groupBy("at.cell").agg(F.sum("at.distance").alias("distance"), *(F.avg(f"x{i}").alias(f"x{i}") for i in n)).collect()  # k rows
            out.inertia.append(sum(r.distance for r in found))
            moved = [list(c) for c in out.centroids]
            for r in found:
                moved[r.cell] = [r[f"x{i}"] for i in n]
            still = moved == out.centroids
            out.centroids = moved
            if still:
                break
    finally:
        held.unpersist()
    return out


def numbered(df: DataFrame, by: list[str], order: Column, ties: list[str], out: str, buckets: int = 64) -> DataFrame:
    """Adds the rank (from 1) inside ``by`` in the order of a hex digest; a large group is ranked in ``buckets`` parts with offsets carried over."""
    rows = df.withColumn("_order", order).withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 6), 16, 10).cast("long") * buckets / (1 << 24)))
    counts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    starts = counts.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_order", *ties)
    ranked = rows.withColumn("_rank", F.row_number().over(inside))
    same = F.col("_bucket") == F.col("_b")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ranked.join(starts, same).withColumn(out, F.col("_start") + F.col("_rank")).drop("_order", "_bucket", "_rank", "_b", "_start", *(f"_{c}" for c in by))


def shuffled_inside(df: DataFrame, by: list[str], key: list[str], values: list[str], seed: str) -> DataFrame:
    """Each row with ``drawn_...`` values of another row of its group: a permutation of the group, by hash."""
    ties = [*key, *values]
    mine = numbered(df, by, shuffle_key(f"{seed}-to", *key), ties, "_at")
    theirs = numbered(df.select(*by, *key, *values), by, shuffle_key(f"{seed}-from", *key), ties, "_at")
    drawn = theirs.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_at").alias("_place"), *(F.col(c).alias(f"drawn_{c}") for c in values))
    same = F.col("_at") == F.col("_place")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return mine.join(drawn, same).drop("_at", "_place", *(f"_{c}" for c in by))
