"""Down-sampling until two conditions are spread alike over clusters.

The loop runs over the table of counts (two numbers a cluster) and gives a quota for each cell; then one pass keeps the rows of least hash in each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import numbered
from .ranks import shuffle_key


def chi_square_tail(x: float, df: int) -> float:
    """P(X > x) for a whole number of degrees of freedom."""
    if df < 1 or x <= 0:
        return 1.0
    if df % 2:
        out, term, k = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 1
    else:
        out, term, k = 0.0, math.exp(-x / 2), 0
    while k < df:
        out, k = out + term, k + 2
        term *= x / k
    return min(out, 1.0)


def independence(counts: list[tuple[int, int]]) -> tuple[float, list[tuple[float, float]]]:
    """p of the test of independence (with a continuity correction for two clusters), and the residuals ``(n - e) / sqrt(e)``."""
    sides = [sum(c[s] for c in counts) for s in (0, 1)]
    total = sum(sides)
    if not all(sides) or len(counts) < 2:
        return 1.0, [(0.0, 0.0)] * len(counts)
    expected = [tuple(sum(c) * sides[s] / total for s in (0, 1)) for c in counts]
    slack = 0.5 if len(counts) == 2 else 0.0
    chi = sum((abs(n - e) - min(slack, abs(n - e))) ** 2 / e for c, x in zip(counts, expected, strict=True) for n, e in zip(c, x, strict=True))
    return chi_square_tail(chi, len(counts) - 1), [tuple((n - e) / math.sqrt(e) for n, e in zip(c, x, strict=True)) for c, x in zip(counts, expected, strict=True)]


def quotas(counts: list[tuple[int, int]], level: float = 0.05) -> list[tuple[int, int]]:
    """Counts at which the test no longer rejects: again and again the cell that is most over its share comes down to the other condition's count."""
    out = list(counts)
    while True:
        p, residuals = independence(out)
        if p >= level:
            return out
        most = max(r for pair in residuals for r in pair)
        row, side = next((i, s) for i, pair in enumerate(residuals) for s in (0, 1) if pair[s] == most)
        target = out[row][1 - side]
        if most <= 0 or out[row][side] <= target:
            return out
        out[row] = (target, target)


def balanced(df: DataFrame, cluster: str, condition: str, key: list[str], seed: str, level: float = 0.05) -> DataFrame:
    """The rows of ``df`` that stay; ``condition`` is 0 or 1.

    Rows with a null cluster, or another condition, go.  ``key`` names rows; rows with equal keys are ordered by all their values.
    """
    rows = df.filter(F.col(cluster).isNotNull() & F.col(condition).isin(0, 1))
    found = rows.groupBy(cluster).agg(*(F.count(F.when(F.col(condition) == s, 1)).alias(f"n{s}") for s in (0, 1))).orderBy(cluster).collect()  # two numbers a cluster
    kept = quotas([(r.n0, r.n1) for r in found], level)
    table = [(r[cluster], s, q[s]) for r, q in zip(found, kept, strict=True) for s in (0, 1)]
    quota = df.sparkSession.createDataFrame(table, f"_cluster {df.schema[cluster].dataType.simpleString()}, _side int, _quota long")
    ranked = numbered(rows, [cluster, condition], shuffle_key(seed, *key), [*key, *(c for c in df.columns if c not in key)], "_at")
    held = F.broadcast(quota)  # two rows a cluster, made from what the driver holds
    return ranked.join(held, (F.col(cluster) == F.col("_cluster")) & (F.col(condition) == F.col("_side"))).filter("_at <= _quota").select(*df.columns)


def _level(counts: str, how: str) -> Column:
    """Whole number at or under the median, mean, or percentile (``q25``) of counts over 0."""
    positive = F.when(F.col(counts) > 0, F.col(counts))
    if how == "mean":
        return F.floor(F.avg(positive))
    return F.floor(F.percentile(positive, F.lit(0.5 if how == "median" else float(how[1:]) / 100)))


def cluster_targets(df: DataFrame, cluster: str, condition: str, mode: str = "soft", level: str = "median", ratio: float = 1.0, least: int = 10) -> DataFrame:
    """How many rows of each cluster and condition (0 or 1) are used: ``(cluster, n_0, n_1, target, kept, drop_reason)``.

    ``cap``: at most ``ratio`` times the ``level`` of the smaller sides, on both sides alike, where a cluster has more; ``hard``: the smallest side of any cluster that is kept;
    ``soft``: the smaller side, or the ``level`` of all smaller sides (``least`` at least) where that is less; ``resample``: that level on both sides, drawn with replacement
    where a side has fewer.  Clusters with fewer than ``least`` rows on a side do not count towards levels and are dropped.
    """
    side = lambda s: F.count(F.when(F.col(condition) == s, 1))
    n = df.filter(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("cluster")).agg(side(0).alias("n_0"), side(1).alias("n_1")).withColumn("n", F.least("n_0", "n_1"))
    counted = n.withColumn("fine", F.when(F.col("n") >= least, F.col("n")))
    every = counted.agg(_level("fine", level).alias("level"), F.min("fine").alias("lowest"))
    out = counted.crossJoin(F.broadcast(every))  # one row
    cap = F.floor(F.col("level") * ratio)
    target = {"cap": F.when(F.col("n") > cap, cap), "hard": F.col("lowest"), "soft": F.least("n", F.greatest("level", F.lit(least))), "resample": F.greatest("level", F.lit(least))}[mode]
    few = F.col("fine").isNull()
    low = target < least
    words = {"cap": "ratio_capped_to_", "hard": "hard_balanced_to_", "soft": "soft_balanced_to_", "resample": "soft_resampled_to_"}[mode]
    reason = F.when(few, f"fewer_than_{least}_on_a_side").when(low, f"balance_target_below_min_{least}").when(target.isNotNull(), F.concat(F.lit(words), target.cast("string")))
    return out.select("cluster", "n_0", "n_1", F.when(~few & ~F.coalesce(low, F.lit(False)), target).cast("long").alias("target"), (~few & ~F.coalesce(low, F.lit(False))).alias("kept"), reason.alias("drop_reason"))


def sampled(df: DataFrame, cluster: str, condition: str, key: list[str], targets: DataFrame, seed: str) -> DataFrame:
    """The rows that :func:`cluster_targets` asks for, with ``draw`` (from 1): rows of least hash, or draws by hash with replacement where a side has fewer than the target.

    A cluster that is kept without a target keeps all its rows.
    """
    rows = numbered(df.filter(F.col(condition).isin(0, 1)), [cluster, condition], shuffle_key(seed, *key), [*key, *(c for c in df.columns if c not in key)], "_at")
    t = targets.filter("kept").select(F.col("cluster").alias("_cluster"), "n_0", "n_1", "target")
    own = F.when(F.col(condition) == 0, F.col("n_0")).otherwise(F.col("n_1"))
    held = rows.join(t, F.col(cluster) == F.col("_cluster")).withColumn("_own", own).drop("_cluster", "n_0", "n_1")
    enough = F.col("target").isNull() | (F.col("_own") >= F.col("target"))
    once = held.filter(enough & (F.col("target").isNull() | (F.col("_at") <= F.col("target")))).withColumn("draw", F.col("_at"))
    # one row for each draw of a side that has too few, and the row it falls on
    sides = held.filter(~enough).select(cluster, condition, "_own", "target").distinct()
    draws = sides.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("target"))))
    pick = F.conv(F.substring(shuffle_key(f"{seed}-draw", cluster, condition, "draw"), 1, 7), 16, 10).cast("long") % F.col("_own") + 1
    draws = draws.select(F.col(cluster).alias("_c"), F.col(condition).alias("_s"), "draw", pick.alias("_pick"))
    again = held.filter(~enough).join(draws, (F.col(cluster) == F.col("_c")) & (F.col(condition) == F.col("_s")) & (F.col("_at") == F.col("_pick")))
    return once.select(*df.columns, "draw").unionByName(again.select(*df.columns, "draw"))


def manifest(sample: DataFrame, key: list[str], group: list[str]) -> DataFrame:
    """What names a sample: keys with their group and draw, to be written and replayed."""
    return sample.select(*group, *key, "draw")


def replayed(df: DataFrame, of: DataFrame, key: list[str], group: list[str]) -> tuple[DataFrame, int]:
    """The rows of ``df`` that a manifest names, once for each of its draws, and how many of its entries ``df`` has no row for."""
    named = of.select(*(F.col(c).alias(f"_{c}") for c in [*group, *key]), "draw")
    same = F.lit(True)
    for c in [*group, *key]:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(named, same).select(*df.columns, "draw"), named.join(df, same, "left_anti").count()


def claimed(words: DataFrame, group: str, word: str, n: int, seed: str) -> DataFrame:
    """``n`` words of each group by hash, none of which an earlier group has: groups choose in their order, each ``(group, word, place)``.

    Groups are few (a step each); what earlier groups chose is ``n`` words a group at most.
    """
    distinct = words.dropna(subset=[group, word]).select(F.col(group).alias("group"), F.col(word).alias("word")).distinct().persist()
    taken: list[tuple] = []
    try:
        for g in [r[0] for r in distinct.select("group").distinct().orderBy("group").collect()]:
            used = words.sparkSession.createDataFrame([(w,) for _, w, _ in taken], f"word {distinct.schema['word'].dataType.simpleString()}")
            free = distinct.filter(F.col("group") == g).join(F.broadcast(used), "word", "left_anti")  # at most n words a group
            chosen = free.orderBy(shuffle_key(seed, "word"), "word").limit(n).select("word").collect()
            taken += [(g, r.word, i) for i, r in enumerate(chosen, 1)]
    finally:
        distinct.unpersist()
    kind = distinct.schema
    return words.sparkSession.createDataFrame(taken, f"group {kind['group'].dataType.simpleString()}, word {kind['word'].dataType.simpleString()}, place int")
