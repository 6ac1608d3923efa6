"""Hash-ordered randomness, ranks, false-discovery control and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def shuffle_key(seed: str, *columns: str) -> Column:
    """A reproducible random order: md5 of the seed and the columns, on any partitioning."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.col(c).cast("string") for c in columns)))


def average_rank(by: str, within: tuple[str, ...] = ()) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*within)
    return F.rank().over(w.orderBy(by)) + (F.count(F.lit(1)).over(w.partitionBy(*within, by)) - 1) / F.lit(2.0)


def benjamini_hochberg(df: DataFrame, p: str, key: str | None = None, out: str = "q", buckets: int = 1024) -> DataFrame:
    """Adds adjusted p-values: p n / rank, made monotone from the largest down, at most 1; null p-values do not count and stay null.

    Equal p-values have one adjusted value, so distinct ones are counted first; these are summed and lessened in ``buckets`` of (0, 1), whose totals carry over.
    """
    counts = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_k")).withColumn("_b", F.least(F.floor(F.col("_p") * buckets), F.lit(buckets)))
    totals = counts.groupBy("_b").agg(F.sum("_k").alias("_t"))
    whole = Window.orderBy("_b")  # a row a bucket
    totals = totals.select("_b", F.coalesce(F.sum("_t").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_t").over(Window.partitionBy()).alias("_n"))
    up = Window.partitionBy("_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(totals, "_b").withColumn("_q", F.col("_p") * F.col("_n") / (F.col("_before") + F.sum("_k").over(up)))
    lows = ranked.groupBy("_b").agg(F.min("_q").alias("_low")).withColumn("_later", F.min("_low").over(Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)))
    down = Window.partitionBy("_b").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    found = ranked.join(lows.select("_b", "_later"), "_b").select("_p", F.least(F.lit(1.0), F.min("_q").over(down), "_later").alias(out))
    return df.join(found, F.col(p) == F.col("_p"), "left").drop("_p")


def contiguous_fold(i: Column, n: Column, k: int, extra: str = "first") -> Column:
    """Fold of row ``i`` of ``n`` in contiguous parts; left-over rows go one each to the ``first`` folds, or all to the ``last``."""
    size, over = F.floor(n / k), n % k
    if extra == "last":
        return F.least(F.floor(i / size), F.lit(k - 1)).cast("int")
    cut = over * (size + 1)
    return F.when(i < cut, F.floor(i / (size + 1))).otherwise(over + F.floor((i - cut) / size)).cast("int")


def row_number0(w: WindowSpec) -> Column:
    return F.row_number().over(w) - 1


def quantiles(df: DataFrame, by: str, shares: tuple[float, ...], buckets: int = 4096) -> DataFrame:
    """One row with the array ``q`` of exact quantiles of ``by`` (interpolated; nulls do not count), null if there is no value.

    Values are counted in ``buckets`` of equal width; only those of buckets that hold a wanted rank are sorted.
    """
    x = df.select(F.col(by).cast("double").alias("_x")).filter("_x is not null")
    ends = x.agg(F.min("_x").alias("_lo"), F.max(F.when(~F.isnan("_x"), F.col("_x"))).alias("_hi"), F.count(F.lit(1)).alias("_n"))  # one row
    at = F.least(F.floor((F.col("_x") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * buckets), F.lit(buckets - 1))
    laid = x.crossJoin(F.broadcast(ends)).select("_x", F.when(F.isnan("_x"), F.lit(buckets)).when(F.col("_hi") > F.col("_lo"), at).otherwise(F.lit(0)).cast("int").alias("_b"))
    counts = laid.groupBy("_b").agg(F.count(F.lit(1)).alias("_k"))
    before = counts.withColumn("_before", F.sum("_k").over(Window.orderBy("_b")) - F.col("_k"))  # a row a bucket
    wanted = ends.select("_n", F.posexplode(F.array(*map(F.lit, shares))).alias("_j", "_share")).withColumn("_pos", F.col("_share") * (F.col("_n") - 1))
    places = wanted.select("_j", "_pos", F.explode(F.array(F.floor("_pos"), F.ceil("_pos"))).alias("_i"))
    found = before.join(places, (F.col("_i") >= F.col("_before")) & (F.col("_i") < F.col("_before") + F.col("_k"))).select("_b", "_before", "_j", "_pos", "_i")
    kept = laid.join(F.broadcast(found.select("_b").distinct()), "_b", "left_semi")  # two buckets a share at most
    ranked = kept.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_x")) - 1)
    values = ranked.join(F.broadcast(found), "_b").filter("_r + _before = _i").groupBy("_j", "_pos").agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    one = values.select("_j", (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_pos") - F.floor("_pos"))).alias("_q"))
    return one.agg(F.array(*(F.max(F.when(F.col("_j") == j, F.col("_q"))) for j in range(len(shares)))).alias("q"))
