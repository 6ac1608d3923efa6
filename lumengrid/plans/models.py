"""Model fits (survey 2.12, 2.14, 2.17); solvers run in grouped tasks, tests check their optimum."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.glm import encode_units
from ..operators.ranks import contiguous_fold
from ..operators.tables import micros, r6, table
from ..registry import query


def _responses(spark, d):
    """Events per unit and six hours as counts, with time features and an exposure."""
    e = table(spark, d, "events").withColumn("bin", F.floor(micros("ts") / (6 * 3600 * 1_000_000)))
    y = e.groupBy("user_id", "bin").agg(F.count(F.lit(1)).alias("y"), F.avg("value").alias("level"), F.stddev_pop("value").alias("spread"), F.max("value").alias("top"))
    w = Window.partitionBy("user_id")
    i = F.row_number().over(w.orderBy("bin")) - 1
    y = y.withColumn("i", i).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("fold", contiguous_fold(F.col("i"), F.col("n"), 4))
    return y.withColumn("phase", F.sin(F.col("bin") % 4)).withColumn("log_exposure", F.lit(0.0))


@query()
def m16_encoding(spark, d):
    """Nested-cross-validated Poisson ridge per unit, with a circular-shift null."""
    return encode_units(_responses(spark, d), "user_id", ["level", "spread", "top", "phase"], "y", "log_exposure", "fold", "bin", permutations=10)


@query("select c_nationkey, round(sum((a - ma) * (b - mb)) / nullif(sum((a - ma) * (a - ma)), 0), 6) as slope from (select c_nationkey, c_acctbal as a, c_custkey::double as b, avg(c_acctbal) over (partition by c_nationkey, c_mktsegment) as ma, avg(c_custkey) over (partition by c_nationkey, c_mktsegment) as mb from customer) group by 1")
def m15_fixed_effects(spark, d):
    """Slope within groups, by demeaning."""
    c = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("a"), F.col("c_custkey").cast("double").alias("b"))
    w = Window.partitionBy("c_nationkey", "c_mktsegment")
    c = c.withColumn("a", F.col("a") - F.avg("a").over(w)).withColumn("b", F.col("b") - F.avg("b").over(w))
    return c.groupBy("c_nationkey").agg(r6(F.sum(F.col("a") * F.col("b")) / F.nullif(F.sum(F.col("a") * F.col("a")), F.lit(0.0))).alias("slope"))
