import math

import pytest
from lumengrid.functions import special
from pyspark.sql import functions as F

# quantiles as they stand in printed tables
TABLED = [
    ("normal_upper", (1.959963984540054,), 0.025), ("normal_upper", (-1.2815515655446004,), 0.9), ("chi_square_upper", (3.841458820694124, 1.0), 0.05), ("chi_square_upper", (18.307038053275146, 10.0), 0.05),
    ("t_two_sided", (2.2281388519649385, 10.0), 0.05), ("t_two_sided", (-12.706204736432095, 1.0), 0.05), ("t_upper", (1.9623390808264078, 1000.0), 0.025), ("f_upper", (4.102821015304574, 2.0, 10.0), 0.05), ("f_upper", (161.4476387975881, 1.0, 1.0), 0.05),
]


@pytest.mark.parametrize("name,arguments,want", TABLED)
def test_tabled_values(spark, name, arguments, want):
    got = spark.range(1).select(getattr(special, name)(*map(F.lit, arguments)).alias("p")).first().p
    assert abs(got - want) < 1e-9


def test_t_quantile_and_large_arguments(spark):
    df = spark.createDataFrame([(1.0, 12.706204736432095), (10.0, 2.2281388519649385), (1000.0, 1.9623390808264078)], "df double, c double")
    for r in df.select("c", special.t_critical(0.05, F.col("df")).alias("got")).collect():
        assert abs(r.got - r.c) < 1e-8 * r.c
    big = spark.range(1).select(special.gamma_upper(F.lit(50_000.0), F.lit(50_000.0)).alias("g"), special.beta_lower(F.lit(40_000.0), F.lit(40_000.0), F.lit(0.5)).alias("b"), special.log_gamma(F.lit(123456.7)).alias("l")).first()
    assert abs(big.g - (0.5 - 1 / (3 * math.sqrt(2 * math.pi * 50_000)))) < 1e-6 and abs(big.b - 0.5) < 1e-9 and abs(big.l - math.lgamma(123456.7)) < 1e-6


def test_signed_ranks_counted_out(spark):
    n = 7
    counts = {}
    for subset in range(1 << n):
        w = sum(k + 1 for k in range(n) if subset >> k & 1)
        counts[w] = counts.get(w, 0) + 1
    df = spark.createDataFrame([(float(w), n) for w in range(30)], "w double, n int")
    for r in df.select("w", special.signed_rank_upper(F.col("w"), F.col("n")).alias("p")).collect():
        assert abs(r.p - sum(c for v, c in counts.items() if v >= r.w) / 2**n) < 1e-12


def test_nulls_and_no_degrees_of_freedom(spark):
    none = F.lit(None).cast("double")
    row = spark.range(1).select(
        special.normal_upper(none).alias("a"), special.t_two_sided(F.lit(1.0), F.lit(0.0)).alias("b"), special.f_upper(none, F.lit(1.0), F.lit(2.0)).alias("c"), special.chi_square_upper(F.lit(0.0), F.lit(3.0)).alias("d"), special.signed_rank_upper(F.lit(0.0), F.lit(0)).alias("e")
    ).first()
    assert tuple(row) == (None, None, None, 1.0, None)


def test_no_python_worker(spark):
    plan = spark.range(3).select(special.t_two_sided(F.col("id").cast("double"), F.lit(5.0)).alias("p"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
