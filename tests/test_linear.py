import numpy as np
import pytest
from lumengrid.operators import linear
from lumengrid.plans import linear as plans
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 3
    rows = [(i, i % 3, r.tolist()) for i, r in enumerate(x)]
    odd = [(1000, 0, None), (1001, 1, [1.0]), (1002, 2, [float("nan")] * 5), (1003, None, [1.0] * 5), (1004, 0, [1.0, None, 1.0, 1.0, 1.0])]
    return x, spark.createDataFrame(rows + odd, "id long, fold int, v array<double>").repartition(7).cache()


def _matrix(df, column):
    return np.array([r[column] for r in df.filter("id < 1000").orderBy("id").collect()])


def test_components_equal_a_singular_value_decomposition(spark, table):
    x, df = table
    whole = df.filter("fold is not null")
    m = linear.moments(whole, "v", 5)[None]
    assert m.n == 300
    got = _matrix(linear.applied(whole, "v", 5, {None: linear.principal(m, 3)}, "y"), "y")
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    sign = np.sign(vt[range(3), np.abs(vt[:3]).argmax(1)])
    assert np.allclose(got, (u * s)[:, :3] * sign)


def test_components_of_a_fold_learn_from_the_others(spark, table):
    x, df = table
    parts = linear.moments(df, "v", 5, "fold")
    every = parts[0] + parts[1] + parts[2]
    out = linear.applied(df, "v", 5, {k: linear.principal(every - m, 2, True) for k, m in parts.items()}, "y", "fold")
    got, fold = _matrix(out, "y"), np.arange(300) % 3
    for k in range(3):
        z = (x - x[fold != k].mean(0)) / x[fold != k].std(0)
        _, _, vt = np.linalg.svd(z[fold != k] - z[fold != k].mean(0), full_matrices=False)
        y = z @ (vt[:2].T * np.sign(vt[range(2), np.abs(vt[:2]).argmax(1)]))
        assert np.allclose(got[fold == k], (y / y[fold != k].std(0))[fold == k])
    assert {r.id for r in out.filter("y is null").collect()} == {1000, 1001, 1002, 1003, 1004}


def test_erasure_is_the_least_change_without_covariance(spark, table):
    x, df = table
    z = np.stack([np.arange(300) % 2, x[:, 0] ** 2], 1)
    joined = df.filter("id < 1000").withColumn("w", F.concat("v", F.array((F.col("id") % 2).cast("double"), F.get("v", F.lit(0)) * F.get("v", F.lit(0)))))
    a = linear.eraser(linear.moments(joined, "w", 7)[None], 2)
    y = _matrix(linear.applied(joined, "w", 7, {None: a}, "y", then=lambda x, c, y: x[:, :5] - y), "y")
    assert np.abs((y - y.mean(0)).T @ (z - z.mean(0))).max() < 1e-7
    cov, c = np.cov(x.T, bias=True), (x - x.mean(0)).T @ (z - z.mean(0)) / 300
    assert np.allclose(x - y, (x - x.mean(0)) @ (c @ np.linalg.pinv(c.T @ np.linalg.inv(cov) @ c) @ c.T @ np.linalg.inv(cov)).T)


def test_constant_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 5.0])], "id long, v array<double>")
    got = linear.applied(df, "v", 2, {None: linear.principal(linear.moments(df, "v", 2)[None], 2, True)}, "y").collect()
    assert all(np.isfinite(r.y).all() for r in got) and got[0].y == got[1].y
    none = df.limit(0)
    assert linear.moments(none, "v", 2)[None].n == 0 and linear.moments(none, "v", 2, "id") == {}
    assert linear.applied(none, "v", 2, {}, "y", "id").count() == 0


def test_registered_folds_have_no_null_scores(spark):
    got = plans.f4_components_by_fold(spark, "/root/testdata/sf0.001")
    assert got.filter("scores is null or size(scores) <> 8").isEmpty()


@pytest.mark.parametrize("standardise", [False, True])
def test_randomised_components_equal_exact_ones(spark, standardise):
    rng = np.random.default_rng(8)
    basis = np.linalg.qr(rng.normal(size=(200, 40)))[0]
    x = rng.normal(size=(300, 40)) * 0.5 ** np.arange(40) @ basis.T * 10 + rng.normal(size=200)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 200)], "i int, v array<double>").repartition(5)
    fast = linear.leading(df, "v", 200, 5, standardise)
    exact = linear.principal(linear.moments(df, "v", 200)[None], 5, standardise)
    a, b = np.linalg.qr(fast.weights)[0], np.linalg.qr(exact.weights)[0]
    # the sine of the largest angle between both spaces
    assert np.linalg.norm(b - a @ (a.T @ b), 2) < (1e-6 if not standardise else 1e-3)
    assert np.allclose(fast.centre, exact.centre) and np.allclose(fast.weights[:, :3], exact.weights[:, :3], atol=1e-5 * np.abs(exact.weights).max())


def test_weighted_moments_are_those_of_repeated_rows(spark):
    rng = np.random.default_rng(9)
    x, w = rng.normal(size=(50, 3)), rng.integers(0, 3, (50, 4)).astype(float)
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, w, strict=True)] + [(None, [1.0] * 4), ([1.0, 2.0, 3.0], None), ([1.0, None, 3.0], [1.0] * 4)], "v array<double>, w array<double>").repartition(3)
    for k, m in enumerate(linear.weighted_moments(df, "v", 3, "w", 4)):
        again = np.repeat(x, w[:, k].astype(int), 0)
        assert m.n == len(again) and np.allclose(m.total, again.sum(0)) and np.allclose(m.products, again.T @ again)
    assert linear.weighted_moments(df.filter("false"), "v", 3, "w", 2)[1].n == 0
