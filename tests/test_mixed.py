import numpy as np
import pytest
from lumengrid.operators.mixed import crossed_effects, small_factor_test


def data(n, seed):
    rng = np.random.default_rng(seed)
    c, u, x = rng.integers(0, 6, n), rng.integers(0, 40, n), rng.normal(size=n)
    y = 1 + 0.5 * x + rng.normal(size=6)[c] * 0.7 + rng.normal(size=40)[u] * 0.5 + rng.normal(size=n) * 0.8
    return y, x, c, u


def deviance(theta, y, x, c, u, reml, small):
    """-2 log likelihood from the whole covariance of all rows, coefficients and predicted effects of the small factor."""
    n, design, zc, zu = len(y), np.column_stack([np.ones(len(y)), x]), np.eye(6)[c], np.eye(40)[u]
    v = (theta[0] * zc @ zc.T if small else 0) + theta[1] * zu @ zu.T + theta[2] * np.eye(n)
    inverse = np.linalg.inv(v)
    a = design.T @ inverse @ design
    beta = np.linalg.solve(a, design.T @ inverse @ y)
    r = y - design @ beta
    out = np.linalg.slogdet(v)[1] + r @ inverse @ r + (n - 2 if reml else n) * np.log(2 * np.pi)
    return out + (np.linalg.slogdet(a)[1] if reml else 0), beta, theta[0] * zc.T @ inverse @ r


@pytest.mark.parametrize("reml,small", [(True, True), (False, True), (False, False)])
def test_equals_dense_likelihood_at_its_optimum(spark, reml, small):
    y, x, c, u = data(500, 0)
    df = spark.createDataFrame([(float(a), float(b), int(k), int(j)) for a, b, k, j in zip(y, x, c, u, strict=True)] + [(None, 1.0, 1, 1), (1.0, None, 1, 1), (1.0, 1.0, None, 1), (1.0, 1.0, 1, None)], "y double, x double, c int, u int")
    f = crossed_effects(df, "y", ["x"], "c", "u", reml, small)
    theta = np.array([f.small_variance, f.large_variance, f.error_variance])
    best, beta, blups = deviance(theta, y, x, c, u, reml, small)
    assert f.n == 500 and abs(best - f.deviance) < 1e-8 and np.allclose(beta, f.beta, atol=1e-9)
    assert np.allclose(blups, [f.blups[k] for k in range(6)] if small else blups, atol=1e-9)
    for i in range(0 if small else 1, 3):
        for step in (0.99, 1.01):
            other = theta.copy()
            other[i] *= step
            assert deviance(other, y, x, c, u, reml, small)[0] > best


def test_no_effect_is_the_boundary_and_one_level_is_refused(spark):
    df = spark.range(400).selectExpr("double(id % 2) as y", "int(id / 2 % 4) as c", "int(id / 8 % 5) as u")
    f = crossed_effects(df, "y", [], "c", "u")
    assert (f.small_variance, f.large_variance) == (0.0, 0.0) and abs(f.error_variance - 100 / 399) < 1e-6
    for bad in (df.filter("c = 0"), df.filter("u = 0"), df.filter("false")):
        with pytest.raises(ValueError):
            crossed_effects(bad, "y", [], "c", "u")


def test_ratio_of_an_effect_and_of_none(spark):
    y, x, c, u = data(500, 0)
    df = spark.createDataFrame([(float(a), float(b), int(k), int(j)) for a, b, k, j in zip(y, x, c, u, strict=True)], "y double, x double, c int, u int")
    ratio, p = small_factor_test(df, "y", ["x"], "c", "u")
    assert ratio > 50 and 0 < p < 1e-10
    ratio, p = small_factor_test(df.withColumn("c", (df.c * 7 + df.u * 5 + df.x.cast("int")) % 3), "y", ["x"], "c", "u")
    assert ratio >= 0 and 0 < p <= 0.5
