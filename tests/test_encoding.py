import numpy as np
import pandas as pd
from lumengrid.operators import encoding as E
from lumengrid.operators import weighted as W
from lumengrid.operators.glm import poisson_ridges


def unit(n=80, seed=0, effect=0.8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = rng.poisson(np.exp(0.5 + effect * x[:, 0])).astype(float)
    return pd.DataFrame({"_o": range(n), "_y": y, "_e": rng.normal(size=n) * 0.1, "_f": np.arange(n) * 4 // n, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})


def test_quasi_equals_newton_optimum():
    u = E.Unit(unit(), ["a", "b", "c"])
    use = np.array([u.fold != k for k in u.folds], float)
    for alpha in (0.0, 1e-3, 1.0, 100.0):
        w = E.quasi_ridges(u.sets(use), np.full(4, alpha))
        assert np.allclose(w, poisson_ridges(u.x[None], u.y, use, np.full(4, alpha), u.offset), atol=1e-6)
        warm = E.quasi_ridges(u.sets(use), np.full(4, alpha), w + 0.3)
        assert np.allclose(w, warm, atol=1e-6)


def test_chunks_change_nothing(monkeypatch):
    u = E.Unit(unit(), ["a", "b", "c"])
    use = np.array([u.fold != k for k in u.folds], float)
    whole = E.quasi_ridges(u.sets(use), np.ones(4))
    monkeypatch.setattr(E, "CHUNK", 40)
    assert np.allclose(whole, E.quasi_ridges(u.sets(use), np.ones(4)), atol=1e-8)


def test_two_stages_are_at_least_as_good_as_one():
    u = E.Unit(unit(effect=0.3), ["a", "b", "c"])
    fine, coarse = u.chosen(None), u.chosen(E.COARSE)
    assert all(0.099 < f / c < 10.1 for f, c in zip(fine, coarse, strict=True))
    inner = lambda alpha: sum(
        E.held_out(u.sets(use), E.quasi_ridges(u.sets(use), np.array([a])), test, u.constant[None])[0]
        for k, a in zip(u.folds, alpha, strict=True) for j in u.folds if j != k
        for use, test in [(((u.fold != k) & (u.fold != j)).astype(float)[None], (u.fold == j).astype(float)[None])]
    )
    assert inner(fine) >= inner(coarse) - 1e-6


def test_lags_keep_their_distance():
    for n, folds, tau in ((80, 4, 3), (80, 4, 30), (13, 4, 6), (12, 3, 1)):
        lags = {E.shift_of("s", "u", i, n, folds, tau) for i in range(200)}
        low = max(tau, n // (2 * folds), 1)
        assert all(low <= k < n - low for k in lags) if n - low > low else lags == {n // 2}
    assert E.timescale(np.array([1.0, 1, 1, -1, -1, -1])) == 3 and E.timescale(np.ones(10)) == 5


def test_effects_are_found_and_none_are_not(spark):
    rows = [(f"on{k}", *r) for k in range(3) for r in unit(120, k).itertuples(index=False)] + [(f"off{k}", *r) for k in range(20) for r in unit(120, 50 + k, 0.0).itertuples(index=False)]
    rows += [("short", *r) for r in unit(5).itertuples(index=False)] + [("flat", *r) for r in unit(40).assign(_y=2.0).itertuples(index=False)] + [("on0", None, 1.0, 0.0, 1, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["u", "o", "y", "e", "f", "a", "b", "c"]).astype({"f": "int64"}))
    out = {r.unit: r for r in E.encode(df.dropna(), "u", ["a", "b", "c"], "y", "e", "f", "o", (0.1, 1.0, 10.0), 39, 13).collect()}
    assert len(out) == 25 and out["short"].drop_reason == "too few rows" and out["flat"].ll is None
    assert all(out[f"on{k}"].p_perm == 1 / 40 and out[f"on{k}"].r2 > 0.05 and out[f"on{k}"].permutations == 39 for k in range(3))
    # of twenty units without an effect about one is expected under 5 %
    assert sum(out[f"off{k}"].p_perm <= 0.05 for k in range(20)) <= 4
    assert E.encode(df.filter("false"), "u", ["a"], "y", "e", "f", "o", (1.0,), 3).collect() == []


def frame(spark, n=400):
    rng = np.random.default_rng(1)
    c, d = rng.normal(size=n), rng.normal(size=n)
    s, t = 0.7 * c - 0.2 * d + rng.normal(size=n), d + rng.normal(size=n)
    y = rng.poisson(np.exp(0.3 + 0.5 * c - 0.4 * d))
    u = np.arange(n) % 2
    data = pd.DataFrame({"u": u, "i": range(n), "f": np.arange(n) // 2 % 4, "c": c, "d": d, "s": s, "t": t, "y": y})
    return data, spark.createDataFrame(data)


def test_rates_equal_newton_and_residuals_are_orthogonal(spark):
    data, df = frame(spark)
    got = W.fitted_rates(df, "u", ["c", "d"], "y", "w").toPandas().sort_values("i")
    for u, part in got.groupby("u"):
        x = part[["c", "d"]].to_numpy()
        w = poisson_ridges(x[None], part["y"].to_numpy(float), np.ones((1, len(x))), np.zeros(1), np.zeros(len(x)))[0]
        assert np.allclose(part["w"], np.exp(w[0] + x @ w[1:]), rtol=1e-6), u
    out = W.weighted_residuals(spark.createDataFrame(got), "u", "f", ["c", "d"], ["s", "t"], "w", 0.0).toPandas()
    for (u, f), part in out.groupby(["u", "f"]):
        train = got[(got["u"] == u) & (got["f"] != f)]
        c, w = train[["c", "d"]].to_numpy(), train["w"].to_numpy()[:, None]
        b = np.linalg.solve((c * w).T @ c, (c * w).T @ train[["s", "t"]].to_numpy())
        # what is left of the training rows does not covary with the controls under the weights
        left = train[["s", "t"]].to_numpy() - c @ b
        assert np.abs((c * w).T @ left).max() < 1e-8
        assert np.allclose(part[["residual_s", "residual_t"]], part[["s", "t"]].to_numpy() - part[["c", "d"]].to_numpy() @ b, atol=1e-8)


def test_effective_freedom_and_its_estimate(spark):
    data, df = frame(spark)
    out = {r.unit: r for r in W.effective_freedom(df, "u", ["c", "d", "s", "t"], None, 30.0, 2000).collect()}
    for u, part in data.groupby("u"):
        x = part[["c", "d", "s", "t"]].to_numpy()
        want = np.trace(np.linalg.solve(x.T @ x + 30 * np.eye(4), x.T @ x))
        assert abs(out[u].exact - want) < 1e-9 and abs(out[u].estimated - want) < 0.1
    assert W.effective_freedom(df.filter("false"), "u", ["c"], None, 1.0).collect() == []
    alone = W.effective_freedom(df, "u", ["c"], None, 0.0, 8).collect()
    assert all(abs(r.exact - 1) < 1e-9 and abs(r.estimated - 1) < 1e-9 for r in alone)


def test_units_together_are_as_each_alone():
    frames = [unit(n, k, 0.4) for k, n in enumerate((80, 61, 60, 33))]
    frames[3]["_f"] = np.arange(33) * 3 // 33  # three folds beside four
    frames[1]["c"] = 1.0
    own = [E.Unit(f, ["a", "b", "c"]) for f in frames]
    lags = [np.array([0, 7, len(u.y) - 5]) for u in own]
    some = E.Units(own)
    for grid in (None, (0.1, 1.0, 10.0)):
        for u, got in zip(own, some.chosen(grid), strict=True):
            assert np.allclose(got, u.chosen(grid), rtol=1e-9)
    alphas = [np.linspace(0.01, 3, len(u.folds)) for u in own]
    for u, a, at, got, w in zip(own, alphas, lags, some.likelihood(alphas, lags), some.coefficients(np.ones(4)), strict=True):
        assert np.allclose(got, u.likelihood(a, at.tolist()), rtol=1e-9)
        assert np.allclose(w, E.quasi_ridges(u.sets(np.ones((1, len(u.y)))), np.ones(1))[0], atol=1e-7)


def test_shared_fits_are_at_rest_where_steps_overshoot(monkeypatch):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(2, 30, 2)) * 3, np.zeros((2, 5, 30))
    y[:, :, :2] = 400.0
    use = (rng.random((2, 5, 30)) < 0.8).astype(float)
    use[0, 0] = 0
    alpha = np.full((2, 5), 1e-5)
    whole = E.shared_ridges(x, y, np.zeros(y.shape), use, alpha)
    for u in range(2):
        sets = E.Sets(np.broadcast_to(x[u], (5, 30, 2)), y[u], np.zeros((5, 30)), use[u])
        alone = E.quasi_ridges(sets, alpha[u])
        loss = [(use[u] * (np.exp(e) - y[u] * e)).sum(1) + 0.5 * alpha[u] * (w[:, 1:] ** 2).sum(1) for w in (whole[u], alone) for e in [np.clip(w[:, 1:] @ x[u].T + w[:, :1], -20, 20)]]
        assert np.isfinite(whole[u]).all() and (loss[0] <= loss[1] + 1e-6 * (1 + np.abs(loss[1]))).all()
    monkeypatch.setattr(E, "CHUNK", 40)
    u = E.Unit(unit(40), ["a", "b", "c"])
    assert np.allclose(E.Units([u]).likelihood([np.ones(4)], [np.array([0, 3])])[0], u.likelihood(np.ones(4), [0, 3]), rtol=1e-9)
