import numpy as np
import pandas as pd
import pytest
from lumengrid.operators import decoders as D
from lumengrid.operators.quasi import minimise


def problem(seed=1, n=300, p=6, k=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x = (x - x.mean(0)) / x.std(0)
    t = (x @ rng.normal(size=(p, k)) + rng.gumbel(size=(n, k))).argmax(1)
    return x, np.eye(k)[t], t, np.c_[np.ones(n), x]


def shares(z, w):
    e = np.exp(z @ w - (z @ w).max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def test_minimise_quadratics_and_a_bent_valley():
    a = np.array([1.0, 30.0, 1000.0])
    got = minimise(lambda w, which: ((0.5 * a[which, None] * (w - 1) ** 2).sum(1), a[which, None] * (w - 1)), np.zeros((3, 4)))
    assert np.allclose(got, 1, atol=1e-6)

    def bent(w, which):
        x, y = w.T
        return (1 - x) ** 2 + 100 * (y - x * x) ** 2, np.stack([-2 * (1 - x) - 400 * x * (y - x * x), 200 * (y - x * x)], 1)

    assert np.allclose(minimise(bent, np.array([[-1.2, 1.0], [0.0, 0.0], [2.0, -3.0]])), 1, atol=1e-4)
    assert minimise(bent, np.zeros((0, 2))).shape == (0, 2)


@pytest.mark.parametrize("strength", [0.01, 1.0, 100.0])
def test_logistic_optimum(strength):
    x, y, _, z = problem()
    use = np.random.default_rng(2).uniform(0.5, 2, (2, len(x)))
    for w, u in zip(D.logistic(x, y, use, np.full(2, strength)), use, strict=True):
        g = strength * z.T @ (u[:, None] * (shares(z, w) - y))
        g[1:] += w[1:]
        assert np.abs(g).max() < 1e-4 * max(1, strength)


@pytest.mark.parametrize("strength,mix", [(0.05, 0.5), (1.0, 0.2), (0.5, 1.0), (1.0, 0.0)])
def test_elastic_optimum(strength, mix):
    x, y, _, z = problem()
    w = D.elastic(x, y, np.ones((1, len(x))), np.array([strength]), np.array([mix]))[0]
    g = strength * z.T @ (shares(z, w) - y)
    g[1:] += (1 - mix) * w[1:]
    zero = w[1:] == 0
    assert np.abs(g[0]).max() < 1e-4 and np.abs((g[1:] + mix * np.sign(w[1:]))[~zero]).max() < 1e-4 and (np.abs(g[1:][zero]) <= mix + 1e-4).all()
    if mix == 0:
        assert np.allclose(w, D.logistic(x, y, np.ones((1, len(x))), np.array([strength]))[0], atol=1e-4)


def test_squared_hinge_optimum():
    x, y, _, z = problem()
    w = D.squared_hinge(x, y, np.ones((1, len(x))), np.array([2.0]))[0]
    s = 2 * y - 1
    assert np.abs(-4 * z.T @ (s * np.maximum(0, 1 - s * (z @ w))) + w).max() < 1e-3


def test_discriminant_splits_where_densities_are_equal():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(20_000, 2)) + [2, 0], rng.normal(size=(20_000, 2)) - [2, 0]])
    y = np.repeat(np.eye(2), 20_000, 0)
    w = D.discriminant(x, y, np.ones(len(x)))
    slope = w[1:, 0] - w[1:, 1]
    assert np.allclose(slope, [4, 0], atol=0.15) and abs(w[0, 0] - w[0, 1]) < 0.2


def test_decode_learns_and_gives_reasons(spark):
    x, _, t, _ = problem(3, 240, 4)
    rows = [("a", str(k), v.tolist(), i % 4) for i, (k, v) in enumerate(zip(t, x, strict=True))]
    rows += [("b", "0", [float(i), 0.0, 0.0, 0.0], i % 2) for i in range(8)] + [("c", "1", [1.0, 2.0, 3.0, 4.0], 0)] + [("a", None, [1.0] * 4, 0), ("a", "1", None, 0), ("a", "1", [None, 1.0, 1.0, 1.0], 0), (None, "1", [1.0] * 4, 0), ("a", "1", [1.0] * 4, None)]
    df = spark.createDataFrame(rows, "u string, y string, x array<double>, f int")
    models = (D.Model("l2", "logistic", (0.01, 1.0)), D.Model("free", "free"), D.Model("en", "elastic", (0.1, 1.0), (0.0, 0.5)), D.Model("svm", "svm", (0.1, 1.0)), D.Model("lda", "lda"))
    out = D.decode(df, "u", "y", "x", "f", models).collect()
    assert len(out) == 5 * (4 + 2 + 1)
    for r in out:
        if r.unit == "a":
            assert r.n_train + r.n_test == 240 and r.balanced > 0.55 and len(r.coefficients) == 15
            again = np.flatnonzero(np.arange(240) % 4 != r.fold)
            v = (x - x[again].mean(0)) / x[again].std(0)
            guess = (v @ np.array(r.coefficients).reshape(5, 3)[1:] + np.array(r.coefficients).reshape(5, 3)[0]).argmax(1)
            test = np.arange(240) % 4 == r.fold
            assert abs((guess == t)[test].mean() - r.accuracy) < 1e-9
        else:
            assert r.balanced is None and r.drop_reason == "one class in training"
    assert D.decode(df.filter("false"), "u", "y", "x", "f", models).collect() == []


def test_cross_decode_finds_shared_and_separate_codes(spark):
    rng = np.random.default_rng(5)
    rows = []
    for unit, turn in (("shared", 1), ("turned", -1)):
        for i in range(240):
            y, c = i % 2, i // 2 % 2
            x = rng.normal(size=3) + (2 * y - 1) * np.array([1.5, 0, 0]) * (1 if c == 0 else turn)
            rows.append((unit, str(y), x.tolist(), c, i % 5, i))
    rows += [("lone", "1", [1.0, 1.0, 1.0], i % 2, i, i) for i in range(6)]
    df = spark.createDataFrame(rows, "u string, y string, x array<double>, c int, f int, o int")
    out = {r.unit: r for r in D.cross_decode(df, "u", "y", "x", "c", "f", "o", (D.Model("l2", "logistic", (0.01, 1.0)),), permutations=19, chunk=6).collect()}
    assert out["shared"].across > 0.85 and out["shared"].p == 0.05 and out["shared"].ceiling_0 > 0.85
    assert out["turned"].across < 0.15 and out["turned"].p == 1.0 and out["turned"].ceiling_1 > 0.85
    assert out["lone"].across is None and out["lone"].p is None


def test_hash_permutation_is_one():
    keys = [str(i) for i in range(50)]
    a, b = D.hash_permutation(keys, "1"), D.hash_permutation(keys, "2")
    assert sorted(a) == list(range(50)) and list(a) != list(b) and list(a) == list(D.hash_permutation(keys, "1"))


def test_equal_rows_are_counted_before_they_reach_a_task(spark):
    rng = np.random.default_rng(5)
    n = 3000
    x = rng.integers(0, 2, n).astype(float)
    pdf = pd.DataFrame({"u": "s", "y": (rng.random(n) < 0.3 + 0.4 * x).astype(int), "c": rng.integers(0, 2, n), "f": np.arange(n) % 3, "o": np.arange(n), "x": [[float(v)] for v in x]})
    rows = spark.createDataFrame(pdf)
    out = D.cross_decode(rows, "u", "y", "x", "c", "f", "o", (D.Model("free", "free"),), permutations=3, chunk=2).collect()
    assert len(out) == 1 and out[0]["n"] == n and out[0]["p"] == 0.25
    plain = D.decode(rows, "u", "y", "x", "f", (D.Model("free", "free"), D.Model("lda", "lda", balanced=False)), order="o").toPandas().sort_values(["model", "fold"])
    counted = D.decode(rows, "u", "y", "x", "f", (D.Model("free", "free"), D.Model("lda", "lda", balanced=False))).toPandas().sort_values(["model", "fold"])
    assert plain["n_train"].tolist() == counted["n_train"].tolist() and np.allclose(plain["balanced"].tolist(), counted["balanced"].tolist())
    assert np.allclose(np.stack(plain["coefficients"]), np.stack(counted["coefficients"]), atol=1e-5)
    assert D._counted(D._own(rows, unit=rows.u, y=rows.y.cast("string"), x=rows.x, f=rows.f), "unit", "y", "x", "f").count() <= 12


def test_large_cells_are_put_in_order_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(D, "_STRETCH", 100)
    monkeypatch.setattr(D, "_HELD", 250)
    rng = np.random.default_rng(7)
    n = 1800
    pdf = pd.DataFrame({"unit": rng.integers(0, 2, n).astype(str), "c": rng.integers(0, 2, n), "o": rng.permutation(n) * 3, "y": rng.integers(0, 3, n).astype(str), "x": [[float(v), float(v > 1)] for v in rng.integers(0, 4, n)]})
    rows = spark.createDataFrame(pdf).selectExpr("unit", "cast(c as int) as c", "o", "y", "x")
    laid = rows.repartitionByRange(3, "o").sortWithinPartitions("unit", "c", "o").selectExpr("*", "spark_partition_id() as p").persist()
    got = {(r.unit, r.q, r.c, tuple(r.x), r.y): r.t for r in D._shuffled_cells(laid, 3, 2, n // 4).collect()}
    want = {}
    for (unit, c), cell in pdf.sort_values("o").groupby(["unit", "c"]):
        for q in range(3):
            order = D.hash_permutation([str(o) for o in cell["o"]], str(q))
            for x, y in zip(cell["x"], cell["y"].to_numpy()[order], strict=True):
                key = (unit, q, c, tuple(x), y)
                want[key] = want.get(key, 0) + 1
    assert got == want
    whole, cut = (D.cross_decode(rows.selectExpr("*", "cast(o % 3 as int) as f"), "unit", "y", "x", "c", "f", "o", (D.Model("free", "free"),), permutations=3, chunk=2, window=w).toPandas().sort_values("unit").reset_index(drop=True) for w in (10**6, 10))
    pd.testing.assert_frame_equal(whole, cut)
