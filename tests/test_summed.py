"""Units fitted from sums over blocks have the fits of one task."""

import numpy as np
import pytest

from lumengrid.operators import decoders, summed

MODELS = (
    decoders.Model("logistic", "logistic", (0.01, 1.0)),
    decoders.Model("plain", "logistic", (0.1,), balanced=False),
    decoders.Model("free", "free"),
    decoders.Model("elastic", "elastic", (0.01, 0.1), (0.0, 0.5)),
    decoders.Model("svm", "svm", (0.01, 1.0)),
    decoders.Model("lda", "lda", balanced=False),
    decoders.Model("level", "lda"),
)


def test_sums_over_blocks_give_the_fits_of_one_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    y = rng.choice(3, 420, p=(0.5, 0.3, 0.2))
    x = rng.normal(size=(420, 4)) * (1, 3, 0.1, 1) + np.stack([y, -y, 0 * y, y % 2], 1) + 7
    x[:, 2] = 4.0
    rows = [("a", int(i), f"c{k}", [float(v) for v in row], int(i % 3)) for i, (k, row) in enumerate(zip(y, x, strict=True))]
    # one class alone outside fold 1, and a small unit beside
    rows += [("b", 1000 + i, "c0" if i % 2 or i % 3 else "c1", [float(i % 7)], 1 if i % 2 == 0 else 2) for i in range(400)] + [("c", 2000 + i, f"c{i % 2}", [float(i % 5)], i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "u string, id long, y string, x array<double>, f int")
    seen = []
    monkeypatch.setattr(summed, "decode", lambda own, unit, *a, f=summed.decode: seen.append(unit) or f(own, unit, *a))
    at = lambda large: {(r.unit, r.model, r.fold): r for r in decoders.decode(df, "u", "y", "x", "f", MODELS, "id", large).collect()}
    one, many = at(10**6), at(100)
    assert seen == ["a", "b"] and one.keys() == many.keys()
    for key, r in one.items():
        s = many[key]
        assert (r.n_train, r.n_test, r.strength, r.mix, r.drop_reason) == (s.n_train, s.n_test, s.strength, s.mix, s.drop_reason), key
        assert (r.accuracy, r.balanced) == pytest.approx((s.accuracy, s.balanced)) if r.drop_reason is None else s.accuracy is None, key
        if r.drop_reason is None:
            a, b = (np.array(v.coefficients).reshape(-1, 3 if r.unit == "a" else 2) for v in (r, s))
            # a number added to all classes changes no decoder
            a, b = (v if r.model in ("svm", "lda", "level") else v - v.mean(1, keepdims=True) for v in (a, b))
            assert np.allclose(a, b, atol=2e-4 * max(1, np.abs(a).max())), (key, np.abs(a - b).max())
