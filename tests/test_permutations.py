"""Many hash permutations at once, and fits of rows out of their order."""

import numpy as np
import pandas as pd
import pytest

from lumengrid.operators import reliability as R
from lumengrid.operators.decoders import hash_permutation, hash_permutations


@pytest.mark.parametrize("keys", [[], ["7"], [str(k * k) for k in range(300)], ["é" * k + str(k) for k in range(20)], ["x" * 90, "y"], ["same", "same", "other"]])
def test_permutations_together_are_the_same(keys):
    seeds = ["rel:true:3", "rel:half:c:11", ""]
    for got, seed in zip(hash_permutations(keys, seeds), seeds, strict=True):
        assert got.tolist() == hash_permutation(keys, seed).tolist()


@pytest.mark.parametrize("null", ["rows", "responses"])
@pytest.mark.parametrize("link", ["gaussian", "poisson"])
def test_shuffled_fits_are_fits_of_shuffled_rows(null, link):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 3)) + 2, rng.poisson(3, 40).astype(float)
    x[:, 2] = 1.0
    cfg = R.Fits(link, (1.0,), null=null)
    s = R._Sides(pd.DataFrame(x, columns=["a", "b", "c"]).assign(_c="k", _y=y, _o=range(40)), ["a", "b", "c"], cfg)
    orders = [hash_permutation(s.keys["k"], f"rel:k:{i}") for i in range(4)]
    want = [R.coefficients((x[o] if null == "rows" else x)[None], (y if null == "rows" else y[o])[None], 1.0, link)[0] for o in orders]
    assert np.allclose(s.shuffled("k", 1.0, cfg, range(4)), want, atol=1e-8)


def test_only_sides_that_are_permuted_are_fitted_again(spark):
    df = spark.createDataFrame([("u", c, i + 100 * ord(c), float(i % 3), float(i % 5)) for c in "ab" for i in range(30)], "u string, c string, i long, x double, y double")
    for side in ("first", "second", "both"):
        r = R.crossed(df, "u", "c", ["x"], "y", "i", 5, 5, R.Fits("gaussian", (1.0,), side=side)).collect()
        assert len(r) == 1 and r[0].n_a == r[0].n_b == 30
