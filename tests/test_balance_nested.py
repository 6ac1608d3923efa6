import numpy as np
import pandas as pd
from lumengrid.operators import balance as B
from lumengrid.operators import nested as N


def test_tail_and_correction():
    assert abs(B.chi_square_tail(3.841458820694124, 1) - 0.05) < 1e-12 and abs(B.chi_square_tail(18.307038053275146, 10) - 0.05) < 1e-12 and abs(B.chi_square_tail(7.814727903251179, 3) - 0.05) < 1e-12
    assert B.chi_square_tail(0, 3) == 1 and B.chi_square_tail(5, 0) == 1
    p, residuals = B.independence([(12, 5), (3, 14)])  # 10.6 plain; 8.4 with the correction
    assert abs(p - 0.005) < 0.002 and residuals[0][0] > 0 > residuals[0][1]


def test_quotas_end_where_the_test_does():
    kept = B.quotas([(100, 20), (50, 50), (10, 90), (40, 45)])
    assert B.independence(kept)[0] >= 0.05 and kept[1] == (50, 50) and all(a <= x for (a, _), (x, _) in zip(kept, [(100, 0), (50, 0), (10, 0), (40, 0)], strict=True))
    assert B.quotas([(5, 5), (7, 7)]) == [(5, 5), (7, 7)] and B.quotas([]) == [] and B.quotas([(5, 0)]) == [(5, 0)]
    assert B.quotas([(500, 0), (0, 500)]) in ([(0, 0), (0, 500)], [(500, 0), (0, 0)])


def test_balanced_rows(spark):
    rows = [(i, "abc"[i % 3], int(i % 7 < (1, 3, 6)[i % 3])) for i in range(900)] + [(901, None, 1), (902, "a", 5), (903, "a", None)]
    df = spark.createDataFrame(rows, "id int, g string, c int").repartition(5)
    out = B.balanced(df, "g", "c", ["id"], "s").collect()
    counts = [(sum(r.g == g and r.c == 0 for r in out), sum(r.g == g and r.c == 1 for r in out)) for g in "abc"]
    first = [(sum(g == x and c == 0 for _, x, c in rows), sum(g == x and c == 1 for _, x, c in rows)) for g in "abc"]
    assert counts == B.quotas(first) and counts != first
    assert {(r.id, r.g, r.c) for r in out} <= set(rows)
    assert sorted(r.id for r in B.balanced(df.repartition(2), "g", "c", ["id"], "s").collect()) == sorted(r.id for r in out)
    assert B.balanced(df.filter("false"), "g", "c", ["id"], "s").collect() == []


MODELS = N.Models((), ("a", "b"), ("a", "b", "ab"))


def frame(spark, interaction, units, n=160):
    parts = []
    for u in range(units):
        rng = np.random.default_rng(1000 * interaction + u)
        a, b = rng.integers(0, 2, n), rng.integers(0, 2, n)
        y = rng.poisson(np.exp(0.8 + 0.4 * a - 0.3 * b + 0.1 * interaction * (a * b)))
        parts.append(pd.DataFrame({"u": f"{interaction}-{u}", "i": range(n), "f": np.arange(n) % 3, "a": a, "b": b, "ab": a * b, "y": y}))
    return spark.createDataFrame(pd.concat(parts))


def test_interaction_is_found_and_its_absence_is_calibrated(spark):
    p = {r.unit: r.p for r in N.bootstrap(frame(spark, 0, 60).unionByName(frame(spark, 12, 4)), "u", MODELS, "y", "f", "i", draws=99, chunk=40).collect()}
    null = [v for k, v in p.items() if k.startswith("0-")]
    # a calibrated test rejects about 3 of 60 at 5 %, and its p-values are spread evenly
    assert len(null) == 60 and sum(v <= 0.05 for v in null) <= 8 and 0.35 < np.mean(null) < 0.65
    assert all(v == 0.01 for k, v in p.items() if k.startswith("12-"))


def test_comparison_of_models(spark):
    df = frame(spark, 12, 3).unionByName(frame(spark, 0, 1, 8))
    out = {r.unit: r for r in N.compare(df, "u", MODELS, "y", "f", "i", (0.01, 1.0, 10.0)).collect()}
    assert all(out[f"12-{u}"].interaction > 0 and out[f"12-{u}"].positive_folds == 1 and out[f"12-{u}"].gain > out[f"12-{u}"].interaction for u in range(3))
    assert out["0-0"].ll_full is None and out["0-0"].drop_reason == "too few rows"
    assert N.compare(df.filter("false"), "u", MODELS, "y", "f", "i").collect() == [] and N.bootstrap(df.filter("u = '0-0'"), "u", MODELS, "y", "f", "i", draws=3).first().p is None


def test_modes_of_balancing(spark):
    rows = [(i, g, c) for g, n in (("a", (100, 60)), ("b", (40, 40)), ("c", (30, 90)), ("few", (50, 3)), (None, (9, 9))) for c in (0, 1) for i in range(n[c])]
    df = spark.createDataFrame(rows, "i int, g string, c int")
    want = {
        "cap": {"a": (40, "ratio_capped_to_40"), "b": (None, None), "c": (None, None)}, "hard": dict.fromkeys("abc", (30, "hard_balanced_to_30")),
        "soft": {"a": (40, "soft_balanced_to_40"), "b": (40, "soft_balanced_to_40"), "c": (30, "soft_balanced_to_30")}, "resample": dict.fromkeys("abc", (40, "soft_resampled_to_40")),
    }
    for mode, targets in want.items():
        t = B.cluster_targets(df, "g", "c", mode)
        got = {r.cluster: (r.target, r.drop_reason) for r in t.collect()}
        assert got == targets | {"few": (None, "fewer_than_10_on_a_side")}, mode
        out = B.sampled(df, "g", "c", ["i"], t, "s")
        counts = {(r.g, r.c): r["count"] for r in out.groupBy("g", "c").count().collect()}
        for g, (n, _) in targets.items():
            for c in (0, 1):
                own = sum(r[1] == g and r[2] == c for r in rows)
                assert counts[g, c] == (n if n is not None and (mode == "resample" or own > n) else own), (mode, g, c)
        named = B.manifest(out, ["i"], ["g", "c"])
        again, missing = B.replayed(df.repartition(3), named, ["i"], ["g", "c"])
        assert missing == 0 and sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    assert B.replayed(df.filter("i < 5"), named, ["i"], ["g", "c"])[1] > 0
    assert B.cluster_targets(df.filter("false"), "g", "c").collect() == []


def test_words_are_claimed_once(spark):
    df = spark.createDataFrame([(g, f"w{(g * 7 + i) % 20}") for g in range(4) for i in range(15)] + [(0, None), (None, "w1")], "g int, w string")
    out = B.claimed(df, "g", "w", 6, "s").collect()
    assert len({r.word for r in out}) == len(out) and [sum(r.group == g for r in out) for g in range(3)] == [6, 6, 6]
    assert B.claimed(df.filter("false"), "g", "w", 6, "s").collect() == []


def test_adjusted_p_values_of_many_ties(spark):
    from lumengrid.operators.ranks import benjamini_hochberg
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    p = np.concatenate([np.full(500, 0.001), rng.random(300), [0.0, 1.0, 1.0], rng.integers(1, 20, 200) / 20])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(5000, None)], "i int, p double").repartition(4)
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1].clip(max=1)
    want = dict(zip(order.tolist(), q.tolist(), strict=True))
    for buckets in (1, 7, 1024):
        got = {r.i: r.q for r in benjamini_hochberg(df, "p", out="q", buckets=buckets).select("i", F.col("q")).collect()}
        assert got.pop(5000) is None and max(abs(got[i] - want[i]) for i in want) < 1e-12
