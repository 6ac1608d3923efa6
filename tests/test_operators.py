import numpy as np
from lumengrid.operators.glm import encode_units, poisson_ridge
from lumengrid.operators.intervals import clip_windows, interval_join, nearest_gap, speaker_windows
from lumengrid.operators.ranks import average_rank, benjamini_hochberg, contiguous_fold
from pyspark.sql import functions as F


def test_interval_edges_and_bucket_crossing(spark):
    spans = spark.createDataFrame([(1, 10, 20), (2, 5, 5), (3, -7, 33)], "s int, b long, e long")
    points = spark.createDataFrame([(t,) for t in (9, 10, 19, 20, 21, -7, 33, -8)], "t long")
    for closed in (False, True):
        got = {(r.s, r.t) for r in interval_join(points, spans, "t", "b", "e", 8, closed=closed).select("s", "t").collect()}
        want = {(s, t) for s, b, e in [(1, 10, 20), (2, 5, 5), (3, -7, 33)] for t in (9, 10, 19, 20, 21, -7, 33, -8) if b <= t and (t <= e if closed else t < e)}
        assert got == want


def test_nearest_gap_ties_and_missing(spark):
    left = spark.createDataFrame([(1, 5, "a"), (2, 10, "a"), (3, 1, "b")], "id int, t long, k string")
    right = spark.createDataFrame([(0, "a"), (10, "a")], "p long, k string")
    got = {r.id: r.gap for r in nearest_gap(left, right, "t", "p", ("k",)).collect()}
    assert got == {1: 5, 2: 0, 3: None}


def test_clipped_windows_keep_rows_and_length(spark):
    w = spark.createDataFrame([(-20.0, -5.0), (95.0, 130.0), (50.0, 50.0)], "start double, end double")
    assert [tuple(r) for r in clip_windows(w, 100.0, 10.0).collect()] == [(0.0, 10.0), (90.0, 100.0), (50.0, 60.0)]


def test_ranks_and_false_discovery_with_ties(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.04, 0.9])], "i int, p double")
    assert [r.r for r in df.select(average_rank("p").alias("r")).orderBy("r").collect()] == [1.0, 2.5, 2.5, 4.0]
    q = {r.i: round(r.q, 6) for r in benjamini_hochberg(df, "p", "i").collect()}
    assert q == {0: 0.04, 1: round(0.16 / 3, 6), 2: round(0.16 / 3, 6), 3: 0.9}


def test_contiguous_folds(spark):
    df = spark.range(7).select(contiguous_fold(F.col("id"), F.lit(7), 3).alias("a"), contiguous_fold(F.col("id"), F.lit(7), 3, "last").alias("b"))
    rows = df.collect()
    assert [r.a for r in rows] == [0, 0, 0, 1, 1, 2, 2] and [r.b for r in rows] == [0, 0, 1, 1, 2, 2, 2]


def test_poisson_ridge_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    off = np.log(rng.uniform(0.5, 2, 300))
    y = rng.poisson(np.exp(x @ [0.4, -0.3, 0, 0.2] + 0.5 + off))
    w, b = poisson_ridge(x, y, 3.0, off)
    mu = np.exp(x @ w + b + off)
    assert np.abs(x.T @ (mu - y) + 3.0 * w).max() < 1e-5 and abs((mu - y).sum()) < 1e-5


def test_encoding_finds_signal_and_drops_constant_units(spark):
    rng = np.random.default_rng(2)
    rows = []
    for unit in range(3):
        x = rng.normal(size=80)
        y = rng.poisson(np.exp(1 + 0.8 * x)) if unit == 0 else rng.poisson(3, 80) if unit == 1 else np.zeros(80)
        rows += [(unit, i, i * 4 // 80, float(a), float(b), 0.0) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "u long, i long, fold int, x double, y double, off double")
    got = {r.u: r for r in encode_units(df, "u", ["x"], "y", "off", "fold", "i", permutations=19).collect()}
    assert got[0].p_perm == 0.05 and got[0].r2 > 0.1 and got[2].drop_reason


def test_speaker_windows_by_target_and_others(spark):
    words = spark.createDataFrame([(1, True, 100.0, 200.0), (2, False, 100.0, 200.0), (3, None, 100.0, 200.0), (4, True, 50.0, 40.0)], "id long, own boolean, onset double, offset double")
    run = lambda mode, **k: {r.id: (r.start, r.end) for r in speaker_windows(words, mode, F.col("own"), k, k).collect()}
    assert run("duration_shifted_window", shift=30) == {1: (70, 170), 2: (130, 230), 3: (130, 230)}
    assert run("target_vs_other") == {1: (-400, 100), 2: (100, 700), 3: (100, 700), 4: (-450, 50)}
    assert run("target_vs_other_fixed_window_from_ref", ref="offset", shift=5, length=10)[4] == (45, 55)
