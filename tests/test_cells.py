import hashlib
import random

import numpy as np
from lumengrid.operators import cells
from pyspark.sql import functions as F


def points(spark):
    rng = np.random.default_rng(0)
    at = np.concatenate([rng.normal(size=(150, 2)) * 0.3 + c for c in ((0, 0), (5, 0), (0, 5))])
    return spark.createDataFrame([(i, float(a), float(b), 3.0) for i, (a, b) in enumerate(at)], "id int, a double, b double, same double")


def test_kmeans_finds_clouds_and_never_rises(spark):
    df = points(spark)
    # of these seeds one has its first centroids in three clouds
    fits = [cells.kmeans(df, ["a", "b", "same"], 3, ["id"], str(s)) for s in range(4)]
    for f in fits:
        assert all(x >= y - 1e-9 for x, y in zip(f.inertia, f.inertia[1:], strict=False))
    best = min(fits, key=lambda f: f.inertia[-1])
    found = {(r.id // 150, r.cell) for r in df.select("id", best.nearest().getField("cell").alias("cell")).collect()}
    assert len(found) == 3


def test_kmeans_equals_plain_rounds(spark):
    df = points(spark)
    f = cells.kmeans(df, ["a", "b"], 4, ["id"], "7", 6)
    x = np.array([[r.a, r.b] for r in df.orderBy("id").collect()])
    x = (x - x.mean(0)) / x.std(0)


    first = sorted(range(len(x)), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())[:4]
    c = x[first].copy()
    for _ in range(len(f.inertia)):
        d = ((x[:, None] - c) ** 2).sum(2)
        at = d.argmin(1)
        c = np.array([x[at == k].mean(0) if (at == k).any() else c[k] for k in range(4)])
    assert np.allclose(c, f.centroids, atol=1e-9) and abs(d.min(1).sum() - f.inertia[-1]) < 1e-9


def test_kmeans_of_few_rows_nulls_and_none(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 1.0), (None, 1.0, 1.0), (3, 2.0, 1.0)], "id int, a double, b double")
    f = cells.kmeans(df, ["a", "b"], 5, ["id"], "x")
    assert len(f.centroids) == 2 and f.inertia[-1] == 0.0
    assert cells.kmeans(df.filter("false"), ["a", "b"], 3, ["id"], "x").centroids == []


def test_numbers_and_shuffles_of_large_groups(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.random()) for i in range(3000)] + [(7, "hot", 0.5), (7, "hot", 0.5)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    out = cells.numbered(df, ["g"], F.md5(F.col("id").cast("string")), ["id", "v"], "at", 16).collect()
    for g in ("hot", "a", None):
        assert sorted(r["at"] for r in out if r.g == g) == list(range(1, sum(1 for r in rows if r[1] == g) + 1))
    drawn = cells.shuffled_inside(df, ["g"], ["id"], ["v"], "s").collect()
    assert len(drawn) == len(rows)
    for g in ("hot", "a", None):
        assert sorted(r.v for r in drawn if r.g == g) == sorted(r.drawn_v for r in drawn if r.g == g)
    assert sum(r.v != r.drawn_v for r in drawn) > 2900
    assert cells.shuffled_inside(df.filter("false"), ["g"], ["id"], ["v"], "s").collect() == []
