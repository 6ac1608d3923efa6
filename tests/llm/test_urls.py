"""URL templates against a plain tree."""

import random
import sys
import time

import brute
import pytest
from lumengrid.llm import urls


def pages(spark, rows):
    return spark.createDataFrame([(h, list(s), g) for h, s, g in rows], "host string, shape array<string>, good int")


def counted(rows):
    out = {}
    for h, s, g in rows:
        c = out.setdefault((h, tuple(s)), [0.0, 0])
        if g is not None:
            c[0], c[1] = c[0] + g, c[1] + 1
    return out


def got(df, cfg=urls.Templates()):
    return {(r.host, tuple(r.shape)): (r.template, r.purity) for r in urls.templates(df, cfg).collect()}


def same(a, b):
    assert set(a) == set(b)
    for k, (name, pure) in b.items():
        assert a[k][0] == name and abs(a[k][1] - pure) < 1e-9, k


@pytest.mark.parametrize("seed,branches", [(0, 20), (1, 3), (2, 2), (3, 5)])
def test_templates_equal_a_plain_tree(spark, seed, branches):
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        host, depth = rng.choice(["hot", "hot", "hot", "b", ""]), rng.choice([0, 1, 2, 2, 3, 5])
        shape = [rng.choice("abcdef"[: 2 + 2 * (k < 2)]) for k in range(depth)]
        rows.append((host, shape, None if rng.random() < 0.2 else int(rng.random() < (0.9 if shape[:1] in (["a"], ["b"]) else 0.3))))
    same(got(pages(spark, rows), urls.Templates(branches=branches)), brute.url_templates(counted(rows), branches))


def test_small_steps_do_not_chain(spark):
    rows = [("c.net", [f"b{k:02}", "x"], int(i < 100 * k / 15)) for k in range(16) for i in range(100)]
    out = got(pages(spark, rows))
    same(out, brute.url_templates(counted(rows)))
    assert len({t for t, _ in out.values()}) >= 4
    assert out["c.net", ("b00", "x")][1] < 0.2 and out["c.net", ("b15", "x")][1] > 0.8
    verdicts = {r.shape[0]: r.reject for r in urls.templates(pages(spark, rows)).collect()}
    assert verdicts["b00"] and verdicts["b04"] and not verdicts["b12"] and not verdicts["b15"]


def test_ties_and_two_clear_groups(spark):
    rows = [("t.net", [name, "x"], g) for name, share in zip("abcdef", (0.1, 0.9, 0.1, 0.9, 0.1, 0.9), strict=True) for i in range(50) for g in [int(i < 50 * share)]]
    out = got(pages(spark, rows))
    same(out, brute.url_templates(counted(rows)))
    assert {t for t, _ in out.values()} == {"/a//c//e/x", "/b//d//f/x"}


def test_very_deep_shared_paths(spark):
    sys.setrecursionlimit(20_000)  # the plain tree goes down one call a segment
    deep = [f"s{i % 7}" for i in range(2000)]
    rows = [("trap.net", [*deep, "x"], 1), ("trap.net", [*deep, "y"], 0), ("trap.net", deep, 1), ("trap.net", deep[:1000], None), ("other.net", ["q"], 1)]
    began = time.time()
    out = got(pages(spark, rows))
    assert time.time() - began < 60
    same(out, brute.url_templates(counted(rows)))
