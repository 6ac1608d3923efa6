"""Targets, draws and manifests of balanced samples, words claimed once, coefficients across folds, and whole timing and smoothing features (survey 2.11, 2.16)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import balance, reliability
from ..operators.tables import correlation, micros, r6, table
from ..registry import query
from .reliabilities import _FEATURES, _ROWS, _betas, _lines

LEAST = 20


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % (F.col("label") % 3 + 2) == 0).cast("int").alias("c"))


def _targets(mode: str, target: str, words: str) -> str:
    return f"""select '{mode}' as mode, label, n_0, n_1, case when fine is not null and coalesce({target} >= {LEAST}, true) then {target} end::bigint as target, fine is not null and coalesce({target} >= {LEAST}, true) as kept,
 case when fine is null then 'fewer_than_{LEAST}_on_a_side' when {target} < {LEAST} then 'balance_target_below_min_{LEAST}' when {target} is not null then '{words}' || ({target})::bigint end as drop_reason from f, l"""


_LEVELS = f"""e as (select vec_id, label, (vec_id % (label % 3 + 2) = 0)::int as c from embeddings), n as (select label, count(*) filter (where c = 0) as n_0, count(*) filter (where c = 1) as n_1, least(count(*) filter (where c = 0), count(*) filter (where c = 1)) as n from e group by 1),
 f as (select *, case when n >= {LEAST} then n end as fine from n), l as (select floor(quantile_cont(fine, 0.5)) as level, min(fine) as lowest from f)"""
_MODES = {
    "cap": ("case when n > floor(level * 0.9) then floor(level * 0.9) end", "ratio_capped_to_"), "hard": ("lowest", "hard_balanced_to_"), "soft": (f"least(n, greatest(level, {LEAST}))", "soft_balanced_to_"),
    "resample": (f"greatest(level, {LEAST})", "soft_resampled_to_"),
}


@query(f"with {_LEVELS} " + " union all ".join(_targets(m, t, w) for m, (t, w) in _MODES.items()))
def b2_cluster_targets(spark, d):
    """B2: how many rows of every class are used under each way of balancing two conditions, with the reasons."""
    out = None
    for mode in _MODES:
        one = balance.cluster_targets(_vectors(spark, d), "label", "c", mode, ratio=0.9, least=LEAST).select(F.lit(mode).alias("mode"), F.col("cluster").alias("label"), "n_0", "n_1", "target", "kept", "drop_reason")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with {_LEVELS}, t as ({_targets('resample', *_MODES['resample'])}), r as (select e.*, row_number() over (partition by label, c order by md5('b2:' || vec_id), vec_id) as r, count(*) over (partition by label, c) as own from e),
 k as (select r.*, t.target from r join t using (label) where kept), d as (select label, c, any_value(own) as own, any_value(target) as target from k where own < target group by 1, 2),
 g as (select label, c, i, ('0x' || substr(md5('b2-draw:' || label || ':' || c || ':' || i), 1, 7))::bigint % own + 1 as pick from d, lateral (select unnest(range(1, target + 1)) as i) x)
 select vec_id, r as draw from k where own >= target and r <= target union all select k.vec_id, g.i from g join k on k.label = g.label and k.c = g.c and k.r = g.pick""")
def b2_b8_resampled_rows(spark, d):
    """The rows of a sample in which each class has as many of both conditions, drawn again where it has fewer, named by a manifest and replayed from it."""
    v = _vectors(spark, d)
    targets = balance.cluster_targets(v, "label", "c", "resample", least=LEAST)
    named = balance.manifest(balance.sampled(v, "label", "c", ["vec_id"], targets, "b2"), ["vec_id"], ["label", "c"])
    rows, missing = balance.replayed(v, named, ["vec_id"], ["label", "c"])
    if missing:
        raise ValueError(f"{missing} entries of the manifest have no row")
    return rows.select("vec_id", "draw")


def _chosen(k: int) -> str:
    before = " union all ".join(["select null as word where false", *(f"select word from g{j}" for j in range(k))])
    return f"g{k} as (select g, word, row_number() over (order by md5('b10:' || word), word) as place from w where g = {k} and word not in ({before}) qualify place <= 15)"


@query(f"with w as (select distinct l_linenumber - 1 as g, 'w' || (l_partkey % 90) as word from lineitem where l_quantity > 30), {', '.join(map(_chosen, range(7)))} " + " union all ".join(f"select g + 1 as l_linenumber, word, place::int as place from g{k}" for k in range(7)))
def b10_words_claimed_once(spark, d):
    """Fifteen words of each group, none of which an earlier group has taken."""
    words = table(spark, d, "lineitem").filter("l_quantity > 30").select("l_linenumber", F.concat(F.lit("w"), F.col("l_partkey") % 90).alias("word"))
    return balance.claimed(words, "l_linenumber", "word", 15, "b10").withColumnRenamed("group", "l_linenumber")


@query(f"""with {_ROWS}, x as (select *, (row_number() over (partition by u, k order by id) - 1) % 4 as f from r where c = 'third'), t as (select x.*, g.g from x, range(4) g(g) where f <> g), b as ({_betas('t', 'u, g')}),
 p as (select a.u, a.g as i, z.g as j, corr(a.b, z.b) as r from b a join b z on a.u = z.u and a.k = z.k and a.g < z.g group by all)
 select u::varchar as unit, count(r) as pairs, round(avg(r), 5) as fold_corr from p group by 1""")
def r5_fold_coefficients(spark, d):
    """Mean correlation of the coefficients fitted without each fold, over all pairs of folds; each row is in three fits."""
    rows = _lines(spark, d).filter("c = 'third'")
    kind = F.coalesce(*(F.when(F.col(f) == 1, F.lit(f)) for f in _FEATURES), F.lit("none"))
    rows = rows.withColumn("fold", (F.row_number().over(Window.partitionBy("l_suppkey", kind).orderBy("id")) - 1) % 4)
    held = rows.withColumn("without", F.explode(F.sequence(F.lit(0), F.lit(3)))).filter("fold <> without")
    beta = reliability.observed(held, "l_suppkey", "without", _FEATURES, "y", "id", reliability.Fits(alphas=(0.0,))).select("unit", "condition", "beta")
    pairs = beta.join(beta.select("unit", F.col("condition").alias("other"), F.col("beta").alias("theirs")), "unit").filter("condition < other")
    each = pairs.select("unit", "condition", "other", F.explode(F.arrays_zip("beta", "theirs")).alias("z")).groupBy("unit", "condition", "other").agg(correlation("z.beta", "z.theirs").alias("r"))
    return each.groupBy("unit").agg(F.count("r").alias("pairs"), F.round(F.avg("r"), 5).alias("fold_corr"))


@query("""with e as (select event_id, epoch_us(ts) / 1e6 as s, lag(epoch_us(ts)) over o / 1e6 as p, lead(epoch_us(ts)) over o / 1e6 as n, min(epoch_us(ts)) over (partition by user_id) / 1e6 as first, value from events window o as (partition by user_id order by ts, event_id)),
 g as (select *, least(coalesce(s - p, n - s, 0), 86400) as before, least(coalesce(n - s, s - p, 0), 86400) as after, (s - first) / 86400 as t from e)
 select event_id, round(ln(1 + value), 6) as log_duration, round(ln(1 + before), 6) as log_gap_before, round(ln(1 + after), 6) as log_gap_after, round(t, 6) as session_time, round(t * t, 5) as session_time_squared from g""")
def f8_all_timing_nuisances(spark, d):
    """F8: log duration, log gaps to both neighbours (the other one at an end, a day at most), time in the session and its square."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value", (micros("ts") / F.lit(1e6)).alias("s"))
    before, after = F.col("s") - F.lag("s").over(order), F.lead("s").over(order) - F.col("s")
    e = e.select("event_id", "value", before.alias("b"), after.alias("a"), ((F.col("s") - F.min("s").over(Window.partitionBy("user_id"))) / 86400).alias("t"))
    clipped = lambda *c: F.least(F.coalesce(*c, F.lit(0.0)), F.lit(86400.0))
    return e.select(
        "event_id", r6(F.log(1 + F.col("value"))).alias("log_duration"), r6(F.log(1 + clipped("b", "a"))).alias("log_gap_before"), r6(F.log(1 + clipped("a", "b"))).alias("log_gap_after"),
        r6(F.col("t")).alias("session_time"), (F.round(F.col("t") * F.col("t"), 5) + 0.0).alias("session_time_squared"),
    )


#: Points of the smoothing window and degree of its polynomial.
POINTS, DEGREE = 15, 3


def end_weights(points: int = POINTS, degree: int = DEGREE) -> np.ndarray:
    """``(place, point)``: weights with which the fitted polynomial is read at each place of a window."""
    design = np.vander(np.arange(points) - points // 2, degree + 1).astype(float)
    return design @ np.linalg.pinv(design)


@query("""with e as (select user_id, event_id, value, row_number() over o - 1 as i, count(*) over (partition by user_id) as n from events window o as (partition by user_id order by ts, event_id)),
 w as (select user_id, event_id, i, n, greatest(least(i - 7, n - 15), 0) as low from e where n >= 15), p as (select w.user_id, w.event_id, w.i - w.low - 7.0 as at_, e.i - w.low - 7.0 as x, e.value as y from w join e on e.user_id = w.user_id and e.i between w.low and w.low + 14),
 s as (select event_id, any_value(at_) as a, sum(y) as y0, sum(x * y) as y1, sum(x * x * y) as y2, sum(x * x * x * y) as y3 from p group by 1),
 k as (select 15.0 as s0, 280.0 as s2, 9352.0 as s4, 369640.0 as s6)
 select event_id, round((s4 * y0 - s2 * y2) / (s0 * s4 - s2 * s2) + a * (s6 * y1 - s4 * y3) / (s2 * s6 - s4 * s4) + a * a * (s0 * y2 - s2 * y0) / (s0 * s4 - s2 * s2) + a * a * a * (s2 * y3 - s4 * y1) / (s2 * s6 - s4 * s4), 5) as smooth from s, k""")
def w15_smoothed_to_the_ends(spark, d):
    """Cubic smoothing over 15 points, near the ends read off the polynomial of the first or last 15; SQL fits the polynomial from its normal equations."""
    order, unit = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id")
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value", (F.row_number().over(order) - 1).alias("i"), F.count(F.lit(1)).over(unit).alias("n"))
    half, w = POINTS // 2, end_weights()
    # at most a window's length of neighbours on each side
    near = F.collect_list("value").over(order.rowsBetween(1 - POINTS, POINTS - 1))
    low = F.greatest(F.least(F.col("i") - half, F.col("n") - POINTS), F.lit(0))
    first = F.greatest(F.col("i") - (POINTS - 1), F.lit(0))  # the row that `near` begins with
    e = e.filter(F.col("n") >= POINTS).withColumn("near", near).select("event_id", F.slice("near", (low - first + 1).cast("int"), POINTS).alias("y"), (F.col("i") - low).cast("int").alias("at"))
    table_ = F.array(*(F.array(*map(F.lit, map(float, r))) for r in w))
    return e.select("event_id", F.round(F.aggregate(F.zip_with("y", F.get(table_, "at"), lambda x, k: x * k), F.lit(0.0), lambda s, x: s + x), 5).alias("smooth"))
