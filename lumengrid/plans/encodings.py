"""Encoding models with penalties by inner folds and refitted nulls, weighted residuals, and degrees of freedom (survey 2.11, 2.12, 2.14)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import encoding, nested, weighted
from ..operators.tables import r6
from ..registry import query
from .models import _responses

_BINS = """e as (select user_id, floor((epoch_us(ts)) / 21600000000) as bin, count(*) as y, avg(value) as level from events group by all),
 r as (select user_id as u, y, (level > 50)::int as x, row_number() over (partition by user_id order by bin) - 1 as i, count(*) over (partition by user_id) as n from e),
 d as (select *, (case when i < (n % 4) * (n // 4 + 1) then i // (n // 4 + 1) else n % 4 + (i - (n % 4) * (n // 4 + 1)) // greatest(n // 4, 1) end)::int as f from r where n >= 12)"""


@query(f"""with {_BINS}, live as (select u from d group by 1 having stddev_pop(y) > 0 and count(distinct f) >= 3), s as (select d.* from d join live using (u)),
 m as (select u, avg(y) as m, any_value(n) as n from s group by 1),
 c as (select m.u, k.k, sum((a.y - m.m) * (b.y - m.m)) as c from m, lateral (select unnest(range(1, m.n // 2 + 1)) as k) k join s a on a.u = m.u join s b on b.u = m.u and b.i = a.i + k.k group by 1, 2),
 tau as (select m.u, any_value(m.n) as n, coalesce(min(c.k) filter (where c.c < -1e-9), any_value(m.n // 2)) as tau from m left join c using (u) group by 1),
 lo as (select *, greatest(tau, n // 8, 1) as lo from tau),
 p as (select u, 0 as q, 0 as lag from lo union all select u, q, case when n - lo <= lo then greatest(1, n // 2) else lo + ('0x' || substr(md5('m16:' || u || ':' || (q - 1)), 1, 7))::bigint % (n - 2 * lo) end from lo, range(1, 41) t(q)),
 z as (select p.u, p.q, a.f, a.y, b.x from p join s a on a.u = p.u join s b on b.u = p.u and b.i = (a.i - p.lag + 40 * a.n) % a.n),
 g as (select u, q, f, x, sum(y) as y, count(*) as n from z group by all), t as (select u, q, x, sum(y) as y, sum(n) as n from g group by all),
 o as (select u, sum(y) as y, count(*) as n, f from s group by u, f), w as (select u, sum(y) as y, sum(n) as n from o group by 1),
 rate as (select t.u, t.q, t.x, o.f, coalesce((t.y - coalesce(g.y, 0)) / nullif(t.n - coalesce(g.n, 0), 0)::double, (w.y - o.y) / (w.n - o.n)::double) as mu from t join o on o.u = t.u join w on w.u = t.u left join g on g.u = t.u and g.q = t.q and g.x = t.x and g.f = o.f),
 ll as (select z.u, z.q, sum(z.y * ln(mu) - mu - lgamma(z.y + 1)) as ll from z join rate r on r.u = z.u and r.q = z.q and r.x = z.x and r.f = z.f group by 1, 2),
 null_ as (select s.u, sum(s.y * ln((w.y - o.y) / (w.n - o.n)::double) - (w.y - o.y) / (w.n - o.n)::double - lgamma(s.y + 1)) as ll_null from s join o on o.u = s.u and o.f = s.f join w on w.u = s.u group by 1),
 real as (select * from ll where q = 0), seen as (select real.u, count(*) filter (where ll.ll >= real.ll - 1e-7 * (1 + abs(real.ll))) as better from real join ll on ll.u = real.u and ll.q > 0 group by 1)
 select real.u::varchar as unit, tau.n, tau.tau::int as tau, round(real.ll, 4) as ll, round(ll_null, 4) as ll_null, round(case when ll_null < -0.1 then 1 - real.ll / ll_null end, 6) as r2, round((1 + better) / 41.0, 6) as p_perm
 from real join tau using (u) join null_ using (u) join seen using (u)""")
def m16_nested_encoding(spark, d):
    """Fits of one binary feature without penalty, refitted over 40 circular shifts beyond each unit's timescale; SQL has these fits as rates, so the whole rule is compared."""
    rows = _responses(spark, d).withColumn("x", (F.col("level") > 50).cast("int"))
    out = encoding.encode(rows, "user_id", ["x"], "y", "log_exposure", "fold", "bin", (0.0,), 40, 20)
    return out.filter("ll is not null").select("unit", "n", "tau", F.round("ll", 4).alias("ll"), F.round("ll_null", 4).alias("ll_null"), r6(F.col("r2")).alias("r2"), r6(F.col("p_perm")).alias("p_perm"))


@query()
def m8_two_stage_encoding(spark, d):
    """Four features, penalties by inner folds from the strongest down, coarse and then fine, and 100 refitted shifts."""
    out = encoding.encode(_responses(spark, d), "user_id", ["level", "spread", "top", "phase"], "y", "log_exposure", "fold", "bin")
    return out.select("unit", "n", "tau", F.round("ll", 3).alias("ll"), F.round("ll_null", 3).alias("ll_null"), F.round("r2", 4).alias("r2"), "alpha", "permutations", r6(F.col("p_perm")).alias("p_perm"), "drop_reason")


_SCALED = f"""{_BINS.replace('avg(value) as level', 'avg(value) as level, max(value) as top').replace('(level > 50)::int as x,', '(level > 50)::int as x, top, ')},
 z as (select *, (x - avg(x) over ()) / stddev_pop(x) over () as c, (top - avg(top) over ()) / stddev_pop(top) over () as s, avg(y) over (partition by u, x) as w from d)"""


def _weighted(spark, d):
    """Bins of units with a control, a feature, and the unit's fitted rate on the control."""
    rows = _responses(spark, d).filter("n >= 12").withColumn("x", (F.col("level") > 50).cast("double"))
    m = rows.agg(*(f(c).alias(f"{k}{c}") for c in ("x", "top") for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scaled = lambda c: (F.col(c) - F.lit(m[f"m{c}"])) / F.lit(m[f"s{c}"])
    rows = rows.select("user_id", "i", "fold", "y", scaled("x").alias("c"), scaled("top").alias("s"))
    return weighted.fitted_rates(rows, "user_id", ["c"], "y", "w")


@query(f"""with {_SCALED}, b as (select t.u, t.f, sum(o.w * o.c * o.s) / (sum(o.w * o.c * o.c) + 2) as b from (select distinct u, f from z) t join z o on o.u = t.u and o.f <> t.f group by 1, 2)
 select z.u as user_id, z.i, round(w, 5) as rate, round(s - b * c, 5) as residual from z join b using (u, f)""")
def f11_weighted_residuals(spark, d):
    """a feature without what a ridge on a control explains, under each unit's fitted rates as weights; SQL has the rates of a binary control as means."""
    out = weighted.weighted_residuals(_weighted(spark, d), "user_id", "fold", ["c"], ["s"], "w", 2.0)
    return out.select("user_id", "i", F.round("w", 5).alias("rate"), (F.round("residual_s", 5) + 0.0).alias("residual"))


@query(f"""with {_SCALED}, b as (select u, sum(w * c * c) as p, sum(w * c * s) as q, sum(w * s * s) as r, sum(c * c) as lp, sum(c * s) as lq, sum(s * s) as lr from z group by 1)
 select u as user_id, round(2 - 3 * (p + r + 6) / ((p + 3) * (r + 3) - q * q), 6) as weighted, round(2 - 3 * (lp + lr + 6) / ((lp + 3) * (lr + 3) - lq * lq), 6) as linear from b""")
def m10_effective_freedom(spark, d):
    """Effective degrees of freedom of two features under a ridge, weighted by fitted rates and linear; the estimate by signs is compared in tests."""
    rows = _weighted(spark, d)
    one = weighted.effective_freedom(rows, "user_id", ["c", "s"], "w", 3.0).select("unit", r6(F.col("exact")).alias("weighted"))
    two = weighted.effective_freedom(rows, "user_id", ["c", "s"], None, 3.0).select("unit", r6(F.col("exact")).alias("linear"))
    return one.join(two, "unit").withColumnRenamed("unit", "user_id")


def _crossed(spark, d):
    """Bins of units by a category (level over 50) and a condition (odd bins), with folds in which every cell has its share; units with four rows in each cell at least."""
    rows = _responses(spark, d).withColumn("a", (F.col("level") > 50).cast("int")).withColumn("b", (F.pmod("bin", F.lit(2)) == 1).cast("int"))
    cell = Window.partitionBy("user_id", "a", "b")
    rows = rows.withColumn("fold", (F.row_number().over(cell.orderBy("bin")) - 1) % 3).withColumn("k", F.count(F.lit(1)).over(cell))
    least = rows.groupBy("user_id").agg(F.min("k").alias("k"), F.countDistinct("a", "b").alias("cells")).filter("k >= 4 and cells = 4").select("user_id")
    return rows.join(least, "user_id").select("user_id", "bin", "fold", "y", "a", "b", (F.col("a") * F.col("b")).alias("ab"))


_MODELS = nested.Models((), ("a", "b"), ("a", "b", "ab"))
_ONE = nested.Models((), ("a",), ("a", "b", "ab"))


@query("""with e as (select user_id as u, floor(epoch_us(ts) / 21600000000)::bigint as bin, count(*) as y, (avg(value) > 50)::int as a from events group by 1, 2), r as (select *, (bin % 2 + 2) % 2 as b from e),
 c as (select *, (row_number() over (partition by u, a, b order by bin) - 1) % 3 as f, count(*) over (partition by u, a, b) as k from r), ok as (select u from c group by 1 having min(k) >= 4 and count(distinct 2 * a + b) = 4 and stddev_pop(y) > 0), s as (select c.* from c join ok using (u)),
 m0 as (select t.u, t.f, avg(o.y) as mu from (select distinct u, f from s) t join s o on o.u = t.u and o.f <> t.f group by 1, 2), m1 as (select t.u, t.f, o.a, avg(o.y) as mu from (select distinct u, f from s) t join s o on o.u = t.u and o.f <> t.f group by 1, 2, 3),
 m2 as (select t.u, t.f, o.a, o.b, avg(o.y) as mu from (select distinct u, f from s) t join s o on o.u = t.u and o.f <> t.f group by 1, 2, 3, 4),
 l as (select s.u, s.f, count(*) as n, sum(s.y * ln(m0.mu) - m0.mu - lgamma(s.y + 1)) as l0, sum(s.y * ln(m1.mu) - m1.mu - lgamma(s.y + 1)) as l1, sum(s.y * ln(m2.mu) - m2.mu - lgamma(s.y + 1)) as l2
  from s join m0 using (u, f) join m1 using (u, f, a) join m2 using (u, f, a, b) group by 1, 2)
 select u::varchar as unit, sum(n)::bigint as n, round(sum(l0), 4) as ll_null, round(sum(l1), 4) as ll_reduced, round(sum(l2), 4) as ll_full, round(avg((l2 > l0 + 1e-6)::int), 4) as positive_folds, round(avg((l2 > l1 + 1e-6)::int), 4) as interaction_folds from l group by 1""")
def m13_nested_models(spark, d):
    """Null, category, and category by condition models without penalty in stratified folds; SQL has them as rates of cells."""
    out = nested.compare(_crossed(spark, d), "user_id", _ONE, "y", "fold", "bin", (0.0,))
    r4 = lambda c: F.round(c, 4).alias(c)
    return out.filter("drop_reason is null").select("unit", "n", *map(r4, ("ll_null", "ll_reduced", "ll_full", "positive_folds", "interaction_folds")))


@query()
def n17_reduced_bootstrap(spark, d):
    """The interaction's gain against 200 draws from each unit's fit without it, both models refitted to every draw."""
    out = nested.bootstrap(_crossed(spark, d), "user_id", _MODELS, "y", "fold", "bin")
    return out.select("unit", F.round("deviance", 3).alias("deviance"), "draws", r6(F.col("p")).alias("p"))
