"""Geometry of items in two conditions (survey 2.17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry
from ..operators.tables import r6, table
from ..registry import query

WIDTH = 64


def _items(spark, d):
    """Forty items for each of two groups of classes, each with vectors in two conditions."""
    v = table(spark, d, "embeddings").select(
        (F.col("label") % 2).alias("unit"), F.lpad((F.floor(F.col("vec_id") / 2) % 40).cast("string"), 2, "0").alias("item"), (F.col("vec_id") % 2).cast("int").alias("c"), "embedding"
    )
    return geometry.item_means(v, "unit", "item", "c", "embedding", WIDTH)


_ITEMS = """e as (select (label % 2)::varchar as unit, lpad(((vec_id // 2) % 40)::varchar, 2, '0') as item, (vec_id % 2)::int as c, embedding as v from embeddings),
 l as (select unit, item, c, generate_subscripts(v, 1) - 1 as i, unnest(v)::double as x from e), m as (select unit, item, i, avg(x) filter (where c = 0) as a, avg(x) filter (where c = 1) as b from l group by all),
 k as (select * from m where (unit, item) not in (select (unit, item) from m where a is null or b is null))"""


@query(f"""with {_ITEMS}, s as (select unit, item, i, a / sqrt(sum(a * a) over (partition by unit, item)) as a, b / sqrt(sum(b * b) over (partition by unit, item)) as b from k),
 z as (select unit, item, i, a - avg(a) over (partition by unit, i) as a, b - avg(b) over (partition by unit, i) as b from s),
 g as (select x.unit, x.item as p, y.item as q, sum(x.a * y.a) as a, sum(x.b * y.b) as b from z x join z y on x.unit = y.unit and x.i = y.i group by all)
 select unit, count(distinct p) as n_items, round(sum(a) filter (where p = q), 6) as trace_a, round(sum(b) filter (where p = q), 6) as trace_b,
 round((sum(a) filter (where p = q)) ** 2 / sum(a * a), 5) as participation_a, round((sum(b) filter (where p = q)) ** 2 / sum(b * b), 5) as participation_b from g group by 1""")
def x4_spectra(spark, d):
    """Traces and participation ratios of the centred cosines between items, from eigenvalues; SQL has them from the matrix itself."""
    out = geometry.subspaces(_items(spark, d), 1, 1)
    return out.select("unit", "n_items", r6(F.col("trace_a")).alias("trace_a"), r6(F.col("trace_b")).alias("trace_b"), F.round("participation_a", 5).alias("participation_a"), F.round("participation_b", 5).alias("participation_b"))


@query()
def x5_x6_x7_subspaces(spark, d):
    """X4 (dimensions that hold 95 %), X5, X6, X7: principal angles, alignment and rotation of whole vectors, against 200 permutations of items and 100 half splits of coordinates."""
    out = geometry.subspaces(_items(spark, d))
    r5 = lambda c: F.round(c, 5).alias(c)
    return out.select("unit", "k_a", "k_b", "k", F.transform("angles", lambda x: F.round(x, 3)).alias("angles"), *map(r5, ("a_by_b", "b_by_a", "align", "turn", "null_align", "null_turn", "half_a", "half_b", "p_align", "p_turn", "p_below_a", "p_below_b")), "drop_reason")


@query(f"""with {_ITEMS}, t(w) as (select unnest(range(10))), n as (select unit, count(distinct item) as n from k group by 1),
 o as (select unit, w, item, row_number() over (partition by unit, w order by md5('stability:' || w || ':' || item), item) as r from (select distinct unit, item from k), t),
 kept as (select o.* from o join n using (unit) where r <= greatest(3, ceil(0.8 * n))), c as (select w, ('0x' || substr(md5('stability:' || w || ':' || j), 1, 7))::bigint % 64 as i from t, range(64) j(j)),
 v as (select kept.unit, kept.w, kept.item, k.i, k.a, k.b, count(*) as times from kept join c using (w) join k on k.unit = kept.unit and k.item = kept.item and k.i = c.i group by all),
 s as (select *, sqrt(sum(times * a * a) over (partition by unit, w, item)) as na, sqrt(sum(times * b * b) over (partition by unit, w, item)) as nb from v),
 p as (select x.unit, x.w, x.item as p, y.item as q, 1 - sum(x.times * x.a * y.a) / any_value(x.na * y.na) as a, 1 - sum(x.times * x.b * y.b) / any_value(x.nb * y.nb) as b from s x join s y on x.unit = y.unit and x.w = y.w and x.i = y.i and x.item < y.item group by all)
 select unit, w::int as draw, round(corr(a, b), 5) as r from p group by all""")
def x3_stability(spark, d):
    """Correlation of both conditions' distances over ten subsets of items and coordinates; units that lack power are left out by the gate (their pairs are too few)."""
    items = _items(spark, d).persist()
    fine = geometry.gate(items, WIDTH).filter("drop_reason is null").select("unit")
    return geometry.stability(items.join(fine, "unit"), 10, chunk=5).withColumn("r", F.round("r", 5))


@query("""with m as (select label as item, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), c as (select item, i, avg(x) as x from m group by all),
 d as (select a.item as i, b.item as j, sum((a.x - b.x) ** 2) as s from c a join c b on a.i = b.i group by all), r as (select i, avg(s) as m from d group by 1)
 select i::int as item, round(m - (select avg(m) from r) / 2, 6) as squares from r""")
def x8_classical_scaling(spark, d):
    """Classes laid out by classical scaling of their distances in all dimensions; the squared length of each is known from the distances (SQL), tests rebuild these."""
    means = table(spark, d, "embeddings").groupBy("label").agg(F.array(*(F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(WIDTH))).alias("v"))
    other = means.select(F.col("label").alias("j"), F.col("v").alias("w"))
    square = F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = means.withColumnRenamed("label", "i").join(other, F.col("i") < F.col("j")).select("i", "j", F.sqrt(square).alias("d"))  # pairs of classes are what is scaled
    n = means.count()
    at, _ = geometry.classical_scaling(pairs, n - 1, extra=0)
    return at.select(F.col("item").cast("int").alias("item"), r6(F.aggregate("y", F.lit(0.0), lambda s, x: s + x * x)).alias("squares"))
