"""Reliability of fitted coefficients (survey 2.16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reliability
from ..operators.tables import r6, table
from ..registry import query

_CATEGORIES = 5


def _lines(spark, d):
    """Pieces of each supplier's lines as counts, with a category of the order as indicators and three conditions by line number."""
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.sum(F.floor("l_quantity")).alias("y"))
    kind = F.when(F.col("l_linenumber") == 1, "first").when(F.col("l_linenumber") <= 3, "second").otherwise("third")
    return rows.select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "y", kind.alias("c"), *((F.col("l_orderkey") % _CATEGORIES == k).cast("double").alias(f"k{k}") for k in range(1, _CATEGORIES)))


_FEATURES = [f"k{k}" for k in range(1, _CATEGORIES)]
_ROWS = """r as (select l_suppkey as u, l_orderkey * 10 + l_linenumber as id, sum(floor(l_quantity)) as y, case when l_linenumber = 1 then 'first' when l_linenumber <= 3 then 'second' else 'third' end as c, l_orderkey % 5 as k from lineitem group by l_suppkey, l_orderkey, l_linenumber),
 e as (select *, row_number() over (partition by u, c order by id) as i, count(*) over (partition by u, c) as n from r qualify n >= 10)"""


def _betas(source: str, group: str) -> str:
    """SQL for coefficients without penalty on standardised indicators: log rates against the first category, times the indicator's deviation."""
    return (
        f"select {group}, k, ln(m / any_value(m) filter (where k = 0) over (partition by {group})) * sqrt(q * (1 - q)) as b from (select {group}, k, avg(y) as m, count(*) / sum(count(*)) over (partition by {group})::double as q from {source} group by {group}, k) qualify k > 0"
    ).replace("any_value(m) filter (where k = 0) over", "sum(case when k = 0 then m else 0 end) over")


_PAIRS = "x.c < y.c and x.u = y.u and x.k = y.k"


@query(f"""with {_ROWS}, b as ({_betas('e', 'u, c')}), o as (select x.u, x.c as a, y.c as b, corr(x.b, y.b) as r_cross from b x join b y on {_PAIRS} group by all),
 d as (select *, row_number() over (partition by u, c, w order by md5('rel:' || c || ':' || w || ':' || id), i) as j from e, range(12) t(w)), s as (select d.u, d.c, d.w, e.y, d.k from d join e on e.u = d.u and e.c = d.c and e.i = d.j),
 nb as ({_betas('s', 'u, c, w')}), n as (select x.u, x.c as a, y.c as b, y.w, corr(x.b, y.b) as r from b x join nb y on {_PAIRS} group by all),
 h as (select e.*, w, row_number() over (partition by u, c, w order by md5('rel:half:' || c || ':' || w || ':' || id), i) > n // 2 as half from e, range(12) t(w)), hb as ({_betas('h', 'u, c, w, half')}),
 hr as (select x.u, x.c, x.w, corr(x.b, y.b) as r from hb x join hb y on x.u = y.u and x.c = y.c and x.w = y.w and x.k = y.k and not x.half and y.half group by all), hm as (select u, c, avg(r) as half from hr group by all)
 select o.u::varchar as unit, o.a, o.b, round(any_value(r_cross), 4) as r_cross, round((1 + count(*) filter (where n.r >= r_cross - 1e-9)) / 13.0, 6) as p, round(avg(n.r), 4) as null_mean, round(any_value(ha.half), 4) as half_a, round(any_value(hb_.half), 4) as half_b,
 round(sqrt(greatest(2 * any_value(ha.half) / (1 + any_value(ha.half)), 0) * greatest(2 * any_value(hb_.half) / (1 + any_value(hb_.half)), 0)), 4) as ceiling
 from o join n on n.u = o.u and n.a = o.a and n.b = o.b join hm ha on ha.u = o.u and ha.c = o.a join hm hb_ on hb_.u = o.u and hb_.c = o.b group by o.u, o.a, o.b""")
def r1_r7_fitted_reliability(spark, d):
    """Fitted coefficients of three conditions, pair by pair, against permuted designs and half splits with refits; SQL has these fits as log rates of categories."""
    out = reliability.crossed(_lines(spark, d), "l_suppkey", "c", _FEATURES, "y", "id", 12, 12, reliability.Fits(alphas=(0.0,)), 6)
    r4 = lambda c: F.round(c, 4).alias(c)
    return out.select("unit", "a", "b", r4("r_cross"), r6(F.col("p")).alias("p"), *map(r4, ("null_mean", "half_a", "half_b", "ceiling")))


@query(f"""with {_ROWS}, b as ({_betas('e', 'u, c')}), n as (select u, count(*) filter (where c = 'first') as n_a, count(*) filter (where c = 'third') as n_b from (select distinct u, c, id from r) group by 1)
 select n.u::varchar as unit, n_a, n_b, round(1 - sum(x.b * y.b) / (sqrt(sum(x.b * x.b)) * sqrt(sum(y.b * y.b))), 5) as distance from n join b x on x.u = n.u and x.c = 'first' join b y on y.u = n.u and y.c = 'third' and y.k = x.k group by n.u, n_a, n_b""")
def g1c_cluster_distances(spark, d):
    """Cosine distance of the coefficients of two conditions inside each cluster (here a supplier), with the rows of both."""
    rows = _lines(spark, d).filter("c <> 'second'").withColumn("all", F.lit("all"))
    out = reliability.cluster_distances(rows, "all", "l_suppkey", "c", _FEATURES, "y", "id", reliability.Fits(alphas=(0.0,)))
    return out.filter("drop_reason is null").select(F.col("cluster").alias("unit"), "n_a", "n_b", F.round("distance", 5).alias("distance"))


@query()
def r6_residualised_reliability(spark, d):
    """Cross-correlation of coefficients of what is left of the counts after a model of the controls (Pearson residuals), penalties by folds."""
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.sum(F.floor("l_quantity")).alias("y"), F.avg("l_discount").alias("x1"), F.avg("l_tax").alias("x2"), F.avg("l_extendedprice").alias("x3"), (F.min("l_partkey") % 7).cast("double").alias("x4"))
    rows = rows.select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "y", (F.col("l_linenumber") <= 3).cast("string").alias("c"), (F.col("x1") * 20).alias("x1"), (F.col("x2") * 20).alias("x2"), (F.col("x3") / 50000).alias("x3"), "x4")
    out = reliability.crossed(rows, "l_suppkey", "c", ["x2", "x3", "x4"], "y", "id", 50, 50, reliability.Fits("gaussian", (1.0, 10.0, 100.0)), 50, ("x1",), 6)
    return out.select("unit", "a", "b", "n_a", "n_b", *(F.round(c, 4).alias(c) for c in ("r_cross", "p", "half_a", "half_b", "ceiling", "ceiling_low", "ceiling_high")))


@query()
def r8_learning_curve(spark, d):
    """How alike coefficients of disjoint subsets are as these grow, against permuted designs."""
    out = reliability.learning_curve(_lines(spark, d), "l_suppkey", "c", _FEATURES, "y", "id", (10, 20, 40), 20, reliability.Fits(alphas=(1.0,)))
    return out.select("unit", "condition", "available", "size", *(F.round(c, 4).alias(c) for c in ("cosine", "null_cosine", "excess", "relative_variance")))


BINS = 3
_DISTANCES = """l as (select vec_id, label, (vec_id % 2)::int as c, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), m as (select c, i, avg(x) as m from l group by all),
 d as (select l.vec_id, any_value(l.label) as label, l.c, 1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) as dist from l join m on m.i = l.i and m.c = 1 - l.c group by l.vec_id, l.c),
 q as (select c, [quantile_cont(dist, 0.0), quantile_cont(dist, 1 / 3.0::double), quantile_cont(dist, 2 / 3.0::double)] as e from d group by 1),
 bins as (select d.*, case when dist >= e[3] then 2 when dist >= e[2] then 1 else 0 end as bin from d join q using (c))"""


def _binned(spark, d):
    """Vectors of two conditions (odd and even) with their distance to the other condition's mean, in bins of it."""
    v = table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 2).cast("int").alias("c"), F.col("embedding").cast("array<double>").alias("v"))
    means = v.groupBy("c").agg(F.array(*(F.avg(F.get("v", F.lit(i))) for i in range(64))).alias("m")).select((1 - F.col("c")).alias("c"), "m")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    at = v.join(F.broadcast(means), "c").withColumn("dist", 1 - dot("v", "m") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("m", "m"))))  # two rows
    edges = at.groupBy("c").agg(*(F.percentile("dist", F.lit(k / BINS)).alias(f"e{k}") for k in range(1, BINS)))
    return at.join(F.broadcast(edges), "c").select("vec_id", "label", "c", "dist", sum(((F.col("dist") >= F.col(f"e{k}")).cast("int") for k in range(1, BINS)), F.lit(0)).alias("bin"))


@query(f"with {_DISTANCES} select bin::int as bin, c, count(*) as n, round(avg(dist), 6) as distance, sum(vec_id)::bigint as ids from bins group by all")
def r9_cosine_bins(spark, d):
    """Vectors in quantile bins of their cosine distance to the other condition's mean."""
    return _binned(spark, d).groupBy("bin", "c").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("dist")).alias("distance"), F.sum("vec_id").alias("ids"))


@query(f"""with {_DISTANCES}, r as (select bin as u, vec_id as id, label + 1 as y, c, (vec_id // 2) % 4 as k from bins), b as ({_betas('r', 'u, c')})
 select x.u::varchar as bin, round(corr(x.b, y.b), 4) as r_cross from b x join b y on x.u = y.u and x.k = y.k and x.c < y.c group by 1""")
def r9_bin_reliability(spark, d):
    """Cross-correlation of both conditions' fitted coefficients in each bin."""
    kinds = [F.when(F.floor(F.col("vec_id") / 2) % 4 == k, 1.0).otherwise(0.0).alias(f"k{k}") for k in range(1, 4)]
    rows = _binned(spark, d).select("bin", "c", "vec_id", (F.col("label") + 1).alias("y"), *kinds)
    out = reliability.crossed(rows, "bin", "c", ["k1", "k2", "k3"], "y", "vec_id", 20, 20, reliability.Fits(alphas=(0.0,)))
    return out.select(F.col("unit").alias("bin"), F.round("r_cross", 4).alias("r_cross"))
