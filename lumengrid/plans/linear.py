"""Principal components, erasure, residuals, nested ridges and coefficients across conditions (survey 2.11, 2.12, 2.17)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import linear
from ..operators.ranks import shuffle_key
from ..operators.tables import correlation, r6, table
from ..registry import query

WIDTH = 64


def _hash_part(parts: int, seed: str, *keys: str):
    return (F.conv(F.substring(shuffle_key(seed, *keys), 1, 7), 16, 10).cast("long") % parts).alias("fold")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 4).alias("fold"), F.col("embedding").cast("array<double>").alias("v"))


_CENTRED = "select vec_id, i, x - avg(x) over (partition by i) as x from (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings)"


@query(f"select vec_id, round(sum(x * x), 4) as squares from ({_CENTRED}) group by 1")
def f2_all_components(spark, d):
    """all principal components; their squares add up to those of the centred row (SQL), their order and directions are tested apart."""
    v = _vectors(spark, d).select("vec_id", "v")
    scores = linear.applied(v, "v", WIDTH, {None: linear.principal(linear.moments(v, "v", WIDTH)[None], WIDTH)}, "scores")
    return scores.select("vec_id", F.round(F.aggregate("scores", F.lit(0.0), lambda s, y: s + y * y), 4).alias("squares"))


@query("select c as component, 0.0 as mean, 1.0 as variance from range(8) t(c)")
def f3_standardised_components(spark, d):
    """eight components of standardised columns, standardised again; each has mean 0 and variance 1."""
    v = _vectors(spark, d).select("v")
    scores = linear.applied(v, "v", WIDTH, {None: linear.principal(linear.moments(v, "v", WIDTH)[None], 8, True)}, "scores")
    return scores.select(F.posexplode("scores").alias("c", "y")).groupBy(F.col("c").cast("long").alias("component")).agg(r6(F.avg("y")).alias("mean"), r6(F.var_pop("y")).alias("variance"))


@query()
def f3_randomised_components(spark, d):
    """eight components of standardised columns by the randomised range finder; tests hold them against the exact ones."""
    v = _vectors(spark, d).select("vec_id", "v")
    scores = linear.applied(v, "v", WIDTH, {None: linear.leading(v, "v", WIDTH, 8, True)}, "scores")
    return scores.select("vec_id", F.transform("scores", lambda y: F.round(y, 4)).alias("scores"))


@query()
def f4_components_by_fold(spark, d):
    """standardise, reduce, standardise, fitted for each fold on the other folds' rows, from one pass of sums by fold."""
    v = _vectors(spark, d).select("vec_id", "fold", "v")
    parts = linear.moments(v, "v", WIDTH, "fold")
    every = sum(list(parts.values())[1:], list(parts.values())[0]) if parts else None
    maps = {k: linear.principal(every - m, 8, True) for k, m in parts.items()}
    return linear.applied(v, "v", WIDTH, maps, "scores", "fold").select("vec_id", "fold", F.transform("scores", lambda y: F.round(y, 5)).alias("scores"))


@query("select i::int as i, 0.0 as covariance, round(avg(x), 5) as mean from (select unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings) group by 1")
def f13_erased_concept(spark, d):
    """vectors without what is linear in two concepts (class and parity); no coordinate covaries with either, and means stay."""
    v = _vectors(spark, d).withColumn("z", F.concat("v", F.array(F.col("label").cast("double"), (F.col("vec_id") % 2).cast("double"))))
    maps = {None: linear.eraser(linear.moments(v, "z", WIDTH + 2)[None], 2)}
    out = linear.applied(v, "z", WIDTH + 2, maps, "y", then=lambda x, c, y: x[:, : y.shape[1]] - y)
    both = out.select("label", (F.col("vec_id") % 2).alias("odd"), F.posexplode("y").alias("i", "x")).groupBy("i")
    most = F.greatest(F.abs(F.covar_pop("x", "label")), F.abs(F.covar_pop("x", "odd")))
    return both.agg(r6(most).alias("covariance"), (F.round(F.avg("x"), 5) + 0.0).alias("mean"))


@query("""with r as (select l_orderkey, l_linenumber, l_quantity as c, l_extendedprice / 1000 as x, ('0x' || substr(md5('f10:' || l_orderkey || ':' || l_linenumber), 1, 7))::bigint % 3 as fold from lineitem),
 b as (select k as fold, avg(c) as mc, avg(x) as mx, covar_pop(c, x) * count(*) / (var_pop(c) * count(*) + 2) as b from r, range(3) t(k) where r.fold <> k group by 1)
 select l_orderkey, l_linenumber, round(x - mx - b * (c - mc), 5) as residual from r join b using (fold)""")
def f10_residuals_on_controls(spark, d):
    """features without what a ridge on controls explains, with the coefficients of the other folds' rows."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _hash_part(3, "f10", "l_orderkey", "l_linenumber"), F.array("l_quantity", F.col("l_extendedprice") / 1000).alias("v"))
    parts = linear.moments(rows, "v", 2, "fold")
    every = sum(list(parts.values())[1:], list(parts.values())[0]) if parts else None
    maps = {k: linear.ridge_map(every - m, 1, 2.0) for k, m in parts.items()}
    out = linear.applied(rows, "v", 2, maps, "residual", "fold", then=lambda x, c, y: x[:, 1:] - c[1:] - y)
    return out.select("l_orderkey", "l_linenumber", (F.round(F.get("residual", F.lit(0)), 5) + 0.0).alias("residual"))


ALPHAS = (0.1, 10.0, 1000.0)


@query("""with r as (select l_suppkey as u, ('0x' || substr(md5('m12:' || l_orderkey || ':' || l_linenumber), 1, 7))::bigint % 4 as fold, l_quantity as x, l_extendedprice / 1000 as y from lineitem),
 pairs as (select k, j from range(4) a(k), range(4) b(j) where j <> k), al(alpha) as (values (0.1::double), (10.0::double), (1000.0::double)),
 t as (select u, k, j, alpha, avg(x) as mx, avg(y) as my, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + alpha) as b from r, pairs, al where fold not in (k, j) group by u, k, j, alpha),
 s as (select t.u, k, alpha, sum((y - my - b * (x - mx)) ** 2) as sse from t join r on r.u = t.u and r.fold = t.j group by t.u, k, alpha),
 c as (select u, k, arg_min(alpha, sse) as alpha from s group by u, k),
 f as (select c.u, k, alpha, avg(x) as mx, avg(y) as my, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + alpha) as b from c join r on r.u = c.u and r.fold <> c.k group by c.u, k, alpha)
 select f.u as l_suppkey, round(1 - sum((y - my - b * (x - mx)) ** 2) / sum((y - my) ** 2), 5) as r2, median(distinct alpha) as alpha from f join r on r.u = f.u and r.fold = f.k group by 1""")
def m12_nested_ridge(spark, d):
    """Ridge with alpha by inner folds' squared errors, scored on outer folds; all fits come from one row of sums per unit and fold."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    rows = table(spark, d, "lineitem").select("l_suppkey", _hash_part(4, "m12", "l_orderkey", "l_linenumber"), x.alias("x"), y.alias("y"))
    names = {"n": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y")}
    per = rows.groupBy("l_suppkey", "fold").agg(*(F.sum(c).alias(k) for k, c in names.items()))
    every = per.groupBy("l_suppkey").agg(*(F.sum(k).alias("t_" + k) for k in names))
    held = lambda fold, tag: per.select("l_suppkey", F.col("fold").alias(fold), *(F.col(k).alias(tag + k) for k in names))
    outer = held("k", "k_").join(every, "l_suppkey")

    def slope(train: dict, alpha):
        return (train["xy"] - train["x"] * train["y"] / train["n"]) / (train["xx"] - train["x"] * train["x"] / train["n"] + alpha)

    def errors(train: dict, test: str, b):
        """Squared errors of ``y = a + b x`` over held-out sums."""
        a, s = train["y"] / train["n"] - b * train["x"] / train["n"], {k: F.col(test + k) for k in names}
        return s["yy"] + s["n"] * a * a + b * b * s["xx"] - 2 * a * s["y"] - 2 * b * s["xy"] + 2 * a * b * s["x"]

    without = lambda *tags: {k: F.col("t_" + k) - sum((F.col(t + k) for t in tags), F.lit(0.0)) for k in names}
    both = outer.join(held("j", "j_"), "l_suppkey").filter("j <> k").withColumn("alpha", F.explode(F.array(*map(F.lit, ALPHAS))))
    inner = both.withColumn("b", slope(without("k_", "j_"), F.col("alpha")))
    sse = inner.groupBy("l_suppkey", "k", "alpha").agg(F.sum(errors(without("k_", "j_"), "j_", F.col("b"))).alias("sse"))
    chosen = sse.groupBy("l_suppkey", "k").agg(F.min_by("alpha", F.struct("sse", "alpha")).alias("alpha"))
    fit = outer.join(chosen, ["l_suppkey", "k"]).withColumn("b", slope(without("k_"), F.col("alpha")))
    scored = fit.select("l_suppkey", "alpha", errors(without("k_"), "k_", F.col("b")).alias("sse"), errors(without("k_"), "k_", F.lit(0.0)).alias("null"))
    alphas = F.array_sort(F.collect_set("alpha"))  # three at most
    middle = (F.element_at(alphas, ((F.size(alphas) + 1) / 2).cast("int")) + F.element_at(alphas, F.floor(F.size(alphas) / 2 + 1).cast("int"))) / 2
    return scored.groupBy("l_suppkey").agg(F.round(1 - F.sum("sse") / F.sum("null"), 5).alias("r2"), middle.alias("alpha"))


_BETAS = """r as (select l_suppkey as u, l_linenumber <= 3 as own, l_orderkey as o, l_linenumber as l, l_extendedprice / 1000 as y, l_quantity as x1, l_discount * 100 as x2, l_tax * 100 as x3, l_orderkey % 7 as x4 from lineitem),
 i as (select *, row_number() over (partition by u, own order by o, l, y) as i from r),
 s as (select u, own, p, y, row_number() over (partition by p, u, own order by case when p = 0 then '' else md5('r1:' || p || ':' || o || ':' || l) end, o, l, y) as i from r, range(6) t(p)),
 b as (select u, own, p, [covar_pop(x1, s.y) / stddev_pop(x1), covar_pop(x2, s.y) / stddev_pop(x2), covar_pop(x3, s.y) / stddev_pop(x3), covar_pop(x4, s.y) / stddev_pop(x4)] as b from i join s using (u, own, i) group by all),
 c as (select x.u, x.p, (select corr(f, g) from (select unnest(x.b) as f, unnest(y.b) as g)) as r from b x join b y using (u, p) where x.own and not y.own)"""


_DESIGN = ("x1", "x2", "x3", "x4")


def _cross(spark, d):
    """Correlation across features of two conditions' coefficients, per unit, as observed (p = 0) and with responses shuffled within the condition."""
    r = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("u"), (F.col("l_linenumber") <= 3).alias("own"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), (F.col("l_extendedprice") / 1000).alias("y"),
        F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("x2"), (F.col("l_tax") * 100).alias("x3"), (F.col("l_orderkey") % 7).cast("double").alias("x4"),
    )
    cell = Window.partitionBy("u", "own")
    # places of a row in the design and in each shuffle are found where the unit's rows lie, and rows of one place meet there too: rows are shuffled once
    r = r.withColumn("i0", F.row_number().over(cell.orderBy("o", "l", "y")))
    for p in range(1, 6):
        r = r.withColumn(f"i{p}", F.row_number().over(cell.orderBy(shuffle_key(f"r1:{p}", "o", "l"), "o", "l", "y")))
    none = F.lit(None).cast("double")
    placed = [F.struct(F.col(f"i{p}").alias("i"), F.lit(p).alias("p"), "y", *((F.col(x) if p == 0 else none).alias(x) for x in _DESIGN)) for p in range(6)]
    drawn = r.select("u", "own", F.explode(F.array(*placed)).alias("z")).select("u", "own", "z.*")
    at = drawn.groupBy("u", "own", "i").agg(*(F.max(x).alias(x) for x in _DESIGN), *(F.max(F.when(F.col("p") == p, F.col("y"))).alias(f"y{p}") for p in range(6)))
    beta = [F.struct(F.lit(p).alias("p"), *(F.coalesce(F.try_divide(F.covar_pop(x, f"y{p}"), F.stddev_pop(x)), F.lit(float("nan"))).alias("b" + x) for x in _DESIGN)) for p in range(6)]
    b = at.groupBy("u", "own").agg(F.array(*beta).alias("b")).select("u", "own", F.explode("b").alias("b")).select("u", "own", "b.*")
    side = lambda own, tag: b.filter(F.col("own") == own).select("u", "p", F.array("bx1", "bx2", "bx3", "bx4").alias(tag))
    pairs = side(True, "f").join(side(False, "g"), ["u", "p"]).select("u", "p", F.explode(F.arrays_zip("f", "g")).alias("z"))
    return pairs.groupBy("u", "p").agg(correlation("z.f", "z.g").alias("r"))


@query(f"with {_BETAS} select u as l_suppkey, p::int as p, round(r, 5) as r from c")
def r1_cross_correlation(spark, d):
    """Coefficients of two conditions correlated per unit, against refits on responses shuffled inside each condition."""
    return _cross(spark, d).select(F.col("u").alias("l_suppkey"), "p", F.round("r", 5).alias("r"))


@query(f"""with {_BETAS}, q as (select u, p, round(r, 5) as r from c), n as (select avg(r) as m, stddev_samp(r) as s, count(*) as n from q where p > 0)
 select count(*) as units, round(avg(q.r), 5) as mean, round(avg((q.r - m) / s), 4) as z, round(avg((1 + (select count(*) from q x where x.p > 0 and x.r >= q.r)) / (1.0 + n)), 6) as p_right from q, n where q.p = 0""")
def r4_pooled_null(spark, d):
    """All units' shuffles pooled to one null: mean correlation, mean z, and mean one-sided p, counted by one sort of ranks."""
    q = _cross(spark, d).select("p", F.round("r", 5).alias("r"))
    null = q.filter("p > 0").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.count(F.lit(1)).alias("n"))
    # equal values are counted first, then running sums from the greatest down; five decimals bound how many there are
    at = q.groupBy("r").agg(F.count(F.when(F.col("p") > 0, 1)).alias("nulls"), F.count(F.when(F.col("p") == 0, 1)).alias("units"))
    at = at.withColumn("above", F.sum("nulls").over(Window.orderBy(F.desc("r")))).filter("units > 0").crossJoin(F.broadcast(null))  # one row
    mean = lambda c: F.sum(F.col("units") * c) / F.sum("units")
    return at.agg(F.sum("units").alias("units"), F.round(mean(F.col("r")), 5).alias("mean"), F.round(mean((F.col("r") - F.col("m")) / F.col("s")), 4).alias("z"), r6(mean((1 + F.col("above")) / (1 + F.col("n")))).alias("p_right"))


@query("""with h as (select label, row_number() over (partition by label order by vec_id) % 2 as half, embedding[1]::double as x, embedding[2]::double as y from embeddings),
 m as (select label, avg(x) filter (where half = 0) as ax, avg(y) filter (where half = 0) as ay, avg(x) filter (where half = 1) as bx, avg(y) filter (where half = 1) as bz from h group by 1),
 k as (select ax - avg(ax) over () as ax, ay - avg(ay) over () as ay, bx - avg(bx) over () as bx, bz - avg(bz) over () as bz from m where ax is not null and bx is not null),
 s as (select sum(ax * bx) as a, sum(ax * bz) as b, sum(ay * bx) as c, sum(ay * bz) as d, sum(ax * ax + ay * ay) as na, sum(bx * bx + bz * bz) as nb from k)
 select round((a * a + b * b + c * c + d * d + 2 * abs(a * d - b * c)) / (na * nb), 6) as r2 from s""")
def x7_procrustes(spark, d):
    """How much of one half's class means a rotation (or reflection) and scaling of the other's explains, from singular values of their products."""
    import numpy as np

    half = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) % 2
    h = table(spark, d, "embeddings").select("label", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("v"), half.alias("half"))
    mean = lambda k, i: F.avg(F.when(F.col("half") == k, F.get("v", F.lit(i))))
    m = h.groupBy("label").agg(F.array(*(mean(k, i) for k in (0, 1) for i in (0, 1))).alias("v"))
    s = linear.moments(m, "v", 4)[None].scatter  # of whole class means, four by four
    nuclear = np.linalg.svd(s[:2, 2:], compute_uv=False).sum()
    r2 = nuclear**2 / (np.trace(s[:2, :2]) * np.trace(s[2:, 2:]))
    return spark.createDataFrame([(round(float(r2), 6),)], "r2 double")
