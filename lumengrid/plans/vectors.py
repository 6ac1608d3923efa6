"""Vectors, designs and geometry (survey 2.11, 2.17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.tables import r6, table
from ..registry import query


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _centroids(v):
    each = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))  # 64 numbers


_C = "select label, list(m order by i) as c from (select label, i, avg(x) as m from (select label, unnest(embedding)::double as x, unnest(range(64)) as i from embeddings) group by all) group by 1"


@query(f"select e.vec_id, round(1 - list_cosine_similarity(e.embedding::double[], c.c), 5) as distance from embeddings e join ({_C}) c on c.label = (e.label + 1) % 10")
def f18_distance_to_other_centroid(spark, d):
    """cosine distance to the centroid of the other condition."""
    v = _vectors(spark, d)
    c = _centroids(v).withColumnRenamed("label", "other")
    return v.withColumn("other", (F.col("label") + 1) % 10).join(c, "other").select("vec_id", F.round(1 - cosine("v", "c"), 5).alias("distance"))


@query(f"select a.label as a, b.label as b, round(1 - list_cosine_similarity(a.c, b.c), 5) as distance from ({_C}) a join ({_C}) b on a.label < b.label")
def g_centroid_distances(spark, d):
    """Representational geometry: distances between cluster centroids."""
    c = _centroids(_vectors(spark, d))
    b = c.select(F.col("label").alias("b"), F.col("c").alias("u"))
    return c.join(b, F.col("label") < F.col("b")).select(F.col("label").alias("a"), "b", F.round(1 - cosine("c", "u"), 5).alias("distance"))  # as many rows as clusters, squared


@query("select l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) as z, l_linenumber > 2 as train from lineitem, (select avg(l_quantity) as m, coalesce(nullif(stddev_pop(l_quantity), 0), 1) as s from lineitem where l_linenumber > 2)")
def f1_standardised(spark, d):
    """standardised with the training rows' mean and deviation."""
    rows = table(spark, d, "lineitem")
    s = rows.filter("l_linenumber > 2").agg(F.avg("l_quantity").alias("m"), F.coalesce(F.nullif(F.stddev_pop("l_quantity"), F.lit(0.0)), F.lit(1.0)).alias("s"))
    return rows.crossJoin(F.broadcast(s)).select("l_orderkey", "l_linenumber", r6((F.col("l_quantity") - F.col("m")) / F.col("s")).alias("z"), (F.col("l_linenumber") > 2).alias("train"))  # one row


@query("select vec_id, round(list_sum(x), 5) as total, len(x)::int as width from (select vec_id, list_concat(e[1:3], list_concat([dur, ln(dur)], list_transform(e[1:3], lambda y: y * dur))) as x from (select vec_id, embedding::double[] as e, 1.0 + vec_id % 7 as dur from embeddings))")
def f5_design(spark, d):
    """components, duration, its log and their products in one array."""
    dur = (1.0 + F.col("vec_id") % 7).alias("dur")
    v = _vectors(spark, d).select("vec_id", F.slice("v", 1, 3).alias("e"), dur)
    x = F.concat("e", F.array("dur", F.ln("dur")), F.transform("e", lambda y: y * F.col("dur")))
    return v.withColumn("x", x).select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda s, y: s + y), 5).alias("total"), F.size("x").alias("width"))


@query("select l_orderkey, l_linenumber, round((l_quantity - mu) / sqrt(mu), 6) as residual, (l_returnflag = 'N')::int as is_n, (l_returnflag = 'R')::int as is_r from (select *, avg(l_quantity) over (partition by l_returnflag) as mu from lineitem)")
def f7_f12_residuals(spark, d):
    """one-hot columns and Pearson residuals."""
    rows = table(spark, d, "lineitem")
    mu = rows.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mu"))
    flag = lambda v: (F.col("l_returnflag") == v).cast("int")
    return rows.join(mu, "l_returnflag").select("l_orderkey", "l_linenumber", r6((F.col("l_quantity") - F.col("mu")) / F.sqrt("mu")).alias("residual"), flag("N").alias("is_n"), flag("R").alias("is_r"))


@query("select event_id, round(1.0 / (count(*) over (partition by event_type) * k), 9) as weight from events, (select count(distinct event_type) as k from events)")
def f15_inverse_frequency(spark, d):
    """weights by the inverse frequency of speakers."""
    e = table(spark, d, "events").select("event_id", "event_type")
    n = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    k = n.agg(F.count(F.lit(1)).alias("k"))
    return e.join(n, "event_type").crossJoin(F.broadcast(k)).select("event_id", F.round(1.0 / (F.col("n") * F.col("k")), 9).alias("weight"))  # one row


@query("select vec_id, round(0.5 * list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * i / 64)), 5) as activation from embeddings")
def m17_activations(spark, d):
    """Activations of rows under given coefficients."""
    weights = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i / F.lit(64.0))
    return _vectors(spark, d).select("vec_id", F.round(0.5 * dot("v", weights), 5).alias("activation"))
