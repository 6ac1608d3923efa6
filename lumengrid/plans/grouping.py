"""Aggregations, order and sets (survey 2.6, 2.8, 2.9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.tables import r6, table
from ..registry import query


@query("select l_returnflag, l_linestatus, round(avg(l_quantity), 6) as mean, median(l_quantity) as median, round(stddev_samp(l_quantity), 6) as sd, round(stddev_pop(l_quantity), 6) as sd_pop, count(*) as n, count(distinct l_partkey) as parts from lineitem group by all")
def a1_group_statistics(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        r6(F.avg("l_quantity")).alias("mean"), F.median("l_quantity").alias("median"), r6(F.stddev_samp("l_quantity")).alias("sd"), r6(F.stddev_pop("l_quantity")).alias("sd_pop"),
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("parts"),
    )


@query("select c_nationkey, count(*) as customers, round(avg(m), 4) as mean, round(stddev_samp(m) / sqrt(count(*)), 4) as sem from (select c_nationkey, c_custkey, avg(o_totalprice) as m from customer join orders on o_custkey = c_custkey group by all) group by 1")
def a2_two_level_rollup(spark, d):
    m = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("m"))
    m = m.join(table(spark, d, "customer"), "c_custkey")
    return m.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.round(F.avg("m"), 4).alias("mean"), F.round(F.stddev_samp("m") / F.sqrt(F.count(F.lit(1))), 4).alias("sem"))


@query("select l_suppkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) as weighted from lineitem group by 1")
def a3_weighted_mean(spark, d):
    w = F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(w, 4).alias("weighted"))


@query("select user_id, count(*) filter (where event_type = 'view') as view, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'purchase') as purchase from events group by 1")
def a5_a6_crosstab(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.count(F.lit(1))).fillna(0)


@query("select l_orderkey, l_linenumber, 'l_discount' as name, l_discount as value from lineitem union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem")
def a7_unpivot(spark, d):
    return table(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "name", "value")


@query("select o_orderpriority, round(quantile_cont(o_totalprice, 0.025), 4) as low, round(quantile_cont(o_totalprice, 0.5), 4) as mid, round(quantile_cont(o_totalprice, 0.975), 4) as high from orders group by 1")
def a8_quantiles(spark, d):
    q = lambda p: F.round(F.percentile("o_totalprice", F.lit(p)), 4)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(q(0.025).alias("low"), q(0.5).alias("mid"), q(0.975).alias("high"))


_TOKENS = "(select role, unnest(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) as w from conversations)"


def _tokens(spark, d):
    return table(spark, d, "conversations").select("role", F.explode(F.filter(F.split(F.lower("text"), " "), lambda x: x != "")).alias("w"))


@query(f"with t as {_TOKENS}, s as (select w from t group by w having count(distinct role) >= 2) select role, count(distinct w) as types, count(*) as tokens, round(count(distinct w) / count(*), 6) as ratio, count(distinct w) filter (where w in (from s)) as shared_types, count(*) filter (where w in (from s)) as shared_tokens from t group by role")
def a9_a10_vocabulary(spark, d):
    """Type-token ratio, and the vocabulary that speakers share."""
    n = _tokens(spark, d).groupBy("role", "w").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("w")) >= 2)
    return n.groupBy("role").agg(
        F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"), r6(F.count(F.lit(1)) / F.sum("n")).alias("ratio"),
        F.count(F.when(F.col("shared"), 1)).alias("shared_types"), F.coalesce(F.sum(F.when(F.col("shared"), F.col("n"))), F.lit(0)).alias("shared_tokens"),
    )


@query("select event_type, round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 6e7), 6) as per_minute from events group by 1")
def a11_rate_per_minute(spark, d):
    from ..operators.tables import micros

    t = table(spark, d, "events").withColumn("t", micros("ts"))
    return t.groupBy("event_type").agg(r6(F.count(F.lit(1)) / ((F.max("t") - F.min("t")) / 6e7)).alias("per_minute"))


@query("select c_nationkey, c_custkey, c_acctbal from customer qualify row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) = 1")
def a12_arg_max(spark, d):
    """Best per group by one aggregation, the first of ties."""
    best = F.min_by(F.struct("c_custkey", "c_acctbal"), F.struct((-F.col("c_acctbal")).alias("x"), "c_custkey"))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(best.alias("b")).select("c_nationkey", "b.c_custkey", "b.c_acctbal")


@query("select label, i, round(avg(x), 5) as mean, round(stddev_pop(x), 5) as sd from (select label, unnest(embedding)::double as x, unnest(range(64)) as i from embeddings) group by all")
def a13_a14_centroids(spark, d):
    """Mean and spread of vectors per cluster."""
    each = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    x = F.col("x").cast("double")
    return each.groupBy("label", F.col("p").cast("long").alias("i")).agg(F.round(F.avg(x), 5).alias("mean"), F.round(F.stddev_pop(x), 5).alias("sd"))


@query("select lang, round(100 * avg(toxic), 6) as percent, sum(toxic)::bigint as n from documents join labels using (doc_id) group by 1")
def a15_percent(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return both.groupBy("lang").agg(r6(100 * F.avg("toxic")).alias("percent"), F.sum("toxic").alias("n"))


@query("select c_mktsegment, c_nationkey, count(*) as n, round(sum(c_acctbal), 2) as total from customer group by rollup (c_mktsegment, c_nationkey)")
def a17_rollup(spark, d):
    return table(spark, d, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query(f"select w, count(*) as n from {_TOKENS} group by w order by n desc, w limit 50")
def top_tokens(spark, d):
    """2.8: the fifty most frequent tokens."""
    return _tokens(spark, d).groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(50)


@query("select user_id, event_type, n from (select user_id, event_type, count(*) as n from events group by all) qualify row_number() over (partition by user_id order by n desc, event_type) <= 2")
def top_two_per_unit(spark, d):
    """2.8: two most frequent speakers per unit, ties to the lowest."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).filter("k <= 2").drop("k")


@query("""select 'intersect' as op, count(*) as n from (select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O')
 union all select 'except', count(*) from (select o_custkey from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'O')
 union all select 'union', count(*) from (select o_custkey from orders where o_orderstatus = 'F' union select o_custkey from orders where o_orderstatus = 'O')""")
def set_operations(spark, d):
    """2.9: intersection, difference and union of key sets."""
    o = table(spark, d, "orders")
    a, b = (o.filter(F.col("o_orderstatus") == s).select("o_custkey") for s in "FO")
    n = lambda df, op: df.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))
    return n(a.intersect(b), "intersect").union(n(a.subtract(b), "except")).union(n(a.union(b).distinct(), "union"))
