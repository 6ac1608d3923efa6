"""Balancing, shuffles and resampling by hash order (survey 2.14, 2.16)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.ranks import shuffle_key
from ..operators.tables import r6, table
from ..registry import query


@query("select lang, toxic, count(*) as n, min(doc_id) as first from (select lang, toxic, doc_id, row_number() over (partition by lang, toxic order by md5('3:' || doc_id), doc_id) as r, least(sum(toxic) over (partition by lang), sum(1 - toxic) over (partition by lang)) as cap from documents join labels using (doc_id)) where r <= cap group by all")
def b4_matched_classes(spark, d):
    """As many rows of both conditions in every class."""
    both = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    n = both.groupBy("lang").agg(F.least(F.sum("toxic"), F.sum(1 - F.col("toxic"))).alias("cap"))
    r = F.row_number().over(Window.partitionBy("lang", "toxic").orderBy(shuffle_key("3", "doc_id"), "doc_id"))
    kept = both.withColumn("r", r).join(n, "lang").filter("r <= cap")
    return kept.groupBy("lang", "toxic").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("""with c as (select label, count(*) as n from embeddings group by 1), t as (select least(quantile_cont(n, 0.5), 1000)::bigint as target from c) select label, n, least(n, target) as used, n >= 5 as kept, case when n < 5 then 'too few' end as drop_reason from c, t""")
def b2_capped_clusters(spark, d):
    """B2: clusters capped at the median, with reasons."""
    c = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.bround(F.least(F.percentile("n", F.lit(0.5)), F.lit(1000.0))).cast("long").alias("target"))
    out = c.crossJoin(F.broadcast(t))  # one row
    return out.select("label", "n", F.least("n", "target").alias("used"), (F.col("n") >= 5).alias("kept"), F.when(F.col("n") < 5, "too few").alias("drop_reason"))


@query("select a.event_id, b.event_id as drawn from (select event_id, user_id, row_number() over (partition by user_id order by event_id) as i from events) a join (select event_id, user_id, row_number() over (partition by user_id order by md5('5:' || event_id), event_id) as i from events) b using (user_id, i)")
def n1_row_shuffle(spark, d):
    """Rows shuffled within units, which is the draw of N4, N8 and N14 as well; refits are in `m16_nested_encoding` and `r1_r7_fitted_reliability`."""
    e = table(spark, d, "events").select("event_id", "user_id")
    a = e.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    b = e.select("user_id", F.col("event_id").alias("drawn"), F.row_number().over(Window.partitionBy("user_id").orderBy(shuffle_key("5", "event_id"), "event_id")).alias("i"))
    return a.join(b, ["user_id", "i"]).select("event_id", "drawn")


@query("""with r as (select event_id, user_id, (row_number() over (partition by user_id order by ts, event_id) - 1) // 8 as b, row_number() over (partition by user_id order by ts, event_id) as i from events)
 select event_id, row_number() over (partition by user_id order by md5('9:' || user_id || ':' || b), b, i) as place from r""")
def n3_block_shuffle(spark, d):
    """Blocks of eight in shuffled order, rows inside in their own."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    r = table(spark, d, "events").select("event_id", "user_id", i.alias("i")).withColumn("b", F.floor((F.col("i") - 1) / 8))
    w = Window.partitionBy("user_id").orderBy(shuffle_key("9", "user_id", "b"), "b", "i")
    return r.select("event_id", F.row_number().over(w).cast("long").alias("place"))


@query("""with r as (select event_id, user_id, floor(value / 10) as cell, row_number() over (partition by user_id, floor(value / 10) order by event_id) as i, row_number() over (partition by user_id, floor(value / 10) order by md5('11:' || event_id), event_id) as j from events)
 select a.event_id, b.event_id as drawn from r a join r b on a.user_id = b.user_id and a.cell = b.cell and a.i = b.j""")
def n11_stratified_shuffle(spark, d):
    """Rows shuffled inside cells of a confound."""
    e = table(spark, d, "events").select("event_id", "user_id", F.floor(F.col("value") / 10).alias("cell"))
    w = Window.partitionBy("user_id", "cell")
    a = e.withColumn("i", F.row_number().over(w.orderBy("event_id")))
    b = e.select("user_id", "cell", F.col("event_id").alias("drawn"), F.row_number().over(w.orderBy(shuffle_key("11", "event_id"), "event_id")).alias("i"))
    return a.join(b, ["user_id", "cell", "i"]).select("event_id", "drawn")


@query("""with c as (select conv_id, avg(length(text)) as v, row_number() over (order by conv_id) - 1 as i, count(*) over () as n from conversations group by 1),
 p as (select k, j, ('0x' || substr(md5(k || ':' || j), 1, 7))::bigint % n as pick from range(1, 31) a(k), (select i as j, n from c)), m as (select k, avg(v) as m from p join c on c.i = pick group by k)
 select round(quantile_cont(m, 0.025), 5) as low, round(avg(m), 5) as mean, round(quantile_cont(m, 0.975), 5) as high from m""")
def n19_bootstrap(spark, d):
    """Bootstrap interval over subjects, draws by hash."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.avg(F.length("text")).alias("v"))
    c = c.withColumn("i", (F.row_number().over(Window.orderBy("conv_id")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    p = c.select(F.explode(F.sequence(F.lit(1), F.lit(30))).alias("k"), F.col("i").alias("j"), "n")
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("k").cast("string"), F.col("j").cast("string"))), 1, 7), 16, 10).cast("long") % F.col("n")
    m = p.select("k", pick.alias("i")).join(c.select("i", "v"), "i").groupBy("k").agg(F.avg("v").alias("m"))
    q = lambda x: F.round(F.percentile("m", F.lit(x)), 5)
    return m.agg(q(0.025).alias("low"), F.round(F.avg("m"), 5).alias("mean"), q(0.975).alias("high"))


@query("select vec_id, label from (select vec_id, label, row_number() over (partition by label order by md5('13:' || vec_id), vec_id) as r from embeddings) where r <= 12")
def b6_b10_capped_sample(spark, d):
    """A fixed number per group in hash order, the same on every run."""
    r = F.row_number().over(Window.partitionBy("label").orderBy(shuffle_key("13", "vec_id"), "vec_id"))
    return table(spark, d, "embeddings").select("vec_id", "label", r.alias("r")).filter("r <= 12").drop("r")
