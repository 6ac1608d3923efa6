"""Ranks, bins, normalisation, folds (survey 2.7, 2.13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.ranks import average_rank, benjamini_hochberg, contiguous_fold, shuffle_key
from ..operators.tables import micros, r6, table
from ..registry import query


@query("select c_custkey, round(rank() over (partition by c_nationkey order by bal) + (count(*) over (partition by c_nationkey, bal) - 1) / 2.0 - (count(*) over (partition by c_nationkey) + 1) / 2.0, 6) as centred from (select *, floor(c_acctbal / 500) as bal from customer)")
def w9_centred_ranks(spark, d):
    c = table(spark, d, "customer").withColumn("bal", F.floor(F.col("c_acctbal") / 500))
    mean = (F.count(F.lit(1)).over(Window.partitionBy("c_nationkey")) + 1) / F.lit(2.0)
    return c.select("c_custkey", r6(average_rank("bal", ("c_nationkey",)) - mean).alias("centred"))


@query("select user_id, round(p, 6) as p, round(least(1.0, min(p * n / r) over (order by r desc rows between unbounded preceding and current row)), 6) as q from (select user_id, p, row_number() over (order by p, user_id) as r, count(*) over () as n from (select user_id, (1 + count(*) filter (where value > 60)) / (1.0 + count(*))::double as p from events group by 1))")
def w10_false_discovery(spark, d):
    above = F.count(F.when(F.col("value") > 60, 1))
    p = table(spark, d, "events").groupBy("user_id").agg(((1 + above) / (1.0 + F.count(F.lit(1)))).alias("p"))
    return benjamini_hochberg(p, "p", "user_id").select("user_id", r6(F.col("p")).alias("p"), r6(F.col("q")).alias("q"))


@query("select o_orderkey, (case when o_totalprice <= q[1] then 0 when o_totalprice <= q[2] then 1 when o_totalprice <= q[3] then 2 else 3 end)::int as bin from orders, (select quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) as q from orders)")
def w11_quantile_bins(spark, d):
    """Bins by edges, not by equal counts."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    edges = o.agg(F.percentile("o_totalprice", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"))
    return o.crossJoin(F.broadcast(edges)).select("o_orderkey", F.size(F.filter("q", lambda e: F.col("o_totalprice") > e)).alias("bin"))  # one row


@query("select event_id, round(0.6745 * (value - m) / nullif(mad, 0), 6) as z from (select *, median(abs(value - m)) over (partition by user_id) as mad from (select *, median(value) over (partition by user_id) as m from events)) where abs(0.6745 * (value - m) / nullif(mad, 0)) < 1")
def w12_robust_z(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    m = e.groupBy("user_id").agg(F.median("value").alias("m"))
    e = e.join(m, "user_id")
    mad = e.groupBy("user_id").agg(F.median(F.abs(F.col("value") - F.col("m"))).alias("mad"))
    z = 0.6745 * (F.col("value") - F.col("m")) / F.nullif(F.col("mad"), F.lit(0.0))
    return e.join(mad, "user_id").filter(F.abs(z) < 1).select("event_id", r6(z).alias("z"))


@query("select event_id, round(least(greatest(value, lo), hi), 6) as v from events join (select user_id, quantile_cont(value, 0.1) as lo, quantile_cont(value, 0.9) as hi from events group by 1) using (user_id)")
def w13_winsorised(spark, d):
    e = table(spark, d, "events")
    q = e.groupBy("user_id").agg(F.percentile("value", F.lit(0.1)).alias("lo"), F.percentile("value", F.lit(0.9)).alias("hi"))
    return e.join(q, "user_id").select("event_id", r6(F.least(F.greatest("value", "lo"), "hi")).alias("v"))


@query("select event_id, round((value - avg(value) over w) / nullif(stddev_pop(value) over w, 0), 6) as z, round((value - min(value) over w) / nullif(max(value) over w - min(value) over w, 0), 6) as unit, round(value / max(value) over w, 6) as of_max from events window w as (partition by event_type)")
def w14_normalised(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    v, zero = F.col("value"), F.lit(0.0)
    return e.join(s, "event_type").select(
        "event_id", r6((v - F.col("m")) / F.nullif(F.col("s"), zero)).alias("z"), r6((v - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), zero)).alias("unit"), r6(v / F.col("hi")).alias("of_max")
    )


@query("""with r as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n from events)
 select event_id, (case when i < (n % 5) * (n // 5 + 1) then i // (n // 5 + 1) else n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) end)::int as v1, least(i // (n // 5), 4)::int as v2, ((i - 3 + n) % n < n // 4) as v3, (i < n // 2) as v7,
 (case when i < n // 3 then 0 when i < 2 * (n // 3) then 1 else 2 end)::int as v5 from r""")
def v1_v7_contiguous_folds(spark, d):
    """V1, V2, V3, V5, V7: contiguous folds, rolling hold-out, growing splits, halves."""
    rows = table(spark, d, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    i, n = F.col("i"), F.col("n")
    third = F.floor(n / 3)
    return rows.select(
        "event_id", contiguous_fold(i, n, 5).alias("v1"), contiguous_fold(i, n, 5, "last").alias("v2"), (F.pmod(i - 3, n) < F.floor(n / 4)).alias("v3"), (i < F.floor(n / 2)).alias("v7"),
        F.when(i < third, 0).when(i < 2 * third, 1).otherwise(2).alias("v5"),
    )


@query("select event_id, ((row_number() over (partition by user_id order by md5('42:' || event_id), event_id) - 1) % 5)::int as fold from events")
def v4_shuffled_folds(spark, d):
    w = Window.partitionBy("user_id").orderBy(shuffle_key("42", "event_id"), "event_id")
    return table(spark, d, "events").select("event_id", ((F.row_number().over(w) - 1) % 5).alias("fold"))


@query("""with f as (select event_id, user_id, epoch_us(ts) as t, (row_number() over (partition by user_id order by md5('7:' || event_id), event_id) - 1) % 5 as fold from events)
 select event_id from f where fold <> 0 and not exists (select 1 from f g where g.user_id = f.user_id and g.fold = 0 and abs(g.t - f.t) <= 600000000)""")
def v6_purged_training_rows(spark, d):
    """V6: training rows further than the embargo from every test row."""
    from ..operators.intervals import nearest_gap

    w = Window.partitionBy("user_id").orderBy(shuffle_key("7", "event_id"), "event_id")
    f = table(spark, d, "events").select("event_id", "user_id", micros("ts").alias("t"), ((F.row_number().over(w) - 1) % 5).alias("fold"))
    test = f.filter("fold = 0").select("user_id", F.col("t").alias("p"))
    return nearest_gap(f.filter("fold <> 0"), test, "t", "p", ("user_id",)).filter("gap is null or gap > 600000000").select("event_id")


@query("select vec_id, ((row_number() over (partition by label order by md5('1:' || vec_id), vec_id) - 1) % 4)::int as fold from embeddings")
def v8_stratified_folds(spark, d):
    w = Window.partitionBy("label").orderBy(shuffle_key("1", "vec_id"), "vec_id")
    return table(spark, d, "embeddings").select("vec_id", ((F.row_number().over(w) - 1) % 4).alias("fold"))
