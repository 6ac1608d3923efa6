"""Joins (survey 2.5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.intervals import counts_before, interval_join, nearest_gap
from ..operators.tables import micros, r6, table
from ..registry import query

SIX_HOURS = 6 * 3600 * 1_000_000


@query(f"""with s as (select event_id, event_type as cond, epoch_us(ts) as b, epoch_us(ts) + {SIX_HOURS} as e from events where event_type in ('purchase', 'view')),
 u as (select distinct user_id from events), n as (select cond, count(*) as n from s group by cond),
 h as (select cond, user_id, count(*) as k from s join events p on epoch_us(p.ts) >= b and epoch_us(p.ts) < e group by all)
 select n.cond, u.user_id, coalesce(k, 0)::bigint as hits, round(coalesce(k, 0) / n.n / 6.0, 6) as rate from n cross join u left join h on h.cond = n.cond and h.user_id = u.user_id""")
def j1_event_rates(spark, d):
    """Events per unit in windows after each stimulus; units without any count 0."""
    events = table(spark, d, "events").select("user_id", "event_type", micros("ts").alias("t"))
    kinds = ("purchase", "view")
    stimuli = events.filter(F.col("event_type").isin(*kinds)).select(F.col("event_type").alias("cond"), F.col("t").alias("b"))
    # an event's hits are the stimuli up to it less those six hours before, so that no pair is made
    ends = events.select("user_id", "t", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"))
    at = ends.select("user_id", "sign", (F.col("t") + F.when(F.col("sign") == 1, F.lit(1)).otherwise(F.lit(1 - SIX_HOURS))).alias("m"), F.explode(F.array(*map(F.lit, kinds))).alias("cond"))
    hits = counts_before(stimuli, at, "b", "m", SIX_HOURS // 24, ("cond",)).groupBy("cond", "user_id").agg(F.sum(F.col("sign") * F.col("before")).alias("hits"))
    n = stimuli.groupBy("cond").agg(F.count(F.lit(1)).alias("n"))
    grid = n.join(events.select("user_id").distinct().withColumn("cond", F.explode(F.array(*map(F.lit, kinds)))), "cond")
    out = grid.join(hits, ["cond", "user_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.select("cond", "user_id", "hits", r6(F.col("hits") / F.col("n") / 6.0).alias("rate"))


@query("""select o.o_orderkey, count(l.t) as n, round(coalesce(sum(l.q), 0), 3) as total from (select o_orderkey, epoch_us(o_orderdate) as b, epoch_us(o_orderdate) + 86400000000 * 60 as e from orders) o
 left join (select l_orderkey, epoch_us(l_shipdate) as t, l_quantity as q from lineitem) l on l.l_orderkey = o.o_orderkey and l.t >= o.b and l.t <= o.e group by o.o_orderkey""")
def j2_interval_sum(spark, d):
    """Sums inside closed windows of the same key, empty windows 0."""
    day = 86_400_000_000
    o = table(spark, d, "orders").select("o_orderkey", micros("o_orderdate").alias("b"), (micros("o_orderdate") + 60 * day).alias("e"))
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), micros("l_shipdate").alias("t"), F.col("l_quantity").alias("q"))
    hit = interval_join(items, o, "t", "b", "e", 60 * day, ("o_orderkey",), closed=True).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("total"))
    return o.join(hit, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 3).alias("total"))


@query("""select w.event_id, case when w.b < lo or w.e > hi then null else (select count(*) from events p where p.user_id = w.user_id and epoch_us(p.ts) >= w.b and epoch_us(p.ts) < w.e) end as n
 from (select event_id, user_id, epoch_us(ts) + 3600000000 as b, epoch_us(ts) + 3600000000 + 43200000000 as e from events where event_type = 'click') w, (select min(epoch_us(ts)) as lo, max(epoch_us(ts)) as hi from events)""")
def j3_shifted_windows(spark, d):
    """Counts in shifted windows, null where a window leaves the recording."""
    hour = 3_600_000_000
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", micros("ts").alias("t"))
    w = e.filter("event_type = 'click'").select("event_id", "user_id", (F.col("t") + hour).alias("b"), (F.col("t") + 13 * hour).alias("e"))
    hit = interval_join(e.select("user_id", "t"), w, "t", "b", "e", 12 * hour, ("user_id",)).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    span = e.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    out = w.join(hit, "event_id", "left").crossJoin(F.broadcast(span))  # one row
    return out.select("event_id", F.when((F.col("b") >= F.col("lo")) & (F.col("e") <= F.col("hi")), F.coalesce("n", F.lit(0))).alias("n"))


@query("""select event_id, round(avg(n) * 1000 / 3600, 6) as rate from (select w.event_id, g.k, count(p.t) as n from (select event_id, user_id, epoch_us(ts) as b from events where event_type = 'signup') w cross join range(12) g(k)
 left join (select user_id, epoch_us(ts) as t from events) p on p.user_id = w.user_id and p.t >= w.b + g.k * 3600000000 and p.t < w.b + (g.k + 1) * 3600000000 group by all) group by event_id""")
def j4_binned_rate(spark, d):
    """Mean rate over whole bins of a window (a partial last bin is left out)."""
    hour, bins = 3_600_000_000, 12
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", micros("ts").alias("t"))
    w = e.filter("event_type = 'signup'").select("event_id", "user_id", F.col("t").alias("b"), (F.col("t") + bins * hour + hour // 2).alias("e"))
    hit = interval_join(e.select("user_id", "t"), w, "t", "b", "e", 12 * hour, ("user_id",)).filter(F.floor((F.col("t") - F.col("b")) / hour) < bins)
    n = hit.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return w.join(n, "event_id", "left").select("event_id", r6(F.coalesce("n", F.lit(0)) / bins * 1000 / 3600).alias("rate"))


@query("select a.event_id, b.o_orderkey from (select event_id, event_type, row_number() over (partition by event_type order by event_id) as i from events) a join (select o_orderkey, case o_orderstatus when 'F' then 'view' when 'O' then 'click' else 'error' end as event_type, row_number() over (partition by o_orderstatus order by o_orderkey) as i from orders) b using (event_type, i)")
def j5_ordinal_join(spark, d):
    """The n-th row of one table with the n-th of another, per speaker."""
    a = table(spark, d, "events").select("event_id", "event_type", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).alias("i"))
    kind = F.when(F.col("o_orderstatus") == "F", "view").when(F.col("o_orderstatus") == "O", "click").otherwise("error")
    b = table(spark, d, "orders").select("o_orderkey", kind.alias("event_type"), F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_orderkey")).alias("i"))
    return a.join(b, ["event_type", "i"]).select("event_id", "o_orderkey")


@query("select event_id, k - 1 as place from (select event_id, m, assigned, row_number() over (partition by m order by event_id) as k from (select event_id, m, case when event_id % 2 = 0 then 'a' else 'b' end as assigned from events, unnest(case when event_id % 5 = 0 then ['a', 'b'] when event_id % 2 = 0 then ['a'] else ['b'] end) t(m))) where m = assigned")
def j6_shared_rows(spark, d):
    """Rows of several speakers advance all their cursors, and count for the assigned one."""
    i = F.col("event_id")
    members = F.when(i % 5 == 0, F.array(F.lit("a"), F.lit("b"))).when(i % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b")))
    rows = table(spark, d, "events").select("event_id", F.when(i % 2 == 0, "a").otherwise("b").alias("assigned"), F.explode(members).alias("m"))
    k = F.row_number().over(Window.partitionBy("m").orderBy("event_id"))
    return rows.withColumn("place", (k - 1).cast("long")).filter("m = assigned").select("event_id", "place")


@query("select event_id, round(lead(value, 3) over (partition by user_id order by ts, event_id), 6) as later from events qualify lead(event_id, 3) over (partition by user_id order by ts, event_id) is not null")
def j7_shift_join(spark, d):
    """Each row with the response three steps on, ends cut."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    out = table(spark, d, "events").select("event_id", r6(F.lead("value", 3).over(w)).alias("later"), F.lead("event_id", 3).over(w).alias("other"))
    return out.filter("other is not null").drop("other")


@query("select c_custkey, n_name, n_orders from customer left join (select o_custkey, count(*) as n_orders from orders group by 1) on o_custkey = c_custkey join nation on n_nationkey = c_nationkey")
def j8_j9_merges(spark, d):
    """Left and inner merges."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(n, "c_custkey", "left").join(nation, "c_nationkey").select("c_custkey", "n_name", "n_orders")


@query("select coalesce(a.lang, b.lang) as lang, coalesce(a.n, 0) as n_long, coalesce(b.n, 0) as n_toxic from (select lang, count(*) as n from documents where n_chars > 3000 group by 1) a full join (select lang, count(*) as n from documents join labels using (doc_id) where toxic = 1 group by 1) b on a.lang = b.lang")
def j10_outer_merge(spark, d):
    """Full outer merge, missing counts 0."""
    docs = table(spark, d, "documents")
    a = docs.filter("n_chars > 3000").groupBy("lang").agg(F.count(F.lit(1)).alias("n_long"))
    b = docs.join(table(spark, d, "labels").filter("toxic = 1"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n_toxic"))
    return a.join(b, "lang", "full_outer").fillna(0, ["n_long", "n_toxic"])


@query("select event_id, (select min(abs(epoch_us(p.ts) - epoch_us(e.ts))) from events p where p.user_id = e.user_id and p.event_type = 'purchase') as gap from events e where event_type = 'view'")
def j12_nearest(spark, d):
    """Time to the nearest mark on either side."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", micros("ts").alias("t"))
    out = nearest_gap(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'").select("user_id", F.col("t").alias("p")), "t", "p", ("user_id",))
    return out.select("event_id", "gap")


@query("select p_partkey, region from part join (values ('low', 1, 15), ('mid', 16, 35), ('high', 36, 60)) r(region, lo, hi) on p_size between lo and hi")
def j13_channel_ranges(spark, d):
    """A fixed table of channel ranges."""
    ranges = spark.createDataFrame([("low", 1, 15), ("mid", 16, 35), ("high", 36, 60)], "region string, lo int, hi int")
    return table(spark, d, "part").join(F.broadcast(ranges), F.col("p_size").between(F.col("lo"), F.col("hi"))).select("p_partkey", "region")


@query("select a.label, count(*) as pairs, round(avg(1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 4) as mean_distance from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id group by a.label")
def j14_all_pairs_in_cluster(spark, d):
    """All pairs inside each cluster; their mean distance from one sum of unit vectors, as no pair need be made (``vec_id`` is a key)."""
    e = table(spark, d, "embeddings").filter("vec_id is not null and label is not null").select("label", F.col("embedding").cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(norm > 0, 1)).alias("m"))
    sums = e.filter(norm > 0).select("label", F.posexplode(F.transform("v", lambda x: x / norm)).alias("k", "x")).groupBy("label", "k").agg(F.sum("x").alias("x"))
    total = sums.groupBy("label").agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    cosine = (F.col("square") - F.col("m")) / F.expr("nullif(m * (m - 1), 0)")
    return n.filter("n > 1").join(total, "label", "left").select("label", F.expr("n * (n - 1) div 2").alias("pairs"), F.round(1 - cosine, 4).alias("mean_distance"))


@query("select label, count(*) as pairs, round(avg(cd), 4) as mean_distance from (select a.label, 1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as cd from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id) group by label")
def j14_pairs_in_cluster(spark, d):
    """J14 under its first name: whole clusters too."""
    return j14_all_pairs_in_cluster(spark, d)


@query("select c_custkey, c_acctbal from customer where c_custkey not in (select c_custkey from customer where c_custkey % 3 = 0) union all select c_custkey, 0.0 from customer where c_custkey % 3 = 0")
def j15_upsert(spark, d):
    """Rows of matching keys replaced."""
    old = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = old.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(0.0))
    return old.join(new, "c_custkey", "left_anti").unionByName(new)
