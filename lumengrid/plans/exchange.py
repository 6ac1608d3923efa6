"""Features and results written and read back (survey 2.1, 2.18)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.tables import r6, table
from ..registry import query
from ..sources import results


@query("select vec_id, round(list_sum(embedding::double[]), 5) as total from embeddings where label = 3")
def s5_layer_slice(spark, d):
    """One layer of vectors kept by layer."""
    path = results.write_slices(table(spark, d, "embeddings"), results.new_folder(spark, "layers"), "label")
    v = results.read_slice(spark, path, label=3)
    return v.select("vec_id", F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("select user_id, count(*) as n, round(sum(value), 4) as total from events where event_type = 'view' and user_id % 2 = 0 group by 1")
def s6_k1_counts_by_speaker(spark, d):
    """Responses written by condition and region, and one such table read."""
    rows = table(spark, d, "events").select("user_id", "value", "event_type", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("region"))
    path = results.write_slices(rows, results.new_folder(spark, "counts"), "event_type", "region")
    return results.read_slice(spark, path, event_type="view", region="even").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


_STATS = "user_id long, n long, mean double, first string"


def _stats(spark, d):
    e = table(spark, d, "events").groupBy("user_id")
    return e.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), F.nullif(F.min("event_type"), F.lit("click")).alias("first"))


_STATS_SQL = "select user_id, count(*) as n, round(avg(value), 6) as mean, nullif(min(event_type), 'click') as first from events group by 1"


@query(_STATS_SQL)
def k2_csv_results(spark, d):
    """K2: a table of results as CSV; nulls and empty texts stay apart."""
    return results.read_csv(spark, results.write_csv(_stats(spark, d), results.new_folder(spark, "stats")), _STATS)


@query(f"select s.user_id, s.n, s.mean, b.spread from ({_STATS_SQL}) s join (select user_id, round(stddev_pop(value), 6) as spread from events group by 1) b using (user_id)")
def k3_result_bundle(spark, d):
    """A bundle of tables (results, and what was fitted with them), joined again by unit."""
    base = results.new_folder(spark, "bundle")
    parts = {"stats": _stats(spark, d), "fits": table(spark, d, "events").groupBy("user_id").agg(r6(F.stddev_pop("value")).alias("spread"))}
    for name, part in parts.items():
        part.write.parquet(f"{base}/{name}")
    return spark.read.parquet(f"{base}/stats").join(spark.read.parquet(f"{base}/fits"), "user_id").select("user_id", "n", "mean", "spread")


@query("select event_type, count(*) as n, count(distinct user_id) as units from events group by 1")
def k6_json_summary(spark, d):
    """K6: a summary as JSON, read with its schema."""
    s = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("units"))
    return spark.read.schema("event_type string, n long, units long").json(results.write_summary(s, results.new_folder(spark, "summary")))


@query("select substr(md5(c_custkey::varchar || ':salt'), 1, 16) as unit, c_mktsegment, c_acctbal from customer")
def k7_anonymised_export(spark, d):
    """K7: an export without names or telephone numbers, checked before it is written."""
    unit = F.substring(F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit(":salt"))), 1, 16)
    rows = table(spark, d, "customer").withColumn("unit", unit)
    path = results.export_checked(rows, results.new_folder(spark, "export"), ["unit", "c_mktsegment", "c_acctbal"], r"Customer#|\d{2}-\d{3}-\d{3}-\d{4}")
    return spark.read.parquet(path)


@query(f"select user_id, case when user_id % 3 = 0 then -1 else n end as n, mean, first from ({_STATS_SQL}) union all select -5, -1, null, 'new'")
def k8_csv_upsert(spark, d):
    """Rows with the same key replaced in an earlier table of results, others added."""
    stats = _stats(spark, d)
    prior = results.write_csv(stats, results.new_folder(spark, "prior"))
    fresh = stats.filter("user_id % 3 = 0").withColumn("n", F.lit(-1).cast("long"))
    extra = spark.createDataFrame([(-5, -1, None, "new")], _STATS)
    out = results.upsert_csv(fresh.unionByName(extra), prior, results.new_folder(spark, "upserted"), ["user_id"], _STATS)
    return results.read_csv(spark, out, _STATS)


@query("select event_type as subject, user_id, value as a, case when event_type <> 'view' then value + 1 end as b from events where event_type in ('view', 'click', 'purchase')")
def s11_outputs_of_subjects(spark, d):
    """Outputs of several subjects, one of which lacks a column, read as one table."""
    e, paths = table(spark, d, "events"), []
    for subject in ("view", "click", "purchase"):
        one = e.filter(F.col("event_type") == subject).select(F.lit(subject).alias("subject"), "user_id", F.col("value").alias("a"))
        one = one if subject == "view" else one.withColumn("b", F.col("a") + 1)
        paths.append(results.new_folder(spark, subject))
        one.write.parquet(paths[-1])
    return results.read_outputs(spark, paths).select("subject", "user_id", "a", "b")


@query("""with o as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey) - 1 as row_idx from orders)
 select o_orderkey, round(greatest(case when row_idx % 5 = 4 then 0 else o_totalprice / 1000 end, 1e-6), 6) as duration from o""")
def s7_durations(spark, d):
    """Durations from a file of their own, joined by place, and at least 1e-6."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (F.row_number().over(order) - 1).alias("row_idx"))
    given = o.select("o_custkey", "row_idx", F.when(F.col("row_idx") % 5 == 4, 0.0).otherwise(F.col("o_totalprice") / 1000).alias("duration"))
    path = results.write_csv(given, results.new_folder(spark, "durations"))
    read = results.read_csv(spark, path, "o_custkey long, row_idx int, duration double")
    return o.join(read, ["o_custkey", "row_idx"]).select("o_orderkey", r6(F.greatest("duration", F.lit(1e-6))).alias("duration"))


@query("""with r as (select l_orderkey, l_linenumber, l_suppkey, l_discount, case when l_tax > 0 then ln(1 + l_quantity) end as surprisal from lineitem)
 select l_orderkey, l_linenumber, l_discount, round(coalesce(surprisal, avg(surprisal) over (partition by l_suppkey), 0), 6) as surprisal from r""")
def s8_s16_control_features(spark, d):
    """Controls with surprisal from another table; where it is missing, the mean of the unit (0 where none is known)."""
    rows, key = table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]
    more = rows.filter("l_tax > 0").select(*key, F.log(1 + F.col("l_quantity")).alias("surprisal")).distinct()
    path = results.new_folder(spark, "surprisal")
    more.write.parquet(path)
    both = rows.select(*key, "l_discount", (F.col("l_tax") > 0).alias("known")).join(spark.read.parquet(path), key, "left")
    s = F.when(F.col("known"), F.col("surprisal"))
    mean = F.avg(s).over(Window.partitionBy("l_suppkey"))
    return both.select("l_orderkey", "l_linenumber", "l_discount", r6(F.coalesce(s, mean, F.lit(0.0))).alias("surprisal"))


@query("select event_type as subject, user_id, value as a, case when event_type <> 'view' then value + 1 end as b from events")
def s11_glob_of_outputs(spark, d):
    """Outputs of every subject, found by a pattern over their folders; some lack a column."""
    e, root = table(spark, d, "events").select(F.col("event_type").alias("subject"), "user_id", F.col("value").alias("a")), results.new_folder(spark, "subjects")
    e.filter("subject = 'view'").write.parquet(f"{root}/task-1")
    e.filter("subject <> 'view'").withColumn("b", F.col("a") + 1).repartition("subject").write.parquet(f"{root}/task-2")
    return results.read_glob(spark, f"{root}/task-*").select("subject", "user_id", "a", "b")


@query("select vec_id, label, len(embedding) as width, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 4) as squares from embeddings")
def s4_embedding_csv(spark, d):
    """Whole vectors written to CSV as list literals and parsed from there."""
    v = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    path = results.write_literals(v, "embedding", results.new_folder(spark, "embeddings"))
    read = results.read_literals(spark, path, "embedding", "vec_id long, label int, embedding string")
    return read.select("vec_id", "label", F.size("embedding").cast("long").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 4).alias("squares"))
