"""Scores and tests (survey 2.15)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.ranks import average_rank
from ..operators.tables import correlation, dealt, r6, table
from ..registry import query

_FIT = "select l_suppkey, floor(l_quantity) as y, 1 + l_discount * 200 as mu, avg(floor(l_quantity)) over (partition by l_suppkey) as m from lineitem"
_LL = "sum(y * ln({0}) - {0} - lgamma(y + 1))"


@query(f"""select l_suppkey, round(ll, 3) as ll, round(null_ll, 3) as null_ll, round(sat, 3) as sat, round(case when sat - null_ll > 0.1 then (ll - null_ll) / (sat - null_ll) end, 6) as dev_r2,
 round(case when null_ll < -0.1 then 1 - ll / null_ll end, 6) as mcfadden, round(ll - null_ll, 3) as gain, round(2 * 3 - 2 * ll, 3) as aic, round(3 * ln(n) - 2 * ll, 3) as bic
 from (select l_suppkey, {_LL.format('mu')} as ll, {_LL.format('m')} as null_ll, sum(case when y > 0 then y * ln(y) else 0 end - y - lgamma(y + 1)) as sat, count(*) as n from ({_FIT}) group by 1)""")
def i1_i9_likelihoods(spark, d):
    """Model, mean and saturated log-likelihoods and what is made of them."""
    y = F.floor("l_quantity").cast("double")
    own = Window.partitionBy("l_suppkey")
    rows = table(spark, d, "lineitem").select("l_suppkey", y.alias("y"), (1 + F.col("l_discount") * 200).alias("mu"))
    rows = rows.withColumn("m", F.avg("y").over(own)).withColumn("lg", F.expr("aggregate(sequence(1, greatest(cast(y as int), 1)), 0D, (a, k) -> a + ln(k))"))
    ll = lambda mu: F.sum(F.col("y") * F.ln(mu) - F.col(mu) - F.col("lg"))
    sat = F.sum(F.when(F.col("y") > 0, F.col("y") * F.ln("y")).otherwise(0.0) - F.col("y") - F.col("lg"))
    s = rows.groupBy("l_suppkey").agg(ll("mu").alias("a"), ll("m").alias("b"), sat.alias("s"), F.count(F.lit(1)).alias("n"))
    a, b, s_ = F.col("a"), F.col("b"), F.col("s")
    r3 = lambda c: F.round(c, 3)
    return s.select(
        "l_suppkey", r3(a).alias("ll"), r3(b).alias("null_ll"), r3(s_).alias("sat"), r6(F.when(s_ - b > 0.1, (a - b) / (s_ - b))).alias("dev_r2"), r6(F.when(b < -0.1, 1 - a / b)).alias("mcfadden"),
        r3(a - b).alias("gain"), r3(6 - 2 * a).alias("aic"), r3(3 * F.ln("n") - 2 * a).alias("bic"),
    )


@query("""select l_suppkey, round(corr(l_quantity, l_extendedprice), 6) as pearson, round(corr(ra, rb), 6) as spearman, round(regr_slope(l_extendedprice, l_quantity), 4) as slope from (select *,
 rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2.0 as ra, rank() over (partition by l_suppkey order by l_extendedprice) + (count(*) over (partition by l_suppkey, l_extendedprice) - 1) / 2.0 as rb from lineitem) group by 1""")
def i10_i19_correlations(spark, d):
    """Pearson, Spearman and trend per unit."""
    # two sorts of a task's rows are held at a time
    rows = dealt(table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice"), 200_000, "l_suppkey")
    rows = rows.withColumn("ra", average_rank("l_quantity", ("l_suppkey",))).withColumn("rb", average_rank("l_extendedprice", ("l_suppkey",)))
    return rows.groupBy("l_suppkey").agg(
        r6(correlation("l_quantity", "l_extendedprice")).alias("pearson"), r6(correlation("ra", "rb")).alias("spearman"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope")
    )


@query("""select c_nationkey, round(sum(case when d > 0 then r else 0 end), 3) as w_plus, round((sum(case when d > 0 then r else 0 end) - sum(case when d < 0 then r else 0 end)) / sum(r), 6) as rank_biserial from
 (select c_nationkey, c_custkey, d, rank() over (partition by c_nationkey order by abs(d)) + (count(*) over (partition by c_nationkey, abs(d)) - 1) / 2.0 as r from (select c_nationkey, c_custkey, floor(c_acctbal / 100) - 40 as d from customer) where d <> 0) group by 1""")
def i11_signed_ranks(spark, d):
    """Wilcoxon's signed-rank sum and the rank-biserial correlation."""
    x = table(spark, d, "customer").select("c_nationkey", (F.floor(F.col("c_acctbal") / 100) - 40).alias("d")).filter("d <> 0").withColumn("a", F.abs("d"))
    x = x.withColumn("r", average_rank("a", ("c_nationkey",)))
    plus, minus = F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0))
    return x.groupBy("c_nationkey").agg(F.round(plus, 3).alias("w_plus"), r6((plus - minus) / F.sum("r")).alias("rank_biserial"))


@query("select event_type, round(avg(value - 50) / (stddev_samp(value) / sqrt(count(*))), 6) as t, round(avg(value - 50) / stddev_samp(value), 6) as cohen_d from events group by 1")
def i12_t_statistics(spark, d):
    m, s, n = F.avg(F.col("value") - 50), F.stddev_samp("value"), F.count(F.lit(1))
    return table(spark, d, "events").groupBy("event_type").agg(r6(m / (s / F.sqrt(n))).alias("t"), r6(m / s).alias("cohen_d"))


@query("""with g as (select event_type, count(*) as n, avg(value) as m, sum(value) as s, sum(value * value) as q from events group by 1), t as (select count(*) as k, sum(n) as n, sum(s) / sum(n) as m from g)
 select round((sum(g.n * (g.m - t.m) * (g.m - t.m)) / (any_value(t.k) - 1)) / (sum(g.q - g.n * g.m * g.m) / (any_value(t.n) - any_value(t.k))), 5) as f from g, t""")
def i13_anova(spark, d):
    """One-way F from group sums."""
    g = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.sum(F.col("value") * F.col("value")).alias("q"))
    n, k = F.sum("n"), F.count(F.lit(1))
    mean = F.sum(F.col("n") * F.col("m")) / n
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * mean * mean
    within = F.sum(F.col("q") - F.col("n") * F.col("m") * F.col("m"))
    return g.agg(F.round((between / (k - 1)) / (within / (n - k)), 5).alias("f"))


@query("""with c as (select lang, toxic, count(*)::double as n from documents join labels using (doc_id) group by all), g as (select a.lang, b.toxic, coalesce(c.n, 0) as n from (select distinct lang from c) a cross join (select distinct toxic from c) b left join c on c.lang = a.lang and c.toxic = b.toxic),
 e as (select lang, toxic, n, sum(n) over (partition by lang) * sum(n) over (partition by toxic) / sum(n) over () as x from g) select lang, toxic, n::bigint as n, round((n - x) / sqrt(x), 6) as residual, round(sum((n - x) * (n - x) / x) over (), 6) as chi2 from e""")
def i15_chi_square(spark, d):
    """Independence test with standardised residuals over a contingency table."""
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang", "toxic").agg(F.count(F.lit(1)).alias("n"))
    grid = both.select("lang").distinct().withColumn("toxic", F.explode(F.array(F.lit(0), F.lit(1))))
    g = grid.join(both, ["lang", "toxic"], "left").fillna(0, ["n"])
    every = Window.partitionBy()
    x = F.sum("n").over(Window.partitionBy("lang")) * F.sum("n").over(Window.partitionBy("toxic")) / F.sum("n").over(every)
    g = g.withColumn("x", x)
    return g.select("lang", "toxic", "n", r6((F.col("n") - F.col("x")) / F.sqrt("x")).alias("residual"), r6(F.sum((F.col("n") - F.col("x")) ** 2 / F.col("x")).over(every)).alias("chi2"))


@query("""with b as (select user_id, event_type, avg(value) as v from events where event_type in ('view', 'click', 'purchase') group by all), f as (select user_id from b group by 1 having count(*) = 3),
 r as (select event_type, rank() over (partition by user_id order by v) as r from b where user_id in (from f)), s as (select event_type, sum(r) as s, count(*) as n from r group by 1) select round(12.0 / (any_value(n) * 3 * 4) * sum(s * s) - 3 * any_value(n) * 4, 6) as chi2 from s""")
def i16_friedman(spark, d):
    b = table(spark, d, "events").filter(F.col("event_type").isin("view", "click", "purchase")).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    b = b.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("user_id"))).filter("k = 3")
    r = b.withColumn("r", F.rank().over(Window.partitionBy("user_id").orderBy("v")))
    s = r.groupBy("event_type").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"))
    n = F.first("n")
    return s.agg(r6(12.0 / (n * 12) * F.sum(F.col("s") * F.col("s")) - 12 * n).alias("chi2"))


@query("select lang, round(avg((toxic = 1 and quality = 0)::int) / nullif(avg(toxic) * avg((quality = 0)::int), 0), 6) as enrichment from documents join labels using (doc_id) group by 1")
def i17_enrichment(spark, d):
    """Observed over expected overlap of two flags."""
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    a, b = F.col("toxic").cast("double"), (F.col("quality") == 0).cast("double")
    return both.groupBy("lang").agg(r6(F.avg(a * b) / F.nullif(F.avg(a) * F.avg(b), F.lit(0.0))).alias("enrichment"))


@query("""with s as (select o_orderpriority as unit, avg(o_totalprice) as s from orders group by 1), n as (select o_orderpriority as unit, k, avg(case when (ascii(md5(k || ':' || o_orderkey)) % 2) = 0 then o_totalprice else 300000 - o_totalprice end) as v from orders, range(1, 20) t(k) group by all)
 select s.unit, round((1 + count(*) filter (where v >= s)) / (1.0 + count(*)), 6) as p, round(count(*) filter (where v >= s) / count(*)::double, 6) as p_raw, round((any_value(s) - avg(v)) / stddev_pop(v), 4) as z from s join n using (unit) group by 1""")
def i7_i20_permutation_p(spark, d):
    """Corrected and raw permutation p-values and the null's z, with a sign-flip null by hash."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("unit"), "o_orderkey", F.col("o_totalprice").alias("x"))
    s = o.groupBy("unit").agg(F.avg("x").alias("s"))
    each = o.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(19))))
    heads = F.ascii(F.md5(F.concat_ws(":", F.col("k").cast("string"), F.col("o_orderkey").cast("string")))) % 2 == 0
    n = each.groupBy("unit", "k").agg(F.avg(F.when(heads, F.col("x")).otherwise(300000 - F.col("x"))).alias("v")).join(s, "unit")
    more = F.count(F.when(F.col("v") >= F.col("s"), 1))
    return n.groupBy("unit").agg(r6((1 + more) / (1 + F.count(F.lit(1)))).alias("p"), r6(more / F.count(F.lit(1))).alias("p_raw"), F.round((F.first("s") - F.avg("v")) / F.stddev_pop("v"), 4).alias("z"))
