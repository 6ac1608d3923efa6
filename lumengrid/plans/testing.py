"""p-values of the tests (survey 2.15), from distribution functions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import special
from ..operators.ranks import average_rank
from ..operators.tables import r6, table
from ..registry import query

#: Up to this many differences without ties the law of the signed-rank sum is counted out, else it is taken as normal.
EXACT = 50


def _simpson(density: str, upper: str, steps: int = 2000) -> str:
    """SQL for the integral of ``density`` (of ``v``) from 0 to ``upper``."""
    f = f"list_sum(list_transform(range({steps} + 1), lambda i: case when i in (0, {steps}) then 1 when i % 2 = 1 then 4 else 2 end * ({density.replace('v', f'(({upper}) * i / {steps})')})))"
    return f"(({upper}) / {3 * steps} * {f})"


_NORMAL = _simpson("exp(-v * v / 2) / sqrt(2 * pi())", "abs(z)")
_LAW = "law(n, p) as (select 0, [1.0::double] union all select n + 1, list_transform(range(1, len(p) + n + 2), lambda i: (coalesce(p[i], 0) + case when i > n + 1 then coalesce(p[i - n - 1], 0) else 0 end) / 2) from law where n < 50)"


@query(f"""with recursive {_LAW}, d as (select c_nationkey, round(c_acctbal - 4000, case when c_nationkey % 2 = 0 then 2 else -3 end) as d from customer where c_acctbal <> 4000),
 r as (select *, rank() over (partition by c_nationkey order by abs(d)) + (count(*) over (partition by c_nationkey, abs(d)) - 1) / 2.0 as r, count(*) over (partition by c_nationkey, abs(d)) as t from d where d <> 0),
 s as (select c_nationkey, count(*) as n, sum(case when d > 0 then r else 0 end) as w, sum(case when d > 0 then r else -r end) / sum(r) as rb, max(t) as ties, sum((t * t - 1) / 48.0) as tied from r group by 1),
 z as (select *, (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tied) as z from s)
 select z.c_nationkey, z.n, round(w, 1) as w_plus, round(rb, 6) as rank_biserial, z.n <= 50 and ties = 1 as exact, round(z, 6) as z,
 round(case when z.n <= 50 and ties = 1 then list_sum(law.p[ceil(w)::int + 1:]) else 0.5 - sign(z) * {_NORMAL} end, 6) as p_greater from z left join law on law.n = z.n""")
def i11_signed_rank_p(spark, d):
    """The signed-rank test, one-sided: counted out for few differences without ties, else by the normal law with its variance lessened by ties."""
    far = F.when(F.col("c_nationkey") % 2 == 0, F.round(F.col("c_acctbal") - 4000, 2)).otherwise(F.round(F.col("c_acctbal") - 4000, -3))
    x = table(spark, d, "customer").filter("c_acctbal <> 4000").select("c_nationkey", far.alias("d")).filter("d <> 0").withColumn("a", F.abs("d"))
    x = x.withColumn("r", average_rank("a", ("c_nationkey",))).withColumn("t", F.count(F.lit(1)).over(Window.partitionBy("c_nationkey", "a")))
    up = F.col("d") > 0
    s = x.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(up, F.col("r")).otherwise(0.0)).alias("w"), (F.sum(F.when(up, F.col("r")).otherwise(-F.col("r"))) / F.sum("r")).alias("rb"),
        F.max("t").alias("ties"), F.sum((F.col("t") * F.col("t") - 1) / 48).alias("tied"),
    )
    n = F.col("n")
    s = s.withColumn("z", (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied"))).withColumn("exact", (n <= EXACT) & (F.col("ties") == 1))
    p = F.when(F.col("exact"), special.signed_rank_upper(F.col("w"), n)).otherwise(special.normal_upper(F.col("z")))
    return s.select("c_nationkey", "n", F.round("w", 1).alias("w_plus"), r6(F.col("rb")).alias("rank_biserial"), "exact", r6(F.col("z")).alias("z"), r6(p).alias("p_greater"))


_T_SHARE = "exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi() * df) * pow(1 + v * v / df, -(df + 1) / 2.0)"


@query(f"""with recursive m as (select o_orderpriority as unit, o_custkey, avg(case when o_orderkey % 2 = 0 then o_totalprice end) - avg(case when o_orderkey % 2 = 1 then o_totalprice end) as d from orders group by all),
 s as (select unit, count(d) as n, avg(d) / 1000 as m, stddev_samp(d) / 1000 as s, (count(d) - 1)::double as df from m group by 1),
 c(unit, df, low, high, k) as (select unit, df, 0.0::double, 200.0::double, 0 from s union all select unit, df, case when 0.475 > {_simpson(_T_SHARE, '(low + high) / 2', 400)} then (low + high) / 2 else low end,
  case when 0.475 > {_simpson(_T_SHARE, '(low + high) / 2', 400)} then high else (low + high) / 2 end, k + 1 from c where k < 40),
 t as (select s.*, m / (s / sqrt(n)) as t, high as c from s join c using (unit) where k = 40)
 select unit, n, round(m, 5) as mean, round(t, 5) as t, round(m / s, 6) as cohen_d, round(1 - 2 * {_simpson(_T_SHARE, 'abs(t)')}, 6) as p, round(m - c * s / sqrt(n), 4) as low, round(m + c * s / sqrt(n), 4) as high from t""")
def i12_paired_p(spark, d):
    """The paired t test of customers' orders of two kinds, two-sided, with the interval by the t quantile."""
    o = table(spark, d, "orders")
    kind = lambda k: F.avg(F.when(F.col("o_orderkey") % 2 == k, F.col("o_totalprice")))
    m = o.groupBy(F.col("o_orderpriority").alias("unit"), "o_custkey").agg((kind(0) - kind(1)).alias("d"))
    s = m.groupBy("unit").agg(F.count("d").alias("n"), (F.avg("d") / 1000).alias("m"), (F.stddev_samp("d") / 1000).alias("s"))
    se, df = F.col("s") / F.sqrt("n"), (F.col("n") - 1).cast("double")
    t, half = F.col("m") / se, special.t_critical(0.05, df) * se
    return s.select(
        "unit", "n", F.round("m", 5).alias("mean"), F.round(t, 5).alias("t"), r6(F.col("m") / F.col("s")).alias("cohen_d"), r6(special.t_two_sided(t, df)).alias("p"),
        F.round(F.col("m") - half, 4).alias("low"), F.round(F.col("m") + half, 4).alias("high"),
    )


@query("""with g as (select o_orderpriority as unit, o_orderstatus as level, count(*) as n, avg(o_totalprice) as m, sum(o_totalprice ** 2) as q from orders group by all),
 t as (select unit, count(*) - 1 as df1, sum(n) - count(*) as df2, sum(n * m * m) - sum(n * m) ** 2 / sum(n) as b, sum(q) - sum(n * m * m) as w from g group by 1)
 select unit, df1::bigint as df1, df2::bigint as df2, round(b / df1 / (w / df2), 5) as f, round(pow(df2 / (df2 + df1 * (b / df1 / (w / df2))), df2 / 2.0), 6) as p from t""")
def i13_anova_p(spark, d):
    """One-way F of three groups with its p, which has a closed form in SQL (two degrees of freedom above)."""
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("unit"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"), F.sum(F.col("o_totalprice") ** 2).alias("q"))
    squares, n = F.sum(F.col("n") * F.col("m") ** 2), F.sum("n")
    t = g.groupBy("unit").agg(
        (F.count(F.lit(1)) - 1).alias("df1"), (n - F.count(F.lit(1))).alias("df2"), (squares - F.sum(F.col("n") * F.col("m")) ** 2 / n).alias("b"), (F.sum("q") - squares).alias("w")
    )
    f = (F.col("b") / F.col("df1")) / (F.col("w") / F.col("df2"))
    return t.select("unit", "df1", "df2", F.round(f, 5).alias("f"), r6(special.f_upper(f, F.col("df1").cast("double"), F.col("df2").cast("double"))).alias("p"))


_CHI = _simpson("2 * pow(v, df - 1) * exp(-v * v / 2) / exp(df / 2.0 * ln(2) + lgamma(df / 2.0))", "sqrt(chi2)", 4000)


@query(f"""with c as (select source, lang, toxic, count(*)::double as n from documents join labels using (doc_id) group by all),
 g as (select s.source, a.lang, b.toxic, coalesce(c.n, 0) as n from (select distinct source from c) s cross join (select distinct lang from c) a cross join (select 0 as toxic union all select 1) b left join c on c.source is not distinct from s.source and c.lang = a.lang and c.toxic = b.toxic),
 e as (select *, sum(n) over (partition by source, lang) as row, sum(n) over (partition by source, toxic) as col, sum(n) over (partition by source) as total from g),
 t as (select source, sum((n - row * col / total) ** 2 / (row * col / total)) as chi2, (count(distinct lang) - 1) * (count(distinct toxic) - 1)::double as df from e where row > 0 and col > 0 group by 1)
 select source, df::bigint as df, round(chi2, 6) as chi2, round(case when df > 0 then 1 - {_CHI} end, 6) as p from t""")
def i15_chi_square_p(spark, d):
    """Independence of language and toxicity for each source, with its p; rows and columns without a document do not count."""
    both = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id").groupBy("source", "lang", "toxic").agg(F.count(F.lit(1)).alias("n"))
    cells = both.groupBy("source", "lang").agg(*(F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)))
    own = Window.partitionBy("source")
    row, cols = F.col("n0") + F.col("n1"), [F.sum("n0").over(own), F.sum("n1").over(own)]
    total = cols[0] + cols[1]
    cells = cells.withColumn("_x", F.array(*(F.when(c > 0, (F.col(f"n{k}") - row * c / total) ** 2 / (row * c / total)) for k, c in enumerate(cols)))).withColumn("_c", (cols[0] > 0).cast("int") + (cols[1] > 0).cast("int"))
    t = cells.groupBy("source").agg(F.sum(F.aggregate("_x", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))).alias("chi2"), ((F.count(F.lit(1)) - 1) * (F.first("_c") - 1)).alias("df"))
    return t.select("source", "df", r6(F.col("chi2")).alias("chi2"), r6(special.chi_square_upper(F.col("chi2"), F.col("df").cast("double"))).alias("p"))


@query("""with b as (select user_id, event_type, avg(value) as v from events group by all), f as (select user_id from b group by 1 having count(*) = (select count(distinct event_type) from events)),
 r as (select user_id, event_type, rank() over (partition by user_id order by v) + (count(*) over (partition by user_id, v) - 1) / 2.0 as r from b where user_id in (from f)),
 s as (select event_type, sum(r) as s, count(*)::double as n from r group by 1), t as (select any_value(n) as n, count(*) as k, 12.0 / (any_value(n) * count(*) * (count(*) + 1)) * sum(s * s) - 3 * any_value(n) * (count(*) + 1) as chi2 from s)
 select n::bigint as n, k - 1 as df, round(chi2, 6) as chi2, round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) as p from t""")
def i16_friedman_p(spark, d):
    """I16: Friedman's test over all conditions (five event types: four degrees of freedom, whose tail SQL has in closed form), with its p."""
    b = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    kinds = b.select("event_type").distinct().count()
    r = b.withColumn("r", average_rank("v", ("user_id",))).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("user_id"))).filter(F.col("k") == kinds)
    s = r.groupBy("event_type").agg(F.sum("r").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    n, k = F.first("n"), F.count(F.lit(1))
    t = s.agg(n.alias("n"), k.alias("k"), (12.0 / (n * k * (k + 1)) * F.sum(F.col("s") ** 2) - 3 * n * (k + 1)).alias("chi2"))
    df = F.col("k") - 1
    return t.select(F.col("n").cast("long").alias("n"), df.alias("df"), r6(F.col("chi2")).alias("chi2"), r6(special.chi_square_upper(F.col("chi2"), df.cast("double"))).alias("p"))
