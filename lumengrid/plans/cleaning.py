"""Cleaning of design and response rows, masks, positions, and statistics without refits (survey 2.2, 2.5-2.8, 2.12, 2.14-2.16)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.tables import micros, r6, table
from ..registry import query

_NAN = float("nan")


def _nan_where(condition, column: str):
    return F.when(condition, F.lit(_NAN)).otherwise(F.col(column))


@query("select l_orderkey, l_linenumber, l_discount, l_tax, l_quantity from lineitem where l_discount <> 0 and l_tax <> 0 and l_quantity <= 40")
def p4_complete_rows(spark, d):
    """Rows with any NaN among features or responses go (zero rates and large quantities are marked missing here)."""
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", _nan_where(F.col("l_discount") == 0, "l_discount").alias("l_discount"), _nan_where(F.col("l_tax") == 0, "l_tax").alias("l_tax"),
        _nan_where(F.col("l_quantity") > 40, "l_quantity").alias("l_quantity"),
    )
    return rows.filter(~F.exists(F.array("l_discount", "l_tax", "l_quantity"), lambda x: F.isnan(x) | x.isNull()))


@query("select l_orderkey, l_linenumber from lineitem where not (l_discount = 0 and l_tax = 0) and not (l_quantity > 40 and l_extendedprice > 40000)")
def p5_rows_not_all_missing(spark, d):
    """P5: rows go when all features, or all responses, are NaN."""
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array(_nan_where(F.col("l_discount") == 0, "l_discount"), _nan_where(F.col("l_tax") == 0, "l_tax")).alias("x"),
        F.array(_nan_where(F.col("l_quantity") > 40, "l_quantity"), _nan_where(F.col("l_extendedprice") > 40000, "l_extendedprice")).alias("y"),
    )
    return rows.filter(~F.forall("x", F.isnan) & ~F.forall("y", F.isnan)).select("l_orderkey", "l_linenumber")


@query("select p_partkey, region from part join (values ('low', 1, 15), ('mid', 16, 35), ('high', 36, 60)) r(region, lo, hi) on p_size between lo and hi where p_partkey % 6 in (4, 5)")
def p6_units_by_quality_and_range(spark, d):
    """Units of accepted quality (4 or 5) whose channel lies in a region's range."""
    ranges = spark.createDataFrame([("low", 1, 15), ("mid", 16, 35), ("high", 36, 60)], "region string, lo int, hi int")
    good = table(spark, d, "part").filter((F.col("p_partkey") % 6).isin(4, 5))
    return good.join(F.broadcast(ranges), F.col("p_size").between(F.col("lo"), F.col("hi"))).select("p_partkey", "region")


@query("""select user_id, bool_or(p < 0.5 and effect > 0) as significant, count(*) filter (where p < 0.5 and effect > 0) as n_conditions from (
 select user_id, event_type, (1.0 + count(*) filter (where value > 60)) / (1.0 + count(*)) as p, avg(value) - 20 as effect from events group by all) group by user_id""")
def p11_significance_masks(spark, d):
    """Units with a significant positive effect in any condition."""
    cells = table(spark, d, "events").groupBy("user_id", "event_type").agg(
        ((F.count(F.when(F.col("value") > 60, 1)) + 1.0) / (F.count(F.lit(1)) + 1.0)).alias("p"), (F.avg("value") - 20).alias("effect")
    )
    mask = (F.col("p") < 0.5) & (F.col("effect") > 0)
    return cells.groupBy("user_id").agg(F.bool_or(mask).alias("significant"), F.count(F.when(mask, 1)).alias("n_conditions"))


@query("select a.c as custkey, a.n as n_first, b.n as n_second from (select o_custkey as c, count(*) as n from orders where year(o_orderdate) < 1996 group by 1) a join (select o_custkey as c, count(*) as n from orders where year(o_orderdate) >= 1996 group by 1) b using (c)")
def j11_shared_index(spark, d):
    """Two frames cut to the index they share."""
    o, early = table(spark, d, "orders"), F.year("o_orderdate") < 1996
    per = lambda rows, name: rows.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias(name))
    return per(o.filter(early), "n_first").join(per(o.filter(~early), "n_second"), "custkey")


@query("""select user_id, min(v) filter (where not isnan(v)) as floor, round(avg(v) filter (where not isnan(v)), 6) as mean, least(min(v) filter (where event_type = 'view'), min(v) filter (where event_type = 'click')) as least_of_two from (
 select user_id, event_type, case when event_type = 'error' then 'nan'::double else value end as v from events) group by user_id""")
def a16_noise_floor(spark, d):
    """Least and mean response without the NaN ones; the smaller of two conditions where either is known."""
    e = table(spark, d, "events").select("user_id", "event_type", _nan_where(F.col("event_type") == "error", "value").alias("v"))
    known, of = F.when(~F.isnan("v"), F.col("v")), lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("v")))
    return e.groupBy("user_id").agg(F.min(known).alias("floor"), r6(F.avg(known)).alias("mean"), F.least(of("view"), of("click")).alias("least_of_two"))


@query("""select event_id, place, sentence, row_number() over (partition by user_id, sentence order by place) - 1 as place_in_sentence from (
 select event_id, user_id, row_number() over o - 1 as place, coalesce(sum((event_type = 'purchase')::int) over (o rows between unbounded preceding and 1 preceding), 0)::bigint as sentence from events window o as (partition by user_id order by ts, event_id))""")
def w4_serial_positions(spark, d):
    """Place in the recording, and in the sentence (each purchase ends one)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ended = F.sum((F.col("event_type") == "purchase").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    e = table(spark, d, "events").select("event_id", "user_id", (F.row_number().over(order) - 1).alias("place"), F.coalesce(ended, F.lit(0)).alias("sentence"))
    inside = Window.partitionBy("user_id", "sentence").orderBy("place")
    return e.select("event_id", "place", "sentence", (F.row_number().over(inside) - 1).alias("place_in_sentence"))


@query("""select event_id, round(ln(1 + gap), 6) as log_gap, round(t, 6) as session_time, round(t * t, 6) as session_time_squared from (
 select event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over o, 0) / 1e6 as gap, (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6 / 86400 as t from events window o as (partition by user_id order by ts, event_id))""")
def f8_timing_nuisances(spark, d):
    """F8: log gap to the event before, time since the session began, and its square."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "user_id", "ts", micros("ts").alias("us"))
    gap = F.coalesce(F.col("us") - F.lag("us").over(order), F.lit(0)) / F.lit(1e6)
    e = e.select("event_id", gap.alias("gap"), ((F.col("us") - F.min("us").over(Window.partitionBy("user_id"))) / F.lit(1e6) / 86400).alias("t"))
    return e.select("event_id", r6(F.log(1 + F.col("gap"))).alias("log_gap"), r6(F.col("t")).alias("session_time"), r6(F.col("t") * F.col("t")).alias("session_time_squared"))


@query("select l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept from lineitem group by 1 having stddev_pop(l_quantity) > 0")
def f16_raw_coefficients(spark, d):
    """F16: a coefficient fitted on the standardised feature, brought back to the raw scale."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.stddev_pop("l_quantity").alias("sd"), F.avg("l_quantity").alias("mean"), F.covar_pop("l_extendedprice", "l_quantity").alias("cov"), F.avg("l_extendedprice").alias("bias")
    ).filter("sd > 0")
    fitted = g.withColumn("w", F.col("cov") / F.col("sd"))  # the least-squares slope on (x - mean) / sd
    return fitted.select("l_suppkey", F.round(F.col("w") / F.col("sd"), 4).alias("slope"), F.round(F.col("bias") - F.col("w") * F.col("mean") / F.col("sd"), 4).alias("intercept"))


@query("""with g as (select user_id, epoch_us(ts) // 86400000000 % 4 as quarter, event_type, value from events where event_type in ('view', 'click', 'purchase')),
 m as (select *, avg(value) over () as grand, avg(value) over (partition by event_type) as c, avg(value) over (partition by quarter) as s, avg(value) over (partition by event_type, quarter) as f from g),
 r as (select sum((f - grand) ** 2) / sum((value - grand) ** 2) as r2_full, sum((c - grand) ** 2) / sum((value - grand) ** 2) as r2_control, sum((s - grand) ** 2) / sum((value - grand) ** 2) as r2_semantic from m)
 select round(r2_full - r2_control, 6) as unique_semantic, round(r2_full - r2_semantic, 6) as unique_control, round(r2_semantic + r2_control - r2_full, 6) as shared from r""")
def i5_variance_parts(spark, d):
    """What two families of features explain alone and together, from R2 of the full and the reduced models (cell means)."""
    g = table(spark, d, "events").filter(F.col("event_type").isin("view", "click", "purchase"))
    g = g.withColumn("us", micros("ts")).select("event_type", F.expr("us div 86400000000 % 4").alias("quarter"), "value")
    cells = g.groupBy("event_type", "quarter").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    total = cells.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).select((F.col("s") * F.col("s") / F.col("n")).alias("base"), (F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("all"))

    def explained(*keys: str, name: str):
        per = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        return per.agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias(name))

    one = total.crossJoin(explained("event_type", "quarter", name="full")).crossJoin(explained("event_type", name="control")).crossJoin(explained("quarter", name="semantic"))  # one row each
    r2 = one.select(*(((F.col(c) - F.col("base")) / F.col("all")).alias(c) for c in ("full", "control", "semantic")))
    return r2.select(r6(F.col("full") - F.col("control")).alias("unique_semantic"), r6(F.col("full") - F.col("semantic")).alias("unique_control"), r6(F.col("semantic") + F.col("control") - F.col("full")).alias("shared"))


@query("""with v as (select user_id, event_type, avg(value) as x from events where event_type in ('view', 'click', 'purchase') group by all), k as (select * from v where user_id in (select user_id from v group by 1 having count(*) = 3)),
 m as (select *, avg(x) over () as g, avg(x) over (partition by event_type) as c, avg(x) over (partition by user_id) as u from k)
 select count(distinct user_id) as n_units, round((sum((c - g) ** 2) / 2) / (sum((x - c - u + g) ** 2) / (2 * (count(distinct user_id) - 1))), 6) as f from m""")
def i14_repeated_measures(spark, d):
    """One-factor repeated-measures F over units with a mean in every condition."""
    v = table(spark, d, "events").filter(F.col("event_type").isin("view", "click", "purchase")).groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.avg("value"))
    v = v.dropna().withColumn("u", (F.col("view") + F.col("click") + F.col("purchase")) / 3)
    kinds = ("view", "click", "purchase")
    s = v.agg(F.count(F.lit(1)).alias("n"), *(F.avg(k).alias(k) for k in kinds), F.avg("u").alias("g"), F.var_pop("u").alias("vu"), *(F.var_pop(k).alias("v_" + k) for k in kinds))
    square = lambda x: x * x
    factor = F.col("n") * sum((square(F.col(k) - F.col("g")) for k in kinds), F.lit(0.0))
    within = F.col("n") * sum((F.col("v_" + k) for k in kinds), F.lit(0.0))  # around each condition's own mean
    error = within - 3 * F.col("n") * F.col("vu")
    return s.select(F.col("n").alias("n_units"), r6((factor / 2) / (error / (2 * (F.col("n") - 1)))).alias("f"))


@query("""with n as (select user_id, count(*) as n from events group by 1), t as (select floor(median(n))::bigint as target from n),
 r as (select user_id, event_id, row_number() over (partition by user_id order by md5(event_id::varchar), event_id) - 1 as r, count(*) over (partition by user_id) as n from events)
 select user_id, event_id, target // n + (r < target % n)::bigint as copies from r, t where target // n + (r < target % n)::bigint > 0""")
def b7_resampled_to_median(spark, d):
    """Every unit brought to the median number of rows, by repeats where it has fewer and by hash order."""
    e = table(spark, d, "events").select("user_id", "event_id")
    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    target = n.agg(F.floor(F.median("n")).alias("target"))
    order = Window.partitionBy("user_id").orderBy(F.md5(F.col("event_id").cast("string").cast("binary")), "event_id")
    ranked = e.withColumn("r", F.row_number().over(order) - 1).join(n, "user_id").crossJoin(F.broadcast(target))  # one row
    return ranked.withColumn("copies", F.expr("target div n + if(r < target % n, 1, 0)")).filter("copies > 0").select("user_id", "event_id", "copies")


@query("select user_id, count(*) as n, case when least(50, count(*) // 5 - 2) >= 2 then least(50, count(*) // 5 - 2) end as components from events group by 1")
def b9_component_counts(spark, d):
    """Components that a unit's rows bear in each of five folds, 50 at most; null where not even two."""
    n = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    k = F.least(F.lit(50), F.expr("n div 5 - 2"))
    return n.select("user_id", "n", F.when(k >= 2, k).alias("components"))


def _placed(spark, d):
    """Whole-number responses ``y`` of units in order, with a fitted rate ``mu`` by condition, and contiguous folds."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("y", F.floor(F.col("value") / 20).cast("double"))
    mu = e.groupBy("event_type").agg((F.avg("y") + 0.1).alias("mu"))
    size = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    placed = e.withColumn("place", F.row_number().over(order) - 1).join(F.broadcast(mu), "event_type").join(size, "user_id")
    return placed.withColumn("fold", F.expr("place * 4 div n")).select("user_id", "place", "fold", "n", "y", "mu")


_PLACED = """e as (select *, floor(value / 20) as y from events), m as (select event_type, avg(y) + 0.1 as mu from e group by 1),
 p as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as place, count(*) over (partition by user_id) as n, y, mu from e join m using (event_type)),
 g as (select *, place * 4 // n as fold from p)"""


@query(f"""with {_PLACED} select g.user_id, lag, round(sum(h.y * ln(g.mu) - g.mu), 6) as ll from g, (values (0), (1), (2), (3)) l(lag) join g h on h.user_id = g.user_id and h.place = (g.place + lag * g.n // 4) % g.n group by all""")
def n5_shifted_likelihoods(spark, d):
    """Log likelihood under the fitted rates of responses shifted in a circle by quarters, without refits (lag 0: as observed)."""
    g = _placed(spark, d)
    asked = g.withColumn("lag", F.explode(F.array(*map(F.lit, range(4))))).select("user_id", "lag", "mu", F.expr("(place + lag * n div 4) % n").alias("place"))
    found = asked.join(g.select("user_id", "place", "y"), ["user_id", "place"])
    return found.groupBy("user_id", "lag").agg(r6(F.sum(F.col("y") * F.log("mu") - F.col("mu"))).alias("ll"))


@query(f"""with {_PLACED}, f as (select *, count(*) over (partition by user_id, fold) as size, row_number() over (partition by user_id, fold order by place) - 1 as r from g)
 select a.user_id, round(sum(a.y * ln(a.mu) - a.mu), 6) as ll, round(sum(b.y * ln(a.mu) - a.mu), 6) as ll_shifted from f a join f b on b.user_id = a.user_id and b.fold = a.fold and b.r = (a.r + a.size // 2) % a.size group by 1""")
def n6_shifts_within_folds(spark, d):
    """The same with a shift by half of each test fold, inside it."""
    fold = Window.partitionBy("user_id", "fold")
    f = _placed(spark, d).withColumn("size", F.count(F.lit(1)).over(fold)).withColumn("r", F.row_number().over(fold.orderBy("place")) - 1)
    asked = f.select("user_id", "fold", "mu", F.col("y").alias("own"), F.expr("(r + size div 2) % size").alias("r"))
    both = asked.join(f.select("user_id", "fold", "r", "y"), ["user_id", "fold", "r"])
    ll = lambda y: r6(F.sum(F.col(y) * F.log("mu") - F.col("mu")))
    return both.groupBy("user_id").agg(ll("own").alias("ll"), ll("y").alias("ll_shifted"))
