"""Decoding, reliability, geometry, smoothing and sessions (survey 2.7, 2.17, 2.19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import shuffle_key
from ..operators.tables import correlation, micros, r6, table
from ..registry import query
from ..streaming.sessions import session_counts, tumbling_counts

_BAYES = """m as (select l_returnflag as c, avg(l_quantity) + 0.001 as a, avg(l_linenumber) + 0.001 as b, ln(count(*)::double / sum(count(*)) over () + 1e-30) as p from lineitem group by 1),
 f as (select distinct l_quantity as q, l_linenumber as k from lineitem), s as (select q, k, c, q * ln(a) + k * ln(b) - (a + b) + p as s from f, m),
 best as (select q, k, first(c order by s desc, c) as predicted from s group by 1, 2),
 conf as (select l_returnflag as actual, predicted, count(*) as n from lineitem join best on q = l_quantity and k = l_linenumber group by 1, 2)"""


def _confusion(spark, d) -> DataFrame:
    """Poisson naive Bayes of the return flag from two counts: fitted by means, one row of classes meets the data."""
    items = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("actual"), F.col("l_quantity").alias("q"), F.col("l_linenumber").alias("k"))
    per = items.groupBy("actual").agg((F.avg("q") + 0.001).alias("a"), (F.avg("k") + 0.001).alias("b"), F.count(F.lit(1)).alias("n"))
    model = per.agg(F.collect_list(F.struct("actual", "a", "b", "n")).alias("m"), F.sum("n").alias("all"))
    score = lambda m: F.col("q") * F.ln(m["a"]) + F.col("k") * F.ln(m["b"]) - (m["a"] + m["b"]) + F.ln(m["n"] / F.col("all") + 1e-30)
    best = F.array_min(F.transform("m", lambda m: F.struct((-score(m)).alias("s"), m["actual"].alias("c"))))["c"]
    # counted before it is scored: the pairs of counts are few, whatever the rows
    counted = items.groupBy("actual", "q", "k").agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(F.broadcast(model)).withColumn("predicted", best).groupBy("actual", "predicted").agg(F.sum("n").alias("n"))  # one row


@query(f"with {_BAYES} select actual, predicted, n::bigint as n from conf")
def c3_naive_bayes(spark, d):
    """Poisson naive Bayes with empirical priors; ties go to the first class."""
    return _confusion(spark, d)


@query(f"""with {_BAYES}, c as (select c from (select actual as c from conf union select predicted from conf)),
 t as (select c.c, coalesce(sum(n) filter (where actual = c.c and predicted = c.c), 0) as hit, coalesce(sum(n) filter (where actual = c.c), 0) as support, coalesce(sum(n) filter (where predicted = c.c), 0) as named from c, conf group by 1)
 select round(avg(case when support > 0 then hit / support end), 6) as bal_acc, round(sum(hit) / sum(support), 6) as acc, round(avg(2 * hit / (support + named)), 6) as f1 from t""")
def c2_scores(spark, d):
    """Balanced accuracy, accuracy and macro F1 of a confusion table."""
    conf = _confusion(spark, d)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = conf.select(F.col("actual").alias("c"), hit.alias("hit"), F.col("n").alias("support"), zero.alias("named"))
    sides = sides.unionByName(conf.select(F.col("predicted").alias("c"), zero.alias("hit"), zero.alias("support"), F.col("n").alias("named")))
    t = sides.groupBy("c").agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("named").alias("named"))
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support"))
    return t.agg(r6(F.avg(recall)).alias("bal_acc"), r6(F.sum("hit") / F.sum("support")).alias("acc"), r6(F.avg(2 * F.col("hit") / (F.col("support") + F.col("named")))).alias("f1"))


@query("""with e as (select user_id, event_type as cond, hour(ts) // 4 as slot, value, row_number() over (partition by user_id, event_type order by ts, event_id) % 2 as half from events where event_type in ('view', 'click')),
 b as (select user_id, cond, slot, avg(value) filter (where half = 0) as h0, avg(value) filter (where half = 1) as h1 from e group by all),
 r as (select user_id, cond, case when count(*) >= 3 then greatest(corr(h0, h1), 0) end as r from b where h0 is not null and h1 is not null group by all),
 s as (select user_id, max(2 * r / (1 + r)) filter (where cond = 'view') as sb_view, max(2 * r / (1 + r)) filter (where cond = 'click') as sb_click from r group by 1)
 select user_id, round(sb_view, 6) as sb_view, round(sb_click, 6) as sb_click, round(sqrt(sb_view * sb_click), 6) as ceiling from s""")
def r3_noise_ceiling(spark, d):
    """Split-half correlations per condition, Spearman-Brown, clamped, and their geometric mean."""
    e = table(spark, d, "events").filter(F.col("event_type").isin("view", "click"))
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = e.withColumn("half", F.row_number().over(order) % 2).withColumn("slot", F.floor(F.hour("ts") / 4))
    mean = lambda h: F.avg(F.when(F.col("half") == h, F.col("value")))
    b = e.groupBy("user_id", "event_type", "slot").agg(mean(0).alias("h0"), mean(1).alias("h1")).filter("h0 is not null and h1 is not null")
    r = b.groupBy("user_id", "event_type").agg(F.when(F.count(F.lit(1)) >= 3, F.greatest(correlation("h0", "h1"), F.lit(0.0))).alias("r"))
    r = r.withColumn("sb", 2 * F.col("r") / (1 + F.col("r")))
    of = lambda c: F.max(F.when(F.col("event_type") == c, F.col("sb")))
    s = r.groupBy("user_id").agg(of("view").alias("v"), of("click").alias("c"))
    return s.select("user_id", r6(F.col("v")).alias("sb_view"), r6(F.col("c")).alias("sb_click"), r6(F.sqrt(F.col("v") * F.col("c"))).alias("ceiling"))


@query("""with e as (select user_id, event_type, value, ntile(4) over (partition by user_id order by ts, event_id) as fold from events), b as (select user_id, fold, event_type, avg(value) as b from e group by all),
 p as (select x.user_id, x.fold as f, y.fold as g, case when count(*) >= 3 then corr(x.b, y.b) end as r from b x join b y on x.user_id = y.user_id and x.event_type = y.event_type and x.fold < y.fold group by all)
 select user_id, count(r) as pairs, round(avg(r), 6) as fold_corr from p group by 1""")
def r5_fold_correlation(spark, d):
    """Mean correlation of coefficients between folds; at most four folds meet per unit and feature."""
    fold = F.ntile(4).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    b = table(spark, d, "events").select("user_id", "event_type", "value", fold.alias("fold")).groupBy("user_id", "fold", "event_type").agg(F.avg("value").alias("b"))
    other = b.select("user_id", "event_type", F.col("fold").alias("g"), F.col("b").alias("b2"))
    p = b.join(other, ["user_id", "event_type"]).filter("fold < g").groupBy("user_id", "fold", "g").agg(F.when(F.count(F.lit(1)) >= 3, correlation("b", "b2")).alias("r"))
    return p.groupBy("user_id").agg(F.count("r").alias("pairs"), r6(F.avg("r")).alias("fold_corr"))


_GEOMETRIES = """e as (select label, embedding, row_number() over (partition by label order by vec_id) % 2 as half from embeddings),
 u as (select label, half, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from e), m as (select label, half, i, avg(x) as x from u group by all),
 c as (select label, half, list(x order by i) as v from m group by all),
 r as (select a.half, a.label as l1, b.label as l2, 1 - list_cosine_similarity(a.v, b.v) as dist from c a join c b on a.half = b.half and a.label < b.label),
 w as (select l1, l2, x.dist as d0, y.dist as d1 from r x join r y using (l1, l2) where x.half = 0 and y.half = 1)"""


def _geometries(spark, d) -> DataFrame:
    """Cosine distances ``d0`` and ``d1`` between class means in two halves, a row per pair of classes."""
    half = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) % 2
    # numbered in a step of its own: beside a generator the window would number exploded rows
    halves = table(spark, d, "embeddings").select("label", "embedding", half.alias("half"))
    v = halves.select("label", "half", F.posexplode("embedding").alias("i", "x"))
    m = v.groupBy("label", "half", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    other = m.select("half", "i", F.col("label").alias("label2"), F.col("x").alias("y"))
    # class means are few; they meet by half and coordinate, never as whole vectors
    p = m.join(other, ["half", "i"]).filter("label < label2").groupBy("half", "label", "label2").agg(
        (1 - F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("dist")
    )
    of = lambda h: F.max(F.when(F.col("half") == h, F.col("dist")))
    return p.groupBy("label", "label2").agg(of(0).alias("d0"), of(1).alias("d1")).filter("d0 is not null and d1 is not null")


@query(f"with {_GEOMETRIES} select count(*) as pairs, round(corr(d0, d1), 6) as rsa from w")
def x2_similarity_of_geometries(spark, d):
    """Cosine distances between class means in two halves, and the correlation of their upper triangles."""
    return _geometries(spark, d).agg(F.count(F.lit(1)).alias("pairs"), r6(correlation("d0", "d1")).alias("rsa"))


@query(f"""with {_GEOMETRIES}, l as (select label, row_number() over (order by label) as i from (select l1 as label from w union select l2 from w)),
 q as (select p, label, row_number() over (partition by p order by case when p = 0 then '' else md5('16:' || p || ':' || label) end, label) as i from l, range(100) t(p)),
 k as (select q.p, l.label, q.label as drawn from l join q using (i)),
 z as (select a.p, round(corr(w.d0, v.d1), 6) as r from w join k a on a.label = w.l1 join k b on b.label = w.l2 and b.p = a.p join w v on v.l1 = least(a.drawn, b.drawn) and v.l2 = greatest(a.drawn, b.drawn) group by 1)
 select count(*) - 1 as permutations, max(r) filter (where p = 0) as r, (1 + count(*) filter (where p > 0 and r >= (select r from z where p = 0))) / count(*) as p_right from z""")
def n16_permuted_geometry(spark, d):
    """The correlation of two geometries against 99 permutations of the classes of one of them, by hash order."""
    w = _geometries(spark, d)
    labels = w.select("label").union(w.select("label2")).distinct()
    numbered = labels.withColumn("i", F.row_number().over(Window.orderBy("label")))  # a row per class
    key = F.when(F.col("p") == 0, F.lit("")).otherwise(shuffle_key("16", "p", "label"))
    drawn = labels.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(99))))
    drawn = drawn.select("p", F.col("label").alias("drawn"), F.row_number().over(Window.partitionBy("p").orderBy(key, "label")).alias("i"))
    maps = numbered.join(drawn, "i").select("p", "label", "drawn")
    second = maps.select("p", F.col("label").alias("label2"), F.col("drawn").alias("drawn2"))
    met = w.select("label", "label2", "d0").join(maps, "label").join(second, ["p", "label2"])
    met = met.select("p", "d0", F.least("drawn", "drawn2").alias("label"), F.greatest("drawn", "drawn2").alias("label2"))
    r = met.join(w.select("label", "label2", "d1"), ["label", "label2"]).groupBy("p").agg(r6(correlation("d0", "d1")).alias("r"))
    s = r.agg(F.max(F.when(F.col("p") == 0, F.col("r"))).alias("r"), F.collect_list(F.when(F.col("p") > 0, F.col("r"))).alias("null"))  # 99 numbers
    above = F.size(F.filter("null", lambda x: x >= F.col("r")))
    return s.select(F.size("null").cast("long").alias("permutations"), "r", ((1 + above) / (1 + F.size("null"))).alias("p_right"))


HALF = 7


def _savgol(i: int) -> float:
    """Weight at ``i`` of the cubic least-squares fit over ``2 * HALF + 1`` points."""
    m = HALF
    return 3 * (3 * m * m + 3 * m - 1 - 5 * i * i) / ((2 * m - 1) * (2 * m + 1) * (2 * m + 3))


_SG = " + ".join(f"{_savgol(i)!r} * " + (f"lag(value, {-i}) over w" if i < 0 else f"lead(value, {i}) over w" if i else "value") for i in range(-HALF, HALF + 1))


@query(f"select event_id, round({_SG}, 6) as smooth from events window w as (partition by user_id order by ts, event_id)")
def w15_savitzky_golay(spark, d):
    """Cubic smoothing over 15 points per unit, as one window of fixed weights; null nearer to the ends."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    parts = [F.lit(_savgol(i)) * (F.lag("value", -i).over(w) if i < 0 else F.lead("value", i).over(w) if i else F.col("value")) for i in range(-HALF, HALF + 1)]
    return table(spark, d, "events").select("event_id", r6(sum(parts[1:], parts[0])).alias("smooth"))


@query("""with e as (select user_id, row_number() over w as i, count(*) over (partition by user_id) as n, (value - avg(value) over (partition by user_id)) / (stddev_pop(value) over (partition by user_id) + 1e-10) as z from events window w as (partition by user_id order by ts, event_id)),
 a as (select x.user_id, y.i - x.i as lag, sum(x.z * y.z) / (x.n - (y.i - x.i)) as acf, x.n from e x join e y on x.user_id = y.user_id and y.i - x.i between 1 and least(x.n // 4, 500) group by x.user_id, lag, x.n)
 select user_id, coalesce(min(lag) filter (where abs(acf) < 0.05), least(max(n) // 4, 500))::bigint as tau from a group by 1""")
def w18_timescale(spark, d):
    """First lag whose autocorrelation is under 0.05, else the longest lag (a quarter of the series, 500 at most, by definition)."""
    unit = Window.partitionBy("user_id")
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.count(F.lit(1)).over(unit).alias("n"), ((F.col("value") - F.avg("value").over(unit)) / (F.stddev_pop("value").over(unit) + 1e-10)).alias("z"))
    ahead = F.collect_list("z").over(unit.orderBy("ts", "event_id").rowsBetween(1, 500))
    longest = F.least(F.floor(F.col("n") / 4), F.lit(500)).cast("int")
    lagged = e.withColumn("later", F.slice(ahead, F.lit(1), longest)).select("user_id", "n", "z", F.posexplode("later").alias("lag", "y"))
    acf = lagged.groupBy("user_id", "n", (F.col("lag") + 1).alias("lag")).agg(F.sum(F.col("z") * F.col("y")).alias("s")).withColumn("acf", F.col("s") / (F.col("n") - F.col("lag")))
    first = F.min(F.when(F.abs("acf") < 0.05, F.col("lag")))
    return acf.groupBy("user_id").agg(F.coalesce(first, F.max(F.least(F.floor(F.col("n") / 4), F.lit(500)))).cast("long").alias("tau"))


@query("""with e as (select user_id, epoch_us(ts) as t, case when epoch_us(ts) - lag(epoch_us(ts)) over w < 21600000000 then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
 s as (select user_id, t, sum(new) over (partition by user_id order by t rows unbounded preceding) as s from e) select user_id, min(t) as start_us, max(t) + 21600000000 as end_us, count(*) as n from s group by user_id, s""")
def s1_sessions(spark, d):
    """Beyond the survey's operators: sessions per unit with a gap of six hours, by the same function as on a stream."""
    s = session_counts(table(spark, d, "events"))
    return s.select("user_id", micros("start").alias("start_us"), micros("end").alias("end_us"), "n")


@query("select event_type, epoch_us(time_bucket(interval '6 hours', ts)) as start_us, count(*) as n, round(sum(value), 4) as total from events group by all")
def s2_tumbling(spark, d):
    """Beyond the survey's operators: counts and sums in windows of six hours, by the same function as on a stream."""
    t = tumbling_counts(table(spark, d, "events"))
    return t.select("event_type", micros("start").alias("start_us"), "n", F.round("total", 4).alias("total"))
