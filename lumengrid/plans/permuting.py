"""Label permutations, designs with deviations, half splits, list literals and look-ups with fallbacks (survey 2.1, 2.2, 2.9, 2.11-2.13, 2.16)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.ranks import shuffle_key
from ..operators.tables import r6, table
from ..registry import query
from .cleaning import _PLACED, _placed


@query("""with e as (select event_id, user_id, event_type, ts, (event_type is distinct from lag(event_type) over o)::int as new from events window o as (partition by user_id order by ts, event_id)),
 t as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as turn from e), d as (select distinct user_id, turn, event_type from t),
 b as (select user_id, event_type as drawn, row_number() over (partition by user_id order by md5('13:' || user_id || ':' || turn), turn) as turn from d)
 select t.event_id, t.turn, b.drawn from t join b using (user_id, turn)""")
def n13_turn_permutation(spark, d):
    """Conditions permuted over whole turns (runs of one kind), so that all rows of a turn get the same one."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = ~F.col("event_type").eqNullSafe(F.lag("event_type").over(order)) | (F.row_number().over(order) == 1)
    e = table(spark, d, "events").withColumn("new", new.cast("long"))
    t = e.select("event_id", "user_id", "event_type", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("turn"))
    turns = t.select("user_id", "turn", "event_type").distinct()
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(shuffle_key("13", "user_id", "turn"), "turn")).cast("long")
    drawn = turns.select("user_id", F.col("event_type").alias("drawn"), place.alias("turn"))
    return t.join(drawn, ["user_id", "turn"]).select("event_id", "turn", "drawn")


@query("""with r as (select l_orderkey, l_linenumber, l_suppkey, l_quantity, l_discount, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as i,
 row_number() over (partition by l_suppkey order by md5('q:' || l_orderkey || ':' || l_linenumber), l_orderkey, l_linenumber, l_quantity) as q, row_number() over (partition by l_suppkey order by md5('d:' || l_orderkey || ':' || l_linenumber), l_orderkey, l_linenumber, l_discount) as d from lineitem)
 select a.l_orderkey, a.l_linenumber, b.l_quantity as quantity, c.l_discount as discount from r a join r b on b.l_suppkey = a.l_suppkey and b.q = a.i join r c on c.l_suppkey = a.l_suppkey and c.d = a.i""")
def n7_column_shuffles(spark, d):
    """Every feature column shuffled inside its unit in an order of its own."""
    unit, keys = Window.partitionBy("l_suppkey"), ("l_orderkey", "l_linenumber")
    rows = table(spark, d, "lineitem").select(*keys, "l_suppkey", "l_quantity", "l_discount")
    drawn = lambda column, seed, name: rows.select("l_suppkey", F.col(column).alias(name), F.row_number().over(unit.orderBy(shuffle_key(seed, *keys), *keys, column)).alias("i"))
    placed = rows.select(*keys, "l_suppkey", F.row_number().over(unit.orderBy(*keys)).alias("i"))
    both = placed.join(drawn("l_quantity", "q", "quantity"), ["l_suppkey", "i"]).join(drawn("l_discount", "d", "discount"), ["l_suppkey", "i"])
    return both.select(*keys, "quantity", "discount")


@query(f"""with {_PLACED} select g.user_id, lag, round(sum(h.y * ln(g.mu) - g.mu), 6) as ll from g, (values (-3), (-2), (-1), (1), (2), (3)) l(lag) join g h on h.user_id = g.user_id and h.place = (g.place + lag + 3 * g.n) % g.n group by all""")
def n9_lag_pool(spark, d):
    """Log likelihood of responses shifted in a circle by each of a fixed pool of lags to both sides."""
    g = _placed(spark, d)
    lags = F.explode(F.array(*map(F.lit, (-3, -2, -1, 1, 2, 3))))
    asked = g.withColumn("lag", lags).select("user_id", "lag", "mu", F.expr("(place + lag + 3 * n) % n").alias("place"))
    found = asked.join(g.select("user_id", "place", "y"), ["user_id", "place"])
    return found.groupBy("user_id", "lag").agg(r6(F.sum(F.col("y") * F.log("mu") - F.col("mu"))).alias("ll"))


@query("""select event_id, (row_number() over (partition by user_id order by ts, event_id) - 1) * 2 // count(*) over (partition by user_id) as contiguous,
 (row_number() over (partition by user_id order by md5('half:' || event_id), event_id) - 1) * 2 // count(*) over (partition by user_id) as shuffled from events""")
def v9_half_splits(spark, d):
    """V9: halves of each unit's rows, contiguous in time and in hash order."""
    unit = Window.partitionBy("user_id")
    n = F.count(F.lit(1)).over(unit)
    half = lambda *order: F.floor((F.row_number().over(unit.orderBy(*order)) - 1) * 2 / n)
    return table(spark, d, "events").select("event_id", half("ts", "event_id").alias("contiguous"), half(shuffle_key("half", "event_id"), "event_id").alias("shuffled"))


@query("""with q as (select quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) as q from orders) select o_orderkey, (o_totalprice > q[2])::int as above_median,
 (o_totalprice > q[1])::int + (o_totalprice > q[2])::int + (o_totalprice > q[3])::int as quarter from orders, q""")
def p13_median_and_bins(spark, d):
    """Labels by the median, and by four quantile bins (an edge belongs to the bin below it)."""
    orders, x = table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice")
    q = orders.agg(F.percentile("o_totalprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    above = [(x > F.get("q", F.lit(i))).cast("int") for i in range(3)]
    return orders.crossJoin(F.broadcast(q)).select("o_orderkey", above[1].alias("above_median"), (above[0] + above[1] + above[2]).alias("quarter"))  # one row


@query("""with v as (select vec_id, embedding[1:2]::double[] as x, (vec_id % 2)::double as c, label % 3 as k from embeddings),
 h as (select vec_id, x, c, [(k = 0)::int::double, (k = 1)::int::double, (k = 2)::int::double] as h from v),
 r as (select vec_id, list_concat([c], h, list_transform(h, lambda a: a * c), x, list_transform(x, lambda a: a * c),
  [0.5 * x[1] * h[1], 0.5 * x[2] * h[1], 0.5 * x[1] * h[2], 0.5 * x[2] * h[2], 0.5 * x[1] * h[3], 0.5 * x[2] * h[3]],
  [0.5 * x[1] * h[1] * c, 0.5 * x[2] * h[1] * c, 0.5 * x[1] * h[2] * c, 0.5 * x[2] * h[2] * c, 0.5 * x[1] * h[3] * c, 0.5 * x[2] * h[3] * c]) as row from h)
 select vec_id, unnest(range(len(row)))::int as col, round(unnest(row), 6) as x from r""")
def f9_category_deviations(spark, d):
    """shared slopes beside shrunken deviations by category and by category and condition, a row per entry."""
    hot = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: (F.col("label") % 3 == k).cast("double"))
    v = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 2).cast("array<double>").alias("x"), (F.col("vec_id") % 2).cast("double").alias("c"), hot.alias("h"))
    times_c = lambda a: F.transform(a, lambda y: y * F.col("c"))
    v = v.withColumn("by_category", F.flatten(F.transform("h", lambda h: F.transform("x", lambda y: 0.5 * y * h))))
    row = F.concat(F.array("c"), "h", times_c("h"), "x", times_c("x"), "by_category", times_c("by_category"))
    return v.select("vec_id", F.posexplode(row).alias("col", "x")).select("vec_id", "col", r6(F.col("x")).alias("x"))


@query("""with c as (select user_id, event_type as cluster, count(*) as n, avg(value) filter (where event_id % 2 = 0) as a, avg(value) filter (where event_id % 2 = 1) as b from events group by all),
 s as (select user_id, cluster, n, 1 / (1 + a / 50) as self, 1 / (1 + b / 50) as other, abs(a - b) / 100 as distance from c),
 m as (select cluster from s group by 1 order by sum(n) desc, cluster limit 1),
 f as (select user_id, 1 - least(avg(self), avg(other)) as floor from s where cluster = (select cluster from m) and self is not null and other is not null group by 1)
 select user_id, cluster, (select cluster from m) as reference, round(floor, 6) as noise_floor, round(case when floor > 0 then distance / floor end, 6) as normalised from s left join f using (user_id)""")
def g3c_normalised_distances(spark, d):
    """Distances over the noise floor of the cluster with most rows overall; null where that is unknown or not positive."""
    mean = lambda odd: F.avg(F.when(F.col("event_id") % 2 == odd, F.col("value")))
    c = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), mean(0).alias("a"), mean(1).alias("b"))
    s = c.select("user_id", "cluster", "n", (1 / (1 + F.col("a") / 50)).alias("self"), (1 / (1 + F.col("b") / 50)).alias("other"), (F.abs(F.col("a") - F.col("b")) / 100).alias("distance"))
    sizes = s.groupBy("cluster").agg(F.sum("n").alias("n"))
    reference = sizes.agg(F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster"))).alias("reference"))
    s = s.crossJoin(F.broadcast(reference))  # one row
    valid = s.filter((F.col("cluster") == F.col("reference")) & F.col("self").isNotNull() & F.col("other").isNotNull())
    floors = valid.groupBy("user_id").agg((1 - F.least(F.avg("self"), F.avg("other"))).alias("floor"))
    return s.join(floors, "user_id", "left").select("user_id", "cluster", "reference", r6(F.col("floor")).alias("noise_floor"), r6(F.when(F.col("floor") > 0, F.col("distance") / F.col("floor"))).alias("normalised"))


@query("select l_orderkey, l_linenumber, 3 as width, round(l_quantity::int + l_linenumber / 4.0 - l_suppkey, 6) as total from lineitem")
def s4_list_literals(spark, d):
    """Vectors kept as list literals in a text column, parsed to arrays; a literal that is no list gives null."""
    text = F.concat(F.lit("["), F.col("l_quantity").cast("int"), F.lit(", "), F.col("l_linenumber") / 4.0, F.lit(",-"), F.col("l_suppkey"), F.lit("]"))
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.from_json(text, "array<double>").alias("v"))
    return v.select("l_orderkey", "l_linenumber", F.size("v").alias("width"), r6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("""with p as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as place from events), w as (select *, unnest([place // 4, place // 4 - 1]) as chunk from p),
 t as (select user_id, place, avg(value * (1 + (place - chunk * 4) / 8.0)) as v from w where chunk >= 0 group by all)
 select user_id, place // 3 as word, count(*) as n_tokens, round(avg(v), 6) as v from t group by all""")
def s14_overlapping_windows(spark, d):
    """Tokens in windows of eight every four places; a token is the mean of its windows' values, a word (three places) that of its tokens."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, d, "events").select("user_id", "value", (F.row_number().over(order) - 1).cast("long").alias("place"))
    w = p.withColumn("chunk", F.explode(F.array(F.expr("place div 4"), F.expr("place div 4 - 1")))).filter("chunk >= 0")
    # a place in a window stands for the context that a model would give the token there
    t = w.groupBy("user_id", "place").agg(F.avg(F.col("value") * (1 + (F.col("place") - F.col("chunk") * 4) / 8.0)).alias("v"))
    return t.groupBy("user_id", F.expr("place div 3").alias("word")).agg(F.count(F.lit(1)).alias("n_tokens"), r6(F.avg("v")).alias("v"))


_EDGES = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"


@query(rf"""with v as (select distinct w from (select unnest(string_split_regex(text, '\s+')) as w from benchmark) where w <> ''),
 t as (select w, count(*) as n from (select unnest(string_split_regex(text, '\s+')) as w from documents) where w <> '' group by 1), s as (select w, n, regexp_replace(w, '{_EDGES}', '', 'g') as s from t)
 select case when w in (from v) then 'exact' when lower(w) in (from v) then 'lower' when s in (from v) then 'stripped' when lower(s) in (from v) then 'stripped lower' when contains(s, '''') and split_part(s, '''', 1) in (from v) then 'stem' else 'none' end as found,
  count(*) as n_words, sum(n)::bigint as n_tokens from s group by 1""")
def s15_fallback_lookup(spark, d):
    """Words looked up as they are, in lower case, without punctuation at their ends, and by the part before an apostrophe; the first hit counts."""
    split = lambda name: table(spark, d, name).select(F.explode(F.split("text", r"\s+")).alias("w")).filter("w <> ''")
    known = split("benchmark").distinct()
    w = split("documents").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    s = F.regexp_replace("w", _EDGES, "")
    forms = F.array(F.col("w"), F.lower("w"), s, F.lower(s), F.when(F.contains(s, F.lit("'")), F.substring_index(s, "'", 1)))
    # all forms of a distinct word meet the vocabulary in one join
    tried = w.select("w", "n", F.posexplode(forms).alias("rank", "form"))
    hits = tried.join(known.select(F.col("w").alias("form"), F.lit(True).alias("hit")), "form", "left")
    best = hits.groupBy("w", "n").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("rank"))
    names = F.array(*map(F.lit, ("exact", "lower", "stripped", "stripped lower", "stem")))
    return best.groupBy(F.coalesce(F.get(names, F.col("rank")), F.lit("none")).alias("found")).agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n_tokens"))


@query("""with u as (select label, vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), k as (select label, vec_id, i, x - avg(x) over (partition by label, i) as x from u),
 g as (select a.label, a.i, b.i as j, sum(a.x * b.x) as c from k a join k b using (vec_id, label) group by all)
 select label, round(sum(c) filter (where i = j) ** 2 / sum(c * c), 5) as participation from g group by 1""")
def x4_participation_ratio(spark, d):
    """Participation ratio of each class's centred Gram matrix, as trace squared over the trace of its square; taken from
    the coordinates' products, so that its size does not grow with the rows."""
    e = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    entries = e.select("label", F.posexplode("v").alias("i", "x"), "v").select("label", "i", "x", F.posexplode("v").alias("j", "y"))
    c = entries.groupBy("label", "i", "j").agg((F.covar_pop("x", "y") * F.count(F.lit(1))).alias("c"))
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("c")))
    return c.groupBy("label").agg(F.round(trace * trace / F.sum(F.col("c") * F.col("c")), 5).alias("participation"))
