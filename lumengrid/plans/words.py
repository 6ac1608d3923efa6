"""Token streams, windows on them, and their features (survey 2.3, 2.4, 2.7, 2.10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.intervals import MODES, clip_windows, window_bounds
from ..operators.ranks import quantiles
from ..operators.tables import micros, r6, table
from ..registry import query


@query("select conv_id, role, count(*) as n from (select conv_id, role, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) as w from conversations) group by all")
def p1_melt_tokens(spark, d):
    """One row per token, counted by speaker."""
    words = table(spark, d, "conversations").select("conv_id", "role", F.explode(F.filter(F.split("text", " "), lambda x: x != "")).alias("w"))
    return words.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query("""select event_id, case when view_v <> '' then 'view' when click_v <> '' then 'click' when other_v <> '' then 'other' end as speaker from (
 select event_id, case when event_type = 'view' then 'x' else '' end as view_v, case when event_type = 'click' then 'x' else '' end as click_v,
 case when event_type not in ('view', 'click', 'error') then 'x' else '' end as other_v from events)""")
def p2_first_filled_column(spark, d):
    """The first of wide columns that holds something."""
    mark = lambda c: F.when(c, F.lit("x")).otherwise("")
    kind = F.col("event_type")
    wide = table(spark, d, "events").select("event_id", mark(kind == "view").alias("view"), mark(kind == "click").alias("click"), mark(~kind.isin("view", "click", "error")).alias("other"))
    return wide.select("event_id", F.coalesce(*(F.when(F.col(c) != "", F.lit(c)) for c in ("view", "click", "other"))).alias("speaker"))


@query("select event_type, count(*) filter (where is_self) as n_self, count(*) filter (where not is_self) as n_other from (select event_type, user_id % 2 = 0 as is_self from events) group by all")
def p3_self_other(spark, d):
    """Rows by condition, the target's own and the others'."""
    own = table(spark, d, "events").withColumn("is_self", F.col("user_id") % 2 == 0)
    return own.groupBy("event_type").agg(F.count(F.when(F.col("is_self"), 1)).alias("n_self"), F.count(F.when(~F.col("is_self"), 1)).alias("n_other"))


@query("select user_id from (select user_id, event_type, count(*) as n from events where event_type in ('view', 'click') group by all) group by user_id having count(*) = 2 and min(n) >= 3")
def p7_min_count_in_all_conditions(spark, d):
    """Units with enough events in every condition."""
    n = table(spark, d, "events").filter(F.col("event_type").isin("view", "click")).groupBy("user_id", "event_type").count()
    return n.groupBy("user_id").agg(F.count(F.lit(1)).alias("k"), F.min("count").alias("m")).filter("k = 2 and m >= 3").select("user_id")


@query("select l_suppkey, round(stddev_pop(l_quantity), 6) as sd from lineitem where isfinite(l_quantity) group by l_suppkey having stddev_pop(l_quantity) > 0")
def p8_varying_units(spark, d):
    """Constant responses dropped."""
    sd = table(spark, d, "lineitem").filter(~F.isnan("l_quantity")).groupBy("l_suppkey").agg(F.stddev_pop("l_quantity").alias("sd"))
    return sd.filter("sd > 0").select("l_suppkey", r6(F.col("sd")).alias("sd"))


@query("select conv_id, role, n from (select *, count(*) over (partition by conv_id) as speakers from (select conv_id, role, count(*) as n from conversations group by all having count(*) >= 2)) where speakers >= 2")
def p9_min_words_and_speakers(spark, d):
    """Enough rows per speaker, and two such speakers."""
    n = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return n.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("conv_id"))).filter("k >= 2").drop("k")


@query("""select lang from (select lang, count(*) filter (where toxic = 1) as a, count(*) filter (where toxic = 0) as b from documents join labels using (doc_id) group by lang) where a >= 2 and b >= 2""")
def p10_class_gate(spark, d):
    """P10: classes with enough members in both conditions."""
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang")
    n = both.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("a"), F.count(F.when(F.col("toxic") == 0, 1)).alias("b"))
    return n.filter("a >= 2 and b >= 2").select("lang")


@query("select vec_id, (dense_rank() over (order by grp) - 1)::bigint as cls from (select vec_id, case when label < 3 then 0 when label < 6 then 3 else 7 end as grp from embeddings where label <> 9)")
def p12_recode_labels(spark, d):
    """Labels mapped to fewer, one dropped, numbered without gaps."""
    grp = F.when(F.col("label") < 3, 0).when(F.col("label") < 6, 3).otherwise(7)
    rows = table(spark, d, "embeddings").filter("label <> 9").select("vec_id", grp.alias("grp"))
    codes = rows.select("grp").distinct().withColumn("cls", (F.row_number().over(Window.orderBy("grp")) - 1).cast("long"))
    return rows.join(F.broadcast(codes), "grp").select("vec_id", "cls")  # a handful of labels


@query("select o_orderkey, case when o_totalprice <= q[1] then 'low' when o_totalprice >= q[2] then 'high' end as label from orders, (select [quantile_cont(o_totalprice, 0.25), quantile_cont(o_totalprice, 0.75)] as q from orders)")
def p13_quantile_labels(spark, d):
    """Top and bottom quarter as labels."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    q = quantiles(orders, "o_totalprice", (0.25, 0.75))
    x = F.col("o_totalprice")
    return orders.crossJoin(F.broadcast(q)).select("o_orderkey", F.when(x <= F.get("q", F.lit(0)), "low").when(x >= F.get("q", F.lit(1)), "high").alias("label"))  # one row


def _timed(spark, d):
    """Orders as words: onset by date, offset after their price in ms."""
    return table(spark, d, "orders").select("o_orderkey", (micros("o_orderdate") / 1000).cast("double").alias("onset"), (micros("o_orderdate") / 1000 + F.floor("o_totalprice")).cast("double").alias("offset"))


_MODE_SQL = " union all ".join(
    f"select '{m}' as mode, count(*) as n, round(sum(({b}) - ({a})), 3) as total from w" for m, (a, b) in {k: tuple(x.replace(" pre", " 100").replace(" post", " 400").replace(" shift", " 250").replace("offset", '"offset"') for x in v) for k, v in MODES.items()}.items()
)


@query('with w as (select epoch_us(o_orderdate) / 1000 as onset, epoch_us(o_orderdate) / 1000 + floor(o_totalprice) as "offset" from orders) ' + _MODE_SQL)
def windows_by_mode(spark, d):
    """2.4: every window mode over the same words."""
    words, out = _timed(spark, d), None
    for mode in MODES:
        start, end = window_bounds(mode, 100, 400, 250)
        one = words.select((end - start).alias("w")).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 3).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""select o_orderkey, greatest(least(greatest(s, 0), 990), 0)::double as start, greatest(least(e, 1000), greatest(least(greatest(s, 0), 990), 0) + 10)::double as "end"
 from (select o_orderkey, (o_orderkey % 1100) - 50 as s, (o_orderkey % 1100) + 3 as e from orders)""")
def windows_clipped(spark, d):
    """2.4: windows clipped to a recording and widened to a least length, rows kept."""
    k = (F.col("o_orderkey") % 1100).cast("double")
    return clip_windows(table(spark, d, "orders").select("o_orderkey", (k - 50).alias("start"), (k + 3).alias("end")), 1000.0, 10.0)


_TURNS = "select conv_id, turn, role, coalesce(lag(role) over (partition by conv_id order by turn) <> role, true) as new from conversations"


@query(f"select conv_id, seg, min(turn) as first_turn, count(*) as n from (select conv_id, turn, sum(new::int) over (partition by conv_id order by turn)::bigint as seg from ({_TURNS})) group by all")
def w1_turn_segments(spark, d):
    """Runs of one speaker."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.coalesce(F.lag("role").over(w) != F.col("role"), F.lit(True)).cast("int")
    seg = table(spark, d, "conversations").withColumn("new", new).withColumn("seg", F.sum("new").over(w))
    return seg.groupBy("conv_id", "seg").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n"))


@query("select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as seen, round((row_number() over (partition by user_id, event_type order by ts, event_id) - 1) / row_number() over (partition by user_id order by ts, event_id), 6) as rate from events")
def w2_running_occurrences(spark, d):
    """How often a token occurred so far, and its rate."""
    own = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    every = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = (F.row_number().over(own) - 1).cast("long")
    return table(spark, d, "events").select("event_id", seen.alias("seen"), r6(seen / F.row_number().over(every)).alias("rate"))


@query("select event_id, round(n / greatest(span, 1), 9) as rate from (select event_id, count(*) over w as n, (max(epoch_us(ts)) over w - min(epoch_us(ts)) over w) / 1e6 as span from events window w as (partition by user_id order by ts, event_id rows between 5 preceding and 5 following))")
def w3_local_rate(spark, d):
    """Rate among five neighbours on both sides."""
    t = table(spark, d, "events").withColumn("t", micros("ts"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, 5)
    span = (F.max("t").over(w) - F.min("t").over(w)) / 1e6
    return t.select("event_id", (F.round(F.count(F.lit(1)).over(w) / F.greatest(span, F.lit(1.0)), 9)).alias("rate"))


@query("select event_id, least(greatest(coalesce(t - lag(t) over w, 0), 0), 3600000000)::bigint as before, least(coalesce(lead(t) over w - t, 0), 3600000000)::bigint as after from (select event_id, user_id, epoch_us(ts) as t from events) window w as (partition by user_id order by t, event_id)")
def w5_gaps(spark, d):
    """Gaps to the neighbours with edge values, clipped."""
    t = table(spark, d, "events").withColumn("t", micros("ts"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    gap = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)), F.lit(3_600_000_000)).cast("long")
    return t.select("event_id", gap(F.col("t") - F.lag("t").over(w)).alias("before"), gap(F.lead("t").over(w) - F.col("t")).alias("after"))


@query("select event_id, round((value - avg(value) over (partition by user_id)) / nullif(stddev_pop(value) over (partition by user_id), 0), 6) as z, round(lag(value, 1) over w, 6) as lag1, round(lag(value, 2) over w, 6) as lag2 from events window w as (partition by user_id order by ts, event_id) qualify row_number() over w > 2")
def w6_own_lags(spark, d):
    """Earlier responses of the unit, the first rows dropped."""
    w, own = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id")
    z = (F.col("value") - F.avg("value").over(own)) / F.nullif(F.stddev_pop("value").over(own), F.lit(0.0))
    out = table(spark, d, "events").select("event_id", r6(z).alias("z"), r6(F.lag("value", 1).over(w)).alias("lag1"), r6(F.lag("value", 2).over(w)).alias("lag2"), F.row_number().over(w).alias("k"))
    return out.filter("k > 2").drop("k")


@query("select event_id, string_agg(event_type, ' ') over (partition by user_id order by ts, event_id rows between 3 preceding and current row) as context from events")
def w7_sliding_context(spark, d):
    """The last tokens up to this one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    return table(spark, d, "events").select("event_id", F.array_join(F.collect_list("event_type").over(w), " ").alias("context"))


@query("select event_id, i, value_rolled from (select a.event_id, a.i, round(b.value, 6) as value_rolled from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n from events) a join (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events) b on a.user_id = b.user_id and b.i = (a.i - 7 + 7 * a.n) % a.n)")
def w17_circular_shift(spark, d):
    """A unit's series rolled by seven."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("i", (F.row_number().over(w) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    moved = rows.select("user_id", F.pmod(F.col("i") + 7, F.col("n")).alias("i"), r6(F.col("value")).alias("value_rolled"))
    return rows.select("event_id", "user_id", "i").join(moved, ["user_id", "i"]).select("event_id", "i", "value_rolled")


@query("select conv_id, n, round(cume_dist() over (order by n), 6) as share from (select conv_id, count(*) as n from conversations group by conv_id)")
def w19_turn_cdf(spark, d):
    """Empirical distribution of turn counts, from counts per value."""
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    values = n.groupBy("n").agg(F.count(F.lit(1)).alias("k"))  # few different counts
    share = F.sum("k").over(Window.orderBy("n")) / F.sum("k").over(Window.partitionBy())
    return n.join(values.select("n", r6(share).alias("share")), "n").select("conv_id", "n", "share")


@query("""select event_id, lower(regexp_replace(event_type, '[^a-z0-9]', '', 'g')) || '__occ' || row_number() over (partition by event_type order by event_id) as tag, length(event_type)::int as len,
 'Speaker' || regexp_extract('SPK0' || (user_id % 10), 'SPK0*([0-9]+)', 1) as speaker from events""")
def strings(spark, d):
    """2.10: cleaning, patterns, speaker names, occurrence tags."""
    n = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    speaker = F.regexp_extract(F.concat(F.lit("SPK0"), F.col("user_id") % 10), "SPK0*([0-9]+)", 1)
    return table(spark, d, "events").select(
        "event_id", F.concat(F.lower(F.regexp_replace("event_type", "[^a-z0-9]", "")), F.lit("__occ"), n).alias("tag"), F.length("event_type").alias("len"), F.concat(F.lit("Speaker"), speaker).alias("speaker")
    )


@query("""select l_orderkey, l_linenumber, round(ln(1 + l_quantity), 6) as lp, round(exp(least(greatest(l_discount * 300, -20), 20)), 3) as ex, round(lgamma(floor(l_quantity) + 1), 6) as lg, round(2 * l_discount / (1 + l_discount), 6) as sb, round_even(l_quantity / 4, 0)::double as even from lineitem""")
def mathematics(spark, d):
    """2.10: logs, clamped exponent, log-gamma of counts, Spearman-Brown, rounding half to even."""
    q, x = F.col("l_quantity"), F.col("l_discount")
    lg = F.expr("aggregate(sequence(1, greatest(cast(floor(l_quantity) as int), 1)), 0D, (a, k) -> a + ln(k))")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(F.log1p(q)).alias("lp"), F.round(F.exp(F.least(F.greatest(x * 300, F.lit(-20)), F.lit(20))), 3).alias("ex"),
        r6(lg).alias("lg"), r6(2 * x / (1 + x)).alias("sb"), F.bround(q / 4, 0).alias("even"),
    )


@query("""select event_id, (props->>'k') as k, round(coalesce(case when value < 0 then null else value end, avg(value) over ()), 6) as filled, nullif(event_type, 'error') as kind from events""")
def nulls_and_json(spark, d):
    """2.10: JSON fields, sentinels to null, missing values by the mean."""
    e = table(spark, d, "events")
    mean = e.agg(F.avg("value").alias("m"))
    return e.crossJoin(F.broadcast(mean)).select(  # one row
        "event_id", F.get_json_object("props", "$.k").alias("k"), r6(F.coalesce(F.when(F.col("value") >= 0, F.col("value")), F.col("m"))).alias("filled"), F.nullif("event_type", F.lit("error")).alias("kind")
    )
