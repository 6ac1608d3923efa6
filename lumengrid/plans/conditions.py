"""Windows by speaker, decoding across conditions, simulated responses and resampled sides (survey 2.4, 2.7, 2.13-2.17)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.intervals import SPEAKER_MODES, speaker_windows
from ..operators.ranks import shuffle_key
from ..operators.tables import micros, r6, spread, table
from ..registry import query


@query("""with w as (select o_orderkey % 3 = 0 as own, epoch_us(o_orderdate) / 1000 % 100000000 as a, epoch_us(o_orderdate) / 1000 % 100000000 + floor(o_totalprice) - 50000 as b from orders),
 m as (select 'fixed' as mode, own, a - 20 as s, a + 480 as e from w where own union all select 'fixed', own, a + 30, a + 280 from w where not own
 union all select 'regression', own, a, b + 500 from w
 union all select 'target_vs_other', own, a - 500, a from w where own union all select 'target_vs_other', own, a, b + 500 from w where not own
 union all select 'onset_offset_plus_prepost', own, a - 100, b + 400 from w where own union all select 'onset_offset_plus_prepost', own, a - 50, b + 200 from w where not own
 union all select 'onset_offset_append_window', own, a - 100, b + 400 from w where own union all select 'onset_offset_append_window', own, a - 50, b + 200 from w where not own
 union all select 'duration_shifted_window', own, a - 250, b - 250 from w where own and a < b union all select 'duration_shifted_window', own, a + 80, b + 80 from w where not own and a < b
 union all select 'target_vs_other_custom_bounds', own, b - 30, b + 70 from w where own union all select 'target_vs_other_custom_bounds', own, a + 10, b + 20 from w where not own
 union all select 'target_vs_other_fixed_window_from_ref', own, a + 250, a + 850 from w where own union all select 'target_vs_other_fixed_window_from_ref', own, b + 80, b + 480 from w where not own)
 select mode, own, count(*) as n, round(avg(e - s), 3) as width, round(avg(s), 2) as start from m group by all""")
def windows_by_speaker(spark, d):
    """2.4: modes with other windows for the target's words than for those of others."""
    target = {"pre": 100, "post": 400, "shift": 250, "start": "offset", "start_shift": -30, "end": "offset", "end_shift": 70, "ref": "onset", "length": 600}
    other = {"pre": 50, "post": 200, "shift": 80, "start": "onset", "start_shift": 10, "end": "offset", "end_shift": 20, "ref": "offset", "length": 400}
    onset = (micros("o_orderdate") / 1000 % 100000000).cast("double")
    words = table(spark, d, "orders").select((F.col("o_orderkey") % 3 == 0).alias("own"), onset.alias("onset"), (onset + F.floor("o_totalprice") - 50000).alias("offset"))
    out = None
    for mode in SPEAKER_MODES:
        w = speaker_windows(words, mode, F.col("own"), target, other).groupBy(F.lit(mode).alias("mode"), "own")
        one = w.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("end") - F.col("start")), 3).alias("width"), F.round(F.avg("start"), 2).alias("start"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""with r as (select l_linenumber <= 3 as own, ('0x' || substr(md5('c1:' || l_orderkey || ':' || l_linenumber), 1, 7))::bigint % 2 as fold, l_returnflag as cls, floor(l_quantity) as q, round(l_discount * 100) as k from lineitem),
 m as (select own as trained, 1 - fold as fold, cls as c, avg(q) + 0.001 as a, avg(k) + 0.001 as b, ln(count(*)::double / sum(count(*)) over (partition by own, fold)) as p from r group by own, fold, cls),
 x as (select own, fold, cls, q, k, count(*) as n from r group by all),
 s as (select trained, own, x.fold, cls, q, k, n, arg_min(c, {'s': -(q * ln(a) + k * ln(b) - a - b + p), 'c': c}) as predicted from x join m on m.fold = x.fold group by all),
 t as (select trained, own, cls, sum(n * (predicted = cls)::int) / sum(n) as recall from s group by all)
 select trained as trained_on_own, own as tested_on_own, count(*) as classes, round(avg(recall), 6) as bal_acc from t group by all""")
def c1_cross_condition(spark, d):
    """Poisson naive Bayes trained in one condition and tested in the other and, as a ceiling, in its own, always on the fold it did not see."""
    fold = F.conv(F.substring(shuffle_key("c1", "l_orderkey", "l_linenumber"), 1, 7), 16, 10).cast("long") % 2
    r = table(spark, d, "lineitem").select((F.col("l_linenumber") <= 3).alias("own"), fold.alias("fold"), F.col("l_returnflag").alias("cls"), F.floor("l_quantity").alias("q"), F.round(F.col("l_discount") * 100).alias("k"))
    cells = r.groupBy("own", "fold", "cls", "q", "k").agg(F.count(F.lit(1)).alias("n"))
    fitted = cells.groupBy("own", "fold", "cls").agg((F.sum(F.col("q") * F.col("n")) / F.sum("n") + 0.001).alias("a"), (F.sum(F.col("k") * F.col("n")) / F.sum("n") + 0.001).alias("b"), F.sum("n").alias("n"))
    models = fitted.groupBy(F.col("own").alias("trained"), (1 - F.col("fold")).alias("fold")).agg(F.collect_list(F.struct("cls", "a", "b", "n")).alias("m"), F.sum("n").alias("all"))  # a row per condition and fold
    score = lambda m: F.col("q") * F.ln(m["a"]) + F.col("k") * F.ln(m["b"]) - m["a"] - m["b"] + F.ln(m["n"] / F.col("all"))
    best = F.array_min(F.transform("m", lambda m: F.struct((-score(m)).alias("s"), m["cls"].alias("c"))))["c"]
    scored = cells.join(F.broadcast(models), "fold").select("trained", "own", "cls", "n", (best == F.col("cls")).alias("hit"))
    recall = scored.groupBy("trained", "own", "cls").agg((F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / F.sum("n")).alias("recall"))
    return recall.groupBy(F.col("trained").alias("trained_on_own"), F.col("own").alias("tested_on_own")).agg(F.count(F.lit(1)).alias("classes"), r6(F.avg("recall")).alias("bal_acc"))


@query("""with y as (select user_id, epoch_us(ts) // 3600000000 as bin, count(*) as y from events group by all), e as (select user_id, min(bin) as lo, max(bin) as hi, sum(y) as mass from y group by 1),
 s as (select user_id, bin + k as bin, sum(y * exp(-k * k / 8.0)) as s from y, range(-8, 9) t(k) group by all), c as (select s.*, mass from s join e using (user_id) where bin between lo and hi)
 select user_id, bin, round(s * mass / sum(s) over (partition by user_id), 6) as smooth from c""")
def w16_gaussian_smoothing(spark, d):
    """Counts smoothed by a Gaussian of two bins, cut at four deviations, inside the unit's span and with its mass preserved."""
    y = table(spark, d, "events").withColumn("us", micros("ts")).groupBy("user_id", F.expr("us div 3600000000").alias("bin")).agg(F.count(F.lit(1)).alias("y"))
    ends = y.groupBy("user_id").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.sum("y").alias("mass"))
    spread = y.withColumn("k", F.explode(F.sequence(F.lit(-8), F.lit(8))))
    s = spread.groupBy("user_id", (F.col("bin") + F.col("k")).alias("bin")).agg(F.sum(F.col("y") * F.exp(-F.col("k") * F.col("k") / 8.0)).alias("s"))
    inside = s.join(ends, "user_id").filter("bin between lo and hi")
    return inside.select("user_id", "bin", r6(F.col("s") * F.col("mass") / F.sum("s").over(Window.partitionBy("user_id"))).alias("smooth"))


@query("""with r as (select row_number() over () as id, l_suppkey, 1 + l_discount * 20 as mu, ('0x' || substr(md5('n18:' || l_orderkey || ':' || l_linenumber), 1, 7))::bigint / 268435456.0 as u from lineitem),
 c as (select id, l_suppkey, mu, u, sum(exp(k * ln(mu) - mu - lgamma(k + 1))) over (partition by id order by k) as cdf from r, range(60) t(k)),
 y as (select id, l_suppkey, any_value(mu) as mu, count(*) filter (where cdf <= u) as y from c group by 1, 2)
 select l_suppkey, sum(y)::bigint as total, max(y) as most, round(avg((y - mu) * (y - mu) / mu), 5) as dispersion from y group by 1""")
def n17_n18_simulated_counts(spark, d):
    """Poisson responses drawn at given rates by inverse distribution from a hash, and their dispersion, near 1 if all is calibrated."""
    u = F.conv(F.substring(shuffle_key("n18", "l_orderkey", "l_linenumber"), 1, 7), 16, 10).cast("long") / F.lit(268435456.0)
    r = table(spark, d, "lineitem").select("l_suppkey", (1 + F.col("l_discount") * 20).alias("mu"), u.alias("u"))
    # u has 28 bits: above twelve deviations and twenty no draw can lie
    steps = F.sequence(F.lit(1), F.ceil(F.col("mu") + 12 * F.sqrt("mu") + 20).cast("int"))
    zero = F.struct(F.exp(-F.col("mu")).alias("p"), F.exp(-F.col("mu")).alias("cdf"), (F.exp(-F.col("mu")) <= F.col("u")).cast("long").alias("y"))

    def step(s, k):
        p = s["p"] * F.col("mu") / k
        return F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), (s["y"] + (s["cdf"] + p <= F.col("u")).cast("long")).alias("y"))

    y = r.select("l_suppkey", "mu", F.aggregate(steps, zero, step, lambda s: s["y"]).alias("y"))
    gap = F.col("y") - F.col("mu")
    return y.groupBy("l_suppkey").agg(F.sum("y").alias("total"), F.max("y").alias("most"), F.round(F.avg(gap * gap / F.col("mu")), 5).alias("dispersion"))


@query("""with r as (select event_type, user_id % 2 as side, value, row_number() over (partition by event_type, user_id % 2 order by event_id) - 1 as i, count(*) over (partition by event_type, user_id % 2) as n from events),
 s as (select event_type, arg_max(side, {'n': n, 's': side}) as large, min(n) as few, max(n) as many, count(distinct side) as sides from r group by 1),
 p as (select event_type, large, k, ('0x' || substr(md5('b3:' || k || ':' || j), 1, 7))::bigint % many as i from s, range(1, 21) a(k), range((select max(few) from s)) b(j) where j < few and sides = 2),
 b as (select event_type, k, avg(value) as m from p join r using (event_type, i) where side = large group by all)
 select event_type, any_value(few) as n, round(avg(m), 5) as large_mean, round((select avg(value) from r where r.event_type = b.event_type and r.side <> s.large), 5) as small_mean from b join s using (event_type) group by event_type, s.large""")
def b3_larger_side_resampled(spark, d):
    """Of two sides, the larger one drawn with replacement down to the size of the smaller, twenty times, and averaged."""
    cell = Window.partitionBy("event_type", "side")
    r = table(spark, d, "events").select("event_type", (F.col("user_id") % 2).alias("side"), "event_id", "value")
    r = r.select("event_type", "side", "value", (F.row_number().over(cell.orderBy("event_id")) - 1).cast("long").alias("i"))
    sizes = r.groupBy("event_type", "side").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    s = sizes.groupBy("event_type").agg(F.max(F.struct("n", "side")).alias("l"), F.min(F.struct("n", "side", "mean")).alias("s"), F.count(F.lit(1)).alias("sides")).filter("sides = 2")
    s = s.select("event_type", F.col("l.side").alias("side"), F.col("l.n").alias("many"), F.col("s.n").alias("few"), F.col("s.mean").alias("small"))
    # draws are made in stretches, which are dealt to tasks
    step = 50_000
    draws = s.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("few") - 1, F.lit(step).cast("long"))))
    draws = spread(draws, "event_type", "k", "from").withColumn("j", F.explode(F.sequence("from", F.least(F.col("from") + step, F.col("few")) - 1)))
    pick = F.conv(F.substring(shuffle_key("b3", "k", "j"), 1, 7), 16, 10).cast("long") % F.col("many")
    # equal draws are counted before they meet the rows
    counted = draws.groupBy("event_type", "side", "k", "few", "small", pick.alias("i")).agg(F.count(F.lit(1)).alias("times"))
    # there are as many draws as rows, whatever the few rows they come from let the planner think: neither side is to be broadcast
    means = counted.hint("merge").join(r, ["event_type", "side", "i"]).groupBy("event_type", "k", "few", "small").agg((F.sum(F.col("times") * F.col("value")) / F.sum("times")).alias("m"))
    return means.groupBy("event_type", F.col("few").alias("n"), "small").agg(F.round(F.avg("m"), 5).alias("large_mean")).select("event_type", "n", "large_mean", F.round("small", 5).alias("small_mean"))


@query("""with m as (select user_id, avg(value) filter (where event_type = 'view') - avg(value) filter (where event_type = 'click') as d from events group by 1)
 select count(d) as n, round(avg(d), 6) as mean, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) as t, round(avg(d) / stddev_samp(d), 6) as cohen_d,
 round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(d)), 6) as low, round(avg(d) + 1.96 * stddev_samp(d) / sqrt(count(d)), 6) as high from m""")
def i12_paired(spark, d):
    """Paired t, Cohen's d and a 95 % interval (by the normal quantile) of units' differences between two conditions."""
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    m = table(spark, d, "events").groupBy("user_id").agg((mean("view") - mean("click")).alias("d"))
    s = m.agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    se = F.col("s") / F.sqrt("n")
    return s.select("n", r6(F.col("m")).alias("mean"), r6(F.col("m") / se).alias("t"), r6(F.col("m") / F.col("s")).alias("cohen_d"), r6(F.col("m") - 1.96 * se).alias("low"), r6(F.col("m") + 1.96 * se).alias("high"))


@query("""with r as (select l_orderkey, l_linenumber, l_suppkey, l_quantity, l_discount, l_tax, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_quantity) as i,
 row_number() over (partition by l_suppkey order by md5('n10:' || l_orderkey || ':' || l_linenumber), l_orderkey, l_linenumber, l_discount, l_tax) as j from lineitem)
 select a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_discount, b.l_tax from r a join r b on a.l_suppkey = b.l_suppkey and a.i = b.j""")
def n10_controls_permuted(spark, d):
    """The block of controls permuted as a whole inside the unit, while the other features and the responses stay."""
    unit, keys = Window.partitionBy("l_suppkey"), ("l_orderkey", "l_linenumber")
    r = table(spark, d, "lineitem").select(*keys, "l_suppkey", "l_quantity", "l_discount", "l_tax")
    kept = r.select(*keys, "l_suppkey", "l_quantity", F.row_number().over(unit.orderBy(*keys, "l_quantity")).alias("i"))
    drawn = r.select("l_suppkey", "l_discount", "l_tax", F.row_number().over(unit.orderBy(shuffle_key("n10", *keys), *keys, "l_discount", "l_tax")).alias("i"))
    return kept.join(drawn, ["l_suppkey", "i"]).drop("l_suppkey", "i")


@query("""with x as (select event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events), c as (select a, b, count(*) as n from x where b is not null group by all),
 l as (select event_type as b, row_number() over (order by event_type) as i from events group by 1), q as (select p, b as drawn, row_number() over (partition by p order by case when p = 0 then '' else md5('15:' || p || ':' || b) end, b) as i from l, range(20) t(p)),
 s as (select p, sum(n * (a = drawn)::int) / sum(n) as same from c join l using (b) join q using (i) group by p)
 select p::int as p, round(same, 6) as same, p = 0 as observed from s""")
def n15_permuted_label_map(spark, d):
    """Agreement of two labellings under permutations of the second one's names; rows are counted by pairs of labels before."""
    e = table(spark, d, "events")
    x = e.select(F.col("event_type").alias("a"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("b"))
    c = x.filter("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    labels = e.select(F.col("event_type").alias("b")).distinct()
    numbered = labels.withColumn("i", F.row_number().over(Window.orderBy("b")))  # a row per label
    every = labels.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(19))))
    key = F.when(F.col("p") == 0, F.lit("")).otherwise(shuffle_key("15", "p", "b"))
    drawn = every.select("p", F.col("b").alias("drawn"), F.row_number().over(Window.partitionBy("p").orderBy(key, "b")).alias("i"))
    s = c.join(numbered.join(drawn, "i"), "b").groupBy("p").agg((F.sum(F.when(F.col("a") == F.col("drawn"), F.col("n")).otherwise(0)) / F.sum("n")).alias("same"))
    return s.select("p", r6(F.col("same")).alias("same"), (F.col("p") == 0).alias("observed"))


@query("""with w as (select conv_id, turn, unnest(string_split(text, ' ')) as a, generate_subscripts(string_split(text, ' '), 1) - 1 as i from conversations),
 s as (select *, regexp_replace(lower(a), '[.,!?;:]+$', '') as b from w where ('0x' || substr(md5('c6:' || conv_id || ':' || turn || ':' || i), 1, 7))::bigint % 10 = 0)
 select conv_id, count(*) as sampled, count(*) filter (where a = b) as same, min(a) filter (where a <> b) as example from s group by 1""")
def c6_alignment_check(spark, d):
    """Words of two versions of a transcript compared at a hashed tenth of the places."""
    w = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("i", "a"))
    s = w.filter(F.conv(F.substring(shuffle_key("c6", "conv_id", "turn", "i"), 1, 7), 16, 10).cast("long") % 10 == 0)
    s = s.withColumn("b", F.regexp_replace(F.lower("a"), "[.,!?;:]+$", ""))
    return s.groupBy("conv_id").agg(F.count(F.lit(1)).alias("sampled"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("same"), F.min(F.when(F.col("a") != F.col("b"), F.col("a"))).alias("example"))
