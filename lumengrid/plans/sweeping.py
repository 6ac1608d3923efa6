"""Sweeps over grids of windows, duration annotations, every window mode, and look-ups in maps (survey 2.4, 2.10, 2.18)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.intervals import annotated, annotated_from, counts_before, window_bounds
from ..operators.tables import correlation, micros, r6, table
from ..registry import query

HOUR = 3_600_000_000
STARTS, LENGTHS = (-12, -6, 0, 6), (3, 12)


@query("""with e as (select event_id, user_id, event_type, value, epoch_us(ts) as t from events), g as (select s, l from (values (-12), (-6), (0), (6)) a(s), (values (3), (12)) b(l)),
 w as (select event_id, user_id, value, s, l, t + s * 3600000000 as b, t + (s + l) * 3600000000 as e from e, g where event_type = 'click'),
 n as (select w.event_id, w.s, w.l, any_value(w.value) as value, count(e.t) as n from w left join e on e.user_id = w.user_id and e.t >= w.b and e.t < w.e group by all),
 r as (select s, l, count(*) as words, sum(n)::bigint as hits, avg(n / l) as rate, corr(n, value) as r from n group by all)
 select s as start_h, l as length_h, words, hits, round(rate, 6) as rate, round(r, 6) as r, row_number() over (order by round(abs(r), 6) desc, s, l) = 1 as best from r""")
def sweep_window_grid(spark, d):
    """2.18: a grid of window starts and lengths in one job: counts of every event and window from running counts, scored by window, the best marked."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("t"))
    grid = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(n).alias("l")) for s in STARTS for n in LENGTHS)))
    w = e.filter("event_type = 'click'").select("event_id", "user_id", "value", "t", grid.alias("g"))
    # both ends of each window are marks; a window's count is the difference of its marks
    ends = w.select("event_id", "user_id", "value", F.col("g.s").alias("s"), F.col("g.l").alias("l"), F.explode(F.array(F.struct(F.lit(-1).alias("sign"), (F.col("t") + F.col("g.s") * HOUR).alias("m")), F.struct(F.lit(1).alias("sign"), (F.col("t") + (F.col("g.s") + F.col("g.l")) * HOUR).alias("m")))).alias("x"))
    ends = ends.select("event_id", "user_id", "value", "s", "l", "x.sign", "x.m")
    n = counts_before(e.select("user_id", "t"), ends, "t", "m", 24 * HOUR, ("user_id",)).groupBy("event_id", "s", "l").agg(F.first("value").alias("value"), F.sum(F.col("sign") * F.col("before")).alias("n"))
    r = n.groupBy("s", "l").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("hits"), F.avg(F.col("n") / F.col("l")).alias("rate"), F.round(correlation("n", "value"), 6).alias("r"))
    first = F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "s", "l")) == 1  # a row a grid point
    return r.select(F.col("s").alias("start_h"), F.col("l").alias("length_h"), "words", "hits", r6(F.col("rate")).alias("rate"), "r", first.alias("best"))


def _words(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", micros("o_orderdate").alias("t"), "o_totalprice", "o_orderpriority")
    onset = (F.col("t") / 1000).cast("double")
    return o.select("o_orderkey", onset.alias("onset"), (onset + F.floor("o_totalprice")).alias("offset"), F.when(F.col("o_orderkey") % 11 > 0, F.substring("o_orderpriority", 1, 1)).alias("speaker"))


@query("""with w as (select o_orderkey, epoch_us(o_orderdate) / 1000 as onset, epoch_us(o_orderdate) / 1000 + floor(o_totalprice) as off, case when o_orderkey % 11 > 0 then substr(o_orderpriority, 1, 1) end as speaker from orders)
 select o_orderkey, off - onset as word_dur, case when speaker is not null then onset - case when speaker = '1' then 100 else 20 end end as regress_pre_onset, case when speaker is not null then off + case when speaker = '1' then 300 else 50 end end as regress_post_offset,
 case when speaker is not null then off - onset + case when speaker = '1' then 400 else 70 end end as regress_dur, case when speaker is not null then 500.0 end as fixed_dur from w""")
def annotate_durations(spark, d):
    """2.4 annotation: word and window durations by speaker, and those of windows of one length; words without a speaker have none."""
    words = _words(spark, d)
    by_speaker = annotated(words, "speaker", "1", (100, 300), (20, 50))
    fixed = annotated(words, "speaker", "1", fixed=500).select("o_orderkey", F.col("regress_dur").alias("fixed_dur"))
    return by_speaker.join(fixed, "o_orderkey").select("o_orderkey", "word_dur", "regress_pre_onset", "regress_post_offset", "regress_dur", "fixed_dur")


@query("""with w as (select o_orderkey, epoch_us(o_orderdate) / 1000 as onset, floor(o_totalprice) as dur, case when o_orderkey % 11 > 0 then substr(o_orderpriority, 1, 1) end as speaker from orders),
 i as (select *, row_number() over (partition by speaker order by onset, o_orderkey) as i from w), n as (select *, i as k from i where speaker is not null and i % 7 > 0)
 select i.o_orderkey, i.dur as word_dur, n.dur + 180 as regress_dur from i left join n on n.speaker = i.speaker and n.k = i.i""")
def annotate_from_events(spark, d):
    """2.4 annotation from extracted windows: joined by speaker and the word's number among the speaker's, null where windows are missing."""
    words = _words(spark, d)
    order = Window.partitionBy("speaker").orderBy("onset", "o_orderkey")
    taken = words.filter("speaker is not null").withColumn("i", F.row_number().over(order)).filter("i % 7 > 0")
    windows = taken.select("speaker", "i", (F.col("onset") - 100).alias("pre_onset"), (F.col("offset") + 80).alias("post_offset"), (F.col("offset") - F.col("onset") + 180).alias("duration"))
    return annotated_from(words, windows, "speaker", ["onset", "o_orderkey"]).select("o_orderkey", "word_dur", "regress_dur")


@query("""with w as (select epoch_us(o_orderdate) / 1000 as a, epoch_us(o_orderdate) / 1000 + floor(o_totalprice) as b from orders),
 m as (select 'fixed' as mode, a + 80 - 100 as s, a + 80 + 400 as e, a from w union all select 'regression', a, b + 500, a from w union all select 'before_onset', a - 500, a, a from w union all select 'after_onset', a, b + 500, a from w
  union all select 'pre_onset_to_post_offset', a - 100, b + 400, a from w union all select 'shifted', a + 250, b + 250, a from w union all select 'pre_to_onset', a - 100, a, a from w union all select 'pre_to_offset', a - 100, b, a from w
  union all select 'onset_to_offset', a, b, a from w union all select 'onset_to_offset_plus', a, b + 400, a from w union all select 'onset_to_onset_plus', a, a + 400, a from w
  union all select 'pre_to_offset_plus', a - 100, b + 400, a from w union all select 'onset_to_offset_plusminus', a - 100, b + 400, a from w)
 select mode, count(*) as n, round(sum(e - s), 3) as total, round(avg(s - a), 3) as lead from m group by 1""")
def windows_of_every_mode(spark, d):
    """2.4: all window modes, older ones included, against bounds written out one by one."""
    words, out = _words(spark, d), None
    for mode in ("fixed", "regression", "before_onset", "after_onset", "pre_onset_to_post_offset", "shifted", "pre_to_onset", "pre_to_offset", "onset_to_offset", "onset_to_offset_plus", "onset_to_onset_plus", "pre_to_offset_plus", "onset_to_offset_plusminus"):
        start, end = window_bounds(mode, 100, 400, 250)
        one = words.select((end - start).alias("w"), (start - F.col("onset")).alias("lead")).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 3).alias("total"), (F.round(F.avg("lead"), 3) + 0.0).alias("lead"))
        out = one if out is None else out.unionByName(one)
    return out


#: What categories are called.
NAMES = {"view": "looked", "click": "pressed", "purchase": "bought", "signup": "joined"}


@query("""select event_id, case event_type when 'view' then 'looked' when 'click' then 'pressed' when 'purchase' then 'bought' when 'signup' then 'joined' else 'other: ' || event_type end as name,
 json_extract_string(props, '$.k') as k, json_extract_string(props, '$.missing') is not null as has_missing, len(json_keys(props)) as n_keys from events""")
def map_lookup(spark, d):
    """2.10: names looked up in a map with a fallback, and keys of a map read from JSON."""
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    e = table(spark, d, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    found = F.coalesce(F.try_element_at(names, F.col("event_type")), F.concat(F.lit("other: "), "event_type"))
    return e.select("event_id", found.alias("name"), F.try_element_at("m", F.lit("k")).alias("k"), F.map_contains_key("m", F.lit("missing")).alias("has_missing"), F.size(F.map_keys("m")).cast("long").alias("n_keys"))
