"""Decoders of labels (survey 2.18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decoders
from ..operators.ranks import shuffle_key
from ..operators.tables import r6, table
from ..registry import query


def _fold(parts: int, seed: str, *keys: str):
    return (F.conv(F.substring(shuffle_key(seed, *keys), 1, 7), 16, 10).cast("long") % parts).cast("int")


@query("""with r as (select l_linenumber as u, (l_extendedprice > 30000)::int as y, (l_quantity > 25)::int as x, ('0x' || substr(md5('c4:' || l_orderkey || ':' || l_linenumber), 1, 7))::bigint % 3 as f from lineitem),
 t as (select u, k, sum(x * y) as n11, sum((1 - x) * y) as n01, sum(x * (1 - y)) as n10, sum((1 - x) * (1 - y)) as n00, stddev_pop(x) as sd, count(*) as n from r, range(3) a(k) where f <> k group by 1, 2),
 g as (select u, k, n, ln(n11 * n00 / (n10 * n01)::double) * sd as slope, n11 / (n11 + n01)::double > n10 / (n10 + n00)::double as at1, n01 / (n11 + n01)::double > n00 / (n10 + n00)::double as at0 from t),
 p as (select g.u, g.k, any_value(n) as n, any_value(slope) as slope, count(*) as m, avg((y = (case when x = 1 then at1 else at0 end)::int)::int) as accuracy,
  (avg((case when x = 1 then at1 else at0 end)::int) filter (where y = 1) + avg(1 - (case when x = 1 then at1 else at0 end)::int) filter (where y = 0)) / 2 as balanced from g join r on r.u = g.u and r.f = g.k group by 1, 2)
 select u::varchar as unit, k::int as fold, n as n_train, m as n_test, round(slope, 4) as slope, round(accuracy, 6) as accuracy, round(balanced, 6) as balanced from p""")
def c4_free_decoder(spark, d):
    """The logistic decoder without penalty on one binary feature, whose slope SQL has as a log odds ratio, with its held-out scores."""
    r = table(spark, d, "lineitem").select(
        "l_linenumber", (F.col("l_extendedprice") > 30000).cast("int").alias("y"), F.array((F.col("l_quantity") > 25).cast("double")).alias("x"), _fold(3, "c4", "l_orderkey", "l_linenumber").alias("f")
    )
    out = decoders.decode(r, "l_linenumber", "y", "x", "f", (decoders.Model("free", "free"),))
    at = lambda i: F.get("coefficients", F.lit(i))
    return out.select("unit", "fold", "n_train", "n_test", F.round(at(3) - at(2), 4).alias("slope"), r6(F.col("accuracy")).alias("accuracy"), r6(F.col("balanced")).alias("balanced"))


@query()
def c4_model_zoo(spark, d):
    """C4: all linear models with their grids and inner folds, on whole vectors of every class."""
    v = table(spark, d, "embeddings").select("vec_id", "label", "embedding", _fold(3, "zoo", "vec_id").alias("f")).withColumn("unit", F.lit("all"))
    return decoders.decode(v, "unit", "label", "embedding", "f", order="vec_id").select("unit", "model", "fold", "n_train", "n_test", "strength", "mix", F.round("accuracy", 4).alias("accuracy"), F.round("balanced", 4).alias("balanced"), "drop_reason")


_RATE = "n1 / sum(n1) over (partition by u, q, c) > n0 / sum(n0) over (partition by u, q, c)"


@query(f"""with r as (select l_linenumber as u, l_orderkey as o, (l_returnflag = 'R')::int as c, (l_extendedprice > 30000)::int as y, (l_quantity > 25)::int as x, ('0x' || substr(md5('f1:' || l_orderkey), 1, 7))::bigint % 3 as f
  from lineitem qualify row_number() over (partition by l_linenumber, l_orderkey order by l_suppkey, l_partkey, l_extendedprice, l_quantity, l_returnflag) = 1),
 i as (select *, row_number() over (partition by u, c order by o) as i from r), s as (select u, c, q, y, row_number() over (partition by u, c, q order by case when q = 0 then '' else md5((q - 1) || ':' || o) end, o) as i from r, range(13) t(q)),
 d as (select i.u, i.c, i.o, i.x, i.f, s.q, s.y from i join s on s.u = i.u and s.c = i.c and s.i = i.i),
 n as (select u, q, c, x, sum(y)::double as n1, sum(1 - y)::double as n0 from d group by all), g as (select u, q, c, x, ({_RATE})::int as guess from n),
 a as (select d.u, d.q, d.c, (avg(guess) filter (where y = 1) + avg(1 - guess) filter (where y = 0)) / 2 as b from d join g on g.u = d.u and g.q = d.q and g.c = 1 - d.c and g.x = d.x group by 1, 2, 3),
 w as (select u, q, avg(b) as across, sum(b) filter (where c = 1) as from_0, sum(b) filter (where c = 0) as from_1 from a group by 1, 2),
 ni as (select u, c, k as q, x, sum(y)::double as n1, sum(1 - y)::double as n0 from d, range(3) t(k) where d.q = 0 and f <> k group by all), gi as (select u, c, q, x, (n1 / sum(n1) over (partition by u, q, c) > n0 / sum(n0) over (partition by u, q, c))::int as guess from ni),
 ci as (select d.u, d.c, d.f, (avg(guess) filter (where y = 1) + avg(1 - guess) filter (where y = 0)) / 2 as b from d join gi on gi.u = d.u and gi.c = d.c and gi.q = d.f and gi.x = d.x where d.q = 0 group by 1, 2, 3),
 ce as (select u, avg(b) filter (where c = 0) as ceiling_0, avg(b) filter (where c = 1) as ceiling_1 from ci group by 1)
 select w.u::varchar as unit, round(w.across, 6) as across, round(from_0, 6) as from_0, round(from_1, 6) as from_1, round(ceiling_0, 6) as ceiling_0, round(ceiling_1, 6) as ceiling_1,
 round((1 + (select count(*) from w n where n.u = w.u and n.q > 0 and n.across >= w.across - 1e-12)) / 13.0, 6) as p from w join ce using (u) where w.q = 0""")
def c1_cross_condition_decoder(spark, d):
    """A fitted decoder trained on lines of one kind and tested on the other, both ways, with ceilings by folds within each and labels permuted within each (12 times); SQL has the decoder of one binary feature by counts."""
    rows = table(spark, d, "lineitem").groupBy("l_linenumber", "l_orderkey").agg(F.min(F.struct("l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag")).alias("r"))
    rows = rows.select(
        "l_linenumber", "l_orderkey", (F.col("r.l_returnflag") == "R").cast("int").alias("c"), (F.col("r.l_extendedprice") > 30000).cast("int").alias("y"), F.array((F.col("r.l_quantity") > 25).cast("double")).alias("x"), _fold(3, "f1", "l_orderkey").alias("f")
    )
    out = decoders.cross_decode(rows, "l_linenumber", "y", "x", "c", "f", "l_orderkey", (decoders.Model("free", "free"),), permutations=12, chunk=4)
    return out.select("unit", *(r6(F.col(c)).alias(c) for c in ("across", "from_0", "from_1", "ceiling_0", "ceiling_1", "p")))
