"""Mixed models, cells of similar rows, and balancing (survey 2.12, 2.14, 2.16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance, cells, mixed
from ..operators.tables import r6, table
from ..registry import query
from .testing import _simpson


def _cells(spark, d):
    """A response for each supplier and line number: a two-way layout with one value in each cell, from lines with more pieces than four times their number."""
    over = F.col("l_quantity") > 4 * F.col("l_linenumber")
    lines = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg((1 + F.count(F.when(over, 1))).alias("n"))
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") / 10000).alias("level"))
    return lines.join(own, "l_suppkey").select("l_suppkey", "l_linenumber", (F.ln("n") + F.col("level")).alias("y"))


@query("""with y as (select l_suppkey as u, l_linenumber as c, ln(1 + count(*) filter (where l_quantity > 4 * l_linenumber)) + any_value(s_acctbal) / 10000 as y from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2),
 m as (select *, avg(y) over (partition by u) as mu, avg(y) over (partition by c) as mc, avg(y) over () as m from y), k as (select count(distinct u)::double as a, count(distinct c)::double as b from y),
 s as (select sum((mu - m) ** 2) / (any_value(a) - 1) as msu, sum((mc - m) ** 2) / (any_value(b) - 1) as msc, sum((y - mu - mc + m) ** 2) / ((any_value(a) - 1) * (any_value(b) - 1)) as mse, any_value(a) as a, any_value(b) as b, any_value(m) as m from m, k)
 select c as l_linenumber, round(any_value(mc), 5) as raw_mean, round((msc - mse) / msc * (any_value(mc) - s.m), 4) as deviation, round(s.m + (msc - mse) / msc * (any_value(mc) - s.m), 4) as pooled_mean,
 round((msc - mse) / a, 4) as category_variance, round((msu - mse) / b, 4) as unit_variance, round(mse, 5) as error_variance from m, s group by c, msc, mse, msu, a, b, s.m""")
def m14_partial_pooling(spark, d):
    """Crossed effects of line number and supplier by REML, and line numbers' means drawn towards the whole; of a balanced layout, where SQL has the estimates from mean squares."""
    cells = _cells(spark, d)
    fit = mixed.crossed_effects(cells, "y", [], "l_linenumber", "l_suppkey")
    means = cells.groupBy("l_linenumber").agg(F.round(F.avg("y"), 5).alias("raw_mean"))
    blups = spark.createDataFrame(list(fit.blups.items()), "l_linenumber int, u double")  # one row a line number
    rounded = lambda x, k: F.lit(round(float(x), k))
    return means.join(F.broadcast(blups), "l_linenumber").select(
        "l_linenumber", "raw_mean", F.round("u", 4).alias("deviation"), F.round(F.col("u") + float(fit.beta[0]), 4).alias("pooled_mean"),
        rounded(fit.small_variance, 4).alias("category_variance"), rounded(fit.large_variance, 4).alias("unit_variance"), rounded(fit.error_variance, 5).alias("error_variance"),
    )


_STEPS, _CELLS = 8, 5


def _rounds() -> str:
    """SQL of the same k-means, its rounds one after the other; ``a{k}`` has each row's cell in round ``k``."""
    parts = ["""z as (select *, row_number() over () as id from (select l_orderkey as o, l_linenumber as l, l_quantity, l_extendedprice, l_discount, l_tax,
 (l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over () as x, (l_extendedprice - avg(l_extendedprice) over ()) / stddev_pop(l_extendedprice) over () as y, (l_discount - avg(l_discount) over ()) / stddev_pop(l_discount) over () as w from lineitem))"""]
    parts.append(f"c0 as (select row_number() over (order by md5('cells:' || o || ':' || l), o, l, l_quantity, l_extendedprice, l_discount) - 1 as cell, x, y, w from z qualify cell < {_CELLS})")
    for k in range(_STEPS):
        parts.append(f"a{k} as (select id, min({{'d': (z.x - c.x) ** 2 + (z.y - c.y) ** 2 + (z.w - c.w) ** 2, 'cell': c.cell}}) as hit from z, c{k} c group by id)")
        parts.append(f"c{k + 1} as (select c.cell, coalesce(m.x, c.x) as x, coalesce(m.y, c.y) as y, coalesce(m.w, c.w) as w from c{k} c left join (select hit.cell as cell, avg(x) as x, avg(y) as y, avg(w) as w from a{k} join z using (id) group by 1) m using (cell))")
    parts.append(f"f as (select id, min({{'d': (z.x - c.x) ** 2 + (z.y - c.y) ** 2 + (z.w - c.w) ** 2, 'cell': c.cell}}) as hit from z, c{_STEPS} c group by id)")
    return ", ".join(parts)


def _found(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    fit = cells.kmeans(rows, ["l_quantity", "l_extendedprice", "l_discount"], _CELLS, ["l_orderkey", "l_linenumber"], "cells", _STEPS)
    return rows, fit


@query(f"with {_rounds()} select c.cell::int as cell, count(id) as n, round(any_value(c.x), 4) as quantity, round(any_value(c.y), 4) as price, round(any_value(c.w), 4) as discount, round(sum(hit.d), 2) as inertia from c{_STEPS} c left join f on f.hit.cell = c.cell group by 1")
def f17_kmeans_cells(spark, d):
    """cells of lines with like quantity, price and discount, by eight rounds of k-means from hash-chosen seeds."""
    rows, fit = _found(spark, d)
    at = rows.select(fit.nearest().alias("at")).groupBy("at.cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("at.distance"), 2).alias("inertia"))
    centres = spark.createDataFrame([(i, *(round(v, 4) for v in c)) for i, c in enumerate(fit.centroids)], "cell int, quantity double, price double, discount double")  # one row a cell
    return F.broadcast(centres).join(at, "cell", "left").fillna(0, ["n"])


@query(f"""with {_rounds()}, r as (select o, l, l_tax, hit.cell as cell, row_number() over (partition by hit.cell order by md5('n12-to:' || o || ':' || l), o, l, l_tax) as i, row_number() over (partition by hit.cell order by md5('n12-from:' || o || ':' || l), o, l, l_tax) as j from z join f using (id))
 select a.o as l_orderkey, a.l as l_linenumber, a.cell::int as cell, a.l_tax, b.l_tax as drawn_l_tax from r a join r b on a.cell = b.cell and a.i = b.j""")
def n12_matched_shuffle(spark, d):
    """A feature permuted among lines of one cell, so that it only goes to lines with like controls; a cell with very many lines is ranked in parts."""
    rows, fit = _found(spark, d)
    at = rows.select("l_orderkey", "l_linenumber", "l_tax", fit.nearest().getField("cell").alias("cell"))
    return cells.shuffled_inside(at, ["cell"], ["l_orderkey", "l_linenumber"], ["l_tax"], "n12")


_SIDES = "e as (select vec_id, label, (vec_id % (label % 3 + 2) = 0)::int as c from embeddings)"
_TAIL = _simpson("2 * pow(v, df - 1) * exp(-v * v / 2) / exp(df / 2.0 * ln(2) + lgamma(df / 2.0))", "sqrt(chi2)", 2000)


@query(f"""with recursive {_SIDES}, n as (select label, count(*) filter (where c = 0) as a, count(*) filter (where c = 1) as b from e group by 1),
 st(k, a, b) as (select 0, list(a order by label), list(b order by label) from n union all
  select k + 1, case when side = 0 then list_transform(range(1, len(a) + 1), lambda i: case when i = row then b[i] else a[i] end) else a end, case when side = 1 then list_transform(range(1, len(a) + 1), lambda i: case when i = row then a[i] else b[i] end) else b end
  from (select *, (list_position(r, list_max(r)) + 1) // 2 as row, (list_position(r, list_max(r)) - 1) % 2 as side, 1 - {_TAIL} as p from
   (select *, list_transform(range(2 * len(a)), lambda i: case when i % 2 = 0 then (a[i // 2 + 1] - ea[i // 2 + 1]) / sqrt(ea[i // 2 + 1]) else (b[i // 2 + 1] - eb[i // 2 + 1]) / sqrt(eb[i // 2 + 1]) end) as r,
     list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - ea[i]) ** 2 / ea[i] + (b[i] - eb[i]) ** 2 / eb[i])) as chi2, len(a) - 1.0 as df from
    (select *, list_transform(range(1, len(a) + 1), lambda i: (a[i] + b[i]) * list_sum(a) / (list_sum(a) + list_sum(b))::double) as ea, list_transform(range(1, len(a) + 1), lambda i: (a[i] + b[i]) * list_sum(b) / (list_sum(a) + list_sum(b))::double) as eb from st)))
  where p < 0.05 and list_max(r) > 0 and case when side = 0 then a[row] > b[row] else b[row] > a[row] end),
 q as (select unnest(list_sort((select list(label) from n))) as label, unnest(a) as q0, unnest(b) as q1 from st order by k desc limit (select count(*) from n)),
 w as (select *, row_number() over (partition by label, c order by md5('b1:' || vec_id), vec_id) as at_ from e)
 select w.label, w.c, count(*) as n, count(*) filter (where at_ <= case when c = 0 then q0 else q1 end) as kept, coalesce(sum(vec_id) filter (where at_ <= case when c = 0 then q0 else q1 end), 0)::bigint as ids from w join q using (label) group by 1, 2""")
def b1_balanced_until_alike(spark, d):
    """B1: rows of two conditions, down-sampled cell by cell until the conditions are spread over classes alike (p of at least 0.05)."""
    e = table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % (F.col("label") % 3 + 2) == 0).cast("int").alias("c"))
    kept = balance.balanced(e, "label", "c", ["vec_id"], "b1").select("vec_id").withColumn("stays", F.lit(1))
    both = e.join(kept, "vec_id", "left")
    return both.groupBy("label", "c").agg(F.count(F.lit(1)).alias("n"), F.count("stays").alias("kept"), F.coalesce(F.sum(F.when(F.col("stays") == 1, F.col("vec_id"))), F.lit(0)).alias("ids"))
