"""Mixing sources to target weights (DataFrame functions only).

A multivariate-hypergeometric splitting tree: each source owes a quota of
blocks; starting from all output shards, every node draws how many blocks of
each source its left half gets, exactly as if shuffled blocks were dealt out,
until single shards remain.  A shard then draws its quota of each source as a
stretch of that source's permuted blocks (stretches of different shards are
disjoint), and orders them locally.

The permutation of a source is the order of seeded block hashes.  Its ranks come from
hash buckets of bounded size and sums over buckets, so no source is sorted in one task.

Defined results: null texts have size 0 and own no blocks; sources sort by code
point with null last; repeated rows are separate documents; without words all
targets are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sorted sources; no source is used over ``most`` times.

    ``block_words``: words in a block, None for whole documents.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    block_words: int | None = 64
    shard_blocks: int = 16384
    bucket_rows: int = 4096
    seed: int = 17


def sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``docs(doc_id, source, text)`` to a slim written table ``(row, doc_id, source, size)``; ``row`` names a column with a key of its rows."""
    key = F.monotonically_increasing_id() if row is None else F.col(row)
    return written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("row")), "sizes")


def _blocks(size: Column, mix: Mix) -> Column:
    if mix.block_words is None:
        return (size > 0).cast("long")
    return F.ceil(size / F.lit(mix.block_words)).cast("long")


def targets(slim: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per source: ``sid, source, source_size, n_blocks, target, quota``.

    With ``r`` the share per weight at which a source hits its limit, sources in order of ``r`` are
    limited as long as ``r`` is under the share that the others would get.
    """
    per = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(_blocks(F.col("size"), mix)).alias("n_blocks"))
    every = Window.partitionBy()
    n = len(mix.weights)
    per = per.withColumn("sid", (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("sid") % n + 1).cast("int")).cast("double"))
    per = per.withColumn("limit", (mix.most * F.col("source_size")).cast("double"))
    order = every.orderBy((F.col("limit") / F.col("weight")).asc(), "sid")
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    share = (F.sum("source_size").over(every) - before) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("share", share)
    free = F.max(F.when(F.col("limit") / F.col("weight") > F.col("share"), F.col("share"))).over(every)
    per = per.withColumn("target", F.least("limit", F.coalesce(free * F.col("weight"), F.col("limit"))))
    quota = F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"), mix.most * F.col("n_blocks"))
    return per.select("sid", "source", "source_size", "n_blocks", "target", F.when(F.col("source_size") > 0, quota).otherwise(F.lit(0)).cast("long").alias("quota"))


def _log_factorial(x: str) -> str:
    """ln x! by Stirling's series eight places up."""
    z, down = f"(({x}) + 9.0D)", " * ".join(f"(({x}) + {k}.0D)" for k in range(1, 9))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1.0D/(12.0D*{z}) - 1.0D/(360.0D*{z}*{z}*{z}) - ln({down}))"


def hypergeometric(total: str, good: str, drawn: str, u: str) -> str:
    """SQL for the number of ``good`` among ``drawn`` of ``total``, by inversion at ``u`` outward from the mode.

    Steps beyond 12 standard deviations have no mass in double precision and are not taken.
    """
    lf = _log_factorial
    mode = f"least({good}, {drawn}, cast(floor(({drawn} + 1.0D) * ({good} + 1.0D) / ({total} + 2.0D)) as bigint))"
    mode = f"greatest({mode}, {drawn} + {good} - {total}, 0L)"
    rest = f"({total} - {good} - {drawn} + m)"
    p = (
        f"exp({lf(good)} - {lf('m')} - {lf(f'({good} - m)')} + {lf(f'({total} - {good})')} - {lf(f'({drawn} - m)')} - {lf(rest)}"
        f" - {lf(total)} + {lf(drawn)} + {lf(f'({total} - {drawn})')})"
    )
    spread = f"sqrt(greatest(1.0D, cast({drawn} as double) * {good} / greatest({total}, 1L) * ({total} - {good}) / greatest({total}, 1L) * ({total} - {drawn}) / greatest({total} - 1L, 1L)))"
    steps = f"cast(least(greatest(least({good}, {drawn}) - m, m - greatest(0L, {drawn} + {good} - {total})), 12.0D * {spread} + 12.0D) as int)"
    up = f"s.up * ({good} - m - j + 1.0D) * ({drawn} - m - j + 1.0D) / ((m + j) * ({rest} + j))"
    down = f"s.down * (m - j + 1.0D) * ({rest} - j + 1.0D) / (({good} - m + j) * ({drawn} - m + j))"
    up, down = f"greatest(0.0D, {up})", f"if(m - j >= greatest(0L, {drawn} + {good} - {total}), greatest(0.0D, {down}), 0.0D)"
    walk = (
        f"aggregate(if({steps} >= 1, sequence(1, {steps}), cast(array() as array<int>)), named_struct('x', if({u} < p, m, null), 'up', p, 'down', p, 'left', {u} - p), "
        f"(s, j) -> if(s.x is not null, s, element_at(transform(array(named_struct('up', {up}, 'down', {down})), t -> named_struct("
        "'x', case when s.left < t.up then m + j when s.left < t.up + t.down then m - j end, 'up', t.up, 'down', t.down, 'left', s.left - t.up - t.down)), 1)), "
        "s -> coalesce(s.x, m))"
    )
    return f"element_at(transform(array({mode}), m -> element_at(transform(array({p}), p -> {walk}), 1)), 1)"


def split_tree(quotas: DataFrame, total: int, shards: int, mix: Mix = Mix()) -> DataFrame:
    """Quotas ``(sid, quota)`` to ``(shard, sid, quota)``; rows sum to the quotas, shards to their capacity exactly."""
    nodes = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("sid", "quota"))).alias("q")).select(
        F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "q"
    )
    until = f"cast(floor(cast(({{}}) as decimal(20,0)) * {total} / {shards}) as bigint)"
    uniform = f"(shiftrightunsigned(xxhash64({mix.seed}L, lo, hi, e.sid), 11) / 9007199254740992.0D)"
    draw = hypergeometric("a.total", "e.quota", "a.free", uniform)
    left = (
        "aggregate(q, named_struct('total', aggregate(q, 0L, (t, e) -> t + e.quota), 'free', room, 'out', cast(array() as array<struct<sid:bigint,quota:bigint>>)), "
        f"(a, e) -> element_at(transform(array({draw}), x -> named_struct('total', a.total - e.quota, 'free', a.free - x, 'out', array_append(a.out, named_struct('sid', e.sid, 'quota', x)))), 1), a -> a.out)"
    )
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        if level and level % 6 == 0:
            nodes = nodes.repartition("lo")
        mid = "cast(floor((lo + hi) / 2) as bigint)"
        parted = nodes.withColumn("mid", F.expr(mid)).withColumn("room", F.expr(f"{until.format('mid')} - {until.format('lo')}"))
        parted = parted.withColumn("l", F.expr(f"if(hi - lo > 1, {left}, q)"))
        right = "zip_with(q, l, (a, b) -> named_struct('sid', a.sid, 'quota', a.quota - b.quota))"
        halves = f"if(hi - lo > 1, array(named_struct('lo', lo, 'hi', mid, 'q', l), named_struct('lo', mid, 'hi', hi, 'q', {right})), array(named_struct('lo', lo, 'hi', hi, 'q', q)))"
        nodes = parted.select(F.explode(F.expr(halves)).alias("n")).select("n.*")
    return nodes.select(F.col("lo").alias("shard"), F.explode("q").alias("e")).select("shard", "e.sid", "e.quota").filter(F.col("quota") > 0)


def _before(df: DataFrame, key: list[str], at: str, value: str, chunk: int = 4096) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of ``key`` with smaller ``at`` (distinct whole numbers).

    Sums of ``chunk`` neighbours first, then sums of these, so that no task orders all rows of a key.
    """
    own = df.withColumn("_chunk", F.expr(f"{at} div {chunk}"))
    chunks = own.groupBy(*key, "_chunk").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.select(*key, "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_from"))
    inside = Window.partitionBy(*key, "_chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(starts, [*key, "_chunk"]).withColumn("before", F.col("_from") + F.col("_in")).drop("_chunk", "_from", "_in")


def draw(slim: DataFrame, plan: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixed stream: ``(shard, slot, row, doc_id, sid, block, epoch, words)``, one row per block drawn.

    ``plan`` is what :func:`targets` gives, written.
    """
    total = plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]  # one number
    shards = max(1, math.ceil(total / mix.shard_blocks))
    leaves = split_tree(plan.select("sid", "quota"), total, shards, mix)
    width = F.greatest(F.lit(1), F.ceil(F.col("all") / shards)).cast("long")
    leaves = _before(written(leaves, "leaves"), ["sid"], "shard", "quota").withColumnRenamed("before", "begin").withColumn("end", F.col("begin") + F.col("quota"))
    leaves = leaves.join(plan.select("sid", F.col("quota").alias("all")), "sid").withColumn("width", width)
    cells = leaves.select("sid", "shard", "begin", "end", F.explode(F.expr("sequence(begin div width, (end - 1) div width)")).alias("cell"))

    keys = plan.filter("quota > 0").select(F.col("source").alias("s"), "sid", "n_blocks", "quota")
    own = slim.filter("size > 0").join(keys, F.col("source").eqNullSafe(F.col("s")))
    own = own.withColumn("epoch", F.explode(F.expr("sequence(0L, (quota - 1) div n_blocks)")))
    own = own.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), _blocks(F.col("size"), mix) - 1)))
    words = F.col("size") if mix.block_words is None else F.least(F.lit(mix.block_words).cast("long"), F.col("size") - F.col("block") * mix.block_words)
    own = own.withColumn("words", words).withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed), "epoch", "doc_id", "block"), 11))
    own = own.withColumn("bucket", F.expr(f"cast(floor(h / 9007199254740992.0D * ceil(n_blocks / {mix.bucket_rows})) as bigint)"))
    own = own.select("row", "doc_id", "sid", "epoch", "block", "words", "h", "bucket", "n_blocks", "quota", "size")
    bucket = ["sid", "epoch", "bucket"]
    counts = own.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
    starts = _before(written(counts, "counts"), ["sid", "epoch"], "bucket", "n").select(*bucket, F.col("before").alias("start"))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy(*bucket).orderBy("h", "doc_id", "block", "size", "row")))
    drawn = ranked.join(starts, bucket).withColumn("place", F.col("epoch") * F.col("n_blocks") + F.col("start") + F.col("rank") - 1)
    drawn = drawn.filter("place < quota").withColumn("cell", F.expr(f"place div cast(greatest(1, ceil(quota / {shards})) as bigint)"))
    dealt = drawn.join(cells, (drawn["sid"] == cells["sid"]) & (drawn["cell"] == cells["cell"]) & (F.col("place") >= F.col("begin")) & (F.col("place") < F.col("end"))).drop(cells["sid"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(mix.seed + 1), "h", "shard"), "doc_id", "block", "epoch", "size", "row")
    return dealt.withColumn("slot", F.row_number().over(local) - 1).select("shard", "slot", "row", "doc_id", "sid", "block", "epoch", "words")


def mixed(docs: DataFrame, mix: Mix = Mix(), row: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs(doc_id, source, text)`` to ``(slim, plan, draws)``."""
    slim = sizes(docs, row)
    plan = written(targets(slim, mix), "targets")
    return slim, plan, draw(slim, plan, mix)


def taken(slim: DataFrame, plan: DataFrame, draws: DataFrame) -> DataFrame:
    """What the mix takes of each document: ``row, doc_id, size, source_size, target, taken, first_shard``."""
    per = draws.groupBy("row").agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"))
    of_source = plan.select(F.col("source").alias("s"), "source_size", "target")
    out = slim.join(of_source, F.col("source").eqNullSafe(F.col("s"))).join(per, "row", "left")
    return out.select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")
