"""Line dedup: a suffix array over line-id sequences by prefix doubling; later copies of repeated line runs are deleted.

Lines with a word get content ids; a document is a sequence of them.  At depth ``2^k`` the
positions whose first ``2^k`` lines are equal form one interval of the suffix array (its
longest common prefix is that deep at least); its rank is its place in the order of all intervals.
Doubling joins each position to the one ``2^k`` lines on and orders the pairs of
ranks.  Positions alone in their interval repeat nothing and leave.  Interval minima combine before
the shuffle, and the intervals meet their positions in a join without further grouping, which Spark splits where it is skewed.

A run of lines is deleted when it has at least ``min_words`` words and a copy that starts
earlier in the order of ``doc_id``, text hash and line.  Such a run is the union of the
shortest stretches with ``min_words`` words that start or end at its lines.  A line has a word at least, so these
have at most ``min_words`` lines and doubling ends there; stretches of other lengths than ``2^k`` are named
by the ranks of the two overlapping stretches of ``2^k`` lines that cover them.
Overlapping and touching stretches are merged into maximal runs by a running maximum.

Defined results: null texts have no lines and stay null; lines without words are never deleted;
rows equal in ``doc_id`` and text are one document and share their result; a
null ``doc_id`` sorts first; an empty table gives no rows; all other columns stay, but ``kept``, ``n_lines`` and
``n_deleted``, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, word_count, written

_BLANK = r"^[\x20\x09-\x0D]*$"
ADDED = ("kept", "n_lines", "n_deleted")


@dataclass(frozen=True)
class Runs:
    """``broadcast_numbers``: starts and ends of deleted runs up to which these are broadcast to the texts; beyond it both are shuffled."""

    min_words: int = 16
    broadcast_numbers: int = 500_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _place(start: str = "i") -> Column:
    return F.struct("doc_id", "key", F.col(start).alias("i"))


def _intervals(level: DataFrame, names: list[str]) -> DataFrame:
    """The intervals with two positions at least, ``(*names, rank, first)``: their place in suffix order and first position."""
    found = level.groupBy(*names).agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"))
    found = found.filter("first <> last or (first is null) <> (last is null)").drop("last")
    return written(found.orderBy(*names).withColumn("rank", F.monotonically_increasing_id()), "intervals")


def _level(positions: DataFrame, names: list[str]) -> DataFrame:
    """Positions ``(doc_id, key, i, words, *names)`` to those that repeat, ``(doc_id, key, i, words, rank, first)``."""
    intervals = _intervals(positions, names)
    level = positions.join(intervals, names).select("doc_id", "key", "i", "words", "rank", "first").distinct()
    level = written(level, "level")
    release(intervals)
    return level


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """The shortest stretches with ``min_words`` words that start, or end, at each of ``lines``, where these are not ``2^k`` lines.

    A stretch from a line has just the lines that begin fewer than ``min_words`` words after it, so a window over
    running word counts finds it; stretches that leave ``lines`` have a gap in their line numbers.
    """
    text, most = Window.partitionBy("doc_id", "key"), min_words - 1
    ends = F.sum("words").over(text.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    counted = lines.select("doc_id", "key", "i", "words", ends.alias("end")).withColumn("begin", F.col("end") - F.col("words"))
    found = None
    for frame in (text.orderBy("begin").rangeBetween(0, most), text.orderBy("end").rangeBetween(-most, 0)):
        own = counted.select("doc_id", "key", F.min("i").over(frame).alias("start"), F.max("i").over(frame).alias("stop"), F.count(F.lit(1)).over(frame).alias("length"), F.sum("words").over(frame).alias("words"))
        own = own.filter((F.col("stop") - F.col("start") + 1 == F.col("length")) & (F.col("words") >= min_words) & (F.col("length").bitwiseAND(F.col("length") - 1) != 0))
        own = own.select("doc_id", "key", "start", F.col("length").cast("int").alias("length"))
        found = own if found is None else found.unionByName(own)
    return found.distinct()


def _at(level: DataFrame, back: Column | int, *columns: Column) -> DataFrame:
    return level.select(F.col("doc_id").alias("d"), F.col("key").alias("e"), (F.col("i") - back).alias("j"), *columns)


def _same(start: Column) -> Column:
    return F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("e")) & (start == F.col("j"))


def _covered(level: DataFrame, stretches: DataFrame, k: int) -> DataFrame:
    """Of the ``stretches`` between ``2^k`` and ``2^(k+1)`` lines those that start earlier too."""
    own = stretches.filter((F.col("length") > 1 << k) & (F.col("length") < 2 << k))
    for n, offset in enumerate((F.lit(0), F.col("length") - (1 << k))):
        own = own.join(_at(level, 0, F.col("rank").alias(f"r{n}")), _same(F.col("start") + offset)).drop("d", "e", "j")
    name = ["length", "r0", "r1"]
    firsts = own.groupBy(*name).agg(F.min(_place("start")).alias("first"), F.max(_place("start")).alias("last")).filter("first <> last or (first is null) <> (last is null)")
    return own.join(firsts.drop("last"), name).filter(F.col("first") < _place("start")).select("doc_id", "key", "start", "length")


def _maximal(runs: DataFrame) -> DataFrame:
    """Merge ``(doc_id, key, start, length)`` where they overlap or touch, to ``(doc_id, key, start, stop)``."""
    order = Window.partitionBy("doc_id", "key").orderBy("start", "stop")
    ends = runs.select("doc_id", "key", "start", (F.col("start") + F.col("length")).alias("stop"))
    apart = F.col("start") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = ends.withColumn("new", F.coalesce(apart.cast("int"), F.lit(0)))
    numbered = numbered.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "key", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def repeated_runs(docs: DataFrame, cfg: Runs = Runs()) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, key, start, stop)``: the maximal runs to delete, by line number among lines with words."""
    filled = F.filter(_lines(F.col("text")), lambda x: ~x.rlike(_BLANK))
    lines = docs.select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(filled).alias("i", "line"))
    lines = lines.select("doc_id", "key", "i", F.xxhash64("line").alias("x"), F.xxhash64("line", F.lit(1)).alias("y"), word_count(F.col("line")).alias("words"))

    level, k, found = _level(lines, ["x", "y"]), 0, []
    stretches = written(_stretches(level, cfg.min_words), "stretches")
    while True:
        later = level.filter((F.col("words") >= cfg.min_words) & (F.col("first") < _place()))
        runs = later.select("doc_id", "key", F.col("i").alias("start"), F.lit(1 << k).alias("length"))
        if k:
            runs = runs.unionByName(_covered(level, stretches, k))
        found.append(written(runs, "runs"))
        if 2 << k > cfg.min_words:
            break
        on = _at(level, 1 << k, F.col("rank").alias("next"), F.col("words").alias("more"))
        pairs = level.join(on, _same(F.col("i"))).select("doc_id", "key", "i", (F.col("words") + F.col("more")).alias("words"), F.col("rank").alias("own"), "next")
        last, level, k = level, _level(pairs, ["own", "next"]), k + 1
        release(last)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    out = written(_maximal(every), "maximal")
    release(level, stretches, *found)
    return out


def dedup_lines(docs: DataFrame, cfg: Runs = Runs()) -> DataFrame:
    """Adds ``kept`` (the text without deleted lines), ``n_lines`` (with words) and ``n_deleted`` to ``docs(doc_id, text, ...)``."""
    runs = repeated_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cfg)
    few = 2 * runs.count() <= cfg.broadcast_numbers
    spans = runs.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("e")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    own = docs.select(F.struct(*[c for c in docs.columns if c not in ADDED]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    out = own.join(F.broadcast(spans) if few else spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("e")), "left")
    # lines with their number among those with words
    out = out.withColumn("every", _lines(F.col("text"))).withColumn("fill", F.transform("every", lambda x: ~x.rlike(_BLANK)))
    out = out.withColumn("at", F.expr("filter(transform(fill, (f, i) -> if(f, i, -1)), i -> i >= 0)"))
    numbers = F.expr("flatten(transform(coalesce(spans, array()), s -> sequence(s.start, s.stop - 1)))")
    out = out.withColumn("lost", F.transform(numbers, lambda n: F.get("at", n)))
    keep = F.array_except(F.expr("if(size(every) > 0, sequence(0, size(every) - 1), cast(array() as array<int>))"), F.col("lost"))
    kept = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get("every", i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("at")).cast("long")
    return out.select("row.*", kept.alias("kept"), n_lines.alias("n_lines"), F.size("lost").cast("long").alias("n_deleted"))
