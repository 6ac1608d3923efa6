"""Joins on time: points in intervals, and the nearest point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int, on: tuple[str, ...] = (), closed: bool = False) -> DataFrame:
    """Pairs with ``start <= at < end`` (``<= end`` when ``closed``) and equal ``on`` columns.

    Spans are laid over buckets of ``width``, so the join is an equi-join on bucket with the
    bounds as a residual condition; a span meets a point in one bucket only.  Choose
    ``width`` near the usual span: wider means more misses, narrower more copies.
    """
    last = F.col(end) if closed else F.col(end) - 1
    laid = spans.filter(F.col(start) <= last).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))
    keyed = points.withColumn("_b", F.floor(F.col(at) / width))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) <= last)
    return keyed.join(laid, ["_b", *on]).filter(inside).drop("_b")


def counts_before(points: DataFrame, marks: DataFrame, at: str, mark: str, width: int, on: tuple[str, ...] = (), out: str = "before") -> DataFrame:
    """Adds to ``marks`` how many points of equal ``on`` lie before ``mark``; nothing is paired, so dense points cost no more than their number.

    Time is cut into buckets of ``width``: a running count inside each, and the counts of whole buckets before it.  Counts of points in ``[a, b)`` are differences of two of these.
    Marks without a time get null; null keys are a key of their own.
    """
    both = marks.select("*", F.col(mark).alias("_t"), F.lit(0).alias("_n"), F.lit(1).alias("_mine")).unionByName(points.select(*on, F.col(at).alias("_t"), F.lit(1).alias("_n"), F.lit(0).alias("_mine")).filter("_t is not null"), allowMissingColumns=True)
    both = both.withColumn("_b", F.floor(F.col("_t") / width))
    totals = both.groupBy(*on, "_b").agg(F.sum("_n").alias("_k"))
    earlier = Window.partitionBy(*on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    starts = totals.select(*(F.col(c).alias(f"_on_{c}") for c in on), F.col("_b").alias("_bucket"), F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_start"))
    # marks come before points of the same time, so that these are not counted
    inside = Window.partitionBy(*on, "_b").orderBy("_t", F.desc("_mine")).rowsBetween(Window.unboundedPreceding, 0)
    mine = both.withColumn("_run", F.sum("_n").over(inside)).filter("_mine = 1")
    same = F.col("_b").eqNullSafe(F.col("_bucket"))
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    counted = F.when(F.col("_t").isNotNull(), F.col("_start") + F.col("_run"))
    return mine.join(starts, same).select(*marks.columns, counted.alias(out))


def annotated(words: DataFrame, speaker: str, own: str, target: tuple[float, float] = (0, 0), other: tuple[float, float] = (0, 0), fixed: float | None = None) -> DataFrame:
    """Adds ``word_dur``, ``regress_dur``, ``regress_pre_onset`` and ``regress_post_offset`` to words with ``onset`` and ``offset``.

    Windows reach ``(before, after)`` beyond the word, by speaker, or have the length ``fixed`` from its onset; words without a time or speaker have null ones.
    """
    mine = F.col(speaker) == own
    begin = F.col("onset") - (F.lit(0.0) if fixed is not None else F.when(mine, float(target[0])).otherwise(float(other[0])))
    end = F.col("onset") + float(fixed) if fixed is not None else F.col("offset") + F.when(mine, float(target[1])).otherwise(float(other[1]))
    known = F.col(speaker).isNotNull() & F.col("onset").isNotNull() & F.col("offset").isNotNull()
    return words.withColumn("word_dur", F.col("offset") - F.col("onset")).withColumn("regress_pre_onset", F.when(known, begin)).withColumn("regress_post_offset", F.when(known, end)).withColumn("regress_dur", F.col("regress_post_offset") - F.col("regress_pre_onset"))


def annotated_from(words: DataFrame, windows: DataFrame, speaker: str, order: list[str]) -> DataFrame:
    """The same from extracted windows ``(speaker, i, pre_onset, post_offset, duration)``: the ``i``-th word of a speaker (from 1, in ``order``) has the ``i``-th window, or null ones."""
    counted = words.withColumn("_i", F.row_number().over(Window.partitionBy(speaker).orderBy(*order)))
    found = windows.select(F.col(speaker).alias("_speaker"), F.col("i").alias("_at"), F.col("pre_onset").alias("regress_pre_onset"), F.col("post_offset").alias("regress_post_offset"), F.col("duration").alias("regress_dur"))
    return counted.join(found, (F.col(speaker) == F.col("_speaker")) & (F.col("_i") == F.col("_at")), "left").withColumn("word_dur", F.col("offset") - F.col("onset")).drop("_i", "_speaker", "_at")


def nearest_gap(left: DataFrame, right: DataFrame, at: str, other: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``gap``, the distance from ``at`` to the nearest ``other`` of equal ``on`` (null where there is none), by one sorted pass."""
    tagged = left.select("*", F.col(at).alias("_t"), F.lit(None).cast("long").alias("_o"), F.lit(1).alias("_mine"))
    marks = right.select(*on, F.col(other).alias("_t"), F.col(other).cast("long").alias("_o"), F.lit(0).alias("_mine"))
    both = tagged.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy("_t", "_mine")
    before = F.last("_o", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_o", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col(at) - before, after - F.col(at))
    return both.withColumn("gap", gap).filter("_mine = 1").drop("_t", "_o", "_mine")


#: Window modes: begin and end from onset, offset, and parameters ``pre``, ``post``, ``shift`` (ms).
MODES = {
    "fixed": ("onset + 80 - pre", "onset + 80 + post"),
    "regression": ("onset", "offset + 500"),
    "before_onset": ("onset - 500", "onset"),
    "after_onset": ("onset", "offset + 500"),
    "pre_onset_to_post_offset": ("onset - pre", "offset + post"),
    "shifted": ("onset + shift", "offset + shift"),
    "pre_to_onset": ("onset - pre", "onset"),
    "pre_to_offset": ("onset - pre", "offset"),
    "onset_to_offset": ("onset", "offset"),
    "onset_to_offset_plus": ("onset", "offset + post"),
    "onset_to_onset_plus": ("onset", "onset + post"),
    "pre_to_offset_plus": ("onset - pre", "offset + post"),
    "onset_to_offset_plusminus": ("onset - pre", "offset + post"),
    "offset_plus_minus": ("offset - pre", "offset + post"),
}


def window_bounds(mode: str, pre: float = 0, post: float = 0, shift: float = 0) -> tuple[Column, Column]:
    """Columns of a window's begin and end over a table with ``onset`` and ``offset``."""
    values = {"pre": pre, "post": post, "shift": shift}

    def column(text: str) -> Column:
        for k, v in values.items():
            text = text.replace(f" {k}", f" ({v})")
        return F.expr(text)

    start, end = MODES[mode]
    return column(start), column(end)


def clip_windows(words: DataFrame, limit: float, least: float) -> DataFrame:
    """Windows ``start``/``end`` kept inside ``[0, limit]`` and at least ``least`` long; every row stays."""
    start = F.least(F.greatest("start", F.lit(0)), F.lit(limit) - least)
    return words.withColumn("start", F.greatest(start, F.lit(0))).withColumn("end", F.greatest(F.least("end", F.lit(limit)), F.col("start") + least))


def _fixed(s: dict) -> tuple[Column, Column]:
    return F.col("onset") + 80 - s["pre"], F.col("onset") + 80 + s["post"]


def _padded(s: dict) -> tuple[Column, Column]:
    return F.col("onset") - s["pre"], F.col("offset") + s["post"]


def _shifted(s: dict) -> tuple[Column, Column]:
    return F.col("onset") + s["shift"], F.col("offset") + s["shift"]


def _bounds(s: dict) -> tuple[Column, Column]:
    return F.col(s["start"]) + s["start_shift"], F.col(s["end"]) + s["end_shift"]


def _from_reference(s: dict) -> tuple[Column, Column]:
    return F.col(s["ref"]) + s["shift"], F.col(s["ref"]) + s["shift"] + s["length"]


#: Names of modes whose windows differ between the target speaker and others, and their numbers (ms).
SPEAKER_MODES = {
    "fixed": (_fixed, _fixed),
    "regression": (lambda s: (F.col("onset"), F.col("offset") + 500), lambda s: (F.col("onset"), F.col("offset") + 500)),
    "target_vs_other": (lambda s: (F.col("onset") - 500, F.col("onset")), lambda s: (F.col("onset"), F.col("offset") + 500)),
    "onset_offset_plus_prepost": (_padded, _padded),
    "onset_offset_append_window": (_padded, _padded),
    # the target's own window lies before the word by the shift, that of others after it
    "duration_shifted_window": (lambda s: _shifted({"shift": -s["shift"]}), _shifted),
    "target_vs_other_custom_bounds": (_bounds, _bounds),
    "target_vs_other_fixed_window_from_ref": (_from_reference, _from_reference),
}


def speaker_windows(words: DataFrame, mode: str, own: Column, target: dict, other: dict) -> DataFrame:
    """Adds ``start`` and ``end`` by speaker; ``target`` and ``other`` hold what the mode needs of
    ``pre``, ``post``, ``shift``, ``start``, ``start_shift``, ``end``, ``end_shift``, ``ref``, ``length``.

    Shifted windows that are empty go; a word of unknown speaker counts as another's.
    """
    of_target, of_other = SPEAKER_MODES[mode]
    mine, theirs = of_target(target), of_other(other)
    both = [F.when(own, a).otherwise(b) for a, b in zip(mine, theirs, strict=True)]
    out = words.select("*", both[0].alias("start"), both[1].alias("end"))
    return out.filter("start < end") if mode == "duration_shifted_window" else out
