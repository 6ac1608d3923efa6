"""Quality rules by cross-document line frequency.

Lines are normalised and hashed; a line held by many documents of one host is
boilerplate and is removed; a document of which too little is left is rejected.

Defined results: a null text has no words; a null host is a host of its own;
documents without words keep nothing and have all counts 0; repeated rows each
get their own result; columns beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .text import word_hashes

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineLimits:
    """A line goes when more than ``min_documents`` and more than ``share`` of its host's documents hold it,
    and in any case when more than ``any_host`` documents of its host do.

    Up to ``broadcast_lines`` such lines are sent to all workers; beyond that they are joined.
    A document is depleted when over ``depleted`` of its words stand on such lines.
    """

    min_documents: int = 20
    share: float = 0.05
    depleted: float = 0.5
    any_host: int = 1000
    broadcast_lines: int = 100_000


def line_hash(parts: list[bytes]) -> int:
    """The hash of a normalised line, given its words."""
    return xxhash.xxh3_64_intdigest(b" ".join(parts).lower()) - (1 << 63)


def without_lines(text: str, gone: Collection[int]) -> str:
    """The text without the lines whose hashes are in ``gone``; blank lines stay."""
    kept = [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if not (parts := x.split()) or line_hash(parts) not in gone]
    return b"\n".join(kept).decode("utf-8", "surrogatepass")


def measure(text: str) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """Counts of one text, and the hash and words of each of its distinct normalised lines."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    white = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    hashes, sizes, seen, repeated = [], [], {}, 0
    exact = set()
    for line in data.split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        if line in exact:
            repeated += 1
        exact.add(line)
        h = line_hash(parts)
        if h in seen:
            sizes[seen[h]] += len(parts)
        else:
            seen[h] = len(hashes)
            hashes.append(h)
            sizes.append(len(parts))
    covered = 0
    if n >= 4:
        w = word_hashes(words)
        m = np.uint64(0x9E3779B97F4A7C15)
        three = (w[:-2] * m + w[1:-1]) * m + w[2:]
        _, which, times = np.unique(three, return_inverse=True, return_counts=True)
        many = np.flatnonzero(times[which] > 1)
        mark = np.zeros(n, bool)
        for k in range(3):
            mark[many + k] = True
        covered = int(mark.sum())
    return n, len(text) - white, symbols, repeated, covered, hashes, sizes


_MEASURED = pa.schema([
    ("doc_id", pa.int64()), ("host", pa.string()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("line_hash", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int32())), ("text", pa.string()),
])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t or "") for t in batch.column(2).to_pylist()]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip(columns, list(_MEASURED)[2:-1], strict=True)), batch.column(2)], schema=_MEASURED
        )


def _cleaned(sent):
    """Texts without frequent lines, and the words taken; ``sent`` has the lines by host, or is None where rows have theirs in ``gone``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = batch.column("line_hash").to_pylist(), batch.column("line_words").to_pylist()
            if sent is None:
                own = [set(g or ()) for g in batch.column("gone").to_pylist()]
            else:
                own = [sent.value.get(h, ()) for h in batch.column("host").to_pylist()]
            texts, removed = [], []
            for k, (hs, ws, frequent) in enumerate(zip(hashes, sizes, own, strict=True)):
                gone = {h: w for h, w in zip(hs, ws, strict=True) if h in frequent}
                removed.append(sum(gone.values()))
                text = batch.column("text")[k].as_py()
                texts.append(without_lines(text, gone) if gone else text)
            same = [batch.column(n) for n in COUNTED]
            yield pa.RecordBatch.from_arrays([*same, pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=[*COUNTED, "removed_words", "text"])

    return run


COUNTED = ("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def failed_base() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """``docs(doc_id, host, text)`` to one row per document: its counts, ``removed_words``, the ``text`` without frequent lines, and ``kept``."""
    small_batches(docs.sparkSession)
    counted = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    schema = f"{counted}, line_hash array<long>, line_words array<int>, text string"
    base = docs.select(F.col("doc_id").cast("long"), "host", "text").mapInArrow(_measured, schema)
    base = written(base.withColumn("row", F.monotonically_increasing_id()), "quality")
    lines = base.select("row", "host", F.explode("line_hash").alias("line_hash"))
    per_host = base.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counts = lines.groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("holders")).filter(F.col("holders") > min(limits.min_documents, limits.any_host))
    same = counts["host"].eqNullSafe(per_host["host"])
    above = (F.col("holders") > limits.min_documents) & (F.col("holders") > limits.share * F.col("host_docs")) | (F.col("holders") > limits.any_host)
    # written, so that its true size decides between a broadcast and a sorted join
    frequent = written(counts.join(per_host, same).filter(above).select(counts["host"], "line_hash"), "lines")
    if frequent.count() <= limits.broadcast_lines:
        by_host: dict[str | None, set[int]] = {}
        for host, h in frequent.collect():
            by_host.setdefault(host, set()).add(h)
        clean, given = _cleaned(docs.sparkSession.sparkContext.broadcast(by_host)), base.drop("row")
    else:
        f = frequent.withColumnsRenamed({"host": "f_host", "line_hash": "f_hash"})
        gone = lines.join(f, (F.col("line_hash") == F.col("f_hash")) & F.col("host").eqNullSafe(F.col("f_host"))).groupBy("row").agg(F.collect_list("line_hash").alias("gone"))
        clean, given = _cleaned(None), base.join(gone, "row", "left").drop("row")
    out = given.mapInArrow(clean, f"{counted}, removed_words long, text string")
    return out.withColumn("base_failed", failed_base()).withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= limits.depleted * F.col("n_words")))
