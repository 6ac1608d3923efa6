"""Packing token pieces into sequences, shortest pack first, over the length histogram.

Documents are tokenized and cut into pieces of at most ``limit`` tokens.  The histogram of
piece lengths has at most ``limit`` rows whatever the input, so patterns are laid
on the driver: lengths are placed longest first, each into the packs that are
shortest so far, with counts per pattern instead of single packs.  Pieces get
their sequence by joining their rank among pieces of equal length to the patterns.

Defined results: a null or empty text is its end token alone; repeated rows are
separate pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Entries that a worker's table of encoded words may hold before it starts anew.
MEMO = 400_000
_SIMPLE = re.compile(rb"[!-&(-;=-~]+")
_PARTS = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")


class WordEncoder:
    """Token ids of whole texts, word by word, as little-endian 32-bit bytes.

    Right for tokenizers that drop white space and never join across it.  Plain
    ASCII words without quotes are split into letters, digits and the rest,
    which are encoded once each; all other words, and texts with a special
    token's string, go through the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def direct(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: bytes) -> bytes:
        if len(self.words) > MEMO:
            self.words.clear()
        if _SIMPLE.fullmatch(word):
            out = b"".join(map(self.part, _PARTS.findall(word.decode().lower())))
        else:
            out = self.direct(word.decode())
        self.words[word] = out
        return out

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) > MEMO:
                self.parts.clear()
            found = self.parts[part] = self.packed([t.id for t in self.tokenizer.model.tokenize(part)])
        return found

    def text(self, text: str) -> bytes:
        if "<|" in text:
            return self.direct(text)
        words = self.words
        return b"".join([words[w] if w in words else self.word(w) for w in text.encode("utf-8", "surrogatepass").split()])


_ENCODERS: dict[str, WordEncoder] = {}


def pieces(docs: DataFrame, tokenizer: str, limit: int = 2048, end: int = 1, cut: int | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, start, length, doc_tokens, ids)``; ``ids`` are little-endian 32-bit.

    Full pieces have ``limit`` tokens; the rest of a document is cut at multiples of ``cut``.
    """
    small_batches(docs.sparkSession)
    tail = np.frombuffer(np.uint32(end).tobytes(), np.uint8).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, WordEncoder(tokenizer))
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encoder.text(text or "") + tail
                    n, at = len(ids) // 4, 0
                    while at < n:
                        size = min(limit if n - at >= limit else cut or limit, n - at)
                        rows.append((doc, at, size, n, ids[4 * at : 4 * (at + size)]))
                        at += size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                ) if rows else pa.RecordBatch.from_pylist([], pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


def lay_patterns(histogram: dict[int, int], limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns ``(count, lengths)`` that use up the histogram, each within ``limit``."""
    open_: dict[int, list[list]] = defaultdict(list)  # by tokens left
    rest = sum(n * k for n, k in histogram.items())  # tokens not yet placed
    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            left = max((k for k, v in open_.items() if v and k >= length), default=None)
            if left is None:
                # no more new packs than all that is left would fill
                used = min(todo, -(-rest // limit))
                open_[limit - length].append([used, (length,)])
                todo, rest = todo - used, rest - used * length
                continue
            count, lengths = open_[left].pop()
            used = min(count, todo)
            if count > used:
                open_[left].append([count - used, lengths])
            open_[left - length].append([used, (*lengths, length)])
            todo, rest = todo - used, rest - used * length
    return [(c, p) for group in open_.values() for c, p in group]


def pack(pieces: DataFrame, limit: int = 2048, bucket_rows: int = 20_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces(doc_id, start, length, ...)``; give it a written table."""
    spark = pieces.sparkSession
    found = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # one row per length: at most `limit`
    patterns = lay_patterns(found, limit)
    slots, ranks, first = [], dict.fromkeys(found, 0), 0
    for count, lengths in sorted(patterns, key=lambda p: p[1], reverse=True):
        at = 0
        for length, times in Counter(lengths).items():  # equal ones lie side by side
            slots.append((length, ranks[length], ranks[length] + count * times, count, first, at))
            ranks[length] += count * times
            at += length * times
        first += count
    table = spark.createDataFrame(slots, "length long, low long, high long, packs long, first long, at long")
    buckets = max(1, sum(found.values()) // bucket_rows)
    own = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = own.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start")
    ranked = own.withColumn("_rank", F.row_number().over(inside)).join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_from") - 1)
    # a row for each length of each pattern, however often the pattern has it: the place follows from the rank
    out = ranked.join(F.broadcast(table), "length").filter("_rank >= low and _rank < high").withColumn("_rank", F.col("_rank") - F.col("low"))
    out = out.withColumn("sequence_id", F.col("first") + F.col("_rank") % F.col("packs")).withColumn("offset", F.col("at") + F.expr("_rank div packs") * F.col("length"))
    return out.drop("_bucket", "_rank", "_from", "low", "high", "packs", "first", "at")
