"""Substring dedup: windows of words that a smaller document holds too are removed.

Reference passages are those that very many documents share.  They are bounded in number,
go into suffix automata of bounded shards, and are broadcast; documents stream through them for matching
statistics, and what matches a passage of a smaller document for a whole window is
removed there and then, so such passages never meet in a shuffle.

The corpus itself has no size bound and cannot be broadcast.  Windows outside the
reference take an exact way: each window is represented by its least five-word anchor;
anchors of several documents are found by combining minima; windows of such
anchors meet by anchor, where the smallest document of each window is known.

Defined results: null texts have no words; a text shorter than a window loses
nothing; a window repeated inside its own document only is kept; rows with
equal ``doc_id`` are judged against smaller ids alone; a null ``doc_id`` is
greater than any other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .text import shingle_hashes, word_hashes

LAST = (1 << 63) - 1
#: Windows that one anchor can represent, at most.
BITS = 32


@dataclass(frozen=True)
class Windows:
    """``window`` words are compared; an anchor has ``anchor`` words.

    ``hot``: documents from which on a passage belongs to the reference, ``hot_anchors``: its bound (most shared first),
    ``shard``: words in an automaton; ``broadcast_anchors`` and ``broadcast_numbers``: sizes up to which shared anchors and
    removed spans are broadcast, beyond which they are joined.
    """

    window: int = 13
    anchor: int = 5
    hot: int = 64
    hot_anchors: int = 2048
    shard: int = 50_000
    broadcast_anchors: int = 4_000_000
    broadcast_numbers: int = 4_000_000


@dataclass
class Automaton:
    """Suffix automaton over sequences of word hashes; every state knows the smallest document it occurs in."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    least: list[int] = field(default_factory=lambda: [LAST])

    def _state(self, length: int, least: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The part of state ``q`` that ends one step after ``p``, as a state of its own."""
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(self.length[p] + 1, LAST, dict(self.next[q]), self.link[q])
        self.link[q] = own
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = own
            p = self.link[p]
        return own

    def add(self, words: list[int], doc: int) -> None:
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:
                last = self._split(last, w, q)
            else:
                new, p = self._state(self.length[last] + 1, LAST, {}, 0), last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                self.link[new] = 0 if p < 0 else self._split(p, w, self.next[p][w])
                last = new
            self.least[last] = min(self.least[last], doc)

    def settle(self) -> Automaton:
        """Pass the smallest documents on to all suffixes."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            self.least[up] = min(self.least[up], self.least[s])
        return self

    def holders(self, words: list[int], window: int) -> list[int]:
        """For each window start, the smallest document of the automaton that holds the window; ``LAST`` where none does."""
        moves, link, length, least = self.next, self.link, self.length, self.least
        out = [LAST] * max(0, len(words) - window + 1)
        s = n = 0
        for i, w in enumerate(words):
            while s and w not in moves[s]:
                s = link[s]
                n = length[s]
            if w in moves[s]:
                s = moves[s][w]
                n += 1
            else:
                n = 0
            if n >= window:
                while length[link[s]] >= window:
                    s = link[s]
                    n = min(n, length[s])
                out[i - window + 1] = least[s]
        return out


def _words(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "surrogatepass").split())


def _anchors(words: np.ndarray, cfg: Windows) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the hash and the place of its anchor (the least one, the first of equals)."""
    grams = shingle_hashes(words, cfg.anchor)
    n, span = len(words) - cfg.window + 1, cfg.window - cfg.anchor + 1
    if n <= 0:
        return grams[:0], np.zeros(0, np.int64)
    value, place = grams[:n].copy(), np.arange(n)
    for j in range(1, span):
        lower = grams[j : j + n] < value
        value[lower] = grams[j : j + n][lower]
        place[lower] = np.flatnonzero(lower) + j
    return value, place


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _postings(cfg: Windows):
    """``(anchor, doc_id)``, once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value, place = _anchors(_words(text), cfg)
                if len(value):
                    own = np.unique(_signed(value[np.r_[True, np.diff(place) != 0]]))
                    anchors.append(own)
                    docs.append(np.full(len(own), LAST if doc is None else doc))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors)), pa.array(np.concatenate(docs))], names=["anchor", "doc_id"])

    return run


def _passages(cfg: Windows):
    """Words of the windows at the given anchors of a document, ``(doc_id, text, anchors)`` to ``(doc_id, words)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, out = [], []
            for doc, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = _words(text)
                value, _ = _anchors(words, cfg)
                starts = np.flatnonzero(np.isin(_signed(value), np.asarray(wanted, np.int64)))
                for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                    if len(part):
                        docs.append(doc)
                        out.append(_signed(words[part[0] : part[-1] + cfg.window]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "words"])

    return run


def reference(docs: DataFrame, shared: DataFrame, cfg: Windows) -> list[Automaton]:
    """Automata of the passages with the most shared anchors, as their first documents have them."""
    hot = shared.filter(F.col("docs") >= cfg.hot).orderBy(F.desc("docs"), "anchor").limit(cfg.hot_anchors)
    first = written(hot.groupBy(F.col("low").alias("doc_id")).agg(F.collect_list("anchor").alias("anchors")), "hot")
    texts = docs.join(F.broadcast(first), "doc_id").select("doc_id", "text", "anchors")  # at most hot_anchors rows
    rows = texts.mapInArrow(_passages(cfg), "doc_id long, words array<long>").distinct()
    # a passage has at most the windows of its anchors: a few dozen words for each of hot_anchors
    shards, size = [Automaton()], 0
    for doc, words in sorted((r["doc_id"], tuple(r["words"])) for r in rows.collect()):
        if size + len(words) > cfg.shard and size:
            shards, size = [*shards, Automaton()], 0
        shards[-1].add(list(words), doc)
        size += len(words)
    return [a.settle() for a in shards]


def _candidates(cfg: Windows, automata, known):
    """``(doc_id, text[, anchors])`` to the windows of shared anchors, a row for each occurrence of one.

    ``(anchor, doc_id, start, done, open, hashes)``: bits count windows from ``start``; ``done`` ones have a smaller
    document in the reference, the hashes of the ``open`` ones follow in order.
    """
    names = ["anchor", "doc_id", "start", "done", "open", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [a for a in automata.value if len(a.link) > 1]
        listed = known.value if known is not None else None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            out: list[tuple] = []
            for row in zip(*columns, strict=True):
                doc, words = LAST if row[0] is None else row[0], _words(row[1])
                value, place = _anchors(words, cfg)
                if not len(value):
                    continue
                cut = np.flatnonzero(np.r_[True, np.diff(place) != 0])
                size = np.diff(np.r_[cut, len(value)])
                own = _signed(value[cut])
                if listed is None:
                    shared = np.isin(own, np.asarray(row[2] or [], np.int64))
                else:
                    shared = listed[np.minimum(np.searchsorted(listed, own), len(listed) - 1)] == own if len(listed) else np.zeros(len(own), bool)
                if not shared.any():
                    continue
                inside = np.repeat(shared, size)
                gone = np.zeros(len(value), bool)
                edges = np.flatnonzero(np.diff(np.r_[0, inside.view(np.int8), 0]))
                for a, b in edges.reshape(-1, 2) if shards else ():
                    ints = _signed(words[a : b + cfg.window - 1]).tolist()
                    for s in shards:
                        gone[a:b] |= np.asarray(s.holders(ints, cfg.window)) < doc
                cut, size, own = cut[shared], size[shared], own[shared]
                first = np.cumsum(size) - size
                bit = np.int64(1) << (np.arange(size.sum()) - np.repeat(first, size))
                gone = gone[inside]
                full = shingle_hashes(words, cfg.window)[inside][~gone]
                left = np.add.reduceat(~gone, first, dtype=np.int64)
                out.append((own, np.full(len(own), doc), cut, np.add.reduceat(bit * gone, first), np.add.reduceat(bit * ~gone, first), left, full))
            if out:
                own, docs, cut, done, open_, left, full = map(np.concatenate, zip(*out, strict=True))
                ends = np.r_[0, np.cumsum(left * 8)].astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(left), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(full))])
                yield pa.RecordBatch.from_arrays([*map(pa.array, (own, docs, cut.astype(np.int32), done, open_)), blobs], names=names)

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and document to ``(doc_id, start, done)``: windows whose hash a smaller document had."""
    import pandas as pd

    def solved(rows: pd.DataFrame) -> pa.RecordBatch:
        count = rows["hashes"].str.len().to_numpy() // 8
        flat = np.frombuffer(b"".join(rows["hashes"]), np.uint64) if len(rows) else np.zeros(0, np.uint64)
        group = np.cumsum(np.r_[0, np.diff(rows["anchor"].to_numpy()) != 0]) if len(rows) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), count)
        docs = rows["doc_id"].to_numpy()[owner]
        order = np.lexsort((docs, flat, group[owner]))
        f, g, d = flat[order], group[owner][order], docs[order]
        new = np.r_[True, (f[1:] != f[:-1]) | (g[1:] != g[:-1])] if len(f) else np.zeros(0, bool)
        least = d[np.maximum.accumulate(np.where(new, np.arange(len(f)), 0))] if len(f) else d
        lost = np.zeros(len(flat), bool)
        lost[order] = least < d
        # back to bits of the row: the open ones, in order
        at = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
        bits = ((rows["open"].to_numpy()[:, None] >> np.arange(BITS)) & 1).astype(bool)
        table = np.zeros((len(rows), BITS), bool)
        table[owner[lost], at[lost]] = True
        hit = bits & np.take_along_axis(table, np.maximum(np.cumsum(bits, 1) - 1, 0), 1)
        mask = (hit * (np.int64(1) << np.arange(BITS))).sum(1)
        keep = mask > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["doc_id"].to_numpy()[keep]), pa.array(rows["start"].to_numpy()[keep].astype(np.int32)), pa.array(mask[keep])], names=["doc_id", "start", "done"]
        )

    rest = None
    for batch in batches:
        rows = batch.to_pandas()
        if rest is not None:
            rows = pd.concat([rest, rows], ignore_index=True)
        if len(rows):
            whole = rows["anchor"].to_numpy() != rows["anchor"].iloc[-1]
            yield solved(rows[whole])
            rest = rows[~whole].reset_index(drop=True)
    if rest is not None and len(rest):
        yield solved(rest)


def _merged(window: int):
    """``(doc_id, lost)``, window starts as ``start * 2^32 + bits``, to ``(doc_id, spans)``: begin, end, begin, end, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lost in batch.column(1):
                packed = lost.values.to_numpy()
                starts = ((packed >> 32)[:, None] + np.arange(BITS))[((packed[:, None] >> np.arange(BITS)) & 1).astype(bool)]
                starts = np.unique(starts)
                gap = np.flatnonzero(np.diff(starts) > window)
                out.append(np.stack([starts[np.r_[0, gap + 1]], starts[np.r_[gap, -1]] + window], 1).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["_k", "spans"])

    return run


def removed_spans(docs: DataFrame, cfg: Windows = Windows()) -> DataFrame:
    """``docs(doc_id, text)`` to ``(_k, spans)``: removed words by begin and end, for documents that have any; ``_k`` is the id, null as ``LAST``."""
    if cfg.window - cfg.anchor >= BITS:
        raise ValueError("an anchor must represent at most 32 windows")
    spark = docs.sparkSession
    small_batches(spark)
    pairs = docs.mapInArrow(_postings(cfg), "anchor long, doc_id long")
    shared = pairs.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("docs"))
    shared = written(shared.filter("low < high").drop("high"), "shared")
    automata = spark.sparkContext.broadcast(reference(docs, shared, cfg))
    if shared.count() <= cfg.broadcast_anchors:
        anchors = np.sort(shared.select("anchor").toArrow()["anchor"].to_numpy())
        known, with_anchors = spark.sparkContext.broadcast(anchors), docs
    else:
        known = None
        own = docs.mapInArrow(_postings(cfg), "anchor long, doc_id long").join(shared.select("anchor"), "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
        with_anchors = docs.withColumn("_k", F.coalesce("doc_id", F.lit(LAST))).join(own.withColumnRenamed("doc_id", "_k"), "_k").select("doc_id", "text", "anchors")
    found = with_anchors.mapInArrow(_candidates(cfg, automata, known), "anchor long, doc_id long, start int, done long, open long, hashes binary")
    found = written(found, "windows")
    # the reference has taken the hot anchors' windows out, all but those of their first documents
    open_ = found.filter("open <> 0").select("anchor", "doc_id", "start", "hashes", "open").repartition("anchor").sortWithinPartitions("anchor", "doc_id")
    late = open_.mapInArrow(_resolve, "doc_id long, start int, done long")
    every = found.filter("done <> 0").select("doc_id", "start", "done").unionByName(late)
    lost = every.groupBy("doc_id").agg(F.collect_list(F.shiftleft(F.col("start").cast("long"), 32) + F.col("done")).alias("lost"))
    return lost.mapInArrow(_merged(cfg.window), "_k long, spans array<int>")


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            part, out = batch.slice(i, 128), []
            for doc, text, spans in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                for a, b in list(zip(spans[::2], spans[1::2], strict=True))[::-1] if spans else ():
                    del words[a:b]
                kept = b" ".join(words)
                out.append((doc, n, n - len(words), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 5, kinds, strict=True)], names=names)


def dedup_substrings(docs: DataFrame, cfg: Windows = Windows()) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_words, n_removed, kept, kept_sha256)``, a row per row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = written(removed_spans(docs, cfg), "removed")
    if spans.agg(F.coalesce(F.sum(F.size("spans") + 4), F.lit(0))).first()[0] <= cfg.broadcast_numbers:
        spans = F.broadcast(spans)
    out = docs.withColumn("_k", F.coalesce("doc_id", F.lit(LAST))).join(spans, "_k", "left")
    return out.select("doc_id", "text", "spans").mapInArrow(_rebuilt, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
