"""Exact dedup: Patricia tries own the distinct texts, terminal nodes know which copy stays.

A text's key is its length, a hash of its content and its full bytes.  Each task first puts its own
documents into a trie, so that a text with very many copies leaves it once, with the owner among them and their number.
Partitions by length and hash then bring equal texts together; the rows of each come sorted by
length and hash, and are put into one trie again.  Texts are told apart by all their bytes,
so a collision of hashes costs a deeper branch and nothing else.

Memory is bounded by spilling subtrees.  Before the shuffle the largest branch of a full trie is sent on as it is:
it holds partial owners, which merge behind the shuffle.  There, branches of lengths and hashes before
the present row's are finished as the rows are sorted, and a full trie hands these on.  So a task
holds ``trie_bytes`` and the texts that share one length and one hash.

What comes back to the documents is one row for each text with two copies at least, joined by length and digest.
It is broadcast up to ``broadcast_rows`` and shuffled beyond that, where Spark splits a crowded key.

Defined results: null texts count as empty; a null ``doc_id`` is smaller than any other; rows with equal ``doc_id`` and
text are copies as others are, and one of them stays; an empty table gives no rows;
:func:`owners` and :func:`decisions` ignore other columns and :func:`without_copies` keeps them all, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: What a node takes besides its bytes.
NODE_BYTES = 400
_FOUND = "size long, hash long, text binary, owner long, owners long, copies long"


@dataclass(frozen=True)
class Copies:
    """``keep``: the ``largest`` or ``smallest`` id stays.  ``hash_bits``: bits of the content hash that are used (64, or fewer in tests).
    ``trie_bytes``: size at which a task's trie spills subtrees.  ``broadcast_rows``: repeated texts up to which their owners are broadcast."""

    keep: str = "largest"
    hash_bits: int = 64
    trie_bytes: int = 64 << 20
    broadcast_rows: int = 200_000


def normalised(text: str | None) -> bytes:
    """The bytes that are compared: A-Z lower-cased, all others as they are."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


class Node:
    """``label``: bytes from the parent; ``owner``: ``(id, rows with it, copies)`` where a text ends."""

    __slots__ = ("label", "children", "owner", "weight")

    def __init__(self, label: bytes, owner: tuple | None = None) -> None:
        self.label, self.owner = label, owner
        self.children: dict[int, Node] = {}
        self.weight = len(label) + NODE_BYTES


class Patricia:
    """A compressed radix trie from byte strings to owners; ``weight`` of a node is the size of its subtree."""

    def __init__(self, keep: str) -> None:
        self.root = Node(b"")
        self.largest = keep == "largest"

    def merged(self, a: tuple, b: tuple) -> tuple:
        if a[0] == b[0]:
            return a[0], a[1] + b[1], a[2] + b[2]
        if a[0] is None or b[0] is None:
            first = (b[0] is None) == self.largest
        else:
            first = (a[0] > b[0]) == self.largest
        id_, rows, _ = a if first else b
        return id_, rows, a[2] + b[2]

    def add(self, key: bytes, owner: tuple) -> None:
        node, at, path = self.root, 0, []
        while True:
            path.append(node)
            if at == len(key):
                node.owner = owner if node.owner is None else self.merged(node.owner, owner)
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = new = Node(key[at:], owner)
                return self._grow(path, new.weight)
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, key, at)
            upper = Node(label[:same])
            upper.weight = child.weight + NODE_BYTES
            child.label = label[same:]
            child.weight -= same
            node.children[key[at]] = upper
            upper.children[child.label[0]] = child
            self._grow(path, NODE_BYTES)
            node, at = upper, at + same

    @staticmethod
    def _grow(path: list[Node], by: int) -> None:
        for n in path:
            n.weight += by

    @property
    def weight(self) -> int:
        return self.root.weight

    def take(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, tuple]]:
        """Texts and owners of a subtree, in byte order."""
        todo = [(node, prefix)]
        while todo:
            n, before = todo.pop()
            here = before + n.label
            if n.owner is not None:
                yield here, n.owner
            todo += [(n.children[b], here) for b in sorted(n.children, reverse=True)]

    def _cut(self, path: list[Node], child: Node) -> None:
        del path[-1].children[child.label[0]]
        self._grow(path, -child.weight)

    def spill_largest(self) -> Iterator[tuple[bytes, tuple]]:
        """Cuts the heaviest branch off, below the first node that branches at all."""
        path, prefix = [self.root], b""
        while True:
            child = max(path[-1].children.values(), key=lambda n: n.weight, default=None)
            if child is None:
                return
            if len(path[-1].children) > 1 or child.owner is not None or not child.children:
                break
            prefix += child.label
            path.append(child)
        self._cut(path, child)
        yield from self.take(child, prefix)

    def spill_before(self, key: bytes) -> Iterator[tuple[bytes, tuple]]:
        """Cuts all branches off whose texts come before ``key`` in byte order and do not begin with it."""
        path, prefix = [self.root], b""
        while True:
            here = path[-1]
            at = len(prefix)
            if at >= len(key):
                return
            for b in sorted(x for x in here.children if x < key[at]):
                child = here.children[b]
                self._cut(path, child)
                yield from self.take(child, prefix)
            child = here.children.get(key[at])
            if child is None:
                return
            whole = prefix + child.label
            if not (whole.startswith(key) or key.startswith(whole)):
                if whole < key:
                    self._cut(path, child)
                    yield from self.take(child, prefix)
                return
            path.append(child)
            prefix = whole


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common beginning of ``label`` and ``key[at:]``, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def _head(size: int, hash_: int) -> bytes:
    return size.to_bytes(8, "big") + (hash_ + (1 << 63)).to_bytes(8, "big")


def _batches(found: Iterator[tuple[bytes, tuple]], rows: int = 256, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    part, held = [], 0
    for key, owner in found:
        part.append((key, owner))
        held += len(key)
        if len(part) >= rows or held >= limit:
            yield _batch(part)
            part, held = [], 0
    if part:
        yield _batch(part)


def _batch(part: list) -> pa.RecordBatch:
    long = pa.int64()
    return pa.RecordBatch.from_arrays([
        pa.array([int.from_bytes(k[:8], "big") for k, _ in part], long), pa.array([int.from_bytes(k[8:16], "big") - (1 << 63) for k, _ in part], long), pa.array([k[16:] for k, _ in part], pa.binary()),
        *(pa.array([o[i] for _, o in part], long) for i in range(3)),
    ], names=["size", "hash", "text", "owner", "owners", "copies"])


def _hash(text: bytes, bits: int) -> int:
    return (xxhash.xxh3_64_intdigest(text) >> (64 - bits)) - (1 << 63) if bits else 0


def owners(docs: DataFrame, cfg: Copies = Copies()) -> DataFrame:
    """One row per distinct text: ``(size, digest, owner, owners, copies)``: bytes, sha256, the id that stays, rows with it, and all rows."""
    small_batches(docs.sparkSession)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia(cfg.keep)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                key = normalised(text.as_py())
                trie.add(_head(len(key), _hash(key, cfg.hash_bits)) + key, (doc, 1, 1))
                if trie.weight > cfg.trie_bytes:
                    yield from _batches(trie.spill_largest())
        yield from _batches(trie.take(trie.root, b""))

    def finished(found: Iterator[tuple[bytes, tuple]]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(found):
            digests = pa.array([hashlib.sha256(t.as_py()).digest() for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, *batch.columns[3:]], names=["size", "digest", "owner", "owners", "copies"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia(cfg.keep)
        for batch in batches:
            sizes, hashes, ids, rows, copies = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            for i, text in enumerate(batch.column(2)):
                head = _head(sizes[i], hashes[i])
                if trie.weight > cfg.trie_bytes:
                    yield from finished(trie.spill_before(head))
                trie.add(head + text.as_py(), (ids[i], rows[i], copies[i]))
        yield from finished(trie.take(trie.root, b""))

    partial = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(local, _FOUND)
    together = partial.repartition("size", "hash").sortWithinPartitions("size", "hash")
    return together.mapInArrow(whole, "size long, digest binary, owner long, owners long, copies long")


def _keyed(docs: DataFrame, row: str | None) -> DataFrame:
    """``(doc_id, row, size, digest)`` of each document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalised(t.as_py()) for t in batch.column(2)]
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()), digests], names=["doc_id", "row", "size", "digest"])

    key = F.col(row) if row else F.monotonically_increasing_id()
    return docs.select(F.col("doc_id").cast("long"), key.alias("row"), "text").mapInArrow(run, "doc_id long, row long, size long, digest binary")


def decisions(docs: DataFrame, cfg: Copies = Copies(), row: str | None = None) -> DataFrame:
    """One row per document: ``(doc_id, row, keep_id, group_size, kept, digest)``; ``row`` is the column of that name, or a number of its own."""
    repeated = written(owners(docs, cfg).filter("copies > 1"), "owners")
    keyed = written(_keyed(docs, row), "keyed")
    few = repeated.count() <= cfg.broadcast_rows
    found = keyed.join(F.broadcast(repeated) if few else repeated, ["size", "digest"], "left")
    own = found.select(
        "doc_id", "row", "size", "digest", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("owner")).alias("keep_id"), F.coalesce("copies", F.lit(1)).alias("group_size"),
        F.coalesce("owners", F.lit(1)).alias("_owners"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if not repeated.filter("owners > 1").isEmpty():
        # rows that share the id that stays: the first of them does; minima combine before the shuffle
        tied = own.filter("kept and _owners > 1").groupBy("size", "digest").agg(F.min("row").alias("_first"))
        tied = written(tied, "tied")
        few = tied.count() <= cfg.broadcast_rows
        own = own.join(F.broadcast(tied) if few else tied, ["size", "digest"], "left").withColumn("kept", F.col("kept") & (F.col("_first").isNull() | (F.col("row") == F.col("_first"))))
    return own.select("doc_id", "row", "keep_id", "group_size", "kept", "digest")


def without_copies(docs: DataFrame, cfg: Copies = Copies()) -> DataFrame:
    """The documents that stay, with all their columns."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    gone = written(decisions(keyed, cfg, row).filter(~F.col("kept")).select(F.col("row").alias(row)), "copies")
    few = gone.count() <= cfg.broadcast_rows
    return keyed.join(F.broadcast(gone) if few else gone, row, "left_anti").drop(row)
