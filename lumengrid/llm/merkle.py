"""Merkle manifest of a dataset: a digest tree per group, one over the groups, and a proof for every row.

Rows are range-sorted by group and order into an RDD.  Counts of the first and last group of each partition (one small
entry a partition) give every group's offset and total in it; groups in between lie in one partition.
Each partition then builds every complete aligned run of ``fanout`` nodes by itself, level by level.  What is ragged,
nodes whose run begins or ends in another partition, is shuffled by its coordinate (group, level, run), where at most ``fanout`` nodes meet,
and finished level by level.  The digests of groups are the leaves of the upper tree, which is built in the same way.
For the proofs each partition is sent the runs that it lacks, which are two at most for each level of a
group; the ranges and these runs share a partitioner, so that rows are not shuffled again.

A partition holds its own digests (about ``partition_rows`` rows), a run ``fanout`` of them; the driver sees one entry for each partition.

Defined results: rows of equal group and order are ordered by their leaf, so that equal rows are leaves of their own; null groups
and null orders come first; a lone leaf is its group's digest, a lone group's digest the root, and their proofs are empty; an empty table has no rows and no root; columns that
are not named are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

from pyspark import RDD, Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import small_batches, written

#: Marks the key of what is sent to a partition by its number.
PART = "part"
#: The group of the tree over all groups.
TOP = b"\x02"


@dataclass(frozen=True)
class Tree:
    fanout: int = 16
    partition_rows: int = 100_000


def digest(*inputs: str) -> str:
    """Lowercase hex sha256 of the inputs, one after the other."""
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field as its length in bytes, ``:`` and value, or ``-`` if null."""
    part = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*part), 256)


def group_key(group: str | None) -> bytes:
    """Sorts as the group does: null first, then by bytes."""
    return b"" if group is None else b"\x01" + group.encode("utf-8", "surrogatepass")


class Segment:
    """What one partition has of a group: leaves ``offset``, ``offset + 1``, ... of ``total``, and all nodes that follow from them alone."""

    def __init__(self, leaves: list[str], offset: int, total: int, fanout: int) -> None:
        self.fanout = fanout
        self.levels = [(offset, total, leaves)]  # first node here, nodes of the level, own nodes
        while total > 1:
            first, end = -(-offset // fanout), offset + len(leaves)
            last = -(-end // fanout) if end == total else end // fanout  # runs first .. last - 1 lie here whole
            leaves = [digest(*leaves[max(k * fanout - offset, 0) : (k + 1) * fanout - offset]) for k in range(first, last)]
            offset, total = first, -(-total // fanout)
            self.levels.append((offset, total, leaves))

    def whole(self, level: int, run: int) -> list[str] | None:
        """The nodes of a run, if all of it lies here."""
        offset, total, nodes = self.levels[level]
        low, high = run * self.fanout, min((run + 1) * self.fanout, total)
        return nodes[low - offset : high - offset] if low >= offset and high <= offset + len(nodes) else None

    def ragged(self) -> Iterator[tuple[int, int, str]]:
        """``(level, place, digest)`` of the nodes whose run is not whole here."""
        for level, (offset, total, nodes) in enumerate(self.levels):
            if total > 1:
                for i, d in enumerate(nodes, offset):
                    if self.whole(level, i // self.fanout) is None:
                        yield level, i, d

    @property
    def top(self) -> str | None:
        """The group's digest, if it follows from the leaves here."""
        _, _, nodes = self.levels[-1]
        return nodes[0] if nodes else None


@dataclass
class Ranges:
    """Rows ``((group, *order), value)`` sorted in an RDD; ``at`` (broadcast, one entry a partition): a partition's first group, its rows before, and totals of the groups at its ends."""

    rows: RDD
    partitions: int
    place: Callable[[tuple], int]
    at: Broadcast
    spanning: int
    """Rows of the largest group that lies in several partitions."""


def ranged(rows: RDD, partitions: int) -> Ranges:
    n = rows.count()
    sample = sorted(rows.keys().sample(False, min(1.0, 20.0 * partitions / max(n, 1)), 1).collect()) if partitions > 1 else []  # 20 keys a partition
    bounds = [sample[len(sample) * i // partitions] for i in range(1, partitions)] if sample else []

    def place(key: tuple) -> int:
        return key[1] if key[0] == PART else bisect_right(bounds, key)

    rows = rows.repartitionAndSortWithinPartitions(partitions, place)
    ends = sorted(rows.mapPartitionsWithIndex(_ends).collect())  # one entry a partition
    totals, parts = defaultdict(int), defaultdict(int)
    for _, counts in ends:
        for group, n in counts:
            totals[group] += n
            parts[group] += 1
    seen, at = defaultdict(int), {}
    for p, counts in ends:
        first = counts[0][0]  # any other group begins here
        at[p] = (first, seen[first], {g: totals[g] for g, _ in counts})
        for group, n in counts:
            seen[group] += n
    return Ranges(rows, rows.getNumPartitions(), place, rows.context.broadcast(at), max((totals[g] for g, n in parts.items() if n > 1), default=0))


def _ends(p: int, rows: Iterator) -> Iterator[tuple[int, list]]:
    """The first and the last group of a partition, with their rows."""
    counts: list = []
    for key, _ in rows:
        if counts and counts[-1][0] == key[0]:
            counts[-1][1] += 1
        else:
            del counts[1:]
            counts.append([key[0], 1])
    if counts:
        yield p, counts


def _segments(p: int, rows: Iterator, at: Broadcast, fanout: int) -> Iterator[tuple[bytes, list, Segment]]:
    """The groups of a partition: key, rows, nodes."""
    first, before, totals = at.value.get(p, (None, 0, {}))
    for group, own in groupby(rows, key=lambda r: r[0][0]):
        own = list(own)
        yield group, own, Segment([v[0] for _, v in own], before if group == first else 0, totals.get(group, len(own)), fanout)


def forest(ranges: Ranges, fanout: int, spans: Callable[[int, tuple], tuple[int, int]], all_runs: bool = False) -> tuple[RDD, RDD]:
    """Runs that partitions lack, ``((group, level, run), (digests, low, high))``, and groups, ``(group, (digest, low, high))``.

    ``low`` and ``high`` are the first and last part that stand below: ``spans(p, value)`` are those of a row in partition ``p``.
    With ``all_runs`` the runs that lie whole in a partition come as well.
    """
    at = ranges.at

    def build(p: int, rows: Iterator) -> Iterator[tuple]:
        for group, own, s in _segments(p, rows, at, fanout):
            reach = [spans(p, v) for _, v in own]
            start = s.levels[0][0]

            def below(level: int, i: int, reach=reach, start=start) -> tuple[int, int]:
                return reach[i * fanout**level - start][0], reach[min((i + 1) * fanout**level - start, len(reach)) - 1][1]

            if s.top is not None:
                yield "top", (group, (s.top, reach[0][0], reach[-1][1]))
            for level, i, d in s.ragged():
                yield level, ((group, level, i // fanout), (i % fanout, d, *below(level, i), s.levels[level][1]))
            for level, (_, total, _) in enumerate(s.levels if all_runs else ()):
                for run in range(-(-total // fanout) if total > 1 else 0):
                    nodes = s.whole(level, run)
                    if nodes is not None:
                        yield "run", ((group, level, run), (nodes, *below(level + 1, run)))

    def meet(nodes: Iterator) -> tuple:
        nodes = sorted(nodes)
        return [d for _, d, *_ in nodes], min(x[2] for x in nodes), max(x[3] for x in nodes), nodes[0][4]

    def parent(x: tuple) -> tuple:
        (group, level, run), (nodes, low, high, total) = x
        return (group, level + 1, run // fanout), (run % fanout, digest(*nodes), low, high, -(-total // fanout))

    built = ranges.rows.mapPartitionsWithIndex(build).persist(StorageLevel.MEMORY_AND_DISK)  # ragged nodes and groups, few for each partition
    runs, tops = [built.filter(lambda x: x[0] == "run").values()], [built.filter(lambda x: x[0] == "top").values()]
    few, total, level, parents = max(1, ranges.partitions // 16), ranges.spanning, 0, None
    while total > 1:
        nodes = built.filter(lambda x, level=level: x[0] == level).values()
        done = (nodes if parents is None else nodes.union(parents)).groupByKey(few).mapValues(meet)  # `fanout` nodes at most
        runs.append(done.mapValues(lambda v: v[:3]))
        up = done.map(parent)
        tops.append(up.filter(lambda x: x[1][4] == 1).map(lambda x: (x[0][0], x[1][1:4])))
        parents = up.filter(lambda x: x[1][4] > 1)
        total, level = -(-total // fanout), level + 1
    context = ranges.rows.context
    return context.union(runs), context.union(tops)


def fold(leaf: str, path: list[tuple[list[str], int]]) -> str:
    """The root that follows from a leaf and its runs ``(nodes, place of the own one)``, in which its own node is not read."""
    for nodes, at in path:
        leaf = digest(*nodes[:at], leaf, *nodes[at + 1 :])
    return leaf


def siblings(path: list[tuple[list[str], int]]) -> Iterator[str]:
    """A proof as it is handed on: the other nodes of each run, level by level, left to right."""
    for nodes, at in path:
        yield from nodes[:at]
        yield from nodes[at + 1 :]


PROOF = "group string, leaf string, path array<struct<nodes: array<string>, at: int>>, subroot string, root string"


def whole_proof(row: Row, path: list, subroot: str, root: str) -> tuple:
    return row["group"], row["leaf"], path, subroot, root


def proofs(leaves: DataFrame, tree: Tree = Tree(), each: Callable[[Row, list, str, str], tuple] = whole_proof, schema: str = PROOF) -> DataFrame:
    """``leaves(group, order, leaf, ...)`` to one row each: what ``each`` makes of the row, its path, its group's digest and the root.

    ``each`` runs in the task that has the path, so that a proof need not leave it.
    """
    spark, fanout = leaves.sparkSession, tree.fanout
    small_batches(spark)
    leaves = written(leaves.withColumn("_tie", F.monotonically_increasing_id()), "leaves")
    names = [c for c in leaves.columns if c != "_tie"]

    def keyed(r: Row) -> tuple:
        order = () if r["order"] is None else (r["order"],)
        return (group_key(r["group"]), order, r["leaf"], r["_tie"]), (r["leaf"], *(r[c] for c in names))

    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // tree.partition_rows))
    rows = ranged(leaves.rdd.map(keyed), partitions)
    runs, groups = forest(rows, fanout, lambda p, _: (p, p))
    upper = ranged(groups.map(lambda g: ((TOP, g[0]), g[1])), -(-groups.count() // tree.partition_rows) or 1)
    upper_runs, top = forest(upper, fanout, lambda _, v: v[1:], all_runs=True)
    root = next((v[0] for _, v in top.collect()), None)  # one row, or none

    def placed(p: int, groups: Iterator) -> Iterator[tuple]:
        for _, own, s in _segments(p, groups, upper_at, fanout):
            offset, total, _ = s.levels[0]
            for i, ((_, group), (subroot, low, high)) in enumerate(own, offset):
                yield group, ((subroot, i, total), low, high)

    upper_at, place = upper.at, rows.place
    sent = runs.union(upper_runs).union(upper.rows.mapPartitionsWithIndex(placed))
    sent = sent.flatMap(lambda x: (((PART, p), (x[0], x[1][0])) for p in range(x[1][1], x[1][2] + 1)))
    # the same partitioner as the rows: a union of both keeps partitions as they are
    sent = sent.partitionBy(rows.partitions, place).mapPartitions(lambda x: x, True)
    both = sent.union(rows.rows)
    if both.getNumPartitions() != rows.partitions:
        raise RuntimeError("rows and what is sent to them are not partitioned alike")
    at, make = rows.at, Row(*names)

    def climb(p: int, items: Iterator) -> Iterator[tuple]:
        lacking, items = {}, iter(items)
        own = next(items, None)
        while own is not None and own[0][0] == PART:
            lacking[own[1][0]] = own[1][1]
            own = next(items, None)
        for group, rows, s in _segments(p, chain(() if own is None else [own], items), at, fanout):
            subroot, place, groups = lacking[group]
            above = []
            for level in range(_depth(groups, fanout)):
                above.append((lacking[TOP, level, place // fanout], place % fanout))
                place //= fanout
            start, total, _ = s.levels[0]
            depth = _depth(total, fanout)
            for i, (_, value) in enumerate(rows, start):
                path = []
                for level in range(depth):
                    path.append((s.whole(level, i // fanout) or lacking[group, level, i // fanout], i % fanout))
                    i //= fanout
                yield each(make(*value[1:]), path + above, subroot, root)

    return spark.createDataFrame(both.mapPartitionsWithIndex(climb), schema, verifySchema=False)


def _depth(nodes: int, fanout: int) -> int:
    depth = 0
    while nodes > 1:
        nodes, depth = -(-nodes // fanout), depth + 1
    return depth
