"""N-gram Jaccard join: rare-first prefix filtering, with length, positional and suffix filters.

Each text is the set of its distinct word shingles (64-bit hashes, cut to 58 bits).
Shingles have one global order: by the class of their document frequency, rare
ones first, then by hash.  Frequencies come from a sketch of fixed size that
counts every shingle of every document; any such order keeps the filters exact, so its
errors cost candidates and never links.

Two sets over the threshold share a shingle within their first
``n - ceil(t n) + 1``; only those are shuffled.  Equal sets are one node from the start.
Nodes that share a prefix shingle are first tried against the least of them; what that links
is one component and needs no further pairs, so a group of copies costs as many
pairs as it has members.  Where a shingle still has many components, its nodes are tried against another one,
chosen by hash, a few times over.  Only nodes of a shingle that are still in different components are
then paired, once each.  Pairs pass the length and positional filters where they are made,
the suffix filter (their counts in hash partitions bound the overlap) before sets are fetched, and are
verified once on whole sets.  Sets travel as the top 32 bits of each shingle, from which the overlap is known but for
rare collisions; pairs so near the threshold that these could matter are decided on all bits.

Defined results: texts with fewer words than a shingle are one shingle, the
whole sequence; null texts and texts without words have empty sets and no
links; equal texts are linked; a null ``doc_id`` takes part and sorts as the greatest; repeated rows
keep their own rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, small_batches, tidy, written
from .graph import components
from .text import shingle_hashes, word_hashes

BITS = 58
#: Bytes in an Arrow batch.
BATCH_BYTES = 16 << 20


@dataclass(frozen=True)
class Join:
    """Links need ``100 * |A and B| >= percent * |A or B|``.

    ``cells``: size of the frequency sketch; ``parts``: partitions of the suffix filter;
    ``broadcast_rows``: keys up to which a join is broadcast, beyond it is shuffled; ``crowd`` and ``rounds``: components at a
    shingle beyond which its nodes are tried against one of them first, and how often (all pairs left are tried after that).
    """

    k: int = 5
    percent: int = 80
    cells: int = 1 << 20
    parts: int = 16
    broadcast_rows: int = 250_000
    crowd: int = 16
    rounds: int = 3


def shingles(text: str, k: int) -> np.ndarray:
    """Distinct shingles of one text, sorted."""
    words = word_hashes(text.encode("utf-8", "surrogatepass").lower().split())
    n = len(words)
    if not n:
        return words
    if n < k:
        # salted by its length, so that it never equals a full shingle
        return shingle_hashes(words, n)[:1] * np.uint64(2 * n + 1) >> np.uint64(64 - BITS)
    return np.unique(shingle_hashes(words, k) >> np.uint64(64 - BITS))


def node_of(tokens: np.ndarray) -> int:
    """64-bit fingerprint of a set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _summaries(cfg: Join):
    """Pass one: ``(doc_id, n, node)`` of each document, then this task's counts of sketch cells."""
    names, kinds = ["doc_id", "n", "node", "part", "counts"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    shift, pieces = np.uint64(BITS - (cfg.cells.bit_length() - 1)), 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_ = np.zeros(cfg.cells, np.uint32), False
        for batch in batches:
            rows, found = [], []
            for text in batch.column(1).to_pylist():
                tokens = shingles(text or "", cfg.k)
                rows.append((len(tokens), node_of(tokens)))
                found.append(tokens)
            if rows:
                any_ = True
                counts += np.bincount((np.concatenate(found) >> shift).astype(np.int64), minlength=cfg.cells).astype(np.uint32)
            n, node = zip(*rows, strict=True) if rows else ((), ())
            none = [None] * len(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip((n, node, none, none), kinds[1:], strict=True))], names=names)
        if any_:
            for i, c in enumerate(np.split(counts, pieces)):
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, None, None, i, c.tobytes()), kinds, strict=True)], names=names)

    return run


def _added(key, pdf):
    import pandas as pd

    total = sum(np.frombuffer(c, np.uint32).astype(np.uint64) for c in pdf["counts"])
    return pd.DataFrame({"part": [key[0]], "counts": [total.tobytes()]})


def _frequency_classes(summaries: DataFrame, cfg: Join) -> np.ndarray:
    """One byte per cell: the binary order of its count.  ``cells`` numbers reach the driver, whatever the input."""
    parts = summaries.filter("part is not null").select("part", "counts")
    # each task's counts of one part are combined within a bounded number of rows first
    salted = parts.withColumn("salt", F.spark_partition_id() % 64)
    half = salted.groupBy("part", "salt").applyInPandas(lambda key, pdf: _added(key, pdf), "part int, counts binary")
    rows = half.groupBy("part").applyInPandas(lambda key, pdf: _total(key, pdf), "part int, counts binary").collect()
    out = np.zeros(cfg.cells, np.uint64)
    for r in rows:
        c = np.frombuffer(r["counts"], np.uint64)
        out[r["part"] * len(c) : (r["part"] + 1) * len(c)] = c
    return np.ceil(np.log2(out.astype(np.float64) + 1)).astype(np.uint8)


def _total(key, pdf):
    import pandas as pd

    return pd.DataFrame({"part": [key[0]], "counts": [sum(np.frombuffer(c, np.uint64) for c in pdf["counts"]).tobytes()]})


def ordered(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Tokens in the global order, rare first."""
    shift = np.uint64(BITS - (len(classes).bit_length() - 1))
    keys = np.sort((classes[(tokens >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(BITS)) | tokens)
    return keys & np.uint64((1 << BITS) - 1)


def _prefixes(cfg: Join, shared):
    """Pass two: the prefix shingles of each distinct set of a task, ``(token, node, n, pos)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = shared.value, set()
        for batch in batches:
            tokens, nodes, sizes, places = [], [], [], []
            for text in batch.column(0).to_pylist():
                own = shingles(text or "", cfg.k)
                if not len(own) or (node := node_of(own)) in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(node)
                p = prefix_length(len(own), cfg.percent)
                tokens.append(ordered(own, classes)[:p])
                nodes.append(np.full(p, node, np.int64))
                sizes.append(np.full(p, len(own), np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in ([t.astype(np.int64) for t in tokens], nodes, sizes, places)], names=["token", "node", "n", "pos"]
                )

    return run


def _sets(cfg: Join, whole: bool):
    """``(node, parts, tokens)``: counts by hash partition, and the sorted shingles with all bits (``whole``) or the top 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                own = [shingles(t or "", cfg.k) for t in batch.column(0).slice(i, 128).to_pylist()]
                parts = [np.bincount((o % np.uint64(cfg.parts)).astype(np.int64), minlength=cfg.parts).tolist() for o in own]
                tokens = [o.tobytes() if whole else (o >> np.uint64(BITS - 32)).astype(np.uint32).tobytes() for o in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(o) for o in own], pa.int64()), pa.array(parts, pa.list_(pa.int32())), pa.array(tokens, pa.binary())], names=["node", "parts", "tokens"]
                )

    return run


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted arrays, equal ones counted as often as both have them."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    if (a[1:] != a[:-1]).all() and (b[1:] != b[:-1]).all():
        return int((both[1:] == both[:-1]).sum())
    values, times = np.unique(a, return_counts=True)
    others, more = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    return int(np.minimum(times[i], more[j]).sum())


def decided(both: int, na: int, nb: int, percent: int, whole: bool) -> int:
    """1 for a link, -1 for none, 0 where collisions of 32-bit shingles could change it.

    Collisions only add to ``both``, about ``na * nb / 2^32`` on average; many more than that do not happen.
    """
    links = lambda x: 100 * x >= percent * (na + nb - x)
    if not links(both):
        return -1
    extra = 0 if whole else 3 + int(40 * (na * nb) ** 0.5 / 65536)
    return 1 if links(both - extra) else 0


def _verified(percent: int, whole: bool):
    """``(a, b, tokens of a, tokens of b)`` to ``(a, b, sure)`` for pairs that link, or may."""
    kind = np.uint64 if whole else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    a, b = np.frombuffer(x, kind), np.frombuffer(y, kind)
                    found.append(decided(overlap(a, b), len(a), len(b), percent, whole))
            verdict = np.array(found, np.int8)
            kept = pa.array(verdict >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array(verdict[verdict >= 0] == 1)], names=["a", "b", "sure"])

    return run


def _may_link(percent: int, a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Length filter, and the positional one, for two sets ``(n, pos, after)`` at a shingle that may be the first they share.

    From there on a set has ``n - pos`` shingles.  In prefixes only ``after`` more are shared with anyone, and all
    else that is shared lies in the suffix of the set whose prefix ends first.  Sets over the
    threshold pass at the first shingle they share, so dropping them at others loses nothing.
    """
    (na, oa, fa), (nb, ob, fb) = a, b
    length = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    suffix = F.ceil(F.greatest(na, nb) * percent / 100) - 1
    most = F.least(1 + F.least(fa, fb) + suffix, na - oa, nb - ob)
    return length & ((100 + percent) * most.cast("long") >= percent * (na + nb))


def _placed(postings: DataFrame) -> DataFrame:
    """Postings of shared shingles once per set, with how many its prefix has (``shared``) and how many of these come ``after``."""
    own = Window.partitionBy("node")
    shared = F.count(F.lit(1)).over(own).cast("int")
    once = postings.repartition("node").distinct()
    return once.select("token", "node", "n", "pos", shared.alias("shared"), (shared - F.row_number().over(own.orderBy("pos", "token"))).alias("after"))


def _checked(table: DataFrame, cfg: Join) -> DataFrame:
    """A written table of a few numbers a row, broadcast when it has at most ``broadcast_rows`` rows, else left to a shuffle."""
    return F.broadcast(table) if table.count() <= cfg.broadcast_rows else table


def _close(pairs: DataFrame, sets: DataFrame, cfg: Join) -> DataFrame:
    """The suffix filter: distinct ``pairs(a, b)`` whose partition counts allow a link."""
    left = sets.select(F.col("node").alias("a"), F.col("parts").alias("pa"))
    right = sets.select(F.col("node").alias("b"), F.col("parts").alias("pb"))
    most = "aggregate(zip_with(pa, pb, (x, y) -> least(x, y)), 0L, (s, x) -> s + x)"
    size = "aggregate(pa, 0L, (s, x) -> s + x) + aggregate(pb, 0L, (s, x) -> s + x)"
    close = left.join(_checked(pairs, cfg), "a").join(right, "b").filter(F.expr(f"{100 + cfg.percent} * {most} >= {cfg.percent} * ({size})"))
    return written(close.select("a", "b"), "close")


def _compared(pairs: DataFrame, sets: DataFrame, cfg: Join, whole: bool) -> DataFrame:
    """``(a, b, sure)`` of the ``pairs(a, b)`` that link: the set of ``a`` travels to ``b``, once for each pair, and only sets that a pair needs do."""
    few = _checked(pairs, cfg)
    ta = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")).join(few, "a")
    tb = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")).join(few.select("b").distinct(), "b", "left_semi")
    return written(ta.join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(_verified(cfg.percent, whole), "a long, b long, sure boolean"), "verified")


def similarity_classes(docs: DataFrame, cfg: Join = Join()) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_shingles, component_id)``, a row per row."""
    spark = docs.sparkSession
    tidy(spark)
    small_batches(spark)
    # sets of long texts are large: batches end at this many bytes too
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    summaries = written(docs.mapInArrow(_summaries(cfg), "doc_id long, n long, node long, part int, counts binary"), "summaries")
    rows = summaries.filter("part is null").select("doc_id", "n", "node")
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    classes = spark.sparkContext.broadcast(_frequency_classes(summaries, cfg))  # cfg.cells bytes

    postings = docs.select("text").mapInArrow(_prefixes(cfg, classes), "token long, node long, n int, pos int")
    # counts alone are shuffled; a shingle of copies in several tasks passes too and meets no other set later
    common = postings.groupBy("token").count().filter("count > 1").select("token")
    groups = written(_placed(postings.join(common, "token")), "groups")

    def fetched(pairs: DataFrame, whole: bool) -> DataFrame:
        """The sets of the nodes in ``pairs``, once each."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        chosen = written(wanted.join(nodes, "node").select(F.col("least").alias("doc_id")).distinct(), "chosen")
        few = chosen.count() <= cfg.broadcast_rows
        same = docs["doc_id"].eqNullSafe(chosen["doc_id"])
        texts = docs.join(F.broadcast(chosen) if few else chosen, same, "left_semi").select("text")
        sets = written(texts.mapInArrow(_sets(cfg, whole), "node long, parts array<int>, tokens binary"), "sets")
        release(chosen)
        # only where ids repeat can a node come twice
        twice = sets.groupBy("node").count().filter("count > 1")
        return sets if twice.isEmpty() else written(sets.dropDuplicates(["node"]), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the distinct ``pairs(a, b)`` that link."""
        sets = fetched(pairs, False)
        close = _close(pairs, sets, cfg)
        found = _compared(close, sets, cfg, False)
        release(sets, close)
        out, open_ = found.filter("sure").select("a", "b"), found.filter("not sure").select("a", "b")
        if open_.isEmpty():
            return out
        sets = fetched(open_, True)
        more = _compared(open_, sets, cfg, True)
        release(sets)
        return out.unionByName(more.select("a", "b"))

    heads = groups.groupBy("token").agg(F.max(F.struct("shared", "node", "n")).alias("h"))
    tried = groups.join(heads, "token").filter(F.col("node") != F.col("h.node"))
    tried = tried.filter(100 * F.least("n", "h.n") >= cfg.percent * F.greatest("n", "h.n"))
    # heads are the greater by a fixed order, so a pair comes in one direction only
    first = written(tried.select(F.col("node").alias("a"), F.col("h.node").alias("b")).distinct(), "pairs")
    links = linked(first)
    roots = written(components(links), "roots")

    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def divided(named: DataFrame, least: int) -> DataFrame:
        """The rows at shingles with at least ``least`` components (``parts``)."""
        named = written(named, "rooted")
        apart = written(named.select("token", "root").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("parts")).filter(F.col("parts") >= least), "apart")
        out = written(named.join(_checked(apart, cfg), "token"), "divided")
        release(named, apart)
        return out

    def moved(old: DataFrame, new: DataFrame) -> DataFrame:
        """``(node, to)`` of the roots in ``old``, single nodes included, that are none in ``new``; components only grow, so these are few."""
        gone = new.filter("node <> root").select("node", F.col("root").alias("to"))
        return written(gone.join(old.filter("node <> root").select("node"), "node", "left_anti"), "moved")

    def renamed(own: DataFrame, to: DataFrame) -> DataFrame:
        there = _checked(to.withColumnRenamed("node", "_was"), cfg)
        return own.join(there, F.col("root") == F.col("_was"), "left").withColumn("root", F.coalesce("to", "root")).drop("_was", "to")

    named = groups.select("token", "node", "n", "pos", "after").join(_checked(roots, cfg), "node", "left").withColumn("root", F.coalesce("root", "node"))
    own, first_roots, spent = divided(named, 2), roots, [groups]
    crowded = own.filter(F.col("parts") > cfg.crowd)
    for attempt in range(cfg.rounds):
        some = crowded.groupBy("token").agg(F.max(F.struct(F.xxhash64("token", "node", F.lit(attempt)).alias("order"), "node", "n", "pos", "after", "root")).alias("h"))
        met = crowded.join(some, "token").filter(F.col("root") != F.col("h.root"))
        met = met.filter(_may_link(cfg.percent, tuple(map(F.col, ("n", "pos", "after"))), tuple(map(F.col, ("h.n", "h.pos", "h.after")))))
        more = met.select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct()
        more = written(more.join(tested, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            break
        tested, links = tested.unionByName(more), links.unionByName(linked(more))
        before, roots = roots, written(components(links), "roots")
        tidy(spark)
        if attempt + 1 < cfg.rounds:
            # a shingle that is not crowded will not be again
            crowded = divided(renamed(crowded.drop("parts"), moved(before, roots)), cfg.crowd + 1)
            spent.append(crowded)
    if roots is not first_roots:
        spent.append(own)
        own = written(renamed(own, moved(first_roots, roots)), "own")

    tidy(spark)
    # by component first: the most that any of its sets could share from this shingle on
    sides = own.groupBy("token", "root").agg(F.min("n").alias("short"), F.max("n").alias("long"), F.max("after").alias("after"), F.max(F.col("n") - F.col("pos")).alias("left"), F.count(F.lit(1)).alias("nodes"))
    other = sides.select("token", *(F.col(c).alias(c + "2") for c in ("root", "short", "long", "after", "left", "nodes")))
    fit = (F.col("root") < F.col("root2")) & (100 * F.col("long") >= cfg.percent * F.col("short2")) & (100 * F.col("long2") >= cfg.percent * F.col("short"))
    most = F.least(F.least("after", "after2") + F.ceil(F.greatest("long", "long2") * cfg.percent / 100), "left", "left2")
    fit &= (100 + cfg.percent) * most.cast("long") >= cfg.percent * (F.col("short") + F.col("short2"))
    # the component with fewer sets at the shingle first, so that a large one is only met where the pair itself is tested
    small = F.col("nodes") <= F.col("nodes2")
    facing = sides.join(other, "token").filter(fit).select("token", F.when(small, F.col("root")).otherwise(F.col("root2")).alias("root"), F.when(small, F.col("root2")).otherwise(F.col("root")).alias("root2"))
    facing_ = written(facing, "facing")
    facing = _checked(facing_, cfg)
    a = own.select("token", "root", F.col("node").alias("na"), F.col("n").alias("sa"), F.col("pos").alias("oa"), F.col("after").alias("fa"))
    b = own.select("token", F.col("root").alias("root2"), F.col("node").alias("nb"), F.col("n").alias("sb"), F.col("pos").alias("ob"), F.col("after").alias("fb"))
    cross = a.join(facing, ["token", "root"]).join(b, ["token", "root2"]).filter(_may_link(cfg.percent, tuple(map(F.col, ("sa", "oa", "fa"))), tuple(map(F.col, ("sb", "ob", "fb")))))
    second = cross.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()
    second = written(second.join(tested, ["a", "b"], "left_anti"), "pairs")
    release(own, facing_, *spent)
    links = links.unionByName(linked(second))
    tidy(spark)
    roots = components(links)

    named = roots.join(nodes, "node")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_link = named.select("node", "root").join(ids, "root").select("node", "component_id")
    every = nodes.join(of_link, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    out = rows.join(every, "node", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
