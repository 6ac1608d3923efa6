"""Merkle manifest, exact dedup and fill-in-the-middle."""

import random
import zlib

import brute
import pytest
from compare import connection, differences
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from lumengrid.llm import exact, infilling, merkle, queries
from pyspark.sql import functions as F

LONG = "\n".join(f"line {i} of a very long text" for i in range(40_000))
EDGE = [
    (1, None), (2, ""), (3, "A b"), (4, "a B"), (4, "a b"), (4, "a b"), (None, "a b"), (None, "null ids alone"), (None, "null ids alone"), (5, "É é"), (6, "é É"), (-7, "\n\n"),
    (8, LONG), (9, LONG.upper()), (10, LONG + " tail"), (11, "x\x01y\x02c\x02e\x01\nz\x02\x01"), (12, "one <P> two\nthree"), (13, "no newline"), (14, "a\r\nb\rc\n"), (15, "😀é\n😀\n" * 5), (16, "<"), (17, "<\n<S\nP>\n"),
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in EDGE], "doc_id long, text string, owner string, kept string, size int, n int, row int").repartition(3)


@pytest.mark.parametrize("cfg", [exact.Copies(), exact.Copies(keep="smallest"), exact.Copies(hash_bits=0, trie_bytes=1), exact.Copies(hash_bits=2, trie_bytes=4000, broadcast_rows=0), exact.Copies(keep="smallest", trie_bytes=1, broadcast_rows=0)])
def test_exact_copies_equal_brute_force(spark, edge, cfg):
    got = exact.decisions(edge, cfg).select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")), "kept").collect()
    assert sorted((tuple(r[:4]) for r in got), key=repr) == sorted(brute.copies(EDGE, cfg.keep == "largest"), key=repr)
    assert all(r[0] == r[1] for r in got if r.kept)
    digests = [r[3] for r in got]
    assert sorted(r[3] for r in got if r.kept) == sorted(set(digests))  # one of each text


def test_exact_dedup_keeps_columns_and_one_of_each_text(spark, edge):
    out = exact.without_copies(edge)
    assert out.columns == edge.columns
    assert sorted((r.text or "").encode().lower() for r in out.collect()) == sorted({(t or "").encode().lower() for _, t in EDGE})


def test_crowded_text_leaves_each_task_once(spark):
    docs = spark.range(0, 30_000, 1, 12).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "The Same").otherwise(F.concat(F.lit("own "), F.col("id"))).alias("text"))
    found = {r.size: (r.owner, r.copies) for r in exact.owners(docs).filter("copies > 1").collect()}
    assert found == {8: (29_997, 10_000)}
    plan = exact.owners(docs)._jdf.queryExecution().toString()
    assert plan.count("Exchange hashpartitioning(size") > 0


keys = st.lists(st.tuples(st.binary(max_size=12), st.one_of(st.none(), st.integers(-5, 5))), max_size=60)


@given(keys, st.booleans(), st.integers(0, 2000))
@settings(max_examples=200, deadline=None)
def test_trie_spills_lose_nothing(found, largest, limit):
    trie, sent = exact.Patricia("largest" if largest else "smallest"), []
    for k, i in found:
        trie.add(k, (i, 1, 1))
        if trie.weight > limit:
            sent += trie.spill_largest()
    sent += trie.take(trie.root, b"")
    whole = exact.Patricia("largest" if largest else "smallest")
    for k, o in sorted(sent, key=lambda x: x[0]):
        whole.add(k, o)
    got = dict(whole.take(whole.root, b""))
    want = {}
    for k in {k for k, _ in found}:
        ids = [i for x, i in found if x == k]
        keep = max((i for i in ids if i is not None), default=None) if largest else (None if None in ids else min(ids))
        want[k] = (keep, ids.count(keep), len(ids))
    assert got == want


@given(st.lists(st.binary(min_size=3, max_size=9), max_size=60), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_trie_hands_sorted_subtrees_on_once(found, head):
    trie, sent = exact.Patricia("largest"), []
    for k in sorted(found):
        sent += trie.spill_before(k[:head])
        trie.add(k, (1, 1, 1))
        assert all(x[:head] == k[:head] for x, _ in trie.take(trie.root, b""))
    sent += trie.take(trie.root, b"")
    assert [k for k, _ in sent] == sorted(set(found))
    assert sum(o[2] for _, o in sent) == len(found)


def _leaves(spark, n, groups):
    rng = random.Random(n)
    data = [(rng.choice(groups), None if rng.random() < 0.1 else rng.randrange(n), brute.digest(str(rng.randrange(n)))) for _ in range(n)]
    return data, spark.createDataFrame([(*r, "x") for r in data], "group string, order long, leaf string, root string").repartition(5)


@pytest.mark.parametrize("n,groups,fanout,size", [(900, ["hot"] * 9 + ["b", None, "é", ""], 3, 40), (700, [str(i) for i in range(300)], 4, 50), (300, ["one"], 2, 20), (500, ["a", "b"], 16, 10_000), (1, ["a"], 16, 10), (700, ["hot"] * 5 + [f"g{i}" for i in range(9)], 16, 30)])
def test_proofs_equal_plain_trees(spark, n, groups, fanout, size):
    data, df = _leaves(spark, n, groups)
    got = [(r.group, r.leaf, tuple((tuple(x.nodes), x.at) for x in r.path), r.subroot, r.root) for r in merkle.proofs(df, merkle.Tree(fanout, size)).collect()]
    assert sorted(got, key=repr) == sorted(brute.merkle(data, fanout), key=repr)
    assert all(merkle.fold(leaf, path) == root for _, leaf, path, _, root in got)


def test_merkle_of_rows_that_are_all_equal(spark):
    df = spark.range(2000).select(F.lit("g").alias("group"), F.lit(None).cast("long").alias("order"), F.lit("d").alias("leaf"))
    got = merkle.proofs(df, merkle.Tree(4, 100)).collect()
    want = brute.merkle([("g", None, "d")] * 2000, 4)
    assert sorted((tuple((tuple(x.nodes), x.at) for x in r.path), r.root) for r in got) == sorted((p, r) for _, _, p, _, r in want)


def test_merkle_sees_any_change(spark, tmp_path):
    docs = [(i, None if i % 7 == 0 else f"s{i % 3}", "en", i, None if i % 5 == 0 else f"Text {i}") for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out if not r.verified} == {i for i, *_, t in docs if t and zlib.crc32(str(i).encode()) % 5 == 0}
    assert differences(spark, connection(str(tmp_path)), "op11", queries.op11_merkle_manifest, queries.oracle_sql()["op11_merkle_manifest"], str(tmp_path)) == ""


def test_infilling_equals_plain_version(spark, edge):
    out = infilling.rearrange(edge).withColumn("again", infilling.restored(F.col("output"), F.col("form")))
    got = [(r.doc_id, r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(i, *brute.infilling(i, t)) for i, t in EDGE], key=repr)
    assert out.filter("again <> coalesce(text, '')").isEmpty()
    assert {c: t for c, t in out.dtypes if c in ("owner", "row")} == {"owner": "string", "row": "int"}


def test_infilling_rates_and_marks(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\nd").alias("text"))
    cfg = infilling.Infilling(rate=40, suffix_first=25, prefix_mark="[pre]", suffix_mark="[suf]", middle_mark="[mid]")
    out = infilling.rearrange(docs, cfg).withColumn("again", infilling.restored(F.col("output"), F.col("form"), cfg))
    forms = {r.form: r["count"] for r in out.groupBy("form").count().collect()}
    assert abs(forms["plain"] - 1200) < 120 and abs(forms["spm"] - 200) < 60
    assert out.filter("again <> text").isEmpty()
    with pytest.raises(ValueError):
        infilling.Infilling(prefix_mark="ab", suffix_mark="ba")


@pytest.mark.parametrize("run", [queries.op11_merkle_manifest, queries.op12_exact_dedup, queries.op13_fill_in_middle])
def test_no_rows(spark, tmp_path, run):
    spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_exact_dedup", "op13_fill_in_middle"])
def test_queries_equal_sql(spark, name):
    assert differences(spark, connection(SF), name, queries.queries()[name], queries.oracle_sql()[name], SF) == ""
