import hashlib
import zlib

import brute
import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from lumengrid.llm import chat, graph, jaccard, lines, mixture, ogg, packing, quality, queries, substrings, toxicity, urls
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One TWO"), (6, PASSAGE), (7, "before " + PASSAGE + " after it"), (8, PASSAGE), (8, PASSAGE), (None, PASSAGE + " tail"),
    (9, LONG), (10, LONG + " more"), (11, "a b c d e f g h i j k l m n " * 4), (12, PASSAGE + "\n" + PASSAGE), (13, "\n".join([PASSAGE, "x y", "z " * 20])),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, "extra") for r in EDGE], "doc_id long, text string, words string")


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("cfg", [substrings.Windows(), substrings.Windows(hot=2), substrings.Windows(hot=2, shard=30, broadcast_anchors=0, broadcast_numbers=0)])
def test_substrings_equal_brute_force(spark, edge, cfg):
    got = substrings.dedup_substrings(edge, cfg).drop("kept")
    assert rows(got) == sorted(brute.substrings(EDGE), key=repr)


def test_substring_query(spark, documents):
    assert rows(queries.op5_substring_dedup(spark, SF)) == sorted(brute.substrings(documents), key=repr)


def test_automaton_knows_the_smallest_holder():
    rng = np.random.default_rng(3)
    texts = {d: rng.integers(0, 3, 40).tolist() for d in range(6)}
    own = substrings.Automaton()
    for d, t in texts.items():
        own.add(t, d)
    own.settle()
    probe = rng.integers(0, 3, 200).tolist()
    for w in (1, 3, 5):
        want = [min((d for d, t in texts.items() if any(t[i : i + w] == probe[s : s + w] for i in range(len(t) - w + 1))), default=substrings.LAST) for s in range(len(probe) - w + 1)]
        assert own.holders(probe, w) == want


@pytest.mark.parametrize("cfg", [jaccard.Join(k=4, percent=85), jaccard.Join(broadcast_rows=0)])
def test_similarity_classes_equal_brute_force(spark, edge, documents, cfg):
    assert rows(jaccard.similarity_classes(edge, cfg)) == sorted(brute.classes(EDGE, cfg.k, cfg.percent), key=repr)


def test_near_copies_with_chains(spark):
    rng = np.random.default_rng(5)
    base, docs = [f"t{i}" for i in range(120)], []
    for d in range(150):
        own = list(base)
        for i in rng.integers(0, 120, rng.integers(0, 6)):
            own[i] = f"n{rng.integers(0, 9)}"
        docs.append((d, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for cfg in (jaccard.Join(k=4, percent=85), jaccard.Join(crowd=1)):
        assert rows(jaccard.similarity_classes(df, cfg)) == sorted(brute.classes(docs, cfg.k, cfg.percent), key=repr)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 202), (5, 5), (202, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}


@pytest.mark.parametrize("few", [lines.Runs(min_words=5), lines.Runs(min_words=16, broadcast_numbers=0)])
def test_line_dedup_equals_brute_force(spark, documents, few):
    docs = [r for r in EDGE if r[0] is not None and r[0] != 8] + [(i + 100, t) for i, t in documents]
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), few).select("doc_id", "kept")
    assert rows(got) == sorted(brute.line_dedup(docs, few.min_words), key=repr)


def test_line_dedup_finds_runs_of_any_length(spark):
    short = [f"seven words in this line number {n}" for n in range(7)]
    mixed = ["one", "two words", "now three words", "and these are four", "x", "a b c d e f g", "h i"]
    docs = [(1, "\n".join(short)), (2, "\n".join(["own start", *short[:3], "own end"])), (3, "\n".join(mixed)), (4, "\n".join(["other", *mixed[1:6], "", *mixed])), (5, "\n".join(short[1:3]))]
    docs += [(6, "\n".join(["p q r s t u v w", *mixed, *mixed[:4], *mixed]))]
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "kept")
    assert rows(got) == sorted(brute.line_dedup(docs, 16), key=repr)
    kept = dict(got.collect())
    assert kept[2] == "own start\nown end" and kept[5] == docs[4][1]


def test_mixture_targets_and_draws(spark):
    docs = [(i, f"s{i % 4}" if i % 5 else None, "w " * (1 + i % 90)) for i in range(400)] + [(1000, "zero", None), (1001, "zero", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    mix = mixture.Mix(block_words=8, shard_blocks=50, bucket_rows=64)
    slim, plan, draws = mixture.mixed(df, mix)
    out = {r.doc_id: r for r in mixture.taken(slim, plan, draws).collect()}
    size = {}
    for i, s, t in docs:
        size[s] = size.get(s, 0) + len(brute.words(t))
    names = [*sorted(s for s in size if s is not None), None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, float(sum(size.values())), set(names)
    while True:  # limit those above, share the rest anew
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.discard(s)
    took = dict.fromkeys(names, 0)
    for i, s, t in docs:
        assert out[i].source_size == size[s] and abs(out[i].target - target[s]) < 1e-6 * (1 + target[s]) and out[i].taken <= 3 * out[i].size
        took[s] += out[i].taken
    assert all(abs(took[s] - target[s]) <= 0.05 * target[s] + 16 for s in names)
    once = draws.groupBy("row", "block", "epoch").count().filter("count > 1").count()
    shards = {r["shard"]: r["count"] for r in draws.groupBy("shard").count().collect()}
    assert once == 0 and len(shards) > 10 and max(shards.values()) - min(shards.values()) <= 1
    again = {r.doc_id: r.taken for r in mixture.taken(*mixture.mixed(df.repartition(7), mix)).collect()}
    assert again == {i: r.taken for i, r in out.items()}


def test_hypergeometric_draws_follow_the_law(spark):
    draw = mixture.hypergeometric("total", "good", "drawn", "((id + 0.5D) / 2000)")
    df = spark.range(2000).selectExpr("id", "40L as total", "15L as good", "10L as drawn").select(F.expr(draw).alias("x"))
    got = {r.x: r["count"] / 2000 for r in df.groupBy("x").count().collect()}
    from math import comb

    assert all(abs(got.get(x, 0) - comb(15, x) * comb(25, 10 - x) / comb(40, 10)) < 2e-3 for x in range(11))


def test_chat_events_fold_and_round_trip(spark):
    hard = "\\### Assistant: </turn> ok\n<\\/turn> \\\\ # ## </turn></turn>\\"
    log = [
        (1, 1, 1, "delta", "user", "Hel"), (1, 2, 1, "delta", "user", "lo"), (1, 3, 2, "delta", "assistant", "bad"), (1, 4, 3, "delta", "user", "why?"), (1, 5, 2, "regenerate", "assistant", None),
        (1, 6, 2, "delta", "assistant", "go"), (1, 7, 2, "delta", "assistant", "od"), (1, 8, 1, "edit", "user", "Hi"), (1, 9, 1, "delta", "user", "!"), (1, 10, 4, "delta", "user", hard), (2, 1, 1, "delta", None, None), (None, 1, 1, "delta", "a: b", hard),
    ]
    out = {r.conv_id: r for r in chat.format_log(spark.createDataFrame(log, "conv_id long, seq long, message int, kind string, role string, text string")).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("user", "Hi!"), ("assistant", "good"), ("user", hard)]
    assert [(t.role, t.text) for t in out[2].turns] == [("", "")] and [(t.role, t.text) for t in out[None].turns] == [("a: b", hard)]
    said = [out[1].formatted[t.start : t.start + t.length] for t in out[1].turns if t.in_loss]
    assert said == ["good"]


def test_chat_query_equals_sql(spark):
    from compare import connection, differences

    assert differences(spark, connection(SF), "op2", queries.op2_chat_format, queries.oracle_sql()["op2_chat_format"], SF) == ""


def test_packing_whole_ids(spark, edge, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    own = Tokenizer.from_file(path)
    hard = [(900, "Don't STOP it's Ünïcode ΣΑΣ 中文 <|endoftext|> a\x1cb 1234 ''s we'll"), (901, "é  x y ſt İstanbul"), (902, "~!@ #$%^&*()_+ {}|: <>? a_b")]
    docs = [r for r in EDGE if r[0] is not None and r[0] != 8] + hard + [(i + 1000, t) for i, t in documents]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    cut = packing.pieces(df, path, limit=512)
    out = packing.pack(cut.cache(), limit=512, bucket_rows=50).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in docs:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        parts = sorted(by[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in parts) == ids.tobytes() and all(r.length <= 512 and r.doc_tokens == len(ids) for r in parts)
    used = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 512 and sum(used.values()) > 0.97 * 512 * len(used)


def test_quality_counts(spark):
    boiler = "this very line stands in each of the documents of one host"
    docs = [(i, "h", "\n".join([boiler, *(f"own {i} word{k} more{k * i}" for k in range(20))])) for i in range(30)] + [(100 + i, "h", boiler + "\n" + " ".join(f"u{i}v{k}" for k in range(45))) for i in range(2)]
    docs += [(200, None, None), (201, "h", "# a\n# a\na b a b a b " * 12), (202, "h", (boiler + "\n") * 9 + "tiny")]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(docs, "doc_id long, host string, text string")).collect()}
    assert got[1].kept and got[1].removed_words == 12 and got[100].kept
    assert not got[202].kept and got[202].removed_words == 108 and got[202].n_dup_lines == 8
    assert got[201].base_failed and got[201].n_symbols == 24 and (got[200].n_words, got[200].kept) == (0, False)


@pytest.mark.parametrize("sent", [100_000, 0])
def test_quality_takes_frequent_lines_out(spark, sent):
    boiler, rare = "This  very line stands in many documents", "this line stands in few of them"
    docs = [(i, "h" if i % 2 else None, f"own {i}\n\n {boiler.upper() if i % 3 else boiler} \nünd {i} end") for i in range(80)] + [(100 + i, "h", f"{rare}\nx {i}") for i in range(30)]
    docs += [(200 + i, "h", f"y {i}\n") for i in range(700)] + [(1000, "other", boiler), (1001, "h", None), (1, "h", boiler)]
    df = spark.createDataFrame(docs, "doc_id long, host string, text string")
    limits = quality.LineLimits(any_host=35, broadcast_lines=sent)  # boiler is in 41 of h's 772 documents, and in all of the null host's
    got = sorted(((r.doc_id, r.text) for r in quality.quality_rules(df, limits).collect()), key=repr)
    want = [(i, "" if t == boiler and h == "h" else "\n".join(x for x in t.split("\n") if h == "other" or x.split() != boiler.split() and x.split() != boiler.upper().split()) if t else t) for i, h, t in docs]
    assert got == sorted(want, key=repr) and (1, "own 1\n\nünd 1 end") in got
    low = quality.LineLimits(share=0.06, any_host=41, broadcast_lines=sent)
    assert {r.text for r in quality.quality_rules(df.filter("host = 'h'"), low).collect()} == {t for _, h, t in docs if h == "h"}


def test_url_rules_and_templates(spark):
    urls_ = [(1, "http://A.Example.ORG/es/9?x"), (2, "https://org/en/1#t"), (3, "ftp://x.com/de/"), (4, None), (5, "no scheme"), (6, "http://badexample.org/es/1"), (7, "http://a.com"), (8, "http://example.org/en/17/x")]
    urls_ += [(100 + i, f"http://n.net/{'spam' if i % 2 else 'news'}/{i}") for i in range(80)]
    df = spark.createDataFrame(urls_, "page_id long, url string").withColumn("good", F.when(F.col("page_id") >= 100, (F.col("page_id") + 1) % 2))
    got = {r.page_id: r for r in urls.filter_urls(df, queries.RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (1, 2, 3, 6, 8)] == [
        ("a.example.org", "/es/9", "example.org/es/", "block"), ("org", "/en/1", "org/", "allow"), ("x.com", "/de/", "com/de/", "block"), ("badexample.org", "/es/1", "org/", "allow"), ("example.org", "/en/17/x", "example.org/en/1", "block"),
    ]
    assert (got[4].host, got[4].path, got[5].host, got[7].path) == ("", "", "", "")
    assert got[101].verdict == "block" and got[100].verdict == "allow" and got[101].template == "/spam/*"


def test_url_inner_branches_merge(spark):
    pages = [(f"http://m.net/{s}/{i}", int(s != "c")) for s in "abc" for i in range(40)] + [(f"http://m.net/x/{s}/{i}", int(s == "good")) for s in ("good", "bad") for i in range(40)]
    pages += [("http://m.net/a", 1), ("http://m.net", 1)]
    df = spark.createDataFrame([(n, *p) for n, p in enumerate(pages)], "page_id long, url string, good int")
    got = {r.path: r for r in urls.filter_urls(df, []).collect()}
    assert got["/a/1"].template == got["/b/2"].template == "/a//b/*" and got["/c/1"].template != "/a//b/*"
    assert got["/x/good/1"].template != got["/x/bad/1"].template and got["/x/bad/1"].verdict == "block" and got["/x/good/1"].verdict == "allow"
    assert got["/a"].template == "/a" and got[""].template == ""
    prior = (sum(g for _, g in pages) + 1) / (len(pages) + 2)
    assert abs(got["/a/1"].purity - (80 + 10 * prior) / 90) < 1e-9


def test_url_templates_of_any_depth(spark):
    deep = "/".join("abcdefgh")
    pages = [(f"http://d.net/{deep}/{s}/{i}", int(s == "news")) for s in ("spam", "news") for i in range(40)] + [("http://e.net/q/" + "/".join(["r"] * 30), None)]
    df = spark.createDataFrame([(n, *p) for n, p in enumerate(pages)], "page_id long, url string, good int")
    got = {r.path: r for r in urls.filter_urls(df, []).collect()}
    assert len(got) == len(pages) and all(r.verdict == ("block" if "spam" in p else "allow") for p, r in got.items())
    assert got[f"/{deep}/spam/1"].template == f"/{deep}/spam/*" and got["/q/" + "/".join(["r"] * 30)].template == "/q" + "/r" * 30


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=70_000) | st.text(max_size=3000).map(str.encode))
def test_ogg_round_trip(data):
    data = data or b"\0"
    assert ogg.read_back(ogg.encode(data, packet=255 * 3))[0] == data and ogg.read_back(ogg.encode(data))[0] == data


def test_ogg_finds_damage_and_known_checksum():
    table = []
    for b in range(256):
        r = b << 24
        for _ in range(8):
            r = (r << 1) ^ (0x04C11DB7 if r & 0x80000000 else 0)
        table.append(r & 0xFFFFFFFF)
    crc, page = 0, b"OggS some page"
    for b in page:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ table[(crc >> 24) ^ b]
    assert ogg.checksum(page) == crc
    good = ogg.encode(bytes(range(256)) * 200)
    for at in (0, 30, 500, len(good) - 1):
        with pytest.raises(ogg.OggError):
            ogg.decode(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
    with pytest.raises(ogg.OggError):
        ogg.decode(good[: len(good) // 2])


def test_media_query(spark, edge):
    for r in ogg.examine(ogg.store(edge)).collect():
        raw = (dict(EDGE)[r.doc_id] or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_toxicity_learns_and_reaches_long_texts(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("aeioustrn"), 6))
    docs, labels = [], []
    for i in range(300):
        w, bad = [word() for _ in range(40)], i % 4 == 0
        if bad:
            w[7], w[20] = "gnarfle", "blorptak"
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    probe = [(1000, " ".join(word() for _ in range(3000)) + " gnarfles!"), (1001, " ".join(word() for _ in range(300))), (1002, None), (1003, "")]
    df = spark.createDataFrame(docs + probe, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, label int")
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.fit(df, lab)).collect()}
    wrong = sum((got[i] >= 0.3) != bool(y) for i, y in labels)
    assert wrong <= 3 and got[1000] > got[1001] and 0 <= got[1002] == got[1003] <= 1


@pytest.mark.parametrize("run", [substrings.dedup_substrings, jaccard.similarity_classes, lines.dedup_lines, lambda d: mixture.taken(*mixture.mixed(d)), quality.quality_rules, lambda d: ogg.examine(ogg.store(d)), lambda d: toxicity.score(d, None)])
def test_empty_tables(spark, run):
    empty = spark.createDataFrame([], "doc_id long, text string, source string, host string")
    assert run(empty).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "mixture", "packing"]
    out = p.run(spark, SF)
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(out.columns) and out.count() > 50


def _with_odd_ids(spark):
    """Null and repeated ids: copies and near copies among them, and texts of their own under one id."""
    own = lambda n: " ".join(f"own{n}word{k}" for k in range(40))
    docs = [(None, own(1)), (None, own(2)), (None, own(2)), (3, own(3)), (3, own(4)), (3, own(4)), (4, own(4)), (5, own(4) + " more"), (5, own(5)), (6, PASSAGE), (None, PASSAGE + " tail"), (2, PASSAGE + " end")]
    docs += [(7, "too short"), (7, "too short"), (None, None), (None, "one two three")]
    return docs, spark.createDataFrame([(i, t, "en", f"s{n % 2}", n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline_near_duplicates_with_odd_ids(spark):
    import corpus_pipeline as p

    docs, df = _with_odd_ids(spark)
    classes = brute.classes([(n, t) for n, (_, t) in enumerate(docs)], jaccard.Join().k, jaccard.Join().percent)
    group = {r[0]: r[2] for r in classes}
    best = {}
    for n, (i, _) in enumerate(docs):
        best.setdefault(group[n], []).append((i is None, i or 0))
    want = sorted(min(v) for v in best.values())
    for parts in (1, 5):
        out = p.drop_near_duplicates(spark, df.repartition(parts), SF).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == want
        texts = [r.text for r in out]
        assert {docs[0][1], docs[1][1], docs[3][1], docs[8][1], None} <= set(texts) and texts.count(docs[4][1]) == 1


def test_pipeline_mixture_with_odd_ids(spark):
    import corpus_pipeline as p
    from collections import Counter

    docs, df = _with_odd_ids(spark)
    slim, plan, draws = mixture.mixed(df.select(F.col("n_chars").alias("doc_id"), "source", "text"), mixture.Mix(block_words=None))
    quota = {r.source: (r.quota, r.n_blocks) for r in plan.collect()}
    seen = []
    for parts in (1, 5):
        out = Counter(r.n_chars for r in p.mix_sources(spark, df.repartition(parts), SF).collect())
        seen.append(out)
        for s, (q, blocks) in quota.items():
            own = {n: out[n] for n, (_, t) in enumerate(docs) if f"s{n % 2}" == s and t}
            assert len(own) == blocks and sum(own.values()) == q and all(c in (q // blocks, q // blocks + 1) for c in own.values())
    assert seen[0] == seen[1] and any(out > 0 and docs[n][0] is None for n, out in seen[0].items())


def test_line_dedup_of_very_long_texts(spark):
    """Two equal documents of very many short lines, and a third that shares their middle."""
    line = [f"line {n} of many" for n in range(60_000)]
    docs = [(1, "\n".join(line)), (2, "\n".join(line)), (3, "\n".join(["start here", *line[100:50_000], "end here"])), (3, "\n".join(["start here", *line[100:50_000], "end here"]))]
    df = spark.createDataFrame([(*d, "mine", 5) for d in docs], "doc_id long, text string, kept string, spans long")
    got = sorted(map(tuple, lines.dedup_lines(df).select("doc_id", "kept", "n_lines", "n_deleted", "spans").collect()))
    assert got == [(1, docs[0][1], 60_000, 0, 5), (2, "", 60_000, 60_000, 5)] + [(3, "start here\nend here", 49_902, 49_900, 5)] * 2


def test_packing_of_repeated_rows_null_ids_and_no_rows(spark):
    import public_tokenizers
    from collections import Counter

    path = public_tokenizers.path(queries.TOKENIZER)
    docs = [(None, "")] * 700 + [(1, None)] * 30 + [(2, "a few words here")] * 50 + [(None, "a few words here")] * 3 + [(3, LONG)] * 2
    df = spark.createDataFrame([(*d, 9, 9) for d in docs], "doc_id long, text string, low long, first long")
    out = packing.pack(packing.pieces(df, path, limit=256).cache(), limit=256, bucket_rows=64).collect()
    assert Counter(r.doc_id for r in out if r.start == 0) == Counter(d for d, _ in docs)
    assert Counter((r.doc_id, r.start) for r in out if r.doc_id == 3) == {(3, s): 2 for s in {r.start for r in out if r.doc_id == 3}}
    used = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert set(used) == set(range(len(used))) and max(used.values()) <= 256 and sum(used.values()) > 0.97 * 256 * len(used)
    assert packing.pack(packing.pieces(df.limit(0), path).cache()).count() == 0


def test_running_sums_need_no_single_task(spark):
    values = [(s, n, (7 * n + s) % 11) for s in range(2) for n in range(0, 300, 1 + s)]
    got = {(r.s, r.n): r.before for r in mixture._before(spark.createDataFrame(values, "s int, n long, v long"), ["s"], "n", "v", chunk=16).collect()}
    assert got == {(s, n): sum(v for t, m, v in values if t == s and m < n) for s, n, _ in values}


def test_overlap_of_short_hashes_decides_or_leaves_open():
    rng = np.random.default_rng(8)
    for n, m in ((0, 5), (40, 60), (3000, 2900)):
        a, b = (np.sort(rng.integers(0, 4000, k).astype(np.uint32)) for k in (n, m))
        from collections import Counter

        assert jaccard.overlap(a, b) == sum((Counter(a.tolist()) & Counter(b.tolist())).values())
    for both in range(101):
        exact = jaccard.decided(both, 100, 100, 80, True)
        assert exact == (1 if 100 * both >= 80 * (200 - both) else -1)
        assert jaccard.decided(both, 100, 100, 80, False) in (exact, 0) and jaccard.decided(both, 100, 100, 80, False) == exact or 89 <= both <= 93


def test_quality_query_equals_sql(spark):
    from compare import connection, differences

    assert differences(spark, connection(SF), "op7", queries.op7_quality_rules, queries.oracle_sql()["op7_quality_rules"], SF) == ""


def test_quality_of_awkward_rows_equals_sql(spark, tmp_path):
    """Null hosts and texts, repeated rows, a very long text, and columns of other operators' names."""
    from compare import connection, differences

    line = "this line stands in many documents of a host"
    docs = [(i, f"own {i}\n{line.upper() if i % 2 else line}\n" + " ".join(f"w{i}x{k}" for k in range(60)), None if i % 3 else "h") for i in range(90)]
    docs += [(5, None, "h"), (5, None, "h"), (6, "", None), (7, LONG, "h"), (8, "a b c " * 400, "h"), (9, "\n \n", "h")] + [(10, "# a\n# a\nb", "other")] * 2
    spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, kept int, removed_words string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = connection(str(tmp_path))
    assert differences(spark, con, "op7", queries.op7_quality_rules, queries.oracle_sql()["op7_quality_rules"], str(tmp_path)) == ""


def test_toxicity_of_repeated_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("aeioustrn"), 6))
    docs = [(i, " ".join([*(word() for _ in range(20)), *(["gnarfle"] if i % 3 == 0 else [])])) for i in range(90)]
    docs += [docs[0]] * 40 + [(1, " ".join(word() for _ in range(5))), (None, docs[3][1]), (None, None)]
    df = spark.createDataFrame([(*d, "old", n) for n, d in enumerate(docs)], "doc_id long, text string, score string, label int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(0, 0), (0, 1), (None, 1), (5, None)], "doc_id long, label int")
    model = toxicity.fit(df, labels)
    out = toxicity.score(df, model).collect()
    assert len(out) == len(docs) and sorted(r.label for r in out) == list(range(len(docs))) and all(0 <= r.score <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.text, set()).add(r.score)
    assert all(len(v) == 1 for v in by.values())
    again = toxicity.fit(df.repartition(5), labels)
    assert np.array_equal(model.weights, again.weights) and model.curve == again.curve
    assert toxicity.fit(df, labels.filter("label = 1")) is None and toxicity.fit(df.limit(0), labels) is None


def test_toxicity_windows_equal_a_plain_score(spark):
    weights = np.random.default_rng(1).normal(0, 1, 64)
    for width in (1, 3):
        model = toxicity.Model(weights, 0.25, (1.5, -0.5, 0.1), width, 10)
        for text in ("", "one", "one two", "one two three four five six one", "«Ünï» x, y! " * 9):
            w = toxicity.normal_words(text)
            each = [np.mean([weights[g] for g in toxicity.grams(x, 64)]) for x in w]
            runs = [np.mean(each[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else [0.0]
            want = 1 / (1 + np.exp(-(1.5 * (0.25 + max(runs)) - 0.5 * np.log1p(len(w)) + 0.1)))
            assert abs(model.score(text) - want) < 1e-12


def test_url_filter_of_no_rows_repeats_and_deep_paths(spark):
    kind = "page_id long, url string, good int, host string, template int"
    assert urls.filter_urls(spark.createDataFrame([], kind), queries.RULES).count() == 0
    deep = "http://h.net/" + "/".join(f"s{k % 3}" for k in range(12)) + "/" + "q" * 50_000
    pages = [(1, deep), (1, deep), (2, None), (None, "http://ORG/EN/1"), (3, "http://x.example.org/en/1"), (4, "http://example.org.com/de/1"), (5, "://"), (6, "a://b://c/d")]
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame([(*p, None, "mine", 1) for p in pages], kind), [*queries.RULES, ("block", "org", "/")]).collect()), key=repr)
    path = deep[len("http://h.net") :]
    want = [(1, "h.net", path, None, "allow")] * 2 + [(2, "", "", None, "allow"), (3, "x.example.org", "/en/1", "example.org/en/1", "block"), (4, "example.org.com", "/de/1", "com/de/", "block"), (5, "", "", None, "allow"), (6, "b:", "//c/d", None, "allow")]
    assert [r for r in got if r[0] is not None] == want and [r[:4] for r in got if r[0] is None] == [(None, "org", "/EN/1", "org/")]
