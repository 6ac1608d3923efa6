"""The registered queries over the test tables: operators applied to whole tables."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import chat, exact, infilling, jaccard, lines, merkle, mixture, ogg, packing, quality, substrings, toxicity, urls
from .common import table, written

TOKENIZER = "word_bpe_49k.json"
THRESHOLD = 0.3
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_log(chat.events_of_turns(turns))
    said = F.array_join(F.transform(F.filter("turns", lambda t: t["in_loss"]), lambda t: t["text"]), "")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"), F.sha2(said, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture.taken(*mixture.mixed(docs)).drop("row")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), jaccard.Join(k=4, percent=85))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, public_tokenizers.path(TOKENIZER))
    slim = written(cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "pieces")
    return packing.pack(slim)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("host"), "text")
    out = quality.quality_rules(docs).withColumn("kept_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return out.drop("host", "text")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: the ``quality`` of the document whose number ends a page's path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.expr("try_cast(regexp_extract(path, '/([0-9]+)(?:/|[.]html)?$', 1) as bigint)")
    numbered = pages.withColumn("path", urls.path_of(F.col("url"))).withColumn("number", number)
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("number")).agg(F.avg("quality").alias("good"))
    return urls.filter_urls(numbered.join(labels, "number", "left"), RULES)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.examine(ogg.store(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _checked(row: Row, path: list, subroot: str, root: str) -> tuple:
    again = merkle.fold(row["tampered"] or row["leaf"], path)
    return row["order"], row["leaf"], subroot, root, merkle.digest(*merkle.siblings(path)), again, again == root


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    leaves = docs.select(F.col("source").alias("group"), F.col("doc_id").alias("order"), merkle.leaf(*fields, F.col("text")).alias("leaf"), F.when(altered, merkle.leaf(*fields, lower)).alias("tampered"))
    return merkle.proofs(leaves, each=_checked, schema="doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.decisions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infilling.rearrange(table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = infilling.restored(F.col("output"), F.col("form"))
    return out.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"),
    )


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_ESCAPED = "replace(replace(replace(coalesce({0}, ''), chr(92), chr(92) || chr(92)), '#', chr(92) || '#'), '</turn>', '<' || chr(92) || '/turn>')"
_OP2 = f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -7, 0, 'user', chr(92) || '### Assistant: </turn> ok' union all select -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok')
 select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
 sum(4 + length(replace({_ESCAPED.format('role')}, ': ', ':' || chr(92) || ' ')) + 2 + length({_ESCAPED.format('text')}) + 8)::bigint as formatted_chars from t group by conv_id"""

_OP5 = """with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
 s as (select doc_id, i, array_to_string(ws[i : i + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)),
 m as (select k, min(doc_id) as d from s group by k), g as (select distinct doc_id, i + j as p from s join m using (k), range(13) r(j) where m.d < s.doc_id),
 e as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as p from w),
 kept as (select e.doc_id, count(g.p) as n_removed, string_agg(e.x, ' ' order by e.p) filter (where g.p is null) as t from e left join g on g.doc_id = e.doc_id and g.p = e.p group by 1)
 select w.doc_id, len(ws) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)"""


_SPLIT = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_OP7 = f"""with b as (select row_number() over () as r, doc_id, source as host, text, coalesce(text, '') as t from documents),
 w as (select r, {_SPLIT.format('t')} as ws from b),
 g as (select r, i, array_to_string(ws[i : i + 2], ' ') as k from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 4)),
 again as (select r, count(distinct i + j) as n from (select r, i from g qualify count(*) over (partition by r, k) > 1), range(3) x(j) group by r),
 l as (select r, host, p, line, {_SPLIT.format('line')} as lw from (select r, host, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as p from b)),
 f as (select *, len(lw) > 0 as filled, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from l),
 h as (select host, count(*) as docs from b group by 1),
 hot as (select c.host, norm from (select host, norm, count(distinct r) as holders from f where filled group by 1, 2) c join h on h.host is not distinct from c.host where holders > 20 and holders > 0.05 * docs or holders > 1000),
 m as (select f.*, hot.norm is not null and filled as gone from f left join hot on hot.norm = f.norm and hot.host is not distinct from f.host),
 per as (select r, (count(*) filter (where filled) - count(distinct line) filter (where filled))::bigint as n_dup_lines, coalesce(sum(len(lw)) filter (where gone), 0)::bigint as removed_words,
  coalesce(string_agg(line, chr(10) order by p) filter (where not gone), '') as clean from m group by r),
 o as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, n_dup_lines, coalesce(again.n, 0) as n_repeat_words, removed_words, sha256(clean) as kept_sha256
  from b join w using (r) join per using (r) left join again using (r))
 select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and removed_words <= 0.5 * n_words as kept from o"""


def _op11(low: int = 7, high: int = 4) -> str:
    """The trees' levels are laid out one by one: up to 16^low rows a source and 16^high sources; a level of one node is passed on as it is."""
    encoded = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')"
    fields = " || ".join(encoded.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    bits = "xor(a, b)"  # DuckDB has no crc32
    for _ in range(8):
        bits = f"list_transform([{bits}], lambda c: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)[1]"
    crc = f"xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda a, b: {bits}), 4294967295)"
    parts = [
        f"l as (select doc_id, source, sha256({fields} || {encoded.format('text')}) as leaf, case when {crc} % 5 = 0 then sha256({fields} || {encoded.format(lower)}) end as tampered from documents)",
        "n as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from l)",
        "t0 as (select source as g, i, leaf as d, count(*) over (partition by source) as n from n)", "p0 as (select doc_id, source, leaf, source as g, i, leaf as own, coalesce(tampered, leaf) as folded, '' as proof from n)",
    ]

    def climb(k: int) -> None:
        before, after = "array_to_string(ds[:i % 16], '')", "array_to_string(ds[i % 16 + 2:], '')"
        parts.append(f"r{k} as (select g, i // 16 as k, list(d order by i) as ds, any_value(n) as n from t{k} group by 1, 2)")
        parts.append(f"t{k + 1} as (select g, k as i, case when n = 1 then ds[1] else sha256(array_to_string(ds, '')) end as d, (n + 15) // 16 as n from r{k})")
        parts.append(
            f"p{k + 1} as (select doc_id, source, leaf, p.g, i // 16 as i, case when n = 1 then own else sha256(array_to_string(ds, '')) end as own, case when n = 1 then folded else sha256({before} || folded || {after}) end as folded,"
            f" case when n = 1 then proof else proof || {before} || {after} end as proof{', subroot' if k > low else ''} from p{k} p join r{k} r on r.g is not distinct from p.g and r.k = p.i // 16)"
        )

    for k in range(low):
        climb(k)
    first = low + 1
    parts.append(f"s as (select g as source, d, row_number() over (order by encode(g) nulls first) - 1 as i, count(*) over () as n from t{low})")
    parts.append(f"t{first} as (select 0 as g, i, d, n from s)")
    parts.append(f"p{first} as (select doc_id, p.source, leaf, 0 as g, s.i, own, folded, proof, own as subroot from p{low} p join s on s.source is not distinct from p.source)")
    for k in range(first, first + high):
        climb(k)
    return f"with {', '.join(parts)} select doc_id, leaf, subroot, own as root, sha256(proof) as proof_sha256, folded as folded_root, folded = own as verified from p{first + high}"


_OP12 = """with t as (select doc_id, row_number() over () as r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
 select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, row_number() over (partition by t order by doc_id desc nulls last, r) = 1 as kept, sha256(t) as text_sha256 from t"""

_OP13 = r"""with t as (select doc_id, coalesce(text, '') as t, sha256('7:' || doc_id) as h from documents),
 u as (select *, case when t = '' then [] else regexp_extract_all(t, '[^\n]*\n|[^\n]+') end as u, [('0x' || substr(h, 8 * k + 1, 8))::bigint for k in range(4)] as h4 from t),
 c as (select *, len(u)::bigint as n, least(h4[1] % (len(u) + 1), h4[2] % (len(u) + 1)) as a, greatest(h4[1] % (len(u) + 1), h4[2] % (len(u) + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when h4[4] % 100 < 50 then 'spm' else 'psm' end as form from u),
 p as (select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf from c)
 select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
 sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from p"""


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle_manifest": _op11(), "op12_exact_dedup": _OP12, "op13_fill_in_middle": _OP13, "op2_chat_format": _OP2, "op5_substring_dedup": _OP5, "op7_quality_rules": _OP7}
