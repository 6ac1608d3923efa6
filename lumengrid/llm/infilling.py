"""Fill-in-the-middle: texts rearranged so that a model learns to write what lies between two parts.

Escaped marker injection.  A delimiter character and an escape character are escaped in the text, so
that the delimiter is free; one ``regexp_replace`` appends it after every unit (a line with its newline,
or the rest), the delimiters are counted, ``substring_index`` takes the parts by their rank, and the
delimiters and escapes are taken out of the parts again.  Units never end inside an escape, as neither
character is a newline.  All of it is columns of one row: nothing is shuffled, and no text leaves the JVM.

The places of the cuts and the form depend on the seed and ``doc_id`` alone.

Defined results: null texts count as empty; an empty text, and one that holds a mark itself, stay as they
are (``plain``); a null ``doc_id`` is hashed as an empty number; equal rows get equal
results; an empty table gives no rows; all other columns stay, but those in ``ADDED``, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = r"([^\n]*+\n|[^\n]++)"
#: The delimiter, the escape, and what stands for each of them after the escape.
CUT, ESCAPE, CUT_NAME, ESCAPE_NAME = "\x01", "\x02", "c", "e"
ADDED = ("n", "form", "prefix", "middle", "suffix", "output")


@dataclass(frozen=True)
class Infilling:
    """``rate``: percent of the texts that are rearranged; ``suffix_first``: percent of those in the order suffix, prefix, middle."""

    seed: int = 7
    rate: int = 100
    suffix_first: int = 50
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"

    def __post_init__(self) -> None:
        for a in self.marks:
            for b in self.marks:
                if not a or a is not b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError(f"marks {a!r} and {b!r} could be read into each other")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix_mark, self.suffix_mark, self.middle_mark


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + ESCAPE_NAME)), F.lit(CUT), F.lit(ESCAPE + CUT_NAME))


def _plain(part: Column) -> Column:
    joined = F.replace(part, F.lit(CUT), F.lit(""))
    return F.replace(F.replace(joined, F.lit(ESCAPE + CUT_NAME), F.lit(CUT)), F.lit(ESCAPE + ESCAPE_NAME), F.lit(ESCAPE))


def _parts(text: Column, count: Column) -> Column:
    """The first ``count`` parts, or the last ``-count``."""
    return F.call_function("substring_index", text, F.lit(CUT), count.cast("int"))


def rearrange(docs: DataFrame, cfg: Infilling = Infilling()) -> DataFrame:
    """Adds number of units, form, the three parts (null if plain) and the rearranged text."""
    digest = F.sha2(F.concat(F.lit(f"{cfg.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    out = docs.drop(*ADDED).withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_digest", digest)
    out = out.withColumn("_cut", F.regexp_replace(_escaped(F.col("_text")), UNITS, f"$1{CUT}"))
    out = out.withColumn("n", (F.length("_cut") - F.length(F.replace("_cut", F.lit(CUT), F.lit("")))).cast("long"))
    one, two = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    out = out.withColumn("_a", F.least(one, two)).withColumn("_b", F.greatest(one, two))
    marked = F.lit(False)
    for mark in cfg.marks:
        marked = marked | F.contains("_text", F.lit(mark))
    plain = (F.col("n") == 0) | marked | (h[2] % 100 >= cfg.rate)
    out = out.withColumn("form", F.when(plain, "plain").when(h[3] % 100 < cfg.suffix_first, "spm").otherwise("psm"))
    moved = F.col("form") != "plain"
    out = out.withColumn("prefix", F.when(moved, _plain(_parts(F.col("_cut"), F.col("_a")))))
    out = out.withColumn("middle", F.when(moved, _plain(_parts(_parts(F.col("_cut"), F.col("_b")), F.col("_a") - F.col("_b")))))
    # the last delimiter ends the text, so one more part, an empty one, follows it
    out = out.withColumn("suffix", F.when(moved, _plain(_parts(F.col("_cut"), F.col("_b") - F.col("n") - 1))))
    p, s, m = (F.lit(x) for x in cfg.marks)
    order = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle"))
    return out.withColumn("output", F.coalesce(order, F.col("_text"))).drop("_text", "_digest", "_cut", "_a", "_b")


def restored(output: Column, form: Column, cfg: Infilling = Infilling()) -> Column:
    """The text that was rearranged, from the output and its form alone."""
    p, s, m = (F.lit(x) for x in cfg.marks)

    def between(mark: Column, following: Column) -> Column:
        return F.split_part(F.split_part(output, mark, F.lit(2)), following, F.lit(1))

    middle = F.split_part(output, m, F.lit(2))
    psm, spm = F.concat(between(p, s), middle, between(s, m)), F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
