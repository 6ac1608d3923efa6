"""From raw documents to packed training sequences, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and
returns them again (the last one: packed pieces).  Each stage's result is written
as Parquet and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid.llm import jaccard, lines, mixture, packing, queries, toxicity
from lumengrid.llm.common import table, written

#: SQL has no form for a trained classifier; tests compare the stages with plain versions.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the classifier learns from the labels outside the held-out part."""
    labels = table(spark, sf_dir, "labels").filter(~queries.held_out()).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, "_score").filter(F.col("_score") < queries.THRESHOLD).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; documents that consisted of such runs alone go."""
    out = lines.dedup_lines(docs).filter("n_deleted < n_lines or n_lines = 0")
    changed = F.col("n_deleted") > 0
    return out.select(
        "doc_id", F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a written key of their rows, as ids may be null or repeated."""
    return written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "keyed")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, the first by id (null last) and text hash; all other rows stay."""
    cfg, keyed = jaccard.Join(), _keyed(docs)
    classes = jaccard.similarity_classes(keyed.select(F.col("_row").alias("doc_id"), "text"), cfg)
    classes = written(classes.select(F.col("doc_id").alias("_row"), "component_id"), "classes")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text").alias("hash"), "lang", "source", "n_chars", "_row")
    first = classes.join(keyed.select("_row", order.alias("order")), "_row").groupBy("component_id").agg(F.min("order").getField("_row").alias("_row"))
    losers = written(classes.join(first, "_row", "left_anti").select("_row"), "losers")
    few = losers.count() <= cfg.broadcast_rows
    return keyed.join(F.broadcast(losers) if few else losers, "_row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents drawn towards the target weights; one drawn more than once has as many rows."""
    keyed = _keyed(docs)
    # the hash of the whole row, so that rows without an id are shuffled too and only equal rows tie
    of_row = keyed.select(F.xxhash64(*COLUMNS).alias("doc_id"), "source", "text", "_row")
    _, _, draws = mixture.mixed(of_row, mixture.Mix(block_words=None), "_row")
    times = draws.groupBy(F.col("row").alias("_row")).agg(F.count(F.lit(1)).cast("int").alias("_times"))
    drawn = keyed.join(times, "_row")
    return drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and place."""
    cut = written(packing.pieces(docs, public_tokenizers.path(queries.TOKENIZER)), "pieces")
    return packing.pack(cut)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
