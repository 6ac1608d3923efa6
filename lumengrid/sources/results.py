"""Features and results as tables: partitioned slices, CSV, JSON summaries, many outputs read as one, upserts and checked exports."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that nobody else writes to, in ``spark.checkpoint.dir``; where that is unset, a local one on ``local[...]`` only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lumengrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/results/{name}-{uuid.uuid4().hex}"


def write_slices(df: DataFrame, path: str, *by: str) -> str:
    """One folder for each value of ``by`` (layer, speaker, region), so that a slice is read without the rest.

    Rows are dealt by ``by`` and a hash of all columns over 32, so that a large slice has several writers and few small files.
    """
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(32))
    df.repartition(*by, spread).write.partitionBy(*by).parquet(path)
    return path


def read_slice(spark: SparkSession, path: str, **keys) -> DataFrame:
    """The slice with these values; the filter reaches the folders."""
    return reduce(lambda t, k: t.filter(F.col(k[0]).eqNullSafe(F.lit(k[1]))), keys.items(), spark.read.parquet(path))


def write_csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).option("emptyValue", "").option("nullValue", "\\N").csv(path)
    return path


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """CSV with a header and a stated schema, so that nothing is read twice to guess types."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("emptyValue", "").option("nullValue", "\\N").csv(path)


def read_outputs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Outputs of many subjects or array tasks as one table; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (spark.read.parquet(p) for p in paths))


def read_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """All outputs whose folders match a pattern, as one table; the columns are those of any of them."""
    return spark.read.option("mergeSchema", True).parquet(pattern)


def write_literals(df: DataFrame, vector: str, path: str) -> str:
    """CSV with a vector column as a list literal."""
    text = F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ", ", "null"), F.lit("]"))
    return write_csv(df.withColumn(vector, F.when(F.col(vector).isNotNull(), text)), path)


def read_literals(spark: SparkSession, path: str, vector: str, schema: str) -> DataFrame:
    """The same read again; ``schema`` has the vector as a string.  A text that is no list gives null."""
    return read_csv(spark, path, schema).withColumn(vector, F.from_json(vector, "array<double>"))


def write_summary(df: DataFrame, path: str) -> str:
    """One JSON object a row."""
    df.write.json(path)
    return path


def upsert_csv(new: DataFrame, prior: str, out: str, keys: list[str], schema: str) -> str:
    """Prior rows without the keys of ``new``, and ``new``, in a folder of their own: a failed job leaves the prior table whole."""
    old = read_csv(new.sparkSession, prior, schema)
    return write_csv(old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new), out)


def export_checked(df: DataFrame, path: str, columns: list[str], private: str) -> str:
    """Writes ``columns`` alone, after a check that no text among them matches ``private``; raises and writes nothing otherwise."""
    chosen = df.select(*columns)
    texts = [f.name for f in chosen.schema.fields if f.dataType.typeName() == "string"]
    found = reduce(lambda a, c: a | F.coalesce(F.col(c).rlike(private), F.lit(False)), texts, F.lit(False))
    if not chosen.filter(found).isEmpty():
        raise ValueError("private values in the export")
    chosen.write.parquet(path)
    return path
