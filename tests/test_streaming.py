from conftest import SF
from lumengrid.operators.tables import table
from lumengrid.streaming.sessions import session_counts, tumbling_counts
from pyspark.sql import functions as F


def test_stream_closes_the_windows_a_table_gives(spark, tmp_path):
    """All windows that end before the watermark come out of the stream as from the table."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    src = str(tmp_path / "in")
    table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    still = spark.read.parquet(src)
    for name, f, key in (("sessions", session_counts, "user_id"), ("tumbling", tumbling_counts, "event_type")):
        live = f(spark.readStream.schema(still.schema).parquet(src))
        q = live.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {(r[key], r["start"], r["n"]) for r in spark.table(name).collect()}
        want = {(r[key], r["start"], r["n"]) for r in f(still).collect()}
        assert got and got <= want
