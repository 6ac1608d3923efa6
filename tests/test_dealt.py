"""Tasks that grow in number with the table, not in size."""

from pyspark.sql import functions as F

from lumengrid.operators.tables import dealt


def test_more_rows_are_more_tasks_and_keys_stay_together(spark):
    few, many = (dealt(spark.range(n).withColumn("k", F.col("id") % 500), 100, "k") for n in (300, 4000))
    assert few.rdd.getNumPartitions() == 4 and many.rdd.getNumPartitions() == 40
    assert many.count() == 4000 and many.select("k", F.spark_partition_id().alias("p")).distinct().count() == 500
