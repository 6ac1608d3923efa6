import pytest
from lumengrid.sources import results

SCHEMA = "unit long, n long, note string"


def test_slice_reads_its_folder_only(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (2, None, 2.0), (3, "b", 3.0)], "unit long, layer string, x double")
    path = results.write_slices(df, f"{tmp_path}/s", "layer")
    part = results.read_slice(spark, path, layer="a")
    assert [(r.unit, r.x) for r in part.collect()] == [(1, 1.0), (1, 1.0)]
    assert [r.unit for r in results.read_slice(spark, path, layer=None).collect()] == [2]
    assert "PartitionFilters: [(layer" in part._jdf.queryExecution().explainString(part._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_upsert_keeps_other_rows_and_nulls(spark, tmp_path):
    prior = spark.createDataFrame([(1, 1, "x"), (2, 2, ""), (None, 3, None)], SCHEMA)
    first = results.write_csv(prior, f"{tmp_path}/a")
    new = spark.createDataFrame([(2, 9, "new"), (2, 10, "twice"), (4, 4, 'quo"te,\nline')], SCHEMA)
    path = results.upsert_csv(new.filter("n < 10 and unit < 4"), first, f"{tmp_path}/b", ["unit"], SCHEMA)
    assert sorted(map(tuple, results.read_csv(spark, path, SCHEMA).collect()), key=str) == [(1, 1, "x"), (2, 9, "new"), (None, 3, None)]
    assert results.read_csv(spark, results.upsert_csv(new.limit(0), first, f"{tmp_path}/c", ["unit"], SCHEMA), SCHEMA).count() == 3


def test_outputs_with_unlike_columns(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/a")
    spark.range(3).selectExpr("id", "id * 2 as y").write.parquet(f"{tmp_path}/b")
    got = results.read_outputs(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert got.count() == 5 and got.filter("y is null").count() == 2


def test_export_raises_and_writes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok"), (2, "call 555-1234"), (3, None)], "unit long, note string")
    with pytest.raises(ValueError, match="private"):
        results.export_checked(df, f"{tmp_path}/x", ["unit", "note"], r"\d{3}-\d{4}")
    assert not (tmp_path / "x").exists()
    results.export_checked(df, f"{tmp_path}/y", ["unit"], r"\d{3}-\d{4}")
    assert spark.read.parquet(f"{tmp_path}/y").columns == ["unit"]


def test_list_literals_and_globs(spark):
    from lumengrid.sources import results

    df = spark.createDataFrame([(1, [1.5, -2.0]), (2, None), (3, []), (4, [None, 1.0])], "i int, v array<double>")
    path = results.write_literals(df, "v", results.new_folder(spark, "literals"))
    back = {r.i: r.v for r in results.read_literals(spark, path, "v", "i int, v string").collect()}
    assert back == {1: [1.5, -2.0], 2: None, 3: [], 4: [None, 1.0]}
    root = results.new_folder(spark, "many")
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{root}/task-1")
    spark.createDataFrame([(2, "x")], "a int, b string").write.parquet(f"{root}/task-2")
    spark.createDataFrame([(3,)], "a int").write.parquet(f"{root}/other")
    assert sorted(map(tuple, results.read_glob(spark, f"{root}/task-*").select("a", "b").collect())) == [(1, None), (2, "x")]
