"""Groups without spread: SQL's correlations are NaN there, and no division fails."""

import datetime as dt
import math

import duckdb
import pytest
from compare import differences

from lumengrid import registry
from lumengrid.operators.tables import correlation


def test_correlations_without_spread_are_not_errors(spark):
    rows = [("flat", 1.0, 2.0), ("flat", 1.0, 5.0), ("one", 3.0, 4.0), ("line", 1.0, 2.0), ("line", 2.0, 4.0), ("line", None, 9.0), ("none", None, 1.0)]
    out = {r.g: r.r for r in spark.createDataFrame(rows, "g string, a double, b double").groupBy("g").agg(correlation("a", "b").alias("r")).collect()}
    assert math.isnan(out["flat"]) and math.isnan(out["one"]) and out["line"] == pytest.approx(1.0) and out["none"] is None


@pytest.mark.parametrize("name", ["r3_noise_ceiling", "r5_fold_correlation"])
def test_users_with_equal_values_equal_sql(spark, tmp_path, name):
    """User 1 has one value, user 2 fewer than three slots, user 3 a slope."""
    rows = []
    for user, hours in ((1, (1, 5, 9, 13)), (2, (1, 5)), (3, (1, 5, 9, 13))):
        for kind in ("view", "click", "error"):
            rows += [(len(rows) + i, user, kind, dt.datetime(2024, 1, 1, h, m), {1: 5.0, 2: 7.0, 3: 1.0 * h * h + m + len(kind)}[user]) for i, (h, m) in enumerate((h, m) for h in hours for m in range(4))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert not differences(spark, con, name, registry.queries()[name], registry.oracle_sql()[name], str(tmp_path))
