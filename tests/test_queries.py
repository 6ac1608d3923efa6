import re

import pytest
from compare import connection, differences
from conftest import SF
from lumengrid import registry

CON = connection(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differences(spark, CON, name, registry.queries()[name], registry.oracle_sql()[name], SF) == ""


def test_entry_and_registry_import(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pairs_in_cluster_take_every_vector(spark, tmp_path):
    spark.range(600).selectExpr("id as vec_id", "int(id % 3) as label", "array(1f, float(id >= 200), float(id % 7)) as embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    name = "j14_all_pairs_in_cluster"
    assert differences(spark, connection(str(tmp_path)), name, registry.queries()[name], registry.oracle_sql()[name], str(tmp_path)) == ""
    assert {r.pairs for r in registry.queries()[name](spark, str(tmp_path)).collect()} == {200 * 199 // 2}


def test_event_rates_pair_nothing_and_shuffles_meet_where_they_lie(spark):
    plan = lambda name: registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "sequence(" not in plan("j1_event_rates")  # no spans over buckets
    # rows meet by their unit's keys alone
    assert "own, i" not in "".join(line for line in re.sub(r"#\d+L?", "", plan("r1_cross_correlation")).splitlines() if "Exchange" in line)


def test_exact_quantiles(spark):
    import numpy as np
    from lumengrid.operators.ranks import quantiles

    for values in ([3.0], [1.0, 1.0, 1.0], np.random.default_rng(0).lognormal(size=501).tolist(), [5.0, None, 2.0]):
        q = quantiles(spark.createDataFrame([(v,) for v in values], "x double"), "x", (0.0, 0.25, 0.75, 1.0), 16).first()["q"]
        assert np.allclose(q, np.quantile([v for v in values if v is not None], [0, 0.25, 0.75, 1]), atol=1e-12)
    assert quantiles(spark.createDataFrame([(None,)], "x double"), "x", (0.5,)).first()["q"] == [None]
    # no sum of all values in one place
    assert "percentile" not in registry.queries()["p13_quantile_labels"](spark, SF)._jdf.queryExecution().executedPlan().toString()
