"""Where tables that cut lineage go."""

from types import SimpleNamespace

import pytest

from sealyard.session import clean_up, fresh_folder, materialise, shared_folder


def session(named=None, set_before=None, master="spark://host"):
    chosen = []
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: set_before, setCheckpointDir=chosen.append
    )
    warehouse = {"spark.sql.warehouse.dir": "file:/w"}
    conf = SimpleNamespace(get=lambda key, default: warehouse.get(key) or named or default)
    return SimpleNamespace(conf=conf, sparkContext=context), chosen


def test_the_named_folder_is_used():
    spark, chosen = session(named="hdfs://x/shared/", set_before="hdfs://other")
    assert shared_folder(spark) == "hdfs://x/shared" and not chosen
    assert shared_folder(session(set_before="hdfs://other/")[0]) == "hdfs://other"


def test_a_cluster_gets_no_local_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session()[0])


@pytest.mark.parametrize("master", ["yarn", "local-cluster[2,1,1024]"])
def test_nor_does_any_session_with_executors(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session(master=master)[0])


def test_a_local_session_without_setting_uses_its_warehouse():
    spark, chosen = session(master="local[2]")
    assert shared_folder(spark) == "file:/w/shared-tables" and not chosen


def test_materialise_keeps_rows_types_and_variants(spark):
    df = spark.sql("select 1 as a, array('x') as b, parse_json('{\"k\":[1]}') as c")
    kept = materialise(df)
    assert kept.dtypes == df.dtypes
    assert kept.selectExpr("a", "b", "to_json(c)").first() == (1, ["x"], '{"k":[1]}')
    assert "FileScan parquet" in kept._jdf.queryExecution().executedPlan().toString()


def test_clean_up_deletes_this_sessions_tables_only(spark):
    place = fresh_folder(spark, "x")
    assert place.startswith(shared_folder(spark) + "/") and spark.sparkContext.applicationId in place
    materialise(spark.range(3))
    assert clean_up(spark) and not clean_up(spark)
    assert materialise(spark.range(3)).count() == 3
