"""Tables in buckets, and joins on them that move nothing."""

import pytest
from pyspark.sql import functions as F

import sealyard as sy
from sealyard.bindings.inventory import bucketed_digest_tables
from sealyard.operators.digests import verify_digests

ROWS = [(i % 7, f"n{i}", bytearray(b"x" * i), [str(i)]) for i in range(50)] + [(None, "n", None, None), (1, None, None, [])]
SCHEMA = "key int, name string, content binary, fields array<string>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_bucketed_table_is_opened_by_its_folder(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    written = sy.write_bucketed(df, f"{tmp_path}/t", ["key", "name"], 4)
    found = sy.read_bucketed(spark, f"{tmp_path}/t")
    assert rows(found) == rows(written) == rows(df) and found.schema == df.schema
    assert len(found.inputFiles()) == 4
    with pytest.raises(Exception, match="non-empty"):
        sy.write_bucketed(df, f"{tmp_path}/t", ["key", "name"], 4)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sy.read_bucketed(spark, f"{tmp_path}/none")


def test_joins_and_aggregations_on_the_key_have_no_exchange(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    one, two = (sy.write_bucketed(df, f"{tmp_path}/{n}", ["key", "name"], 4) for n in "ab")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = one.join(two.select("key", "name", F.lit(1).alias("other")), ["key", "name"], "left")
        assert "Exchange" not in plan_of(joined) and joined.count() == len(ROWS)
        assert "Exchange" not in plan_of(one.groupBy("key", "name").count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_digests_are_verified_without_an_exchange(spark, sf_dir):
    tables = bucketed_digest_tables(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = verify_digests(*tables, ["doc_id"])
        plan = plan_of(found)
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 3, plan
        assert found.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
