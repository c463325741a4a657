"""Admission against an index of very many keys: same results, and the keys stay where they are."""

import re

import pytest
from builder import CONTRACT, write_release
from pyspark.sql import functions as F

import sealyard as sy
from sealyard.operators import lookup
from sealyard.plans.publish import index_rows, draft_release, publish_release, releases_path, taken_tags

LITTLE, MUCH = lookup.FEW_BYTES, 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    taken = spark.range(40_000).select(F.concat(F.lit("v"), "id").alias("tag"))
    return sy.write_key_index(taken, f"file://{tmp_path_factory.mktemp('index')}/i", ["tag"], buckets=16)


def candidates(spark, n=300):
    """Tags of which one in three is taken, one hot, some NULL."""
    rows = [(f"v{i}" if i % 3 == 0 else f"new{i}", i) for i in range(n)]
    rows += [("hot", i) for i in range(n)] + [(None, 1), (None, 2), ("v1", None), ("v1", 5)]
    return spark.createDataFrame(rows, "tag string, arrival int")


@pytest.mark.parametrize("few_bytes", [LITTLE, MUCH])
def test_an_index_gives_what_the_keys_give(spark, index, few_bytes):
    recent = spark.createDataFrame([("new1",), ("v0",), (None,)], "tag string")
    rows = candidates(spark)
    got = sy.reject_indexed(rows, index, ["arrival"], recent, few_bytes)
    taken = index.keys(spark).unionByName(recent)
    want = sy.reject_existing(rows, taken, ["tag"], ["arrival"])
    one, two = ([sorted(map(tuple, side.collect()), key=repr) for side in pair] for pair in (got, want))
    assert one == two and sum(map(len, one)) == rows.count() and len(one[0]) > 100


def test_nothing_taken_and_nothing_asked(spark, index, tmp_path):
    new = spark.createDataFrame([("x", 1), ("y", 2)], "tag string, arrival int")
    for few_bytes in (LITTLE, MUCH):
        admitted, rejected = sy.reject_indexed(new, index, ["arrival"], few_bytes=few_bytes)
        assert admitted.count() == 2 and rejected.count() == 0
        assert sy.taken_keys(new.limit(0), index, few_bytes).count() == 0
    empty = sy.write_key_index(new.limit(0), f"file://{tmp_path}/e", ["tag"])
    assert sy.taken_keys(candidates(spark), empty).count() == 0 == sy.taken_keys(candidates(spark), empty, MUCH).count()


def test_filters_miss_no_key_and_pass_few_others(spark, index):
    assert lookup.pass_filters(index.keys(spark), index).count() == 40_000
    others = spark.range(20_000).select(F.concat(F.lit("w"), "id").alias("tag"))
    assert lookup.pass_filters(others, index).count() < 600


def test_the_index_side_has_no_exchange(spark, index):
    """Whether the batch is broadcast or dealt out, the keys are joined where they lie."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few_bytes, join in ((LITTLE, "BroadcastHashJoin"), (MUCH, "ShuffledHashJoin")):
            plan = plan_of(sy.taken_keys(candidates(spark), index, few_bytes))
            assert join in plan and "SortMergeJoin" not in plan
            exchanges = re.findall(r"Exchange \w+[^\n]*", plan)
            # One exchange, and below it the batch; above the scan of the index there is none.
            assert len(exchanges) == 1, plan
            stream = plan.split(join)[1].split(exchanges[0])[0]
            assert "FileScan parquet" in stream and "Exchange" not in stream, plan
        assert "Bucketed: true" in plan and "SelectedBucketsCount: 16 out of 16" in plan
        assert "hashpartitioning(tag" in exchanges[0] and ", 16)" in exchanges[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_small_batch_opens_the_files_of_its_buckets_only(spark, index):
    few = spark.createDataFrame([("v7",), ("v11",), ("brand new",)], "tag string")
    found = sy.taken_keys(few, index)
    assert sorted(r.tag for r in found.collect()) == ["v11", "v7"]
    files = [f for f in found.inputFiles() if "/keys/" in f]
    assert 1 <= len(files) <= 2 and len(index.keys(spark).inputFiles()) == 16


@pytest.mark.parametrize("few_bytes", [LITTLE, MUCH])
def test_an_index_is_opened_again_with_keys_of_several_columns(spark, tmp_path, few_bytes):
    rows = spark.createDataFrame([(i, f"a b{i}", i * 10**17) for i in range(-50, 50)] + [(None, "x", 1)], "`k 1` int, `k.2` string, k3 bigint")
    written = sy.write_key_index(rows, f"{tmp_path}/i", rows.columns, buckets=4, note={"any": 1})
    index = sy.open_key_index(spark, f"{tmp_path}/i")
    assert index == written and index.note == {"any": 1}
    asked = rows.unionByName(rows.withColumn("k3", F.col("k3") + 1)).withColumn("arrival", F.lit(1))
    found = sy.taken_keys(asked, index, few_bytes)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.where('`k 1` IS NOT NULL').collect()))


def test_an_unfinished_index_is_none(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sy.open_key_index(spark, f"{tmp_path}/none")
    sy.write_key_index(spark.createDataFrame([("a",)], "tag string"), f"{tmp_path}/i", ["tag"])
    with pytest.raises(Exception, match="non-empty"):
        sy.write_key_index(spark.createDataFrame([("a",)], "tag string"), f"{tmp_path}/i", ["tag"])


# ---- the registry's tags


def taken(spark, registry, tags):
    rows = spark.createDataFrame([(t,) for t in tags], "tag string")
    return sorted({r.tag for r in taken_tags(rows, registry).join(rows, "tag").collect()})


def test_tags_are_taken_and_freed_beside_their_index(spark, tmp_path):
    registry = f"file://{tmp_path}/registry"
    sy.create_registry(spark, registry)

    def batch(seq, tags, failed=()):
        rows = spark.createDataFrame([(t, t, 1) for t in tags], "release_id string, tag string, arrival bigint")
        rows = index_rows(rows, F.lit("p"), F.col("arrival"))
        draft_release(rows, registry, seq)
        publish_release(rows, spark.createDataFrame([(t,) for t in failed], "release_id string"), registry, seq)

    def withdraw(tags, seq):
        sy.withdraw_draft(spark.createDataFrame([(t,) for t in tags], "tag string"), registry, seq)

    asked = ["a", "b", "c", "d", "e", "z"]
    batch(1, ["a", "b", "c"], failed=["b", "c"])
    assert taken(spark, registry, asked) == ["a", "b", "c"]
    sy.index_tags(spark, registry)
    assert taken(spark, registry, asked) == ["a", "b", "c"]
    batch(2, ["d"], failed=["d"])
    withdraw(["b", "c", "d"], 3)
    assert taken(spark, registry, asked) == ["a"]
    batch(4, ["c", "e"])
    assert taken(spark, registry, asked) == ["a", "c", "e"]
    # A compaction puts old and new together; the next index starts from there.
    sy.compact_releases(spark, releases_path(registry))
    assert taken(spark, registry, asked) == ["a", "c", "e"]
    sy.index_tags(spark, registry)
    batch(5, ["z"])
    assert taken(spark, registry, asked) == ["a", "c", "e", "z"]


def test_a_folder_is_published_against_the_index_of_tags(spark, tmp_path):
    registry, dist = f"file://{tmp_path}/registry", tmp_path / "dist"
    sy.create_registry(spark, registry)
    write_release(dist / "a", "0.4.0")
    write_release(dist / "b", "0.5.0")
    rows = spark.createDataFrame([("a", "v0.4.0", 1), ("b", "v0.5.0", 2)], "release_id string, tag string, arrival bigint")
    sy.publish_folder(spark, CONTRACT, rows.where("release_id = 'a'"), str(dist), registry, 1)
    sy.index_tags(spark, registry)
    released, found = sy.publish_folder(spark, CONTRACT, rows, str(dist), registry, 2)
    assert {(r.release_id, r.rule) for r in found.collect()} == {("a", "tag_not_published")}
    got = {(r.tag, r.seq) for r in released.where("state = 'published'").collect()}
    assert got == {("v0.4.0", 1), ("v0.5.0", 2)}
