"""Reconciling by fingerprint gives what joining all rows gives, and joins only what differs."""

import random

import pytest
from pyspark.sql import functions as F

import sealyard as sy
from sealyard.operators.inventory import differing_groups

EXPECTED, OBSERVED = "g string, name string, size bigint", "g string, name string, size bigint, pos int"


def tables(spark, seed, groups=60):
    """Groups that are equal, in another order, short, long, repeated, changed, absent, or with NULLs."""
    rnd = random.Random(seed)
    expected, observed = [], []
    for g in [None, *map(str, range(groups))]:
        files = [(f"n{i}", rnd.randrange(5)) for i in range(rnd.randrange(1, 6))]
        expected += [(g, n, s) for n, s in files]
        seen = [(n, s) for n, s in files]
        for kind in rnd.sample(range(8), rnd.choice([0, 0, 1, 2])):
            at = rnd.randrange(len(seen)) if seen else None
            if kind == 0 and seen:
                seen.pop(at)
            elif kind == 1:
                seen.append((f"x{rnd.randrange(3)}", 1))
            elif kind == 2 and seen:
                seen[at] = (seen[at][0], rnd.choice([None, 9]))
            elif kind == 3 and seen:
                seen.append((seen[at][0], rnd.randrange(5)))
            elif kind == 4 and seen:
                seen.insert(0, (seen[at][0], 7))
            elif kind == 5:
                seen = []
            elif kind == 6:
                seen.append((None, 1))
            elif kind == 7 and expected:
                expected[-1] = (g, expected[-1][1], None)
        if rnd.random() < 0.3 and len({n for n, _ in seen}) == len(seen):
            rnd.shuffle(seen)
        observed += [(g, n, s, i) for i, (n, s) in enumerate(seen)]
    observed.append(("nobody", "n0", 1, 0))
    return spark.createDataFrame(expected, EXPECTED), spark.createDataFrame(observed, OBSERVED)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("report_extra", [False, True])
def test_the_result_is_that_of_the_row_join(spark, seed, report_extra):
    expected, observed = tables(spark, seed)
    want = sy.reconcile_inventory(expected, observed, ["g", "name"], "size", ["pos"], report_extra)
    got = sy.reconcile_by_fingerprint(expected, observed, ["g"], ["name"], "size", ["pos"], report_extra)
    assert rows(got) == rows(want)
    faults = sy.reconcile_by_fingerprint(expected, observed, ["g"], ["name"], "size", ["pos"], report_extra, only_faults=True)
    assert rows(faults) == rows(want.where("status <> 'ok'")) and faults.count() > 10


def test_equal_groups_are_not_joined(spark):
    same = [(f"g{i % 500}", f"n{i}", i * 10**15) for i in range(3000)]
    expected = spark.createDataFrame(same, EXPECTED)
    observed = spark.createDataFrame([(*row, i) for i, row in enumerate(reversed(same))], OBSERVED)
    one = observed.withColumn("size", F.when(F.col("name") == "n7", 0).otherwise(F.col("size")))
    args = (["g"], ["name"], "size")
    assert differing_groups(expected, observed, *args).count() == 0
    assert rows(differing_groups(expected, one, *args)) == [("g7",)]
    found = sy.reconcile_by_fingerprint(expected, one, *args, ["pos"], only_faults=True)
    assert rows(found) == [("g7", "n7", "mismatch")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = sy.reconcile_by_fingerprint(expected, one, *args, ["pos"], only_faults=True)
        executed = found._jdf.queryExecution().executedPlan()
        found._jdf.collect()
        # Joined by name are the six files of the one group that differs, not the 3000.
        joined = []

        def walk(node):
            if node.nodeName() == "SortMergeJoin" and "LeftSemi" in node.simpleString(1000):
                joined.append(node.metrics().get("numOutputRows").get().value())
            for i in range(node.children().size()):
                walk(node.children().apply(i))

        walk(executed)
        assert sorted(joined) == [6, 6]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_sums_of_many_and_equal_rows_hold(spark):
    many = spark.range(200_000).select(F.lit("g").alias("g"), F.lit("n").alias("name"), F.lit(1).cast("bigint").alias("size"))
    assert differing_groups(many, many, ["g"], ["name"], "size").count() == 0
    assert differing_groups(many, many.limit(199_998), ["g"], ["name"], "size").count() == 1
    empty = many.limit(0)
    assert differing_groups(empty, many, ["g"], ["name"], "size").count() == 0
    assert differing_groups(empty, many, ["g"], ["name"], "size", report_extra=True).count() == 1
