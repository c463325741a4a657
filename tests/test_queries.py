"""Every registered query against its SQL in DuckDB, and plans that hold at scale."""

import re

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES = contract.queries()
SQL = contract.oracle_sql()
NO_SQL = {name for name in QUERIES if re.match(r"op\d+_|pipeline", name)}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def test_sql_is_given_wherever_it_can_be():
    assert set(QUERIES) - set(SQL) <= NO_SQL and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(SQL) - NO_SQL))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(SQL[name])
    want = normal([d[0] for d in result.description], result.fetchall())
    got = normal(df.columns, [tuple(row) for row in df.collect()])
    assert got == want and got[1]


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "rule" in df.columns


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written_plans(monkeypatch):
    """Plans of the tables a query writes on its way, beside its own."""
    import sealyard.session

    plans, stored = [], sealyard.session.stored

    def noted(df, path):
        plans.append(plan_of(df))
        return stored(df, path)

    monkeypatch.setattr(sealyard.session, "stored", noted)
    return plans


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NO_SQL))
def test_no_product_of_rows(spark, sf_dir, name, written_plans):
    own = plan_of(QUERIES[name](spark, sf_dir))
    for plan in [own, *written_plans]:
        for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "RoundRobinPartitioning"):
            assert operator not in plan
        assert "SinglePartition" not in plan


@pytest.mark.parametrize(
    "name",
    ["gate", "gate_rows", "first_violation", "last_wins", "latest_per_channel", "any_row",
     "all_rows", "duplicate_digest", "require_members", "reject_existing"],
)
def test_aggregations_combine_before_the_shuffle(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    below = plan.split("Exchange hashpartitioning", 1)[1]
    assert re.match(r".*\n[^\n]*(Hash|Sort)Aggregate", below), plan


def test_scans_read_only_what_is_asked(spark, sf_dir):
    def schema_of(name):
        return re.findall(r"ReadSchema: struct<(.*?)>", plan_of(QUERIES[name](spark, sf_dir)))

    assert schema_of("full_match") == ["p_brand:string"]
    assert schema_of("asset_present") == ["doc_id:bigint"] * 2
    assert sorted(schema_of("reconcile_inventory")) == ["doc_id:bigint", "doc_id:bigint,quality:int"]
    plan = plan_of(QUERIES["require_members"](spark, sf_dir))
    assert "PushedFilters: [In(l_linenumber, [1,2])" in plan


def test_joins_without_broadcast_share_partitionings(spark, sf_dir):
    """Beyond the broadcast size a check of admission shuffles each side once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES["reject_existing"](spark, sf_dir))
        assert plan.count("Exchange hashpartitioning") == 2, plan
        plan = plan_of(QUERIES["verify_digests"](spark, sf_dir))
        assert plan.count("Exchange hashpartitioning") == 3 and "sha2(" not in plan, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
