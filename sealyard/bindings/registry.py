"""Admission and latest pointer over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealyard import (
    latest_per_channel as latest_of,
    reject_existing as admit,
    reject_indexed as admit_indexed,
    write_key_index,
)
from sealyard.bindings import query, table
from sealyard.plans.publish import tag_violations
from sealyard.session import fresh_folder


@query("""
    SELECT user_id, event_id, event_type, value FROM events WHERE event_type <> 'error'
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_per_channel(spark, sf_dir):
    channel = F.when(F.col("event_type") == "error", "prerelease").otherwise("stable")
    events = table(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type", "value", "ts", channel.alias("channel")
    )
    return latest_of(events, ["user_id"], ["ts", "event_id"]).drop("ts", "channel")


@query("""
    SELECT o_orderkey, o_custkey FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey
""")
def reject_existing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    existing = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    admitted, _ = admit(orders, existing, ["o_orderkey"], ["o_orderkey", "o_custkey"])
    return admitted


@query("""
    SELECT o_orderkey, 7 AS phase, 0::BIGINT AS item_pos, 26 AS rule_ord, 0 AS sub_pos,
           'tag_not_published' AS rule, 'Release ' || o_custkey || ' already exists' AS message
    FROM (SELECT o_orderkey, o_custkey,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
    WHERE n > 1 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
""")
def tag_not_published(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("tag"), "o_orderkey"
    )
    owing = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0)
    existing = owing.select(F.col("c_custkey").alias("tag"))
    _, rejected = admit(orders, existing, ["tag"], ["o_orderkey"])
    return tag_violations(rejected, ["o_orderkey"])


# Tags are NULL in one language and arrivals in another; every document is on one side.
_NULL_TAGS = """
    SELECT doc_id, nullif(lang, 'de') || '/' || source AS tag, nullif(lang, 'fr') AS arrival,
           text FROM documents
"""


@query(f"""
    WITH candidate AS ({_NULL_TAGS}), first AS (
      SELECT doc_id FROM candidate WHERE tag IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY tag ORDER BY arrival NULLS FIRST, doc_id) = 1
    )
    SELECT c.doc_id, f.doc_id IS NOT NULL AND c.tag NOT LIKE '%/src7' AS admitted
    FROM candidate c LEFT JOIN first f ON c.doc_id = f.doc_id
""")
def reject_existing_null_keys(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    tag = F.concat(F.nullif("lang", F.lit("de")), F.lit("/"), "source")
    candidates = documents.select(
        tag.alias("tag"), F.nullif("lang", F.lit("fr")).alias("arrival"), "doc_id"
    )
    taken = documents.where("source = 'src7'").select(tag.alias("tag"))
    admitted, rejected = admit(candidates, taken, ["tag"], ["arrival", "doc_id"])

    def side(df, which):
        return df.select("doc_id", F.lit(which).alias("admitted"))

    return side(admitted, True).unionByName(side(rejected, False))


@query("""
    SELECT o_orderkey, o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND row_number()
      OVER (PARTITION BY o_orderkey ORDER BY o_custkey) = 1 AS admitted
    FROM orders
""")
def reject_indexed(spark, sf_dir):
    """All orders, with whether each is admitted, against an index of the keys that have line items."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    index = write_key_index(lines, fresh_folder(spark, "keys"), ["o_orderkey"])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    admitted, rejected = admit_indexed(orders, index, ["o_custkey"])

    def side(df, which):
        return df.select("o_orderkey", F.lit(which).alias("admitted"))

    return side(admitted, True).unionByName(side(rejected, False))
