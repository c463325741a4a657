"""Connected components of a links table, by contraction in shuffles; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealyard.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``links`` (``a``, ``b``): the smallest node it is connected with.

    Large-star and small-star rounds in turn: each node's neighbours are linked to the smallest of them, until
    every node is linked to its component's smallest only. A hot node is one row per task before a shuffle, as
    minima are combined first. Every round is written to the shared folder, so a lost executor costs one round.
    """
    edges = materialise(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    )
    last = None
    while True:
        # Large star: neighbours above a node go to the smallest around it, itself included.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        # Small star: neighbours below a node, and the node, go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        edges = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        # Edges are distinct, so none cancels another out; sums of ids could overflow.
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if state == last:
            break
        last = state
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
