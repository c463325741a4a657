"""The append-only release registry: admission and the latest pointer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealyard.operators.aggregates import last_wins
from sealyard.session import materialise


def reject_existing(
    candidates: DataFrame, releases: DataFrame, key: Sequence[str], arrival: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """``(admitted, rejected)``: a key is admitted once, in whatever state it exists.

    Of several candidates for one key the first by ``arrival`` counts; ``arrival``
    should tell candidates apart. A key with a NULL in it can't be published and is
    rejected. Candidates are written once, with a number each; the rejected are those
    whose number is not among the admitted, so every row is on one side, whatever its
    types, and no join sees a hot key. Both sides shrink to one row per key before they
    meet: an outer join with a null test keeps that order of steps, while an anti join
    would be moved below the aggregation, onto all candidates.
    """
    key, arrival = list(key), list(arrival)
    taken = releases.select(*key).distinct().withColumn("_taken", F.lit(True))
    numbered = materialise(candidates.withColumn("_row", F.monotonically_increasing_id()))
    whole = numbered
    for name in key:
        whole = whole.where(F.col(f"`{name}`").isNotNull())

    def first(rows: DataFrame) -> DataFrame:
        found = last_wins(rows, key, arrival, earliest=True).join(taken, key, "left")
        return found.where(F.col("_taken").isNull())

    columns = [F.col(f"`{name}`") for name in candidates.columns]
    in_order = whole.select(*dict.fromkeys([*key, *arrival, "_row"]))
    rejected = numbered.join(first(in_order).select("_row"), "_row", "left_anti")
    return first(whole).select(*columns), rejected.select(*columns)


def latest_per_channel(
    releases: DataFrame, key: Sequence[str], order: Sequence[str], channel: str | None = "stable"
) -> DataFrame:
    """The row published last per key, by publish order and not by version.

    With ``channel`` only that channel counts; with None every row does.
    """
    if channel is not None:
        releases = releases.where(F.col("channel") == channel)
    return last_wins(releases, key, order)


def resolve_latest(
    releases: DataFrame,
    inventory: DataFrame,
    key: Sequence[str],
    product: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """The files a client gets: the latest published stable release, joined to its files."""
    published = releases.where(F.col("state") == "published")
    latest = latest_per_channel(published, product, order)
    return latest.join(inventory, list(key), "inner")


def manifest_and_archive(resolved: DataFrame, product: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """``product, manifest, archive``: of each resolved release the two files a client reads.

    ``resolved`` has one row per file with its ``kind``; both results are structs of the
    columns ``carry``. A release that lacks one of the two has NULL there.
    """

    def of(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.struct(*carry))).alias(kind)

    return resolved.groupBy(*product).agg(of("manifest"), of("archive"))
