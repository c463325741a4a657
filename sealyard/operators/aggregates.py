"""Aggregations per key. All of them combine before the shuffle, so a key that
holds a third of the rows still reaches the reducer as one row per map task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealyard.functions.text import strip_slashes


def any_row(df: DataFrame, key: Sequence[str], predicate: Column) -> DataFrame:
    """``key, ok``: at least one row of the key satisfies the predicate."""
    return df.groupBy(*key).agg(F.bool_or(F.coalesce(predicate, F.lit(False))).alias("ok"))


def all_rows(df: DataFrame, key: Sequence[str], predicate: Column) -> DataFrame:
    """``key, ok``: every row of the key satisfies the predicate."""
    return df.groupBy(*key).agg(F.bool_and(F.coalesce(predicate, F.lit(False))).alias("ok"))


def require_any_prefix(
    df: DataFrame, key: Sequence[str], name: Column, prefix: Column
) -> DataFrame:
    """``key, ok``: at least one name lies strictly below the folder ``prefix``."""
    return any_row(df, key, strip_slashes(name).startswith(prefix))


def last_wins(
    df: DataFrame, key: Sequence[str], order: Sequence[str], earliest: bool = False
) -> DataFrame:
    """One row per key: the one that sorts last by ``order`` (first with ``earliest``).

    ``order`` must tell the rows of a key apart, else the choice is open.
    """
    rest = [name for name in df.columns if name not in key]
    if not rest:
        return df.distinct()
    pick = F.min_by if earliest else F.max_by
    return (
        df.groupBy(*key)
        .agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*key, "_row.*")
        .select(*df.columns)
    )
