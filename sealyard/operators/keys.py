"""Joins on keys of which any column may be NULL: NULL is a key value like others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on_keys(left: DataFrame, right: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """``left`` with the other columns of ``right``; the key columns are those of ``left``."""
    apart = {name: f"_key_{i}" for i, name in enumerate(key)}
    renamed = right.withColumnsRenamed(apart)
    same = F.lit(True)
    for name, other in apart.items():
        same &= F.col(f"`{name}`").eqNullSafe(F.col(other))
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*apart.values())
