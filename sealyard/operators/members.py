"""Rules on archive members, and on the members an archive must have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_members(
    members: DataFrame, subjects: DataFrame, key: Sequence[str], name: Column, required: Sequence
) -> DataFrame:
    """``key, missing``: the required names a subject has no member for.

    Which required names occur is folded into flags per key before the shuffle;
    rows with other names never leave the scan. No subject x name product is
    joined: the flags are unfolded after the join.
    """
    key = list(key)
    flags = [F.bool_or(name == F.lit(value)).alias(f"_has{i}") for i, value in enumerate(required)]
    seen = members.where(name.isin(*required)).groupBy(*key).agg(*flags)
    absent = F.array(
        *[
            F.when(~F.coalesce(F.col(f"_has{i}"), F.lit(False)), F.lit(value))
            for i, value in enumerate(required)
        ]
    )
    return (
        subjects.select(*key)
        .join(seen, key, "left")
        .select(*key, F.explode(absent).alias("missing"))
        .where(F.col("missing").isNotNull())
    )
