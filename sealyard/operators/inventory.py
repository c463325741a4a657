"""Which files a release should have, and how that compares with what is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealyard.operators.aggregates import last_wins
from sealyard.operators.keys import join_on_keys


def expected_inventory(
    releases: DataFrame,
    key: Sequence[str],
    base: Column,
    files: Sequence[tuple[str, Column | str]],
    carry: Sequence[str] = (),
) -> DataFrame:
    """``key, ord, kind, name`` plus ``carry``: the files derived from each release.

    ``files`` lists (kind, suffix) in inventory order. A suffix given as Column
    stands for the whole name. The list is inlined, so no join takes place.
    """
    entries = []
    for ord, (kind, suffix) in enumerate(files):
        name = suffix if isinstance(suffix, Column) else F.concat(base, F.lit(suffix))
        entries.append(
            F.struct(F.lit(ord).alias("ord"), F.lit(kind).alias("kind"), name.alias("name"))
        )
    exploded = F.explode(F.array(*entries)).alias("entry")
    return releases.select(*key, *carry, exploded).select(*key, "entry.*", *carry)


def inventory_order(inventory: DataFrame, key: Sequence[str]) -> DataFrame:
    """Inventory sorted for output: release by release, files in contract order."""
    return inventory.orderBy(*key, "ord")


def reconcile_inventory(
    expected: DataFrame,
    observed: DataFrame,
    key: Sequence[str],
    compare: str,
    order: Sequence[str] = (),
    report_extra: bool = False,
) -> DataFrame:
    """``key, status`` with status ok, missing, mismatch (or extra, when asked for).

    ``order`` settles repeated observations: the last one counts. Without it the key
    must be unique among the observed, as in the expected rows. Observed files
    nobody expects are no fault; ``report_extra`` merely lists them.
    """
    key = list(key)
    if order:
        observed = last_wins(observed.select(*key, compare, *order), key, order)
    left = expected.select(*key, F.col(compare).alias("_want"), F.lit(True).alias("_expected"))
    right = observed.select(*key, F.col(compare).alias("_have"), F.lit(True).alias("_observed"))
    status = (
        F.when(F.col("_expected").isNull(), "extra")
        .when(F.col("_observed").isNull(), "missing")
        .when(F.col("_want") == F.col("_have"), "ok")
        .otherwise("mismatch")
    )
    how = "full_outer" if report_extra else "left"
    return left.join(right, key, how).select(*key, status.alias("status"))


def _fingerprints(rows: DataFrame, group: Sequence[str], name: Sequence[str], compare: str, prefix: str) -> DataFrame:
    """Per group a hash of its rows in any order, as sums that combine before the shuffle and cannot overflow."""
    columns = [*name, compare]
    whole = F.lit(True)
    for column in [*group, *columns]:
        whole = whole & F.col(f"`{column}`").isNotNull()
    sums = [F.count("*"), F.count_if(whole)]
    for seed in (1, 2):
        value = F.xxhash64(*[f"`{column}`" for column in columns], F.lit(seed))
        sums += [F.sum(F.shiftrightunsigned(value, 32)), F.sum(value.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return rows.groupBy(*group).agg(*[column.alias(f"{prefix}{i}") for i, column in enumerate(sums)])


def differing_groups(
    expected: DataFrame, observed: DataFrame, group: Sequence[str], name: Sequence[str], compare: str,
    report_extra: bool = False,
) -> DataFrame:
    """The groups whose expected and observed rows are not the same (name, value) pairs, each once.

    Two groups that differ pass as the same with the chance that two 64-bit hashes of all their rows agree. A group
    with a NULL in its key, a name or a value differs always, as NULL equals nothing.
    """
    left, right = (_fingerprints(df, group, name, compare, p) for df, p in ((expected, "_w"), (observed, "_h")))
    both = join_on_keys(left.withColumn("_left", F.lit(True)), right, group, "left")
    same = F.col("_w0") == F.col("_w1")
    for i in range(6):
        same = same & (F.col(f"_w{i}") == F.col(f"_h{i}"))
    found = both.where(~F.coalesce(same, F.lit(False))).select(*group)
    if report_extra:
        found = found.unionByName(join_on_keys(right, left, group, "left_anti").select(*group))
    return found


def reconcile_by_fingerprint(
    expected: DataFrame,
    observed: DataFrame,
    group: Sequence[str],
    name: Sequence[str],
    compare: str,
    order: Sequence[str] = (),
    report_extra: bool = False,
    only_faults: bool = False,
) -> DataFrame:
    """``reconcile_inventory`` by ``group`` and ``name``, with row joins for groups that differ only.

    Groups of which all is as expected, usually nearly all, are settled by a hash of their rows, one row a group and
    task. A repeated observation makes its group differ, so the last one counts as ever. With ``only_faults`` nothing
    is said of what is well, and rows of such groups go nowhere.
    """
    group, name = list(group), list(name)
    changed = differing_groups(expected, observed, group, name, compare, report_extra)
    some = [join_on_keys(df, changed, group, "left_semi") for df in (expected, observed)]
    status = reconcile_inventory(*some, [*group, *name], compare, order, report_extra)
    if only_faults:
        return status.where("status <> 'ok'")
    same = join_on_keys(expected, changed, group, "left_anti").select(*group, *name, F.lit("ok").alias("status"))
    return status.unionByName(same)
