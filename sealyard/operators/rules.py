"""Rules as data: from row predicates to violations, verdicts and gates.

A violation row is the key columns followed by
``phase, item_pos, rule_ord, sub_pos, rule, message``. The four numbers put the
violations of one subject into the order in which a sequential check meets them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealyard.functions.documents import json_document, missing_keys, object_fields
from sealyard.functions.text import array_of, quoted
from sealyard.operators.keys import join_on_keys
from sealyard.session import configure, stored

ORDER = ("phase", "item_pos", "rule_ord", "sub_pos")
FINDING = (*ORDER, "rule", "message")


def _column(value: Column | str | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


@dataclass(frozen=True, eq=False)
class Rule:
    """One requirement on a row. ``holds`` being NULL means it is not met."""

    name: str
    ord: int
    holds: Column
    message: Column | str | None = None
    phase: int = 1
    item_pos: Column | int = 0
    sub_pos: int = 0

    @property
    def broken(self) -> Column:
        return ~F.coalesce(self.holds, F.lit(False))

    @property
    def finding(self) -> Column:
        """The violation as a struct; what the rule itself fixes is one literal."""
        fixed = (
            f"named_struct('phase', {self.phase}, 'rule_ord', {self.ord}, "
            f"'sub_pos', {self.sub_pos}, 'rule', {quoted(self.name)})"
        )
        if not isinstance(self.item_pos, Column) and not isinstance(self.message, Column):
            message = "CAST(NULL AS string)" if self.message is None else quoted(self.message)
            position = f"CAST({self.item_pos} AS bigint)"
            return F.expr(
                f"named_struct('fixed', {fixed}, 'item_pos', {position}, 'message', {message})"
            )
        position = self.item_pos if isinstance(self.item_pos, Column) else F.lit(self.item_pos)
        return F.struct(
            F.expr(f"{fixed} AS fixed"),
            position.cast("bigint").alias("item_pos"),
            _column(self.message).alias("message"),
        )


def violations(df: DataFrame, key: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """All violations of all rules, from one pass over ``df`` and without a shuffle."""
    findings = F.array(*[F.when(rule.holds, None).otherwise(rule.finding) for rule in rules])
    return (
        df.select(*key, F.explode(findings).alias("finding"))
        .where("finding IS NOT NULL")
        .selectExpr(
            *[f"`{name}`" for name in key],
            "finding.fixed.phase",
            "finding.item_pos",
            "finding.fixed.rule_ord",
            "finding.fixed.sub_pos",
            "finding.fixed.rule",
            "finding.message",
        )
    )


def required_keys(
    df: DataFrame,
    key: Sequence[str],
    column: Column,
    keys: Sequence[str],
    item_pos: Column | int = 0,
) -> DataFrame:
    """One row ``key, item_pos, missing`` per key a JSON object lacks; values are free.

    ``column`` is a VARIANT. What is no object lacks all keys.
    """
    return df.select(
        *key,
        (item_pos if isinstance(item_pos, Column) else F.lit(item_pos))
        .cast("bigint")
        .alias("item_pos"),
        F.explode(missing_keys(object_fields(column), keys)).alias("missing"),
    )


def required_keys_of_text(
    df: DataFrame, key: Sequence[str], raw: Column, keys: Sequence[str]
) -> DataFrame:
    """``required_keys`` over a column of JSON text."""
    configure(df.sparkSession)
    parsed = df.select(*key, json_document(raw).alias("_document"))
    return required_keys(parsed, key, F.col("_document"), keys)


def missing_key_violations(
    missing: DataFrame, key: Sequence[str], rule: str, ord: int, phase: int, keys, message: Column
) -> DataFrame:
    """The rows of ``required_keys`` as violations, in the order the keys are listed."""
    return missing.select(
        *key,
        F.lit(phase).cast("int").alias("phase"),
        "item_pos",
        F.lit(ord).cast("int").alias("rule_ord"),
        (F.array_position(array_of(keys), F.col("missing")) - 1).cast("int").alias("sub_pos"),
        F.lit(rule).alias("rule"),
        message.alias("message"),
    )


def write_violations(found: DataFrame, path: str) -> DataFrame:
    """Store all violations as a table and go on from the stored rows."""
    return stored(found, path)


def gate(subjects: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, n_violations, passed`` per subject. Counts are partial before the shuffle.

    ``subjects`` has one row per key; a NULL in a key is a value like any other, so that
    a subject without a proper key fails with its violations.
    """
    counts = found.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0).cast("bigint"))
    return join_on_keys(subjects.select(*key), counts, key, "left").select(
        *key, n.alias("n_violations"), (n == 0).alias("passed")
    )


def gate_rows(df: DataFrame, key: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """``key, n_rows, n_violations, passed`` per group of rows of one table.

    Same verdict as ``gate`` over ``violations``, but in one scan and one
    aggregation, as rules of a single table need neither rows per finding nor a join.
    """
    broken = F.lit(0).cast("bigint")
    for rule in rules:
        broken = broken + F.sum(rule.broken.cast("bigint"))
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n_rows"), broken.alias("n_violations"))
        .withColumn("passed", F.col("n_violations") == 0)
    )


def first_violation(found: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, rule, message`` of the violation a sequential check would stop at."""
    return (
        found.groupBy(*key)
        .agg(F.min_by(F.struct("rule", "message"), F.struct(*ORDER)).alias("first"))
        .select(*key, "first.*")
    )


def first_broken(rules: Sequence[Rule], label: str = "name") -> Column:
    """The first broken rule of a row, in rule order, or NULL; needs no shuffle at all.

    The order is that of ``first_violation``, and has to be known before any row is.
    """
    if any(isinstance(rule.item_pos, Column) for rule in rules):
        raise ValueError("positions that differ by row have no fixed order of rules")
    ordered = sorted(rules, key=lambda r: (r.phase, r.item_pos, r.ord, r.sub_pos))
    pick = (lambda r: F.lit(r.name)) if label == "name" else (lambda r: _column(r.message))
    return F.coalesce(*[F.when(rule.broken, pick(rule)) for rule in ordered])


def verdicts(subjects: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """Gate and first violation of every subject, one row per key, from one aggregation."""
    summary = found.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(F.struct("rule", "message"), F.struct(*ORDER)).alias("_first"),
    )
    n = F.coalesce(F.col("_n"), F.lit(0).cast("bigint"))
    return join_on_keys(subjects.select(*key), summary, key, "left").select(
        *key,
        (n == 0).alias("passed"),
        n.alias("n_violations"),
        F.col("_first.rule").alias("rule"),
        F.col("_first.message").alias("message"),
    )
