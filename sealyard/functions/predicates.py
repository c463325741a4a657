"""Row predicates of the rule set. NULL counts as a failure once a Rule wraps them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sealyard.functions.documents import (
    array_items,
    json_document,
    object_fields,
)
from sealyard.functions.text import path_parts

FILE, DIRECTORY, SYMLINK = "file", "directory", "symlink"


def full_match(column: Column, pattern: str) -> Column:
    """The whole text matches; a final newline is not forgiven, digits are Unicode."""
    return column.rlike(rf"(?U)\A(?:{pattern})\z")


def columns_equal(left: Column, right: Column) -> Column:
    """Both sides are there and equal."""
    return F.coalesce(left == right, F.lit(False))


def equals_constant(column: Column, constant) -> Column:
    return F.coalesce(column == F.lit(constant), F.lit(False))


def strict_true(value: Column) -> Column:
    """JSON ``true`` itself, not 1 and not the text "true", which prints with quotes."""
    return F.coalesce(F.to_json(value) == "true", F.lit(False))


def nonempty_object(value: Column) -> Column:
    return F.coalesce(F.size(object_fields(value)) > 0, F.lit(False))


def nonempty_array(value: Column) -> Column:
    return F.coalesce(F.size(array_items(value)) > 0, F.lit(False))


def manifest_readable(raw: Column) -> Column:
    """The text is valid UTF-8 and holds exactly one JSON value."""
    return json_document(raw).isNotNull()


def safe_path(path: Column, parts: Column | None = None) -> Column:
    """Not absolute, and no ``..`` component. ``parts`` saves splitting the path again."""
    parts = path_parts(path) if parts is None else parts
    return ~path.startswith("/") & ~F.array_contains(parts, "..")


def path_root(path: Column, root: Column, parts: Column | None = None) -> Column:
    """The first component is ``root``; an empty path has none and fails."""
    parts = path_parts(path) if parts is None else parts
    return F.coalesce(F.get(parts, F.lit(0)) == root, F.lit(False))


def allowed_kind(kind: Column, kinds=(FILE, DIRECTORY, SYMLINK)) -> Column:
    return kind.isin(*kinds)


def link_allowlist(kind: Column, name: Column, target: Column, pairs) -> Column:
    """Whatever is no symlink passes; a symlink must be one of the (name, target) pairs.

    The pairs may be Columns, so that a permitted name can depend on the row.
    """
    permitted = F.lit(False)
    for pair_name, pair_target in pairs:
        permitted = permitted | ((name == pair_name) & (target == pair_target))
    return (kind != SYMLINK) | permitted


def member_property(value: Column, mask: int) -> Column:
    """At least one bit of ``mask`` is set."""
    return value.bitwiseAND(F.lit(mask)) != 0
