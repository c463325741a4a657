"""Small text expressions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four information separators U+001C..U+001F.
_BLANKS = r"(?U)[\s\x1c-\x1f]+"


def quoted(value: str) -> str:
    """A text as SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_of(values) -> Column:
    """A literal array of texts."""
    return F.expr(f"array({', '.join(quoted(value) for value in values)})")


def split_fields(text: Column) -> Column:
    """Words of a text, split at runs of Unicode white space, without empty ones."""
    return F.array_remove(F.split(text, _BLANKS), "")


def path_parts(path: Column) -> Column:
    """Components of a POSIX path; empty and ``.`` components do not count."""
    return F.array_remove(F.array_remove(F.split(path, "/"), ""), ".")


def strip_slashes(path: Column) -> Column:
    """The path without any trailing slashes."""
    return F.rtrim(path, F.lit("/"))


def base_name(path: Column) -> Column:
    """The last component of a path."""
    return F.substring_index(path, "/", -1)


def parent_name(path: Column) -> Column:
    """The name of the folder a file lies in."""
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def classify_channel(tag: Column) -> Column:
    """``prerelease`` for tags with a hyphen, ``stable`` for all others."""
    return F.when(F.contains(tag, F.lit("-")), "prerelease").when(tag.isNotNull(), "stable")
