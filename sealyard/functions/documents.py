"""Reading JSON text as VARIANT without guessing a schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sealyard.functions.text import array_of

# NaN, Infinity and -Infinity are accepted, single-quoted strings are not.
_OPTIONS = {"allowSingleQuotes": "false"}
# The parser knows more spellings of infinity than that; outside strings they are errors.
_STRINGS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_OTHER_INFINITIES = r"INF|\+Infinity"


def json_document(raw: Column) -> Column:
    """The one JSON value a text holds, or NULL when it is not exactly one value.

    The parser stops after the first complete value, so text behind it would go
    unseen. The text is therefore read once as array item and once as object value.
    Whatever follows the value breaks one of the two: a bracket ends only one of
    them, and after a comma the one wants a value, the other a key with a colon. An
    empty text is no object value. Each parse is referred to once, as an expression
    used twice in a conditional would be evaluated twice.
    """
    as_item = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "variant", _OPTIONS)
    as_value = F.from_json(F.concat(F.lit('{"k":'), raw, F.lit("}")), "variant", _OPTIONS)
    items = F.try_variant_get(as_item, "$", "array<variant>")
    suspect = raw.rlike(_OTHER_INFINITIES)
    plain = ~suspect | ~F.regexp_replace(raw, _STRINGS, "").rlike(_OTHER_INFINITIES)
    return F.when(F.is_valid_utf8(raw) & plain & as_value.isNotNull(), F.get(items, 0))


def object_fields(value: Column) -> Column:
    """The members of a JSON object as a map; NULL for every other JSON type."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def key_list(fields: Column) -> Column:
    """The keys of an object's members, none when there is no object."""
    return F.coalesce(F.map_keys(fields), F.expr("CAST(array() AS array<string>)"))


def array_items(value: Column) -> Column:
    """The items of a JSON array; NULL for every other JSON type."""
    return F.try_variant_get(value, "$", "array<variant>")


def json_type(value: Column) -> Column:
    return F.schema_of_variant(value)


def string_value(value: Column) -> Column:
    """The text of a JSON string; NULL for numbers, booleans and the rest."""
    return F.when(json_type(value) == "STRING", F.try_variant_get(value, "$", "string"))


def whole_number(value: Column) -> Column:
    """A JSON number without fraction as BIGINT; NULL for text that looks like one."""
    kind = json_type(value)
    number = F.try_variant_get(value, "$", "bigint")
    numeric = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE")
    return F.when(numeric & (F.try_variant_get(value, "$", "double") == number), number)


def missing_keys(fields: Column, keys) -> Column:
    """Those of ``keys`` an object lacks, in order; all of them when it is no object."""
    return F.array_except(array_of(keys), key_list(fields))
