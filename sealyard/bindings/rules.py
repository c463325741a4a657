"""Predicates, violations and gates over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealyard import (
    Rule,
    allowed_kind as allowed_kind_of,
    classify_channel as channel_of,
    columns_equal as equal_columns,
    equals_constant as equals,
    first_violation as first_of,
    full_match as matches,
    gate as gate_by,
    gate_rows as gate_rows_by,
    link_allowlist as permitted_link,
    manifest_readable as readable,
    member_property as has_bits,
    nonempty_array as filled_array,
    nonempty_object as filled_object,
    path_parts as parts_of,
    path_root as has_root,
    safe_path as is_safe,
    strict_true as is_true,
    verdicts as verdicts_of,
    violations,
    write_violations as store,
)
from sealyard.bindings import query, table
from sealyard.functions.documents import json_document
from sealyard.functions.text import base_name, parent_name, split_fields, strip_slashes
from sealyard.operators.rules import first_broken as first_broken_of
from sealyard.operators.rules import required_keys_of_text
from sealyard.session import configure, fresh_folder


def document_rules():
    """Three rules that documents break in all combinations."""
    return [
        Rule(
            "size_matches", 1, F.octet_length("text") == F.col("n_chars"), "Size differs"
        ),
        Rule(
            "known_language", 2, F.col("lang").isin("en", "fr"),
            F.concat(F.lit("Unexpected language "), F.col("lang")),
        ),
        Rule(
            "single_digit_source", 3, matches(F.col("source"), r"src\d"),
            F.concat(F.lit("Unexpected source "), F.col("source")), phase=2,
        ),
    ]


_FOUND = r"""
    SELECT * FROM (
      SELECT doc_id, 1 AS phase, 0::BIGINT AS item_pos, 1 AS rule_ord, 0 AS sub_pos,
             'size_matches' AS rule, 'Size differs' AS message
      FROM documents WHERE strlen(text) <> n_chars
      UNION ALL
      SELECT doc_id, 1, 0, 2, 0, 'known_language', 'Unexpected language ' || lang
      FROM documents WHERE lang NOT IN ('en', 'fr')
      UNION ALL
      SELECT doc_id, 2, 0, 3, 0, 'single_digit_source', 'Unexpected source ' || source
      FROM documents WHERE NOT regexp_full_match(source, 'src\p{Nd}')
    )
"""


@query(r"""
    SELECT regexp_full_match(p_brand, 'Brand#\p{Nd}{2}') AS ok, count(*) AS n
    FROM part GROUP BY 1
""")
def full_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.groupBy(matches(F.col("p_brand"), r"Brand#\d{2}").alias("ok")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("SELECT strlen(text) = n_chars AS ok, count(*) AS n FROM documents GROUP BY 1")
def columns_equal(spark, sf_dir):
    ok = equal_columns(F.octet_length("text"), F.col("n_chars"))
    return table(spark, sf_dir, "documents").groupBy(ok.alias("ok")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("SELECT c_mktsegment = 'BUILDING' AS ok, count(*) AS n FROM customer GROUP BY 1")
def equals_constant(spark, sf_dir):
    ok = equals(F.col("c_mktsegment"), "BUILDING")
    return table(spark, sf_dir, "customer").groupBy(ok.alias("ok")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("""
    SELECT event_id, 0::BIGINT AS item_pos, k.key AS missing
    FROM events, (VALUES ('k'), ('revision')) AS k(key)
    WHERE NOT list_contains(json_keys(props), k.key)
""")
def required_keys(spark, sf_dir):
    configure(spark)
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return required_keys_of_text(events, ["event_id"], F.col("props"), ["k", "revision"])


_FLAG_JSON = """CASE event_type WHEN 'click' THEN 'true' WHEN 'view' THEN '"true"'
    WHEN 'error' THEN '1' WHEN 'signup' THEN 'null' ELSE 'false' END"""


@query(f"""
    SELECT event_id, json_type(flag::JSON) = 'BOOLEAN' AND flag = 'true' AS ok
    FROM (SELECT event_id, {_FLAG_JSON} AS flag FROM events)
""")
def strict_true(spark, sf_dir):
    configure(spark)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props").select(
        "event_id", json_document(F.expr(_FLAG_JSON)).alias("flag")
    )
    return events.select("event_id", is_true(F.col("flag")).alias("ok"))


_SERVER_JSON = """CASE event_type WHEN 'click' THEN '{}' WHEN 'view' THEN '[1]'
    WHEN 'error' THEN '"text"' WHEN 'signup' THEN '[]' ELSE props END"""


@query(f"""
    SELECT event_id, json_type(server::JSON) = 'OBJECT'
        AND len(coalesce(json_keys(server), [])) > 0 AS ok
    FROM (SELECT event_id, {_SERVER_JSON} AS server FROM events)
""")
def nonempty_object(spark, sf_dir):
    configure(spark)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props").select(
        "event_id", json_document(F.expr(_SERVER_JSON)).alias("server")
    )
    return events.select("event_id", filled_object(F.col("server")).alias("ok"))


@query(f"""
    SELECT event_id, json_type(items::JSON) = 'ARRAY' AND json_array_length(items) > 0 AS ok
    FROM (SELECT event_id, {_SERVER_JSON} AS items FROM events)
""")
def nonempty_array(spark, sf_dir):
    configure(spark)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props").select(
        "event_id", json_document(F.expr(_SERVER_JSON)).alias("items")
    )
    return events.select("event_id", filled_array(F.col("items")).alias("ok"))


_MANIFEST_TEXT = """CASE event_type WHEN 'click' THEN props || ' x' WHEN 'view' THEN props || '}'
    WHEN 'error' THEN '' WHEN 'signup' THEN ' ' || props || ' ' ELSE props END"""


@query(f"""
    SELECT event_id, json_valid(raw) AS ok
    FROM (SELECT event_id, {_MANIFEST_TEXT} AS raw FROM events)
""")
def manifest_readable(spark, sf_dir):
    configure(spark)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props").select(
        "event_id", F.expr(_MANIFEST_TEXT).alias("raw")
    )
    return events.select("event_id", readable(F.col("raw")).alias("ok"))


@query("""
    SELECT event_type, count(*) AS n FROM events
    WHERE event_type NOT IN ('click', 'view') GROUP BY 1
""")
def allowed_kind(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    outside = events.where(~allowed_kind_of(F.col("event_type"), ("click", "view")))
    return outside.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT page_id, parts[1] IS DISTINCT FROM '..' AND NOT list_contains(parts, '..')
        AND NOT starts_with(path, '/') AS ok, array_to_string(parts, '|') AS parts
    FROM (
      SELECT page_id, path,
             list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')) AS parts
      FROM (SELECT page_id, replace(url, 'http:/', '..') AS path FROM pages)
    )
""")
def safe_path(spark, sf_dir):
    path = F.replace(F.col("url"), F.lit("http:/"), F.lit(".."))
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return pages.select(
        "page_id",
        is_safe(F.col("path")).alias("ok"),
        F.concat_ws("|", parts_of(F.col("path"))).alias("parts"),
    )


@query("""
    SELECT page_id, coalesce(
        list_filter(string_split(url, '/'), lambda x: x NOT IN ('', '.'))[1] = 'https:', false
    ) AS ok FROM pages
""")
def path_root(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", has_root(F.col("url"), F.lit("https:")).alias("ok"))


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem
    WHERE (l_returnflag, l_linestatus) NOT IN (('A', 'F'), ('N', 'O')) GROUP BY 1, 2
""")
def link_allowlist(spark, sf_dir):
    pairs = [("A", "F"), ("N", "O")]
    ok = permitted_link(F.lit("symlink"), F.col("l_returnflag"), F.col("l_linestatus"), pairs)
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.where(~ok).groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("SELECT (p_size & 9) <> 0 AS ok, count(*) AS n FROM part GROUP BY 1")
def member_property(spark, sf_dir):
    ok = has_bits(F.col("p_size"), 9)
    return table(spark, sf_dir, "part").groupBy(ok.alias("ok")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("""
    SELECT page_id, CASE WHEN contains(url, '-') THEN 'prerelease' ELSE 'stable' END AS channel
    FROM pages
""")
def classify_channel(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", channel_of(F.col("url")).alias("channel")
    )


@query("""
    SELECT page_id, string_split(url, '/')[-1] AS base_name, rtrim(url, '/') AS stripped,
           string_split(url, '/')[-2] AS parent
    FROM pages
""")
def path_functions(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        base_name(url).alias("base_name"),
        strip_slashes(url).alias("stripped"),
        parent_name(url).alias("parent"),
    )


# The white space of the word split, spelled out for the other engine.
_BLANKS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
    r"\x{3000}]+"
)


@query(rf"""
    SELECT doc_id, len(words)::INTEGER AS n, sha256(array_to_string(words, '|')) AS joined
    FROM (
      SELECT doc_id, list_filter(regexp_split_to_array(text, '{_BLANKS}'),
                                 lambda x: x <> '') AS words
      FROM documents
    )
""")
def split_text_fields(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", "text").select(
        "doc_id", split_fields(F.col("text")).alias("words")
    )
    return words.select(
        "doc_id", F.size("words").alias("n"), F.sha2(F.concat_ws("|", "words"), 256).alias("joined")
    )


@query(_FOUND)
def write_violations(spark, sf_dir):
    found = violations(table(spark, sf_dir, "documents"), ["doc_id"], document_rules())
    return store(found, fresh_folder(spark, "violations"))


@query(f"""
    SELECT doc_id, rule, message FROM ({_FOUND})
    QUALIFY row_number() OVER (PARTITION BY doc_id
                               ORDER BY phase, item_pos, rule_ord, sub_pos) = 1
""")
def first_violation(spark, sf_dir):
    found = violations(table(spark, sf_dir, "documents"), ["doc_id"], document_rules())
    return first_of(found, ["doc_id"])


@query(r"""
    SELECT doc_id, CASE WHEN strlen(text) <> n_chars THEN 'size_matches'
                        WHEN lang NOT IN ('en', 'fr') THEN 'known_language'
                        WHEN NOT regexp_full_match(source, 'src\p{Nd}')
                        THEN 'single_digit_source' END AS rule
    FROM documents
""")
def first_broken(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", first_broken_of(document_rules()).alias("rule")
    )


@query(f"""
    SELECT d.doc_id, f.doc_id IS NULL AS passed, coalesce(f.n, 0) AS n_violations,
           f.rule, f.message
    FROM documents d LEFT JOIN (
      SELECT doc_id, rule, message, count(*) OVER (PARTITION BY doc_id) AS n FROM ({_FOUND})
      QUALIFY row_number() OVER (PARTITION BY doc_id
                                 ORDER BY phase, item_pos, rule_ord, sub_pos) = 1
    ) f ON d.doc_id = f.doc_id
""")
def verdicts(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return verdicts_of(
        documents, violations(documents, ["doc_id"], document_rules()), ["doc_id"]
    )


@query("""
    SELECT source, lang, count(*) FILTER (strlen(text) <> n_chars) AS n_violations,
           count(*) FILTER (strlen(text) <> n_chars) = 0 AS passed
    FROM documents GROUP BY 1, 2
""")
def gate(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    key = ["source", "lang"]
    found = violations(documents, key, document_rules()[:1])
    return gate_by(documents.select(*key).distinct(), found, key)


@query(f"""
    SELECT d.source, d.lang, count(DISTINCT d.doc_id) AS n_rows, count(f.doc_id) AS n_violations,
           count(f.doc_id) = 0 AS passed
    FROM documents d LEFT JOIN ({_FOUND}) f ON d.doc_id = f.doc_id GROUP BY 1, 2
""")
def gate_rows(spark, sf_dir):
    return gate_rows_by(table(spark, sf_dir, "documents"), ["source", "lang"], document_rules())


# The same gates where a key of the subjects may be NULL: one language is taken away.
@query("""
    SELECT source, nullif(lang, 'de') AS lang,
           count(*) FILTER (strlen(text) <> n_chars) AS n_violations,
           count(*) FILTER (strlen(text) <> n_chars) = 0 AS passed
    FROM documents GROUP BY 1, 2
""")
def gate_null_keys(spark, sf_dir):
    documents = _without_german(spark, sf_dir)
    key = ["source", "lang"]
    found = violations(documents, key, document_rules()[:1])
    return gate_by(documents.select(*key).distinct(), found, key)


@query(r"""
    WITH found AS (
      SELECT source, nullif(lang, 'de') AS lang, 1 AS rule_ord, 'size_matches' AS rule
      FROM documents WHERE strlen(text) <> n_chars
      UNION ALL
      SELECT source, nullif(lang, 'de'), 2, 'known_language' FROM documents
      WHERE nullif(lang, 'de') IS NULL OR lang NOT IN ('en', 'fr')
    ), summary AS (
      SELECT source, lang, count(*) AS n_violations, arg_min(rule, rule_ord) AS rule
      FROM found GROUP BY 1, 2
    )
    SELECT s.source, s.lang, f.rule IS NULL AS passed, coalesce(f.n_violations, 0) AS n_violations, f.rule
    FROM (SELECT DISTINCT source, nullif(lang, 'de') AS lang FROM documents) s
    LEFT JOIN summary f ON s.source = f.source AND s.lang IS NOT DISTINCT FROM f.lang
""")
def verdicts_null_keys(spark, sf_dir):
    documents = _without_german(spark, sf_dir)
    key = ["source", "lang"]
    found = violations(documents, key, document_rules()[:2])
    judged = verdicts_of(documents.select(*key).distinct(), found, key)
    return judged.drop("message")


def _without_german(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.withColumn("lang", F.nullif("lang", F.lit("de")))
