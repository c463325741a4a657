"""Digests, inventories and aggregates over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealyard import (
    reconcile_by_fingerprint as reconcile_grouped,
    all_rows as all_of,
    any_row as any_of,
    content_digest as digest_of,
    expected_inventory as inventory_of,
    inventory_order as in_order,
    last_wins as last_of,
    reconcile_inventory as reconcile,
    require_any_prefix as any_below,
    require_members as require,
    split_fields,
    verify_digests as verify,
    violations,
)
from sealyard.bindings import query, table
from sealyard.operators.digests import asset_rules
from sealyard.operators.digests import sidecar_matches as says
from sealyard.plans.publish import upload_violations
from sealyard.session import configure, fresh_folder, materialise
from sealyard.sources.bucketed import write_bucketed
from sealyard.sources.files import parse_uploads, scan_models as models_of

_SUFFIXES = [
    ("archive", ".tar.gz"),
    ("archive_sidecar", ".tar.gz.sha256"),
    ("image", ".dmg"),
    ("image_sidecar", ".dmg.sha256"),
]


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", digest_of(F.col("text")).alias("sha256")
    )


@query("""
    SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def duplicate_digest(spark, sf_dir):
    digests = table(spark, sf_dir, "documents").select(digest_of(F.col("text")).alias("sha256"))
    return digests.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def _inventory_of_parts(spark, sf_dir):
    base = F.concat(F.lit("part-"), F.col("p_partkey"), F.lit("-"), F.col("p_type"))
    files = [("manifest", F.lit("release.json")), *_SUFFIXES]
    return inventory_of(table(spark, sf_dir, "part"), ["p_partkey"], base, files)


_INVENTORY = """
    SELECT p_partkey, k.ord, k.kind,
           CASE k.ord WHEN 0 THEN 'release.json'
                      ELSE 'part-' || p_partkey || '-' || p_type || k.suffix END AS name
    FROM part, (VALUES (0, 'manifest', ''), (1, 'archive', '.tar.gz'),
                       (2, 'archive_sidecar', '.tar.gz.sha256'), (3, 'image', '.dmg'),
                       (4, 'image_sidecar', '.dmg.sha256')) AS k(ord, kind, suffix)
"""


@query(_INVENTORY)
def expected_inventory(spark, sf_dir):
    return _inventory_of_parts(spark, sf_dir)


@query(_INVENTORY + " ORDER BY p_partkey, ord")
def inventory_order(spark, sf_dir):
    return in_order(_inventory_of_parts(spark, sf_dir), ["p_partkey"])


@query("""
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing'
                          WHEN l.quality = 1 THEN 'ok' ELSE 'mismatch' END AS status
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def reconcile_inventory(spark, sf_dir):
    expected = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("quality"))
    return reconcile(expected, table(spark, sf_dir, "labels"), ["doc_id"], "quality")


@query("""
    SELECT coalesce(d.doc_id, c.conv_id) AS doc_id,
           CASE WHEN d.doc_id IS NULL THEN 'extra' WHEN c.conv_id IS NULL THEN 'missing'
                WHEN c.role = 'assistant' THEN 'ok' ELSE 'mismatch' END AS status
    FROM documents d FULL OUTER JOIN (
      SELECT conv_id * 11 AS conv_id, role FROM conversations
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1
    ) c ON d.doc_id = c.conv_id
""")
def reconcile_with_extras(spark, sf_dir):
    expected = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("assistant").alias("role")
    )
    observed = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 11).alias("doc_id"), "role", "turn"
    )
    return reconcile(expected, observed, ["doc_id"], "role", ["turn"], report_extra=True)


# The form in which a checksum file states digest and name, by language.
_SIDECAR_TEXT = """CASE lang
    WHEN 'en' THEN concat(sha, '  ', name, chr(10)) WHEN 'fr' THEN concat(sha, chr(160), name)
    WHEN 'de' THEN concat(sha, ' *', name) ELSE concat(name, chr(9), sha) END"""


def _document_assets(spark, sf_dir):
    name = F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", name.alias("name"), digest_of(F.col("text")).alias("sha")
    )


_ASSETS = """SELECT doc_id, lang, source, 'doc-' || doc_id || '.txt' AS name,
                    sha256(text) AS sha FROM documents"""


@query(rf"""
    SELECT doc_id, list_filter(regexp_split_to_array(raw, '[\t-\r\x1c-\x20\x{{85}}\x{{a0}}]+'),
                               lambda x: x <> '') = [sha, name] AS ok
    FROM (SELECT doc_id, sha, name, {_SIDECAR_TEXT} AS raw FROM ({_ASSETS}))
""")
def sidecar_matches(spark, sf_dir):
    # Spark's chr() ends at 255, which covers the no-break space.
    assets = _document_assets(spark, sf_dir)
    fields = split_fields(F.expr(_SIDECAR_TEXT))
    return assets.select("doc_id", says(fields, F.col("sha"), F.col("name")).alias("ok"))


# Documents of one source have no asset; two languages have a faulty checksum file, and
# for another source the manifest claims the digest in upper case.
_DIGEST_FINDINGS = f"""
    WITH asset AS ({_ASSETS})
    SELECT * FROM (
      SELECT doc_id, 3 AS phase, 0::BIGINT AS item_pos, 13 AS rule_ord, 0 AS sub_pos,
             'asset_present' AS rule, 'No such file: ' || name AS message
      FROM asset WHERE source = 'src7'
      UNION ALL
      SELECT doc_id, 3, 0, 14, 0, 'sidecar_matches', 'Invalid checksum for ' || name
      FROM asset WHERE source <> 'src7' AND lang NOT IN ('en', 'fr')
      UNION ALL
      SELECT doc_id, 3, 0, 15, 1, 'digest_matches_manifest',
             'Archive checksum differs from manifest'
      FROM asset WHERE source = 'src3'
    )
"""


def _digest_tables(spark, sf_dir):
    """Expected files, assets and checksum files of the documents, hashed once."""
    all_assets = materialise(_document_assets(spark, sf_dir))
    claimed = F.when(F.col("source") == "src3", F.upper("sha")).otherwise(F.col("sha"))
    expected = all_assets.select(
        "doc_id",
        F.lit(0).alias("item_pos"),
        F.lit("archive").alias("kind"),
        "name",
        claimed.alias("claimed_sha256"),
    )
    assets = all_assets.where(F.col("source") != "src7").withColumnRenamed("sha", "sha256")
    sidecars = all_assets.select(
        "doc_id", "name", split_fields(F.expr(_SIDECAR_TEXT)).alias("fields")
    )
    return expected, assets, sidecars


@query(_DIGEST_FINDINGS)
def verify_digests(spark, sf_dir):
    return verify(*_digest_tables(spark, sf_dir), ["doc_id"])


def bucketed_digest_tables(spark, sf_dir, buckets=16):
    """The same three tables, in buckets by release and file name."""
    return [
        write_bucketed(rows, fresh_folder(spark, "bucketed"), ["doc_id", "name"], buckets)
        for rows in _digest_tables(spark, sf_dir)
    ]


@query(_DIGEST_FINDINGS)
def verify_digests_bucketed(spark, sf_dir):
    """As ``verify_digests``, over tables kept in buckets: the joins move no row."""
    return verify(*bucketed_digest_tables(spark, sf_dir), ["doc_id"])


@query("""
    SELECT d.doc_id, 'asset_present' AS rule, 'No such file: doc-' || d.doc_id AS message
    FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id
""")
def asset_present(spark, sf_dir):
    name = F.concat(F.lit("doc-"), F.col("doc_id")).alias("name")
    expected = table(spark, sf_dir, "documents").select("doc_id", name)
    found = table(spark, sf_dir, "labels").select("doc_id", name, F.lit(True).alias("_present"))
    facts = expected.join(found, ["doc_id", "name"], "left").withColumn("item_pos", F.lit(0))
    rule = next(r for r in asset_rules() if r.name == "asset_present")
    return violations(facts, ["doc_id"], [rule]).select("doc_id", "rule", "message")


@query("""
    SELECT doc_id, 'digest_matches_manifest' AS rule,
           'Archive checksum differs from manifest' AS message
    FROM documents WHERE source = 'src3' AND lang <> 'fr'
""")
def digest_matches_manifest(spark, sf_dir):
    """The rule over claims of which one source's are wrong; in one language it is an image."""
    claimed = F.when(F.col("source") == "src3", F.upper("sha")).otherwise(F.col("sha"))
    kind = F.when(F.col("lang") == "fr", "image").otherwise("archive")
    facts = _document_assets(spark, sf_dir).select(
        "doc_id", "name", F.col("sha").alias("sha256"), claimed.alias("claimed_sha256"),
        kind.alias("kind"), F.lit(True).alias("_present"), F.lit(0).alias("item_pos"),
        F.array("sha", "name").alias("fields"),
    )
    rule = next(r for r in asset_rules() if r.name == "digest_matches_manifest")
    return violations(facts, ["doc_id"], [rule]).select("doc_id", "rule", "message")


@query("""
    SELECT p_partkey, (i - 1)::INTEGER AS model_pos, words[i] AS id, 'id,n' AS keys
    FROM (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part),
         unnest(range(1, len(words) + 1)) AS t(i)
""")
def scan_models(spark, sf_dir):
    configure(spark)
    model = F.transform(
        F.split("p_name", " "), lambda w: F.struct(w.alias("id"), F.col("p_size").alias("n"))
    )
    manifests = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").select(
        "p_partkey", F.to_json(F.struct(model.alias("models"))).alias("raw")
    )
    return models_of(manifests, ["p_partkey"]).select(
        "p_partkey",
        "model_pos",
        F.try_variant_get("model", "$.id", "string").alias("id"),
        F.concat_ws(",", F.array_sort("keys")).alias("keys"),
    )


# A listing names the text of each page twice, as an interrupted upload would: once
# with its full size, then, for secure addresses, with a shorter one.
def _page_listings(spark, sf_dir):
    def entry(size):
        return F.struct(F.col("url").alias("name"), size.alias("size"))

    size = F.octet_length("html").cast("bigint")
    short = F.when(F.col("url").startswith("https:"), size - 1).otherwise(size)
    listing = F.struct(F.array(entry(size), entry(short)).alias("assets"))
    return table(spark, sf_dir, "pages").select("page_id", F.to_json(listing).alias("raw"))


@query("""
    SELECT page_id, k.pos AS upload_pos, url AS name,
           strlen(html) - CASE WHEN k.pos = 1 AND starts_with(url, 'https:') THEN 1 ELSE 0 END
           AS size
    FROM pages, (VALUES (0), (1)) AS k(pos)
""")
def scan_uploads(spark, sf_dir):
    configure(spark)
    return parse_uploads(_page_listings(spark, sf_dir), ["page_id"], F.col("raw"))


@query("""
    SELECT page_id, 'upload_size_matches' AS rule,
           'Missing or incomplete upload: ' || url AS message
    FROM pages WHERE starts_with(url, 'https:')
""")
def upload_size_matches(spark, sf_dir):
    configure(spark)
    expected = table(spark, sf_dir, "pages").select(
        "page_id", F.col("url").alias("name"), F.octet_length("html").cast("bigint").alias("size")
    )
    uploads = parse_uploads(_page_listings(spark, sf_dir), ["page_id"], F.col("raw"))
    found = upload_violations(expected, uploads, ["page_id"])
    return found.select("page_id", "rule", "message")


@query("""
    SELECT conv_id, bool_or(starts_with(role, 'sys')) AS ok FROM conversations GROUP BY 1
""")
def any_row(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return any_of(conversations, ["conv_id"], F.col("role").startswith("sys"))


@query("SELECT conv_id, bool_and(turn < 6) AS ok FROM conversations GROUP BY 1")
def all_rows(spark, sf_dir):
    return all_of(table(spark, sf_dir, "conversations"), ["conv_id"], F.col("turn") < 6)


@query("""
    SELECT site, bool_or(starts_with(rtrim(url, '/'), site || '/en/')) AS ok
    FROM (SELECT url, array_to_string(string_split(url, '/')[1:3], '/') AS site FROM pages)
    GROUP BY 1
""")
def require_any_prefix(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "url", F.substring_index("url", "/", 3).alias("site")
    )
    below = F.concat(F.col("site"), F.lit("/en/"))
    return any_below(pages, ["site"], F.col("url"), below)


@query("""
    SELECT o_orderkey, k.line AS missing FROM orders, (VALUES (1), (2)) AS k(line)
    WHERE NOT EXISTS (SELECT 1 FROM lineitem
                      WHERE l_orderkey = o_orderkey AND l_linenumber = k.line)
""")
def require_members(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return require(lines, orders, ["o_orderkey"], F.col("l_linenumber"), [1, 2])


@query("""
    SELECT user_id, event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type
                               ORDER BY ts DESC, event_id DESC) = 1
""")
def last_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events").drop("props")
    return last_of(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""
    SELECT source, doc_id, CASE
        WHEN source IS NULL OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'missing'
        WHEN strlen(text) = n_chars THEN 'ok' ELSE 'mismatch' END AS status
    FROM documents
""")
def reconcile_by_fingerprint(spark, sf_dir):
    """Documents by source, expected with their characters and found with their bytes, the toxic ones not at all."""
    documents = table(spark, sf_dir, "documents")
    expected = documents.select("source", "doc_id", F.col("n_chars").alias("size"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    found = documents.join(toxic, "doc_id", "left_anti").select(
        "source", "doc_id", F.octet_length("text").cast("bigint").alias("size")
    )
    return reconcile_grouped(expected, found, ["source"], ["doc_id"], "size")
