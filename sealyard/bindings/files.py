"""The operators on files, over files derived from the given tables.

Each query stages what it reads: one release per row of a table, which SQL can follow.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sealyard import read_release_files as files_source, stage_release as stage
from sealyard.bindings import query, table
from sealyard.operators.digests import content_digest
from sealyard.operators.digests import digest_files as digests_below
from sealyard.plans.publish import create_registry
from sealyard.session import fresh_folder
from sealyard.sources.files import (
    scan_assets as assets_below,
    scan_manifests as manifests_below,
    scan_sidecars as sidecars_below,
    scan_uploads as uploads_below,
)
from sealyard.sources.named import file_lengths, qualified, read_texts


# One release per benchmark item: its text, a manifest, a checksum file, a listing.
_ITEMS = """
    SELECT 'v1.0.' || item_id AS tag, text, sha256(text) AS sha FROM benchmark
"""
_ITEM_FILES = f"""
    SELECT tag, 0::BIGINT AS upload_pos, 'release.json' AS name,
           '{{"version":"' || substr(tag, 2) || '","sha256":"' || sha || '"}}' AS text
    FROM ({_ITEMS})
    UNION ALL
    SELECT tag, 1, 'item.txt', text FROM ({_ITEMS})
    UNION ALL
    SELECT tag, 2, 'item.txt.sha256', sha || '  item.txt' || chr(10) FROM ({_ITEMS})
    UNION ALL
    SELECT tag, 3, 'uploaded-assets.json',
           '{{"assets":[{{"name":"item.txt","size":' || strlen(text) || '}}]}}' FROM ({_ITEMS})
    UNION ALL
    SELECT tag, 4, 'empty.bin', '' FROM ({_ITEMS})
"""


def _staged_items(spark, sf_dir):
    """Stage five small files per benchmark item, one of them without any bytes.

    Returns their folder and the listing, whose ``release_id`` names the releases.
    """
    registry = fresh_folder(spark, "registry")
    create_registry(spark, registry)
    tag = F.concat(F.lit("v1.0."), F.col("item_id"))
    items = table(spark, sf_dir, "benchmark").select(
        tag.alias("tag"), "text", content_digest(F.col("text")).alias("sha")
    )
    version = F.substr("tag", F.lit(2))
    upload = F.struct(F.lit("item.txt").alias("name"), F.octet_length("text").alias("size"))
    texts = {
        "release.json": F.to_json(
            F.struct(version.alias("version"), F.col("sha").alias("sha256"))
        ),
        "item.txt": F.col("text"),
        "item.txt.sha256": F.concat("sha", F.lit("  item.txt\n")),
        "uploaded-assets.json": F.to_json(F.struct(F.array(upload).alias("assets"))),
        "empty.bin": F.lit(""),
    }
    entries = [
        F.struct(F.lit(ord).alias("ord"), F.lit(name).alias("name"), text.alias("text"))
        for ord, (name, text) in enumerate(texts.items())
    ]
    files = (
        items.select("tag", F.explode(F.array(*entries)).alias("file"))
        .select(F.col("tag").alias("release_id"), "tag", "file.*")
        .withColumn("content", F.encode("text", "utf-8"))
    )
    releases = items.select(
        F.col("tag").alias("release_id"), "tag", F.lit("items").alias("product"),
        F.concat_ws(" ", F.lit("items"), "tag").alias("title"), F.lit("stable").alias("channel"),
        F.lit(1).cast("bigint").alias("arrival"),
    )
    uploads = stage(files, releases, registry, 1, content="content")
    return f"{registry}/files", uploads


@query(f"SELECT tag, upload_pos, name, strlen(text) AS size FROM ({_ITEM_FILES})")
def stage_release(spark, sf_dir):
    _, uploads = _staged_items(spark, sf_dir)
    return uploads.select("tag", "upload_pos", "name", "size")


@query(f"""
    SELECT tag AS release_id, text AS raw FROM ({_ITEM_FILES}) WHERE name = 'release.json'
""")
def scan_manifests(spark, sf_dir):
    folder, uploads = _staged_items(spark, sf_dir)
    return manifests_below(uploads, folder)


@query(f"""
    SELECT tag AS release_id, 'item.txt' AS name, sha || ' item.txt' AS fields FROM ({_ITEMS})
""")
def scan_sidecars(spark, sf_dir):
    folder, uploads = _staged_items(spark, sf_dir)
    return sidecars_below(uploads, folder).select(
        "release_id", "name", F.concat_ws(" ", "fields").alias("fields")
    )


@query(f"""
    SELECT tag AS release_id, 0 AS upload_pos, 'item.txt' AS name, strlen(text) AS size
    FROM ({_ITEMS})
""")
def scan_upload_files(spark, sf_dir):
    folder, uploads = _staged_items(spark, sf_dir)
    return uploads_below(uploads, folder)


@query(f"SELECT tag AS release_id, name, strlen(text) AS length FROM ({_ITEM_FILES})")
def scan_assets(spark, sf_dir):
    folder, uploads = _staged_items(spark, sf_dir)
    return assets_below(uploads, folder).select("release_id", "name", "length")


@query(f"""
    SELECT tag AS release_id, name, strlen(text) AS length, sha256(text) AS sha256
    FROM ({_ITEM_FILES})
""")
def digest_files(spark, sf_dir):
    folder, uploads = _staged_items(spark, sf_dir)
    return digests_below(uploads, folder).select(
        "release_id", "name", "length", "sha256"
    )


@query(f"""
    SELECT tag AS release_id, name, strlen(text) AS length, sha256(text) AS sha256
    FROM ({_ITEM_FILES})
    UNION ALL
    SELECT tag, 'no such file', NULL, NULL FROM ({_ITEMS})
""")
def open_named_files(spark, sf_dir):
    """Files opened by the names a table gives them; one name per release is in vain."""
    folder, uploads = _staged_items(spark, sf_dir)
    key = ["release_id", "name"]
    vain = uploads.select("release_id").distinct().withColumn("name", F.lit("no such file"))
    root = F.lit(qualified(spark, folder))
    files = uploads.select(*key).unionByName(vain)
    files = files.withColumn("path", F.concat_ws("/", root, *key))
    texts = read_texts(files, key).select(*key, content_digest(F.col("raw")).alias("sha256"))
    return file_lengths(files, key).join(texts, key)


@query(f"SELECT tag AS release_id, name, strlen(text) AS length FROM ({_ITEM_FILES}) WHERE name <> 'empty.bin'")
def read_release_files(spark, sf_dir):
    """The staged files as a data source, which lists them when the query runs."""
    folder, _ = _staged_items(spark, sf_dir)
    found = files_source(spark, folder, names=["*.json", "item*"])
    return found.select("release_id", "name", "length")
