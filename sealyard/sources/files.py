"""File sources. A registry folder holds one sub-folder per release.

The releases to be read are a table. Tasks list or open the folders of their own rows,
so nothing grows on the driver, and files without any bytes are seen like others.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealyard.fixed import LISTING_NAME, MANIFEST_NAME, SIDECAR_SUFFIX
from sealyard.functions.documents import (
    array_items,
    json_document,
    object_fields,
    string_value,
    whole_number,
)
from sealyard.functions.text import split_fields
from sealyard.session import configure
from sealyard.sources.commits import FILE_BYTES, committed_names, compact, read_log, read_markers
from sealyard.sources.named import IN_FLIGHT, balance, qualified, read_texts
from sealyard.sources.streams import locate

RELEASES_SCHEMA = (
    "release_id string, tag string, product string, title string, channel string, "
    "arrival bigint, state string, seq bigint"
)


def list_folders(releases: DataFrame, path: str, pattern: str = "*") -> DataFrame:
    """``release_id, name, path, length`` of the files in each release's folder below ``path``.

    A release without a folder has no rows. Only files in the folder itself are listed.
    """
    root = qualified(releases.sparkSession, path)

    def visit(batches):
        from concurrent.futures import ThreadPoolExecutor
        from fnmatch import fnmatchcase

        import pyarrow as pa
        from pyarrow import fs

        def files_of(release):
            system, place = locate(f"{root}/{release}")
            inside = fs.FileSelector(place, allow_not_found=True)
            found = system.get_file_info(inside)
            return [
                (release, i.base_name, f"{root}/{release}/{i.base_name}", i.size)
                for i in found
                if i.is_file and fnmatchcase(i.base_name, pattern)
            ]

        kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
        with ThreadPoolExecutor(IN_FLIGHT) as pool:
            for batch in batches:
                names = [n for n in batch.column(0).to_pylist() if n]
                for at in range(0, len(names), IN_FLIGHT):
                    rows = [row for rows in pool.map(files_of, names[at : at + IN_FLIGHT]) for row in rows]
                    if rows:
                        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                        yield pa.RecordBatch.from_arrays(columns, ["release_id", "name", "path", "length"])

    wanted = balance(releases.select("release_id").distinct(), F.lit(1), 1000, ["release_id"])
    return wanted.mapInArrow(visit, "release_id string, name string, path string, length bigint")


def _texts(releases: DataFrame, path: str, name: str) -> DataFrame:
    """``release_id, raw`` of the one file of that name in each folder that has it."""
    root = F.lit(qualified(releases.sparkSession, path))
    place = F.concat_ws("/", root, "release_id", F.lit(name))
    files = releases.select("release_id").distinct().withColumn("path", place)
    return read_texts(files, ["release_id"]).where(F.col("raw").isNotNull())


def scan_manifests(releases: DataFrame, path: str, name: str = MANIFEST_NAME) -> DataFrame:
    """``release_id, raw``: the manifest text of each release that has one in UTF-8."""
    return _texts(releases, path, name)


def scan_models(manifests: DataFrame, key=("release_id",), raw: str = "raw") -> DataFrame:
    """``key, model_pos, keys, model``: the catalog entries of the manifests.

    A manifest whose ``models`` is absent or no array has no rows here.
    """
    configure(manifests.sparkSession)
    parsed = manifests.select(*key, json_document(F.col(raw)).alias("_doc"))
    return explode_models(parsed, key, F.col("_doc"))


def explode_models(df: DataFrame, key, document: Column) -> DataFrame:
    models = array_items(F.try_variant_get(document, "$.models", "variant"))
    return df.select(*key, F.posexplode(models).alias("model_pos", "model")).select(
        *key, "model_pos", F.map_keys(object_fields(F.col("model"))).alias("keys"), "model"
    )


def scan_assets(releases: DataFrame, path: str, pattern: str = "*") -> DataFrame:
    """``release_id, name, path, length`` of every file; no content is read."""
    return list_folders(releases, path, pattern)


def scan_sidecars(releases: DataFrame, path: str, suffix: str = SIDECAR_SUFFIX) -> DataFrame:
    """``release_id, name, fields``: words of each checksum file, by asset name."""
    files = list_folders(releases, path, "*" + suffix)
    return read_texts(files, ["release_id", "name"]).where(F.col("raw").isNotNull()).select(
        "release_id",
        F.left("name", F.char_length("name") - len(suffix)).alias("name"),
        split_fields(F.col("raw")).alias("fields"),
    )


def scan_uploads(releases: DataFrame, path: str, name: str = LISTING_NAME) -> DataFrame:
    """``release_id, upload_pos, name, size`` from the listing of each release folder."""
    return parse_uploads(_texts(releases, path, name), ("release_id",), F.col("raw"))


def parse_uploads(listings: DataFrame, key, raw: Column) -> DataFrame:
    """Entries of ``{"assets": [{"name": .., "size": ..}]}``; sizes only if JSON numbers.

    An entry that lacks one of the two keys has no name here, and is thereby a fault.
    """
    configure(listings.sparkSession)
    fields = object_fields(F.col("upload"))
    named = string_value(F.try_element_at("_fields", F.lit("name")))
    return (
        listings.select(*key, json_document(raw).alias("_doc"))
        .select(
            *key,
            F.posexplode(
                array_items(F.try_variant_get("_doc", "$.assets", "variant"))
            ).alias("upload_pos", "upload"),
        )
        .select(*key, "upload_pos", fields.alias("_fields"))
        .select(
            *key,
            "upload_pos",
            F.when(F.map_contains_key("_fields", F.lit("size")), named).alias("name"),
            whole_number(F.try_element_at("_fields", F.lit("size"))).alias("size"),
        )
    )


def scan_releases(
    spark: SparkSession, path: str, as_of: int | None = None, beyond: Iterable[str] = ()
) -> DataFrame:
    """The registry index, as it was after the batches with a ``seq`` up to ``as_of`` if that is given.

    Batches named in ``beyond`` are left out where they lie by themselves. Drafts that were
    withdrawn later are not in it, and neither is what no batch has committed. An absent or
    unreadable index is an error, never "empty".
    """
    markers = read_markers(spark, path)
    rows = read_log(spark, path, RELEASES_SCHEMA, as_of, markers, beyond)
    if not any(".withdrawn" in name for name in committed_names(markers)):
        return rows
    until = F.max("seq").alias("_until")
    ended = rows.where("state = 'withdrawn'").groupBy("tag").agg(until)
    live = (F.col("state") != "draft") | F.col("_until").isNull() | (F.col("seq") > F.col("_until"))
    return rows.where("state <> 'withdrawn'").join(ended, ["tag"], "left").where(live).select(*rows.columns)


def compact_releases(spark: SparkSession, path: str, file_bytes: int = FILE_BYTES) -> bool:
    """Fold the index's batches into files of about ``file_bytes``, ordered by tag; every snapshot stays as it is."""
    return compact(spark, path, RELEASES_SCHEMA, "tag", file_bytes) is not None
