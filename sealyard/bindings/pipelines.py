"""The pipelines a user calls, over release folders staged from the rows of a table.

Every benchmark item becomes a folder with a manifest, an archive, an image and their
checksum files; the number of the item decides which fault, if any, the release has.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sealyard import (
    create_registry,
    materialise,
    publish_folder as publish,
    stage_release as stage,
    validate_folder as validate,
    validate_published as validate_again,
)
from sealyard.bindings import query, table
from sealyard.bindings.releases import CONTRACT, manifests_of, packed_documents
from sealyard.operators.digests import content_digest
from sealyard.session import configure, fresh_folder

# Faults by item number; two of twelve items are sound.
_FAULTS = [
    None, "no_manifest", "architecture", "claim", "no_image", "swapped_sidecar", "not_gzip",
    "no_entrypoint", "no_alias", "alias_file", "tag", None,
]


def _candidates_and_folder(spark, sf_dir):
    """Stage the folders; returns ``release_id, tag, arrival`` and where the folders are."""
    configure(spark)
    names = F.array(*[F.lit(name).cast("string") for name in _FAULTS])
    fault = F.get(names, F.pmod("item_id", F.lit(len(_FAULTS))).cast("int"))
    version = F.concat(F.lit("1.0."), F.col("item_id"))
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("doc_id"), "text", fault.alias("fault")
    )
    base = F.concat(F.lit("pack-1.0."), F.col("doc_id"), F.lit("-any-x64"))
    packed = materialise(
        packed_documents(items, base, F.col("fault")).join(items.drop("fault"), "doc_id")
    )
    described = packed.select(
        F.col("doc_id").alias("release_id"), "base", "fault",
        F.concat(F.lit("1.0."), F.col("doc_id")).alias("version"),
        content_digest(F.col("content")).alias("archive_sha"),
    )
    candidates, manifests = manifests_of(described)
    archive, image = F.concat("base", F.lit(".tar.gz")), F.concat("base", F.lit(".dmg"))
    sha = content_digest(F.col("content"))
    parts = [archive, sha]
    claim = F.when(F.col("fault") == "swapped_sidecar", F.concat_ws("  ", *parts)).otherwise(
        F.concat_ws("  ", *parts[::-1])
    )
    image_claim = F.concat_ws("  ", content_digest(F.col("text")), image)

    def entry(ord, name, content):
        return F.struct(F.lit(ord).alias("ord"), name.alias("name"), content.alias("content"))

    binaries = packed.select(
        F.col("doc_id").alias("release_id"), "fault",
        F.explode(F.array(
            entry(1, archive, F.col("content")),
            entry(2, F.concat(archive, F.lit(".sha256")), F.encode(claim, "utf-8")),
            entry(3, image, F.encode("text", "utf-8")),
            entry(4, F.concat(image, F.lit(".sha256")), F.encode(image_claim, "utf-8")),
        )).alias("file"),
    ).select("release_id", "fault", "file.*")
    binaries = binaries.where(~((F.col("ord") == 3) & F.col("fault").eqNullSafe(F.lit("no_image"))))
    texts = manifests.select(
        "release_id", F.lit(0).alias("ord"), F.lit("release.json").alias("name"),
        F.encode("raw", "utf-8").alias("content"),
    )
    folder = F.col("release_id").cast("string")
    files = binaries.drop("fault").unionByName(texts).withColumns({"release_id": folder, "tag": folder})
    dist = fresh_folder(spark, "dist")
    create_registry(spark, dist)
    staged = packed.select(
        F.col("doc_id").cast("string").alias("release_id"), F.col("doc_id").cast("string").alias("tag"),
        F.lit("staged").alias("product"), F.lit("").alias("title"), F.lit("stable").alias("channel"),
        F.col("doc_id").alias("arrival"),
    )
    stage(files, staged, dist, 1, content="content")
    arrival = F.col("release_id").cast("bigint").alias("arrival")
    return candidates.select(folder.alias("release_id"), "tag", arrival), f"{dist}/files"


_ITEM = """
    SELECT item_id, item_id::VARCHAR AS release_id, 'pack-1.0.' || item_id || '-any-x64' AS base,
           item_id % 12 AS fault FROM benchmark
"""
# One row per fault: the item's remainder, where it is found, the rule and its message.
_FOUND = f"""
    SELECT release_id, k.phase, k.item_pos::BIGINT AS item_pos, k.rule_ord, k.sub_pos, k.rule,
           replace(k.message, '{{base}}', base) AS message
    FROM ({_ITEM}) JOIN (VALUES
      (1, 1, 0, 1, 0, 'manifest_readable', 'Manifest missing or not one JSON value'),
      (2, 1, 0, 5, 1, 'equals_constant(architecture)', 'Expected x64'),
      (3, 3, 0, 15, 1, 'digest_matches_manifest', 'Archive checksum differs from manifest'),
      (4, 3, 1, 13, 0, 'asset_present', 'No such file: {{base}}.dmg'),
      (5, 3, 0, 14, 0, 'sidecar_matches', 'Invalid checksum for {{base}}.tar.gz'),
      (6, 4, 0, 16, 0, 'archive_readable', 'not a gzip file'),
      (7, 6, 0, 21, 0, 'require_member(entrypoint)', '''{{base}}/run'''),
      (8, 6, 0, 23, 0, 'require_member(alias)', '''{{base}}/compat'''),
      (9, 6, 0, 23, 1, 'member_property(alias)', 'Missing client compatibility entry'),
      (10, 1, 0, 4, 0, 'columns_equal(tag)', 'Tag and manifest version differ')
    ) AS k(fault, phase, item_pos, rule_ord, sub_pos, rule, message) ON k.fault = item_id % 12
"""
_SOUND = f"SELECT * FROM ({_ITEM}) WHERE fault IN (0, 11)"


@query(_FOUND)
def validate_folder(spark, sf_dir):
    """All violations of all folders."""
    candidates, dist = _candidates_and_folder(spark, sf_dir)
    return validate(spark, CONTRACT, candidates, dist)[1]


@query(f"""
    SELECT release_id, k.ord, k.kind,
           CASE k.ord WHEN 0 THEN 'release.json' ELSE base || k.suffix END AS name
    FROM ({_SOUND}), (VALUES (0, 'manifest', ''), (1, 'archive', '.tar.gz'),
        (2, 'archive_sidecar', '.tar.gz.sha256'), (3, 'image', '.dmg'),
        (4, 'image_sidecar', '.dmg.sha256')) AS k(ord, kind, suffix)
""")
def passed_inventory(spark, sf_dir):
    """The files of the folders that pass."""
    candidates, dist = _candidates_and_folder(spark, sf_dir)
    return validate(spark, CONTRACT, candidates, dist)[0].drop("path")


def _two_batches(spark, sf_dir):
    """Publish the first half of the items, then all of them; registry and second result."""
    candidates, dist = _candidates_and_folder(spark, sf_dir)
    candidates = materialise(candidates)
    registry = fresh_folder(spark, "registry")
    create_registry(spark, registry)
    publish(spark, CONTRACT, candidates.where("arrival % 24 < 12"), dist, registry, 1)
    index, found = publish(spark, CONTRACT, candidates, dist, registry, 2)
    return registry, index, found


@query(f"""
    SELECT release_id, 'v1.0.' || item_id AS tag, 'pack' AS product,
           'pack v1.0.' || item_id AS title, 'stable' AS channel, item_id AS arrival, s.state,
           CASE WHEN item_id % 24 < 12 THEN 1 ELSE 2 END::BIGINT AS seq
    FROM ({_SOUND}), (VALUES ('draft'), ('published')) AS s(state)
""")
def publish_folder(spark, sf_dir):
    """The index after both batches."""
    return _two_batches(spark, sf_dir)[1]


@query(f"""
    {_FOUND}
    UNION ALL
    SELECT release_id, 7, 0, 26, 0, 'tag_not_published', 'Release v1.0.' || item_id || ' already exists'
    FROM ({_SOUND}) WHERE item_id % 24 < 12
""")
def publish_folder_violations(spark, sf_dir):
    """All violations of the second batch: faults, and tags that the first has taken."""
    return _two_batches(spark, sf_dir)[2]


@query(f"""
    SELECT 'v1.0.' || item_id AS release_id, true AS passed, 0::BIGINT AS n_violations,
           NULL::VARCHAR AS rule, NULL::VARCHAR AS message
    FROM ({_SOUND})
""")
def validate_published(spark, sf_dir):
    """Verdicts on what the registry itself holds after both batches."""
    registry, _, _ = _two_batches(spark, sf_dir)
    return validate_again(spark, CONTRACT, registry)[2]
