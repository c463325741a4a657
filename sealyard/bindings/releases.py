"""Whole releases derived from the given tables: one release per document."""

from __future__ import annotations

import io
import tarfile

from pyspark.sql import functions as F

from sealyard import (
    ReleaseContract,
    create_results,
    list_archives as list_of,
    manifest_and_archive,
    materialise,
    publish_release as publish,
    reject_existing,
    resolve_latest as resolve,
    scan_releases as scan_index,
    split_fields,
    validate_changed_releases as validate_changed,
    validate_releases as validate,
)
from sealyard.bindings import query, table
from sealyard.fixed import MODEL_KEYS
from sealyard.operators.digests import content_digest
from sealyard.plans.publish import (
    create_registry,
    draft_release,
    index_rows,
    releases_path,
    upload_violations,
    write_upload_listing as keep_listing,
)
from sealyard.plans.validate import manifest_facts, release_inventory
from sealyard.session import bound_batches, configure, fresh_folder
from sealyard.sources.archives import digests_of, members_of, read_bytes_once

CONTRACT = ReleaseContract(
    base_prefix="pack-",
    base_suffix="-any-x64",
    architecture="x64",
    team_identifier="TEAM00",
    entrypoint="run",
    alias="compat",
    resources="data.bundle",
)

# (what is wrong, the rule that must report it first, its message). Source number and
# language of a document select an entry; beyond the list documents make sound releases.
FAULTS = [
    ("no_manifest", "manifest_readable", "Manifest missing or not one JSON value"),
    ("trailing_text", "manifest_readable", "Manifest missing or not one JSON value"),
    ("no_version", "required_key", "'version'"),
    ("version_suffix", "full_match(version)", "Invalid version"),
    ("tag", "columns_equal(tag)", "Tag and manifest version differ"),
    ("architecture", "equals_constant(architecture)", "Expected x64"),
    ("architecture_and_no_models", "equals_constant(architecture)", "Expected x64"),
    ("team", "equals_constant(team_identifier)", "Expected the signing team"),
    ("notarized", "strict_true(notarized)", "Only notarized builds may be published"),
    ("commit", "full_match(source_commit)", "Missing source commit"),
    ("server", "nonempty_object(server)", "Missing server description"),
    ("no_models", "required_key", "'models'"),
    ("empty_models", "nonempty_array(models)", "Missing model catalog"),
    ("model_key", "required_keys(models[])", "Model missing dimensions"),
    ("archive_name", "columns_equal(archive)", "Unexpected archive"),
    ("image_name", "columns_equal(disk_image)", "Unexpected disk_image"),
    ("no_image", "asset_present", "No such file: {base}.dmg"),
    ("no_sidecar", "sidecar_matches", "Invalid checksum for {base}.tar.gz"),
    ("swapped_sidecar", "sidecar_matches", "Invalid checksum for {base}.tar.gz"),
    ("claim", "digest_matches_manifest", "Archive checksum differs from manifest"),
    ("no_claim", "required_key", "'archive_sha256'"),
    ("not_gzip", "archive_readable", "not a gzip file"),
    ("absolute", "safe_path", "Unsafe archive path"),
    ("upwards", "safe_path", "Unsafe archive path"),
    ("other_root", "path_root", "Unexpected archive root"),
    ("hard_link", "allowed_kind", "Unsupported archive member"),
    ("other_link", "link_allowlist", "Unexpected symlink"),
    ("no_entrypoint", "require_member(entrypoint)", "'{base}/run'"),
    ("plain_entrypoint", "member_property(entrypoint)", "Entry point is not executable"),
    ("entrypoint_twice", "member_property(entrypoint)", "Entry point is not executable"),
    ("no_alias", "require_member(alias)", "'{base}/compat'"),
    ("alias_file", "member_property(alias)", "Missing client compatibility entry"),
    ("no_resources", "require_any_prefix(resources)", "Missing resources"),
]
_LANGUAGES = ("en", "fr", "de", "es")
# The position of a document's fault in the list, counted from 1; same text for both engines.
_FAULT_NUMBER = (
    "TRY_CAST(substr(source, 4) AS INTEGER) * 4 + CASE lang "
    + " ".join(f"WHEN '{lang}' THEN {i}" for i, lang in enumerate(_LANGUAGES))
    + " ELSE 80 END"
)


def pack(text: str, base: str, fault: str | None) -> bytes:
    """A small tar.gz with the text as resource, well-formed or with one fault."""
    target = io.BytesIO()
    if fault == "not_gzip":
        return text.encode()
    with tarfile.open(fileobj=target, mode="w:gz", compresslevel=1) as archive:

        def add(name, kind=tarfile.REGTYPE, data=b"", mode=0o644, link=""):
            info = tarfile.TarInfo(name)
            info.type, info.mode, info.linkname, info.size = kind, mode, link, len(data)
            archive.addfile(info, io.BytesIO(data))

        add(base, tarfile.DIRTYPE, mode=0o755)
        if fault != "no_entrypoint":
            add(f"{base}/run", data=b"#!", mode=0o644 if fault == "plain_entrypoint" else 0o755)
        if fault == "alias_file":
            add(f"{base}/compat")
        elif fault != "no_alias":
            add(f"{base}/compat", tarfile.SYMTYPE, mode=0o777, link="run")
        add(f"{base}/data.bundle/", tarfile.DIRTYPE, mode=0o755)
        if fault != "no_resources":
            add(f"{base}/data.bundle/text.txt", data=text.encode())
        extra = {
            "absolute": (f"/{base}/x",),
            "upwards": (f"{base}/../x",),
            "other_root": ("elsewhere/x",),
            "hard_link": (f"{base}/x", tarfile.LNKTYPE, b"", 0o644, f"{base}/run"),
            "other_link": (f"{base}/x", tarfile.SYMTYPE, b"", 0o777, "run"),
            "entrypoint_twice": (f"{base}/run",),
        }.get(fault)
        if extra:
            add(*extra)
    whole = target.getvalue()
    if fault == "headless":
        return whole[2:]
    return whole[: len(whole) // 2] if fault == "cut" else whole


def packed_documents(documents, base, fault):
    """``doc_id, base, fault, content``: an archive per document, built in Arrow batches."""
    bound_batches(documents.sparkSession)

    def build(batches):
        import pyarrow as pa

        names = ["doc_id", "base", "fault", "content"]
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                fields = [batch.column(name).to_pylist() for name in ("text", "base", "fault")]
                content = [pack(*values) for values in zip(*fields)]
                columns = [batch.column(name) for name in names[:3]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(content, pa.binary())], names)

    return documents.select(
        "doc_id", base.alias("base"), fault.alias("fault"), "text"
    ).mapInArrow(build, "doc_id bigint, base string, fault string, content binary")


_PACKED = ["doc_id", "text", "lang", "source"]


def _base():
    return F.concat(F.lit("pack-1.0."), F.col("doc_id"), F.lit("-any-x64"))


_MEMBERS = """
    SELECT doc_id, k.pos::BIGINT AS member_pos,
           'pack-1.0.' || doc_id || '-any-x64' || k.name AS name, k.type,
           k.mode::BIGINT AS mode, k.link AS linkname
    FROM documents, (VALUES (0, '', 'directory', 493, ''), (1, '/run', 'file', 493, ''),
        (2, '/compat', 'symlink', 511, 'run'), (3, '/data.bundle', 'directory', 493, ''),
        (4, '/data.bundle/text.txt', 'file', 420, '')) AS k(pos, name, type, mode, link)
"""


@query(_MEMBERS)
def list_archives(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(*_PACKED)
    packed = packed_documents(documents, _base(), F.lit(None).cast("string"))
    return list_of(packed, ["doc_id"], content="content").where(F.col("error").isNull()).drop("error")


@query("SELECT doc_id, lang NOT IN ('de', 'es') AS ok FROM documents")
def archive_readable(spark, sf_dir):
    damage = F.when(F.col("lang") == "de", "headless").when(F.col("lang") == "es", "cut")
    documents = table(spark, sf_dir, "documents").select(*_PACKED)
    damaged = packed_documents(documents, _base(), damage)
    listing = read_bytes_once(damaged, ["doc_id"], True, "content")
    return digests_of(listing, ["doc_id"]).select("doc_id", F.col("error").isNull().alias("ok"))


@query("""
    SELECT doc_id, CASE lang WHEN 'de' THEN 'not a gzip file'
        ELSE 'Compressed file ended before the end-of-stream marker was reached' END AS error
    FROM documents WHERE lang IN ('de', 'es')
""")
def damaged_archives(spark, sf_dir):
    """What the listing says of archives without a head, and of some that end too early."""
    damage = F.when(F.col("lang") == "de", "headless").when(F.col("lang") == "es", "cut")
    documents = table(spark, sf_dir, "documents").select(*_PACKED)
    told = list_of(packed_documents(documents, _base(), damage), ["doc_id"], content="content")
    return told.where(F.col("error").isNotNull()).select("doc_id", "error")


def _manifest(fault):
    """Manifest text of a release; a NULL field is a key the manifest lacks."""

    def unless(names, value):
        return F.when(~fault.isin(*names) | fault.isNull(), value)

    def instead(name, value, regular):
        return F.when(fault == name, value).otherwise(regular)

    base, version = F.col("base"), F.col("version")
    model = F.struct(
        *[
            (unless(["model_key"], F.lit(1)) if key == "dimensions" else F.lit(key)).alias(key)
            for key in MODEL_KEYS
        ]
    )
    no_models = F.array().cast(f"array<struct<{','.join(_model_type(k) for k in MODEL_KEYS)}>>")
    fields = F.struct(
        unless(["no_version"], instead("version_suffix", F.concat(version, F.lit("-")), version))
        .alias("version"),
        F.when(fault.isin("architecture", "architecture_and_no_models"), "other")
        .otherwise("x64").alias("architecture"),
        instead("team", F.lit("TEAM0"), F.lit("TEAM00")).alias("team_identifier"),
        # The JSON text "true" takes the place of the boolean further down.
        instead("notarized", F.lit(False), F.lit(True)).alias("notarized"),
        F.left(F.sha2("base", 256), instead("commit", F.lit(39), F.lit(40))).alias("source_commit"),
        F.struct(unless(["server"], F.lit("any")).alias("kind")).alias("server"),
        unless(
            ["no_models", "architecture_and_no_models"],
            instead("empty_models", no_models, F.array(model)),
        ).alias("models"),
        instead("archive_name", F.concat(base, F.lit(".tgz")), F.concat(base, F.lit(".tar.gz")))
        .alias("archive"),
        instead("image_name", F.concat(base, F.lit(".img")), F.concat(base, F.lit(".dmg")))
        .alias("disk_image"),
        unless(["no_claim"], instead("claim", F.upper("archive_sha"), F.col("archive_sha")))
        .alias("archive_sha256"),
    )
    text = F.to_json(fields)
    return (
        F.when(fault == "trailing_text", F.concat(text, F.lit(" x")))
        .when(fault == "notarized", F.replace(text, F.lit(":false,"), F.lit(':"true",')))
        .otherwise(text)
    )


def _model_type(key: str) -> str:
    return f"{key}:{'int' if key == 'dimensions' else 'string'}"


def _faulty(documents):
    """``fault`` of each document, as its source number and language select it."""
    names = F.array(*[F.lit(name) for name, _, _ in FAULTS])
    number = F.expr(_FAULT_NUMBER)
    return F.when(number.between(1, len(FAULTS)), F.get(names, number - 1))


def described_releases(documents):
    """``release_id, base, fault, version, archive_sha`` as manifests need them.

    Without archives, the digest that a manifest claims is that of the text.
    """
    return documents.select(
        F.col("doc_id").alias("release_id"),
        _base().alias("base"),
        _faulty(documents).alias("fault"),
        F.concat(F.lit("1.0."), F.col("doc_id")).alias("version"),
        content_digest(F.col("text")).alias("archive_sha"),
    )


def manifests_of(described):
    """``(candidates, manifests)`` of described releases."""
    fault = F.col("fault")
    tag = F.concat(F.lit("v"), F.col("version"))
    candidates = described.select(
        "release_id", F.when(fault == "tag", F.col("version")).otherwise(tag).alias("tag")
    )
    manifests = described.where(~(fault == "no_manifest") | fault.isNull()).select(
        "release_id", _manifest(fault).alias("raw")
    )
    return candidates, manifests


def document_releases(spark, sf_dir):
    """The input tables of a validation: candidates, manifests, assets, sidecars, members.

    Each archive is read once, for digest and members together.
    """
    configure(spark)
    documents = table(spark, sf_dir, "documents").select(*_PACKED)
    number = F.expr(_FAULT_NUMBER)
    name = F.concat(F.col("base"), F.lit(".tar.gz"))
    # Archives are built in the tasks that read the documents and are listed in the same.
    packed = packed_documents(documents, _base(), _faulty(documents)).withColumnRenamed(
        "doc_id", "release_id"
    )
    keys = ["release_id", "name", "base", "fault"]
    listing = materialise(
        read_bytes_once(packed.withColumn("name", name), keys, True, "content")
    )
    described = materialise(
        listing.where(F.col("member_pos").isNull()).select(
            "release_id", "base", "fault",
            F.concat(F.lit("1.0."), F.col("release_id")).alias("version"),
            F.col("sha256").alias("archive_sha"),
        )
    )
    candidates, manifests = manifests_of(described)
    fault = F.col("fault")
    archives = digests_of(listing, ["release_id", "name"])
    members = members_of(listing.withColumnRenamed("name", "archive"), ["release_id", "archive"])
    image = F.concat(F.col("base"), F.lit(".dmg"))
    images = documents.select(
        F.col("doc_id").alias("release_id"),
        _base().alias("base"),
        content_digest(F.col("text")).alias("sha256"),
        number.alias("number"),
    )
    # Kept, as assets and sidecars are read by several branches and texts are long.
    images = materialise(images.select("release_id", image.alias("name"), "sha256", "number"))
    missing_image = [i + 1 for i, f in enumerate(FAULTS) if f[0] == "no_image"]
    present = images.where(~F.col("number").isin(*missing_image)).drop("number")
    assets = archives.drop("length").unionByName(
        present.withColumn("error", F.lit(None).cast("string"))
    )
    archive_claim = described.where(~(fault == "no_sidecar") | fault.isNull()).select(
        "release_id",
        name.alias("name"),
        F.when(fault == "swapped_sidecar", F.concat_ws("  ", name, "archive_sha"))
        .otherwise(F.concat_ws("  ", "archive_sha", name)).alias("raw"),
    )
    image_claim = images.select(
        "release_id", "name", F.concat_ws("\t", "sha256", "name").alias("raw")
    )
    sidecars = archive_claim.unionByName(image_claim).select(
        "release_id", "name", split_fields(F.col("raw")).alias("fields")
    )
    return candidates, manifests, assets, sidecars, members


_EXPECTED = (
    "VALUES "
    + ", ".join(
        "({}, '{}', '{}')".format(i, rule, message.replace("'", "''"))
        for i, (_, rule, message) in enumerate(FAULTS, 1)
    )
)
_VERDICTS = f"""
    SELECT d.doc_id AS release_id, f.number IS NULL AS passed, f.rule,
           replace(f.message, '{{base}}', 'pack-1.0.' || d.doc_id || '-any-x64') AS message
    FROM documents d LEFT JOIN ({_EXPECTED}) AS f(number, rule, message)
      ON f.number = {_FAULT_NUMBER}
"""


@query(_VERDICTS)
def validate_releases(spark, sf_dir):
    _, judged = validate(CONTRACT, *document_releases(spark, sf_dir))
    return judged.select("release_id", "passed", "rule", "message")


# Every finding of each kind of release by the number of its fault: where, which rule, and what it says.
_ALL_FOUND = f"""
    SELECT d.doc_id AS release_id, k.phase, k.item_pos::BIGINT AS item_pos, k.rule_ord, k.sub_pos, k.rule,
           replace(k.message, '{{base}}', 'pack-1.0.' || d.doc_id || CASE WHEN k.fault = 4 THEN '-' ELSE '' END
                   || '-any-x64') AS message
    FROM documents d JOIN (VALUES
      (1, 1, 0, 1, 0, 'manifest_readable', 'Manifest missing or not one JSON value'),
      (2, 1, 0, 1, 0, 'manifest_readable', 'Manifest missing or not one JSON value'),
      (3, 1, 0, 3, 0, 'required_key', '''version'''),
      (4, 1, 0, 3, 1, 'full_match(version)', 'Invalid version'),
      (4, 1, 0, 4, 0, 'columns_equal(tag)', 'Tag and manifest version differ'),
      (4, 3, 0, 12, 1, 'columns_equal(archive)', 'Unexpected archive'),
      (4, 3, 0, 13, 0, 'asset_present', 'No such file: {{base}}.tar.gz'),
      (4, 3, 1, 12, 1, 'columns_equal(disk_image)', 'Unexpected disk_image'),
      (4, 3, 1, 13, 0, 'asset_present', 'No such file: {{base}}.dmg'),
      (5, 1, 0, 4, 0, 'columns_equal(tag)', 'Tag and manifest version differ'),
      (6, 1, 0, 5, 1, 'equals_constant(architecture)', 'Expected x64'),
      (7, 1, 0, 5, 1, 'equals_constant(architecture)', 'Expected x64'),
      (7, 1, 0, 10, 0, 'required_key', '''models'''),
      (8, 1, 0, 6, 1, 'equals_constant(team_identifier)', 'Expected the signing team'),
      (9, 1, 0, 7, 1, 'strict_true(notarized)', 'Only notarized builds may be published'),
      (10, 1, 0, 8, 1, 'full_match(source_commit)', 'Missing source commit'),
      (11, 1, 0, 9, 1, 'nonempty_object(server)', 'Missing server description'),
      (12, 1, 0, 10, 0, 'required_key', '''models'''),
      (13, 1, 0, 10, 1, 'nonempty_array(models)', 'Missing model catalog'),
      (14, 2, 0, 11, 5, 'required_keys(models[])', 'Model missing dimensions'),
      (15, 3, 0, 12, 1, 'columns_equal(archive)', 'Unexpected archive'),
      (16, 3, 1, 12, 1, 'columns_equal(disk_image)', 'Unexpected disk_image'),
      (17, 3, 1, 13, 0, 'asset_present', 'No such file: {{base}}.dmg'),
      (18, 3, 0, 14, 0, 'sidecar_matches', 'Invalid checksum for {{base}}.tar.gz'),
      (19, 3, 0, 14, 0, 'sidecar_matches', 'Invalid checksum for {{base}}.tar.gz'),
      (20, 3, 0, 15, 1, 'digest_matches_manifest', 'Archive checksum differs from manifest'),
      (21, 3, 0, 15, 0, 'required_key', '''archive_sha256'''),
      (21, 3, 0, 15, 1, 'digest_matches_manifest', 'Archive checksum differs from manifest'),
      (22, 4, 0, 16, 0, 'archive_readable', 'not a gzip file'),
      (23, 5, 5, 17, 0, 'safe_path', 'Unsafe archive path'),
      (24, 5, 5, 17, 0, 'safe_path', 'Unsafe archive path'),
      (25, 5, 5, 18, 0, 'path_root', 'Unexpected archive root'),
      (26, 5, 5, 19, 0, 'allowed_kind', 'Unsupported archive member'),
      (27, 5, 5, 20, 0, 'link_allowlist', 'Unexpected symlink'),
      (28, 6, 0, 21, 0, 'require_member(entrypoint)', '''{{base}}/run'''),
      (29, 6, 0, 22, 0, 'member_property(entrypoint)', 'Entry point is not executable'),
      (30, 6, 0, 22, 0, 'member_property(entrypoint)', 'Entry point is not executable'),
      (31, 6, 0, 23, 0, 'require_member(alias)', '''{{base}}/compat'''),
      (32, 6, 0, 23, 1, 'member_property(alias)', 'Missing client compatibility entry'),
      (33, 6, 0, 24, 0, 'require_any_prefix(resources)', 'Missing resources')
    ) AS k(fault, phase, item_pos, rule_ord, sub_pos, rule, message) ON k.fault = {_FAULT_NUMBER}
"""


@query(_ALL_FOUND)
def release_violations(spark, sf_dir):
    """All violations of all releases."""
    return validate(CONTRACT, *document_releases(spark, sf_dir))[0]


@query(f"""
    SELECT v.*, d.lang IS NOT DISTINCT FROM 'fr' AS judged
    FROM ({_VERDICTS}) v JOIN documents d ON d.doc_id = v.release_id
""")
def validate_changed_releases(spark, sf_dir):
    """The second of two runs that keep results: tags of one language were others in the first."""
    candidates, *tables = document_releases(spark, sf_dir)
    log = fresh_folder(spark, "results")
    create_results(candidates, log)
    french = table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("release_id"), F.lit(True).alias("other"))
    before = candidates.join(french, "release_id", "left").select(
        "release_id", F.when(F.col("other"), F.concat("tag", F.lit("+"))).otherwise(F.col("tag")).alias("tag")
    )
    validate_changed(CONTRACT, before, *tables, log, 1)
    _, verdicts, judged = validate_changed(CONTRACT, candidates, *tables, log, 2)
    again = verdicts.join(judged.withColumn("judged", F.lit(True)), "release_id", "left")
    return again.select("release_id", "passed", "rule", "message", F.coalesce("judged", F.lit(False)).alias("judged"))


@query(f"""
    SELECT d.doc_id AS release_id, k.ord, k.kind,
           CASE k.ord WHEN 0 THEN 'release.json'
                      ELSE 'pack-1.0.' || d.doc_id || '-any-x64' || k.suffix END AS name
    FROM documents d, (VALUES (0, 'manifest', ''), (1, 'archive', '.tar.gz'),
                       (2, 'archive_sidecar', '.tar.gz.sha256'), (3, 'image', '.dmg'),
                       (4, 'image_sidecar', '.dmg.sha256')) AS k(ord, kind, suffix)
    WHERE {_FAULT_NUMBER} NOT IN (1, 2, 3, 4)
    UNION ALL
    SELECT d.doc_id, k.ord, k.kind,
           CASE k.ord WHEN 0 THEN 'release.json'
                      ELSE 'pack-1.0.' || d.doc_id || '--any-x64' || k.suffix END
    FROM documents d, (VALUES (0, 'manifest', ''), (1, 'archive', '.tar.gz'),
                       (2, 'archive_sidecar', '.tar.gz.sha256'), (3, 'image', '.dmg'),
                       (4, 'image_sidecar', '.dmg.sha256')) AS k(ord, kind, suffix)
    WHERE {_FAULT_NUMBER} = 4
""")
def manifest_inventory(spark, sf_dir):
    configure(spark)
    described = described_releases(table(spark, sf_dir, "documents").select(*_PACKED))
    candidates, manifests = manifests_of(described)
    return release_inventory(CONTRACT, manifest_facts(CONTRACT, candidates, manifests))


# Publishing: the sources are products, a text's digest is its tag, which copies share, and a
# tag with a hyphen is a prerelease, as the texts in two languages are. The first document with a tag is admitted; of these, the ones
# with characters of several bytes count as incompletely uploaded and stay drafts.
_PUBLISHED = """
    SELECT * FROM (
      SELECT *, sha256(text) || CASE WHEN lang IN ('de', 'es') THEN '-rc' ELSE '' END AS tag
      FROM documents
    ) QUALIFY row_number() OVER (PARTITION BY tag ORDER BY doc_id) = 1
"""


def _tagged_documents(spark, sf_dir):
    suffix = F.when(F.col("lang").isin("de", "es"), "-rc").otherwise("")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("release_id"),
        F.concat(content_digest(F.col("text")), suffix).alias("tag"),
        "source",
        "doc_id",
        F.octet_length("text").cast("bigint").alias("size"),
        (F.octet_length("text") == F.col("n_chars")).alias("complete"),
    )


def _published(spark, sf_dir):
    """Admit, draft, reconcile and publish the tagged documents; returns index and candidates."""
    registry = fresh_folder(spark, "registry")
    create_registry(spark, registry)
    candidates = _tagged_documents(spark, sf_dir)
    index = scan_index(spark, releases_path(registry))
    admitted, _ = reject_existing(candidates, index, ["tag"], ["doc_id"])
    admitted = materialise(admitted)
    files = admitted.select("release_id", F.lit("text").alias("name"), "size")
    uploads = admitted.select(
        "release_id",
        F.lit("text").alias("name"),
        F.lit(0).alias("upload_pos"),
        F.when(F.col("complete"), F.col("size")).otherwise(F.col("size") - 1).alias("size"),
    )
    rows = index_rows(admitted, F.col("source"), F.col("doc_id"))
    draft_release(rows, registry, 1)
    return publish(rows, upload_violations(files, uploads), registry, 1), candidates


_INDEX = """SELECT doc_id::VARCHAR AS release_id, tag, source AS product,
           source || ' ' || tag AS title,
           CASE WHEN contains(tag, '-') THEN 'prerelease' ELSE 'stable' END AS channel,
           doc_id AS arrival, '{state}' AS state, 1::BIGINT AS seq"""
_PUBLISHED_INDEX = f"""
    {_INDEX.format(state="published")} FROM ({_PUBLISHED}) WHERE strlen(text) = n_chars
"""


@query(_PUBLISHED_INDEX)
def publish_release(spark, sf_dir):
    return _published(spark, sf_dir)[0].where(F.col("state") == "published")


@query(f"{_PUBLISHED_INDEX} UNION ALL {_INDEX.format(state='draft')} FROM ({_PUBLISHED})")
def scan_releases(spark, sf_dir):
    """The whole index: an incomplete upload has left a draft and nothing else."""
    return _published(spark, sf_dir)[0]


@query("""
    SELECT page_id::VARCHAR AS release_id, 'v' || page_id AS tag, 0::BIGINT AS upload_pos,
           url AS name, strlen(html) AS size, 4::BIGINT AS seq
    FROM pages
""")
def write_upload_listing(spark, sf_dir):
    uploads = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("release_id"),
        F.concat(F.lit("v"), F.col("page_id")).alias("tag"),
        F.lit(0).cast("bigint").alias("upload_pos"),
        F.col("url").alias("name"),
        F.octet_length("html").cast("bigint").alias("size"),
    )
    return keep_listing(uploads, fresh_folder(spark, "registry"), 4)


@query(f"""
    SELECT source AS product, tag, doc_id::VARCHAR AS release_id,
           'release.json:' || (n_chars * 2) AS manifest, 'text.tar.gz:' || strlen(text) AS archive
    FROM ({_PUBLISHED}) WHERE strlen(text) = n_chars AND NOT contains(tag, '-')
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1
""")
def resolve_latest(spark, sf_dir):
    """Of each product's latest release the manifest and the archive, each with its size."""
    releases, files = _published(spark, sf_dir)
    kinds = F.array(
        F.struct(F.lit("manifest").alias("kind"), F.lit("release.json").alias("name"), (F.col("size") * 2).alias("size")),
        F.struct(F.lit("archive").alias("kind"), F.lit("text.tar.gz").alias("name"), F.col("size").alias("size")),
        F.struct(F.lit("image").alias("kind"), F.lit("text.dmg").alias("name"), F.col("size").alias("size")),
    )
    listed = files.select("release_id", F.explode(kinds).alias("file")).select("release_id", "file.*")
    latest = resolve(releases, listed, ["release_id"], ["product"], ["seq", "arrival", "tag"])
    pairs = manifest_and_archive(latest, ["product", "tag", "release_id"], ["name", "size"])

    def told(kind):
        return F.concat_ws(":", f"{kind}.name", F.col(f"{kind}.size").cast("string")).alias(kind)

    return pairs.select("product", "tag", "release_id", told("manifest"), told("archive"))
