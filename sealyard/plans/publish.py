"""Staging and publishing admitted releases into an append-only registry.

Layout below the registry folder: ``releases`` the index, a log of batches
(``sources.commits``), ``uploads`` the observed listings, another such log,
``files/TAG/NAME`` the bytes. A publisher's number ``seq`` is taken by the batch of its drafts and closed by that
of the releases it publishes. Both are written by many tasks and become visible by a marker
that is created only if there is none, so of two publishers with one number one fails, and
readers see all of a batch or nothing. A release exists for readers once its row is
published. Rows are never changed; a draft that nobody will finish is withdrawn by a row of
its own, which frees the tag.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealyard.fixed import MESSAGES
from sealyard.functions.predicates import safe_path
from sealyard.functions.text import classify_channel, path_parts
from sealyard.operators.inventory import reconcile_by_fingerprint
from sealyard.operators.lookup import KeyIndex, open_key_index, taken_keys, write_key_index
from sealyard.operators.registry import reject_existing
from sealyard.operators.rules import Rule, violations
from sealyard.plans.contract import ReleaseContract
from sealyard.plans.validate import validate_folder
from sealyard.session import materialise
from sealyard.sources.commits import (
    AlreadyCommitted,
    commit,
    committed_names,
    is_committed,
    marker_name,
    read_log,
    read_markers,
)
from sealyard.sources.files import RELEASES_SCHEMA, scan_releases
from sealyard.sources.named import IN_FLIGHT, balance, balance_by_bytes, file_lengths, qualified
from sealyard.sources.streams import copy_file, locate

_LISTING = "release_id string, tag string, upload_pos bigint, name string, size bigint"
UPLOADS_SCHEMA = f"{_LISTING}, seq bigint"
_INDEX = ["release_id", "tag", "product", "title", "channel", "arrival"]


def releases_path(registry: str) -> str:
    return f"{registry}/releases"


def create_registry(spark: SparkSession, registry: str) -> None:
    """An empty index. Needed once: a missing index is an error for every reader."""
    empty = spark.createDataFrame([], RELEASES_SCHEMA)
    commit(empty, releases_path(registry), 0, "draft")


def _append(rows: DataFrame, registry: str, state: str, seq: int) -> None:
    kept = rows.select(*_INDEX, F.lit(state).alias("state"), F.lit(seq).cast("bigint").alias("seq"))
    commit(kept, releases_path(registry), seq, state)


def draft_release(releases: DataFrame, registry: str, seq: int) -> None:
    """Enter releases as drafts: no reader resolves them, but their tags are taken.

    Takes the number ``seq``; raises ``AlreadyCommitted`` if another publisher has it.
    """
    _append(releases, registry, "draft", seq)


def withdraw_draft(
    tags: DataFrame, registry: str, seq: int, abandon: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(withdrawn, refused)``: remove left-over drafts, so that their tags can be tried again.

    ``tags`` has ``tag``; ``withdrawn`` is the index rows that end the drafts, ``refused``
    ``tag, reason``: ``published`` releases are never removed, ``no draft`` has the tag,
    ``open`` drafts belong to a publisher that has not closed its number, ``later`` ones are
    not older than ``seq``. With ``abandon`` such publishers are shut out first: their number is closed
    with nothing published, and whoever closes it first wins. The staged files go before
    the tag is free, so that a retry finds its folder empty; a run that ends in between is repeated.
    """
    spark = tags.sparkSession
    log = releases_path(registry)
    wanted = tags.select("tag").where(F.col("tag").isNotNull()).distinct()
    wanted = materialise(wanted)

    def drafts() -> DataFrame:
        return scan_releases(spark, log).join(wanted, ["tag"], "left_semi")

    if abandon:
        done = committed_names(read_markers(spark, log))
        for row in drafts().where("state = 'draft'").select("seq").distinct().collect():
            if row.seq < seq and marker_name(row.seq, "published") not in done:
                _close(spark, registry, row.seq)
    done = committed_names(read_markers(spark, log))
    index = materialise(drafts())
    # One number per batch that holds such a draft.
    held = [r.seq for r in index.where("state = 'draft'").select("seq").distinct().collect()]
    unfinished = [n for n in held if marker_name(n, "published") not in done]
    draft = F.when(F.col("state") == "draft", F.col("seq"))
    known = index.groupBy("tag").agg(
        F.bool_or(F.col("state") == "published").alias("published"), F.max(draft).alias("at")
    )
    reason = (
        F.when(F.col("published"), "published")
        .when(F.col("at").isNull(), "no draft")
        .when(F.col("at") >= seq, "later")
        .when(F.col("at").isin(*unfinished) if unfinished else F.lit(False), "open")
    )
    judged = materialise(wanted.join(known, ["tag"], "left").select("tag", reason.alias("reason")))
    ended = index.where("state = 'draft'").join(judged.where("reason IS NULL").select("tag"), ["tag"], "left_semi")
    ended = materialise(ended)
    every = ended.select("tag", F.lit("*").alias("pattern")).distinct()
    materialise(_remove_files(every, registry))
    _append(ended, registry, "withdrawn", seq)
    withdrawn = ended.withColumns({"state": F.lit("withdrawn"), "seq": F.lit(seq).cast("bigint")})
    return withdrawn, judged.where("reason IS NOT NULL")


def _close(spark: SparkSession, registry: str, seq: int) -> None:
    """Close a publisher's number with nothing published, unless it has just been closed."""
    try:
        _append(spark.createDataFrame([], RELEASES_SCHEMA), registry, "published", seq)
    except AlreadyCommitted:
        pass


def _is_within(part: Column) -> Column:
    """A name that stays in its folder and is not the folder itself."""
    named = safe_path(part, path_parts(part)) & (F.size(path_parts(part)) > 0)
    return F.coalesce(named, F.lit(False))


def _remove_files(tags: DataFrame, registry: str) -> DataFrame:
    """``tag, files``: how many files of each ``tag`` with names like its ``pattern`` have been deleted."""
    root = qualified(tags.sparkSession, f"{registry}/files")

    def remove(batches):
        from fnmatch import fnmatchcase

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            counts = []
            for tag, pattern in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, place = locate(f"{root}/{tag}")
                there = fs.FileSelector(place, allow_not_found=True, recursive=True)
                found = system.get_file_info(there)
                files = [i.path for i in found if i.is_file and fnmatchcase(i.base_name, pattern)]
                for path in files:
                    system.delete_file(path)
                counts.append(len(files))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["tag", "files"])

    wanted = balance(tags.where(_is_within(F.col("tag"))).select("tag", "pattern"), F.lit(1), 1000, ["tag"])
    return wanted.mapInArrow(remove, "tag string, files bigint")


def _parts_of(seq: Column) -> Column:
    """Names that half-copied files of a publisher have."""
    return F.concat(F.lit("*."), seq.cast("string"), F.lit("-*.part"))


def sweep_parts(spark: SparkSession, registry: str) -> int:
    """Delete what interrupted copies have left, and return how many files that were.

    Only files of publishers whose number is closed go: the others may be at work, or be resumed.
    """
    log = releases_path(registry)
    done = committed_names(read_markers(spark, log))
    drafts = scan_releases(spark, log).where("state = 'draft'")
    held = [r.seq for r in drafts.select("seq").distinct().collect()]
    unfinished = [n for n in held if marker_name(n, "published") not in done]
    ended = drafts.where(~F.col("seq").isin(*unfinished)) if unfinished else drafts
    parts = ended.select("tag", _parts_of(F.col("seq")).alias("pattern")).distinct()
    return materialise(_remove_files(parts, registry)).agg(F.sum("files")).first()[0] or 0


def _resume_drafts(releases: DataFrame, registry: str, seq: int) -> None:
    """Take up a number that an attempt of one's own has left open; the releases must be the drafted ones."""
    spark, log = releases.sparkSession, releases_path(registry)
    if marker_name(seq, "published") in committed_names(read_markers(spark, log)):
        raise AlreadyCommitted(f"[BATCH_ALREADY_EXISTS] number {seq} of {registry} is closed")
    drafted = scan_releases(spark, log).where((F.col("state") == "draft") & (F.col("seq") == seq))
    key = ["release_id", "tag"]
    one, two = drafted.select(*key), releases.select(*key)
    if not (one.join(two, key, "left_anti").isEmpty() and two.join(one, key, "left_anti").isEmpty()):
        raise ValueError(f"the drafts of number {seq} are not the releases to be staged")
    materialise(_remove_files(two.select("tag", _parts_of(F.lit(seq)).alias("pattern")).distinct(), registry))


def index_tags(spark: SparkSession, registry: str) -> KeyIndex:
    """Index the tags that are taken now, so that later batches are checked without reading the registry.

    Best done after a compaction, and again when many batches have come since.
    """
    log = releases_path(registry)
    names = sorted(committed_names(read_markers(spark, log)))
    # Batches committed since the names were read may be in the index too, and are read again: that is no fault.
    live = scan_releases(spark, log).select("tag")
    return write_key_index(live, f"{registry}/tags/{len(names):020d}-{uuid.uuid4().hex}", ["tag"], note=names)


def _latest_tag_index(spark: SparkSession, registry: str) -> KeyIndex | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{qualified(spark, registry)}/tags/*/about.json")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(str(status.getPath().getParent()) for status in system.globStatus(place) or [])
    return open_key_index(spark, found[-1]) if found else None


def taken_tags(candidates: DataFrame, registry: str) -> DataFrame:
    """Of the candidates' tags those that are taken, and others that are; only ``tag``.

    With an index of tags, only what it lets pass and the batches since it was made are read.
    """
    spark, log = candidates.sparkSession, releases_path(registry)
    index = _latest_tag_index(spark, registry)
    if index is None:
        return scan_releases(spark, log).select("tag")
    recent = scan_releases(spark, log, beyond=index.note)
    ended = read_log(spark, log, RELEASES_SCHEMA, beyond=index.note).where("state = 'withdrawn'").select("tag")
    # A tag that was withdrawn since is free, unless a batch since has taken it again.
    held = taken_keys(candidates.select("tag"), index).join(ended.distinct(), "tag", "left_anti")
    return held.unionByName(recent.select("tag"))


def tag_violations(rejected: DataFrame, key: Sequence[str] = ("release_id",)) -> DataFrame:
    """Rule 26 for candidates whose tag exists already, in the registry or the batch."""
    taken = Rule(
        "tag_not_published", 26, F.lit(False),
        F.concat(F.lit("Release "), "tag", F.lit(" already exists")), phase=7,
    )
    return violations(rejected, key, [taken])


def upload_violations(
    expected: DataFrame, uploads: DataFrame, key: Sequence[str] = ("release_id",)
) -> DataFrame:
    """Rule 25: each expected file is uploaded in full. Extra uploads are no fault.

    ``expected`` has ``key, name, size``, uploads ``key, name, upload_pos, size``. An
    upload without a name makes the listing as a whole unusable.
    """
    usable = Rule(
        "upload_listing_readable", 25, F.col("name").isNotNull(),
        "Upload without name or size", phase=8, item_pos=-1,
    )
    status = reconcile_by_fingerprint(
        expected.select(*key, "name", "size"), uploads, key, ["name"], "size", ["upload_pos"], only_faults=True
    )
    complete = Rule(
        "upload_size_matches", 25, F.col("status") == "ok",
        F.concat(F.lit(MESSAGES["upload_size_matches"]), "name"), phase=8,
    )
    return violations(uploads, key, [usable]).unionByName(violations(status, key, [complete]))


def stage_release(
    files: DataFrame,
    releases: DataFrame,
    registry: str,
    seq: int,
    content: str | None = None,
    resume: bool = False,
) -> DataFrame:
    """Draft the releases, copy their files, and return the observed upload listing.

    ``releases`` has the index columns, ``files`` has ``release_id, tag, ord, name,
    length`` and the bytes as column ``content`` or else at ``path``. Drafts come
    first, so that an interrupted upload leaves a trace that blocks the tag until
    someone has looked at it. The listing holds the sizes found after the copy; a file
    whose name or tag leads out of its folder, or whose place another file has taken,
    is not copied and has no size.

    With ``resume`` a number that an interrupted attempt has left open is taken up, with the
    same releases: what it has half copied is deleted, files that are there are kept, and a
    listing that it finished is returned. That attempt must have ended.
    """
    try:
        draft_release(releases, registry, seq)
    except AlreadyCommitted:
        if not resume:
            raise
        _resume_drafts(releases, registry, seq)
        listed = _upload_listing(files.sparkSession, registry, seq)
        if listed is not None:
            return listed
    source = content if content is not None else "path"
    root, in_row = qualified(files.sparkSession, f"{registry}/files"), content is not None
    names = [column.split()[0] for column in _LISTING.split(", ")]

    def upload(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        def put(data, tag, name, safe):
            if not safe.as_py():
                return None
            return copy_file(data.as_buffer() if in_row else data.as_py(), f"{root}/{tag}/{name}", str(seq))

        with ThreadPoolExecutor(IN_FLIGHT) as pool:
            for batch in batches:
                asked = [batch.column(n) for n in ("_source", "tag", "name", "_safe")]
                sizes = list(pool.map(put, *asked))
                columns = [batch.column(i) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], names)

    safe = _is_within(F.col("tag")) & _is_within(F.col("name"))
    wanted = files.select(
        "release_id", "tag", F.col("ord").cast("bigint").alias("ord"), "name",
        F.col(source).alias("_source"), safe.alias("_safe"),
        F.concat_ws("/", "tag", "name").alias("path"),
        (F.octet_length(source) if in_row else F.col("length")).cast("bigint").alias("length"),
    )
    uploaded = balance_by_bytes(wanted).drop("path", "length").mapInArrow(upload, _LISTING)
    return write_upload_listing(uploaded, registry, seq)


def write_upload_listing(uploads: DataFrame, registry: str, seq: int) -> DataFrame:
    """Keep the observed listing for audit and go on from the stored rows."""
    kept = uploads.select(*[c.split()[0] for c in _LISTING.split(", ")], F.lit(seq).cast("bigint").alias("seq"))
    commit(kept, f"{registry}/uploads", seq, "uploads")
    return _upload_listing(uploads.sparkSession, registry, seq)


def _upload_listing(spark: SparkSession, registry: str, seq: int) -> DataFrame | None:
    """The listing of one number, if it has been written in whole."""
    log = f"{registry}/uploads"
    if not is_committed(spark, log, marker_name(seq, "uploads")):
        return None
    own = [m for m in read_markers(spark, log) if m.name == marker_name(seq, "uploads")]
    return read_log(spark, log, UPLOADS_SCHEMA, markers=own)


def read_upload_listings(spark: SparkSession, registry: str) -> DataFrame:
    return read_log(spark, f"{registry}/uploads", UPLOADS_SCHEMA)


def publish_release(releases: DataFrame, faults: DataFrame, registry: str, seq: int) -> DataFrame:
    """Append the releases without faults to the published index and return it.

    ``releases`` are the staged ones, ``faults`` their violations. A faulty one
    stays a draft. Published rows are never changed; "latest" follows from ``seq``. Raises
    ``AlreadyCommitted`` if the number is closed, by another publisher or by a withdrawal.
    """
    sound = releases.join(faults.select("release_id").distinct(), ["release_id"], "left_anti")
    _append(sound, registry, "published", seq)
    return scan_releases(releases.sparkSession, releases_path(registry))


def index_rows(admitted: DataFrame, product: Column, arrival: Column) -> DataFrame:
    """Admitted candidates as rows of the index, with title and channel from the tag."""
    return admitted.select(
        "release_id",
        "tag",
        product.alias("product"),
        F.concat_ws(" ", product, "tag").alias("title"),
        classify_channel(F.col("tag")).alias("channel"),
        arrival.cast("bigint").alias("arrival"),
    )


def validate_published(
    spark: SparkSession, contract: ReleaseContract, registry: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``validate_folder`` over what the registry itself holds; release ids are the tags."""
    published = scan_releases(spark, releases_path(registry)).where("state = 'published'")
    candidates = published.select(F.col("tag").alias("release_id"), "tag").distinct()
    return validate_folder(spark, contract, candidates, f"{registry}/files")


def publish_folder(
    spark: SparkSession,
    contract: ReleaseContract,
    candidates: DataFrame,
    path: str,
    registry: str,
    seq: int,
    resume: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(index, violations)``: validate, admit, stage, reconcile and publish a batch.

    ``candidates`` has ``release_id, tag, arrival``; ``path`` holds a folder per
    release id. What fails a step goes no further and is among the violations. With
    ``resume`` an interrupted run with this number is carried on.
    """
    inventory, found, judged = validate_folder(spark, contract, candidates, path)
    sound = candidates.join(judged.where("passed").select("release_id"), ["release_id"])
    sound = materialise(sound)
    if resume:
        # The drafts of this number are this batch's own.
        index = scan_releases(spark, releases_path(registry))
        taken = index.where(~((F.col("state") == "draft") & (F.col("seq") == seq))).select("tag")
    else:
        taken = taken_tags(sound, registry)
    taken = materialise(taken)
    admitted, rejected = reject_existing(sound, taken, ["tag"], ["arrival", "release_id"])
    # Written before the drafts are, as they must not see them.
    admitted = materialise(admitted)
    refused = materialise(tag_violations(rejected))
    files = inventory.join(admitted.select("release_id", "tag"), ["release_id"])
    lengths = file_lengths(files, ["release_id", "name"])
    files = materialise(files.join(lengths, ["release_id", "name"], "left"))
    rows = index_rows(admitted, F.lit(contract.product), F.col("arrival"))
    uploads = stage_release(files, rows, registry, seq, resume=resume)
    faults = materialise(upload_violations(files.withColumnRenamed("length", "size"), uploads))
    index = publish_release(rows, faults, registry, seq)
    return index, found.unionByName(refused).unionByName(faults)
