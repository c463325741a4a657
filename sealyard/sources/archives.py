"""Reading asset bytes once: digest of every file, member listing of archives."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealyard.functions.predicates import DIRECTORY, FILE, SYMLINK
from sealyard.session import bound_batches
from sealyard.sources.streams import HashingReader, locate

LISTING = (
    "sha256 string, length bigint, error string, member_pos bigint, member string, type string, "
    "mode bigint, linkname string"
)
_ROWS_PER_BATCH = 4096
_OTHER_KINDS = {b"1": "hardlink", b"3": "char", b"4": "block", b"6": "fifo"}


def member_kind(info: tarfile.TarInfo) -> str:
    if info.isfile():
        return FILE
    if info.isdir():
        return DIRECTORY
    if info.issym():
        return SYMLINK
    return _OTHER_KINDS.get(info.type, "other")


def _members(reader: HashingReader) -> Iterator[tuple]:
    """Headers of a gzip-compressed tar in file order; nothing is extracted."""
    with tarfile.open(fileobj=reader, mode="r:gz") as archive:
        position = 0
        while (info := archive.next()) is not None:
            # Headers are handed on, not gathered: an archive may have any number.
            archive.members.clear()
            yield (position, info.name, member_kind(info), info.mode, info.linkname)
            position += 1


def _text(value: str) -> str:
    """Undecodable bytes of a name become visible escapes, as Arrow wants valid UTF-8."""
    return value.encode("utf-8", "backslashreplace").decode("utf-8")


def listing_rows(raw, archive: bool) -> Iterator[tuple]:
    """Member rows of one open file, then its digest row with the error, if any."""
    reader = HashingReader(raw)
    error = None
    if archive:
        try:
            for position, name, kind, mode, target in _members(reader):
                yield (None, None, None, position, _text(name), kind, mode, _text(target))
        except Exception as problem:  # any damage is a finding about this one archive
            if reader.failure is not None:
                raise reader.failure from problem
            error = str(problem) or type(problem).__name__
    digest = reader.finish()
    yield (digest, reader.digested, error, None, None, None, None, None)


def read_bytes_once(
    files: DataFrame,
    key: Sequence[str],
    archives: bool | Column = True,
    content: str | None = None,
) -> DataFrame:
    """``key`` and the columns of ``LISTING`` from a single pass over each file.

    One row without ``member_pos`` per file has its digest, or what kept an archive
    from being listed; the other rows are its members. Bytes come from the column
    ``content`` or else from the file ``path``, in chunks and never whole.
    """
    bound_batches(files.sparkSession)
    archive = archives if isinstance(archives, Column) else F.lit(archives)
    source = content if content is not None else "path"
    wanted = files.select(*key, F.col(source).alias("_source"), archive.alias("_archive"))
    identity = wanted.select(*key).schema
    names = [*identity.names, *[column.split()[0] for column in LISTING.split(", ")]]
    key_ddl = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in identity)
    n_keys, in_row = len(identity), content is not None

    def listing(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "bigint": pa.int64()}
        types = [kinds[column.split()[1]] for column in LISTING.split(", ")]

        def output(batch, picks, rows):
            keys = [batch.column(i).take(pa.array(picks)) for i in range(n_keys)]
            found = [pa.array(values, kind) for values, kind in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays(keys + found, names)

        for batch in batches:
            picks, rows = [], []
            for i in range(batch.num_rows):
                place = batch.column(n_keys)[i]
                try:
                    raw = pa.BufferReader(place.as_buffer()) if in_row else _open(place.as_py())
                except (FileNotFoundError, PermissionError) as gone:
                    picks.append(i)
                    rows.append((None, None, str(gone), *[None] * 5))
                    continue
                with raw:
                    for row in listing_rows(raw, batch.column(n_keys + 1)[i].as_py()):
                        picks.append(i)
                        rows.append(row)
                        if len(rows) >= _ROWS_PER_BATCH:
                            yield output(batch, picks, rows)
                            picks, rows = [], []
            if rows:
                yield output(batch, picks, rows)

    return wanted.mapInArrow(listing, f"{key_ddl}, {LISTING}")


def _open(path: str):
    system, place = locate(path)
    return system.open_input_file(place)


def list_archives(
    files: DataFrame, key: Sequence[str], content: str | None = None
) -> DataFrame:
    """``key, member_pos, name, type, mode, linkname, error``: the entries of tar.gz files.

    A damaged archive has, after the entries before the damage, a row with the error alone.
    """
    listing = read_bytes_once(files, key, True, content)
    told = listing.where(F.col("member_pos").isNotNull() | F.col("error").isNotNull())
    return told.select(
        *key, "member_pos", F.col("member").alias("name"), "type", "mode", "linkname", "error"
    )


def members_of(listing: DataFrame, key: Sequence[str]) -> DataFrame:
    return listing.where(F.col("member_pos").isNotNull()).select(
        *key, "member_pos", F.col("member").alias("name"), "type", "mode", "linkname"
    )


def digests_of(listing: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, sha256, length, error``: one row per file; no digest where none was found."""
    columns = [*key, "sha256", "length", "error"]
    return listing.where(F.col("member_pos").isNull()).select(*columns)
