"""Release folders as a data source: ``spark.read.format("release_files")`` and ``"release_archives"``.

Nothing runs while a plan is built. When a query is executed the source lists the folders, leaves out files whose
names are not asked for, and lines up the rest so that each task gets about equally many bytes, a long file a task of
its own. Archives are then listed in these tasks, one pass over each, without extraction.

Options: ``path`` the folder that holds one folder per release, ``names`` and ``releases`` the patterns of names and the
ids that are read, one a line, ``bytesPerTask`` and ``filesPerTask``. Bytes are read by ``release_archives`` only, and
only of files that these leave. Filters of a query are applied by Spark to what is listed: the source does not take
them, as Spark 4.1.2 keeps those that one query has pushed for later queries on the same table.

As for every file source, a listing of what is read (names and lengths) is made in one place, the planner's Python
process, many requests at a time; it goes to the tasks in parts. Where that is too much, ``sources.files`` takes the
releases as a table and lists in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sealyard.sources.archives import listing_rows
from sealyard.sources.named import IN_FLIGHT, qualified
from sealyard.sources.streams import locate

FILES, ARCHIVES = "release_files", "release_archives"
_ROWS_PER_BATCH = 4096


@dataclass(frozen=True)
class FileRow:
    release_id: str
    name: str
    path: str
    length: int


class Files(InputPartition):
    """The files of one task."""

    def __init__(self, rows: tuple[FileRow, ...]):
        super().__init__(None)
        self.rows = rows


def in_shares(rows: list[FileRow], bytes_per_task: int, files_per_task: int) -> list[tuple[FileRow, ...]]:
    """The files in order, cut so that no share has more bytes or files than allowed, but for one longer file."""
    shares, share, size = [], [], 0
    for row in rows:
        if share and (size + row.length > bytes_per_task or len(share) >= files_per_task):
            shares.append(tuple(share))
            share, size = [], 0
        share.append(row)
        size += row.length
    return [*shares, tuple(share)] if share else shares


class _Reader(DataSourceReader):
    def __init__(self, options, width: int):
        self.root = options.get("path", "").rstrip("/")
        if not self.root:
            raise ValueError("the option path, the folder of the releases, is not given")
        self.bytes_per_task = int(options.get("bytesPerTask", 256 * 1024 * 1024))
        self.files_per_task = int(options.get("filesPerTask", 10_000))
        self.width = width
        given = options.get("releases")
        self.asked = None if given is None else {line for line in given.split("\n") if line}
        self.names = (options.get("names") or "*").split("\n")

    def listing(self) -> list[FileRow]:
        """The files that are asked for, by release and name."""
        from pyarrow import fs

        system, place = locate(self.root)
        asked = self.asked
        if asked is None:
            # A folder that is not there is an error, not a source without files.
            found = system.get_file_info(fs.FileSelector(place))
            asked = {i.base_name for i in found if i.type == fs.FileType.Directory}
        asked = sorted(r for r in asked if r and "/" not in r and r not in (".", ".."))

        def files_of(release: str) -> list[FileRow]:
            inside = system.get_file_info(fs.FileSelector(f"{place}/{release}", allow_not_found=True))
            files = [i for i in inside if i.is_file and any(fnmatchcase(i.base_name, n) for n in self.names)]
            rows = [FileRow(release, i.base_name, f"{self.root}/{release}/{i.base_name}", i.size) for i in files]
            return sorted(rows, key=lambda r: r.name)

        with ThreadPoolExecutor(IN_FLIGHT) as pool:
            return [row for rows in pool.map(files_of, asked) for row in rows]

    def partitions(self):
        rows = self.listing()
        # Little work is spread as well, over as many tasks as the session has slots.
        total = sum(row.length for row in rows)
        share = min(self.bytes_per_task, max(1, -(-total // self.width)))
        shares = in_shares(rows, share, max(1, min(self.files_per_task, -(-len(rows) // self.width))))
        return [Files(rows) for rows in shares] or [Files(())]


class _FileReader(_Reader):
    def read(self, partition):
        import pyarrow as pa

        rows = partition.rows
        columns = [[getattr(r, c) for r in rows] for c in ("release_id", "name", "path", "length")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["release_id", "name", "path", "length"]
        )


class _ArchiveReader(_Reader):
    def read(self, partition):
        import pyarrow as pa

        names = ["release_id", "name", "sha256", "length", "error", "member_pos", "member", "type", "mode", "linkname"]
        numbers = {"length", "member_pos", "mode"}
        kinds = [pa.int64() if n in numbers else pa.string() for n in names]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

        rows: list[tuple] = []
        for file in partition.rows:
            for row in self._rows_of(file.path):
                rows.append((file.release_id, file.name, *row))
                if len(rows) >= _ROWS_PER_BATCH:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    def _rows_of(self, path: str) -> Iterator[tuple]:
        system, place = locate(path)
        try:
            raw = system.open_input_file(place)
        except (FileNotFoundError, PermissionError) as gone:
            yield (None, None, str(gone), None, None, None, None, None)
            return
        with raw:
            yield from listing_rows(raw, True)


class ReleaseFiles(DataSource):
    """``release_id, name, path, length`` of the files in each release's folder; no content is read."""

    reads = _FileReader

    @classmethod
    def name(cls) -> str:
        return FILES

    def schema(self) -> str:
        return "release_id string, name string, path string, length bigint"

    def reader(self, schema) -> DataSourceReader:
        return self.reads(self.options, int(self.options.get("width", 8)))


class ReleaseArchives(ReleaseFiles):
    """``release_id, name`` and, of each tar.gz file, a row with digest, length and error, and a row per member."""

    reads = _ArchiveReader

    @classmethod
    def name(cls) -> str:
        return ARCHIVES

    def schema(self) -> str:
        return (
            "release_id string, name string, sha256 string, length bigint, error string, member_pos bigint, "
            "member string, type string, mode bigint, linkname string"
        )


def register_sources(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    for source in (ReleaseFiles, ReleaseArchives):
        spark.dataSource.register(source)


def read_release_files(
    spark: SparkSession, path: str, kind: str = FILES, names: Sequence[str] = ("*",), **options
) -> DataFrame:
    """A table of the files, or with ``kind`` of the archives, below ``path`` that have such names."""
    register_sources(spark)
    slots = spark.sparkContext.defaultParallelism
    reader = spark.read.format(kind).options(width=slots, names="\n".join(names), **options)
    return reader.load(qualified(spark, path))
