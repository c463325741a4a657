"""A log of batches: rows that many tasks write, made visible all at once by one small marker.

Below a log's folder lie ``batches/ATTEMPT``, the rows of one attempt to write a batch, and ``commits/NAME.json``, a
marker for each batch that counts. A writer fills a folder of its own and then creates the marker, which succeeds for
one writer of a name only; readers follow the markers, so that they see all of a batch or nothing, and never what a
failed or losing attempt has left.

Markers have a ``seq``; a snapshot is what has a ``seq`` up to some number. Small batches are folded into large files
by a compaction, which is a marker too: it names the markers whose rows its folder repeats. Readers then read that
folder and the markers it does not name, so no snapshot changes, and a batch that is committed meanwhile is neither
lost nor seen twice. The driver reads one line per batch that no compaction covers, and names of those covered.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealyard.sources.named import qualified
from sealyard.sources.streams import locate

_MARKER = "name string, seq bigint, kind string, folder string, covers array<string>"
COMPACTION = "compaction"
FILE_BYTES = 256 * 1024 * 1024


class AlreadyCommitted(RuntimeError):
    """Another writer has committed a batch of this name."""


@dataclass(frozen=True)
class Marker:
    name: str
    seq: int
    kind: str
    folder: str
    covers: tuple[str, ...] = field(default=())


def marker_name(seq: int, kind: str) -> str:
    return f"{seq:020d}.{kind}"


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this content, unless there is one: of several writers one gets True.

    The content is written under a name of its own and put in place by one step that fails where a file is: a hard
    link on a local or mounted file system, elsewhere a rename without replacement, which the store has to make one step.
    """
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    if path.startswith("file:"):
        _, place = locate(path)
        _, own = locate(draft)
        os.makedirs(os.path.dirname(place), exist_ok=True)
        with open(own, "x", encoding="utf-8") as sink:
            sink.write(text)
            sink.flush()
            os.fsync(sink.fileno())
        try:
            os.link(own, place)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
    return _rename_if_absent(spark, draft, path, text)


def _rename_if_absent(spark: SparkSession, draft: str, path: str, text: str) -> bool:
    system, own = _system(spark, draft)
    _, place = _system(spark, path)
    sink = system.create(own, False)
    try:
        sink.write(bytearray(text.encode("utf-8")))
    finally:
        sink.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    keep = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    keep[0] = getattr(hadoop, "Options$Rename").NONE
    try:
        context.rename(own, place, keep)
        return True
    except Exception as problem:
        if system.exists(place):
            system.delete(own, False)
            return False
        raise problem


def commit(
    rows: DataFrame, log: str, seq: int, kind: str, name: str | None = None, covers: Iterable[str] = ()
) -> Marker:
    """Write ``rows`` with as many tasks as their plan has, and make them visible as a batch of that name.

    Raises ``AlreadyCommitted`` if there is one; nothing of this attempt is then seen.
    """
    spark = rows.sparkSession
    root = qualified(spark, log)
    name = marker_name(seq, kind) if name is None else name
    place = f"{root}/commits/{name}.json"
    taken = AlreadyCommitted(f"[BATCH_ALREADY_EXISTS] {name} of {log} is committed")
    if is_committed(spark, log, name):
        raise taken
    folder = f"batches/{name}-{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").parquet(f"{root}/{folder}")
    found = Marker(name, seq, kind, folder, tuple(covers))
    if not put_if_absent(spark, place, json.dumps(found.__dict__) + "\n"):
        raise taken
    return found


def is_committed(spark: SparkSession, log: str, name: str) -> bool:
    """Whether a marker of that name is there now."""
    system, place = _system(spark, f"{qualified(spark, log)}/commits/{name}.json")
    return system.exists(place)


def read_markers(spark: SparkSession, log: str) -> list[Marker]:
    """All markers. A log without any is an error, never an empty log."""
    rows = spark.read.schema(_MARKER).json(f"{qualified(spark, log)}/commits").collect()
    if not rows:
        raise ValueError(f"no batch has ever been committed to {log}")
    return [Marker(r.name, r.seq, r.kind, r.folder, tuple(r.covers or ())) for r in rows]


def _view(markers: list[Marker]) -> tuple[Marker | None, list[Marker]]:
    """The compaction to be read, and the batches it does not cover."""
    compactions = [m for m in markers if m.kind == COMPACTION]
    base = max(compactions, key=lambda m: (len(m.covers), m.name), default=None)
    covered = set(base.covers) if base else set()
    return base, [m for m in markers if m.kind != COMPACTION and m.name not in covered]


def committed_names(markers: list[Marker]) -> set[str]:
    """Names of all batches that count, compacted ones included."""
    base, rest = _view(markers)
    return {m.name for m in rest} | set(base.covers if base else ())


def read_log(
    spark: SparkSession,
    log: str,
    schema: str,
    as_of: int | None = None,
    markers: list[Marker] | None = None,
    beyond: Iterable[str] = (),
) -> DataFrame:
    """The rows of all batches with a ``seq`` up to ``as_of``. ``schema`` must have a column ``seq``.

    Batches named in ``beyond`` are left out, unless a compaction has put them together with others.
    """
    root = qualified(spark, log)
    base, rest = _view(read_markers(spark, log) if markers is None else markers)
    beyond = set(beyond)
    folders = [base.folder] if base and not beyond.issuperset(base.covers) else []
    folders += [m.folder for m in rest if (as_of is None or m.seq <= as_of) and m.name not in beyond]
    rows = spark.read.schema(schema)
    if not folders:
        return spark.createDataFrame([], schema)
    found = rows.parquet(*[f"{root}/{folder}" for folder in folders])
    return found if as_of is None else found.where(F.col("seq") <= as_of)


def compact(spark: SparkSession, log: str, schema: str, by: str, file_bytes: int = FILE_BYTES) -> Marker | None:
    """Fold all batches into files of about ``file_bytes``, ordered by a column; None if there is at most one batch.

    Every row is kept with its ``seq``, so each snapshot stays as it is. Batches committed meanwhile stay beside it.
    """
    markers = read_markers(spark, log)
    base, rest = _view(markers)
    if len(rest) + (base is not None) < 2:
        return None
    root = qualified(spark, log)
    total = 0
    for folder in [m.folder for m in rest] + ([base.folder] if base else []):
        system, place = _system(spark, f"{root}/{folder}")
        total += system.getContentSummary(place).getLength()
    files = max(1, math.ceil(total / file_bytes))
    rows = read_log(spark, log, schema, markers=markers).repartitionByRange(files, by).sortWithinPartitions(by)
    covers = sorted(committed_names(markers))
    seq = max(m.seq for m in markers)
    return commit(rows, log, seq, COMPACTION, f"{marker_name(seq, COMPACTION)}-{len(covers)}", covers)


def remove_unread(spark: SparkSession, log: str, older_than: float) -> int:
    """Delete the folders of batches that no reader follows any more, and return how many.

    These are attempts that failed or lost, and batches a compaction has replaced. Those changed in the last
    ``older_than`` seconds stay, as a writer may still be at work, or a reader that began before the compaction.
    """
    # Listed before the markers are read: a folder committed in between is among the markers then.
    root = qualified(spark, log)
    system, place = _system(spark, f"{root}/batches")
    there = [(s.getPath(), s.getModificationTime() / 1000) for s in system.listStatus(place)]
    base, rest = _view(read_markers(spark, log))
    wanted = {m.folder for m in [*rest, *([base] if base else [])]}
    gone = 0
    for path, changed in there:
        if f"batches/{path.getName()}" not in wanted and changed <= time.time() - older_than:
            gone += bool(system.delete(path, True))
    return gone
