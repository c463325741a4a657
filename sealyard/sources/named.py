"""Files opened by the name they should have, instead of found by listing folders.

A listing of a whole registry is gathered on the driver, once per source. Where the
wanted files are rows of a table already, tasks can go to them directly: nothing grows
on the driver, files nobody asked for cost nothing, and empty files are seen too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealyard.sources.streams import locate

# Small requests mostly wait for the file system, so a task has several under way.
IN_FLIGHT = 16
# Texts are handed on when there are so many bytes of them; Arrow counts with 32 bits.
_BATCH_BYTES = 64 * 1024 * 1024


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, as Spark itself would resolve it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(place).toString().rstrip("/")


def balance(files: DataFrame, weight: Column, per_task: int, by: Sequence[str]) -> DataFrame:
    """Spread rows over tasks by the work behind them, found by one small aggregate.

    The rows themselves are tiny, so adaptive coalescing would put all of them, and
    with them all the work, into one task. An explicit number is left alone.
    """
    total = files.agg(F.sum(weight)).first()[0] or 0
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(cores, math.ceil(total / per_task)), *by)


def balance_by_bytes(files: DataFrame, bytes_per_task: int = 256 * 1024 * 1024) -> DataFrame:
    """Spread files with a ``length`` so that tasks read about equally many bytes.

    Files are dealt by hash into groups of some tasks' worth of bytes. Within a group they
    are lined up, and each stretch of ``bytes_per_task`` is a task, so a long file has one
    to itself and short ones share.
    """
    total = files.agg(F.sum("length")).first()[0] or 0
    cores = files.sparkSession.sparkContext.defaultParallelism
    share = min(bytes_per_task, max(1, math.ceil(total / cores)))
    tasks = max(cores, math.ceil(total / share))
    group = F.pmod(F.xxhash64("path"), F.lit(math.ceil(tasks / 16)))
    line = Window.partitionBy("_group").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("length").over(line), F.lit(0))
    dealt = files.withColumn("_group", group).withColumn("_slot", F.floor(before / share))
    return dealt.repartitionByRange(tasks, "_group", "_slot").drop("_group", "_slot")


def _per_file(
    files: DataFrame, key: Sequence[str], look: Callable, column: str, files_per_task: int
) -> DataFrame:
    wanted = balance(files.select(*key, "path"), F.lit(1), files_per_task, ["path"])
    fields = wanted.select(*key).schema
    key_ddl = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in fields)
    names = [*fields.names, column.split()[0]]
    of_text = column.endswith("string")

    def visit(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        kind = pa.string() if of_text else pa.int64()

        def output(batch, first, seen):
            keys = [batch.column(i).slice(first, len(seen)) for i in range(len(fields))]
            return pa.RecordBatch.from_arrays([*keys, pa.array(seen, kind)], names)

        with ThreadPoolExecutor(IN_FLIGHT) as pool:
            for batch in batches:
                paths = batch.column(len(fields)).to_pylist()
                first, seen, size = 0, [], 0
                for at in range(0, len(paths), IN_FLIGHT):
                    for found in pool.map(look, paths[at : at + IN_FLIGHT]):
                        grown = len(found) * 4 if of_text and found else 0
                        if seen and size + grown > _BATCH_BYTES:
                            yield output(batch, first, seen)
                            first, seen, size = first + len(seen), [], 0
                        seen.append(found)
                        size += grown
                if seen:
                    yield output(batch, first, seen)

    return wanted.mapInArrow(visit, f"{key_ddl}, {column}")


def _text_of(path: str) -> str | None:
    system, place = locate(path)
    try:
        with system.open_input_file(place) as stream:
            return stream.read().decode("utf-8")
    except (FileNotFoundError, PermissionError, UnicodeDecodeError):
        return None


def _length_of(path: str) -> int | None:
    system, place = locate(path)
    info = system.get_file_info(place)
    return info.size if info.is_file else None


def _state_of(path: str) -> str | None:
    system, place = locate(path)
    info = system.get_file_info(place)
    return f"{info.size}:{info.mtime_ns}" if info.is_file else None


def read_texts(files: DataFrame, key: Sequence[str], files_per_task: int = 1000) -> DataFrame:
    """``key, raw``: the text at each ``path``, NULL where there is none in UTF-8."""
    return _per_file(files, key, _text_of, "raw string", files_per_task)


def file_lengths(files: DataFrame, key: Sequence[str], files_per_task: int = 5000) -> DataFrame:
    """``key, length``: bytes of the file at each ``path``, NULL where there is none."""
    return _per_file(files, key, _length_of, "length bigint", files_per_task)


def file_states(files: DataFrame, key: Sequence[str], files_per_task: int = 5000) -> DataFrame:
    """``key, state``: length and time of the last change of the file at each ``path``, NULL where there is none."""
    return _per_file(files, key, _state_of, "state string", files_per_task)
