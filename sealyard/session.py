"""Session settings the operators rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Set what correctness needs; leave sizing to whoever owns the cluster.

    Objects with a repeated key keep the last value instead of being rejected.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


#: Bytes that go to Python at a time; a batch is in memory on both sides, and in each of a task's Python workers.
BATCH_BYTES = 1024 * 1024


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes where the session has no limit of its own; a longer row is a batch by itself.

    Rows may hold whole files, so a limit by rows leaves the memory of Python workers to the data.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A session without that setting keeps such tables in its warehouse folder if all its
    tasks run in this process; on a cluster that folder may be one machine's own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    already = spark.sparkContext.getCheckpointDir()
    if already:
        return already.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return spark.conf.get("spark.sql.warehouse.dir", None).rstrip("/") + "/shared-tables"


def session_folder(spark: SparkSession) -> str:
    """The part of the shared folder that holds this session's tables and nothing else."""
    return f"{shared_folder(spark)}/sealyard-{spark.sparkContext.applicationId}"


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new, empty path below the shared folder."""
    return f"{session_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> bool:
    """Delete the tables this session has written to the shared folder.

    To be called when no result that reads them is needed any more.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(system.delete(place, True))


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written rows.

    For results that several branches read and that are dear to compute again,
    such as digests: a lost executor then costs a re-read, not a re-hash. Being a
    columnar table, each branch reads its columns only, and joins know its size.
    """
    return stored(df, fresh_folder(df.sparkSession, "table"))


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to a path that must be new, and return the table read from it."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
