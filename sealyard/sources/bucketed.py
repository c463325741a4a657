"""Tables in buckets: rows with one key lie in one file of a known number, so that joins on the key move nothing.

Spark keeps the number of buckets in its catalogue only. Here it lies beside the files, so that any session can open
such a table by its folder.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealyard.functions.text import quoted
from sealyard.sources.commits import put_if_absent
from sealyard.sources.named import qualified


def column_name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def write_buckets(df: DataFrame, path: str, by: Sequence[str], buckets: int) -> None:
    """Write ``df`` to a new folder, one file per bucket, sorted by the key; the number is not noted down."""
    spark = df.sparkSession
    dealt = df.repartition(buckets, *[F.col(column_name(c)) for c in by])
    name = f"sealyard_written_{hashlib.md5(path.encode()).hexdigest()}"
    writer = dealt.write.format("parquet").bucketBy(buckets, *by).sortBy(*by)
    writer.mode("errorifexists").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalogue; the files stay


def open_buckets(spark: SparkSession, path: str, schema: T.StructType, by: Sequence[str], buckets: int) -> DataFrame:
    """The table that ``write_buckets`` has written; joins and aggregations on the key make use of its buckets."""
    name = f"sealyard_buckets_{hashlib.md5(path.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{column_name(f.name)} {f.dataType.simpleString()}" for f in schema)
        key = ", ".join(map(column_name, by))
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS "
            f"LOCATION {quoted(path)}"
        )
    return spark.table(name)


def write_bucketed(df: DataFrame, path: str, by: Sequence[str], buckets: int) -> DataFrame:
    """Write ``df`` to a new folder in buckets by its key, with a note of their number, and return the table.

    Tables that are joined need the same number. A key that a third of all rows have is one bucket: choose keys that
    tell rows nearly apart, such as a release and a file's name.
    """
    root = qualified(df.sparkSession, path)
    write_buckets(df, f"{root}/rows", by, buckets)
    about = {"schema": df.schema.json(), "by": list(by), "buckets": buckets}
    if not put_if_absent(df.sparkSession, f"{root}/about.json", json.dumps(about) + "\n"):
        raise FileExistsError(root)
    return read_bucketed(df.sparkSession, path)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``write_bucketed`` has written in whole; an error if there is none."""
    root = qualified(spark, path)
    (row,) = spark.read.text(f"{root}/about.json", wholetext=True).collect()
    about = json.loads(row.value)
    schema = T.StructType.fromJson(json.loads(about["schema"]))
    return open_buckets(spark, f"{root}/rows", schema, about["by"], about["buckets"])
