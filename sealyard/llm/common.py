"""What several of the operators share: reading a table, and running a function over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words: space, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of(key: Column) -> Column:
    """crc32 of a key written as text; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary"))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add, whatever their case."""
    taken = {name.lower() for name in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


#: Rows that go to Python at a time. Texts are long rows, and a batch is in memory on both sides.
BATCH_ROWS = 1000


def in_batches(df: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` with batches that fit rows of text."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(df.sparkSession.conf.get(setting))
    if given <= 0 or given > BATCH_ROWS:
        df.sparkSession.conf.set(setting, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def add_columns(
    df: DataFrame, inputs: Sequence[str], fields: str, function: Callable, rows: int = 512
) -> DataFrame:
    """``df`` with the columns ``fields`` (DDL), computed from the columns ``inputs`` in batches.

    ``function()`` is called once in each task and returns what maps lists of the inputs to lists of the
    new columns, ``rows`` rows at a time. Columns of ``df`` named like a new one are replaced. A batch is
    passed on as it is, so no other column is turned into Python values.
    """
    added = T.StructType.fromDDL(fields)
    kept = without(df, added.names)
    schema = T.StructType([*kept.schema.fields, *added.fields])
    names = list(inputs)

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in added.fields]
        compute = function()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = compute(*[part.column(part.schema.get_field_index(n)).to_pylist() for n in names])
                new = [pa.array(list(v), kind) for v, kind in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return in_batches(kept, run, schema)
