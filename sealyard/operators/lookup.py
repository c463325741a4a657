"""Keys that are taken, kept so that a batch is checked against very many of them without moving them.

An index folder holds ``keys``, a table bucketed by the key with a file per bucket, ``filters``, a Bloom filter per
bucket, and ``about.json``, written last. A batch passes the filters first: what they say is new is new. Only the rest
is looked up. If that is little, the files of its buckets alone are read, with the batch broadcast; if it is much, it
is dealt out like the buckets and joined in place. In both cases the keys of the index stay where they are.

A filter is rows of 32,768 bits. A key sets its bits in one of its bucket's rows, so that a test reads one row; about
one key in a hundred that is not in the index passes.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealyard.operators.registry import reject_existing
from sealyard.session import materialise
from sealyard.sources.bucketed import column_name, open_buckets, write_buckets
from sealyard.sources.commits import put_if_absent
from sealyard.sources.named import qualified

#: Bits in a filter row, the keys that share one, and the bits each sets.
_BITS, _KEYS, _SET = 32768, 3000, 5
#: Keys of a bucket, about.
BUCKET_KEYS = 1_000_000
#: A batch is broadcast up to so many bytes of keys.
FEW_BYTES = 8 * 1024 * 1024


@dataclass(frozen=True)
class KeyIndex:
    """An index that has been written. ``schema`` is that of the key columns, ``note`` whatever its writer put there."""

    path: str
    schema: T.StructType
    buckets: int
    segments: int
    note: object = None

    @property
    def key(self) -> list[str]:
        return self.schema.names

    def keys(self, spark: SparkSession) -> DataFrame:
        """All keys, as a table whose buckets joins on the key make use of."""
        return open_buckets(spark, f"{self.path}/keys", self.schema, self.key, self.buckets)

    def keys_of(self, spark: SparkSession, buckets: Sequence[int]) -> DataFrame:
        """The keys of some buckets; no other file is opened."""
        wanted = set(buckets)
        files = self.keys(spark).inputFiles()
        # The number of a file's bucket stands behind the last underscore of its name.
        picked = [f for f in files if int(re.search(r"_(\d+)(\.[^/]*)?$", f)[1]) in wanted]
        if not picked:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*picked)

    def filters(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("bucket int, segment int, bits binary").parquet(f"{self.path}/filters")


def _columns(names: Sequence[str]) -> list[Column]:
    return [F.col(column_name(name)) for name in names]


def _whole_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The distinct keys without a NULL."""
    whole = rows.select(*_columns(key))
    for column in _columns(key):
        whole = whole.where(column.isNotNull())
    return whole.distinct()


def _bucket(key: Sequence[str], buckets: int) -> Column:
    """The number of a row's bucket, as Spark deals rows out."""
    return F.pmod(F.hash(*_columns(key)), F.lit(buckets)).cast("int")


def _segment(key: Sequence[str], segments: int) -> Column:
    return F.pmod(F.xxhash64(*_columns(key)), F.lit(segments)).cast("int")


def _places(key: Sequence[str]) -> list[Column]:
    """Where a key's bits stand in its filter row."""
    return [F.pmod(F.xxhash64(*_columns(key), F.lit(i)), F.lit(_BITS)).cast("int") for i in range(1, _SET + 1)]


def write_key_index(
    rows: DataFrame, path: str, key: Sequence[str], buckets: int | None = None, note: object = None
) -> KeyIndex:
    """Write an index of the keys of ``rows`` to ``path``, which must be new. Keys with a NULL are left out."""
    spark, key = rows.sparkSession, list(key)
    root = qualified(spark, path)
    distinct = materialise(_whole_keys(rows, key))
    n = distinct.count()
    buckets = max(8, math.ceil(n / BUCKET_KEYS)) if buckets is None else buckets
    index = KeyIndex(root, distinct.schema, buckets, max(1, math.ceil(n / buckets / _KEYS)), note)
    write_buckets(distinct, f"{root}/keys", key, buckets)
    bits = distinct.select(
        _bucket(key, buckets).alias("bucket"), _segment(key, index.segments).alias("segment"),
        F.explode(F.array(*_places(key))).alias("place"),
    )
    filters = bits.groupBy("bucket", "segment").agg(F.bitmap_construct_agg("place").alias("bits"))
    filters.write.mode("errorifexists").parquet(f"{root}/filters")
    about = {"schema": index.schema.json(), "buckets": buckets, "segments": index.segments, "note": note}
    if not put_if_absent(spark, f"{root}/about.json", json.dumps(about) + "\n"):
        raise FileExistsError(root)
    return index


def open_key_index(spark: SparkSession, path: str) -> KeyIndex:
    """An index that has been written in whole; an error if there is none."""
    root = qualified(spark, path)
    (row,) = spark.read.text(f"{root}/about.json", wholetext=True).collect()
    about = json.loads(row.value)
    schema = T.StructType.fromJson(json.loads(about["schema"]))
    return KeyIndex(root, schema, about["buckets"], about["segments"], about["note"])


def pass_filters(keys: DataFrame, index: KeyIndex) -> DataFrame:
    """Those rows of ``keys`` that may be in the index, with their ``_bucket``; no key of the index is missed.

    ``keys`` has the key columns and is best written already, so that its size is known.
    """
    spark = keys.sparkSession
    asked = keys.withColumns(
        {"_bucket": _bucket(index.key, index.buckets), "_segment": _segment(index.key, index.segments)}
    )
    filters = index.filters(spark).withColumnsRenamed({"bucket": "_bucket", "segment": "_segment", "bits": "_bits"})

    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(place, F.lit(8)))) != 0

    passed = asked.join(filters, ["_bucket", "_segment"])
    for place in _places(index.key):
        passed = passed.where(is_set(place))
    return passed.select(*_columns(index.key), "_bucket")


def _key_bytes(keys: DataFrame, key: Sequence[str]) -> int:
    sizes = [F.coalesce(F.octet_length(c.cast("string")), F.lit(0)) + 16 for c in _columns(key)]
    return keys.agg(F.sum(sum(sizes[1:], sizes[0]).cast("bigint"))).first()[0] or 0


def taken_keys(candidates: DataFrame, index: KeyIndex, few_bytes: int = FEW_BYTES) -> DataFrame:
    """The keys of ``candidates`` that are in the index, each once."""
    spark, key = candidates.sparkSession, index.key
    asked = materialise(_whole_keys(candidates, key))
    maybe = materialise(pass_filters(asked, index))
    size = _key_bytes(maybe, key)
    if not size:
        return spark.createDataFrame([], index.schema)
    if size <= few_bytes:
        # As many numbers as there are buckets, at most.
        hit = [row._bucket for row in maybe.select("_bucket").distinct().collect()]
        return index.keys_of(spark, hit).join(F.broadcast(maybe.drop("_bucket")), key, "left_semi")
    return index.keys(spark).join(maybe.drop("_bucket").hint("shuffle_hash"), key, "left_semi")


def reject_indexed(
    candidates: DataFrame,
    index: KeyIndex,
    arrival: Sequence[str],
    recent: DataFrame | None = None,
    few_bytes: int = FEW_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """``reject_existing`` against the keys of an index, and those of ``recent`` that it does not have yet."""
    taken = taken_keys(candidates, index, few_bytes)
    if recent is not None:
        taken = taken.unionByName(recent.select(*_columns(index.key)))
    return reject_existing(candidates, materialise(taken), index.key, arrival)
