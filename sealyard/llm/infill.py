"""Fill-in-the-middle: texts cut into units, of which a prefix, a middle and a suffix are written in another order.

A unit is a word with the white space before it, or the white space at a text's end. Where the cuts fall and which
form a text takes follows from a hash of its id, so the result is the same in every run and on every cluster.

Each batch goes through one chain of ``pyarrow.compute`` kernels: a byte that UTF-8 never has is set behind every
unit and split at, the lists are flattened with the index of their row, ordinals within the row are compared with the
row's two cuts, what each role keeps is rebuilt into lists and joined. No text is turned into Python values. A batch is
taken some megabytes at a time, and a longer text by itself.

NULL text counts as empty, a NULL id as an id without digits. Empty texts, and texts that hold a marker, stay as they
are. Repeated rows are formatted alike. Columns named like a new one are replaced, others carried along. No rows give
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealyard.llm.common import in_batches, table, without

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 texts so many are rewritten, and of 100 rewritten ones so many begin with the suffix.
RATE, SUFFIX_FIRST = 50, 80
UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
#: Never part of UTF-8.
_BREAK = b"\xff"
_SLICE_BYTES = 8 * 1024 * 1024
_ADDED = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_HASHES = [f"_infill_{i}" for i in (1, 2, 3, 4)]


def _slices(batch, column: str):
    """The batch in slices of bounded bytes of one column, of one row at least."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    total = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)).cast("int64"), 0)).to_numpy()
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = max(at + 1, int(total.searchsorted(before + _SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _modulo(a, b):
    import pyarrow.compute as pc

    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def split_units(text):
    """``(n, units, parents)``: units in each row of a binary array, all units, and the row each is of."""
    import pyarrow as pa
    import pyarrow.compute as pc

    marked = pc.replace_substring_regex(text, pattern=UNIT, replacement=b"\\1" + _BREAK)
    lists = pc.split_pattern(marked, pattern=_BREAK)
    units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    # Behind the last break is an empty piece, the only one of its row.
    real = pc.greater(pc.binary_length(units), 0)
    n = pc.subtract(pc.list_value_length(lists).cast(pa.int64()), 1)
    return n, units.filter(real), parents.filter(real).cast(pa.int64())


def _joined(units, mask, counts):
    """What the mask keeps, as one binary value per row; ``counts`` says how many units each row keeps."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ends = pc.cumulative_sum(counts)
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), ends]).cast(pa.int32())
    lists = pa.ListArray.from_arrays(offsets, units.filter(mask))
    return pc.binary_join(lists, pa.scalar(b"", units.type))


def infill_arrays(text, h1, h2, h3, h4, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> list:
    """The columns of ``_ADDED`` for a large_binary array without NULLs and four int64 hashes, ``output`` in bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def number(value):
        return pa.scalar(value, pa.int64())

    plain = pc.equal(pc.binary_length(text), 0)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(text, marker.encode()))
    plain = pc.or_(plain, pc.greater_equal(_modulo(h3, number(100)), number(rate)))
    rewritten = pc.invert(plain)
    texts = text.filter(rewritten)
    h1, h2, h4 = (h.filter(rewritten) for h in (h1, h2, h4))

    n, units, parents = split_units(texts)
    first = pc.subtract(pc.cumulative_sum(n), n)
    ordinals = pc.subtract(_count(len(units)), first.take(parents))
    one, other = _modulo(h1, pc.add(n, number(1))), _modulo(h2, pc.add(n, number(1)))
    low, high = pc.min_element_wise(one, other), pc.max_element_wise(one, other)
    before, upto = pc.less(ordinals, low.take(parents)), pc.less(ordinals, high.take(parents))
    prefix = _joined(units, before, low)
    middle = _joined(units, pc.and_not(upto, before), pc.subtract(high, low))
    suffix = _joined(units, pc.invert(upto), pc.subtract(n, high))

    p, s, m, nothing = (pa.scalar(x.encode(), text.type) for x in (PREFIX, SUFFIX, MIDDLE, ""))
    ahead = pc.less(_modulo(h4, number(100)), number(suffix_first))
    output = pc.if_else(
        ahead,
        pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, nothing),
        pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, nothing),
    )
    form = pc.if_else(ahead, "spm", "psm")

    def spread(values, regular):
        return pc.replace_with_mask(regular, rewritten, values)

    def chars(pieces):
        return spread(pc.utf8_length(pieces.view(pa.large_string())).cast(pa.int64()), pa.nulls(len(text), pa.int64()))

    counts = pc.replace_with_mask(
        pa.nulls(len(text), pa.int64()), plain, pc.count_substring_regex(text.filter(plain), pattern=UNIT).cast(pa.int64())
    )
    return [
        spread(n, counts),
        spread(form, pa.array(["plain"] * len(text), pa.string())),
        chars(prefix),
        chars(middle),
        spread(output, text),
    ]


def _count(n: int):
    """0 to n - 1."""
    import numpy as np
    import pyarrow as pa

    return pa.array(np.arange(n, dtype=np.int64))


def restore_array(output, form):
    """The texts as they were, from a large_binary array of outputs and their forms."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def halves(values, marker):
        pair = pc.split_pattern(values, pattern=marker.encode(), max_splits=1)
        return pc.list_element(pair, 0), pc.list_element(pair, 1)

    nothing = pa.scalar(b"", output.type)
    for kind, opening, next_one in (("psm", PREFIX, SUFFIX), ("spm", SUFFIX, PREFIX)):
        mask = pc.equal(form, kind)
        if not pc.any(mask, min_count=0).as_py():
            continue
        head, middle = halves(output.filter(mask), MIDDLE)
        front, back = halves(head, next_one)
        _, front = halves(front, opening)
        pieces = (front, middle, back) if kind == "psm" else (back, middle, front)
        output = pc.replace_with_mask(output, mask, pc.binary_join_element_wise(*pieces, nothing))
    return output


def _as_text(values):
    """Bytes that are known to be UTF-8 as strings."""
    import pyarrow as pa

    return values.view(pa.large_string()).cast(pa.string())


def fill_in_middle(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """``df`` with ``n`` units, ``form`` (plain, psm, spm), the lengths of prefix and middle in code points and
    ``output``. ``seed`` and the key, written as text, decide cuts and form."""
    added = T.StructType.fromDDL(_ADDED)
    kept = without(df, [*added.names, *_HASHES])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    hashed = kept.withColumns(
        {name: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i, name in enumerate(_HASHES)}
    )
    schema = T.StructType([*kept.schema.fields, *added.fields])
    n_kept = len(kept.columns)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for part in _slices(batch, text):
                texts = pc.fill_null(part.column(text).cast(pa.large_binary()), b"")
                found = infill_arrays(texts, *[part.column(name) for name in _HASHES], rate, suffix_first)
                found[-1] = _as_text(found[-1])
                yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], *found], names=schema.names)

    return in_batches(hashed, run, schema)


def restore(df: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``df`` with ``restored``, the text that an output was made of, from output and form alone."""
    kept = without(df, ["restored"])
    schema = T.StructType([*kept.schema.fields, T.StructField("restored", T.StringType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _slices(batch, output):
                found = restore_array(part.column(output).cast(pa.large_binary()), part.column(form).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, _as_text(found)], names=schema.names)

    return in_batches(kept, run, schema)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = restore(fill_in_middle(documents).drop("text"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


_SQL = rf"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), hashed AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS one,
    ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS other,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
           OR ('0x' || h[17:24])::BIGINT % 100 >= {RATE} THEN 'plain'
         WHEN ('0x' || h[25:32])::BIGINT % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM units
), pieces AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:least(one, other)], ''), '') AS p,
    coalesce(array_to_string(u[least(one, other) + 1:greatest(one, other)], ''), '') AS m,
    coalesce(array_to_string(u[greatest(one, other) + 1:], ''), '') AS s
  FROM hashed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
         ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""

QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
SQL = {"op12_fill_in_middle": _SQL}
