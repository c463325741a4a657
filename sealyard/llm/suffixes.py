"""Suffix-array dedup: bytes that lie in a long string an earlier document also has are removed.

A string of ``LENGTH`` bytes counts as a copy when it also starts in a document with a smaller doc_id. To bring
equal strings together without moving all suffixes, each string is filed under the smallest hash of the ``GRAM``-
byte strings inside it. Neighbouring strings under the same hash form a segment; hashes that only one document
has are dropped. A task takes whole groups of segments and builds their suffix array: only suffixes smaller than
their successors are sorted directly, the rest follows from them by scans over first-byte buckets, and common
prefixes of neighbours then tell which strings are equal and which document has them first.

Hashes that a sample of the documents has twice or more need no look-up, and the up to ``FREQUENT`` most frequent
are dealt out by document as well. If a hash may have more than ``HOT`` bytes of segments, counted over all documents,
they are not one task's work: the strings are compared one by one by a 128-bit hash, with minima combined before the
shuffle. Equal texts are one text; all but the smallest doc_id of them lose everything (from ``LENGTH`` bytes on).
Strings are judged on the input, not on what is left.

NULL text is empty. Texts shorter than ``LENGTH`` bytes are kept. Rows that share a doc_id are one document, so
they take nothing from one another. A NULL doc_id comes after all others. What is kept need not be UTF-8. Other
columns come along, but for those named like a result or, with an underscore, like a column of the work. No rows
give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealyard.llm.common import add_columns, in_batches, table
from sealyard.session import materialise

LENGTH = 50
GRAM = 24
#: One document in so many is looked at for hashes that are frequent, and so many of those are known to tasks.
SAMPLE, FREQUENT = 64, 1 << 16
#: Bytes of one hash's segments that a task takes; above, strings are compared one by one.
HOT = 1 << 24
#: Bytes that a task sorts at a time, besides the last group's.
BUFFER = 1 << 20
_RUN = 4096
#: Strings that are hashed at a time; their numbers fit a core's cache.
_CHUNK = 1 << 17
_LAST = 9223372036854775807


class Minima:
    """For each string of ``length`` bytes the smallest hash of the ``gram``-byte strings inside it."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        base = 0x5851F42D4C957F2D
        size = _CHUNK + 4 * length
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.full(size, base, np.uint64))
            self.down = np.cumprod(np.full(size, pow(base, -1, 1 << 64), np.uint64))
            letters = np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
            self.letters = (letters ^ (letters >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def of(self, data: np.ndarray) -> np.ndarray:
        """One value per string start; ``data`` has at most a chunk and a string's bytes."""
        n, k = len(data), self.gram
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.letters[data] * self.up[:n], out=sums[1:])
            x = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
        width, span = self.length - k + 1, 1
        while 2 * span <= width:
            x = np.minimum(x[:-span], x[span:])
            span *= 2
        rest = width - span
        return np.minimum(x[:-rest], x[rest:]) if rest else x

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        """``hash, row, start, strings`` as arrays: the segments of texts that stand one after another in ``data``."""
        first = 0
        while first < len(offsets) - 1:
            last = first + 1
            while last < len(offsets) - 1 and offsets[last + 1] - offsets[first] <= _CHUNK:
                last += 1
            begin, end = int(offsets[first]), int(offsets[last])
            for at in range(begin, max(begin + 1, end - self.length + 1), _CHUNK):
                part = data[at : min(end, at + _CHUNK + self.length - 1)]
                if len(part) < self.length:
                    continue
                values = self.of(part)
                starts = offsets[first : last + 1].astype(np.int64) - at
                # Strings lie in one text: a 1 where a text's strings begin, a -1 after its last; short texts have none.
                low, high = np.clip(starts[:-1], 0, None), np.clip(starts[1:] - self.length + 1, None, len(values))
                some = low < high
                step = np.zeros(len(values) + 1, np.int8)
                step[low[some]] += 1
                step[high[some]] -= 1
                valid = np.cumsum(step[:-1], dtype=np.int8).view(bool)
                new = np.empty(len(values), bool)
                np.not_equal(values[1:], values[:-1], out=new[1:])
                new[low[some]] = True
                new &= valid
                end_of = valid.copy()
                end_of[:-1] &= ~valid[1:] | new[1:]
                a, b = np.flatnonzero(new), np.flatnonzero(end_of)
                if (b - a >= _RUN).any():
                    pieces = [(i, min(i + _RUN - 1, int(y))) for x, y in zip(a, b, strict=True) for i in range(int(x), int(y) + 1, _RUN)]
                    a, b = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
                row = np.searchsorted(starts, a, side="right") - 1
                yield values[a].view(np.int64), first + row, a - starts[row], b - a + 1
            first = last


class _Among:
    """Which numbers are among some; most that are not are told by their low bits, without a search."""

    def __init__(self, numbers: np.ndarray):
        self.ordered = np.unique(numbers.view(np.uint64))
        self.low = np.uint64((1 << 20) - 1)
        self.marks = np.zeros(1 << 20, bool)
        self.marks[self.ordered & self.low] = True

    def of(self, values: np.ndarray) -> np.ndarray:
        values = values.view(np.uint64)
        found = self.marks[values & self.low]
        some = np.flatnonzero(found)
        if len(some):
            asked = values[some]
            at = np.searchsorted(self.ordered, asked)
            found[some] = self.ordered[np.minimum(at, len(self.ordered) - 1)] == asked
        return found


#: Symbols that fit into one number; a symbol has nine bits.
_PACK = 7


def _words(symbols: np.ndarray) -> np.ndarray:
    """The next ``_PACK`` symbols at each place as one number, zeros after the end."""
    n = len(symbols)
    padded = np.append(symbols, np.zeros(_PACK, symbols.dtype)).astype(np.uint64)
    out = padded[:n].copy()
    for i in range(1, _PACK):
        out <<= np.uint64(9)
        out |= padded[i : n + i]
    return out


def suffix_array(symbols: np.ndarray, depth: int = LENGTH, words: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in order, as far as their first ``depth`` symbols tell; symbols are 0 to 256.

    Two stages: suffixes smaller than their successor are sorted by comparing symbols; every other suffix follows
    from the one after it in a scan over the buckets of first symbols.
    """
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    s = symbols.astype(np.int64)
    # A suffix is smaller than its successor where the next different symbol is larger; the end is smallest.
    change = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    next_change = change[np.searchsorted(change, np.arange(n))]
    smaller = (next_change < n - 1) & (s[np.minimum(next_change + 1, n - 1)] > s[next_change])
    words = _words(symbols) if words is None else words
    direct = np.flatnonzero(smaller)
    # Sorted by some symbols at a time; only suffixes that are still alike are sorted further.
    direct = direct[np.argsort(words[direct])]
    key = words[direct]
    alike = np.append(False, key[1:] == key[:-1])
    for step in range(_PACK, depth + _PACK, _PACK):
        alike_next = np.append(alike[1:], False)
        open_ = np.flatnonzero(alike | alike_next)
        if not len(open_):
            break
        group = np.cumsum(~alike[open_])
        rows = direct[open_]
        at = rows + step
        key = np.where(at < n, words[np.minimum(at, n - 1)], np.uint64(0))
        # Most groups are copies, whose next symbols are the same throughout and need no sorting.
        differ = np.flatnonzero((group[1:] == group[:-1]) & (key[1:] != key[:-1]))
        if len(differ):
            mixed = np.zeros(int(group[-1]) + 1, bool)
            mixed[group[differ]] = True
            some = np.flatnonzero(mixed[group])
            order = some[np.lexsort((key[some], group[some]))]
            rows[some], key[some] = rows[order], key[order]
            direct[open_] = rows
        alike = np.zeros(len(direct), bool)
        alike[open_[1:]] = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
    first = s[direct]
    edges = np.searchsorted(first, np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    induced[s[n - 1]].append(np.array([n - 1]))  # its successor is the empty suffix, the smallest of all
    out = []
    for c in range(257):
        frontier = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        scanned = []
        while len(frontier):  # suffixes that repeat the symbol follow those they are induced from
            scanned.append(frontier)
            before = frontier[frontier > 0] - 1
            frontier = before[s[before] == c]
        scanned.append(direct[edges[c] : edges[c + 1]])
        bucket = np.concatenate(scanned)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[s[before] > c]
        if len(before):
            before = before[np.argsort(s[before], kind="stable")]
            symbol = s[before]
            cut = np.flatnonzero(np.diff(symbol)) + 1
            for part in np.split(before, cut):
                induced[s[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(symbols: np.ndarray, order: np.ndarray, most: int = LENGTH, words: np.ndarray | None = None) -> np.ndarray:
    """How many symbols each suffix of ``order`` shares with the one before, up to ``most``."""
    n = len(symbols)
    words = np.append(_words(symbols) if words is None else words, np.uint64(0))
    shared = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    one, two = order[1:], order[:-1]
    for step in range(0, most, _PACK):
        differ = words[np.minimum(one + step, n)] ^ words[np.minimum(two + step, n)]
        ended = np.flatnonzero(differ)
        # Symbols of the first words that differ; the first of them is in the highest bits.
        at, bits = open_[ended], differ[ended]
        for i in range(1, _PACK):
            shared[at] += bits >> np.uint64(9 * (_PACK - i)) == 0
        going = np.flatnonzero(differ == 0)
        open_, one, two = open_[going], one[going], two[going]
        shared[open_] += _PACK
        if not len(open_):
            break
    # What follows the end was taken for zeros.
    if len(order):
        left = n - order
        shared[1:] = np.minimum(shared[1:], np.minimum(left[1:], left[:-1]))
    return np.minimum(shared, most)


def earliest(segments: list[bytes], docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``length`` bytes of the segments, one after another, the smallest doc of any segment that
    has it; and where each segment's strings begin among them."""
    sizes = np.array([len(x) for x in segments])
    ends = np.cumsum(sizes + 1)
    # Segments are closed by a symbol of their own, 0, below all bytes.
    symbols = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    symbols[ends - 1] = 0
    words = _words(symbols)
    order = suffix_array(symbols, length, words)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    order = order[order + length < ends[owner[order]]]  # whole strings only
    strings = np.maximum(sizes - length + 1, 0)
    begins = np.cumsum(strings) - strings
    found = np.empty(len(order), np.int64)
    if len(order):
        starts = np.flatnonzero(common_prefixes(symbols, order, length, words) < length)
        doc = np.repeat(np.minimum.reduceat(docs[owner[order]], starts), np.diff(np.append(starts, len(order))))
        at = owner[order]
        found[begins[at] + order - (ends[at] - sizes[at] - 1)] = doc
    return found, begins


def copied(segments: list[bytes], docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``segment, start, stop``: stretches of segments covered by strings that a smaller doc has in any of them.

    Equal segments are one, with their smallest doc.
    """
    number: dict[bytes, int] = {}
    kind = np.fromiter((number.setdefault(s, len(number)) for s in segments), np.int64, len(segments))
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, docs)
    first, begins = earliest(list(number), least, length)
    sizes = np.fromiter(map(len, number), np.int64, len(number))
    some = np.flatnonzero(sizes >= length)
    low, high = np.full(len(number), np.iinfo(np.int64).max), np.full(len(number), np.iinfo(np.int64).max)
    if len(some):
        low[some], high[some] = np.minimum.reduceat(first, begins[some]), np.maximum.reduceat(first, begins[some])
    whole = np.flatnonzero(docs > high[kind])
    at, start, stop = [whole], [np.zeros(len(whole), np.int64)], [sizes[kind[whole]]]
    for i in np.flatnonzero((docs > low[kind]) & (docs <= high[kind])):
        k = kind[i]
        places = np.flatnonzero(first[begins[k] : begins[k] + sizes[k] - length + 1] < docs[i])
        gap = np.flatnonzero(np.diff(places) > 1)
        at.append(np.full(len(gap) + 1, i))
        start.append(places[np.append(0, gap + 1)])
        stop.append(places[np.append(gap, len(places) - 1)] + length)
    return np.concatenate(at), np.concatenate(start), np.concatenate(stop)


def _binary(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where its rows begin, without copying; NULL has none."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


_ROW = np.uint64(0xD1B54A32D192ED03)


def _hashes(texts: DataFrame, length: int, gram: int, frequent: np.ndarray) -> DataFrame:
    """``h, doc, salt`` of all segments of ``doc, data``: a row per ``length`` - ``gram`` + 1 strings of a segment.

    Only text that repeats itself has segments of more strings, so no row stands for more than
    ``_row_bytes`` bytes. ``salt`` is 0, or a number from 1 on that spreads the rows of a hash among the sorted
    ``frequent``, which several documents are known to have.
    """
    width = length - gram + 1

    def run(batches):
        import pyarrow as pa

        minima, often = Minima(length, gram), _Among(frequent)
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = _binary(batch.column(1))
            for h, row, _, strings in minima.segments(data, offsets):
                if (strings > width).any():
                    h, row = np.repeat(h, -(-strings // width)), np.repeat(row, -(-strings // width))
                known = often.of(h)
                doc = docs[row]
                salt = np.where(known, (doc & 1023) + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(salt)], names=["h", "doc", "salt"])

    return in_batches(texts.select("doc", "data"), run, "h bigint, doc bigint, salt int")


def _row_bytes(length: int, gram: int) -> int:
    """Bytes of a segment of as many strings as one row of ``_hashes`` stands for."""
    return 2 * length - gram


def _frequent(texts: DataFrame, length: int, gram: int, share: int = SAMPLE, most: int = FREQUENT) -> list[int]:
    """Hashes that several documents of a sample have, at most ``most``."""
    some = texts.where(F.pmod(F.xxhash64("doc"), F.lit(share)) == 0)
    counts = _hashes(some, length, gram, np.empty(0, np.int64)).groupBy("h").agg(
        F.count("*").alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high")
    )
    rows = counts.where("low < high").orderBy(F.desc("n"), "h").limit(most).select("h").collect()
    return [r.h for r in rows]


def _cut(found: DataFrame, length: int, gram: int, hot: np.ndarray) -> DataFrame:
    """``h, hot, doc, key, place, segment``: the segments of ``_doc, _key, _data`` whose hash is in ``wanted``.

    Hot hashes are those of ``hot`` and of the documents' lists ``heavy``."""
    at = {name: found.columns.index(name) for name in ("_doc", "_key", "_data", "wanted", "heavy")}

    def run(batches):
        import pyarrow as pa

        minima = Minima(length, gram)
        for batch in batches:
            docs, keys = (batch.column(at[n]).to_numpy(zero_copy_only=False) for n in ("_doc", "_key"))
            data, offsets = _binary(batch.column(at["_data"]))
            lists = batch.column(at["wanted"])
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            apart = np.union1d(hot, batch.column(at["heavy"]).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            with np.errstate(over="ignore"):
                # One number for hash and row; another segment taken along by chance does no harm.
                rows = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) * _ROW
                wanted = _Among(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ rows)
                for h, row, place, strings in minima.segments(data, offsets):
                    mine = np.flatnonzero(wanted.of(h.view(np.uint64) ^ (row.astype(np.uint64) * _ROW)))
                    for first in range(0, len(mine), 4096):
                        some = mine[first : first + 4096]
                        r, size = row[some], strings[some] + length - 1
                        ends = np.concatenate([[0], np.cumsum(size)])
                        begin = offsets[r] + place[some]
                        taken = data[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
                        segment = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(taken)])
                        columns = [pa.array(h[some]), pa.array(np.isin(h[some], apart)), pa.array(docs[r]), pa.array(keys[r]), pa.array(place[some].astype(np.int32)), segment]
                        yield pa.RecordBatch.from_arrays(columns, names=["h", "hot", "doc", "key", "place", "segment"])

    return in_batches(found, run, "h bigint, hot boolean, doc bigint, key bigint, place int, segment binary")


def _sorted_groups(segments: DataFrame, length: int) -> DataFrame:
    """``doc, key, start, stop`` of copied stretches, from groups of segments that lie together in a task."""

    def run(batches):
        import pyarrow as pa

        names = ["doc", "key", "start", "stop"]

        def solve(parts):
            docs, keys, places = (np.concatenate([p[i] for p in parts]) for i in range(3))
            at, start, stop = copied([x for p in parts for x in p[3]], docs, length)
            if len(at):
                columns = [docs[at], keys[at], places[at] + start, places[at] + stop]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

        parts, size, last = [], 0, None
        for batch in batches:
            h, docs, keys, places = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            found = batch.column(4).to_pylist()
            first = 0
            for cut in [*(np.flatnonzero(np.diff(h)) + 1).tolist(), len(h)]:
                # A piece of one hash's rows; what is gathered is solved when another hash begins.
                if size >= BUFFER and h[first] != last:
                    yield from solve(parts)
                    parts, size = [], 0
                piece = found[first:cut]
                parts.append((docs[first:cut], keys[first:cut], places[first:cut].astype(np.int64), piece))
                size += sum(map(len, piece))
                last = h[first]
                first = cut
        if parts:
            yield from solve(parts)

    dealt = segments.select("h", "doc", "key", "place", "segment").repartition("h").sortWithinPartitions("h")
    return in_batches(dealt, run, "doc bigint, key bigint, start bigint, stop bigint")


def _one_by_one(segments: DataFrame, length: int) -> DataFrame:
    """The same stretches for hashes of very many segments: strings are rows, minima combine before the shuffle.

    Places of one string in a segment that overlap or touch are one row, so text that repeats itself has few.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for doc, key, place, segment in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                stretches: dict[bytes, list[list[int]]] = {}
                for i in range(len(segment) - length + 1):
                    parts = stretches.setdefault(hashlib.blake2b(segment[i : i + length], digest_size=16).digest(), [])
                    if parts and i <= parts[-1][1]:
                        parts[-1][1] = i + length
                    else:
                        parts.append([i, i + length])
                digests = np.frombuffer(b"".join(d * len(p) for d, p in stretches.items()), np.int64).reshape(-1, 2)
                spans = place + np.array([p for parts in stretches.values() for p in parts], np.int64).reshape(-1, 2)
                columns = [*digests.T, np.full(len(spans), doc), np.full(len(spans), key), *spans.T]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names=["w1", "w2", "doc", "key", "start", "stop"]
                )

    strings = in_batches(
        segments.select("doc", "key", "place", "segment"), run, "w1 bigint, w2 bigint, doc bigint, key bigint, start bigint, stop bigint"
    )
    firsts = strings.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    return (
        strings.join(firsts.select("w1", "w2", "first"), ["w1", "w2"])
        .where("doc > first")
        .select("doc", "key", "start", "stop")
    )


def _later_copies(texts: DataFrame) -> DataFrame:
    """``doc, copies``: keys of texts that a smaller doc has, too, per document that loses them whole."""
    firsts = texts.groupBy("key", "key2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    later = texts.select("key", "key2", "doc").join(firsts.drop("high"), ["key", "key2"]).where("doc > low")
    return later.groupBy("doc").agg(F.collect_set("key").alias("copies"))


def remove_copied(df: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``df`` with ``kept`` (binary) in place of ``text``, and ``n_bytes, n_removed, n_spans``.

    Texts are moved once, to lie by document; hashes of segments, positions and the segments that several
    documents may share come to them.
    """
    own = {"_doc": F.coalesce("doc_id", F.lit(_LAST)), "_data": F.coalesce(F.col("text").cast("binary"), F.lit(b""))}
    rows = df.withColumns(own).withColumn("_key", F.xxhash64("_data"))
    texts = rows.select(F.col("_doc").alias("doc"), F.col("_key").alias("key"), F.col("_data").alias("data"))
    frequent = _frequent(texts, length, gram)
    most = hot // _row_bytes(length, gram)
    # Moved once, for the smallest and largest document of each hash and for the documents that share it.
    # (The joins would ask for rows without NULL on one side only, and so for two shuffles.)
    hashes = _hashes(texts, length, gram, np.array(sorted(frequent), np.int64))
    hashes = hashes.where("h is not null and doc is not null and salt is not null").repartition("h", "salt")
    shared = (
        hashes.groupBy("h", "salt")
        .agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n"))
        .where("salt > 0 or low < high")
        .select("h", "salt", "n")
    )
    # Of a hash that is dealt out, the rows are counted once all is together; any other one is counted by now.
    wanted = hashes.join(shared.hint("shuffle_hash"), ["h", "salt"]).groupBy("doc").agg(
        F.collect_list("h").alias("wanted"),
        F.collect_list(F.when(F.col("salt") > 0, F.col("h"))).alias("dealt"),
        F.collect_set(F.when((F.col("salt") == 0) & (F.col("n") > most), F.col("h"))).alias("heavy"),
    )
    wanted = materialise(wanted)
    # At most FREQUENT of them.
    counts = wanted.select(F.explode("dealt").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    very = np.array([r.h for r in counts.where(F.col("n") > most).collect()], np.int64)
    heavy = len(very) > 0 or not wanted.where(F.size("heavy") > 0).isEmpty()
    wanted = wanted.drop("dealt")
    later = materialise(_later_copies(texts.select("doc", "key", F.xxhash64(F.lit(1), "data").alias("key2"))))
    # The hashes have done their work; their shuffle files go when the driver's garbage is collected, and by now
    # nothing in the driver still looks at the query that made them.
    df.sparkSession.sparkContext._jvm.System.gc()
    # All columns are asked for wherever the texts are read, so that there is one shuffle of them.
    placed = rows.drop("text", "doc_id").repartition("_doc")
    needed = placed.join(wanted.withColumnRenamed("doc", "_doc").hint("shuffle_hash"), "_doc")
    needed = needed.join(later.withColumnRenamed("doc", "_doc").hint("shuffle_hash"), "_doc", "left")
    needed = needed.where(~F.coalesce(F.array_contains("copies", F.col("_key")), F.lit(False)))
    cut = _cut(needed, length, gram, very)
    found = _sorted_groups(cut.where("not hot"), length)
    if heavy:
        found = found.unionByName(_one_by_one(cut.where("hot"), length))
    stretches = found.groupBy("doc").agg(F.collect_list(F.struct("key", "start", "stop")).alias("_stretches"))

    def remove():
        def compute(data, keys, copies, stretches):
            kept, sizes, removed, spans = [], [], [], []
            for text, key, whole, parts in zip(data, keys, copies, stretches, strict=True):
                merged: list[list[int]] = []
                if key in (whole or ()):
                    merged = [[0, len(text)]] if len(text) >= length else []
                else:
                    for a, b in sorted((p["start"], p["stop"]) for p in parts or () if p["key"] == key):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                at, left = 0, []
                for a, b in merged:
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                kept.append(b"".join(left))
                sizes.append(len(text))
                removed.append(sum(b - a for a, b in merged))
                spans.append(len(merged))
            return kept, sizes, removed, spans

        return compute

    joined = placed.join(stretches.withColumnRenamed("doc", "_doc").hint("shuffle_hash"), "_doc", "left")
    joined = joined.join(later.toDF("_doc", "_copies").hint("shuffle_hash"), "_doc", "left")
    done = add_columns(
        joined, ["_data", "_key", "_copies", "_stretches"], "kept binary, n_bytes bigint, n_removed bigint, n_spans bigint", remove
    )
    doc_id = F.when(F.col("_doc") != _LAST, F.col("_doc")).alias("doc_id")
    names = [F.col(f"`{c}`") for c in done.columns if c not in ("_doc", "_data", "_key", "_copies", "_stretches")]
    return done.select(doc_id, *names)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_copied(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
