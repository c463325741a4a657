"""Substring dedup by sliding sentence spans: repeated runs of sentences stay where they come first.

A text is cut into sentences that together are the text again. Every run of neighbouring sentences, ``SPAN`` of
them or as many more as it takes to have ``LEAST_WORDS`` words, is hashed to 128 bits, equal hashes of all documents
are brought together, and each sentence that a non-first occurrence of a repeated run covers is removed. First is the
smallest (doc_id, position).

With ``passage``, as in the query, two more kinds of runs count. Fewer than ``SPAN`` sentences count from ``passage``
words on. And of the text's words, whatever its sentences, runs of ``passage`` words are taken: the first, the last,
and of every ``passage`` neighbouring ones that with the smallest hash. So two texts that share 2 * ``passage`` - 1
words in a row share a run, and the runs a stretch shares lie without gaps. Up to ``passage`` - 1 words at each end of
a stretch that ends within a sentence may stay. An own later run of words counts if it is clear of the first.

NULL text has no sentences and stays NULL. Rows that share doc_id and text are one document and are treated
alike; rows that share only the doc_id compare by position. A NULL doc_id comes after all others. Texts without a
whole run are left alone. Columns named like a result are replaced by it. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealyard.llm.common import add_columns, in_batches, table
from sealyard.session import materialise

#: Sentences in a run, at least, and its words, at least.
SPAN = 3
LEAST_WORDS = 12
#: Words from which on a run counts whatever its sentences.
PASSAGE = 25
#: A sentence ends after a full stop, exclamation or question mark followed by white space, or at a line end.
SENTENCE = re.compile(r"(?s).+?(?:[.!?]+\s+|\n\s*|\Z)")
_LAST = 9223372036854775807
#: Words whose runs are hashed at a time, and bits of a place among them.
_CHUNK, _PLACE = 1 << 20, np.uint64(24)
_ODD = 0x9E3779B97F4A7C15
#: Runs found this often in one text of so many are dealt out over so many groups; at most so many runs are.
_OFTEN, _ONE_IN, _SALTS, _COMMON = 32, 64, 64, 4096


def sentences_of(text: str | None) -> list[str]:
    """The sentences of a text, with what separates them; together they are the text."""
    return SENTENCE.findall(text or "")


def lengths_of(sentences: list[str]) -> list[int]:
    """Words in each sentence."""
    return [len(s.split()) for s in sentences]


def runs_of(
    sentences: list[str], span: int = SPAN, least_words: int = LEAST_WORDS, words: list[int] | None = None
) -> Iterator[tuple[int, int, bytes]]:
    """``start, length, digest`` of the run that starts at each sentence; the last ones may have none."""
    plain = [s.strip() for s in sentences]
    words = lengths_of(sentences) if words is None else words
    end, held = 0, 0
    for start in range(len(plain)):
        while end < len(plain) and (end - start < span or held < least_words):
            held += words[end]
            end += 1
        if end - start < span or held < least_words:
            return
        run = "\n".join(plain[start:end])
        yield start, end - start, hashlib.blake2b(run.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        held -= words[start]


def short_runs_of(sentences: list[str], words: list[int], passage: int, span: int = SPAN) -> Iterator[tuple[int, int, bytes]]:
    """``start, length, digest`` of the runs of fewer than ``span`` sentences that have ``passage`` words."""
    sums = list(itertools.accumulate(words, initial=0))
    for size in range(1, span):
        for start, (before, after) in enumerate(zip(sums, sums[size:])):  # noqa: B905
            # Sentences that all count alone need no run together.
            if after - before >= passage and (size == 1 or min(words[start : start + size]) < passage):
                run = "\n".join([s.strip() for s in sentences[start : start + size]])
                yield start, size, hashlib.blake2b(run.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class WordRuns:
    """Runs of ``size`` words of a text, chosen by their content alone."""

    def __init__(self, size: int):
        self.size = size
        self.powers = self.inverse = np.ones(1, np.uint64)

    def order(self, numbers: np.ndarray) -> np.ndarray:
        """A hash of each run, its lowest bits free."""
        while len(self.powers) < len(numbers):
            n = len(self.powers)
            self.powers = np.concatenate([self.powers, self.powers * np.uint64(pow(_ODD, n, 1 << 64))])
            self.inverse = np.concatenate([self.inverse, self.inverse * np.uint64(pow(_ODD, -n, 1 << 64))])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers * self.powers[: len(numbers)], dtype=np.uint64)])
        h = (sums[self.size :] - sums[: -self.size]) * self.inverse[: len(numbers) + 1 - self.size]
        for _ in range(2):
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h >> _PLACE << _PLACE

    def starts(self, words: list[bytes]) -> list[int]:
        size, last = self.size, len(words) - self.size
        if last < 0:
            return []
        numbers = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * np.uint64(_ODD)
        places, hashes = [0], []
        for base in range(0, last + 1, _CHUNK):
            order = self.order(numbers[base : base + _CHUNK + 2 * size - 2])
            hashes.append(order[:_CHUNK])
            if base and len(order) < size:
                break  # all of them were in the windows before
            least, held, of = order | np.arange(len(order), dtype=np.uint64), 1, min(size, len(order))
            while held < of:
                step = min(held, of - held)
                least = np.minimum(least[: len(least) - step], least[step:])
                held += step
            least = least[np.concatenate([[True], least[1:] != least[:-1]])]
            places.extend((least & np.uint64((1 << 24) - 1)).astype(np.int64) + base)
        places = sorted({*map(int, places), last})
        hashes = dict(zip(places, np.concatenate(hashes)[places].tolist(), strict=True))
        # A text that repeats itself has the same run every few words: as many as leave no gap are enough.
        kept = places[:1]
        for place, after in itertools.zip_longest(places[1:], places[2:]):
            if after is None or hashes[place] != hashes[kept[-1]] or after > kept[-1] + size:
                kept.append(place)
        return kept

    def of(self, text: str | None) -> Iterator[tuple[int, int, bytes]]:
        """``start, -size, digest`` of the chosen runs, counted in words."""
        words = "\n".join((text or "").split()).encode("utf-8", "surrogatepass").split(b"\n")
        for start in self.starts(words):
            run = b" ".join(words[start : start + self.size])
            yield start, -self.size, hashlib.blake2b(run, digest_size=16, person=b"words").digest()


def runs(
    df: DataFrame, span: int = SPAN, least_words: int = LEAST_WORDS, passage: int | None = None, common: Sequence[tuple[int, int]] = ()
) -> DataFrame:
    """``doc, text_key, pos, size, h1, h2, salt``: every run of every text; a negative size counts words.

    ``salt`` is 0 but for the runs in ``common``, which it deals out by their text.
    """
    common = frozenset(common)

    def find(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        names = ["doc", "text_key", "pos", "size", "h1", "h2", "salt"]
        word_runs = WordRuns(passage) if passage else None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows, digests = [], []
                for doc, key, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    parts = sentences_of(text)
                    words = lengths_of(parts)
                    kinds_of_runs = [runs_of(parts, span, least_words, words)]
                    if word_runs:
                        kinds_of_runs += [short_runs_of(parts, words, passage, span), word_runs.of(text)]
                    for start, size, digest in itertools.chain(*kinds_of_runs):
                        rows.append((doc, key, start, size))
                        digests.append(digest)
                if rows:
                    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    salts = np.zeros(len(rows), np.int32)
                    if common:
                        keys = np.fromiter((r[1] for r in rows), np.int64, len(rows))
                        often = np.fromiter(map(common.__contains__, zip(*halves.T.tolist(), strict=True)), bool, len(rows))
                        salts[often] = 1 + keys[often] % _SALTS
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(salts)], names=names)

    keyed = df.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    return in_batches(keyed, find, "doc bigint, text_key bigint, pos int, size int, h1 bigint, h2 bigint, salt int")


def common_runs(df: DataFrame, span: int = SPAN, least_words: int = LEAST_WORDS, passage: int | None = None) -> list[tuple[int, int]]:
    """Runs that one text in ``_ONE_IN`` has often, at most ``_COMMON`` of them: what is worth dealing out.

    They decide where rows go and nothing else; a common run that is not among them is one group of the window.
    """
    some = df.where(F.pmod(F.xxhash64(F.lit("common"), "doc_id", "text"), F.lit(_ONE_IN)) == 0)
    counts = runs(some, span, least_words, passage).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    return [(r.h1, r.h2) for r in counts.where(F.col("n") >= _OFTEN).orderBy(F.desc("n"), "h1", "h2").limit(_COMMON).collect()]


def repeated(found: DataFrame) -> DataFrame:
    """``doc, text_key, removed``: positions and sizes of non-first runs, per document.

    Runs meet in one shuffle, in which each group is in order, the first one first. Groups of common runs are dealt
    out, a document's to one part. What comes later within a part does so among all; only a part's first ones go on,
    a document's runs for each part, and meet the first of all parts.
    """
    group = Window.partitionBy("h1", "h2", "salt").orderBy("doc", "pos")

    def is_later(first, at):
        own = (F.col("doc") == first) & (F.col("pos") > at) & (F.col("pos") >= at - F.col("size"))
        return (F.col("doc") > first) | own

    ordered = found.withColumns({"first": F.first("doc").over(group), "at": F.first("pos").over(group)})
    hits = materialise(ordered.withColumn("later", is_later(F.col("first"), F.col("at"))).where("later OR salt > 0"))
    columns = ["doc", "text_key", "pos", "size"]
    open_ones = hits.where("NOT later")
    firsts = open_ones.groupBy("h1", "h2").agg(F.min(F.struct("first", "at")).alias("least"))
    # Not more than _COMMON rows.
    again = open_ones.join(F.broadcast(firsts), ["h1", "h2"]).where(is_later(F.col("least.first"), F.col("least.at")))
    later = hits.where("later").select(*columns).unionByName(again.select(*columns))
    return later.groupBy("doc", "text_key").agg(F.collect_set(F.struct("pos", "size")).alias("removed"))


def without_runs(text: str | None, removed: list[tuple[int, int]]) -> tuple[str | None, int, int, int]:
    """The text without runs, its sentences, those of which words or all was removed, and the words removed."""
    parts = sentences_of(text)
    if not removed:
        return text, len(parts), 0, 0
    drop = {i for pos, size in removed if size > 0 for i in range(pos, pos + size)}
    gone = {i for pos, size in removed if size < 0 for i in range(pos, pos - size)}
    kept, touched, words, at = [], 0, 0, 0
    for i, part in enumerate(parts):
        begins = [m.start() for m in re.finditer(r"\S+", part)]
        cut = [k for k in range(len(begins)) if at + k in gone]
        at += len(begins)
        whole = i in drop or 0 < len(cut) == len(begins)
        touched += whole or bool(cut)
        words += len(begins) if whole else len(cut)
        if not whole:
            # A word goes with the white space after it.
            edges, last = [*begins, len(part)], 0
            for k in cut:
                kept.append(part[last : edges[k]])
                last = edges[k + 1]
            kept.append(part[last:])
    return "".join(kept), len(parts), touched, words


def remove_repeated_spans(df: DataFrame, span: int = SPAN, least_words: int = LEAST_WORDS, passage: int | None = None) -> DataFrame:
    """``df`` with ``text`` freed of repeated runs, and ``n_sentences``, ``n_removed``, ``removed_words``."""
    common = common_runs(df, span, least_words, passage)
    found = repeated(runs(df, span, least_words, passage, common)).toDF("_doc", "_key", "_removed")
    keyed = df.withColumns({"_doc": F.coalesce("doc_id", F.lit(_LAST)), "_key": F.xxhash64("text")})
    marked = keyed.join(found, ["_doc", "_key"], "left")

    def cut():
        def compute(texts, removed):
            return zip(*[without_runs(t, [(r["pos"], r["size"]) for r in out or ()]) for t, out in zip(texts, removed, strict=True)], strict=True)

        return compute

    result = add_columns(marked, ["text", "_removed"], "_text string, n_sentences bigint, n_removed bigint, removed_words bigint", cut)
    names = [c for c in df.columns if c not in ("n_sentences", "n_removed", "removed_words")]
    return result.select(*[F.col("_text").alias("text") if c == "text" else F.col(f"`{c}`") for c in names], "n_sentences", "n_removed", "removed_words")


def op8_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=PASSAGE)


QUERIES = {"op8_sentence_dedup": op8_sentence_dedup}
