"""Sum-of-squares packing of token sequences into windows of a fixed size.

Documents are taken online. Whole windows are cut off a long document; the rest is placed into the fill level
that makes the sum of squared counts of partially filled windows least, counts being kept in an array by
level. Windows still open at the end of a task, or when there are ``MOST_OPEN`` of them, are topped up by
cutting up the emptiest, so that a task pads one window for each time it does so.

Documents are packed where they are read: a task's windows hold rows of its own split, nothing is shuffled,
and a task that runs again makes the same windows. NULL text counts as empty and has its end id alone. Equal
documents and repeated ids are packed one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from sealyard.llm.common import in_batches, table
from sealyard.llm.pretokens import Encoder, pieces

VOCABULARY = "byte_bpe_50k.json"
WINDOW = 2048
END = 1
#: Open windows that a task holds; the ids of their pieces are kept in memory.
MOST_OPEN = 4096
FIELDS = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, ids array<int>"
)


class Packer:
    """Places pieces ``(doc_id, start, ids, doc_tokens)`` into windows; finished windows come out as lists."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open = window, most_open
        self.counts = np.zeros(window + 1, np.int64)  # open windows by fill level; level 0 is a new one
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The level whose windows get a piece of ``size``: least sum of squares, then the fullest."""
        top = self.window - size
        change = 2 * (self.counts[size:] - self.counts[: top + 1] + 1)
        change[0] = 2 * self.counts[size] + 1  # a new window leaves no level
        change[top] = 1 - 2 * self.counts[top] if top else 0  # a full one enters none
        change[1 : top + 1][self.counts[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(change[::-1].argmin())

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list]:
        total = len(ids)
        whole = total - total % self.window
        for at in range(0, whole, self.window):
            yield [(doc_id, at, ids[at : at + self.window], total)]
        if whole == total:
            return
        rest = (doc_id, whole, ids[whole:].copy(), total)  # not a view that keeps all of a long document
        level = self.level_for(total - whole)
        if level:
            held = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            held = []
        held.append(rest)
        level += total - whole
        if level == self.window:
            yield held
            return
        self.open.setdefault(level, []).append(held)
        self.counts[level] += 1
        self.n_open += 1
        if self.n_open >= self.most_open:
            yield from self.close()

    def close(self) -> Iterator[list]:
        """All open windows, the emptiest cut up to fill the others; at most one of them is not full."""
        windows = [(level, held) for level in sorted(self.open, reverse=True) for held in self.open[level]]
        self.open.clear()
        self.counts[:] = 0
        self.n_open = 0
        last = len(windows) - 1
        spare: list = []
        for i, (level, held) in enumerate(windows):
            if i > last and not spare:
                break
            if i > last:
                level, held = 0, []
            while level < self.window:
                if not spare:
                    if last <= i:
                        break
                    spare = windows[last][1][::-1]
                    last -= 1
                doc_id, start, ids, total = spare.pop()
                room = self.window - level
                held.append((doc_id, start, ids[:room], total))
                level += min(room, len(ids))
                if len(ids) > room:
                    spare.append((doc_id, start + room, ids[room:], total))
            yield held
        if spare:
            yield spare[::-1]


def byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(others)}


def _tokenizer(path: str):
    """A function from texts to their ids, as the tokenizer gives them without added tokens."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}

    model, letters = library.model, byte_letters()

    def encode_words(words: list[str]) -> list:
        # A piece is what the library's own cutting would hand to its model, in the model's alphabet.
        raw = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters) for w in words]
        return [[token.id for token in model.tokenize(r)] for r in raw]

    encoder = Encoder(encode_words)

    def encode(texts: list[str]) -> Iterator[np.ndarray]:
        for text, ids in zip(texts, encoder.encode([t if not _has(t) else "" for t in texts]), strict=True):
            yield with_special(text) if _has(text) else ids

    def _has(text: str) -> bool:
        return any(s in text for s in special)

    def with_special(text: str) -> np.ndarray:
        for content, token in special.items():
            if content in text:
                parts = [with_special(p) for p in text.split(content)]
                ends = [np.array([token], np.uint32)] * (len(parts) - 1)
                return np.concatenate([x for pair in zip(parts, [*ends, np.empty(0, np.uint32)], strict=True) for x in pair])
        return np.concatenate([np.empty(0, np.uint32), *encoder.encode(list(pieces(text)))])

    return encode


def pack_documents(df: DataFrame, path: str, window: int = WINDOW, end: int = END, with_ids: bool = True) -> DataFrame:
    """Pieces of all rows of ``df`` (``doc_id``, ``text``): where each lies in which sequence.

    ``sequence_id`` holds the task in its upper half, so tasks need not agree on anything. ``with_ids`` adds the
    pieces' ids, which is what a trainer reads.
    """
    fields = FIELDS if with_ids else FIELDS.rpartition(",")[0]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = _tokenizer(path)
        packer = Packer(window)
        base, made = TaskContext.get().partitionId() << 33, 0
        names = [f.split()[0] for f in fields.split(", ")]

        def flush(windows: list[list], first: int) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in names]
            for i, held in enumerate(windows):
                offset = 0
                for doc_id, start, ids, total in held:
                    row = (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + first + i, offset, ids.astype(np.int32))
                    for column, value in zip(columns, row, strict=False):
                        column.append(value)
                    offset += len(ids)
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)

        ready: list[list] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    for held in packer.add(doc_id, np.append(ids, np.uint32(end))):
                        ready.append(held)
                        if len(ready) == 512:
                            yield flush(ready, made)
                            made, ready = made + 512, []
        ready.extend(packer.close())
        if ready:
            yield flush(ready, made)

    return in_batches(df.select("doc_id", "text"), run, fields)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), with_ids=False)


QUERIES = {"op1_packing": op1_packing}
