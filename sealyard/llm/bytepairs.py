"""Byte-level BPE in numpy: pieces of like length are merged together, one merge of each per round.

Pieces stand as rows of a padded matrix of ids. In each round every row merges its leftmost pair of the least
rank; ranks of pairs come from a hash table, only the two pairs beside a merge are looked up again, rows
without a mergeable pair leave the matrix, and one column is dropped. Pieces of over ``LONGEST`` bytes would
need as many rounds, so they take the same merges in the same order from a heap.

NULL is encoded as the empty text, which has no ids. Every row gets a result; equal texts get equal ones, ids
may repeat, and an empty table gives an empty result. Any text is taken, special-token strings as plain text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from sealyard.llm.common import add_columns, table
from sealyard.llm.pretokens import Encoder

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONGEST = 1024
_NONE = np.int32(np.iinfo(np.int32).max)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """Rank of the token that two neighbouring tokens make, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        keys = np.fromiter(found.keys(), np.int64, len(found))
        values = np.fromiter(found.values(), np.int32, len(found))
        self.bits = max(4, int(len(found) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        waiting, slot = np.arange(len(keys)), self._slot(keys)
        while len(waiting):
            free = self.keys[slot[waiting]] == -1
            at, first = np.unique(slot[waiting[free]], return_index=True)
            put = waiting[free][first]
            self.keys[at], self.values[at] = keys[put], values[put]
            waiting = waiting[self.keys[slot[waiting]] != keys[waiting]]
            slot[waiting] = (slot[waiting] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``_NONE`` where the two do not merge or one of them is padding (-1)."""
        keys = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.full(keys.shape, _NONE, np.int32)
        open_ = np.flatnonzero(keys != -2)
        while len(open_):
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out


class BytePairs:
    """Encodes pieces by a rank table, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.of_byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(raw):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = [whole]
            elif len(piece) > LONGEST:
                out[i] = self._long(piece)
            else:
                buckets.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            for at in range(0, len(rows), max(1, (1 << 20) // width)):
                self._bucket(raw, rows[at : at + max(1, (1 << 20) // width)], width, out)
        return out

    def _bucket(self, raw: list[bytes], rows: list[int], width: int, out: list) -> None:
        joined = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
        length = np.array([len(raw[i]) for i in rows])
        ids = self.of_byte[joined]
        ids[np.arange(width)[None, :] >= length[:, None]] = -1
        owner = np.array(rows)
        rank = self.pairs.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while len(owner):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(owner), np.int64)
            best = rank[np.arange(len(owner)), at] if rank.shape[1] else np.full(len(owner), _NONE)
            live = best != _NONE
            if not live.all():
                for i, row in zip(owner[~live], ids[~live], strict=True):
                    out[i] = row[row >= 0]
                owner, ids, rank, at, best = owner[live], ids[live], rank[live], at[live], best[live]
                if not len(owner):
                    break
            here = np.arange(len(owner))
            ids[here, at] = best
            keep = np.ones(ids.shape, bool)
            keep[here, at + 1] = False
            ids = ids[keep].reshape(len(owner), -1)
            keep = keep[:, 1:]  # the pair that starts at the merge goes
            rank = rank[keep].reshape(len(owner), -1)
            left = at > 0
            rank[here[left], at[left] - 1] = self.pairs.rank(ids[here[left], at[left] - 1], ids[here[left], at[left]])
            right = at < rank.shape[1]
            rank[here[right], at[right]] = self.pairs.rank(ids[here[right], at[right]], ids[here[right], at[right] + 1])

    def _long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece: a heap of (rank, position) over a linked list."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        start = self.pairs.rank(ids[:-1], ids[1:])
        rank = [*start.tolist(), int(_NONE)]
        ids = ids.tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i) for i, r in enumerate(rank) if r != _NONE]
        heapq.heapify(heap)
        at = {}

        def of(i: int) -> int:
            j = after[i]
            if j >= len(ids):
                return int(_NONE)
            key = (ids[i], ids[j])
            if key not in at:
                at[key] = int(self.pairs.rank(np.array([key[0]]), np.array([key[1]]))[0])
            return at[key]

        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r or ids[i] < 0:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            rank[j] = int(_NONE)
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    rank[k] = of(k)
                    if rank[k] != _NONE:
                        heapq.heappush(heap, (rank[k], k))
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.starts[ids + 1] - self.starts[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[np.repeat(self.starts[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()


def encode_documents(df: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``df`` with ``ids`` (array of int), and ``decoded`` (binary) made from them if asked for."""

    def encoder():
        pairs = BytePairs(load_ranks(path))
        encode = Encoder(pairs.encode_words)

        def compute(texts):
            ids = list(encode.encode([t or "" for t in texts]))
            out = [[i.astype(np.int32) for i in ids]]
            return [*out, [pairs.decode(i.astype(np.int64)) for i in ids]] if decoded else out

        return compute

    return add_columns(df, [text], "ids array<int>" + ", decoded binary" * decoded, encoder, rows=256)


def digests(df: DataFrame) -> DataFrame:
    """``doc_id`` with the number of ids, and digests of ids and decoded bytes."""

    def digest():
        def compute(ids, decoded):
            raw = [np.asarray(i, "<u4").tobytes() for i in ids]
            return (
                [len(r) // 4 for r in raw],
                [hashlib.sha256(r).hexdigest() for r in raw],
                [hashlib.sha256(d).hexdigest() for d in decoded],
            )

        return compute

    return add_columns(df, ["ids", "decoded"], "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_documents(documents, public_tokenizers.path(VOCABULARY), decoded=True)
    return digests(encoded.drop("text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
