"""Byte-level BPE of many texts at once: each different piece of text is encoded once per task.

Both public byte-level tokenizers cut a text by the same pattern before merging. Here that cut is made on an
array of code points for many texts together; pieces are told apart by a 64-bit hash, and only those not met
before are handed to the encoder.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

#: Characters that are cut and encoded together.
CHUNK = 1 << 19
#: Different pieces that are remembered; beyond that the memory starts afresh.
REMEMBERED = 1 << 20
#: Longer pieces are told apart as text, not by hash.
LONG = 256

# Unicode white space, as the pattern's \s takes it.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _NUMBER, _SPACE, _BREAK = range(5)
_BREAK_CODE = 0x110000
_ONE, _TWO = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in ("stmd", "revell"))


def class_table() -> np.ndarray:
    kinds = np.zeros(_BREAK_CODE + 1, np.uint8)
    for code in range(0x40000):  # no letters or digits are assigned beyond these planes
        first = unicodedata.category(chr(code))[0]
        if first == "L":
            kinds[code] = _LETTER
        elif first == "N":
            kinds[code] = _NUMBER
    kinds[_WHITE] = _SPACE
    kinds[_BREAK_CODE] = _BREAK
    return kinds


def cuts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Positions where a piece starts; ``codes`` ends with a break, and every break is a piece."""
    k = kinds[codes]
    before, after = np.empty_like(k), np.empty_like(k)
    before[0], before[1:] = _BREAK, k[:-1]
    after[-1], after[:-1] = _BREAK, k[1:]
    new = k != before
    after_blank = np.empty(len(codes), bool)
    after_blank[0], after_blank[1:] = False, codes[:-1] == 32
    # The last white character before something else goes with it or stands alone.
    last_white = (k == _SPACE) & (after != _SPACE) & (after != _BREAK)
    start = (k == _BREAK) | last_white | (new & ((k == _SPACE) | ~after_blank))
    # English contractions: an apostrophe that starts a piece takes one or two letters along.
    quotes = np.flatnonzero((codes == 39) & start & (after == _LETTER))
    if len(quotes):
        padded = np.append(codes, np.full(3, _BREAK_CODE, codes.dtype))
        first, second = padded[quotes + 1], padded[quotes + 2]
        one = np.isin(first, _ONE)
        two = ~one & np.any([(first == _TWO[i]) & (second == _TWO[i + 1]) for i in (0, 2, 4)], axis=0)
        start[quotes[one | two] + 1] = False
        for at in (quotes[one] + 2, quotes[two] + 3):
            start[at[(k[at] == _LETTER)]] = True
    return np.flatnonzero(start)


def pieces(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut where a piece starts in any case: before white
    space that follows something else. A run without such a place stays whole."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut] in " \n\t" and text[cut - 1] not in " \n\t" and not text[cut - 1].isspace()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


class Encoder:
    """Ids of texts, given a function from a list of pieces to a list of their ids."""

    def __init__(self, encode_words: Callable[[list[str]], list]):
        self.encode_words = encode_words
        self.kinds = class_table()
        rng = np.random.default_rng(20240607)
        base = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.base, self.inverse = base, inverse
        self.salt = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
        self._powers(1 << 16)
        self.forget()

    def _powers(self, size: int) -> None:
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.full(size, self.base, np.uint64)) * self.inverse
            self.down = np.cumprod(np.full(size, self.inverse, np.uint64)) * self.base

    def forget(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.rows = np.empty(0, np.int64)
        self.offsets = np.zeros(1, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _remember(self, hashes: np.ndarray, found: list) -> None:
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        first = len(self.offsets) - 1
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        self.flat = np.concatenate([self.flat, *[np.asarray(f, np.uint32) for f in found]])
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.rows = np.insert(self.rows, at, first + order)

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        import pandas as pd

        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        codes[ends] = _BREAK_CODE
        if len(codes) + 1 > len(self.up):
            self._powers(2 * len(codes))
        with np.errstate(over="ignore"):
            # The break's own value, at the end of each text, takes no part in any hash.
            mixed = (codes.astype(np.uint64) + np.uint64(1)) * self.salt
            mixed ^= mixed >> np.uint64(29)
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(mixed * self.up[: len(codes)], out=sums[1:])
            start = cuts(codes, self.kinds)
            stop = np.append(start[1:], len(codes))
            inside = codes[start] != _BREAK_CODE
            start, stop = start[inside], stop[inside]
            length = stop - start
            hashes = (sums[stop] - sums[start]) * self.down[start] + length.astype(np.uint64) * self.salt
        long = np.flatnonzero(length > LONG)
        if len(long):  # each gets a value of its own that no hash of this chunk has
            hashes[long] = 0
            own: dict[str, int] = {}
            taken = set(hashes.tolist())
            for i in long:
                word = joined[start[i] : stop[i]]
                if word not in own:
                    free = len(own) + 1
                    while free in taken:
                        free += 1 << 40
                    own[word] = free
                    taken.add(free)
                hashes[i] = own[word]
        code, different = pd.factorize(hashes)
        firsts = np.full(len(different), len(hashes), np.int64)
        np.minimum.at(firsts, code, np.arange(len(code)))
        is_long = length[firsts] > LONG if len(different) else np.empty(0, bool)
        if len(self.hashes) + len(different) > REMEMBERED:
            self.forget()
        at = np.minimum(np.searchsorted(self.hashes, different), max(len(self.hashes) - 1, 0))
        known = (self.hashes[at] == different) & ~is_long if len(self.hashes) else np.zeros(len(different), bool)
        new = np.flatnonzero(~known & ~is_long)
        if len(new):
            self._remember(different[new], self.encode_words([joined[start[i] : stop[i]] for i in firsts[new]]))
        row = np.empty(len(different), np.int64)
        short = ~is_long
        row[short] = self.rows[np.searchsorted(self.hashes, different[short])]
        flat, offsets = self.flat, self.offsets
        if is_long.any():
            found = self.encode_words([joined[start[i] : stop[i]] for i in firsts[is_long]])
            row[is_long] = len(offsets) - 1 + np.arange(len(found))
            offsets = np.concatenate([offsets, offsets[-1] + np.cumsum([len(f) for f in found])])
            flat = np.concatenate([flat, *[np.asarray(f, np.uint32) for f in found]])
        row = row[code]
        size = offsets[row + 1] - offsets[row]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(offsets[row] - total[:-1], size) + np.arange(total[-1])]
        edges = total[np.searchsorted(start, ends)]
        return np.split(ids, edges[:-1])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; texts are taken together up to ``CHUNK`` characters."""
        group: list[str] = []
        size = 0
        for text in texts:
            if len(text) > CHUNK:
                if group:
                    yield from self._chunk(group)
                    group, size = [], 0
                yield np.concatenate([ids for part in pieces(text) for ids in self._chunk([part])])
                continue
            group.append(text)
            size += len(text)
            if size > CHUNK:
                yield from self._chunk(group)
                group, size = [], 0
        if group:
            yield from self._chunk(group)
