"""Sets of hashed word shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_CHUNK = 1 << 20
_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted sets of 64-bit hashes of each run of ``size`` words; a shorter text is one shingle.

    Words are what stands between white space (space, and tab to carriage return).
    """

    def __init__(self, size: int = 5):
        self.size = size
        self.base = np.uint64(0x5851F42D4C957F2D)
        self.inverse = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
        self._powers(1 << 16)

    def _powers(self, size: int) -> None:
        self.up = np.cumprod(np.full(size, self.base, np.uint64))
        self.down = np.cumprod(np.full(size, self.inverse, np.uint64))

    def word_hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each text's words end among them."""
        joined = " ".join(texts) + " "
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts])
        if len(codes) > len(self.up):
            self._powers(2 * len(codes))
        blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
        edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1))
        start, stop = edge[::2], edge[1::2]
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(_ODD)) * self.up[: len(codes)], out=sums[1:])
        words = _mix((sums[stop] - sums[start]) * self.down[start] + (stop - start).astype(np.uint64))
        return words, np.searchsorted(start, ends)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        words, ends = self.word_hashes(texts)
        n = len(words)
        runs = np.zeros(max(0, n - self.size + 1), np.uint64)
        for i in range(self.size):
            runs = _mix(runs + np.uint64(_ODD)) + words[i : i + len(runs)]
        runs = _mix(runs)
        first = 0
        for end in ends.tolist():
            if end - first >= self.size:
                yield np.unique(runs[first : end - self.size + 1])
            elif end > first:
                whole = np.uint64(end - first)
                for w in words[first:end]:
                    whole = _mix(whole + np.uint64(_ODD)) + w
                yield np.atleast_1d(_mix(np.atleast_1d(whole)))
            else:
                yield np.empty(0, np.uint64)
            first = end

    def sets(self, texts: list[str]) -> Iterator[np.ndarray]:
        group: list[str] = []
        size = 0
        with np.errstate(over="ignore"):
            for text in texts:
                if group and size + len(text) > _CHUNK:
                    yield from self._group(group)
                    group, size = [], 0
                group.append(text)
                size += len(text)
            if group:
                yield from self._group(group)
