"""Words of Arrow text columns, hashed from the UTF-8 buffers without Python strings.

Texts are worked off in runs of about ``RUN`` bytes. A longer text is cut at white
space into pieces, so the temporary arrays stay small whatever a text's length; a
single word longer than ``RUN`` is the only thing that makes a piece longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN = 1 << 20

# The white space that separates words, and the letters that fold.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
UPPER = (0x41, 0x5A)

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, size: int = RUN) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``size`` bytes, one text at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class WordHasher:
    """64-bit hashes of words, equal after folding A-Z unless told not to, the same in every task."""

    def __init__(self, fold: bool = True) -> None:
        self.space = np.zeros(256, bool)
        self.space[list(WHITE)] = True
        codes = np.arange(256, dtype=np.uint64)
        if fold:
            codes[UPPER[0] : UPPER[1] + 1] += np.uint64(32)
        self.values = mix(codes * _BASE + np.uint64(1))
        self._grow(RUN)

    def _grow(self, n: int) -> None:
        factor = _BASE | np.uint64(1)
        inverse = np.uint64(pow(int(factor), -1, 1 << 64))
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(n, factor, np.uint64))
            self.inverses = np.cumprod(np.full(n, inverse, np.uint64))

    def spans(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every word; a word never crosses from one text to the next."""
        solid = ~self.space[data]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        filled = starts[1:] > starts[:-1]
        first, last = starts[:-1][filled], starts[1:][filled] - 1
        begins[first] = solid[first]
        ends[last] = solid[last]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def _piece(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end = self.spans(data, starts)
        if not len(begin):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if len(data) > len(self.powers):
            self._grow(len(data))
        with np.errstate(over="ignore"):
            terms = self.values[data] * self.powers[: len(data)]
            sums = np.cumsum(terms)
            hashes = (sums[end - 1] - sums[begin] + terms[begin]) * self.inverses[begin]
            hashes = mix(hashes + (end - begin).astype(np.uint64))
        return np.searchsorted(starts, begin, side="right") - 1, hashes

    def words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text number and hash of every word of a run of texts, in order."""
        if len(starts) > 2 or len(data) <= 2 * RUN:
            return self._piece(data, starts)
        found, lo = [], 0
        while lo < len(data):
            hi = min(lo + RUN, len(data))
            while hi < len(data) and not self.space[data[hi]]:
                gap = np.flatnonzero(self.space[data[hi : hi + RUN]])
                hi = hi + int(gap[0]) if len(gap) else min(hi + RUN, len(data))
            found.append(self._piece(data[lo:hi], np.array([0, hi - lo])))
            lo = hi
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def shingles(doc: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of every text, ordered by text and hash.

    A text of fewer than n words has its whole sequence as its one shingle.
    """
    if not len(words):
        return doc, words
    factors = mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    with np.errstate(over="ignore"):
        full = max(len(words) - n + 1, 0)
        total = np.full(full, np.uint64(n), np.uint64)
        for k in range(n):
            total += words[k : k + full] * factors[k]
        whole = doc[:full] == doc[n - 1 : n - 1 + full]
        docs, found = [doc[:full][whole]], [mix(total[whole])]
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        counts = np.diff(np.r_[first, len(doc)])
        for size in range(1, n):
            at = first[counts == size]
            if len(at):
                short = np.full(len(at), np.uint64(size), np.uint64)
                for k in range(size):
                    short += words[at + k] * factors[k]
                docs.append(doc[at])
                found.append(mix(short))
    d, s = np.concatenate(docs), np.concatenate(found)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1])]
    return d[new], s[new]


def shingle_sets(
    column: pa.Array, hasher: WordHasher, n: int
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each run of texts: its range, and per text the bounds of its sorted set."""
    data, offsets = column_bytes(column)
    for lo, hi in runs(offsets):
        part = data[offsets[lo] : offsets[hi]]
        doc, sets = shingles(*hasher.words(part, offsets[lo : hi + 1] - offsets[lo]), n)
        yield lo, hi, np.searchsorted(doc, np.arange(hi - lo + 1)), sets
