"""A compressed full-text index over sequences of 64-bit word hashes, searched in lockstep.

The Burrows-Wheeler transform of all sequences (each closed by a separator of its own) is
held as a wavelet matrix whose codes are as long as their words are rare, so it takes
about the entropy of the words in packed bits, with a running count for every 64. A
backward step prepends a word to a match: two ranks, each one lookup per bit of its code.
Searches of many sequences go on side by side, one word per step.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with ranks."""

    def __init__(self, bits: np.ndarray) -> None:
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)][:-1].astype(np.uint32)
        self.zeros = int(len(bits) - np.count_nonzero(bits))

    def ones(self, ends: np.ndarray) -> np.ndarray:
        """Set bits before each of ``ends``."""
        block = ends >> 6
        below = self.words[block] & ((np.uint64(1) << (ends & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(below)


class WaveletMatrix:
    """Ranks of symbols in a sequence, with codes of about -log2 of a symbol's share."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        counts = np.bincount(sequence, minlength=symbols)
        share = np.maximum(counts, 1) / max(len(sequence), 1)
        self.length = np.maximum(np.ceil(-np.log2(share) - 1e-9), 1).astype(np.int64)
        self.code = self._codes()
        self.levels: list[Bits] = []
        for level in range(int(self.length.max(initial=0))):
            bits = (self.code[sequence] >> level & 1).astype(bool)
            self.levels.append(Bits(bits))
            sequence = np.r_[sequence[~bits], sequence[bits]]
            # Codes that end here lie last, by the order in which they were given out.
            sequence = sequence[: np.count_nonzero(self.length[sequence] > level + 1)]
        every = np.arange(symbols)
        self.first = self._descend(every, np.zeros(symbols, np.int64))

    def _codes(self) -> np.ndarray:
        """Prefix codes, bit k at level k, such that codes that end at a level sort last in it."""
        code, nodes = np.zeros(len(self.length), np.int64), np.zeros(1, np.int64)
        for level in range(int(self.length.max(initial=0))):
            nodes = np.r_[nodes, nodes | (1 << level)]
            ending = np.flatnonzero(self.length == level + 1)
            if len(ending):
                code[ending] = nodes[len(nodes) - len(ending) :]
                nodes = nodes[: len(nodes) - len(ending)]
            rest = self.length[self.length > level + 1]
            nodes = nodes[: int(np.ceil(np.sum(0.5 ** (rest - level - 1)) - 1e-9))]
        return code

    def _descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        places, length, code = places.astype(np.int64), self.length[symbols], self.code[symbols]
        at = np.arange(len(symbols))
        for level, bits in enumerate(self.levels):
            at = at[length[at] > level]
            if not len(at):
                break
            here = places[at]
            ones = bits.ones(here)
            places[at] = np.where(code[at] >> level & 1, bits.zeros + ones, here - ones)
        return places

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its end."""
        return self._descend(symbols, ends) - self.first[symbols]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes, no two of which are equal within one sequence's length.

    Suffixes are sorted by their first two symbols, then by what follows, as far again as
    they are known; only those that still tie are sorted again. A rank is the first place
    that a suffix can have.
    """
    n = len(symbols)
    width, ahead = int(symbols.max(initial=0)) + 2, np.zeros(n, np.int64)
    ahead[:-1] = symbols[1:] + 1
    key = symbols * width + ahead
    order, known = np.argsort(key), 2
    rank, places = np.empty(n, np.int64), np.arange(n)
    waiting, key = order, key[order]
    while True:
        new = np.r_[True, key[1:] != key[:-1]][: len(key)]
        first = places[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        rank[waiting] = first
        tied = ~(new & np.r_[new[1:], True][: len(new)])
        places, waiting = places[tied], waiting[tied]
        if not len(waiting):
            return order
        key = rank[waiting] * (n + 1) + rank[np.minimum(waiting + known, n - 1)]
        again = np.argsort(key)
        waiting, key = waiting[again], key[again]
        order[places] = waiting
        known *= 2


class FMIndex:
    """Sequences of words, given one after another with their bounds.

    ``twice`` marks sequences that stand for more than one place.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray, twice: np.ndarray | None = None) -> None:
        self.vocabulary, ids = np.unique(words, return_inverse=True)
        texts, sizes = len(bounds) - 1, np.diff(bounds)
        # Separators sort before words and differ, so no suffix equals another one.
        symbols = np.empty(len(words) + texts, np.int64)
        closing = bounds[1:] + np.arange(texts)
        inside = np.ones(len(symbols), bool)
        inside[closing] = False
        symbols[closing] = np.arange(texts)
        symbols[inside] = ids + texts
        order = suffix_array(symbols)
        transform = np.maximum(symbols[order - 1] - (texts - 1), 0)
        self.size = len(symbols)
        self.wavelet = WaveletMatrix(transform, len(self.vocabulary) + 1)
        # Suffixes of sequences that count twice, in the order of suffixes.
        own = np.zeros(texts, bool) if twice is None else twice
        self.doubled = Bits(np.repeat(own, sizes + 1)[order])
        # Suffixes that begin with a lesser symbol.
        self.lesser = np.r_[0, np.cumsum(np.bincount(transform, minlength=len(self.vocabulary) + 1))]

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words; -1 for a word that no sequence has."""
        if not len(self.vocabulary):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, -1)

    def prepend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matches of each symbol followed by what matches in [lo, hi)."""
        both = self.wavelet.rank(np.r_[symbols, symbols], np.r_[lo, hi])
        base = self.lesser[symbols]
        return base + both[: len(lo)], base + both[len(lo) :]

    def places(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many places the suffixes in [lo, hi) stand for, at least two of each that counts twice."""
        ones = self.doubled.ones(np.r_[lo, hi])
        return hi - lo + ones[len(lo) :] - ones[: len(lo)]

    def repeats(
        self, words: np.ndarray, bounds: np.ndarray, length: int, places: int = 2
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, from, to) of all maximal runs of ``length`` words or more met in so many places.

        Matching statistics by backward search: a text's matches are extended to the left
        as long as they are met often enough. Where one stops, what is shorter than
        ``length`` reports nothing; the search goes on with the last end whose run of
        ``length`` words is not inside what was found.
        """
        symbols = self.symbols(words)
        text = np.flatnonzero(np.diff(bounds) >= length)
        begin, end = bounds[:-1][text], bounds[1:][text].copy()
        met, lo, hi = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64), np.full(len(text), self.size)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(text):
            symbol = symbols[end - met - 1]
            known = np.maximum(symbol, 0)
            below, above = self.prepend(known, lo, hi)
            longer = (symbol >= 0) & (self.places(below, above) >= places)
            met, lo, hi = met + longer, np.where(longer, below, lo), np.where(longer, above, hi)
            whole = longer & (end - met == begin)
            over = ~longer | whole
            if over.any():
                hit = over & (met >= length)
                found.append((text[hit], (end - met - begin)[hit], (end - begin)[hit]))
                # Runs that are not inside the match begin before it.
                end = np.where(hit, end - met - 1 + length, end - over)
                left = ~whole & (end - begin >= length)
                met, lo, hi = np.where(over, 0, met), np.where(over, 0, lo), np.where(over, self.size, hi)
                text, begin, end, met, lo, hi = (x[left] for x in (text, begin, end, met, lo, hi))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in "xyz")
        return tuple(np.concatenate(c) for c in zip(*found))
