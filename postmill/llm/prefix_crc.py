"""CRC-32 of every run of words of a text, from one scan that stores running CRCs.

The words of many texts are written one after another, a space behind each, and the
CRC register is noted at the begin and end of every word. Shifting a register by n bytes
is a linear map over GF(2), and CRCs add without carry: what lies before a run cancels
when the register at its begin, shifted by its length, is added to the one at its end.
So a run of any number of words costs two lookups, whatever its length in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# The reflected polynomial of CRC-32, its first and last register.
POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)

# Bytes of words are digits, letters, and all bytes beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SPACE = np.uint8(0x20)

#: Bytes a lane reads; lanes are scanned side by side.
LANE = 256


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_BYTE = _byte_table()


def _apply(operator: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map, given as its four tables of one byte each, on registers."""
    return (
        operator[0][values & 255] ^ operator[1][(values >> 8) & 255]
        ^ operator[2][(values >> 16) & 255] ^ operator[3][values >> 24]
    )


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """The shifts by 0 to 255 bytes in one table, and those by 2 ** k bytes from k = 8 on."""
    identity = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    small = [identity]
    for _ in range(256):
        small.append(_BYTE[small[-1] & 255] ^ (small[-1] >> 8))
    large = [small.pop()]
    for _ in range(40):
        large.append(_apply(large[-1], large[-1]))
    return np.stack(small).reshape(-1), large


_SMALL, _LARGE = _shifts()


def shifted(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every register after as many zero bytes as its entry of ``lengths``."""
    base = (lengths & 255).astype(np.int64) << 10
    out = (
        _SMALL[base + (values & 255)] ^ _SMALL[base + 256 + ((values >> 8) & 255)]
        ^ _SMALL[base + 512 + ((values >> 16) & 255)] ^ _SMALL[base + 768 + (values >> 24)]
    )
    rest, k = lengths >> 8, 0
    while (at := np.flatnonzero(rest)).size:
        odd = at[(rest[at] & 1).astype(bool)]
        out[odd] = _apply(_LARGE[k], out[odd])
        rest, k = rest >> 1, k + 1
    return out


def running(stream: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The register before each of the ``places`` of a byte stream, from 0 at its begin."""
    lanes = -(-len(stream) // LANE) or 1
    padded = np.zeros(lanes * LANE, np.uint8)
    padded[: len(stream)] = stream
    columns = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
    states = np.zeros((LANE + 1, lanes), np.uint32)
    for k in range(LANE):
        last = states[k]
        states[k + 1] = _BYTE[(last ^ columns[k]) & 255] ^ (last >> 8)
    # What enters each lane: sums of the lanes before, in steps that double.
    entering = np.r_[np.uint32(0), states[LANE][:-1]]
    step, k = 1, 0
    while step < lanes:
        carried = entering.copy()
        carried[step:] ^= _apply(_LARGE[k], entering[:-step])
        entering, step, k = carried, step * 2, k + 1
    lane, at = places // LANE, places % LANE
    whole = lane == lanes
    lane, at = np.where(whole, lanes - 1, lane), np.where(whole, LANE, at)
    return states[at, lane] ^ shifted(entering[lane], at)


class Words:
    """The words of a run of texts as one stream: text number, begin and end of each."""

    def __init__(self, data: np.ndarray, starts: np.ndarray) -> None:
        data = LOWER[np.insert(data, starts[1:], SPACE)]
        begins = starts[:-1] + np.arange(len(starts) - 1)
        inside = WORD[data]
        kept = inside.copy()
        kept[1:] |= inside[:-1]
        self.stream = np.where(inside, data, SPACE)[kept]
        self.ends = np.flatnonzero(self.stream == SPACE)
        self.starts = np.r_[0, self.ends[:-1] + 1] if len(self.ends) else self.ends
        closing = np.flatnonzero(kept & ~inside)
        self.doc = np.searchsorted(begins, closing, side="right") - 1

    def runs(self, most: int, known: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length up to ``most``: text number and CRC-32 of every run of so many words.

        The first ``known`` words only lead into later ones: runs that end in them are left out.
        """
        registers = running(self.stream, np.r_[self.starts, self.ends])
        before, after = registers[: len(self.starts)] ^ ONES, registers[len(self.starts) :] ^ ONES
        for n in range(1, most + 1):
            first = max(known - n + 1, 0)
            last = len(self.doc) - n + 1
            if last <= first:
                continue
            same = self.doc[first:last] == self.doc[first + n - 1 :]
            begin, end = np.arange(first, last)[same], np.arange(first + n - 1, len(self.doc))[same]
            lengths = self.ends[end] - self.starts[begin]
            yield self.doc[begin], after[end] ^ shifted(before[begin], lengths)


def pieces(data: np.ndarray, size: int, context: int) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in pieces of about ``size`` bytes that end after a word.

    Each piece but the first begins with the last ``context`` words before it; it comes
    with their number. A word is never cut, however long.
    """
    lo = 0
    while lo < len(data):
        hi = min(lo + size, len(data))
        while hi < len(data) and WORD[data[hi]]:
            gap = np.flatnonzero(~WORD[data[hi : hi + size]])
            hi = hi + int(gap[0]) if len(gap) else min(hi + size, len(data))
        begin, led = lo, 0
        reach = 256
        while lo and led < context and begin:
            begin = max(lo - reach, 0)
            inside = WORD[data[begin:lo]]
            opens = np.flatnonzero(inside & ~np.r_[begin > 0, inside[:-1]])
            if len(opens) >= context:
                begin, led = begin + int(opens[-context]), context
            elif not begin:
                led = len(opens)
            reach *= 4
        yield data[begin:hi], led
        lo = hi
