"""Best-fit packing by linear grouping: few rounded sizes, configurations, then best fit.

Lengths are whole numbers up to the capacity, so all that packing needs to know of the
corpus is how many pieces there are of each length: a table bounded by the capacity.

1. Lengths above `SMALL` share of the capacity are sorted and cut into `GROUPS` groups
   of equal numbers of pieces; each is rounded up to the largest of its group.
2. Configurations (how many pieces of each rounded size share a sequence) are optimised
   by column generation: a knapsack proposes the configuration of the best price, a
   simplex step takes it in; the amounts are rounded down.
3. The places of a group are filled with its actual lengths, longest first, which fit as
   they were rounded up. Sequences with the same lengths stay one entry with a count.
4. Small pieces, and large ones that rounding down left, go longest first where they
   leave the least room, or open new sequences.

What results is a plan of runs: "pieces number lo to hi of length L are laid, so many a
sequence, from this sequence and offset on". Spark numbers the pieces within each length
and looks their run up.

Defined cases: a null or empty text is the closing token alone. A document with more
tokens than the capacity is cut into full pieces after a first one that takes the
remainder. Rows with the same id are packed on their own, each. A null id stays null.
Identical rows get different places. Other columns are ignored; an empty table gives an
empty result. A text of any length is tokenised whole.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators.ranking import with_position
from postmill.session import materialise

CAPACITY = 1024
CLOSING = 2
#: Documents whose pieces are handed on together.
ROWS = 200
#: Share of the capacity from which a length counts as large.
SMALL = 1 / 8
GROUPS = 96

# The vocabulary's one special token.
SPECIAL = {"<|endoftext|>": 50256}


class Ids:
    """Token ids of whole texts as bytes (unsigned 32-bit, little endian).

    Reads the vocabulary as ranks, whose ids are those of its `tokenizers` file, with
    the special token's text met as that token; it is several times faster.
    """

    def __init__(self, ranks: str, pattern: str) -> None:
        import tiktoken

        with open(ranks, "rb") as lines:
            pairs = [line.split() for line in lines]
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=pattern, special_tokens=SPECIAL,
            mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs},
        )

    def encode(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def pieces(docs: DataFrame, ranks: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document of ``docs`` (id, text)."""
    id_type = docs.schema["id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, closing = Ids(ranks, pattern), np.asarray([CLOSING], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                some = batch.slice(lo, ROWS)
                at, piece, start, length, crc = [], [], [], [], []
                for k, text in enumerate(some.column("text")):
                    code = ids.encode(text.as_py() or "") + closing
                    total = len(code) // 4
                    end, begin = total % capacity or capacity, 0
                    for number in range(-(-total // capacity)):
                        at.append(k)
                        piece.append(number)
                        start.append(begin)
                        length.append(end - begin)
                        crc.append(zlib.crc32(code[4 * begin : 4 * end]))
                        begin, end = end, end + capacity
                yield pa.RecordBatch.from_arrays(
                    [some.column("id").take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("id", "text").mapInArrow(
        work, f"id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long"
    )


def _grouped(counts: dict[int, int], large: list[int]) -> list[tuple[int, list[int]]]:
    """(rounded size, its lengths): groups of about equal numbers of pieces, longest first."""
    total = sum(counts[n] for n in large)
    groups, held = [], 0
    for n in sorted(large, reverse=True):
        place = min(held * GROUPS // max(total, 1), GROUPS - 1)
        if not groups or groups[-1][0] != place:
            groups.append((place, n, []))
        groups[-1][2].append(n)
        held += counts[n]
    return [(size, lengths) for _, size, lengths in groups]


def _best_priced(prices: np.ndarray, sizes: list[int], capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of the highest price that fits: an unbounded knapsack."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    rising, value = np.asarray(sizes)[order], prices[order]
    fitting = np.searchsorted(rising, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        worth[room] = worth[room - 1]
        if n := fitting[room]:
            fits = worth[room - rising[:n]] + value[:n]
            best = int(fits.argmax())
            if fits[best] > worth[room] + 1e-12:
                worth[room], last[room] = fits[best], order[best]
    taken, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            taken[last[room]] += 1
            room -= sizes[last[room]]
    return taken, float(worth[capacity])


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(pieces of each size, sequences) of the fewest sequences, in whole numbers rounded down."""
    if not sizes:
        return []
    need = np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(60 * len(sizes)):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column, price = _best_priced(np.maximum(prices, 0), sizes, capacity)
        if price <= 1 + 1e-7:
            break
        amounts, step = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        room = np.where(step > 1e-9, amounts / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(room))] = column
    amounts = np.maximum(np.linalg.solve(basis, need), 0)
    out, left = [], [int(d) for d in demand]
    for k in np.argsort(-amounts):
        column = basis[:, k].astype(int)
        times = int(amounts[k] + 1e-9)
        times = min([times, *(left[j] // c for j, c in enumerate(column) if c)])
        if times > 0:
            out.append((column.tolist(), times))
            left = [a - times * c for a, c in zip(left, column)]
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(((length, pieces), ...), sequences): what lies in how many sequences, in order."""
    counts = {n: k for n, k in counts.items() if k}
    large = [n for n in counts if n > capacity * SMALL and n < capacity]
    groups = _grouped(counts, large)
    sizes = [size for size, _ in groups]
    waiting = [[[n, counts[n]] for n in lengths] for _, lengths in groups]
    laid: dict[tuple, int] = defaultdict(int)
    for column, times in configurations(sizes, [sum(counts[n] for n in g) for _, g in groups], capacity):
        while times:
            # Lengths at the head of each group last for so many sequences.
            content, run = [], times
            for j, want in enumerate(column):
                if not want:
                    continue
                n, here = waiting[j][0]
                if here >= want:
                    content.append((n, want))
                    run = min(run, here // want)
                else:
                    run = 1
                    take = want
                    for n, here in waiting[j]:
                        part = min(take, here)
                        content.append((n, part))
                        take -= part
                        if not take:
                            break
            for n, part in content:
                j = next(k for k, (_, g) in enumerate(groups) if n in g)
                for entry in waiting[j]:
                    if entry[0] == n:
                        entry[1] -= part * run
                waiting[j] = [e for e in waiting[j] if e[1]]
            laid[tuple(content)] += run
            times -= run
    rooms: dict[int, dict[tuple, int]] = defaultdict(dict)
    for content, times in laid.items():
        room = capacity - sum(n * k for n, k in content)
        rooms[room][content] = rooms[room].get(content, 0) + times
    if counts.get(capacity):
        rooms[0][((capacity, 1),)] = counts[capacity]
    unlaid = {n: k for entries in waiting for n, k in entries}
    unlaid |= {n: k for n, k in counts.items() if n <= capacity * SMALL and n < capacity}
    for n, left in sorted(unlaid.items(), reverse=True):
        while left:
            room = min((r for r in rooms if r >= n and rooms[r]), default=None)
            if room is None:
                content, times, room = (), left, capacity
            else:
                content = next(iter(rooms[room]))
                times = rooms[room].pop(content)
            each = min(room // n, left)
            run = min(times, left // each)
            if times > run and content:
                rooms[room][content] = rooms[room].get(content, 0) + times - run
            after = (*content, (n, each))
            rooms[room - n * each][after] = rooms[room - n * each].get(after, 0) + run
            left -= run * each
    return [(content, times) for r in sorted(rooms) for content, times in rooms[r].items()]


def runs_of(laid: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, sequence, offset, pieces a sequence) of every run of the plan."""
    used: dict[int, int] = defaultdict(int)
    found, sequence = [], 0
    for content, times in laid:
        offset = 0
        for n, each in content:
            found.append((n, used[n], sequence, offset, each))
            used[n] += each * times
            offset += n * each
        sequence += times
    return found


def pack(
    docs: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    cut = materialise(pieces(texts, ranks, pattern, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs = runs_of(plan(counts, capacity))
    before, total = {}, 0
    for n in sorted(counts):
        before[n], total = total, total + counts[n]
    # Runs of one length lie one after another: the place in all runs gives the run.
    table = sorted((before[n] + lo, sequence, offset, each) for n, lo, sequence, offset, each in runs)
    first, sequence, offset, each = (np.array(c, np.int64) for c in zip(*table)) if table else [np.zeros(0, np.int64)] * 4

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(position: pa.Array, length: pa.Array) -> pa.Array:
        at, n = position.to_numpy(zero_copy_only=False), length.to_numpy(zero_copy_only=False)
        k = np.searchsorted(first, at, side="right") - 1
        ahead = at - first[k]
        return pa.StructArray.from_arrays(
            [pa.array(sequence[k] + ahead // each[k]), pa.array(offset[k] + ahead % each[k] * n)],
            names=["sequence_id", "offset"],
        )

    numbered = with_position(cut, ["length", "id", "piece", "ids_crc32"], "position", start=0)
    return numbered.withColumn("place", place("position", "length")).select(
        "id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset"
    )
