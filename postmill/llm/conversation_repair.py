"""Conversation structure repair: cheapest edits by min-plus matrices over a Re-Pair grammar.

A row is a symbol: its role's initial (s, u, a or another) and its first fault. Blank rows
(no `[^\\x20\\x09-\\x0D]`) and duplicates (role and text seen earlier) must go; truncated rows
(last such character not `[.!?]`) cost `TRUNCATED` if they stay. Edits are Keep (0), Rerole to
user or assistant (1), Delete (2), Insert of an empty user or assistant row (5). Roles left
must read `(s?(ua)+)?`. Of the cheapest edits those with the ASCII-least audit, the initials
of the edits in order, are taken. They fix the roles: an odd number of rows begins with s.

1. Rows are range-sorted by conversation and turn and cut into segments of `SEGMENT` rows at
   most, so that a conversation of any length lies on many tasks.
2. A Re-Pair grammar is built over the distinct segments: Spark counts neighbouring symbols,
   the most frequent pairs become rules (several a round, none of which overlap), and the
   next round counts in the rewritten segments.
3. A symbol is a 4 x 4 min-plus matrix over the states of the grammar of roles; an entry is
   (cost, audit rope). Matrices of rules are products, made bottom-up once and shared by all
   conversations. Ropes of equal cost are compared by walking them side by side. With them
   go the counts of faults and of illegal neighbours, which add up in the same order.
4. A conversation is the product of its segments, folded in order; audits that all states
   share are put out, so little is held. The edits are then played over the rows, which are
   streamed in order, so no conversation is ever held whole but for its audit.

An entry's cost follows from its audit's letters and the rows, so of two audits of equal cost
neither begins with the whole other one; least audits of parts make the least whole.

The number of rules is bounded by `RULES` and `ROUNDS`; symbols that no rule covers are
multiplied one by one, with the same result.

Defined cases: a null role or text counts as one space; a role that begins otherwise than
with s, u or a can be changed or deleted, not kept. A null id is a conversation of its own.
Rows of one turn are ordered by role, then by a digest of the text; null turns come first.
Equal rows are duplicates but for the first. A table without rows gives none. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.session import materialise

#: Most rows of a segment.
SEGMENT = 4096
RULES = 4096
ROUNDS = 16
#: Rules that a round makes at most, and their count at least as a share of the best.
EACH, SHARE = 256, 1 / 8
#: Segments whose matrices a task remembers.
REMEMBERED = 20_000

# Costs of edits, white space, sentence ends, roles that can be given.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
WHITE = " \t\n\x0b\x0c\r"
GIVEN = ("user", "assistant")

# Symbols: class of the role + 4 * fault; rules follow from `FIRST_RULE` on.
OK, CUT, AGAIN, BLANK = 0, 1, 2, 3
FIRST_SYMBOL, FIRST_RULE = 0x61, 0xE000

# States: nothing yet, after s, after u, after a. `NEXT` has the state after a role.
NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
ACCEPTED = (0, 3)
LEGAL = {(0, 1), (1, 2), (2, 1)}

Matrix = dict[tuple[int, int], tuple[int, object]]


def _leaves(rope: object) -> Iterator[str]:
    todo = [rope]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            yield part
        else:
            todo.append(part[1])
            todo.append(part[0])


def flat(rope: object) -> str:
    return rope if isinstance(rope, str) else "".join(_leaves(rope))


def before(a: object, b: object) -> bool:
    """Whether rope ``a`` is less than rope ``b``; parts that both share are passed over."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if not isinstance(x, str):
            left += (x[1], x[0])
            right.append(y)
        elif not isinstance(y, str):
            left.append(x)
            right += (y[1], y[0])
        else:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            left += [x[n:]] if x[n:] else []
            right += [y[n:]] if y[n:] else []
    return bool(right) and not left


def joined(a: object, b: object) -> object:
    return b if a == "" else a if b == "" else (a, b)


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product; ties go to the least audit."""
    out: Matrix = {}
    for (p, m), (cost, rope) in a.items():
        for q in range(4):
            other = b.get((m, q))
            if other is None:
                continue
            total, known = cost + other[0], out.get((p, q))
            if known is None or total < known[0]:
                out[p, q] = total, joined(rope, other[1])
            elif total == known[0] and before(candidate := joined(rope, other[1]), known[1]):
                out[p, q] = total, candidate
    return out


def inserting() -> Matrix:
    """Rows that may be put in between two others."""
    out: Matrix = {(q, q): (0, "") for q in range(4)}
    for start in range(4):
        state, role = start, 2 if start == 2 else 1
        for n in (1, 2):
            state = NEXT[state, role]
            role = 3 - role
            if (start, state) not in out:
                out[start, state] = INSERT * n, "I" * n
    return out


def symbol_matrix(code: int) -> Matrix:
    """The edits of one row, then rows put in behind it."""
    role, fault = code % 4, code // 4
    out: Matrix = {(q, q): (DELETE, "D") for q in range(4)}
    if fault in (OK, CUT):
        stays = TRUNCATED if fault == CUT else 0
        for (state, given), after in NEXT.items():
            if given == role:
                out[state, after] = stays, "K"
            elif given in (1, 2):
                out[state, after] = REROLE + stays, "R"
    return times(out, inserting())


def symbol_counts(code: int) -> tuple[int, ...]:
    """(blank, duplicate, truncated, illegal, first class, last class)."""
    role, fault = code % 4, code // 4
    return int(fault == BLANK), int(fault == AGAIN), int(fault == CUT), 0, role, role


def added(a: tuple[int, ...] | None, b: tuple[int, ...]) -> tuple[int, ...]:
    if a is None:
        return b
    illegal = a[3] + b[3] + ((a[5], b[4]) not in LEGAL)
    return a[0] + b[0], a[1] + b[1], a[2] + b[2], illegal, a[4], b[5]


class Grammar:
    """Rules in the order they were made, and the matrix and counts of every symbol."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, str]] = []
        self.values = {
            chr(FIRST_SYMBOL + c): (symbol_matrix(c), symbol_counts(c)) for c in range(16)
        }

    def add(self, pair: str) -> None:
        (a, m), (b, n) = self.values[pair[0]], self.values[pair[1]]
        name = chr(FIRST_RULE + len(self.rules))
        self.rules.append((pair, name))
        self.values[name] = times(a, b), added(m, n)

    def rewritten(self, text: str) -> str:
        for pair, name in self.rules:
            text = text.replace(pair, name)
        return text

    def product(self, segment: str) -> tuple[dict[tuple[int, int], tuple[int, str]], tuple[int, ...]]:
        """Matrix, with audits written out, and counts of a segment."""
        values = [self.values[c] for c in self.rewritten(segment)]
        matrix = reduce(times, (v[0] for v in values))
        return {k: (c, flat(r)) for k, (c, r) in matrix.items()}, reduce(added, (v[1] for v in values))


def pair_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of neighbouring symbols in lines and how often each can be replaced."""
    codes = np.frombuffer(text.encode("utf-16-le"), "<u2").astype(np.int64)
    if len(codes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = codes[:-1], codes[1:]
    # In a run of one symbol only every second place can be replaced.
    starts = np.r_[0, np.flatnonzero(a != b) + 1]
    begin = starts[np.searchsorted(starts, np.arange(len(a)), side="right") - 1]
    usable = (a != 10) & (b != 10) & ((a != b) | ((np.arange(len(a)) - begin) % 2 == 0))
    return np.unique((a[usable] << 16) | b[usable], return_counts=True)


def chosen(counts: list[tuple[int, int]], room: int) -> list[str]:
    """The most frequent pairs that can be replaced in one round without overlaps."""
    firsts, seconds, out = set(), set(), []
    for code, n in counts:
        if len(out) == room or n < max(2, counts[0][1] * SHARE):
            break
        x, y = code >> 16, code & 0xFFFF
        if x in seconds or y in firsts or (x == y and (x in firsts or y in seconds)):
            continue
        firsts.add(x)
        seconds.add(y)
        out.append(chr(x) + chr(y))
    return out


def built(segments: DataFrame) -> Grammar:
    """A grammar over the distinct values of the column `segment`."""
    distinct = materialise(segments.select("segment").distinct(), "segments")
    grammar = Grammar()
    for _ in range(ROUNDS):
        room = min(EACH, RULES - len(grammar.rules))
        rules = list(grammar.rules)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = "\n".join(batch.column(0).to_pylist())
                for pair, name in rules:
                    text = text.replace(pair, name)
                codes, n = pair_counts(text)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["pair", "n"])

        counts = distinct.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        best = counts.filter("n > 1").orderBy(F.col("n").desc(), "pair").limit(4 * EACH).collect()
        pairs = chosen([(r["pair"], r["n"]) for r in best], room)
        if not pairs:
            break
        for pair in pairs:
            grammar.add(pair)
    return grammar


class Fold:
    """Cheapest edits of a conversation from the start to each state, segment by segment.

    What the audits of all states share is put out; of the rest it is kept which is less,
    so that a tie looks at the segment alone unless one rest begins with the other.
    """

    def __init__(self) -> None:
        self.shared: list[str] = []
        self.ends = {q: value for (p, q), value in inserting().items() if p == 0}
        self.counts: tuple[int, ...] | None = None

    def add(self, matrix: dict[tuple[int, int], tuple[int, str]], counts: tuple[int, ...]) -> None:
        self.counts = added(self.counts, counts)
        after: dict[int, tuple[int, int, str]] = {}
        for (p, q), (cost, audit) in matrix.items():
            if p not in self.ends:
                continue
            total, known = self.ends[p][0] + cost, after.get(q)
            if known is None or total < known[0] or (total == known[0] and self._less(p, audit, known[1], known[2])):
                after[q] = total, p, audit
        ends = {q: (total, self.ends[p][1] + audit) for q, (total, p, audit) in after.items()}
        least, most = min(v[1] for v in ends.values()), max(v[1] for v in ends.values())
        n = next((k for k, (x, y) in enumerate(zip(least, most)) if x != y), min(len(least), len(most)))
        if n:
            self.shared.append(least[:n])
            ends = {q: (total, audit[n:]) for q, (total, audit) in ends.items()}
        self.ends = ends

    def _less(self, p: int, audit: str, q: int, other: str) -> bool:
        a, b = self.ends[p][1], self.ends[q][1]
        n = min(len(a), len(b))
        if a[:n] != b[:n]:
            return a < b
        return a[n:] + audit < b[n:] + other

    def best(self) -> tuple[int, str]:
        cost, audit = min(self.ends[q] for q in ACCEPTED if q in self.ends)
        return cost, "".join(self.shared) + audit


def _texts(conversations: DataFrame, id_column: str) -> DataFrame:
    """(id, turn, role, text, digest): what all steps read."""
    space = F.lit(" ")
    return conversations.select(
        F.col(id_column).alias("id"), F.col("turn").alias("turn"), F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    ).withColumn("digest", F.sha2("text", 256))


def _in_order() -> list[Column]:
    return [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def segments(texts: DataFrame) -> DataFrame:
    """(id, at, segment): the symbols of up to ``SEGMENT`` neighbouring rows of a conversation."""
    trimmed = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = texts.select(
        "id", "turn", "role", "digest", role.alias("class"), (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    placed = materialise(narrow.orderBy(*_in_order()).withColumn("at", F.monotonically_increasing_id()), "rows")
    met = placed.groupBy("id", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = met.select(F.col("id").alias("i"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("at") > F.col("first"), AGAIN).when(F.col("cut"), CUT).otherwise(OK)
    coded = placed.join(met, same, "left").select(
        "id", "at", F.char(F.col("class") + 4 * fault + FIRST_SYMBOL).alias("symbol")
    )
    # The number of a row within its part of the sort, and that part, cut the segments.
    here = F.col("at") - F.col("at").bitwiseAND((1 << 33) - 1) % SEGMENT
    listed = F.array_sort(F.collect_list(F.struct("at", "symbol")))
    return coded.groupBy("id", here.alias("here")).agg(listed.alias("rows")).select(
        "id", F.col("rows")[0]["at"].alias("at"), F.array_join(F.col("rows.symbol"), "").alias("segment")
    )


def audits(texts: DataFrame) -> DataFrame:
    """(id, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    found = materialise(segments(texts), "conversations")
    grammar = built(found)
    id_type = found.schema["id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict[str, tuple] = {}
        current, state, done = None, None, []

        def closed() -> list:
            cost, audit = state.best()
            return [current, *state.counts[:4], cost, audit]

        def batch_of(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = [id_arrow, *[pa.int64()] * 5, pa.string()]
            names = ["id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            id_arrow = batch.schema.field("id").type
            for name, segment in zip(batch.column("id").to_pylist(), batch.column("segment").to_pylist()):
                if state is None or name != current:
                    if state is not None:
                        done.append(closed())
                    current, state = name, Fold()
                if segment not in remembered:
                    if len(remembered) >= REMEMBERED:
                        remembered.clear()
                    remembered[segment] = grammar.product(segment)
                state.add(*remembered[segment])
            if done:
                yield batch_of(done)
                done = []
        if state is not None:
            yield batch_of([closed()])

    ordered = found.repartition("id").sortWithinPartitions(F.col("id").asc_nulls_first(), "at").select("id", "segment")
    return ordered.mapInArrow(
        fold, f"id {id_type}, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    )


def _played(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str | None, str | None, str | None]]:
    """(id, edit, role, text) of every row that stays or is put in; (id, None, None, None) ends a conversation.

    Rows come in order, each conversation's audit first.
    """
    current, audit, place, out, odd, begun = None, "", 0, 0, False, False

    def role() -> str:
        return GIVEN[(out - odd) % 2]

    def put_in() -> Iterator[tuple]:
        nonlocal place, out
        while place < len(audit) and audit[place] == "I":
            yield current, "Insert", role(), ""
            place, out = place + 1, out + 1

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("id", "audit", "role", "text")]
        for name, edits, own, text in zip(*columns):
            if edits is not None:
                if begun:
                    yield from put_in()
                    yield current, None, None, None
                current, audit, place, out, begun = name, edits, 0, 0, True
                odd = (len(edits) - edits.count("D")) % 2
                continue
            yield from put_in()
            letter, place = audit[place], place + 1
            if letter == "D":
                continue
            yield (current, "Keep", own, text) if letter == "K" else (current, "Rerole", role(), text)
            out += 1
    if begun:
        yield from put_in()
        yield current, None, None, None


def _with_audits(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``texts`` in order, before those of each conversation its audit."""
    heads = found.select(
        "id", F.lit(0).alias("kind"), F.lit(None).cast(texts.schema["turn"].dataType).alias("turn"),
        F.lit("").alias("role"), F.lit("").alias("text"), F.lit("").alias("digest"), "audit",
    )
    rows = texts.select("id", F.lit(1).alias("kind"), "turn", "role", "text", "digest", F.lit(None).cast("string").alias("audit"))
    order = _in_order()
    return heads.unionByName(rows).repartition("id").sortWithinPartitions(order[0], "kind", *order[1:]).select(
        "id", "audit", "role", "text"
    )


def repaired(conversations: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """(id, position, role, text, edit): the rows of every conversation after its cheapest edits."""
    texts = _texts(conversations, id_column)
    found = materialise(audits(texts), "audits")
    id_type = texts.schema["id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_arrow
            for batch in batches:
                id_arrow = batch.schema.field("id").type
                yield batch

        def batch_of() -> pa.RecordBatch:
            types = [id_arrow, pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["id", "position", "role", "text", "edit"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), types)], names=names)

        id_arrow, some, position = None, [], 0
        for name, edit, role, text in _played(kinds(batches)):
            if edit is None:
                position = 0
                continue
            some.append((name, position, role, text, edit))
            position += 1
            if len(some) == 1000:
                yield batch_of()
                some = []
        if some:
            yield batch_of()

    return _with_audits(texts, found).mapInArrow(rows, f"id {id_type}, position long, role string, text string, edit string")


def report(conversations: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """One row per conversation: gaps in its turns, faults, cost, audit and a hash of what is left.

    (id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256); the hash
    is that of the lines `role:text`, joined by line feeds.
    """
    texts = _texts(conversations, id_column)
    found = materialise(audits(texts), "audits")
    id_type = texts.schema["id"].dataType.simpleString()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_arrow
            for batch in batches:
                id_arrow = batch.schema.field("id").type
                yield batch

        id_arrow, ids, digests, own, lines = None, [], [], hashlib.sha256(), 0
        for name, edit, role, text in _played(kinds(batches)):
            if edit is None:
                ids.append(name)
                digests.append(own.hexdigest())
                own, lines = hashlib.sha256(), 0
                if len(ids) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, id_arrow), pa.array(digests)], names=["id", "sha"])
                    ids, digests = [], []
                continue
            own.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
            lines += 1
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_arrow), pa.array(digests)], names=["id", "sha"])

    hashed = _with_audits(texts, found).mapInArrow(hashes, f"id {id_type}, sha string")
    turns = texts.groupBy("id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    by_id = [t.withColumnRenamed("id", name) for t, name in ((hashed, "i"), (turns, "j"))]
    joined_rows = found.join(by_id[0], F.col("id").eqNullSafe(F.col("i"))).join(by_id[1], F.col("id").eqNullSafe(F.col("j")))
    return joined_rows.select(
        "id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256")
    )
