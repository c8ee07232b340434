import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from postmill.llm import conversation_repair as repair
from postmill.llm.queries import damaged, op12_conversation_repair

WORD = r"[^\x20\x09-\x0D]"


def faults_of(rows):
    """First fault of every (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        found = re.findall(WORD, text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen
                   else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by a plain search over rows, roles so far, and edits."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def with_inserts(states):
        best = dict(states)
        for _ in range(2):
            for state, (cost, audit, kept) in list(best.items()):
                for role in ("user", "assistant"):
                    after = step.get((state, role[0]))
                    if after:
                        new = (cost + 5, audit + "I", kept + ((role, ""),))
                        if after not in best or new[:2] < best[after][:2]:
                            best[after] = new
        return best

    states = with_inserts({"": (0, "", ())})
    for (role, text), fault in zip(rows, faults_of(rows)):
        after = {}
        for state, (cost, audit, kept) in states.items():
            moves = [(state, cost + 2, "D", ())]
            if fault not in ("blank", "duplicate"):
                stays = 5 if fault == "truncated" else 0
                if target := step.get((state, role[:1])):
                    moves.append((target, cost + stays, "K", ((role, text),)))
                for given in ("user", "assistant"):
                    if given[0] != role[:1] and (target := step.get((state, given[0]))):
                        moves.append((target, cost + stays + 1, "R", ((given, text),)))
            for target, total, letter, row in moves:
                new = (total, audit + letter, kept + row)
                if target not in after or new[:2] < after[target][:2]:
                    after[target] = new
        states = with_inserts(after)
    return min((states[s] for s in ("", "a") if s in states), key=lambda v: v[:2])


def brute(rows):
    """The report of rows (turn, role, text) of one conversation, in order."""
    turns = {t for t, _, _ in rows if t is not None}
    own = [(r, x) for _, r, x in rows]
    faults = faults_of(own)
    cost, audit, kept = cheapest(own) if rows else (0, "", ())
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(own, own[1:])]
    lines = "\n".join(f"{r}:{x}" for r, x in kept)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
        faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
        hashlib.sha256(lines.encode()).hexdigest(),
    )


def in_order(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest())
    return sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=key)


def grouped(table):
    out = defaultdict(list)
    for conv, *row in table:
        out[conv].append(tuple(row))
    return out


def reported(found):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r[c] for c in names) for r in found.collect()}


def harmed(rows):
    """Rows (conv, turn, role, text) damaged as the query does."""
    out = []
    for conv, turn, role, text in rows:
        show = [" " if v is None else str(v) for v in (conv, turn)]
        kind = zlib.crc32(":".join(show).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = op12_conversation_repair(spark, sf)
    left = grouped(harmed(rows))
    want = {c: brute(in_order(left.get(c, []))) for c in {r[0] for r in rows}}
    assert reported(found) == want
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"] * 2


def odd_table(rng, conversations=60):
    texts = ["a.", "b!", "c", " ", "", None, "x?\n", "end", "日.", " ", "long " * 300 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User", "umbrella"]
    out = []
    for conv in [None, *range(conversations)]:
        for _ in range(rng.choice([1, 2, 3, 6, 12])):
            out.append((conv, rng.choice([None, 1, 2, 3, 5, 9]), rng.choice(roles), rng.choice(texts)))
        if rng.random() < 0.3:
            out.append(out[-1])
    return out


def test_odd_rows_against_brute_force(spark):
    table = odd_table(random.Random(4))
    df = spark.createDataFrame([(*r, "z", 3) for r in table], "conv_id long, turn long, role string, text string, audit string, id int")
    want = {c: brute(in_order(rows)) for c, rows in grouped(table).items()}
    assert reported(repair.report(df)) == want
    assert repair.report(df.limit(0)).collect() == []
    rows = repair.repaired(df)
    assert rows.columns == ["id", "position", "role", "text", "edit"]
    lines = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: r.position):
        lines[r.id].append(f"{r.role}:{r.text}")
    for conv, value in want.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == value[-1]


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in (None, 1, 2) for t in (None, *range(40))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(str, (tuple(r) for r in damaged(df).collect()))) == sorted(map(str, harmed(rows)))


def test_a_conversation_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 7)
    rng = random.Random(9)
    table = [(1, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["a.", "b", " ", f"{t}."])) for t in range(300)]
    table += [(2, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(100)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    assert reported(repair.report(df)) == {c: brute(in_order(rows)) for c, rows in grouped(table).items()}


def test_products_equal_the_search_over_all_edits():
    """Least cost and audit of short rows, by listing every way to edit them."""
    roles, faults = "sua-", {"": "a.", "truncated": "a", "blank": " "}
    grammar = repair.Grammar()
    code = {"": 0, "truncated": 1, "blank": 3}
    rng = random.Random(8)
    for n in (1, 2, 3):
        every = list(itertools.product(itertools.product(roles, faults), repeat=n))
        for rows in every if n < 3 else rng.sample(every, 12):
            ways = []
            edits = [[("D", None)] + ([] if f == "blank" else [("K", r), *[("R", g) for g in "ua" if g != r]]) for r, f in rows]
            for letters in itertools.product(*edits):
                for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=n + 1):
                    out = inserts[0] + "".join((x or "") + i for (_, x), i in zip(letters, inserts[1:]))
                    if not re.fullmatch("(s?(ua)+)?", out):
                        continue
                    audit = "I" * len(inserts[0]) + "".join(e + "I" * len(i) for (e, _), i in zip(letters, inserts[1:]))
                    cost = 5 * audit.count("I") + sum(
                        {"D": 2, "K": 0, "R": 1}[e] + (5 if f == "truncated" and e != "D" else 0) for (e, _), (_, f) in zip(letters, rows))
                    ways.append((cost, audit))
            segment = "".join(chr(0x61 + roles.index(r) + 4 * code[f]) for r, f in rows)
            fold = repair.Fold()
            fold.add(*grammar.product(segment))
            assert fold.best() == min(ways), rows


def test_rules_change_no_product_and_ropes_compare_as_text():
    rng = random.Random(2)
    plain, ruled = repair.Grammar(), repair.Grammar()
    for _ in range(40):
        names = [chr(0x61 + c) for c in range(16)] + [n for _, n in ruled.rules]
        ruled.add(rng.choice(names) + rng.choice(names))
    for _ in range(60):
        segment = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 60)))
        assert plain.product(segment) == ruled.product(segment)
    for _ in range(300):
        a, b = ("".join(rng.choice("DK") for _ in range(rng.randrange(1, 9))) for _ in "xx")
        rope = lambda x: x if len(x) < 2 else (x[: (k := rng.randrange(1, len(x)))], x[k:]) if rng.random() < 0.5 else ((x[:1], ""), x[1:])
        assert repair.before(rope(a), rope(b)) == (a < b)


def test_pair_counts_are_those_of_replacing():
    rng = random.Random(7)
    for _ in range(200):
        text = "".join(rng.choice("ab\n") for _ in range(rng.randrange(2, 30)))
        codes, n = repair.pair_counts(text)
        assert {chr(c >> 16) + chr(c & 0xFFFF): k for c, k in zip(codes.tolist(), n.tolist())} == {
            p: text.count(p) for p in ("aa", "ab", "ba", "bb") if p in text}
