import random

import xxhash

from postmill.llm import line_dedup
from postmill.llm.queries import op2_line_dedup


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def text_hash(text):
    return 42 if text is None else signed(xxhash.xxh64(text.encode(), seed=42).intdigest())


def long_hash(x, seed):
    return signed(xxhash.xxh64((x % (1 << 64)).to_bytes(8, "little"), seed=seed % (1 << 64)).intdigest())


def chunks(text):
    lines, out, before = text.split("\n"), [[]], 0
    for k, line in enumerate(lines):
        out[-1].append(line)
        own = text_hash(line)
        window = long_hash(own, long_hash(before, 42))
        following = k + 1 == len(lines) or len(lines[k + 1]) >= line_dedup.LONG
        if len(line) >= line_dedup.LONG or window % line_dedup.EVERY == 0 or following:
            out.append([])
        before = own
    return ["\n".join(c) for c in out if c]


def brute(docs):
    first, out = {}, {}
    for doc_id, text in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, text_hash(d[1]))):
        if text is None:
            out[(doc_id, text)] = None, 0
            continue
        kept, gone = [], 0
        for at, chunk in enumerate(chunks(text)):
            if len(chunk) >= line_dedup.LEAST and first.setdefault(chunk, (doc_id, text, at)) != (doc_id, text, at):
                gone += 1
            else:
                kept.append(chunk)
        out[(doc_id, text)] = "\n".join(kept), gone
    return out


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    wanted = {d: v for (d, _), v in brute(docs).items()}
    rows = op2_line_dedup(spark, sf).collect()
    assert {r.doc_id: (r.text, r.chunks_removed) for r in rows} == wanted
    assert sum(r.chunks_removed for r in rows) > 0 and len(rows) == len(docs)


def test_edge_texts_and_shifted_passages(spark):
    rng = random.Random(1)
    line = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    passage = [line(12) for _ in range(30)]
    long = line(60)
    docs = [(k, "\n".join([line(5) for _ in range(k)] + passage + [line(4)] + [long] + [line(3)])) for k in range(1, 6)]
    docs += [(20, None), (21, ""), (22, "\n\n"), (23, "a\x01b\x01a\n" + long + "\x01"), (24, "a\x01b\x01a\n" + long + "\x01"),
             (None, long), (25, long + "\n" + long), (26, "x" * 10_000 + "\n"), (7, "same\n" + long), (7, "same\n" + long)]
    df = spark.createDataFrame([(d, t, 1, "h") for d, t in docs], "doc_id long, text string, n_chars long, hash string")
    wanted = brute(docs)
    found = line_dedup.deduplicated(df)
    assert sorted(((r.doc_id, r.text, r["__text"], r["__removed"]) for r in found.collect()), key=str) == sorted(
        ((d, t, *wanted[(d, t)]) for d, t in docs), key=str)
    for k in range(2, 6):  # most of the shifted passage goes, the long line always
        text = wanted[next(d for d in docs if d[0] == k)][0]
        assert long not in text and sum(p in text for p in passage) <= 15
    cut = line_dedup.without_repeats(df)
    assert cut.columns == df.columns and cut.count() == len(docs)
    assert line_dedup.without_repeats(df.limit(0)).collect() == []
