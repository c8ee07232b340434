import re
from collections import Counter, defaultdict

import pytest

from postmill.llm import mixing
from postmill.llm.queries import op4_source_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Share by weight, stop at the limit, share the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    order += [None] if None in sizes else []
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(rows, docs, near):
    """rows: (doc_id, size, source_size, target, taken), docs: (doc_id, text, source)."""
    words, sizes = {}, Counter()
    for doc_id, text, source in docs:
        words.setdefault((doc_id, len(WORD.findall(text or ""))), []).append(source)
        sizes[source] += len(WORD.findall(text or ""))
    target = brute_targets(dict(sizes))
    taken = defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        source = next(s for s in words[(r.doc_id, r.size)] if sizes[s] == r.source_size and r.target == pytest.approx(target[s]))
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
    for source, size in sizes.items():
        largest = max(len(WORD.findall(t or "")) for _, t, s in docs if s == source)
        assert abs(taken[source] - target[source]) <= max(near * target[source], largest / 2)


def test_query_meets_the_targets_and_reruns_agree(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op4_source_mixing(spark, sf).collect()
    check(rows, docs, 0.02)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, op4_source_mixing(spark, sf).collect()))


def test_edge_rows(spark):
    docs = [(k, "w " * (1 + k % 17), f"s{k % 4}") for k in range(300)]
    docs += [(1, None, "s1"), (2, "", None), (3, "a\u00a0b \x1c c", None), (3, "a\u00a0b \x1c c", None),
             (None, "no id", "s2"), (400, None, "empty"), (401, "one", "\u00fc"), (402, "x " * 4000, "s0")]
    df = spark.createDataFrame([(d, t, s, 9, "c") for d, t, s in docs],
                               "doc_id long, text string, source string, size int, copies string")
    found = mixing.mix(df)
    rows = found.selectExpr("id AS doc_id", "size", "source_size", "target", "size * copies AS taken").collect()
    check(rows, docs, 0.02)
    repeated = mixing.mixed(df)
    assert repeated.columns == df.columns
    assert repeated.count() == found.agg({"copies": "sum"}).first()[0]
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.mixed(df.limit(0)).collect() == []
