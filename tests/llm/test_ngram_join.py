import re

import pytest

from postmill.llm.ngram_join import one_of_each, similar_texts
from postmill.llm.queries import op10_ngram_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, words, percent):
    sets = []
    for _, text in rows:
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
        if 0 < len(found) < words:
            sets.append({tuple(found)})
        else:
            sets.append({tuple(found[i:i + words]) for i in range(len(found) - words + 1)})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    return sorted(
        ((d, len(sets[i]), low.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)),
        key=str,
    )


def ours(df, **options):
    return sorted(((r.id, r.n, r.component) for r in similar_texts(df, **options).collect()), key=str)


def test_edge_rows_equal_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(60))
    chain = [" ".join(f"w{i}" for i in range(k, 60 + k)) for k in (3, 6, 9, 12)]
    rows = [(7, base), (3, base.upper()), (7, base), (None, base + " x"), (9, None), (10, ""), (11, " \t\n"),
            (12, "one two"), (13, "One  Two"), (14, "one"), (15, "one\x0btwo"), (16, "a b c " * 5000),
            (17, "x" * 5000), (None, None), (18, "a b c d")]
    rows += [(20 + k, t) for k, t in enumerate(chain)]
    df = spark.createDataFrame(
        [(d, t, "l", 1) for d, t in rows], "doc_id long, text string, n string, cls int"
    )
    assert ours(df, words=3, percent=80) == brute(rows, 3, 80)
    assert ours(df) == brute(rows, 5, 80)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ours(df) == []


@pytest.mark.parametrize(("large", "block"), [(64, 1024), (5, 20), (2, 7)])
def test_near_copies_in_a_chain_without_a_common_leader(spark, monkeypatch, large, block):
    import random

    from postmill.llm import ngram_join

    monkeypatch.setattr(ngram_join, "LARGE", large)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(10**6)}"
    base = [word() for _ in range(120)]
    rows = []
    for k in range(90):
        copy = list(base)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(len(copy))] = word()
        rows.append((k, " ".join(copy)))
    passage = [word() for _ in range(30)]
    rows += [(200 + k, " ".join(passage + [word() for _ in range(60)])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 90) if large == 5 else (90,):
        assert ours(df, words=3, percent=percent) == brute(rows, 3, percent)


def test_query_equals_brute_force_on_the_small_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in op10_ngram_jaccard_join(spark, sf).collect())
    assert got == sorted(brute(rows, 3, 90))


@pytest.mark.parametrize("run", [64, 1000])
def test_texts_longer_than_a_run_hash_alike(monkeypatch, run):
    import numpy as np

    from postmill.llm import buffers

    text = ("alpha beta  gamma\n" * 300 + "y" * 500 + " end").encode()
    data, starts = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = buffers.WordHasher().words(data, starts)
    monkeypatch.setattr(buffers, "RUN", run)
    cut = buffers.WordHasher().words(data, starts)
    assert (whole[1] == cut[1]).all() and len(whole[1]) == len(WORD.findall(text.decode()))


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, "a"), (4, text + " more", "b"), (4, text + " more", "c"), (8, "else", "d"), (8, None, "e"),
            (9, "", "f"), (None, text, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    kept = one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(4, text + " more"), (8, "else"), (8, None), (9, "")], key=str)
