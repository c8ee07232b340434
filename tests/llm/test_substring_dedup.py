import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from postmill.llm import substring_dedup as dedup
from postmill.llm.fm_index import FMIndex, WaveletMatrix
from postmill.llm.queries import op13_substring_dedup


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(texts, window=35):
    """For each text its words and those that stay, by counting whole windows."""
    lists = [words_of(t) for t in texts]
    met = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = {j for i in range(len(w) - window + 1) if met[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((w, [x for j, x in enumerate(w) if j not in gone]))
    return out


def wanted(docs):
    return Counter(
        (d, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest())
        for (d, _), (w, k) in zip(docs, brute([t for _, t in docs]))
    )


def found(df):
    return Counter(tuple(r) for r in df.select(df.columns[0], "n_words", "n_removed", "kept_sha256").collect())


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = wanted(docs)
    assert found(op13_substring_dedup(spark, sf)) == want
    assert sum(r[2] > 0 for r in want) > 5


def odd_docs(rng, n=60):
    shared = [[f"s{k}_{rng.randrange(9)}" for _ in range(rng.choice([20, 34, 35, 36, 60, 120]))] for k in range(8)]
    docs = [(1, None), (2, ""), (3, " \t\n"), (None, "w " * 34), (5, "w " * 36), (6, "x " * 35), (7, " ".join(map(str, range(90)))),
            (7, " ".join(map(str, range(90)))), (None, " ".join(map(str, range(40, 200)))), (8, "A b C\x1c　 " * 40)]
    for d in range(9, n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            own = rng.choice(shared)
            if rng.random() < 0.3:
                own = own[: rng.randrange(len(own))] + ["edit"] + own[rng.randrange(len(own)) :]
            parts += own if rng.random() < 0.7 else [f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(50))]
        docs.append((d, rng.choice([" ", "\n", "  \t"]).join(parts)))
    docs.append((99, "long " * 60_000 + "tail"))
    return docs


@pytest.mark.parametrize("hot", [4096, 1])
def test_odd_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(dedup, "HOT", hot)
    monkeypatch.setattr(dedup, "SHARD", 2000)
    docs = odd_docs(random.Random(6))
    df = spark.createDataFrame([(t, d, 5, "h", "r") for d, t in docs], "text string, doc_id long, n_chars long, hash string, runs string")
    assert found(dedup.report(df)) == wanted(docs)
    if hot == 1:
        return
    rows = dedup.without_repeats(df)
    assert rows.columns == df.columns
    want = Counter((d, t if len(w) == len(k) else " ".join(k)) for (d, t), (w, k) in zip(docs, brute([t for _, t in docs])))
    got = rows.collect()
    assert Counter((r.doc_id, r.text) for r in got) == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and (r.hash, r.runs) == ("h", "r") for r in got)
    assert dedup.report(df.limit(0)).collect() == [] and dedup.without_repeats(df.limit(0)).collect() == []


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, 4000).astype(np.uint64)
    begin, end, anchor, digest = dedup.passages(np.zeros(len(words), np.int64), words)
    by_window, content = {}, {}
    for b, e, a, d in zip(begin, end, anchor, digest):
        assert content.setdefault((a, d), tuple(words[b:e])) == tuple(words[b:e])
        for i in range(b, e - dedup.WINDOW + 1):
            assert by_window.setdefault(tuple(words[i : i + dedup.WINDOW]), a) == a
    assert sorted(i for b, e in zip(begin, end) for i in range(b, e - dedup.WINDOW + 1)) == list(range(4000 - dedup.WINDOW + 1))


def test_index_against_counting():
    rng = random.Random(1)
    for _ in range(150):
        lists = [[rng.randrange(rng.choice([2, 4, 30])) for _ in range(rng.randrange(25))] for _ in range(rng.randrange(1, 8))]
        lists += lists[:1] if rng.random() < 0.5 else []
        words, bounds = np.array([x for w in lists for x in w], np.uint64), np.r_[0, np.cumsum([len(w) for w in lists])]
        length = rng.randrange(1, 8)
        met = Counter(tuple(w[i : i + length]) for w in lists for i in range(len(w) - length + 1))
        want = {(k, j) for k, w in enumerate(lists) for i in range(len(w) - length + 1)
                if met[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        runs = zip(*FMIndex(words, bounds).repeats(words, bounds, length))
        assert {(int(t), j) for t, lo, hi in runs for j in range(lo, hi)} == want


def test_words_that_no_sequence_has():
    index = FMIndex(np.array([1, 2, 3, 1, 2, 3], np.uint64), np.array([0, 3, 6]))
    text, lo, hi = index.repeats(np.array([9, 1, 2, 3, 9, 2, 3], np.uint64), np.array([0, 7]), 2)
    assert sorted(zip(text.tolist(), lo.tolist(), hi.tolist())) == [(0, 1, 4), (0, 5, 7)]


def test_ranks():
    rng = np.random.default_rng(2)
    for size, kinds in ((1, 1), (200, 3), (3000, 90)):
        sequence = np.minimum(rng.zipf(1.4, size), kinds) - 1
        wavelet = WaveletMatrix(sequence, kinds)
        for symbol in range(kinds):
            ends = np.array([0, size // 3, size])
            want = [np.count_nonzero(sequence[:e] == symbol) for e in ends]
            assert wavelet.rank(np.full(3, symbol), ends).tolist() == want
