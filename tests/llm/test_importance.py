import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from postmill.llm import importance
from postmill.llm.prefix_crc import Words, pieces, shifted
from postmill.llm.queries import op11_importance_resampling


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5, seed=42):
    """Rows (doc_id, n_features, weight, score, rank) by the plain definition, without prefixes."""
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t))

    s, t = counts(x for _, x in docs), counts(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {}
    out = []
    for doc_id, text in docs:
        weight = 0
        for f in features(text):
            b = zlib.crc32(f.encode()) % 10000
            if b not in gain:
                gain[b] = math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000))))
            weight += gain[b]
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(features(text)), weight, score, None, len(words_of(text)) >= 20])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = op11_importance_resampling(spark, sf)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in found.dtypes} == {"bigint"}
    want = brute(docs, target)
    assert Counter(tuple(r) for r in found.collect()) == want
    assert sum(r[4] is not None for r in want.elements()) > 5


ROWS = [
    (1, None), (2, ""), (3, " .,\n"), (None, "null id " * 12), (4, "A b C " * 9), (4, "A b C " * 9), (5, "a b c " * 9),
    (6, "Éé 日本 x1 \x85 ok " * 30), (7, "word " * 90_000 + "z" * 3_000), (8, "one"), (9, "one two"),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(d, t, "w", 7.0, 1) for d, t in ROWS], "doc_id long, text string, weight string, rank double, id int")
    target = spark.createDataFrame([("a b c",), (None,), ("",)], "text string")
    found = importance.scored(docs, target, percent=50).collect()
    assert Counter(tuple(r) for r in found) == brute(ROWS, ["a b c", None, ""], percent=50)
    assert importance.scored(docs.limit(0), target).collect() == []
    assert len(importance.scored(docs, target.limit(0), percent=100).filter("rank IS NOT NULL").collect()) == 6


def test_resampled_keeps_columns_and_copies(spark):
    docs = spark.createDataFrame([(d, t, "w", 7.0, 1) for d, t in ROWS], "doc_id long, text string, weight string, rank double, id int")
    target = spark.createDataFrame([("a b c",)], "text string")
    drawn = importance.resampled(docs, target, percent=50)
    assert drawn.columns == docs.columns
    want = [k[0] for k, n in brute(ROWS, ["a b c"], percent=50).items() for _ in range(n) if k[4] is not None]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in drawn.collect())
    with pytest.raises(Exception):
        importance.scored(docs.drop("text"), target)


def test_cutting_a_long_text_changes_no_feature():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice("abZ9 .\né日") for _ in range(rng.randrange(200)))
        data, found = np.frombuffer(text.encode(), np.uint8), [Counter() for _ in range(3)]
        for piece, led in pieces(data, 13, 2):
            for n, (_, crc) in enumerate(Words(piece, np.array([0, len(piece)])).runs(3, led)):
                found[n].update(crc.tolist())
        w = words_of(text)
        for n in (1, 2, 3):
            assert found[n - 1] == Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) for i in range(len(w) - n + 1))


def test_a_shift_is_as_many_zero_bytes():
    lengths = np.array([0, 1, 255, 256, 70_000], np.int64)
    raw = [zlib.crc32(b"\0" * n, 0x12345678 ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for n in lengths]
    assert shifted(np.full(5, 0x12345678, np.uint32), lengths).tolist() == raw
