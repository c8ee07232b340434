import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from postmill.llm import packing
from postmill.llm.queries import op6_best_fit_packing, vocabulary

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

ODD = ["", "  a  b ", " x", "x ", "a\n b", "don't  'll\t\tx  ", "<|endoftext|> hi <|endoftext|>",
       "\u65e5\u672c \u8a9e  \u65e5", "a" * 5000, " " * 3000, "\n\n a\r\n b", "1 2 3,4 ' s 's", "x\x1c y \x1fz"]


def check(rows, texts):
    """Every piece holds the ids of its place; sequences are gapless and within the capacity."""
    wanted = Counter()
    for doc_id, text in texts:
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]
        end, begin, piece = len(ids) % 1024 or 1024, 0, 0
        while begin < len(ids):
            crc = zlib.crc32(np.asarray(ids[begin:end], "<u4").tobytes())
            wanted[(doc_id, piece, begin, end - begin, crc)] += 1
            begin, end, piece = end, end + 1024, piece + 1
    assert Counter(tuple(r)[:5] for r in rows) == wanted
    laid = {}
    for r in rows:
        laid.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in laid.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 1024
    return len(laid), -(-sum(r.length for r in rows) // 1024)


def test_edge_texts_round_trip(spark):
    texts = [(k, t) for k, t in enumerate(ODD)] + [(3, "twice"), (3, "twice"), (None, "no id"), (50, None)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in texts], "doc_id long, text string, length string, piece int")
    check(packing.pack(df, *vocabulary()).withColumnRenamed("id", "doc_id").collect(), texts)
    assert packing.pack(df.limit(0), *vocabulary()).collect() == []


def test_query_packs_the_whole_table_tightly(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, least = check(op6_best_fit_packing(spark, sf).collect(), texts)
    assert used <= least * 1.03 + 1


def test_plan_lays_every_length_once():
    rng = random.Random(3)
    for size in (0, 1, 7, 400, 20_000):
        counts = Counter(min(1024, 1 + int(rng.expovariate(1 / 300))) for _ in range(size))
        laid, used = packing.plan(counts), Counter()
        for content, times in laid:
            assert sum(n * k for n, k in content) <= 1024 and times > 0
            for n, k in content:
                used[n] += k * times
        assert +used == +counts
        if size >= 400:
            assert sum(t for _, t in laid) <= 1.02 * sum(n * k for n, k in counts.items()) / 1024 + 1
