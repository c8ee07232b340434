import hashlib
import random
from itertools import combinations

from pyspark.sql import functions as F

from postmill.llm import fingerprints
from postmill.llm.queries import op3_fingerprints


def edited(docs):
    """(doc_id, text) to the wanted (doc_id, n_chars, sha256) of unique ids, and the next id."""
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for k, (doc_id, text) in enumerate(order):
        text, (after, follower) = text or "", order[(k + 1) % len(order)]
        half = len(text) // 2
        new = text[: len(text) - half] + (follower or "")[:half]
        out[doc_id] = (len(text), hashlib.sha256(new.encode()).hexdigest(), after)
    return out


def check(rows, docs):
    wanted, text = edited(docs), dict(docs)
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == {k: v[:2] for k, v in wanted.items()}
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    classes = {}
    for r in rows:
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 32
        assert abs(r.near_next - 1 + bits(r.fingerprint, prints[wanted[r.doc_id][2]]) / 128) < 1e-12
        assert abs(r.near_edited - 1 + bits(r.fingerprint, r.edited_fingerprint) / 128) < 1e-12
        classes.setdefault(text[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(c) == 1 for c in classes.values())
    near = dict.fromkeys(prints.values(), 0)
    for a, b in combinations(near, 2):
        if bits(a, b) <= fingerprints.RADIUS:
            near[a] += 1
            near[b] += 1
    assert {r.doc_id: r.n_near for r in rows} == {k: near[v] for k, v in prints.items()}


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op3_fingerprints(spark, sf).collect()
    check(rows, docs)
    long = [r for r in rows if r.n_chars > 1500]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)


def test_edge_texts(spark):
    words = " ".join(f"w{k}" for k in range(300))
    docs = [(1, None), (2, ""), (9, "one"), (5, " two  words "), (7, "\u00e9\U0001f600 x" * 40), (3, words),
            (30, words + " more"), (31, words + " else"), (32, words), (-4, "a " * 30_000), (12, "\x0b\t")]
    schema = "doc_id long, text string, high string, part int"
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], schema)
    check(fingerprints.report(df).withColumnRenamed("id", "doc_id").collect(), docs)
    assert fingerprints.report(df.limit(0)).collect() == []
    alone = fingerprints.report(spark.createDataFrame([(4, "a b c d")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()


def test_repeated_and_null_ids(spark):
    docs = [(3, "x y z"), (3, "x y z"), (3, "other"), (None, "no id"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = fingerprints.report(df).collect()
    assert len(rows) == 5
    assert len({r.fingerprint for r in rows if r.n_chars == 5 and r.id == 3}) == 2


def test_copies_with_one_changed_word_are_near(spark):
    rng, docs = random.Random(8), []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(504)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:250] + ["changed"] + words[251:]))]
    rows = fingerprints.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == 80 and max(r.n_near for r in rows) == 1 and sum(r.n_near for r in rows) >= 64


def test_tables_of_keys_are_not_broadcast(spark):
    n = F.col("id")
    prints = spark.range(2_000).select(F.xxhash64(n).alias("high"), F.xxhash64(n + F.lit(10**6)).alias("low"))
    pairs = fingerprints.near_fingerprints(prints)
    assert pairs.count() == 0
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
