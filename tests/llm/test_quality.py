import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import quality
from postmill.llm.queries import op9_quality

SF = "/root/testdata/sf0.01"


def auc(good, bad):
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_held_out_ranking(spark):
    found = op9_quality(spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and len(held) > 40
    assert auc([s for s, y in held if y == 1], [s for s, y in held if y == 0]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(5)
    sizes = [1, 2, 5, 3, 1]
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    unary, tie = rng.normal(size=sum(sizes)), rng.normal(size=(2, 2))
    share, pairs, log_z = quality.marginals(unary, tie, first)
    expected = np.zeros((2, 2))
    for k, (lo, n) in enumerate(zip(first, sizes)):
        ways = list(itertools.product((0, 1), repeat=n))
        weights = np.exp([
            sum(unary[lo + t] * y for t, y in enumerate(w)) + sum(tie[a, b] for a, b in zip(w, w[1:])) for w in ways])
        assert log_z[k] == pytest.approx(np.log(weights.sum()))
        for t in range(n):
            assert share[lo + t] == pytest.approx(sum(v for v, w in zip(weights, ways) if w[t]) / weights.sum())
        for v, w in zip(weights, ways):
            for a, b in zip(w, w[1:]):
                expected[a, b] += v / weights.sum()
    assert np.allclose(pairs, expected)


def trained(spark, rows):
    return quality.train(spark.createDataFrame(rows, "text string, quality int, doc_id long"))


def test_defined_cases(spark, monkeypatch):
    good, bad = "The people went home. It was late.\nThey slept.", "BUY!!! $$$ >>> 99\n||| CLICK"
    rows = [(good + f" {k}.", 1, k) for k in range(30)] + [(bad + f" {k}", 0, k) for k in range(30)]
    rows += [(None, 1, 90), ("", 0, 91), ("no label", None, 92), ("other label", 7, 93)]
    model = trained(spark, rows)
    texts = [None, "", good, good, bad, "\n" * 5000, "x" * 200_000, "word. " * 50_000]
    df = spark.createDataFrame([(t, "s", 1) for t in texts], "text string, score string, label int")
    found = quality.with_quality(df, model)
    assert found.columns == ["text", "score", "label", "quality_score"]
    scores = {r.text: r.quality_score for r in found.collect()}
    assert found.count() == len(texts) and all(0 <= s <= 1 for s in scores.values())
    assert scores[None] == scores[""] and scores[good] > scores[bad]
    assert quality.with_quality(df.limit(0), model).collect() == []
    assert trained(spark, [("t", None, 1)]) is None
    assert {r.quality_score for r in quality.with_quality(df, None).collect()} == {0.5}
    # Lines are bounded in all: the shortest texts are learned from.
    monkeypatch.setattr(quality, "SAMPLE_LINES", 100)
    assert trained(spark, rows + [("line\n" * 5000, 1, 100)]) is not None
    assert trained(spark, [("line\n" * 500, 1, 100), ("line\n" * 500, 0, 101)]) is None


def test_the_fit_learns_from_either_label_alone(spark):
    one = trained(spark, [(f"Fine text {k}.", 1, k) for k in range(10)])
    assert quality.with_quality(spark.range(1).select(F.lit("Fine text 3.").alias("text")), one).first()[1] > 0.5
