import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postmill.models import features as fe
from postmill.models import learning, ridge, surrogate
from postmill.models.index import term_index
from postmill.operators.ranking import with_position
from postmill.session import sparing_disk
from tests.rows import column, posting, postings

WORDS = "data spark join window scan filter query table column shuffle".split()


def example_rows(n, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        body = " ".join(rng.choice(WORDS, 12))
        out.append((f"h{i:03d}", f"role {WORDS[i % 10]}", body, "Acme", None, None, None,
                    int(rng.integers(0, 101)), int(rng.integers(0, 101)), i))
    return out


def examples(spark, n, seed=3):
    return spark.createDataFrame(
        example_rows(n, seed),
        "hash string, title string, description string, company string, location string, team string, "
        "comp string, interest_score int, fit_score int, ord int",
    )


def design(model):
    rows = model.rows.orderBy("ordinal").collect()
    x = np.zeros((len(rows), model.features.size))
    for r, row in enumerate(rows):
        x[r, row.idx] = row.val
    return x, np.array([list(r.ys) for r in rows])


def closed_form(x, y, alpha, weight=None):
    w = np.ones(len(x)) if weight is None else weight
    mx, my = w @ x / w.sum(), w @ y / w.sum()
    xc, yc = x - mx, y - my
    beta = np.linalg.solve((xc * w[:, None]).T @ xc + alpha * np.eye(x.shape[1]), (xc * w[:, None]).T @ yc)
    return beta, my - mx @ beta


@pytest.fixture(scope="module")
def model(spark):
    return surrogate.fit_surrogate(examples(spark, 24), ["ord"], n_models=4, seed=5, meta_k=6, desc_k=9)


def test_weights_by_hand(spark):
    df = spark.createDataFrame([("a", "x x y", "q"), ("b", "y the z", "")], "hash string, meta string, body string")
    fitted = fe.fit_features(df)
    assert fitted.meta_vocabulary == ("x", "y", "x x", "x x y", "x y", "y z", "z")
    terms = fitted.meta_vocabulary + fitted.body_vocabulary
    got = {r.hash: {terms[f.i]: f.w for f in r.features} for r in fitted.transform(df).collect()}
    one, two = math.log(3 / 2) + 1, 1.0
    raw = {"x": (1 + math.log(2)) * one, "y": two, "x x": one, "x x y": one, "x y": one}
    length = math.sqrt(sum(v * v for v in raw.values()))
    for term, value in raw.items():
        assert got["a"][term] == pytest.approx(value / length)
    assert got["a"]["q"] == pytest.approx(1.0)
    assert set(got["b"]) == {"y", "z", "y z"}


def test_vocabulary_is_cut_and_ties_go_by_term(spark):
    df = spark.createDataFrame([("a", "b a c b", "")], "hash string, meta string, body string")
    assert fe.fit_features(df, 2, 5, stop_words=()).meta_vocabulary == ("b", "a")


def test_empty_vocabulary(spark):
    rows = postings(spark, posting("a", title="the", company="of", description=""))
    got = fe.similarity(rows, "spark query").collect()
    assert [r.similarity for r in got] == [0.0]


def test_similarity_prefers_shared_words(spark):
    rows = postings(spark, posting("a", title="spark query", description="x"),
                    posting("b", title="cook", description="y"), posting("c", title="spark", description=""))
    got = fe.seed_by_similarity(rows, "spark query engine", 2)
    assert set(column(got)) == {"a", "c"}


def test_heads_match_explicit_leave_one_out(model):
    x, ys = design(model)
    for head, y in ((model.interest, ys[:, 0]), (model.fit, ys[:, 1])):
        errors = []
        for alpha in ridge.ALPHAS:
            total = 0.0
            for i in range(len(x)):
                keep = np.arange(len(x)) != i
                beta, b = closed_form(x[keep], y[keep], alpha)
                total += (y[i] - x[i] @ beta - b) ** 2
            errors.append(total)
        best = ridge.ALPHAS[int(np.argmin(errors))]
        assert head.alpha == pytest.approx(best)
        beta, b = closed_form(x, y, best)
        assert head.intercept == pytest.approx(b)
        np.testing.assert_allclose(head.weights, beta, atol=1e-8)


def test_fits_do_not_depend_on_the_number_of_tasks(spark, model, monkeypatch):
    size = model.features.size
    drawn = surrogate.bootstrap_weights(model.rows, model.n, 4, 5).join(model.rows, "ordinal")
    found = []
    for rows in (10_000, 5):
        monkeypatch.setattr(ridge, "PART_ROWS", rows)
        found.append((ridge.fit_by_loo(model.rows, model.n, size, 3, 2),
                      ridge.fit_weighted(drawn, model.n, size, 3, [2], 1.0).orderBy("model").toPandas()))
    for a, b in zip(*found):
        np.testing.assert_allclose(a["alpha"], b["alpha"])
        np.testing.assert_allclose(a["intercept"], b["intercept"], atol=1e-9)
        np.testing.assert_allclose(np.stack(a["weights"]), np.stack(b["weights"]), atol=1e-9)


def test_predictions_are_the_clipped_geometric_mean(spark, model):
    p = examples(spark, 24).withColumn("compensation_raw", F.lit(None).cast("string")).withColumn(
        "compensation", F.lit(None).cast("struct<min_amount:bigint,max_amount:bigint,currency:string,interval:string,equity:boolean,bonus:boolean>"))
    got = {r.hash: r.surrogate_score for r in model.predict(p).collect()}
    x, _ = design(model)
    heads = [np.clip(x @ np.array(h.weights) + h.intercept, 0, 1) for h in (model.interest, model.fit)]
    want = np.sqrt(heads[0] * heads[1])
    np.testing.assert_allclose([got[f"h{i:03d}"] for i in range(24)], want, atol=1e-9)
    best = column(model.by_score(p, 3))
    assert best == [f"h{i:03d}" for i in sorted(range(24), key=lambda i: (-want[i], i))[:3]]


def test_ensemble_and_disagreement(spark, model):
    weights = surrogate.bootstrap_weights(model.rows, model.n, 4, 5).toPandas()
    assert weights.groupby("model")["weight"].sum().tolist() == [24.0] * 4
    x, ys = design(model)
    predictions = []
    for m, member in enumerate(model.ensemble):
        w = np.zeros(24)
        mine = weights[weights["model"] == m]
        w[mine["ordinal"].to_numpy()] = mine["weight"].to_numpy()
        beta, b = closed_form(x, ys[:, 2], 1.0, w)
        np.testing.assert_allclose(member.weights, beta, atol=1e-8)
        predictions.append(x @ beta + b)
    want = np.var(predictions, axis=0)
    p = examples(spark, 24).withColumn("compensation_raw", F.lit(None).cast("string")).withColumn(
        "compensation", F.lit(None).cast("struct<min_amount:bigint,max_amount:bigint,currency:string,interval:string,equity:boolean,bonus:boolean>"))
    got = {r.hash: r.variance for r in model.disagreement(p).collect()}
    np.testing.assert_allclose([got[f"h{i:03d}"] for i in range(24)], want, atol=1e-10)


def test_cross_validation(model):
    x, ys = design(model)
    y = ys[:, 2]
    predicted = np.empty(24)
    for fold in np.array_split(np.arange(24), 5):
        keep = np.setdiff1d(np.arange(24), fold)
        beta, b = closed_form(x[keep], y[keep], 1.0)
        predicted[fold] = x[fold] @ beta + b
    row = model.cv_metrics().head()
    assert row.n_examples == 24
    assert row.cv_mae == pytest.approx(round(np.abs(y - predicted).mean(), 4))
    assert row.cv_r2 == pytest.approx(round(1 - ((y - predicted) ** 2).sum() / ((y - y.mean()) ** 2).sum(), 4))


def test_one_example_has_no_metrics(spark):
    row = surrogate.fit_surrogate(examples(spark, 1), ["ord"]).cv_metrics().head()
    assert (row.n_examples, row.cv_r2, row.cv_mae, row.cv_spearman) == (1, 0.0, 0.0, 0.0)


def test_agreement(spark):
    scores = spark.createDataFrame([("a", 10, 10), ("b", 50, 50), ("c", 90, 90), ("d", 1, 1)], "hash string, interest_score int, fit_score int")
    guess = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3)], "hash string, surrogate_score double")
    row = surrogate.agreement(scores, guess).head()
    assert (row.agreement_spearman, row.agreement_n) == (1.0, 3)
    row = surrogate.agreement(scores, guess.filter("hash <> 'c'")).head()
    assert (row.agreement_spearman, row.agreement_n) == (None, 2)
    row = surrogate.agreement(scores, guess.filter("false")).head()
    assert (row.agreement_spearman, row.agreement_n) == (None, 0)
    row = surrogate.agreement(scores, guess.withColumn("surrogate_score", F.lit(1.0))).head()
    assert row.agreement_spearman is None


def loop_rows(spark, n):
    rng = np.random.default_rng(1)
    return postings(spark, *[
        posting(f"h{i:03d}", title=" ".join(rng.choice(WORDS, 2)), description=" ".join(rng.choice(WORDS, 8)), ord=i + 1)
        for i in range(n)
    ])


def score_table(spark, names):
    return spark.createDataFrame([(h, 10 + i % 80, 20 + i % 70) for i, h in enumerate(names)],
                                 "hash string, interest_score int, fit_score int")


def test_cold_loop(spark):
    universe = loop_rows(spark, 30)
    names = [f"h{i:03d}" for i in range(30) if i != 7]
    out = learning.active_learning(
        universe, universe.filter("hash in ('h001', 'h007')"), learning.empty_training(spark),
        learning.label_from_table(score_table(spark, names)), "spark query",
        init_num_exploit=6, num_explore=3, num_exploit=3, init_learning_iters=2, n_models=3, meta_k=20, desc_k=20,
    )
    training = column(out.training)
    assert len(training) == len(set(training)) and "h001" in training and "h007" not in training
    assert out.rounds == 2
    assert out.predictions.count() == 30
    assert set(column(out.scored)) == set(training)
    row = out.metrics.head()
    assert row.n_examples == row.agreement_n == len(training)


def test_warm_loop_stops_when_all_is_scored(spark):
    universe = loop_rows(spark, 12)
    names = [f"h{i:03d}" for i in range(12)]
    before = learning.to_examples(universe, score_table(spark, names)).select(
        "hash", "title", "description", "company", "location", "team", "comp", "interest_score", "fit_score",
        F.lit(0).alias("round"), F.col("ord").alias("place"))
    out = learning.active_learning(universe, universe.filter("false"), before,
                                   learning.label_from_table(score_table(spark, names)), learning_iters=3)
    assert out.rounds == 0 and out.training.count() == 12


def test_positions(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7).repartition(6)
    placed = with_position(df, [F.desc("k"), F.asc("id")]).collect()
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert [r.id for r in sorted(placed, key=lambda r: r.position)] == want
    assert sorted(r.position for r in placed) == list(range(1, 1001))


NO_PAY = "struct<min_amount:bigint,max_amount:bigint,currency:string,interval:string,equity:boolean,bonus:boolean>"


def test_index_scores_as_texts_do(spark, model):
    p = examples(spark, 24).withColumns({
        "compensation_raw": F.lit(None).cast("string"), "compensation": F.lit(None).cast(NO_PAY)})
    odd = p.limit(2).withColumns({"hash": F.concat(F.lit("odd"), "hash"), "title": F.lit(None).cast("string"), "description": F.lit("")})
    p = p.unionByName(odd)
    index = term_index(fe.posting_texts(p))
    for by_text, by_index, name in ((model.predict, model.predict_indexed, "surrogate_score"),
                                    (model.disagreement, model.disagreement_indexed, "variance")):
        want = {r.hash: r[name] for r in by_text(p).collect()}
        got = {r.hash: r[name] for r in by_index(index).collect()}
        assert set(got) == set(want) and len(got) == 26
        np.testing.assert_allclose([got[h] for h in sorted(want)], [want[h] for h in sorted(want)], atol=1e-12)
    assert model.predict_indexed(index.limit(0)).collect() == []


def test_rounds_read_texts_once(spark):
    """The plan of a round's selection reads the index, not a text column."""
    universe = loop_rows(spark, 12)
    index = term_index(fe.posting_texts(universe))
    fitted = surrogate.fit_surrogate(examples(spark, 24), ["ord"], n_models=2, seed=5, meta_k=6, desc_k=9)
    plan = fitted.disagreement_indexed(index)._jdf.queryExecution().executedPlan().toString()
    assert "description" not in plan and "title" not in plan


@pytest.mark.parametrize("tracked", [8, 64, 100_000])
def test_frequent_terms_are_exact_whatever_the_summary_keeps(spark, tracked):
    rng = np.random.default_rng(4)
    words = np.minimum(rng.zipf(1.2, 6000), 900)
    texts = [" ".join(f"w{w}" for w in words[n : n + 30]) for n in range(0, 6000, 30)]
    df = spark.createDataFrame([(t,) for t in texts], "body string").repartition(4)
    counts = {}
    for t in texts:
        w = t.split()
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                g = " ".join(w[i : i + n])
                counts[g] = counts.get(g, 0) + 1
    for k in (1, 3, 40, 10**5):
        want = sorted(counts, key=lambda g: (-counts[g], g))[:k]
        assert fe.top_terms(df, "body", k, (), tracked, 0) == fe.top_terms(df, "body", k, ()) == want
    assert fe.top_terms(df.limit(0), "body", 3, (), tracked, 0) == fe.top_terms(df, "body", 0, (), tracked, 0) == []


def test_a_summary_names_few_candidates(spark):
    texts = ["the same words again"] * 300 + [f"a{n} b{n}" for n in range(500)]
    terms = spark.createDataFrame([(t,) for t in texts], "body string").select(F.explode(F.split("body", " ")).alias("term"))
    assert set(fe._frequent(terms, 4, 300)) == {"the", "same", "words", "again"}
    assert fe._frequent(terms, 200, 300) is None


def test_terms_are_counted_by_frequent_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{min(int(x), 400)}" for x in rng.zipf(1.3, 60)) for _ in range(120)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "body string")
    counts = {}
    for t in filter(None, texts):
        w = t.split()
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                g = " ".join(w[i : i + n])
                counts[g] = counts.get(g, 0) + 1
    want = sorted(counts, key=lambda g: (-counts[g], g))
    tokens = fe._tokens_of(df, "body", ())
    for k in (1, 5, 60):
        assert fe._by_parts(tokens, k) == fe.top_terms(df, "body", k, ()) == want[:k]
    assert any(" " in t for t in want[:60]) and any(t.count(" ") == 2 for t in want[:60])
    assert fe._by_parts(tokens, 10**6) is None
    monkeypatch.setattr(fe, "HELD", 3)
    assert fe._by_parts(tokens, 60) is None and fe.top_terms(df, "body", 60, ()) == want[:60]


def test_dense_rows_come_in_bounded_runs():
    pdf = pd.DataFrame({"idx": [[n % 7] for n in range(2500)], "val": [[float(n)] for n in range(2500)], "ys": [[0.0, 1.0, 2.0]] * 2500})
    parts = [a for _, a in ridge.augmented(pdf, 7)]
    assert max(len(a) for a in parts) <= ridge.DENSE_ROWS < 2500 == sum(map(len, parts))
    assert (np.vstack(parts)[:, :7].sum(axis=1) == np.arange(2500)).all()


def test_counts_of_stored_tokens_are_those_of_the_texts(spark):
    rng = np.random.default_rng(9)
    rows = [(f"h{n}", " ".join(rng.choice(WORDS, n % 5)), " ".join(rng.choice(WORDS, n % 9))) for n in range(60)]
    texts = spark.createDataFrame(rows, "hash string, meta string, body string")
    fitted, counts = fe.fit_with_counts(texts, 9, 40)
    assert any(t.count(" ") == 2 for t in fitted.body_vocabulary)
    assert sorted(fitted.transform(counts).collect()) == sorted(fitted.transform(texts).collect())
    none, counts = fe.fit_with_counts(texts, 0, 5)
    assert sorted(none.transform(counts).collect()) == sorted(none.transform(texts).collect())


def test_a_loop_fits_its_last_model_when_asked_and_writes_examples_once(spark, monkeypatch):
    fits, written = [], []
    monkeypatch.setattr(learning, "fit_surrogate", lambda *a, **k: fits.append(1) or surrogate.fit_surrogate(*a, **k))
    write = learning.materialise

    def materialise(df, name="table"):
        out = write(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(learning, "materialise", materialise)
    universe, scores = loop_rows(spark, 30), spark.createDataFrame([(f"h{i:03d}", i, 50) for i in range(30)], "hash string, interest_score int, fit_score int")
    out = learning.active_learning(
        universe, universe.limit(4), learning.empty_training(spark), learning.label_from_table(scores), "data spark",
        init_num_exploit=6, init_learning_iters=0, n_models=2, meta_k=6, desc_k=9)
    assert out.training.count() == sum(n for name, n in written if name == "training") and not fits
    assert out.predictions.count() == universe.count() and out.metrics.count() == 1 and len(fits) == 1


def test_members_weigh_rows_in_place(spark, model, monkeypatch):
    """No row is copied for a member, and the heads are not fitted where only members are asked."""
    drawn = surrogate.with_draws(model.rows, model.n, 4, 5).select("ordinal", "weights").collect()
    assert len({r.ordinal for r in drawn}) == len(drawn) <= 24
    got = {(m, r.ordinal): w for r in drawn for m, w in enumerate(r.weights) if w}
    assert got == {(r.model, r.ordinal): r.weight for r in surrogate.bootstrap_weights(model.rows, model.n, 4, 5).collect()}
    monkeypatch.setattr(surrogate, "fit_by_loo", lambda *a: pytest.fail("heads were fitted"))
    fresh = surrogate.fit_surrogate(examples(spark, 24), ["ord"], n_models=2, seed=5, meta_k=6, desc_k=9)
    assert len(fresh.ensemble) == 2


def test_a_loop_stores_the_tokens_of_a_row_once(spark, monkeypatch):
    written, write = [], fe.materialise

    def materialise(df, name="table"):
        out = write(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(fe, "materialise", materialise)
    universe, scores = loop_rows(spark, 30), score_table(spark, [f"h{i:03d}" for i in range(30)])
    out = learning.active_learning(
        universe, universe.limit(4), learning.empty_training(spark), learning.label_from_table(scores), "data spark",
        init_num_exploit=6, num_explore=3, num_exploit=3, init_learning_iters=2, n_models=2, meta_k=6, desc_k=9)
    # Those of the universe, of the examples and of the reference.
    assert sum(n for name, n in written if name == "tokens") == 30 + out.training.count() + 1


def test_disk_is_spared_within_only(spark):
    names = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.parquet.compression.codec")
    before = [spark.conf.get(n) for n in names]
    with sparing_disk(spark):
        assert [spark.conf.get(n) for n in names] == ["true", "zstd"]
    assert [spark.conf.get(n) for n in names] == before
