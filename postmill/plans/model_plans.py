"""Queries on text features, similarity, the surrogate and the learning loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.models import features as fe
from postmill.models import learning, surrogate
from postmill.models.learning import to_examples
from postmill.operators.dedup import select_universe
from postmill.functions import match
from postmill.operators.ranking import with_position
from postmill.plans import views as v
from postmill.plans.registry import query
from postmill.plans.report_plans import PRIORITY
from postmill.plans.text_plans import META_SQL, sql_match
from postmill.session import materialise, sparing_disk

STOP_SQL = ", ".join(f"'{w}'" for w in fe.STOP_WORDS)


def tokens_sql(text: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), "
            f"lambda t: t NOT IN ({STOP_SQL}))")


GRAMS = """list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]),
    list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))"""


def fea_sql(rows: str, fitted_on: str = "TRUE", meta_k: int = 700, desc_k: int = 1300) -> str:
    """CTEs up to ``weights`` over rows of (hash, meta, body)."""
    return f""", texts AS ({rows}),
    toks AS (SELECT hash, 0 AS block, {tokens_sql('meta')} AS t FROM texts
             UNION ALL SELECT hash, 1, {tokens_sql('body')} FROM texts),
    grams AS (SELECT hash, block, unnest({GRAMS}) AS term FROM toks),
    fit_texts AS (SELECT * FROM texts WHERE {fitted_on}),
    fit_grams AS (SELECT * FROM grams WHERE hash IN (SELECT hash FROM fit_texts)),
    vocabulary AS (SELECT block, term, n FROM (
        SELECT block, term, count(*) AS n, row_number() OVER (PARTITION BY block ORDER BY count(*) DESC, term) AS rn
        FROM fit_grams GROUP BY block, term) WHERE rn <= CASE block WHEN 0 THEN {meta_k} ELSE {desc_k} END),
    df AS (SELECT block, term, count(DISTINCT hash) AS df FROM fit_grams GROUP BY block, term),
    raw AS (SELECT hash, block, term,
        (1 + ln(count(*))) * (ln((1 + (SELECT count(*) FROM fit_texts)) / (1 + any_value(df))) + 1) AS w
        FROM grams JOIN vocabulary USING (block, term) JOIN df USING (block, term) GROUP BY hash, block, term),
    weights AS (SELECT hash, block, term, w / sqrt(sum(w * w) OVER (PARTITION BY hash, block)) AS w FROM raw)"""


def stored(spark, sf):
    """The posting store as a written table: fitting reads it several times."""
    return materialise(v.store(spark, sf), "store")


STORE_TEXTS = f"SELECT hash, {META_SQL} AS meta, description AS body FROM v_store"


@query("fea1_tokens", f"""
    SELECT ord, len(t) AS n, sha256(array_to_string(t, ' ')) AS digest
    FROM (SELECT ord, {tokens_sql('description')} AS t FROM v_postings)""", ("v_postings",))
def tokens(spark, sf):
    t = fe.with_tokens(v.postings(spark, sf).select("ord", "description"), "description", "t")
    return t.select("ord", F.size("t").cast("bigint").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@query("fea2_ngrams", f"""
    SELECT ord, sha256(array_to_string({GRAMS}, '|')) AS digest
    FROM (SELECT ord, {tokens_sql('description')} AS t FROM v_postings)""", ("v_postings",))
def ngrams(spark, sf):
    terms = fe.with_terms(v.postings(spark, sf).select("ord", "description"), "description", "terms", fe.STOP_WORDS)
    return terms.select("ord", F.sha2(F.array_join("terms", "|"), 256).alias("digest"))


@query("agg8_term_totals", f"""
    SELECT term, count(*) AS n FROM (SELECT unnest(t) AS term
      FROM (SELECT {tokens_sql('description')} AS t FROM v_postings)) GROUP BY term""", ("v_postings",))
def term_totals(spark, sf):
    t = fe.with_tokens(v.postings(spark, sf).select("description"), "description", "t")
    return fe.term_counts(t, "t")


@query("fea3_vocabulary", fea_sql(STORE_TEXTS) + " SELECT block, term FROM vocabulary", ("v_store",))
def vocabulary(spark, sf):
    fitted = fe.fit_features(fe.posting_texts(stored(spark, sf)))
    return spark.createDataFrame(
        [(0, t) for t in fitted.meta_vocabulary] + [(1, t) for t in fitted.body_vocabulary], "block int, term string"
    )


def long_form(spark, fitted: fe.Features, texts):
    terms = spark.createDataFrame(
        [(i, int(i >= len(fitted.meta_vocabulary)), t)
         for i, t in enumerate(fitted.meta_vocabulary + fitted.body_vocabulary)],
        "i int, block int, term string",
    )
    rows = fitted.transform(texts).select("hash", F.inline_outer("features")).filter("i is not null")
    return rows.select("hash", "i", F.round("w", 6).alias("w")).join(terms, "i").drop("i")


@query("fea4_weights", fea_sql(STORE_TEXTS) + " SELECT hash, block, term, round(w, 6) AS w FROM weights", ("v_store",))
def weights(spark, sf):
    fitted, counts = fe.fit_with_counts(fe.posting_texts(stored(spark, sf)))
    return long_form(spark, fitted, counts)


@query("fea5_unseen_rows", fea_sql(
    f"SELECT hash, {META_SQL} AS meta, description AS body, location FROM v_store", "location <> 'en'")
    + " SELECT hash, block, term, round(w, 6) AS w FROM weights", ("v_store",))
def unseen_rows(spark, sf):
    p = stored(spark, sf)
    fitted = fe.fit_features(fe.posting_texts(p.filter("location <> 'en'")))
    return long_form(spark, fitted, fe.posting_texts(p))


SIMILARITY_SQL = fea_sql(STORE_TEXTS + """
    UNION ALL SELECT '' AS hash, (SELECT string_agg(text, ' ' ORDER BY item_id) FROM benchmark) AS meta, '' AS body""") + """
    , likeness AS (
      SELECT s.hash, coalesce(d.dot / nullif(n.len * (SELECT sqrt(sum(w * w)) FROM weights WHERE hash = ''), 0), 0) AS similarity
      FROM v_store s
      LEFT JOIN (SELECT a.hash, sum(a.w * b.w) AS dot FROM weights a JOIN weights b
                   ON b.hash = '' AND a.block = b.block AND a.term = b.term GROUP BY a.hash) d USING (hash)
      LEFT JOIN (SELECT hash, sqrt(sum(w * w)) AS len FROM weights GROUP BY hash) n USING (hash))"""


def reference_text(spark, sf) -> str:
    """All items in order as one text; it is an argument of the operators, like a query."""
    return " ".join(r.text for r in v.table(spark, sf, "benchmark").orderBy("item_id").collect())


@query("sim1_similarity", SIMILARITY_SQL + " SELECT hash, round(similarity, 6) AS similarity FROM likeness", ("v_store",))
def similarity(spark, sf):
    scored = fe.similarity(stored(spark, sf), reference_text(spark, sf))
    return scored.select("hash", F.round("similarity", 6).alias("similarity"))


@query("sim1_seed", SIMILARITY_SQL + """ SELECT hash, round(similarity, 6) AS similarity FROM likeness
    ORDER BY likeness.similarity DESC, hash LIMIT 100""", ("v_store",))
def seed(spark, sf):
    chosen = fe.seed_by_similarity(stored(spark, sf), reference_text(spark, sf), 100)
    return chosen.select("hash", F.round("similarity", 6).alias("similarity"))


# --- surrogate --------------------------------------------------------------


def training(spark, sf, postings=None):
    return to_examples(stored(spark, sf) if postings is None else postings, v.scores(spark, sf))


def trained(spark, sf, **options):
    return surrogate.fit_surrogate(training(spark, sf), ["ord"], seed=7, **options)


@query("mod8_targets", f"""
    SELECT hash, round(interest_score / 100.0, 6) AS interest, round(fit_score / 100.0, 6) AS fit,
      round(sqrt({PRIORITY}), 6) AS combined FROM v_scores""", ("v_scores",))
def targets(spark, sf):
    both = surrogate.combined_target("interest_score", "fit_score")
    return v.scores(spark, sf).select(
        "hash", F.round(F.col("interest_score") / 100, 6).alias("interest"),
        F.round(F.col("fit_score") / 100, 6).alias("fit"), F.round(both, 6).alias("combined"),
    )


@query("agg6_regression_metrics", """
    , pairs AS (SELECT interest_score / 100.0 AS y, fit_score / 100.0 AS p FROM v_scores),
    ranks AS (SELECT y, p, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry,
                     rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM pairs)
    SELECT count(*) AS n_examples, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) AS cv_r2,
      round(avg(abs(y - p)), 4) AS cv_mae, round(corr(ry, rp), 4) AS cv_spearman FROM ranks""", ("v_scores",))
def regression_metrics(spark, sf):
    rows = v.scores(spark, sf).select(
        (F.col("interest_score") / 100).alias("target"), (F.col("fit_score") / 100).alias("prediction")
    )
    return surrogate.regression_metrics(materialise(rows, "pairs"))


@query("mod7_folds", """
    , numbered AS (SELECT hash, row_number() OVER (ORDER BY hash) - 1 AS i, count(*) OVER () AS n FROM v_scores)
    SELECT hash, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
      ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM numbered""", ("v_scores",))
def folds(spark, sf):
    placed = with_position(v.scores(spark, sf), ["hash"], "i", start=0)
    return placed.select("hash", surrogate.fold_of(F.col("i"), placed.count(), 5).alias("fold"))


@query("mod3_draws_per_member", """
    SELECT m AS model, CAST(count(*) AS DOUBLE) AS draws FROM v_scores, (SELECT unnest(range(10)) AS m) GROUP BY m""",
       ("v_scores",))
def draws_per_member(spark, sf):
    placed = with_position(v.scores(spark, sf).select("hash"), ["hash"], "ordinal", start=0)
    draws = surrogate.bootstrap_weights(placed, placed.count(), 10, seed=7)
    return draws.groupBy("model").agg(F.sum("weight").alias("draws"))


@query("mod1_chosen_alpha")
def chosen_alpha(spark, sf):
    model = trained(spark, sf)
    return spark.createDataFrame(
        [("interest", model.interest.alpha, model.interest.intercept), ("fit", model.fit.alpha, model.fit.intercept)],
        "head string, alpha double, intercept double",
    )


@query("mod2_mod6_predictions")
def predictions(spark, sf):
    return trained(spark, sf).predict(stored(spark, sf))


@query("mod3_mod4_agg7_disagreement")
def disagreement(spark, sf):
    p = stored(spark, sf)
    return trained(spark, sf).by_disagreement(p, 10)


@query("mod5_select_by_score")
def select_by_score(spark, sf):
    return trained(spark, sf).by_score(stored(spark, sf), 10)


@query("mod7_cv_metrics")
def cv_metrics(spark, sf):
    return trained(spark, sf).cv_metrics()


# --- the same models over few terms, against elimination in SQL --------------

SMALL = {"meta_k": 3, "desc_k": 5}
MEMBERS = 10


def ridge_sql(models: str) -> str:
    """CTEs up to ``solved`` (model, target, alpha, beta, b0, inverse, mean, n).

    ``models`` selects (model, alpha, target, i, weight): which rows weigh how much in
    which fit. Systems are solved by Gauss-Jordan elimination, one column a round.
    """
    return fea_sql(STORE_TEXTS, "hash IN (SELECT hash FROM v_scores)", SMALL["meta_k"], SMALL["desc_k"]) + f""",
    terms AS (SELECT block, term, row_number() OVER (ORDER BY block, n DESC, term) AS j FROM vocabulary),
    dense AS (SELECT s.hash, list(coalesce(w, 0.0) ORDER BY j) AS x FROM v_store s CROSS JOIN terms
        LEFT JOIN weights ON weights.hash = s.hash AND weights.block = terms.block AND weights.term = terms.term GROUP BY s.hash),
    rows_in AS (SELECT hash, x, [interest_score / 100.0, fit_score / 100.0, sqrt((interest_score / 100.0) * (fit_score / 100.0))] AS ys,
        row_number() OVER (ORDER BY ord) - 1 AS i, count(*) OVER () AS rows_n
        FROM dense JOIN v_store USING (hash) JOIN v_scores USING (hash)),
    fits AS ({models}),
    long AS (SELECT model, alpha, target, weight, ys[target] AS y, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS j, i FROM fits JOIN rows_in USING (i)),
    totals AS (SELECT model, alpha, target, sum(weight) AS n, sum(weight * ys[target]) / sum(weight) AS y_mean FROM fits JOIN rows_in USING (i) GROUP BY ALL),
    means AS (SELECT model, alpha, target, j, sum(weight * v) / sum(weight) AS m, sum(weight * v * y) AS xy FROM long GROUP BY ALL),
    grams2 AS (SELECT a.model, a.alpha, a.target, a.j, b.j AS k, sum(a.weight * a.v * b.v) AS g
        FROM long a JOIN long b ON a.model = b.model AND a.alpha = b.alpha AND a.target = b.target AND a.i = b.i GROUP BY ALL),
    cells AS (SELECT g.model, g.alpha, g.target, g.j, g.k,
            g.g - t.n * a.m * b.m + CASE WHEN g.j = g.k THEN g.alpha ELSE 0 END AS v, CASE WHEN g.j = g.k THEN 1.0 ELSE 0.0 END AS one,
            a.xy - t.n * a.m * t.y_mean AS rhs
        FROM grams2 g JOIN totals t USING (model, alpha, target) JOIN means a USING (model, alpha, target, j)
        JOIN means b ON b.model = g.model AND b.alpha = g.alpha AND b.target = g.target AND b.j = g.k),
    lines AS (SELECT model, alpha, target, j, list(v ORDER BY k) || list(one ORDER BY k) || [any_value(rhs)] AS line FROM cells GROUP BY ALL),
    elimination AS (
        SELECT model, alpha, target, 0 AS s, list(line ORDER BY j) AS m FROM lines GROUP BY model, alpha, target
        UNION ALL
        SELECT model, alpha, target, s + 1, list_transform(m, lambda r, j: CASE WHEN j = s + 1
            THEN list_transform(r, lambda v: v / m[s + 1][s + 1])
            ELSE list_transform(r, lambda v, k: v - r[s + 1] * m[s + 1][k] / m[s + 1][s + 1]) END)
        FROM elimination WHERE s < len(m)),
    solved AS (SELECT e.model, e.alpha, e.target, list_transform(m, lambda r: r[len(r)]) AS beta,
            list_transform(m, lambda r: r[len(m) + 1 : 2 * len(m)]) AS inverse, mean, t.n, t.y_mean,
            t.y_mean - list_dot_product(mean, list_transform(m, lambda r: r[len(r)])) AS b0
        FROM elimination e JOIN totals t USING (model, alpha, target)
        JOIN (SELECT model, alpha, target, list(m ORDER BY j) AS mean FROM means GROUP BY model, alpha, target) USING (model, alpha, target)
        WHERE s = len(m))"""


#: Both heads by leave-one-out over all alphas.
HEADS_SQL = ridge_sql("""SELECT 0 AS model, power(10, -2 + 4 * a / 49.0) AS alpha, target, i, 1.0 AS weight
        FROM rows_in, range(50) r(a), (VALUES (1), (2)) t(target)""") + """,
    errors AS (SELECT target, alpha, sum(power((ys[target] - y_mean - list_dot_product(z, beta))
            / (1 - 1.0 / n - list_dot_product(z, list_transform(inverse, lambda r: list_dot_product(r, z)))), 2)) AS error
        FROM (SELECT s.*, ys, list_transform(x, lambda v, j: v - mean[j]) AS z FROM solved s, rows_in) GROUP BY ALL),
    heads AS (SELECT target, alpha, beta, b0 FROM solved JOIN (
        SELECT target, arg_min(alpha, (error, alpha)) AS alpha FROM errors GROUP BY target) USING (target, alpha)),
    guesses AS (SELECT hash, sqrt(greatest(0, least(1, a.b0 + list_dot_product(x, a.beta))) * greatest(0, least(1, b.b0 + list_dot_product(x, b.beta)))) AS score
        FROM dense, heads a, heads b WHERE a.target = 1 AND b.target = 2)"""


def small(spark, sf):
    """The surrogate over eight terms, its members drawn by a rule that SQL has too."""
    return trained(spark, sf, draw=lambda m, i: i * (2 * m + 3) + 17 * m + i * i * (m + 1), n_models=MEMBERS, **SMALL)


@query("mod1_small_alpha", HEADS_SQL + """
    SELECT CASE target WHEN 1 THEN 'interest' ELSE 'fit' END AS head, round(alpha, 6) AS alpha, round(b0, 6) AS intercept FROM heads""",
       ("v_store", "v_scores"))
def small_alpha(spark, sf):
    model = small(spark, sf)
    heads = [("interest", model.interest), ("fit", model.fit)]
    rows = [(name, round(h.alpha, 6), round(h.intercept, 6)) for name, h in heads]
    return spark.createDataFrame(rows, "head string, alpha double, intercept double")


@query("mod2_mod6_small_predictions", HEADS_SQL + " SELECT hash, round(score, 6) AS surrogate_score FROM guesses", ("v_store", "v_scores"))
def small_predictions(spark, sf):
    scored = small(spark, sf).predict(stored(spark, sf))
    return scored.select("hash", F.round("surrogate_score", 6).alias("surrogate_score"))


@query("mod5_small_by_score", HEADS_SQL + """
    SELECT hash, round(score, 6) AS surrogate_score FROM guesses ORDER BY score DESC, hash LIMIT 10""", ("v_store", "v_scores"))
def small_by_score(spark, sf):
    best = small(spark, sf).by_score(stored(spark, sf), 10)
    return best.select("hash", F.round("surrogate_score", 6).alias("surrogate_score"))


@query("mod3_mod4_agg7_small_disagreement", ridge_sql(f"""SELECT model, 1.0 AS alpha, 3 AS target, drawn AS i, count(*)::DOUBLE AS weight
        FROM (SELECT m AS model, (i * (2 * m + 3) + 17 * m + i * i * (m + 1)) % rows_n AS drawn FROM rows_in, range({MEMBERS}) r(m))
        GROUP BY model, drawn""") + """
    SELECT hash, round(variance, 9) AS variance FROM (
        SELECT hash, var_pop(b0 + list_dot_product(x, beta)) AS variance FROM dense, solved GROUP BY hash)
    ORDER BY variance DESC, hash LIMIT 10""", ("v_store", "v_scores"))
def small_disagreement(spark, sf):
    model = small(spark, sf)
    widest = model.by_disagreement(stored(spark, sf), 10)
    return widest.select("hash", F.round("variance", 9).alias("variance"))


@query("mod7_small_metrics", ridge_sql("""SELECT f AS model, 1.0 AS alpha, 3 AS target, i, 1.0 AS weight
        FROM (SELECT *, CASE WHEN i < (rows_n % 5) * (rows_n // 5 + 1) THEN i // (rows_n // 5 + 1)
            ELSE rows_n % 5 + (i - (rows_n % 5) * (rows_n // 5 + 1)) // (rows_n // 5) END AS fold FROM rows_in), range(5) r(f)
        WHERE f <> fold""") + """,
    held AS (SELECT ys[3] AS y, b0 + list_dot_product(x, beta) AS p FROM (
        SELECT *, CASE WHEN i < (rows_n % 5) * (rows_n // 5 + 1) THEN i // (rows_n // 5 + 1)
            ELSE rows_n % 5 + (i - (rows_n % 5) * (rows_n // 5 + 1)) // (rows_n // 5) END AS fold FROM rows_in) JOIN solved ON model = fold),
    ranks AS (SELECT y, p, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry,
        rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM held)
    SELECT count(*) AS n_examples, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) AS cv_r2,
      round(avg(abs(y - p)), 4) AS cv_mae, round(corr(ry, rp), 4) AS cv_spearman FROM ranks""", ("v_store", "v_scores"))
def small_metrics(spark, sf):
    return small(spark, sf).cv_metrics()


# --- learning loop ----------------------------------------------------------


def all_scores(spark, sf, p):
    """Labels where there are any, else scores that follow from the text."""
    derived = p.select(
        "hash", F.pmod(F.xxhash64("hash"), F.lit(101)).cast("int").alias("i"),
        F.pmod(F.length("description"), F.lit(101)).cast("int").alias("f"),
    )
    return derived.join(v.scores(spark, sf), "hash", "left").select(
        "hash", F.coalesce("interest_score", "i").alias("interest_score"), F.coalesce("fit_score", "f").alias("fit_score")
    )


def loop(spark, sf, warm: bool, **options):
    with sparing_disk(spark):
        return _loop(spark, sf, warm, **options)


def _loop(spark, sf, warm: bool, **options):
    p = stored(spark, sf)
    universe, forced = select_universe(p, match.any_of([match.term("the"), match.term("de")]), match.term("avec"))
    before = learning.empty_training(spark)
    if warm:
        before = training(spark, sf, p).select(
            "hash", "title", "description", "company", "location", "team", "comp", "interest_score", "fit_score",
            F.lit(0).alias("round"), F.col("ord").alias("place"),
        )
    # Looked up in every round.
    label = learning.label_from_table(materialise(all_scores(spark, sf, p), "scores"))
    return learning.active_learning(universe, forced, before, label, reference_text(spark, sf), seed=7, **options)


@query("lop1_lop3_lop4_warm_loop")
def warm_loop(spark, sf):
    return loop(spark, sf, True).metrics


@query("lop2_lop5_cold_loop")
def cold_loop(spark, sf):
    """A cold start with two rounds of learning."""
    out = loop(spark, sf, False, init_learning_iters=2)
    return out.training.groupBy("round").agg(F.count("*").alias("examples"))


# --- single steps of the loop, with SQL --------------------------------------

CHOSEN_SQL = f""", unique_rows AS (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY title, company, team, description ORDER BY ord) AS rn FROM v_store) WHERE rn = 1),
    forced AS (SELECT * FROM unique_rows WHERE {sql_match('avec')}),
    chosen AS (SELECT * FROM unique_rows WHERE {sql_match('the')} OR {sql_match('de')} OR {sql_match('avec')})"""
LABEL_SQL = "CAST(length(description) % 101 AS INTEGER) AS interest_score, CAST(ord % 101 AS INTEGER) AS fit_score"


def by_rule(rows):
    """A label function of the caller's own: scores that follow from the posting."""
    return rows.select(
        "hash", (F.length("description") % 101).cast("int").alias("interest_score"), (F.col("ord") % 101).cast("int").alias("fit_score")
    )


def first_steps(spark, sf, p, before, **options):
    universe, forced = select_universe(
        p, match.any_of([match.term("the"), match.term("de")]), match.term("avec"))
    out = learning.active_learning(
        universe, forced, before, by_rule, reference_text(spark, sf), seed=7, n_models=2,
        init_learning_iters=0, learning_iters=0, **options)
    return out.training.select("hash", "round", "interest_score", "fit_score")


@query("lop1_udx3_forced_step", CHOSEN_SQL + f"""
    SELECT hash, 0 AS round, interest_score, fit_score FROM v_store JOIN v_scores USING (hash)
    UNION ALL SELECT hash, 1, {LABEL_SQL} FROM forced WHERE hash NOT IN (SELECT hash FROM v_scores)""", ("v_store", "v_scores"))
def forced_step(spark, sf):
    """A warm start labels what is forced and has no score."""
    p = stored(spark, sf)
    before = training(spark, sf, p).select(
        "hash", "title", "description", "company", "location", "team", "comp", "interest_score", "fit_score",
        F.lit(0).alias("round"), F.col("ord").alias("place"))
    return first_steps(spark, sf, p, before)


@query("lop2_cold_seed", CHOSEN_SQL + """,
    waiting AS (SELECT * FROM chosen WHERE hash NOT IN (SELECT hash FROM forced))""" + SIMILARITY_SQL.replace(
    "FROM v_store\n", "FROM waiting\n").replace("FROM v_store s", "FROM waiting s") + f""",
    seeds AS (SELECT hash FROM likeness ORDER BY likeness.similarity DESC, hash LIMIT 100)
    SELECT hash, 0 AS round, {LABEL_SQL} FROM forced
    UNION ALL SELECT hash, 1, {LABEL_SQL} FROM waiting JOIN seeds USING (hash)""", ("v_store",))
def cold_seed(spark, sf):
    """A cold start labels what is forced, then what is most like the reference."""
    return first_steps(spark, sf, stored(spark, sf), learning.empty_training(spark))
