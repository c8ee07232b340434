from collections import Counter

import corpus_pipeline
from corpus_pipeline import STAGES
from tests.llm.test_line_dedup import brute as deduplicated
from tests.llm.test_ngram_join import brute as components
from tests.llm.test_packing import check


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_every_stage_against_brute_force_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = STAGES[0][1](spark, docs, sf)
    assert kept.columns == columns and kept.count() >= 0.99 * docs.count()

    cut = STAGES[1][1](spark, kept, sf)
    assert cut.columns == columns
    wanted = {d: v[0] for (d, _), v in deduplicated(rows(kept)).items()}
    assert dict(rows(cut)) == wanted
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    single = STAGES[2][1](spark, cut, sf)
    found = components(rows(cut), 5, 80)
    assert single.columns == columns
    assert sorted(d for d, _ in rows(single)) == sorted(d for d, n, c in found if not n or d == c)

    mixed = STAGES[3][1](spark, single, sf)
    assert mixed.columns == columns
    times = Counter(d for d, _ in rows(mixed))
    assert set(times) <= {d for d, _ in rows(single)} and max(times.values()) <= 2

    check(STAGES[4][1](spark, mixed, sf).collect(), rows(mixed))


def test_run_and_an_empty_table(spark, sf, tmp_path):
    assert corpus_pipeline.run(spark, sf).count() > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
