import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import language
from postmill.llm.queries import op1_language_id
from postmill.llm.samples import by_label

STRANGE = [
    "A magyar nyelv az uráli nyelvcsalád tagja, a finnugor nyelvek közé tartozó ugor nyelvek egyike, és sokan beszélik.",
    "Az időjárás holnap is napos lesz, de délután már felhők érkeznek a hegyek felől, este pedig eshet az eső.",
    "Русский язык — один из восточнославянских языков, национальный язык русского народа и многих других людей.",
    "Завтра будет солнечная погода, но после обеда с гор придут облака, а вечером может пойти дождь.",
    "日本語は、主に日本国内や日本人同士の間で使用されている言語です。明日は晴れるでしょう。",
    "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。",
    "zxqv kjwq pfgh wvbx qqzt mnbv xzkj plwq vbnm qwzx jkhg fdsz",
    "hjkl hjkl sdfg vbnq wrtp zxcb qwrt pdfg hjkz xcvb nmqw rtyp",
    "SELECT k.zq, COUNT(*) FROM tblx k JOIN tbly q ON k.xz = q.xz WHERE q.vb > 17 GROUP BY k.zq HAVING COUNT(*) > 3;",
]


def guessed(spark, model, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    found = language.with_language(df, model).orderBy("k").collect()
    return [(r.language.lang, r.language.score, r.language.rejected) for r in found]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.train(docs)


def test_held_out_rows_are_right_and_kept(spark, docs):
    found = op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out and r.lang is not None]
    assert len(found) == 1000 and len(held) > 200
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    assert sum(r.rejected for r in held) <= 0.01 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found} <= {r.lang for r in found}


def test_texts_in_no_learned_language_are_rejected(spark, docs, model):
    assert sum(r[2] for r in guessed(spark, model, STRANGE)) >= 0.8 * len(STRANGE)
    rng = random.Random(3)
    shuffled = []
    for r in docs.filter("n_chars > 200").limit(60).collect():
        letters = [c for c in r.text if c.isalpha()]
        rng.shuffle(letters)
        shuffled.append("".join(letters.pop() if c.isalpha() else c for c in r.text))
    assert sum(r[2] for r in guessed(spark, model, shuffled)) >= 0.8 * len(shuffled)


def test_a_language_left_out_is_mostly_rejected(spark, docs):
    shares = []
    for left_out in ("en", "fr"):
        own = language.train(docs.filter(F.col("lang") != left_out))
        met = docs.filter(F.col("lang") == left_out).filter("n_chars > 100").limit(150)
        found = language.with_language(met, own).select("language.rejected").collect()
        shares.append(sum(r[0] for r in found) / len(found))
    assert min(shares) >= 0.8


def test_defined_cases(spark, model):
    texts = [None, "", " 12 .,", "the of and", "the of and", "日"]
    found = guessed(spark, model, texts)
    assert found[:3] == [("und", 0.0, True)] * 3
    assert found[3] == found[4] and found[5][0] in model.languages
    odd = spark.createDataFrame([("the of", 1, 2, 3)], "text string, __guess int, __lettered int, lang int")
    row = language.with_language(odd, model).first()
    assert (row["__guess"], row["__lettered"], row["lang"]) == (1, 2, 3)
    assert language.with_language(odd.limit(0), model).collect() == []
    nothing = spark.createDataFrame([("the of", None, 1), (None, "en", 2), ("12", "en", 3)], "text string, lang string, doc_id long")
    assert language.train(nothing) is None
    assert guessed(spark, None, ["the"]) == [("und", 0.0, True)]
    assert language.accepted(nothing).collect() == []
    single = spark.createDataFrame([("the of and with", "en", 1)], "text string, lang string, doc_id long")
    assert [r.text for r in language.accepted(single).collect()] == ["the of and with"]


def test_cutting_a_long_text_changes_nothing(spark, model, monkeypatch):
    text = "de la unión española y el agua " * 400
    whole, counted = guessed(spark, model, [text]), language._totals(np.frombuffer(text.encode(), np.uint8))
    monkeypatch.setattr(language, "CHUNK", 37)
    monkeypatch.setattr("postmill.llm.buffers.RUN", 37)
    assert np.array_equal(language._totals(np.frombuffer(text.encode(), np.uint8)), counted)
    cut = guessed(spark, model, [text])
    assert cut[0][0] == whole[0][0] and cut[0][1] == pytest.approx(whole[0][1], abs=1e-6)


def test_the_sample_is_bounded_whatever_the_ids_are(spark):
    rows = spark.range(20_000).select(
        F.lit(10).cast("long").alias("id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 100 == 0, "rare").otherwise("often").alias("label"),
    )
    drawn = {r.label: r["count"] for r in by_label(rows, "label", F.xxhash64("id", "text"), 600).groupBy("label").count().collect()}
    assert drawn["often"] == 300 and drawn.get("rare", 0) <= 300
    none = by_label(rows.limit(0), "label", F.xxhash64("id", "text"), 10)
    assert none.count() == 0
