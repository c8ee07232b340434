"""TF-IDF features of postings: two text blocks, 1- to 3-grams, bounded vocabulary.

Fitting counts words, then pairs and triples of frequent parts, and keeps the top terms only, at
most 2,000 by default, so the vocabulary is a bounded driver object. Transforming
is a pure per-row projection: no shuffle, whatever the table size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.pay import format_pay
from postmill.functions.text import clip, let, meta_text, or_blank
from postmill.operators.ranking import top_n
from postmill.session import materialise

META_FEATURES = 700
DESC_FEATURES = 1300
#: Terms that a summary of frequent ones keeps; its error is at most so many times the
#: number of terms, divided by its slots (a known bound of such summaries).
TRACKED = 200_000
SUMMARY_ERROR = 3.5
#: Bytes of texts from which a summary and a recount move less than one count of all terms.
SUMMARY_BYTES = 1 << 30

#: Terms of one length that are held at once to tell which longer ones to count.
HELD = 200_000
#: Rows whose words are looked up at once.
ROWS = 1_000

#: Columns of stored tokens, and of the term counts made of them.
TOKENS = ("_meta_tokens", "_body_tokens")
COUNTS = ("_meta", "_body")

# Token pattern and default stop words. Pass another list to
# ``fit_features`` to use it instead.
TOKEN = r"[\p{L}\p{N}_]+"
ASCII_TOKEN = "[a-z0-9_]+"
STOP_WORDS = tuple(
    """a about above after again against all am an and any are as at be because
    been before being below between both but by can did do does doing don down
    during each few for from further had has have having he her here hers herself
    him himself his how i if in into is it its itself just me more most my myself
    no nor not now of off on once only or other our ours ourselves out over own s
    same she should so some such t than that the their theirs them themselves then
    there these they this those through to too under until up very was we were
    what when where which while who whom why will with you your yours yourself
    yourselves""".split()
)


def posting_texts(postings: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(hash, meta, body) of postings. The body is whole unless clipped."""
    pay = format_pay("compensation", "compensation_raw")
    return postings.select(
        "hash", meta_text("title", "company", "location", "team", pay).alias("meta"),
        clip(or_blank("description"), max_chars).alias("body"),
    )


def example_texts(
    examples: DataFrame, max_chars: int | None = None, keep: Sequence[str] = ("hash",)
) -> DataFrame:
    """Kept columns plus (meta, body) of training examples."""
    return examples.select(
        *keep, meta_text("title", "company", "location", "team", "comp").alias("meta"),
        clip(or_blank("description"), max_chars).alias("body"),
    )


def _listed(words: Sequence[str]) -> str:
    """Words as an SQL list; one parsed text instead of one call per word."""
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def with_tokens(df: DataFrame, text: str, name: str, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Adds lower-case word tokens in order, stop words removed."""
    folded = F.lower(text)
    found = F.when(
        F.octet_length(text) == F.char_length(text),
        F.regexp_extract_all(folded, F.lit(ASCII_TOKEN), F.lit(0)),
    ).otherwise(F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0)))
    out = df.withColumn(name, found)
    if not stop_words:
        return out
    return out.withColumn(name, F.expr(f"filter({name}, t -> t not in ({_listed(stop_words)}))"))


def with_terms(df: DataFrame, text: str, name: str, stop_words: Sequence[str]) -> DataFrame:
    """Adds the array of 1-, 2- and 3-grams of a text column, or of its stored tokens."""
    stored = f"_{text}_tokens"
    out = df.withColumn("_t1", F.col(stored)) if stored in df.columns else with_tokens(df, text, "_t1", stop_words)
    for n in (2, 3):
        out = NGram(n=n, inputCol="_t1", outputCol=f"_t{n}").transform(out)
    return out.withColumn(name, F.concat("_t1", "_t2", "_t3")).drop("_t1", "_t2", "_t3")


def term_counts(df: DataFrame, terms: str) -> DataFrame:
    """Corpus count of every term.

    The outer form keeps Spark from testing each array for emptiness below the
    projection, which would form all terms a second time.
    """
    found = df.select(F.explode_outer(terms).alias("term")).filter("term is not null")
    return found.groupBy("term").agg(F.count("*").alias("n"))


def _frequent(terms: DataFrame, k: int, tracked: int) -> list[str] | None:
    """Terms among which the k most frequent are for certain; None if the summary cannot tell.

    Each task keeps a summary of ``tracked`` terms; merged, it gives no term less than its
    count and none more than its count plus ``error``, and a term it lost has at most
    ``error``. What can reach the k-th of the lower bounds is kept.
    """
    asked = min(4 * k, tracked)
    row = terms.agg(
        F.expr(f"approx_top_k(term, {asked}, {tracked})").alias("top"), F.count("*").alias("n")
    ).first()
    found = sorted(row.top or [], key=lambda t: -t["count"])
    slots = 1 << math.ceil(math.log2(math.ceil(tracked / 0.75)))
    error = SUMMARY_ERROR * row.n / slots
    if error < 1 and len(found) < asked:
        return [t.item for t in found]
    if len(found) < k:
        return None
    floor = found[k - 1]["count"] - error
    # What was not asked for has at most the last count; what was lost at most the error.
    if floor <= error or (len(found) == asked and found[-1]["count"] >= floor):
        return None
    return [t.item for t in found if t["count"] >= floor]


def _bytes_of(df: DataFrame) -> int:
    """Bytes that Spark expects a table to have, from its files; nothing is read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def top_terms(
    df: DataFrame, text: str, k: int, stop_words: Sequence[str], tracked: int = TRACKED, summary_bytes: int = SUMMARY_BYTES,
) -> list[str]:
    """The k most frequent 1- to 3-grams of a text column, ties by term.

    No term is more frequent than the words and pairs it is made of. So words are counted
    first, then the pairs and last the triples whose parts are frequent enough to be among
    the k. Where that tells too little apart, a bounded summary names candidates that hold
    all of them, which are then counted exactly. If the summary's error is too large for its
    counts to tell, or the texts have less than ``summary_bytes``, all terms are counted, in
    one pass. The result is the same.
    """
    if k <= 0:
        return []
    tokens = _tokens_of(df, text, stop_words)
    found = _by_parts(tokens, k)
    if found is not None:
        return found
    terms = with_terms(df, text, "_terms", stop_words).select(F.explode_outer("_terms").alias("term")).filter("term is not null")
    candidates = _frequent(terms, k, tracked) if _bytes_of(df) >= summary_bytes else None
    if candidates is not None:
        listed = df.sparkSession.createDataFrame([(t,) for t in candidates], "term string")
        terms = terms.join(F.broadcast(listed), "term", "left_semi")
    counted = terms.groupBy("term").agg(F.count("*").alias("n"))
    return [r.term for r in counted.orderBy(F.desc("n"), F.asc("term")).limit(k).collect()]


def _tokens_of(df: DataFrame, text: str, stop_words: Sequence[str]) -> DataFrame:
    """(t): the tokens of a text column, or its stored ones."""
    stored = f"_{text}_tokens"
    if stored in df.columns:
        return df.select(F.col(stored).alias("t"))
    return with_tokens(df.select(text), text, "t", stop_words).select("t")


def _by_parts(tokens: DataFrame, k: int) -> list[str] | None:
    """The k most frequent terms, each length counted over terms with frequent parts.

    None if there are fewer than k words, or more than ``HELD`` terms of a length that
    could be among the k.
    """
    # Of every length, what is met as often as the k-th term of the shorter ones.
    counted = materialise(term_counts(tokens, "t").withColumnRenamed("term", "code"), "words")
    words = _most(counted, 0, k)
    if len(words) < k:
        return None
    floor = words[-1]["n"]
    words = _most(counted, floor)
    if words is None:
        return None
    known = [r.code for r in words]
    counts = [(r.n, r.code) for r in words]
    pairs = _most(_part_counts(tokens, known), floor)
    if pairs is None:
        return None
    width = len(known)
    pair_terms = {r.code: f"{known[r.code // width]} {known[r.code % width]}" for r in pairs}
    counts += [(r.n, pair_terms[r.code]) for r in pairs]
    floor = sorted((n for n, _ in counts), reverse=True)[k - 1]
    kept = np.array(sorted(r.code for r in pairs if r.n >= floor), np.int64)
    if len(kept):
        triples = _most(_part_counts(tokens, known, kept), floor)
        if triples is None:
            return None
        counts += [
            (r.n, f"{pair_terms[int(kept[r.code // width])]} {known[r.code % width]}") for r in triples]
    return [t for _, t in sorted(counts, key=lambda c: (-c[0], c[1]))[:k]]


def _most(counted: DataFrame, floor: int, k: int | None = None) -> list | None:
    """The k first rows of (code, n), most frequent first; without k all from ``floor`` on, None for too many."""
    best = counted.filter(F.col("n") >= floor).orderBy(F.desc("n")).limit(HELD + 1 if k is None else k).collect()
    return None if k is None and len(best) > HELD else best


def _part_counts(tokens: DataFrame, words: Sequence[str], pairs: np.ndarray | None = None) -> DataFrame:
    """(code, n) of the pairs of known words, or of the triples of known pairs.

    A pair's code is its first word's number times the number of words plus its second's;
    a triple's is made of its first pair's number and its last word's.
    """
    width = len(words)
    # The lists travel once to each executor, not with each task.
    shared = tokens.sparkSession.sparkContext.broadcast((list(words), pairs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, kept = shared.value
        known = pa.array(listed, pa.string())
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                column = batch.column(0).slice(start, ROWS)
                sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(sizes)), sizes)
                at = pc.index_in(column.flatten().cast(pa.string()), value_set=known)
                ids = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                near = (row[1:] == row[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0)
                code = np.where(near, ids[:-1] * width + ids[1:], -1)
                if kept is not None:
                    number = np.minimum(np.searchsorted(kept, code), len(kept) - 1)
                    number = np.where(kept[number] == code, number, -1)
                    code = np.where((number[:-1] >= 0) & (number[1:] >= 0), number[:-1] * width + ids[2:], -1)
                met, n = np.unique(code[code >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n.astype(np.int64))], names=["code", "n"])

    return tokens.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def literal_array(values: Sequence[float]) -> Column:
    """A constant array; one parsed literal instead of one node per value."""
    if len(values) == 0:
        return F.array().cast("array<double>")
    text = ",".join(repr(float(v)) for v in values)
    return F.split(F.lit(text), ",").cast("array<double>")


def _weights(counts: Column, idf: Sequence[float], offset: int) -> Column:
    """(index, weight) pairs of one block: log tf times idf, unit length."""
    idf_at = literal_array(idf)
    raw = F.zip_with(
        counts["indices"], counts["values"],
        lambda i, c: F.struct((i + offset).alias("i"), ((F.log(c) + 1) * F.get(idf_at, i)).alias("w")),
    )

    def unit(pairs: Column) -> Column:
        norm = F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["w"] * p["w"]))
        return let(
            norm,
            lambda length: F.transform(
                pairs, lambda p: F.struct(p["i"].alias("i"), (p["w"] / length).alias("w"))
            ),
        )

    return let(raw, unit)


@dataclass(frozen=True)
class Features:
    """A fitted vocabulary with idf weights, per block."""

    meta_vocabulary: tuple[str, ...]
    body_vocabulary: tuple[str, ...]
    meta_idf: tuple[float, ...]
    body_idf: tuple[float, ...]
    stop_words: tuple[str, ...]

    @property
    def size(self) -> int:
        return len(self.meta_vocabulary) + len(self.body_vocabulary)

    def counts(self, texts: DataFrame) -> DataFrame:
        """Adds sparse term counts ``_meta`` and ``_body`` of both blocks."""
        return _block_counts(texts, self.meta_vocabulary, self.body_vocabulary, self.stop_words)

    def transform(self, texts: DataFrame) -> DataFrame:
        """Adds ``features``: array of (i, w), at most ``size`` entries per row.

        ``texts`` has (meta, body), or the term counts of both from ``fit_with_counts``.
        """
        counted = texts if set(COUNTS) <= set(texts.columns) else self.counts(texts)
        kept = [c for c in texts.columns if c not in ("meta", "body", *TOKENS, *COUNTS)]
        return counted.select(
            *kept,
            F.concat(
                _weights(F.col("_meta"), self.meta_idf, 0),
                _weights(F.col("_body"), self.body_idf, len(self.meta_vocabulary)),
            ).alias("features"),
        )


def _block_counts(
    texts: DataFrame, meta_vocabulary: Sequence[str], body_vocabulary: Sequence[str],
    stop_words: Sequence[str],
) -> DataFrame:
    out = texts
    for text, vocabulary in (("meta", meta_vocabulary), ("body", body_vocabulary)):
        if not vocabulary:
            empty = F.struct(
                F.lit(0).cast("tinyint").alias("type"), F.lit(0).alias("size"),
                F.array().cast("array<int>").alias("indices"),
                F.array().cast("array<double>").alias("values"),
            )
            out = out.withColumn(f"_{text}", empty)
            continue
        model = CountVectorizerModel.from_vocabulary(
            list(vocabulary), inputCol="_terms", outputCol="_vector"
        )
        out = model.transform(with_terms(out, text, "_terms", stop_words))
        out = out.withColumn(f"_{text}", F.unwrap_udt("_vector")).drop("_terms", "_vector")
    return out


def known_terms(vocabulary: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of a vocabulary, the codes of its terms in order, and the place of each.

    A term's code has the numbers of its words, from one, as digits.
    """
    words = sorted({w for t in vocabulary for w in t.split(" ")})
    number, base = {w: i + 1 for i, w in enumerate(words)}, len(words) + 1
    codes = []
    for term in vocabulary:
        code = 0
        for w in term.split(" "):
            code = code * base + number[w]
        codes.append(code)
    order = np.argsort(codes)
    return words, np.array(codes, np.int64)[order], order


def terms_met(
    column: pa.ListArray, words: pa.Array, codes: np.ndarray, order: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and count of the known terms in rows of tokens, in order of rows and places."""
    size, base = max(len(codes), 1), len(words) + 1
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = pc.index_in(column.flatten().cast(pa.string()), value_set=words)
    digit = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    places, code = [], digit
    for n in range(3):
        if n:  # terms a word longer, of those that go on with a known word of their row
            code = np.where((code[:-1] > 0) & (digit[n:] > 0) & (row[n:] == row[: len(row) - n]), code[:-1] * base + digit[n:], 0)
        if len(codes):
            k = np.minimum(np.searchsorted(codes, code), size - 1)
            found = np.flatnonzero(codes[k] == code)
            places.append(row[found] * size + order[k[found]])
    place, counts = np.unique(np.concatenate(places) if places else np.zeros(0, np.int64), return_counts=True)
    return place // size, place % size, counts


def _sparse(column: pa.ListArray, *slots) -> pa.StructArray:
    """Indices and counts of the known terms in every row of tokens."""
    row, place, counts = terms_met(column, *slots)
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(column)))].astype(np.int32))
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))),
         pa.ListArray.from_arrays(offsets, pa.array(counts.astype(float)))], names=["indices", "values"])


def _token_counts(tokens: DataFrame, *vocabularies: Sequence[str]) -> DataFrame:
    """Stored tokens of both blocks replaced by the sparse counts of their known terms."""
    shared = tokens.sparkSession.sparkContext.broadcast([known_terms(v) for v in vocabularies])
    kept = [c for c in tokens.columns if c not in TOKENS]
    sparse = T.StructType.fromDDL("indices array<int>, values array<double>")
    schema = T.StructType([tokens.schema[c] for c in kept] + [T.StructField(c, sparse) for c in COUNTS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(pa.array(words, pa.string()), codes, order) for words, codes, order in shared.value]
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.slice(start, ROWS)
                counted = [_sparse(part.column(name), *slots) for name, slots in zip(TOKENS, known)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *counted], names=[*kept, *COUNTS])

    return tokens.select(*kept, *TOKENS).mapInArrow(count, schema)


def fit_features(
    texts: DataFrame, meta_k: int = META_FEATURES, desc_k: int = DESC_FEATURES,
    stop_words: Sequence[str] = STOP_WORDS,
) -> Features:
    """Vocabulary and smoothed idf over (hash, meta, body) rows."""
    return fit_with_counts(texts, meta_k, desc_k, stop_words)[0]


def stored_tokens(texts: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """Rows with the tokens of both blocks in place of their texts, stored."""
    tokens = with_tokens(with_tokens(texts, "meta", "_meta_tokens", stop_words), "body", "_body_tokens", stop_words)
    return materialise(tokens.drop("meta", "body"), "tokens")


def fit_with_counts(
    texts: DataFrame, meta_k: int = META_FEATURES, desc_k: int = DESC_FEATURES,
    stop_words: Sequence[str] = STOP_WORDS,
) -> tuple[Features, DataFrame]:
    """``fit_features``, and the stored term counts of its rows, which ``transform`` takes for texts."""
    stop = tuple(stop_words)
    # Tokens are made once; vocabulary and frequencies both read them.
    if not set(TOKENS) <= set(texts.columns):
        texts = stored_tokens(texts, stop)
    vocabulary = {
        text: tuple(top_terms(texts.select(f"_{text}_tokens"), text, k, stop))
        for text, k in (("meta", meta_k), ("body", desc_k))
    }
    # Counts of known terms are small; frequencies and weights both read them.
    counted = materialise(_token_counts(texts, vocabulary["meta"], vocabulary["body"]), "counts")
    offset = len(vocabulary["meta"])
    present = F.concat(
        F.col("_meta")["indices"], F.transform(F.col("_body")["indices"], lambda i: i + offset)
    )
    # The entry -1 stands for the row itself, so one aggregation counts both.
    found = (
        counted.select(F.explode_outer(F.concat(F.array(F.lit(-1)), present)).alias("i"))
        .groupBy("i").count().collect()
    )
    frequency = {r.i: r["count"] for r in found}
    n = frequency.get(-1, 0)
    idf = [
        math.log((1 + n) / (1 + frequency.get(i, 0))) + 1
        for i in range(offset + len(vocabulary["body"]))
    ]
    fitted = Features(
        vocabulary["meta"], vocabulary["body"], tuple(idf[:offset]), tuple(idf[offset:]), stop
    )
    return fitted, counted


def dot(features: Column | str, weights: Sequence[float] | Column) -> Column:
    """Inner product of sparse features with a dense constant vector."""
    f = F.col(features) if isinstance(features, str) else features
    w = weights if isinstance(weights, Column) else literal_array(weights)
    return F.aggregate(f, F.lit(0.0), lambda acc, p: acc + p["w"] * F.get(w, p["i"]))


def norm(features: Column | str) -> Column:
    f = F.col(features) if isinstance(features, str) else features
    return F.sqrt(F.aggregate(f, F.lit(0.0), lambda acc, p: acc + p["w"] * p["w"]))


def similarity(postings: DataFrame, reference_text: str, **options) -> DataFrame:
    """(hash, similarity) of every posting to a reference text.

    The vocabulary is fitted on the postings plus the reference, which has the
    text as metadata and an empty body.
    """
    texts = posting_texts(postings, options.pop("max_chars", None))
    return _similarity(texts.unionByName(_reference(postings.sparkSession, reference_text)), **options)


def _reference(spark, text: str) -> DataFrame:
    """The reference is the row whose hash is empty, which no posting's is."""
    return spark.range(1).select(F.lit("").alias("hash"), F.lit(text).alias("meta"), F.lit("").alias("body"))


def _similarity(texts: DataFrame, **options) -> DataFrame:
    """(hash, similarity) to the reference among texts, or among their stored tokens."""
    fitted, counts = fit_with_counts(texts, **options)
    row = fitted.transform(counts.filter("hash = ''")).select("features").head()
    dense = [0.0] * fitted.size
    for i, w in row.features:
        dense[i] = w
    length = sum(w * w for w in dense) ** 0.5
    scored = fitted.transform(counts.filter("hash <> ''"))
    if length == 0.0:
        return scored.select("hash", F.lit(0.0).alias("similarity"))
    cosine = dot("features", dense) / (norm("features") * length)
    return scored.select(
        "hash", F.when(norm("features") > 0, cosine).otherwise(0.0).alias("similarity")
    )


def seed_by_similarity(postings: DataFrame, reference_text: str, n: int, **options) -> DataFrame:
    """The n postings most similar to the reference text, best first."""
    return top_n(similarity(postings, reference_text, **options), "similarity", n)


def seed_indexed(index: DataFrame, reference_text: str, n: int, **options) -> DataFrame:
    """``seed_by_similarity`` of postings from their stored tokens."""
    options.pop("max_chars", None)
    reference = stored_tokens(_reference(index.sparkSession, reference_text), options.get("stop_words", STOP_WORDS))
    return top_n(_similarity(index.unionByName(reference), **options), "similarity", n)
