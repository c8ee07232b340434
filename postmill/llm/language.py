"""Language ID: hashed subword embeddings, averaged, a linear softmax, calibrated rejection.

Subwords are the runs of two to four UTF-8 bytes inside a word, word boundaries
included. Each is hashed to a bucket; a text is the mean of its buckets' embeddings,
and a linear softmax over that mean gives the languages. Embeddings and softmax are
trained together by stochastic gradient descent in numpy on a bounded sample.

Rejection is learned too. One sampled text in four is also disguised: its letters are
replaced by others, shuffled, drawn at random or moved to another script, so that it is
in no language at all. Such texts are a class of the softmax beside the languages. One
fifth of all rows is kept back. On it a temperature is fitted, and the least probability
of a language at which a text is accepted: between what right answers reach, but for a
share of `LOST`, and what disguised texts reach, but for a share of `PASSED`.

Defined cases: a null text, or one without a letter, is `und` with score 0 and
rejected. A text whose subwords were never met gets the language the softmax has for it,
with a low score. With no labelled row to learn from every text is `und`. Where no row
could be kept back (no language has five rows) nothing is rejected that has a letter.
Rows with a null language are not learned from. Identical rows get identical results,
other columns are ignored, whatever their names; an empty table gives an empty result. A
text of any length is read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.buffers import column_bytes, runs
from postmill.llm.samples import by_label

UNKNOWN = "und"
#: Most labelled rows that are learned from, over all languages.
SAMPLE_ROWS = 4000
BUCKET_BITS = 15
DIMENSIONS = 16
UPDATES = 20_000
RATE = 1.0
#: Share of right answers that rejection may cost on the rows kept back, and of disguised
#: texts that may pass.
LOST, PASSED = 0.001, 0.02
#: Bytes of a text that are worked off at once.
CHUNK = 1 << 20
#: Of so many sampled texts one is also disguised.
DISGUISED = 4


def _subwords(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list]:
    """Begin of every text after a boundary is set behind each, and (bucket, valid) per size."""
    data = np.insert(data, starts[1:], 0x20)
    begins = starts[:-1] + np.arange(len(starts) - 1)
    upper = (data >= 0x41) & (data <= 0x5A)
    folded = np.where(upper, data + np.uint8(32), data)
    letter = (folded >= 0x80) | ((folded >= 0x61) & (folded <= 0x7A))
    codes = np.where(letter, folded, np.uint8(0x20)).astype(np.uint32)
    codes, letter = np.r_[codes, np.full(3, 0x20, np.uint32)], np.r_[letter, np.zeros(3, bool)]
    n, found = len(data), []
    packed = codes[:n] | (codes[1 : n + 1] << np.uint32(8))
    inside = np.ones(n, bool)
    for size in (2, 3, 4):
        if size > 2:
            packed = packed | (codes[size - 1 : n + size - 1] << np.uint32(8 * (size - 1)))
            inside = inside & letter[size - 2 : n + size - 2]
        valid = inside if size > 2 else letter[:n] | letter[1 : n + 1]
        with np.errstate(over="ignore"):
            mixed = (packed ^ (packed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(size)
            mixed = (mixed ^ (mixed >> np.uint32(12))) * np.uint32(0x297A2D39)
        found.append(((mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), valid))
    return begins, found


def _totals(text: np.ndarray) -> np.ndarray:
    """How often each bucket is met in one text, chunk by chunk; subwords look three bytes ahead."""
    total = np.zeros(1 << BUCKET_BITS)
    for lo in range(0, len(text), CHUNK):
        size = min(CHUNK, len(text) - lo)
        part = text[lo : lo + size + 3]
        for bucket, valid in _subwords(part, np.array([0, len(part)]))[1]:
            total += np.bincount(bucket[:size][valid[:size]], minlength=len(total))
    return total


def disguised(text: np.ndarray, kind: int, rng: np.random.Generator) -> np.ndarray:
    """A text of the same shape that is in no language.

    Its letters stand for others (0), are shuffled (1), are drawn at random (2), or are
    letters of two (3) or three bytes (4) of one script.
    """
    folded = np.where((text >= 0x41) & (text <= 0x5A), text + np.uint8(32), text)
    letter = (folded >= 0x61) & (folded <= 0x7A)
    out, own = folded.copy(), folded[letter]
    follows = (folded >= 0x80) & (folded < 0xC0)
    if kind == 0:
        out[letter] = rng.permutation(26).astype(np.uint8)[own - 0x61] + np.uint8(0x61)
        out[follows] = rng.permutation(64).astype(np.uint8)[folded[follows] - 0x80] + np.uint8(0x80)
        return out
    if kind == 1:
        out[letter] = rng.permutation(own)
        return out
    if kind == 2:
        out[letter] = rng.integers(0x61, 0x7B, len(own), dtype=np.uint8)
        return out
    size = np.where(letter, kind - 1, 1)
    begin, wide = np.cumsum(size) - size, np.repeat(out, size)
    lead = rng.integers(0xC4, 0xDF, 2, dtype=np.uint8) if kind == 3 else rng.integers(0xE1, 0xEA, 4, dtype=np.uint8)
    wide[begin[letter]] = lead[own % len(lead)]
    for k in range(1, kind - 1):
        drawn = own if kind == 3 else own + rng.integers(0, 8, len(own), dtype=np.uint8) * np.uint8(26)
        wide[begin[letter] + k] = rng.permutation(64).astype(np.uint8)[drawn % 64] + np.uint8(0x80)
    return wide


@dataclass(frozen=True)
class Model:
    """What tasks need: each bucket's share in the scores, already times the softmax.

    The last column of scores is that of texts in no language.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        scores = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)


def _features(texts: DataFrame) -> DataFrame:
    """(lang, buckets, counts) of texts and, without a language, of some disguised ones.

    What one text weighs is bounded by the buckets.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for k in range(len(offsets) - 1):
                text = data[offsets[k] : offsets[k + 1]]
                found = [(batch.column("lang").slice(k, 1), _totals(text))]
                draw = zlib.crc32(text.tobytes())
                if draw % DISGUISED == 0:
                    other = disguised(text[:CHUNK], draw // DISGUISED % 5, np.random.default_rng(draw))
                    found.append((pa.nulls(1, pa.string()), _totals(other)))
                for lang, total in found:
                    at = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([
                        lang, pa.array([at.astype(np.int16)], pa.list_(pa.int16())),
                        pa.array([total[at].astype(np.float32)], pa.list_(pa.float32())),
                    ], names=["lang", "buckets", "counts"])

    return texts.mapInArrow(work, "lang string, buckets array<smallint>, counts array<float>")


def _share(counts: np.ndarray) -> np.ndarray:
    return counts / counts.sum(dtype=np.float64)


def _fit(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings times softmax weights, and the bias, after ``UPDATES`` single-text steps."""
    rng = np.random.default_rng(seed)
    inputs = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS))
    outputs, bias = np.zeros((DIMENSIONS, classes)), np.zeros(classes)
    for step in range(UPDATES):
        if step % len(rows) == 0:
            order = rng.permutation(len(rows))
        lang, at, counts = rows[order[step % len(rows)]]
        share = _share(counts)
        rate = RATE * (1 - step / UPDATES)
        hidden = share @ inputs[at]
        scores = hidden @ outputs + bias
        error = np.exp(scores - scores.max())
        error /= error.sum()
        error[lang] -= 1
        back = outputs @ error
        outputs -= rate * np.outer(hidden, error)
        bias -= 0.1 * rate * error
        inputs[at] -= rate * np.outer(share, back)
    return inputs @ outputs, bias


def _calibrated(table: np.ndarray, bias: np.ndarray, kept: list, languages: list[str]) -> Model:
    """The temperature of least log loss, and the threshold of rejection, on rows kept back."""
    small = table.astype(np.float32)
    if not kept:
        return Model(languages, small, bias, 1.0, 0.0)
    sums = np.array([_share(counts) @ table[at] for _, at, counts in kept])
    truth, one = np.array([lang for lang, _, _ in kept]), np.ones(len(kept))

    def loss(t: float) -> float:
        shares = Model(languages, table, bias, t, 0).probabilities(sums, one)
        return -np.log(shares[np.arange(len(truth)), truth] + 1e-12).mean()

    best = float(min(np.geomspace(0.05, 20, 60), key=loss))
    shares = Model(languages, table, bias, best, 0.0).probabilities(sums, one)
    known = truth < len(languages)
    right = shares[np.arange(len(truth)), truth][known]
    threshold = float(np.quantile(right, LOST)) if len(right) else 0.0
    strange = shares[~known, :-1].max(axis=1)
    if len(strange) and (least := float(np.quantile(strange, 1 - PASSED))) < threshold:
        threshold = (least * threshold) ** 0.5
    return Model(languages, small, bias, best, threshold)


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id", seed: int = 7
) -> Model | None:
    """A model from at most ``SAMPLE_ROWS`` rows with a language; None if there are none.

    The id only draws the sample.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(id_column).alias("id")).filter(
        "text IS NOT NULL AND lang IS NOT NULL"
    )
    drawn = by_label(rows, "lang", F.xxhash64("id", "text"), SAMPLE_ROWS).select("text", "lang")
    sample = _features(drawn).toArrow()
    names = sample.column("lang").to_pylist()
    languages = sorted({n for n in names if n is not None})
    if not languages:
        return None
    number = {name: k for k, name in enumerate(languages)} | {None: len(languages)}
    # Views of the gathered buffers: nothing is copied.
    found, place = [], 0
    for batch in sample.to_batches():
        lists = [batch.column(c) for c in ("buckets", "counts")]
        bounds = lists[0].offsets.to_numpy()
        buckets, counts = (x.values.to_numpy() for x in lists)
        for k in range(len(batch)):
            part = slice(bounds[k], bounds[k + 1])
            if bounds[k + 1] > bounds[k]:
                found.append((number[names[place + k]], buckets[part], counts[part]))
        place += len(batch)
    if not any(r[0] < len(languages) for r in found):
        return None
    found.sort(key=lambda r: (r[0], len(r[1]), zlib.crc32(r[1]), zlib.crc32(r[2])))
    # Every fifth row of a class is kept back.
    first: dict[int, int] = {}
    kept, learned = [], []
    for k, row in enumerate(found):
        at = k - first.setdefault(row[0], k)
        (kept if at % 5 == 4 else learned).append(row)
    return _calibrated(*_fit(learned, len(languages) + 1, seed), kept, languages)


def with_language(docs: DataFrame, model: Model | None, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` and a struct (lang, score, rejected) of each whole text."""
    if model is None:
        return docs.withColumn(name, F.struct(
            F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")
        ))
    columns = np.ascontiguousarray(model.table.T)

    @F.arrow_udf("struct<lang: string, score: double>")
    def best(column: pa.Array) -> pa.Array:
        data, offsets = column_bytes(column)
        sums, counts = np.zeros((len(column), len(columns))), np.zeros(len(column))
        for lo, hi in runs(offsets):
            # A text longer than a run is alone in it and worked off in chunks.
            step = CHUNK if hi == lo + 1 else offsets[hi] - offsets[lo] or 1
            for at in range(offsets[lo], max(offsets[hi], offsets[lo] + 1), step):
                end = min(at + step, offsets[hi])
                ahead = min(end + 3, offsets[hi])
                begins, found = _subwords(data[at:ahead], np.clip(offsets[lo : hi + 1], at, ahead) - at)
                for bucket, valid in found:
                    if ahead > end:
                        valid[end - at :] = False
                    counts[lo:hi] += np.add.reduceat(valid, begins, dtype=np.int64)
                    for k, values in enumerate(columns):
                        sums[lo:hi, k] += np.add.reduceat(np.where(valid, values[bucket], 0), begins, dtype=np.float64)
        if not len(column):
            return pa.array([], pa.struct([("lang", pa.string()), ("score", pa.float64())]))
        shares = model.probabilities(sums, counts)
        top = shares[:, :-1].argmax(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array([model.languages[k] for k in top]), pa.array(shares[np.arange(len(top)), top])],
            names=["lang", "score"],
        )

    raw, lettered = best(text), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(name, F.struct(
        F.when(lettered, raw["lang"]).otherwise(UNKNOWN).alias("lang"),
        F.when(lettered, raw["score"]).otherwise(0.0).alias("score"),
        (~lettered | (raw["score"] < model.threshold)).alias("rejected"),
    ))


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """The rows whose language is told with enough certainty, columns unchanged."""
    found = with_language(docs, train(docs, text, lang, id_column), text, "__language")
    return found.filter("NOT __language.rejected").select(*docs.columns)
