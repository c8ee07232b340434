"""Quality classifier: a linear-chain conditional random field labels every line.

Each line has features of its own bytes and words and of the lines before and after it.
The field's transitions tie neighbouring labels; forward and backward passes give each
line the probability of being good. A document's quality is the mean of its lines'
log-odds weighted by their length, put on the scale of the labels by a logistic fit.

Line labels are not given: lines take the label of their document while the field is
trained, by gradient steps on the chain's log-likelihood over a bounded sample.

Defined cases: a null or empty text is one empty line. With no labelled row every score
is the prior 0.5. Identical rows get identical results, equal scores are equal predictions,
other columns are ignored, an empty table gives an empty result. A text of any length and number of lines is read
whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.buffers import WordHasher, column_bytes, mix, runs
from postmill.llm.samples import by_label
from postmill.session import materialise

#: Most labelled rows that are learned from, and most lines of them, in all.
SAMPLE_ROWS = 3000
SAMPLE_LINES = 120_000
STEPS = 150
RATE = 0.05
DECAY = 1e-3
#: Score from which a document is predicted good.
GOOD = 0.3

# Byte classes whose shares are features.
CLASSES = (
    ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", b"abcdefghijklmnopqrstuvwxyz"),
    ("digit", b"0123456789"), ("space", b" \t\v\f\r"), ("stop", b"."), ("comma", b",;:"),
    ("bang", b"!?"), ("bar", b"|"), ("mark", b"#$%&*+/<=>@\\^_~`"), ("quote", b"\"'()[]{}-"),
)
WIDTH = len(CLASSES) + 1 + 8


def line_features(data: np.ndarray, starts: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, the line's length, and the first line of each text.

    Texts are those of one run; each has one line more than it has line feeds.
    """
    data = np.insert(data, starts[1:], 0x0A)
    starts = starts + np.arange(len(starts))
    ends = np.flatnonzero(data == 0x0A)
    begins = np.r_[0, ends[:-1] + 1]
    first = np.searchsorted(begins, starts[:-1])
    length = (ends - begins).astype(np.float64)
    lookup = np.full(256, len(CLASSES), np.uint8)
    for k, (_, members) in enumerate(CLASSES):
        lookup[list(members)] = k
    lookup[0x0A] = 255
    kinds, x = lookup[data], np.zeros((len(begins), WIDTH))
    whole = np.maximum(length, 1)
    for k in range(len(CLASSES) + 1):
        x[:, k] = np.add.reduceat(kinds == k, begins, dtype=np.int64) / whole
    line, words = hasher.words(data, np.r_[begins, len(data)])
    count = np.bincount(line, minlength=len(begins)).astype(np.float64)
    text = np.searchsorted(starts[:-1], begins, side="right") - 1
    k = len(CLASSES) + 1
    x[:, k] = np.log1p(length) / 5
    x[:, k + 1] = np.log1p(count) / 4
    x[:, k + 2] = np.minimum(length / np.maximum(count, 1), 30) / 10
    x[:, k + 3] = _repeated(line, words, len(begins)) / np.maximum(count, 1)
    if len(words) > 2:
        with np.errstate(over="ignore"):
            three = words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7)
        inside = line[:-2] == line[2:]
        x[:, k + 4] = _repeated(line[:-2][inside], mix(three[inside]), len(begins)) / np.maximum(count - 2, 1)
    # A line whose words are those of an earlier line of its text.
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(words)]
        at = np.searchsorted(line, np.arange(len(begins) + 1))
        bag = mix(sums[at[1:]] - sums[at[:-1]] + count.astype(np.uint64))
    x[:, k + 5] = _again(text, bag)
    last = np.where(length > 0, data[np.maximum(ends - 1, 0)], 0)
    x[:, k + 6] = np.isin(last, list(b".!?"))
    x[:, k + 7] = length == 0
    return x, length, first


def _again(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """1 where the value was met before in the group."""
    order = np.lexsort((np.arange(len(value)), value, group))
    g, v = group[order], value[order]
    out = np.zeros(len(value))
    out[order[1:]] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    return out


def _repeated(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """How many values of each group were met before in it."""
    return np.bincount(group, weights=_again(group, value), minlength=groups) if len(group) else np.zeros(groups)


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines around it in its text, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first] = 0
    after[np.r_[first[1:] - 1, len(x) - 1]] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1))])


def marginals(unary: np.ndarray, tie: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains of two labels: P(label), expected pairs, log Z.

    ``unary`` has the log-potentials of label 1 over label 0, ``tie`` those of
    neighbouring labels. All chains advance together, longest first.
    """
    size = np.diff(np.r_[first, len(unary)])
    order = np.argsort(-size, kind="stable")
    begin, length = first[order], size[order]
    node = np.zeros((len(unary), 2))
    node[:, 1] = unary
    ahead, back = np.zeros_like(node), np.zeros_like(node)
    ahead[first] = node[first]
    longest = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
    for t in range(1, longest):
        at = begin[: alive[t]] + t
        prior = ahead[at - 1]
        for y in (0, 1):
            ahead[at, y] = node[at, y] + np.logaddexp(prior[:, 0] + tie[0, y], prior[:, 1] + tie[1, y])
    for t in range(longest - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        later = back[at + 1] + node[at + 1]
        for y in (0, 1):
            back[at, y] = np.logaddexp(later[:, 0] + tie[y, 0], later[:, 1] + tie[y, 1])
    ends = first + size - 1
    log_z = np.logaddexp(ahead[ends, 0], ahead[ends, 1])
    total = ahead + back
    share = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -60, 60)))
    pairs = np.zeros((2, 2))
    linked = np.ones(len(unary), bool)
    linked[first] = False
    at = np.flatnonzero(linked)
    if len(at):
        z = np.repeat(log_z, size)[at]
        for y in (0, 1):
            for w in (0, 1):
                pairs[y, w] = np.exp(ahead[at - 1, y] + tie[y, w] + node[at, w] + back[at, w] - z).sum()
    return share, pairs, log_z


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    tie: np.ndarray
    slope: float
    shift: float

    def documents(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The length-weighted mean of the lines' log-odds, between -12 and 12."""
        unary = with_neighbours((x - self.centre) / self.scale, first) @ self.weights
        share = np.clip(marginals(unary, self.tie, first)[0], 1e-5, 1 - 1e-5)
        weight = length + 1
        total = np.add.reduceat(np.log(share / (1 - share)) * weight, first)
        return total / np.add.reduceat(weight, first)

    def scores(self, odds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-(self.slope * odds + self.shift), -60, 60)))


def _fit(x: np.ndarray, length: np.ndarray, first: np.ndarray, label: np.ndarray) -> Model:
    """Weights by adaptive gradient steps; documents of both labels weigh the same."""
    size = np.diff(np.r_[first, len(x)])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    full = with_neighbours((x - centre) / scale, first)
    truth = np.repeat(label, size).astype(np.float64)
    share_good = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(label == 1, 0.5 / share_good, 0.5 / (1 - share_good)) / size
    each = np.repeat(weight, size)
    weights, tie = np.zeros(full.shape[1]), np.zeros((2, 2))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(tie), np.zeros_like(tie)]
    linked = np.ones(len(x), bool)
    linked[first] = False
    same = np.zeros((2, 2))
    for y in (0, 1):
        same[y, y] = ((truth == y) & linked).sum()
    for step in range(1, STEPS + 1):
        share, pairs, _ = marginals(full @ weights, tie, first)
        slopes = [full.T @ ((truth - share) * each) / len(first) - DECAY * weights,
                  (same - pairs) / len(x) - DECAY * tie]
        for k, (target, slope) in enumerate(((weights, slopes[0]), (tie, slopes[1]))):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * slope
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * slope**2
            target += RATE * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    model = Model(centre, scale, weights, tie, 1.0, 0.0)
    odds, slope, shift = model.documents(x, length, first), 0.1, 0.0
    for _ in range(50):  # Newton steps of a logistic fit with a weak prior
        p = 1 / (1 + np.exp(np.clip(-(slope * odds + shift), -60, 60)))
        curve = p * (1 - p) + 1e-6
        pull = np.array([(odds * (label - p)).sum() - 1e-2 * slope, (label - p).sum() - 1e-2 * shift])
        matrix = np.array([[(curve * odds**2).sum() + 1e-2, (curve * odds).sum()], [(curve * odds).sum(), curve.sum() + 1e-2]])
        move = np.linalg.solve(matrix, pull)
        slope, shift = slope + float(np.clip(move[0], -1, 1)), shift + float(np.clip(move[1], -2, 2))
    return Model(centre, scale, weights, tie, slope, shift)


def _each(column: pa.Array, hasher: WordHasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = column_bytes(column)
    for lo, hi in runs(offsets):
        yield lo, hi, *line_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], hasher)


def train(docs: DataFrame, text: str = "text", label: str = "quality", id_column: str = "doc_id") -> Model | None:
    """A model from at most ``SAMPLE_ROWS`` rows with label 0 or 1; None if there are none.

    The id only draws the sample.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"),
                       F.col(id_column).alias("id")).filter("label IN (0, 1)")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for lo, hi, x, length, first in _each(batch.column("text"), hasher):
                size = np.diff(np.r_[first, len(x)])
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(v.ravel()))
                         for v, n in ((x, size * WIDTH), (length, size))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(lo, hi - lo), *lists], names=["label", "x", "length"]
                )

    sample = (
        by_label(rows, "label", F.xxhash64("id", "text"), SAMPLE_ROWS).select("text", "label")
        .mapInArrow(work, "label int, x array<double>, length array<double>")
        .withColumn("lines", F.size("length"))
    )
    # Long texts are rare; of the sample the shortest are gathered that have so many lines in all.
    sample = materialise(sample, "lines")
    total, longest = 0, -1
    for lines, texts in sorted(tuple(r) for r in sample.groupBy("lines").count().collect()):
        total += lines * texts
        if total > SAMPLE_LINES:
            break
        longest = lines
    sample = sample.filter(F.col("lines") <= longest).toArrow().to_pandas()
    if sample.empty:
        return None
    sample["key"] = [v.tobytes() for v in sample["x"]]
    sample = sample.sort_values(["label", "lines", "key"], ignore_index=True)
    x = np.concatenate([v.reshape(-1, WIDTH) for v in sample["x"]])
    first = np.r_[0, np.cumsum(sample["lines"].to_numpy())[:-1]]
    return _fit(x, np.concatenate(list(sample["length"])), first, sample["label"].to_numpy())


def with_quality(docs: DataFrame, model: Model | None, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` and the probability that a whole text is good."""
    if model is None:
        return docs.withColumn(name, F.lit(0.5))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        hasher, out = WordHasher(), np.zeros(len(column))
        for lo, hi, x, length, first in _each(column, hasher):
            out[lo:hi] = model.scores(model.documents(x, length, first))
        return pa.array(out)

    return docs.withColumn(name, score(text))
