"""Quality classification by histogram gradient-boosted trees over document statistics.

The statistics of a text are counts and shares of its bytes, words and lines. Trees are grown level by level on binned statistics of a
labelled sample, with second-order logistic gains, and flattened into arrays: complete binary trees that numpy traverses for all rows of
a batch at once.

Words are runs of [^\\x20\\x09-\\x0D]+. Null and empty texts have statistics of zero and are scored from them. If a label is missing from
the sample, every score is the share of label 1 in it (0.5 without labels). Rows with null or repeated ids are judged each on its own.
A very long text is measured whole, alone in its chunk. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, NOT_SPACE, U64, chunks, lean, mix, per_row, span_hashes, spans
from ._spark import Scratch
from ._text import labelled_sample, remainder

#: Labelled rows of each label that are learnt from, about.
SAMPLE = 8000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 4, 48, 0.15, 2.0, 8.0
SYMBOLS = b"!#$%&*+/<=>@\\^_`{|}~[]()\"'-"


def _table(chars) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


UPPER, DIGIT, LETTER = _table(range(0x41, 0x5B)), _table(range(0x30, 0x3A)), _table([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
PUNCTUATION, STOP, SYMBOL, HIGH = _table(b".,;:?"), _table(b".!?"), _table(SYMBOLS), _table(range(0x80, 0x100))
ODD = _table(b"#$%&*<>=@\\^_`{|}~[]")
CLASSES = [UPPER, DIGIT, LETTER, PUNCTUATION, STOP, SYMBOL, HIGH, ODD, ~NOT_SPACE]
NAMES = [
    "bytes", "words", "lines", "word length", "word length deviation", "longest word", "line words", "line bytes deviation",
    "upper", "digits", "letters", "punctuation", "stops", "symbols", "high bytes", "odd symbols", "spaces",
    "words without letter", "words with odd symbol", "words ending in punctuation", "upper words", "short words", "distinct words", "adjacent equal words",
    "distinct word pairs", "distinct lines", "empty lines", "most frequent word", "stops a word", "equal neighbour bytes",
]


def _distinct(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and the count of its most frequent one."""
    if not len(h):
        return np.zeros(rows), np.zeros(rows)
    by = np.lexsort((h, row))
    h, row = h[by], row[by]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))))
    many, most = np.diff(np.concatenate((first, [len(h)]))), np.zeros(rows)
    np.maximum.at(most, row[first], many)
    return np.bincount(row[first], minlength=rows).astype(float), most


def statistics(column: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    out = np.zeros((len(column), len(NAMES)), np.float32)
    for lo, hi, buf, own in chunks(column, 1 << 19):
        n, last = hi - lo, own[1:] - 1
        size = np.diff(own) - 1.0
        at = np.concatenate(([0], own[1:]))

        def total(flags, at=at, n=n):
            c = np.concatenate(([0], np.cumsum(flags)))
            return (c[at[1:]] - c[at[:-1]]).astype(float)

        buf = buf.copy()
        shares = [total(t[buf]) for t in CLASSES]
        shares[-1] -= 1  # the space after each text
        starts, ends = spans(buf, NOT_SPACE)
        words = per_row(starts, own)
        row, length = np.repeat(np.arange(n), words), (ends - starts).astype(float)
        counts = np.maximum(words, 1)
        by = lambda x, row=row, n=n: np.bincount(row, x, n)
        mean = by(length) / counts
        spread = np.sqrt(np.maximum(by(length**2) / counts - mean**2, 0))
        longest = np.zeros(n)
        np.maximum.at(longest, row, length)
        inside = lambda t, starts=starts, ends=ends, buf=buf: np.diff(np.concatenate(([0], np.cumsum(t[buf])))[np.stack((starts, ends), 1)], axis=1)[:, 0] if len(starts) else np.zeros(0)
        letters, upper, odd = inside(LETTER), inside(UPPER), inside(ODD)
        h = span_hashes(LOWER[buf], starts, ends)
        same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        pair = mix(h[:-1] * U64(3) + h[1:])[row[1:] == row[:-1]]
        distinct, most = _distinct(h, row, n)
        pairs, _ = _distinct(pair, row[1:][row[1:] == row[:-1]], n)
        # lines: a line ends at a newline or at the end of the text
        buf[last] = 0x0A
        ends_l = np.flatnonzero(buf == 0x0A)
        lines = per_row(ends_l, own)
        row_l = np.repeat(np.arange(n), lines)
        starts_l = np.concatenate(([0], ends_l[:-1] + 1)) if len(ends_l) else ends_l
        length_l = (ends_l - starts_l).astype(float)
        full = length_l > 0
        h_l = span_hashes(buf, starts_l[full], ends_l[full])
        distinct_l, _ = _distinct(h_l, row_l[full], n)
        full_l = np.bincount(row_l[full], minlength=n)
        mean_l = np.bincount(row_l, length_l, n) / np.maximum(lines, 1)
        spread_l = np.sqrt(np.maximum(np.bincount(row_l, length_l**2, n) / np.maximum(lines, 1) - mean_l**2, 0))
        same_byte = np.concatenate((buf[1:] == buf[:-1], [False]))
        same_byte[last] = same_byte[np.maximum(last - 1, 0)] = False  # neighbours of one text only
        equal = total(same_byte)
        bytes_ = np.maximum(size, 1)
        out[lo:hi] = np.stack(
            [
                np.log1p(size), np.log1p(words), np.log1p(lines), mean, spread, np.log1p(longest), words / np.maximum(lines, 1), np.log1p(spread_l),
                *[s / bytes_ for s in shares],
                by((letters == 0).astype(float)) / counts, by((odd > 0).astype(float)) / counts, by(PUNCTUATION[buf[np.maximum(ends - 1, 0)]].astype(float)) / counts,
                by(((upper > 1) & (upper == letters)).astype(float)) / counts, by((length <= 2).astype(float)) / counts, distinct / counts,
                np.bincount(row[1:][same], minlength=n) / counts, pairs / np.maximum(words - 1, 1), distinct_l / np.maximum(full_l, 1), (lines - full_l) / np.maximum(lines, 1),
                most / counts, shares[4] / counts, equal / bytes_,
            ],
            1,
        )
    return out


class Trees:
    """Complete binary trees of one depth as arrays: feature and threshold of each inner node, value of each leaf."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, bias: float):
        self.feature, self.threshold, self.value, self.bias = feature, threshold, value, bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        trees, depth = np.arange(len(self.feature))[None, :], int(np.log2(self.feature.shape[1] + 1)) if len(self.feature) else 0
        at, rows = np.zeros((len(x), len(self.feature)), np.int64), np.arange(len(x))[:, None]
        for _ in range(depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        total = self.bias + (self.value[trees, at - self.feature.shape[1]].sum(1) if depth else 0)
        return 1 / (1 + np.exp(-np.clip(total + np.zeros(len(x)), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, prior: float) -> Trees:
    """Rows of either label weigh so that label 1 has the share `prior`."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    none = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves))
    if not len(y) or y.min() == y.max():
        return Trees(*none, 0.0 if not len(y) else 40.0 * (2 * float(y[0]) - 1))
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    k, m = BINS, x.shape[1]
    bias = float(np.log(prior / (1 - prior)))
    margin = np.full(len(y), bias)
    feature, threshold, value = np.zeros((TREES, inner), np.int64), np.zeros((TREES, inner)), np.zeros((TREES, leaves))
    flat = np.arange(m)[None, :] * k + bins
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            nodes, base = 2**level, 2**level - 1
            index = ((at - base)[:, None] * (m * k) + flat).ravel()
            sums = [np.bincount(index, np.repeat(v, m), nodes * m * k).reshape(nodes, m, k).cumsum(2) for v in (g, h)]
            (gl, hl), (ga, ha) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
            gain[(hl < LEAST * 0.05) | (ha - hl < LEAST * 0.05)] = 0
            gain[:, :, -1] = 0
            for f in range(m):
                gain[:, f, len(cuts[f]) :] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            f, b = best // k, best % k
            split = gain.reshape(nodes, -1).max(1) > 1e-9
            feature[t, base : base + nodes] = f
            threshold[t, base : base + nodes] = [cuts[i][j] if s else np.inf for i, j, s in zip(f, b, split, strict=True)]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > threshold[t, at])
        leaf = at - inner
        value[t] = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        margin += value[t][leaf]
    return Trees(feature, threshold, value, bias)


@lean
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = statistics(b.column(2))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())), *b.columns[3:]], ["doc_id", "held_out", "x", *b.schema.names[3:]])


def measure(docs: DataFrame, keep=()) -> DataFrame:
    """docs: doc_id, held_out, text. The statistics x of each whole text. keep: columns of docs that are carried along."""
    return docs.select("doc_id", "held_out", "text", *keep).mapInArrow(_measure, ", ".join(["doc_id long, held_out boolean, x array<float>", *(f"{k} {t}" for k, t in docs.select(*keep).dtypes)]))


def learn(measured: DataFrame, labels: DataFrame, learn_from, each: int = SAMPLE) -> Trees:
    """labels: doc_id, quality. The rows of the sample, about 2 * each at most, are broadcast to the measured documents."""
    sample = labelled_sample(labels, "quality", learn_from, each)
    prior = labels.filter(learn_from & F.col("quality").isin(0, 1)).agg(F.avg("quality")).head()[0]
    got = sorted((r[0], r[1], r[2]) for r in measured.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "x").toLocalIterator())
    x = np.array([r[2] for r in got], np.float32).reshape(-1, len(NAMES))
    return fit(x, np.array([r[1] for r in got], np.float64), prior if prior is not None else 0.5)


def _scorer(model):
    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            p = m.probability(np.asarray(b.column(2).flatten()).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *b.columns[3:]], ["doc_id", "held_out", "score", "predicted", *b.schema.names[3:]])

    return score


def score(measured: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted of each measured document, and the columns that were carried along."""
    held = measured.sparkSession.sparkContext.broadcast(model)  # some kilobytes, whatever the corpus
    return measured.mapInArrow(_scorer(held), ", ".join(["doc_id long, held_out boolean, score double, predicted int", *(f"{k} {t}" for k, t in measured.dtypes[3:])]))


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch, keep=()) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, quality. Learns from labels whose crc32 of the id modulo 3 is not 1; scores every row.

    keep: columns of docs that are carried along.
    """
    held = remainder(F.col("doc_id"), 3) == 1
    measured = scratch.table(measure(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text", *keep), keep), "statistics")
    return score(measured, learn(measured, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), ~held))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, docs) as scratch:
        return scratch.keep(classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), scratch))
