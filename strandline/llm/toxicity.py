"""Toxicity: a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

Features are the presence of hashed character 4-, 5- and 6-grams of the whole lower-cased text, in which each run of characters other
than letters is one boundary, with one more at the end. Each is scaled by the log ratio of its
smoothed shares among toxic and other texts of a labelled sample; a linear classifier is trained on the scaled features by averaged
passive-aggressive steps, and its margins become probabilities by a logistic curve fitted on margins of texts that were left out of
training in turn.

Null and empty texts have no feature and the score of the intercept. If a label is missing from the sample, every score is the share of
label 1 in it (0.5 without labels). Rows with null or repeated ids are judged each on its own. A very long text is read whole, alone in
its chunk, and has at most one feature for each hash value. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch
from ._text import code_points, labelled_sample, remainder

BITS, LIMIT, GRAMS = 18, 1 << 18, (4, 5, 6)
#: Labelled rows of each label that are learnt from, about; passes over them.
SAMPLE, PASSES = 1500, 8
SMOOTH, AGGRESSION = 1.0, 1.0
#: Texts of the sample that must hold a feature for it to count; parts of the sample by which margins of texts not trained on are found.
LEAST_TEXTS, FOLDS = 3, 4


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct feature numbers) of each row."""
    last = np.empty(1 << BITS, np.int32)
    for i, j, cp, letter, own in code_points(column, LIMIT):
        # a boundary before and after each text, and one for each run of characters that are not letters
        c = np.insert(np.where(letter, cp, 0), own, 0)
        keep = c != 0
        keep[1:] |= c[:-1] != 0
        own = own + np.arange(len(own))
        keep[own] = True
        c, own = c[keep], (np.cumsum(keep) - 1)[own]
        x = c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        x ^= x >> np.uint64(29)
        grams, h = [], x
        for n in range(2, GRAMS[-1] + 1):
            h = h[:-1] * np.uint64(0xBF58476D1CE4E5B9) + x[n - 1 :] if len(h) > 1 else h[:0]
            if n in GRAMS:
                grams.append(((h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - BITS)).astype(np.int32))
        for k in range(j - i):
            a, b = own[k], own[k + 1] + 1
            f = np.concatenate([g[a : max(b - n + 1, a)] for n, g in zip(GRAMS, grams, strict=True)])
            order = np.arange(len(f), dtype=np.int32)
            last[f] = order
            yield i + k, f[last[f] == order]


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        label = b.column(1)
        out = [x.astype(np.int32).tobytes() for _, x in features(b.column(2))]
        yield pa.RecordBatch.from_arrays([b.column(0), label, pa.array(out, pa.binary())], ["doc_id", "label", "x"])


class Model:
    """weight of each feature, and the curve from margins to probabilities."""

    def __init__(self, weight: np.ndarray, slope: float, shift: float):
        self.weight, self.slope, self.shift = weight, slope, shift

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def curve(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of the logistic curve, by Newton steps with a slight ridge."""
    scale = max(float(np.abs(margin).mean()), 1e-9)
    x = np.stack([margin / scale, np.ones_like(margin)], 1)
    t = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -40, 40)))
        gradient = x.T @ (weight * (p - label)) + 1e-2 * t
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        t -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(t[0], 0.0) / scale, t[1]


def log_ratios(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """For each feature the logarithm of its smoothed share among texts of label 1 over that among others; 0 if few texts hold it."""
    counts = np.full((2, 1 << BITS), SMOOTH)
    for f, y in rows:
        counts[y, f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[counts.sum(0) < 2 * SMOOTH + LEAST_TEXTS] = 0
    return ratio


def _train(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weight of each feature, and bias."""
    size, ratio = 1 << BITS, log_ratios(rows)
    rows = [(f[ratio[f] != 0], y) for f, y in rows]  # the others would weigh nothing
    w, total, steps = np.zeros(size), np.zeros(size), 0
    bias, bias_total = 0.0, 0.0
    order = np.arange(len(rows))
    for n in range(PASSES):
        np.random.default_rng(n).shuffle(order)
        for k in order:
            f, y = rows[k]
            s, r = 2 * y - 1, ratio[f]
            loss = 1 - s * (w[f] @ r + bias)
            steps += 1
            if loss > 0:
                rate = loss / (r @ r + 1 + 0.5 / AGGRESSION) * s
                w[f] += rate * r
                total[f] += steps * rate * r
                bias += rate
                bias_total += steps * rate
    return (w - total / (steps + 1)) * ratio, bias - bias_total / (steps + 1)


def fit(rows: list[tuple[np.ndarray, int]], prior: float) -> Model:
    """rows: distinct feature numbers and label, in a fixed order. prior: the share of label 1 among all labelled rows."""
    y = np.array([y for _, y in rows], np.float64)
    if not len(rows) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0 if not len(rows) else 40.0 * (2 * y[0] - 1))
    margin = np.zeros(len(rows))
    for fold in range(FOLDS):
        part = [r for k, r in enumerate(rows) if k % FOLDS != fold]
        if len({y for _, y in part}) == 2:
            weight, bias = _train(part)
            for k in range(fold, len(rows), FOLDS):
                margin[k] = weight[rows[k][0]].sum() + bias
    weight, bias = _train(rows)
    slope, shift = curve(margin, y, np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())))
    return Model(weight.astype(np.float32), slope, shift + slope * bias)


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            margin = np.zeros(b.num_rows)
            for k, f in features(b.column(2)):
                margin[k] = m.weight[f].sum(dtype=np.float64)
            p = m.probability(margin)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return score


def learn(docs: DataFrame, labels: DataFrame, learn_from, each: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. The rows of the sample, at most about 2 * each, are broadcast to the documents."""
    sample = labelled_sample(labels, "toxic", learn_from, each)
    seen = labels.filter(learn_from & F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).head()[0]
    got = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text").mapInArrow(_collect, "doc_id long, label int, x binary")
    rows = sorted(((r[0], r[1], bytes(r[2])) for r in got.toLocalIterator()))
    return fit([(np.frombuffer(x, np.int32), y) for _, y, x in rows], seen if seen is not None else 0.5)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, held_out, text. doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a megabyte, whatever the corpus
    return docs.select("doc_id", "held_out", "text").mapInArrow(_scorer(held), "doc_id long, held_out boolean, score double, predicted int")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    held = remainder(F.col("doc_id"), 5) == 0
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = table.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    with Scratch(spark, table) as scratch:
        return scratch.keep(score(docs, learn(docs.select("doc_id", "text"), labels, ~held)))
