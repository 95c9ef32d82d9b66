"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram is bound from the vectors of its letters, permuted by their place; a text bundles
(sums) its n-grams; a language's prototype bundles the texts of a labelled sample, each with weight one. A text has the language whose
prototype has the largest cosine with it; ties go to the first name. The score is that cosine, at least 0.

Letters are Unicode letters, lower-cased; a run of other characters is one boundary. A null text and one without a letter are `und` with
score 0; so is every text if nothing was learnt. A row with a null or repeated id is judged like any other. A very long text is bundled
whole, its n-grams a few thousand at a time. An empty table gives an empty result. Extra columns are not read. Sums are of small integers
and exact in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch
from ._text import code_points, remainder

DIM, GRAM, SEED = 1024, 3, 11
#: Labelled texts that are learnt from, for each language, about.
SAMPLE = 1500
#: Bytes of text bundled at once, and n-grams multiplied at once.
LIMIT, GRAMS = 1 << 19, 1 << 13
_letters: dict[int, np.ndarray] = {}


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point; 0 is the boundary."""
    for c in points.tolist():
        if c not in _letters:
            _letters[c] = (np.random.default_rng([SEED, c]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1).astype(np.float32)
    return np.stack([_letters[c] for c in points.tolist()]) if len(points) else np.zeros((0, DIM), np.float32)


def bundles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, a vector for each row); a row without letters has a zero vector."""
    for i, j, cp, letter, own in code_points(column, LIMIT):
        rows = j - i
        # a boundary before, between and after documents, and one for each run of other characters
        c = np.insert(np.where(letter, cp, 0), own, 0)
        row = np.insert(np.repeat(np.arange(rows), np.diff(own)), own, 0)
        keep = c != 0
        keep[1:] |= c[:-1] != 0
        keep[0] = True
        c, row = c[keep], row[keep]
        out = np.zeros((rows, DIM), np.float32)
        ok = c[1:-1] != 0  # an n-gram belongs to its middle letter
        if ok.any():
            alphabet, at = np.unique(c, return_inverse=True)
            k = len(alphabet)
            gram = (at[:-2][ok].astype(np.int64) * k + at[1:-1][ok]) * k + at[2:][ok]
            row = row[1:-1][ok]
            if k**3 <= 1 << 22:
                seen = np.flatnonzero(np.bincount(gram, minlength=1))
                place = np.zeros(k**3, np.int64)
                place[seen] = np.arange(len(seen))
                gram = place[gram]
            else:
                seen, gram = np.unique(gram, return_inverse=True)
            letters = letter_vectors(alphabet)
            turned = [np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters]
            for lo in range(0, len(seen), GRAMS):
                g = seen[lo : lo + GRAMS]
                bound = turned[0][g // (k * k)]
                bound *= turned[1][g // k % k]
                bound *= turned[2][g % k]
                if len(seen) <= GRAMS:
                    count = np.bincount(row * len(g) + gram, minlength=rows * len(g))
                else:
                    inside = (gram >= lo) & (gram < lo + len(g))
                    count = np.bincount(row[inside] * len(g) + gram[inside] - lo, minlength=rows * len(g))
                out += count.reshape(rows, len(g)).astype(np.float32) @ bound
        yield i, j, out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    return x / np.where(n > 0, n, 1)[:, None]


def _learner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column(1).to_pylist()
        for i, j, x in bundles(b.column(0)):
            for lang, v in zip(langs[i:j], _unit(x), strict=True):
                total[lang] = total.get(lang, 0) + v
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """docs: doc_id, text, lang. Names and unit prototypes of the languages, from about `sample` texts each."""
    rows = docs.filter("lang is not null and text is not null")
    many = rows.groupBy("lang").count()
    names = {r["lang"]: r["count"] for r in many.collect()}  # a row for each language
    fine = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in names.items() for x in (k, min(fine, int(fine * sample / n)))]) if names else None
    if share is None:
        return [], np.zeros((0, DIM))
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(fine)) < share[F.col("lang")]).select("text", "lang").repartition(12)
    total: dict[str, np.ndarray] = {}
    for lang, v in chosen.mapInArrow(_learner, "lang string, v array<double>").orderBy("lang", "v").toLocalIterator():  # 12 rows for each language at most
        total[lang] = total.get(lang, 0) + np.array(v)
    order = sorted(total)
    return order, _unit(np.array([total[k] for k in order]).reshape(-1, DIM)).round(9)


def _judge(names: list[str], prototypes: np.ndarray):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            for i, j, x in bundles(b.column(2)):
                known = x.any(1) if names else np.zeros(j - i, bool)
                cosine = _unit(x[known]) @ prototypes.T if known.any() else np.zeros((0, 1))
                lang[i:j][known] = np.array(names, object)[cosine.argmax(1)] if len(cosine) else lang[i:j][known]
                score[i:j][known] = np.clip(cosine.max(1), 0, 1) if len(cosine) else 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return judge


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """docs: doc_id, held_out, text. doc_id, held_out, lang_pred, score."""
    return docs.select("doc_id", "held_out", "text").mapInArrow(_judge(names, prototypes), "doc_id long, held_out boolean, lang_pred string, score double")


def op1_language(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = table.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    with Scratch(spark, table) as scratch:
        model = learn(docs.filter("not held_out"))
        return scratch.keep(identify(docs.drop("lang"), *model))
