"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, scaled to unit length and turned by a random rotation; the index keeps one sign bit a dimension, packed, the length
and the inner product of the unit vector with its code. A query's turned vector is rounded to four bits a component, whose planes are
packed too: the inner product of query and code is a sum of population counts. From it and the scalars the inner product of the vectors is
estimated without bias, with a bound on the error. A vector is reranked, by its exact distance, only if the lower bound of its distance is
no more than the k-th smallest distance known so far in the task.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of each dimension are an index of their own, and
a query is compared with those of its dimension; between others no distance is defined. Rows of equal vec_id are all candidates, but none
for a query of that id; of several query rows of an id and dimension the smallest vector asks. With fewer candidates than k, all are
returned; an empty table gives an empty result. Extra columns are not read. Queries come in blocks of bounded size, each scanned against
the whole index: the work is that of the query set times the index, at a few operations a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import lean
from ._spark import Scratch

#: Error bounds hold with this many deviations of the estimate.
DEVIATIONS = 3.0
#: Bits of a query's component.
BITS = 4
#: Queries in a block, and their components; estimates made at once, reranked pairs at once.
QUERY_BLOCK, COMPONENTS, CELLS, PAIRS = 8192, 1 << 20, 1 << 20, 1 << 15
CODES = "vec_id long, dim int, code binary, length double, dot double, vector array<float>"
RESULT = "query_id long, vec_id long, score double"
NEAREST = "query_id long, rank int, vec_id long, score double"


def valid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that take part, whatever their dimension."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False)))


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    rows, dim = bits.shape
    out = np.zeros((rows, -(-dim // 64) * 8), np.uint8)
    out[:, : -(-dim // 8)] = np.packbits(bits, axis=1)
    return out.view(np.uint64)


def _encoder(means: dict[int, np.ndarray]):
    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims).tolist():
                b = batch.filter(pa.array(dims == dim))
                turn = turns.setdefault(dim, rotation(dim))
                x = matrix(b.column(2), dim).astype(np.float64) - means[dim]
                length = np.sqrt((x * x).sum(1))
                unit = (x / np.where(length > 0, length, 1)[:, None]) @ turn
                code = packed(unit >= 0)
                dot = np.abs(unit).sum(1) / np.sqrt(dim)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(dot), b.column(2)], ["vec_id", "dim", "code", "length", "dot", "vector"])

    return encode


class Index:
    """codes: CODES rows; means: the mean vector of each dimension that occurs."""

    def __init__(self, codes: DataFrame, means: dict[int, np.ndarray]):
        self.codes, self.means = codes, means


def build(vectors: DataFrame, scratch: Scratch, key: str = "vec_id", vector: str = "embedding") -> Index | None:
    """Codes of all vectors, centred on the mean of their dimension; None if there is no vector."""
    rows = valid(vectors, key, vector).select("vec_id", F.size("vector").alias("dim"), "vector")
    means: dict[int, dict[int, float]] = {}
    for dim, at, m in rows.select("dim", F.posexplode("vector").alias("at", "x")).groupBy("dim", "at").agg(F.avg(F.col("x").cast("double"))).collect():  # a row for each component
        means.setdefault(dim, {})[at] = round(m, 6)  # sums differ in their last bits between runs
    if not means:
        return None
    arrays = {d: np.array([m[k] for k in range(d)]) for d, m in means.items()}
    return Index(scratch.table(rows.mapInArrow(_encoder(arrays), CODES), "codes"), arrays)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows in double precision, summed in the order of the components."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        d = a[:, k].astype(np.float64) - b[:, k].astype(np.float64)
        total += d * d
    return np.sqrt(total)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, but for rounding."""
    d = a.astype(np.float64) - b
    return np.einsum("ij,ij->i", d, d)


class Asked:
    """A block of queries: ids, vectors, and what their estimates need."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, mean: np.ndarray):
        self.ids, self.vectors, dim = ids, vectors, vectors.shape[1]
        x = vectors.astype(np.float64) - mean
        self.length = np.sqrt((x * x).sum(1)).astype(np.float32)
        unit = (x / np.where(self.length > 0, self.length, 1)[:, None]) @ rotation(dim)
        low, high = unit.min(1), unit.max(1)
        step = np.maximum(high - low, 1e-9) / (2**BITS - 1)
        level = np.rint((unit - low[:, None]) / step[:, None]).astype(np.uint8)
        self.low, self.step, self.total = low.astype(np.float32), step.astype(np.float32), unit.sum(1).astype(np.float32)
        self.planes = [packed((level >> j & 1).astype(bool)) for j in range(BITS)]

    def bounds(self, code: np.ndarray, length: np.ndarray, dot: np.ndarray, deviations: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of all squared distances to some codes, and how far off they may be."""
        dim, n, rows = self.vectors.shape[1], len(self.ids), len(code)
        inner = np.zeros((n, rows), np.float32)
        for j, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                inner += np.bitwise_count(plane[:, w, None] & code[None, :, w]).astype(np.float32) * np.float32(2**j)
        ones = np.bitwise_count(code).sum(1).astype(np.float32)
        inner *= 2 * self.step[:, None]
        inner += 2 * self.low[:, None] * ones[None, :]
        inner -= self.total[:, None]
        cross = (2 * length / (np.sqrt(dim) * dot)).astype(np.float32)  # for a query of length one
        inner *= cross[None, :] * -self.length[:, None]
        inner += (length**2).astype(np.float32)[None, :]
        inner += (self.length**2)[:, None]
        # of the code, and of the rounding of half the query's components by up to half a step
        code_part = np.maximum(1 - dot**2, 0) / max(dim - 1, 1) * dim
        slack = np.sqrt(code_part[None, :] + dim / 6 * self.step[:, None].astype(np.float64) ** 2).astype(np.float32)
        slack *= cross[None, :] * self.length[:, None] * np.float32(deviations)
        slack += 4e-6 * ((length**2).astype(np.float32)[None, :] + (self.length**2)[:, None])  # of single precision
        return inner, slack


def _scanner(query, k: int, dim: int, deviations: float):
    """query: broadcast Asked."""

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = query.value
        ids, vectors, n = asked.ids, asked.vectors, len(asked.ids)
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, vec_id, distance, by query and nearness
        limit = np.full(n, np.inf)  # squared
        size = max(CELLS // max(n, 1), 16)
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                b = batch.slice(lo, size)
                vec_id, rows = np.asarray(b.column(0)), matrix(b.column(4), dim)
                length, dot = np.asarray(b.column(2)), np.maximum(np.asarray(b.column(3)), 1e-9)
                code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(len(vec_id), -1)
                middle, slack = asked.bounds(code, length, dot, deviations)
                middle[ids[:, None] == vec_id[None, :]] = np.inf
                if len(vec_id) > 2 * k:  # the nearest by estimate bound the k-th distance
                    open_ = np.flatnonzero(np.isinf(limit))
                    near = np.argpartition(middle[open_], k - 1, axis=1)[:, :k]
                    for q, v in zip(open_, near, strict=True):
                        if np.isfinite(middle[q, v]).all():
                            limit[q] = squares(vectors[q][None, :], rows[v]).max()
                middle -= slack
                q, v = np.nonzero(middle <= (limit * (1 + 1e-6) + 1e-9).astype(np.float32)[:, None])
                for i in range(0, len(q), PAIRS):
                    qs, vs = q[i : i + PAIRS], v[i : i + PAIRS]
                    near = np.isfinite(middle[qs, vs])
                    qs, vs = qs[near], vs[near]
                    near = squares(vectors[qs], rows[vs]) <= limit[qs] * (1 + 1e-9) + 1e-300
                    qs, vs = qs[near], vs[near]
                    d = exact(vectors[qs], rows[vs])
                    q2, v2, d2 = (np.concatenate(x) for x in zip(best, (qs, vec_id[vs], d), strict=True))
                    by = np.lexsort((v2, d2, q2))
                    q2, v2, d2 = q2[by], v2[by], d2[by]
                    nth = np.arange(len(q2)) - np.searchsorted(q2, q2)
                    best = [x[nth < k] for x in (q2, v2, d2)]
                    last = nth[nth < k] == k - 1
                    limit[best[0][last]] = np.minimum(limit[best[0][last]], best[2][last] ** 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2], pa.float64())], ["query_id", "vec_id", "score"])

    return scan


def search(index: Index, queries: DataFrame, scratch: Scratch, k: int = 10, deviations: float = DEVIATIONS) -> DataFrame:
    """queries: vec_id, vector. The k nearest found of each: query_id, rank, vec_id, score, ties to the smaller vec_id.

    Each block of queries is finished and written before the next, so neither plans nor the driver grow with the queries.
    """
    spark = queries.sparkSession
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))  # at most k rows from each task
    folder, first = f"{scratch.path}/nearest", True
    for dim, mean in sorted(index.means.items()):
        asked = queries.filter(F.size("vector") == dim).groupBy("vec_id").agg(F.min("vector").alias("vector"))
        codes = index.codes.filter(F.col("dim") == dim).select("vec_id", "code", "length", "dot", "vector")
        rows, block = asked.toLocalIterator(), True
        while block:
            block = [x for _, x in zip(range(min(QUERY_BLOCK, max(COMPONENTS // dim, 1))), rows)]
            if not block:
                break
            held = spark.sparkContext.broadcast(Asked(np.array([x[0] for x in block], np.int64), np.array([x[1] for x in block], np.float32).reshape(-1, dim), mean))
            found = codes.mapInArrow(_scanner(held, k, dim, deviations), RESULT).withColumn("rank", rank).filter(F.col("rank") <= k)
            scratch.packed(found.select("query_id", "rank", "vec_id", "score")).write.mode("append").parquet(folder)
            held.unpersist()
            first = False
    if first:
        spark.createDataFrame([], NEAREST).write.mode("append").parquet(folder)
    return spark.read.schema(NEAREST).parquet(folder)


def op8_nearest(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    with Scratch(spark, table) as scratch:
        index = build(table, scratch)
        if index is None:
            return spark.createDataFrame([], NEAREST)
        return scratch.keep(search(index, index.codes.filter(F.col("vec_id") % 100 == 0).select("vec_id", "vector"), scratch))


OP8_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, sqrt(list_reduce(list_prepend(0::DOUBLE, list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - v.e[i]) * (q.e[i] - v.e[i]))), lambda a, x: a + x)) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10
"""
