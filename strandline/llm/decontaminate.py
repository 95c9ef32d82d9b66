"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ten consecutive words (an item of fewer words, but not none, is one window). The shingles of a window are
its pairs of neighbouring words (its word, if it has one), ordered by rarity over all documents. A text that holds a window holds all its
shingles, so a prefix of one, the rarest, is necessary: documents are joined with windows on it, by an equi join that Spark deals out. The
place of the shingle in the window and the words around it in the document bound where the window can stand, and the words there are
compared with the window's, as texts.

Only shingles that may be a window's leave the documents: a bit array of fixed size, the same for any benchmark, tells the most others
apart. It is all that is broadcast and all that comes to the driver; the benchmark and its windows stay distributed. A full array lets
more shingles through and changes no result.

Words are the maximal runs of 0-9, a-z and bytes from 0x80 after A-Z are lower-cased. Null and empty texts have no words and hit nothing.
Items with a null id or no words take no part; items of equal id are one. Very long texts are cut into words a megabyte at a time, or whole
if one is longer; what leaves a text is bounded by its words. Rows of equal or null doc_id are judged each on its own. An empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import ALNUM, LOWER, U64, chunks, lean, mix, per_row, slices, span_hashes, spans
from ._spark import Scratch

WINDOW = 10
#: Bits by which a shingle is looked up in the broadcast array: 2**26 bits are 8 MB.
FILTER_BITS = 26
#: Rows that leave a task at once.
ROWS = 4096
ROW = "r long, n_words long, shingle long, place int, before int, context array<string>"


def tokens(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, and starts, ends and hashes of the words."""
    low = LOWER[buf]
    starts, ends = spans(low, ALNUM)
    return low, starts, ends, span_hashes(low, starts, ends)


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of each word with the next."""
    return mix(h[:-1] * U64(0xD1B54A32D192ED03) + h[1:])


def single_hashes(h: np.ndarray) -> np.ndarray:
    return mix(h ^ U64(0x243F6A8885A308D3))


def _words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> list[str]:
    """The words from the a-th up to the b-th."""
    return [low[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]


def _windows(size: int):
    @lean
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for i, j, buf, own in chunks(b.column(1)):
                low, starts, ends, h = tokens(buf)
                last = np.cumsum(per_row(starts, own)).tolist()
                pairs, single = pair_hashes(h).view(np.int64), single_hashes(h).view(np.int64)
                for item, lo, hi in zip(b.column(0).slice(i, j - i).to_pylist(), [0, *last[:-1]], last, strict=True):
                    words, out = _words(low, starts, ends, lo, hi), []
                    for k in range(max(len(words) - size + 1, min(len(words), 1))):
                        n = min(size, len(words))
                        out.append((item, n, words[k : k + n], (pairs[lo + k : lo + k + n - 1] if n > 1 else single[lo + k : lo + k + 1]).tolist()))
                    for x in range(0, len(out), ROWS):
                        part = list(zip(*out[x : x + ROWS], strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)], ["item", "n", "words", "shingles"])

    return windows


def bit_array(shingles: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits of which those of the shingles (a column `shingle`) are set, as 64-bit words."""
    words = shingles.select(F.shiftright("shingle", 6).bitwiseAND((1 << (bits - 6)) - 1).cast("int").alias("w"), F.expr("shiftleft(1L, cast(shingle & 63 as int))").alias("x"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for w, x in words.groupBy("w").agg(F.bit_or("x").alias("x")).toLocalIterator():  # no more rows than the array has words
        out[w] = x
    return out.view(U64)


def held(array: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (array[((h >> U64(6)) & U64(len(array) - 1)).astype(np.int64)] >> (h & U64(63)) & U64(1)).astype(bool)


def _candidates(h: np.ndarray, many: np.ndarray, arrays: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of the shingles that the arrays for pairs and for single words hold. many: the words of each row."""
    if not len(h):
        return []
    out = []
    pairs = pair_hashes(h)
    inside = np.ones(len(h), bool)
    inside[np.cumsum(many)[many > 0] - 1] = False  # the last word of a row has no next
    at = np.flatnonzero(inside[:-1] & held(arrays[0], pairs))
    out.append((at, pairs[at]))
    if arrays[1].any():
        single = single_hashes(h)
        at = np.flatnonzero(held(arrays[1], single))
        out.append((at, single[at]))
    return out


def _counter(arrays):
    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, own in chunks(batch.column(0)):
                _, starts, _, h = tokens(buf)
                for _, x in _candidates(h, per_row(starts, own), arrays.value):
                    value, n = np.unique(x, return_counts=True)
                    if len(value):
                        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["shingle", "n"])

    return count


def _seeker(arrays, size: int, kept: list[str]):
    names = ["r", "n_words", "shingle", "place", "before", "context"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))

    @lean
    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, without a shingle, and one for each shingle that may be a window's prefix, with the words around it."""
        for batch in batches:
            n, words = batch.num_rows, np.zeros(batch.num_rows, np.int64)
            keys = batch.column(0).to_pylist()
            for lo, hi, buf, own in chunks(batch.column(1)):
                low, starts, ends, h = tokens(buf)
                many = per_row(starts, own)
                words[lo:hi] = many
                last = np.cumsum(many)
                for at, x in _candidates(h, many, arrays.value):
                    row = np.searchsorted(last, at, "right")
                    for k in range(0, len(at), ROWS):
                        out = []
                        for p, r, s in zip(at[k : k + ROWS].tolist(), row[k : k + ROWS].tolist(), x[k : k + ROWS].view(np.int64).tolist(), strict=True):
                            first, end = int(last[r] - many[r]), int(last[r])
                            a = max(first, p - size + 1)
                            out.append((keys[lo + r], None, s, p - first, p - a, _words(low, starts, ends, a, min(end, p + size))))
                        none = [pa.nulls(len(out), c.type) for c in batch.columns[2:]]
                        yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], *none], [*names, *kept])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), *[pa.nulls(n, t) for t in kinds[2:]], *batch.columns[2:]], [*names, *kept])

    return seek


def prefixes(windows: DataFrame, docs: DataFrame, scratch: Scratch, bits: int) -> DataFrame:
    """n, words, shingle and its place of each distinct window of which some document holds the rarest shingle; ties by hash, then place."""
    spark = windows.sparkSession
    distinct = scratch.table(windows.select("n", "words", "shingles").distinct(), "distinct")
    of = distinct.select("n", "words", F.posexplode("shingles").alias("place", "shingle"))
    arrays = spark.sparkContext.broadcast(tuple(bit_array(of.filter(c).select("shingle"), bits) for c in ("n > 1", "n = 1")))
    counts = scratch.table(docs.select("text").mapInArrow(_counter(arrays), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("count")), "counts")
    ranked = of.join(counts, "shingle", "left")
    first = ranked.groupBy("n", "words").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "place")).alias("p"))
    return scratch.table(first.filter("p.count > 0").select("n", "words", "p.shingle", F.col("p.place").alias("offset")), "prefixes")


def find_contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, size: int = WINDOW, bits: int = FILTER_BITS, keep=()) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_hit, item_ids (those with occurring windows, sorted) and runs of hit words.

    keep: columns of docs that are carried along.
    """
    spark = docs.sparkSession
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    windows = scratch.table(items.mapInArrow(_windows(size), "item string, n int, words array<string>, shingles array<long>"), "windows")
    prefix = prefixes(windows, docs, scratch, bits)
    arrays = spark.sparkContext.broadcast(tuple(bit_array(prefix.filter(c).select("shingle"), bits) for c in ("n > 1", "n = 1")))
    # a row is numbered in the one pass that writes both the row and what is found in it
    rows = docs.select(F.monotonically_increasing_id().alias("r"), "text", F.col("doc_id").cast("long").alias("k0"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keep, 1)])
    kept = rows.columns[2:]
    found = scratch.table(rows.mapInArrow(_seeker(arrays, size, kept), ", ".join([ROW, *(f"{k} {t}" for k, t in rows.select(*kept).dtypes)])), "found")
    at = found.filter("shingle is not null").select("r", "shingle", "place", "before", "context").join(prefix, "shingle").filter("before >= offset")
    whole = F.slice("context", F.greatest(F.col("before") - F.col("offset"), F.lit(0)) + 1, F.col("n")) == F.col("words")
    hits = scratch.table(at.filter(whole).select("r", (F.col("place") - F.col("offset")).alias("start"), "n", "words"), "hits")
    spans_ = hits.select("r", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    order = Window.partitionBy("r").orderBy("start", "end")  # no more rows than the document has words
    apart = F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans_.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("r", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy("r").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))
    of = hits.select("r", "n", "words").distinct().join(windows.select("item", "n", "words").distinct(), ["n", "words"])
    of = of.select("r", "item").distinct().groupBy("r").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    out = found.filter("shingle is null").join(runs.join(of, "r"), "r", "left")
    none = F.array().cast("array<string>"), F.array().cast("array<struct<start:int,end:int>>")
    return out.select(
        F.col("k0").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none[0]).alias("item_ids"),
        F.coalesce("runs", none[1]).alias("runs"), *[F.col(f"k{i}").alias(k) for i, k in enumerate(keep, 1)],
    )


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, docs) as scratch:
        out = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch)
        joined = F.array_join("item_ids", ",")
        return scratch.keep(out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")))


OP6_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
      FROM bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM b),
d AS (SELECT doc_id, i, lens.n AS n, array_to_string(w[i:i + lens.n - 1], ' ') AS s FROM dw, lens, unnest(range(1, len(w) - lens.n + 2)) AS r(i)),
h AS (SELECT doc_id, i, d.n, item_id FROM d JOIN b ON d.n = b.n AND d.s = b.s),
hits AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
