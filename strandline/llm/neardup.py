"""Near-duplicate groups by one-permutation MinHash.

The distinct shingles of a text are hashed once; the top bits of a hash name one of 128 bins and each bin keeps its smallest hash. Empty
bins borrow from others by optimal densification. Four bins make a band; texts that share a band share a bucket. Texts of equal sets are
one node. In each bucket, edges run from two centres (the smallest id, and the smallest hash of an id) to the other members: a star, not
all pairs. Each edge is confirmed on the full sets. Then every bucket that still holds unconnected members is finished exactly: members
not connected to the centre are compared with all others of the bucket, in blocks of bounded size, and only edges that connect are
returned. Buckets that lead to one group hold mostly the same members, and are compared as one where that is no more work. Components of
the confirmed edges are the groups.

So two texts of similarity s >= 0.8 are missed only if they share none of the 32 bands: (1 - s^4)^32, under 5e-8. Sets hold 64-bit hashes
of shingles, and equal sets are known by two 64-bit sums of them.

Words are runs of [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased. With fewer words than a shingle, the whole sequence is one. Null and empty
texts have no shingles and are linked with nothing. Very long texts are hashed a word at a time; their sets are as long as they have
distinct shingles, and travel in Arrow batches bounded in bytes. Rows of equal doc_id are nodes of their own, judged each by its own text;
a component is named by the smallest doc_id of its rows, so that two components have one name if both hold a row of that id. A null doc_id
links nothing and has a null component. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import CHUNK, LOWER, NOT_SPACE, U64, chunks, lean, mix, per_row, shingles, span_hashes, spans
from ._spark import Scratch, small
from .components import components

BIN_BITS, ROWS = 7, 4
BINS = 1 << BIN_BITS
BANDS = BINS // ROWS
#: Members that are compared with as many others in one group of the exact pass.
BLOCK = 256
#: Members that are verified against one copy of their centre's set.
FAN = 512
#: Up to so many linked nodes, or open buckets, are broadcast (24 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
EMPTY = U64(2**64 - 1)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingle hashes by row and value, how many each row has)."""
    for i, j, buf, own in chunks(column, CHUNK // 2):
        low = LOWER[buf]
        starts, ends = spans(low, NOT_SPACE)
        h, n = shingles(span_hashes(low, starts, ends), per_row(starts, own), size)
        row = np.repeat(np.arange(j - i), n)
        by = np.lexsort((h, row))
        h, row = h[by], row[by]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield i, j, h[first], np.bincount(row[first], minlength=j - i)


def bands(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """BANDS hashes for each row; rows without shingles have meaningless ones."""
    rows = len(n)
    row, bin_ = np.repeat(np.arange(rows), n), (h >> U64(64 - BIN_BITS)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = (bin_[1:] != bin_[:-1]) | (row[1:] != row[:-1])
    own = np.full((rows, BINS), EMPTY, U64)
    own[row[first], bin_[first]] = h[first]
    out = own.copy()
    r, b = np.nonzero((own == EMPTY) & (n > 0)[:, None])
    attempt = 0
    while len(r):
        attempt += 1
        donor = (mix(np.arange(BINS, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(attempt)) >> U64(64 - BIN_BITS)).astype(np.int64)
        got = own[r, donor[b]]
        ok = got != EMPTY
        out[r[ok], b[ok]] = got[ok]
        r, b = r[~ok], b[~ok]
    total = np.broadcast_to(mix(np.arange(BANDS, dtype=U64) + U64(1)), (rows, BANDS)).copy()
    for k in range(ROWS):
        total = mix(total * U64(0xD1B54A32D192ED03) + out[:, k::ROWS])
    return total


def _sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    c = np.concatenate((np.zeros(1, U64), np.cumsum(x, dtype=U64)))
    end = np.cumsum(n)
    return c[end] - c[end - n]


def _list(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel().view(np.int64)))


def _sketcher(size: int):
    names = ["doc_id", "n", "k1", "k2", "bands"]

    @lean
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, h, n in shingle_sets(b.column(1), size):
                keys = [_sums(mix(h ^ U64(c)), n).view(np.int64) for c in (0x243F6A8885A308D3, 0x13198A2E03707344)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), *map(pa.array, keys), _list(bands(h, n))], names)

    return sketch


def _setter(size: int):
    @lean
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, h, n in shingle_sets(b.column(1), size):
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))], ["node", "s"])

    return sets


def _finisher(threshold: int):
    """Compares the asking rows of each group with its other rows; gives edges that connect different components."""

    def pairs(ask: list, other: list) -> Iterator[tuple[int, int]]:
        root: dict[int, int] = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        flat = np.concatenate([o[2] for o in other])
        size = np.array([len(o[2]) for o in other])
        values, at = np.unique(flat, return_inverse=True)
        begin = np.cumsum(size) - size
        for node, comp, s in ask:
            k = np.searchsorted(values, s).clip(max=len(values) - 1)
            hit = np.zeros(len(values), np.int64)
            hit[k[values[k] == s]] = 1
            both = np.add.reduceat(hit[at], begin)
            for m in np.flatnonzero(100 * both >= threshold * (len(s) + size - both)):
                a, b = find(comp), find(other[m][1])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    yield node, other[m][0]

    @lean
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ask, other = None, [], []

        def done():
            found = list(pairs(ask, other)) if ask and other else []
            ask.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["u", "v"])

        for b in batches:
            data, off = np.asarray(b.column(6).flatten()), np.asarray(b.column(6).offsets)
            off = off - off[0]
            for k, (h, mb, ub, asks, node, comp) in enumerate(zip(*(b.column(c).to_pylist() for c in range(6)), strict=True)):
                if (h, mb, ub) != now:
                    if now is not None and (out := done()).num_rows:
                        yield out
                    now = (h, mb, ub)
                (ask if asks else other).append((node, comp, data[off[k] : off[k + 1]].copy()))
        if now is not None:
            yield done()

    return finish


def near_duplicates(docs: DataFrame, scratch: Scratch, size: int = 5, threshold: int = 80, block: int = BLOCK) -> DataFrame:
    """docs: doc_id, text. A row for each: doc_id, n_shingles, component_id. threshold: least similarity in hundredths.

    The similarity of linked texts is the share of common `size`-word shingles among all of both.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").head(1):
        return _groups(docs, scratch, size, threshold, block)
    # ids that name several rows name no node: each row with an id gets a key, and each component the smallest id of its rows
    keyed = scratch.table(docs.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()).alias("row")), "keyed")
    found = _groups(keyed.select(F.col("row").alias("doc_id"), "text"), scratch, size, threshold, block)
    found = scratch.table(found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("component")), "found")
    ids = found.join(keyed.select("row", "doc_id"), "row")
    least = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return ids.join(least, "component").select("doc_id", "n_shingles", "component_id").unionAll(found.filter("row is null").select("row", "n_shingles", "component"))


def _groups(docs: DataFrame, scratch: Scratch, size: int, threshold: int, block: int) -> DataFrame:
    """near_duplicates of docs whose ids, where not null, are distinct."""
    rows = scratch.table(docs.mapInArrow(_sketcher(size), "doc_id long, n long, k1 long, k2 long, bands array<long>"), "sketches")
    some = rows.filter("n > 0 and doc_id is not null")
    nodes = scratch.table(some.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "bands")).alias("r")).select("k1", "k2", F.col("r.doc_id").alias("node"), "r.n", "r.bands"), "nodes")
    buckets = nodes.select("node", "n", F.explode("bands").alias("h"))
    me = F.struct("node", "n")
    centres = buckets.groupBy("h").agg(F.count(F.lit(1)).alias("many"), F.min(me).alias("c1"), F.min(F.struct(F.xxhash64("node", "h").alias("x"), "node", "n")).alias("c2")).filter("many > 1")
    members = scratch.table(buckets.join(centres.select("h", "many", "c1", F.struct("c2.node", "c2.n").alias("c2")), "h"), "members")
    close = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * threshold  # noqa: E731  else the sets cannot be similar enough
    star = members.select("node", "n", F.explode(F.array("c1", "c2")).alias("c")).filter((F.col("c.node") != F.col("node")) & close(F.col("n"), F.col("c.n")))
    star = scratch.table(star.select(F.col("node").alias("m"), F.col("c.node").alias("c")).distinct(), "star")
    again = members.filter("many > 2").select("node")
    needed = star.select(F.col("m").alias("node")).unionAll(star.select(F.col("c").alias("node"))).unionAll(again).distinct()
    texts = docs.withColumnRenamed("doc_id", "node").join(needed, "node")
    sets = scratch.table(texts.mapInArrow(_setter(size), "node long, s array<long>"), "sets")
    # a member has two centres a band at most, but a centre any number of members: its set goes out once for each FAN of them
    light = lambda df: F.broadcast(df) if small(df, BROADCAST_ROWS) else df  # noqa: E731  a shuffle by bucket would gather the largest one
    fans = scratch.table(star.groupBy(F.col("c").alias("node")).agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("copies")), "fans")
    copies = light(fans.filter("copies > 1"))
    salted = star.withColumnRenamed("c", "node").join(copies, "node", "left").select("m", F.col("node").alias("c"), F.pmod(F.xxhash64("m"), F.coalesce("copies", F.lit(1))).cast("int").alias("copy"))
    a = sets.select(F.col("node").alias("m"), F.col("s").alias("sm"))
    b = sets.join(light(fans), "node").select(F.col("node").alias("c"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("s").alias("sc"))
    both = F.size(F.array_intersect("sm", "sc"))
    similar = both * 100 >= (F.size("sm") + F.size("sc") - both) * threshold
    found = salted.join(a, "m").join(b, ["c", "copy"]).filter(similar)
    edges = scratch.table(found.select(F.greatest("m", "c").alias("u"), F.least("m", "c").alias("v")).distinct(), "edges")
    comp = components(edges, scratch, "first")
    # the members that no centre accounts for
    comp = light(comp)
    left = members.filter("many > 2").withColumn("lead", F.col("c1.node")).join(comp, "node", "left")
    left = left.join(comp.select(F.col("node").alias("lead"), F.col("component").alias("group")), "lead", "left")
    left = left.withColumn("component", F.coalesce("component", "node")).withColumn("asks", F.col("component") != F.coalesce("group", "lead"))
    left = left.filter((F.col("node") != F.col("c1.node")) & (F.col("node") != F.col("c2.node")))
    left = scratch.table(left.select("h", "node", "component", "asks", F.coalesce("group", "lead").alias("group")), "left")
    sizes = scratch.table(left.groupBy("h", "group").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("u")).filter("u > 0"), "sizes")
    left = scratch.table(left.join(light(sizes.select("h")), "h"), "open")
    # buckets of one group, whose members are mostly the same, are compared as one where that is no more work than one by one
    merged = scratch.table(left.groupBy("group", "node", "component").agg(F.bool_or("asks").alias("asks")), "merged")
    whole = merged.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("u"))
    apart = sizes.groupBy("group").agg(F.sum(F.col("n") * F.col("u")).alias("work"))
    dense = light(scratch.table(whole.join(apart, "group").filter(F.col("n") * F.col("u") <= F.col("work")).select("group", "n", "u"), "dense"))
    parts = [F.ceil(F.col(c) / block).cast("int").alias(b) for c, b in (("n", "mb"), ("u", "ub"))]
    one = merged.join(dense, "group").select(F.col("group").alias("h"), "node", "component", "asks", *parts)
    each = left.join(dense.select("group"), "group", "left_anti").join(light(sizes.select("h", "n", "u")), "h").select("h", "node", "component", "asks", *parts)
    rows_ = one.unionAll(each)  # a bucket and a group of one number would only be compared together
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    others = rows_.select("h", part(F.col("mb")).alias("mb"), F.explode(F.sequence(F.lit(0), F.col("ub") - 1)).alias("ub"), F.lit(False).alias("asks"), "node", "component")
    asking = rows_.filter("asks").select("h", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("mb"), part(F.col("ub")).alias("ub"), F.lit(True).alias("asks"), "node", "component")
    grid = others.unionAll(asking).join(sets, "node").select("h", "mb", "ub", "asks", "node", "component", "s")
    more = grid.repartition("h", "mb", "ub").sortWithinPartitions("h", "mb", "ub").mapInArrow(_finisher(threshold), "u long, v long")
    more = scratch.table(more.distinct(), "more")
    if more.head(1):
        comp = components(edges.unionAll(more), scratch, "second")
    named = nodes.select("k1", "k2", "node").join(comp, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component_id"))
    named = scratch.table(named, "named")
    found = rows.drop("bands").join(named, ["k1", "k2"], "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, docs) as scratch:
        found = near_duplicates(docs, scratch, size=2)
        return scratch.keep(found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM d, unnest(range(1, greatest(len(w), 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT s.doc_id, s.g, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.f, s.g) AS r FROM s JOIN (SELECT g, count(*) AS f FROM s GROUP BY g) f USING (g)),
p AS (SELECT k.doc_id, k.g FROM k JOIN n USING (doc_id) WHERE r <= n.n - ceil(n.n * 0.8) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b USING (g) WHERE a.doc_id < b.doc_id),
x AS (SELECT c.a, c.b, count(*) AS common FROM c JOIN s sa ON sa.doc_id = c.a JOIN s sb ON sb.doc_id = c.b AND sb.g = sa.g GROUP BY c.a, c.b),
e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
t AS (SELECT doc_id AS node, doc_id AS least FROM d UNION SELECT u.b, t.least FROM t JOIN u ON u.a = t.node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(least) AS c FROM t GROUP BY node) m ON m.node = d.doc_id
"""
