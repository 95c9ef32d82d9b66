"""Exact removal of repeated passages with a run-length index.

A byte is removed if a string of `length` bytes that covers it also starts earlier: in a document of smaller id, or earlier in the same
document. Strings are judged on the input; matches never cross documents.

1. Documents equal to one of a smaller id go as a whole; only the first of equal texts is looked at further.
2. Every window of `length` bytes has an anchor: the rightmost of its k-grams with the smallest hash. Equal windows have equal anchors.
   Windows in a row with equal anchors form a block; a row goes out for each block (one every 35 bytes or so, fewer in periodic text),
   and rows meet by the anchor's hash. Equal blocks: all but the first are repeats. Blocks that share an anchor and differ, or hold it
   several times, go to the index. Rows of a crowded anchor are summed by block before they meet, so copies never gather in a task.
3. A shard of the index is the concatenation of such blocks, in order of document and place. From its suffixes comes the Burrows-Wheeler
   transform, kept as runs, with a sample at each run's first and last row: text position, that of the row before or after, and the common
   prefix with it. Between samples these move along with the text, so the matching statistics of the whole shard against the rest of it
   are streamed from the samples. Windows with a statistic of `length` or more are the long matches; of each class of equal windows, a
   chain of neighbouring rows, the first stays.
4. An anchor with so many different blocks that they would not fit a shard has its windows compared by 128-bit hashes in an aggregation.

Null texts are empty. Rows of equal id and text are one document; of several texts with one id the one with the smaller hash comes
first; null ids come last. Texts under `length` bytes lose nothing. A very long text is hashed SEGMENT bytes at a time, and only its asked
blocks are cut out. An empty table gives an empty result. Extra columns are not read. Equality of documents rests on 128 bits of SHA-256,
that of blocks on two 64-bit hashes; windows in the index are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import TABLE, U64, bytes_of, chunks, lean, slices, span_hashes
from ._spark import Scratch, small

LENGTH, GRAM = 100, 32
#: Bytes of text hashed at once; bytes of blocks in a shard of the index; blocks of an anchor beyond which its windows are aggregated.
SEGMENT, SHARD, HOT = 1 << 18, 1 << 19, 2048
#: Rows of an anchor beyond which its blocks are summed before they meet, in a large corpus beyond a few times the mean of a counter; rows
#: are counted by so many low bits of anchors.
CROWD, COUNTERS = 4096, 16
#: Windows of a block; more of equal anchors make further blocks.
MOST_WINDOWS = 256
#: Up to so many ids of copies of texts, or hot anchors, are broadcast; beyond, they are joined by shuffle.
BROADCAST_COPIES = 1_000_000
SPAN = "key long, start long, end long"


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of each run of GRAM bytes, by doubling."""
    h, n = TABLE[b], 1
    for k in range(GRAM.bit_length() - 1):
        h = h[:-n] * U64(0x9E3779B97F4A7C15 + 2 * k) + h[n:]
        n *= 2
    h ^= h >> U64(31)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    return h


def blocks(buf: np.ndarray, own: np.ndarray, length: int):
    """(row, place, anchor hash, block hash) of each block of a chunk.

    A place is the start in the row, whether the anchor stands in the block several times, and the number of windows, in one number.
    """
    width = length - GRAM + 1
    if len(buf) < length:
        return
    for lo in range(0, len(buf) - length + 1, SEGMENT):
        b = buf[lo : lo + SEGMENT + length - 1]
        n = len(b) - length + 1
        h = gram_hashes(b)
        low = U64((1 << 24) - 1)
        m = (h & ~low) | (low - np.arange(len(h), dtype=U64))
        size = 1
        while size * 2 <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        m = np.minimum(m[:n], m[width - size : width - size + n])
        at = (low - (m & low)).astype(np.int64)
        valid = np.ones(n, bool)
        r0, r1 = np.searchsorted(own, lo, "right") - 1, np.searchsorted(own, lo + n, "left")
        for e in own[r0 + 1 : r1 + 1]:  # windows that reach the end of a row or the space after it
            valid[max(e - length - lo, 0) : max(e - lo, 0)] = False
        anchor = h[at]
        on = valid[1:] & valid[:-1] & (anchor[1:] == anchor[:-1])
        start, stop = np.flatnonzero(valid & ~np.concatenate(([False], on))), np.flatnonzero(valid & ~np.concatenate((on, [False])))
        if not len(start):
            continue
        again = at[start] != at[stop]  # the anchor stands here several times
        windows = stop - start + 1
        pieces = -(-windows // MOST_WINDOWS)
        if pieces.max() > 1:
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, again = np.repeat(start, pieces) + nth * MOST_WINDOWS, np.repeat(again, pieces)
            windows = np.minimum(np.repeat(windows, pieces) - nth * MOST_WINDOWS, MOST_WINDOWS)
        whole = span_hashes(b, start, start + windows + length - 1)
        row = np.searchsorted(own, start + lo, "right") - 1
        yield row, (start + lo - own[row]) << 16 | again.astype(np.int64) << 15 | windows, anchor[start], whole


def _anchors(length: int):
    @lean
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.asarray(b.column(0))
            for i, _, buf, own in chunks(b.column(1), SEGMENT):
                for row, at, fp, whole in blocks(buf, own, length):
                    yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(keys[i + row]), pa.array(at)], ["fp", "block", "key", "at"])

    return anchors


def _meet(length: int):
    """Rows come by anchor, block, key and place: repeats of a block give spans. Firsts of blocks are asked for if their anchor has
    several blocks or stands in the block several times."""
    names = ["key", "at", "fp", "ask"]

    def out(key, at, fp, ask):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(at), pa.array(fp), pa.array(np.full(len(key), ask))], names)

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # anchor and block of the last row
        held = [np.zeros(0, np.int64)] * 3  # anchor, key, place of the last first
        before = False  # whether the anchor before the held one is the same
        for b in batches:
            fp, block, key, at = (np.asarray(c) for c in b.columns)
            if not len(fp):
                continue
            new = np.ones(len(fp), bool)
            new[1:] = (fp[1:] != fp[:-1]) | (block[1:] != block[:-1])
            new[0] = last is None or last != (fp[0], block[0])
            last = (fp[-1], block[-1])
            if not new.all():
                yield out(key[~new], at[~new], fp[~new], False)
            f, k, a = (np.concatenate((x, y[new])) for x, y in zip(held, (fp, key, at), strict=True))
            if not len(f):
                continue
            same = f[1:] == f[:-1]
            several = np.concatenate(([before], same)) | np.concatenate((same, [False])) | (a >> 15 & 1 == 1)
            before = bool(several[-1])
            if several[:-1].any():
                yield out(k[:-1][several[:-1]], a[:-1][several[:-1]], f[:-1][several[:-1]], True)
            held = [f[-1:], k[-1:], a[-1:]]
        if len(held[0]) and before:
            yield out(held[1], held[2], held[0], True)

    return meet


def _cut(length: int):
    """The bytes of the asked blocks of each text."""

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, off = bytes_of(b.column(1))
            out, size = [[] for _ in range(5)], 0
            for key, i, asked in zip(b.column(0).to_pylist(), off[:-1].tolist(), b.column(2).to_pylist(), strict=True):
                for x in asked:
                    start, windows = x["at"] >> 16, x["at"] & 0x7FFF
                    for o, v in zip(out, (x["shard"], x["hot"], key, start, data[i + start : i + start + windows + length - 1].tobytes()), strict=True):
                        o.append(v)
                    size += windows + length
                if size > SHARD:
                    yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "hot", "key", "start", "bytes"])
                    out, size = [[] for _ in range(5)], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "hot", "key", "start", "bytes"])

    return cut


class RunLengthIndex:
    """The run-compressed Burrows-Wheeler transform of some strings, with samples at the first and last row of each run.

    A string ends in a separator below all bytes; of equal suffixes that of the earlier string comes first. heads: the symbol of each
    run (0 the separator, else byte + 1) and its first row. first, last: text positions of the runs' first and last rows in ascending
    order, with the text position of the row before (after) and the length of the prefix common with it. Suffixes are sorted to build the
    transform and not kept: what is kept has an entry for each run, and all that is asked is streamed from the samples.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
        n = int(self.offsets[-1])
        symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        end = np.repeat(self.offsets[1:] - 1, sizes + 1)  # the separator after each position
        symbols[self.offsets[1:] - 1] = 0
        place = np.arange(n)
        left = end - place  # bytes before the separator
        # ranks of prefixes of 7, 14, 28 ... bytes; a prefix does not go past its separator
        key = np.zeros(n, np.int64)
        for k in range(7):
            key = key << 9 | np.where(k <= left, symbols[np.minimum(place + k, n - 1)], 0)
        ranks, width = [], 7
        while True:
            order = np.argsort(key)
            sorted_ = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([1], sorted_[1:] != sorted_[:-1])))
            ranks.append(rank.astype(np.int32))
            if width > sizes.max(initial=0):
                break
            key = rank * (n + 1) + np.where(width <= left, rank[np.minimum(place + width, n - 1)], 0)
            width *= 2
        suffixes = np.argsort(rank * n + place)
        bwt = symbols[suffixes - 1]
        bwt[place[suffixes] == 0] = 0
        edge = np.ones(n + 1, bool)
        edge[1:-1] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
        rows = np.flatnonzero(edge)
        self.heads = bwt[rows[:-1]], rows[:-1]
        first, last = rows[:-1], rows[1:] - 1

        def sample(row, other):
            """Position of each row, that of another row, and their common prefix (0 if there is no other)."""
            there = (other >= 0) & (other < n)
            p, q = suffixes[row], suffixes[np.where(there, other, row)]
            a, b = p.copy(), q.copy()
            for r, w in zip(reversed(ranks), (7 << k for k in reversed(range(len(ranks)))), strict=True):
                ok = (left[a] >= w) & (left[b] >= w) & (r[a] == r[b])
                a, b = a + w * ok, b + w * ok
            for _ in range(7):
                ok = (symbols[a] == symbols[b]) & (symbols[a] > 0)
                a, b = a + ok, b + ok
            by = np.argsort(p)
            return p[by], q[by], np.where(there, a - p, 0)[by]

        self.first, self.last = sample(first, first - 1), sample(last, last + 1)

    def statistics(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """At each text position: the position of the row before and the common prefix with it, and the same of the row after.

        Inside a run the row before moves along with the position, and the common prefix falls by one with each byte. A position without
        a row before (after) has a common prefix of 0.
        """
        place = np.arange(int(self.offsets[-1]))

        def stream(samples):
            k = np.searchsorted(samples[0], place, "right") - 1
            by = np.where(k >= 0, place - samples[0][k], 0)
            return np.where(k >= 0, samples[1][k] + by, 0), np.where(k >= 0, np.maximum(samples[2][k] - by, 0), 0)

        return *stream(self.first), *stream(self.last)

    def repeats(self, length: int) -> np.ndarray:
        """Text positions whose next `length` bytes also stand at an earlier position, ascending.

        Rows with a statistic of `length` or more chain positions of equal windows; the first of a chain is found by doubling its links.
        """
        above, before, below, after = self.statistics()
        p = np.flatnonzero(np.maximum(before, after) >= length)
        if not len(p):
            return p
        at = np.zeros(int(self.offsets[-1]), np.int64)
        at[p] = np.arange(len(p))
        least = p
        for other, common in ((above, before), (below, after)):
            link, low = np.where(common[p] >= length, at[other[p] * (common[p] >= length)], np.arange(len(p))), p
            while True:
                low, further = np.minimum(low, low[link]), link[link]
                if np.array_equal(further, link):
                    break
                link = further
            least = np.minimum(least, low)
        return p[p != least]


def _runs(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of consecutive numbers."""
    gap = np.flatnonzero(np.diff(p) != 1)
    return p[np.concatenate(([0], gap + 1))], p[np.concatenate((gap, [len(p) - 1]))]


def _index(length: int):
    """Rows come by shard, key and start."""

    @lean
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done():
            x = RunLengthIndex([h[2] for h in held])
            p = x.repeats(length)
            if not len(p):
                return None
            k = np.searchsorted(x.offsets, p, "right") - 1
            a, b = _runs(p + k * length)  # runs of two strings never meet
            k = np.searchsorted(x.offsets + np.arange(len(x.offsets)) * length, a, "right") - 1
            shift = np.array([h[1] for h in held])[k] - x.offsets[k] - k * length
            return pa.RecordBatch.from_arrays([pa.array(np.array([h[0] for h in held])[k]), pa.array(a + shift), pa.array(b + shift + length)], ["key", "start", "end"])

        for b in slices(batches, 1024):
            for shard, key, start, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != now:
                    if held and (out := done()) is not None:
                        yield out
                    now, held = shard, []
                held.append((key, start, data))
        if held and (out := done()) is not None:
            yield out

    return index


def _windows(length: int):
    """Two 64-bit hashes of each window of the blocks of hot anchors."""

    @lean
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, off = bytes_of(b.column(2))
            n = np.diff(off) - length + 1
            at = np.repeat(off[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(np.asarray(b.column(1)), n) + at - np.repeat(off[:-1], n)
            key = np.repeat(np.asarray(b.column(0)), n)
            yield pa.RecordBatch.from_arrays([*(pa.array(span_hashes(data, at, at + length, seed).view(np.int64)) for seed in (1, 2)), pa.array(key), pa.array(start)], ["w1", "w2", "key", "start"])

    return windows


def with_keys(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The texts that are looked at (key, text), and a row for each row of docs: doc_id, key, n_bytes, sha, copy.

    key orders the documents; it is the doc_id unless ids are null or stand for several texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sha = F.sha2(F.col("text").cast("binary"), 256)
    base = scratch.table(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), sha.alias("sha")), "base")
    first = scratch.table(base.groupBy("sha").agg(F.min("doc_id").alias("first")), "first")
    state = first.agg(F.count(F.lit(1)), F.count_distinct("first")).head()
    copy = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    base = scratch.table(base.join(first, "sha").select("doc_id", "first", "n_bytes", "sha", copy.alias("copy")), "rows")
    gone = base.filter("copy").select("doc_id").distinct()
    # ids tell the texts apart if no text's first row has the id of another's, be that a first row too or a copy
    if state[0] == state[1] and not gone.join(first.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").head(1):
        # copies differ from all others by their id; a null id is that of a copy
        base = base.withColumnRenamed("first", "key")
        gone = F.broadcast(gone) if small(gone, BROADCAST_COPIES) else gone
        texts = docs.filter("doc_id is not null").join(gone, "doc_id", "left_anti").select(F.col("doc_id").alias("key"), "text")
        if base.filter("not copy").count() > state[0]:  # whole rows that repeat
            texts = texts.distinct()
    else:
        order = first.select("first", "sha").orderBy(F.col("first").asc_nulls_last(), "sha")  # numbers ascend with the sorted partitions
        keyed = scratch.table(order.select("sha", F.monotonically_increasing_id().alias("key")), "keyed")
        base = scratch.table(base.join(keyed, "sha").select("doc_id", "key", "n_bytes", "sha", "copy"), "keyed_rows")
        texts = docs.withColumn("sha", sha).dropDuplicates(["sha"]).join(keyed, "sha").select("key", "text")
    return texts, base


def _beside(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """texts joined with marks, which may be as many as the texts, by key."""
    return texts.join(marks.hint("merge"), "key")


def _meetings(blocks_: DataFrame, scratch: Scratch, length: int, crowd: int) -> DataFrame:
    """key, at, fp, ask: repeats of blocks, and firsts of blocks that the index is asked for.

    An anchor's blocks meet in one task, as a stream. Where that would be too many, they are summed by anchor and block first, so that
    copies never gather, and the rows then join their block's first: rows of one anchor spread over tasks.
    """
    total = blocks_.count()
    part = F.col("fp").bitwiseAND((1 << COUNTERS) - 1)
    counts = blocks_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # no more rows than there are counters
    crowded = scratch.table(counts.filter(F.col("n") > max(crowd, (total >> COUNTERS) * 8)).select("part"), "crowded")
    meet = lambda rows: rows.repartition("fp").sortWithinPartitions("fp", "block", "key", "at").mapInArrow(_meet(length), "key long, at long, fp long, ask boolean")
    if not crowded.head(1):
        return scratch.table(meet(blocks_), "met")
    beside = blocks_.withColumn("part", part).join(F.broadcast(crowded.withColumn("many", F.lit(True))), "part", "left")
    rows = beside.filter("many").select("fp", "block", "key", "at")
    firsts = scratch.table(rows.groupBy("fp", "block").agg(F.min(F.struct("key", "at")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    copied = firsts.filter("n > 1").drop("n")
    copied = F.broadcast(copied) if small(copied, BROADCAST_COPIES) else copied
    again = rows.join(copied, ["fp", "block"]).filter(F.struct("key", "at") != F.col("first")).select("key", "at", "fp", F.lit(False).alias("ask"))
    several = firsts.groupBy("fp").agg(F.count(F.lit(1)).alias("blocks"), F.bool_or(F.col("first.at").bitwiseAND(1 << 15) != 0).alias("twice")).filter("blocks > 1 or twice").select("fp")
    several = F.broadcast(several) if small(several, BROADCAST_COPIES) else several
    asked = firsts.join(several, "fp", "left_semi").select("first.key", "first.at", "fp", F.lit(True).alias("ask"))
    return scratch.table(meet(beside.filter("many is null").select("fp", "block", "key", "at")), "met").unionAll(scratch.table(again, "met_again")).unionAll(scratch.table(asked, "met_asked"))


def find_spans(texts: DataFrame, scratch: Scratch, length: int = LENGTH, shard: int = SHARD, hot: int = HOT, crowd: int = CROWD) -> DataFrame:
    """texts: key, text, of distinct texts. (key, spans array<struct<start, end>>) of those with repeats."""
    long = texts.filter(F.octet_length("text") >= length)
    met = _meetings(scratch.table(long.mapInArrow(_anchors(length), "fp long, block long, key long, at long"), "blocks"), scratch, length, crowd)
    scratch.drop("blocks")
    asked = met.filter("ask").select("key", "at", "fp")
    start, windows = F.shiftright("at", 16), F.col("at").bitwiseAND(0x7FFF)
    found = met.filter("not ask").select("key", start.alias("start"), (start + windows + (length - 1)).alias("end"))
    total = asked.agg(F.count(F.lit(1)), F.sum(windows + length)).head()
    if total[0]:
        many = asked.groupBy("fp").count().filter(F.col("count") > hot).select("fp", F.lit(True).alias("hot"))
        few = small(many, BROADCAST_COPIES)
        shards = max(1, -(-int(total[1]) // shard))
        asked = asked.join(F.broadcast(many) if few else many, "fp", "left").select("key", "at", F.coalesce("hot", F.lit(False)).alias("hot"), F.pmod(F.xxhash64("fp"), F.lit(shards)).cast("int").alias("shard"))
        by_text = asked.groupBy("key").agg(F.collect_list(F.struct("at", "shard", "hot")).alias("asked"))  # no more than the text has
        cut = scratch.table(_beside(long, by_text).select("key", "text", "asked").mapInArrow(_cut(length), "shard int, hot boolean, key long, start long, bytes binary"), "cut")
        cold = cut.filter("not hot").select("shard", "key", "start", "bytes").repartition(shards, "shard").sortWithinPartitions("shard", "key", "start")
        found = found.unionAll(cold.mapInArrow(_index(length), SPAN))
        if many.head(1):
            w = scratch.table(cut.filter("hot").select("key", "start", "bytes").mapInArrow(_windows(length), "w1 long, w2 long, key long, start long"), "windows")
            least = w.groupBy("w1", "w2").agg(F.min(F.struct("key", "start")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
            least = scratch.table(least, "least_windows")
            again = w.join(F.broadcast(least) if small(least, BROADCAST_COPIES) else least, ["w1", "w2"]).filter(F.struct("key", "start") != F.col("least"))
            found = found.unionAll(again.select("key", "start", (F.col("start") + length).alias("end")))
    return scratch.table(found.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@lean
def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        data, off = bytes_of(b.column(1))
        out = []
        for key, i, j, spans in zip(b.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), b.column(2).to_pylist(), strict=True):
            runs, at, h = merged(spans), i, hashlib.sha256()
            for x, y in runs:
                h.update(data[at : i + x])
                at = i + y
            h.update(data[at:j])
            out.append((key, sum(y - x for x, y in runs), len(runs), h.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["key", "n_removed", "n_spans", "kept_sha256"])


def digests(texts: DataFrame, base: DataFrame, spans: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """A row for each row of base: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    cut = scratch.table(_beside(texts, spans).select("key", "text", "spans").mapInArrow(_remove, "key long, n_removed long, n_spans long, kept_sha256 string"), "removed")
    whole = F.col("copy") & (F.col("n_bytes") >= length)
    out = base.join(cut, "key", "left")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def keep_text(text: bytes, spans: list[dict]) -> str:
    """What is left of a text; a character of which only a part would go stays."""
    at, parts = 0, []
    for x, y in merged(spans):
        while x < y and text[x] & 0xC0 == 0x80:
            x += 1
        while y > x and y < len(text) and text[y] & 0xC0 == 0x80:
            y -= 1
        parts.append(text[at:x])
        at = y
    return b"".join([*parts, text[at:]]).decode("utf-8", "replace")


@lean
def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        text, chars, spans = (b.column(k).to_pylist() for k in (1, 4, 5))
        stays = [True] * len(text)
        for k, s in enumerate(spans):
            if s is not None:
                text[k] = keep_text((text[k] or "").encode(), s)
                chars[k] = len(text[k])
                stays[k] = bool(text[k].strip())
        out = pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), b.column(2), b.column(3), pa.array(chars, pa.int64())], ["doc_id", "text", "lang", "source", "n_chars"])
        yield out.filter(pa.array(stays))


def repeat_marks(base: DataFrame, spans: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, h, spans: what goes of each document that loses anything; h is the hash of its text."""
    whole = F.col("copy") & (F.col("n_bytes") >= length)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    marks = base.join(spans, "key", "left").select(F.col("doc_id").alias("id"), F.col("sha").alias("h"), F.when(whole, everything).otherwise(F.col("spans")).alias("spans"))
    return marks.filter("spans is not null").dropDuplicates(["id", "h"])


def without_repeats(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) with repeats cut out, and without documents of which nothing but space is left."""
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    joined = rows.join(marks.hint("merge"), rows["doc_id"].eqNullSafe(F.col("id")) & (sha == F.col("h")), "left").drop("id", "h")
    return joined.mapInArrow(_rewrite, "doc_id long, text string, lang string, source string, n_chars long")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, docs) as scratch:
        texts, base = with_keys(docs, scratch)
        return scratch.keep(digests(texts, base, find_spans(texts, scratch), scratch))
