"""Vectorised byte work on Arrow text columns: chunks, words, 64-bit hashes.

All functions work on whole texts. A chunk holds documents of about a megabyte together, or one longer document alone, so that
the temporary arrays stay small whatever the size of an Arrow batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK = 1 << 20
#: Bytes of [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
TABLE = np.random.default_rng(20240601).integers(0, 2**64, 256, dtype=U64) | U64(1)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 512


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and the len + 1 offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array, limit: int = CHUNK):
    """(first row, end row, bytes, offsets) of runs of rows; the bytes of each row are followed by one space."""
    data, offsets = bytes_of(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        own = offsets[i : j + 1] - offsets[i] + np.arange(j - i + 1)
        out = np.full(own[-1], 0x20, np.uint8)
        keep = np.ones(own[-1], bool)
        keep[own[1:] - 1] = False
        out[keep] = data[offsets[i] : offsets[j]]
        yield i, j, out, own
        i = j


def spans(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes marked in the 256-entry table."""
    m = inside[buf]
    edge = np.flatnonzero(m[1:] != m[:-1]) + 1
    edge = np.concatenate(([0] * bool(len(m) and m[0]), edge, [len(m)] * bool(len(m) and m[-1]))).astype(np.int64)
    return edge[0::2], edge[1::2]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span stands; spans may overlap.

    Eight bytes at a time go through a bijection that isn't linear, so spans of up to eight bytes never collide with others of their
    length, and no family of texts collides by construction. Spans over LONG_SPAN bytes have a BLAKE2b hash.
    """
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(U64) * U64(0xD1B54A32D192ED03) + U64(0x9E3779B97F4A7C15 + seed))
    if not len(size):
        return out
    lanes = np.ndarray(len(buf), "<u8", np.concatenate((buf, np.zeros(8, np.uint8))), 0, (1,))  # eight bytes from each byte on
    at = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    k = 0
    while len(at):
        left = size[at] - 8 * k
        lane = lanes[starts[at] + 8 * k] & (U64(2**64 - 1) >> (U64(8) * (8 - np.minimum(left, 8)).astype(U64)))
        out[at] = mix(out[at] * U64(0xBF58476D1CE4E5B9) + lane)
        at = at[left > 8]
        k += 1
    for i in np.flatnonzero(size > LONG_SPAN):
        h = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        out[i] = int.from_bytes(h.digest(), "little")
    return out


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words of each document in turn, and how many each has; with fewer words, the whole sequence is one.

    words: hashes of the words of all documents; counts: words of each document.
    """
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.repeat(np.cumsum(counts) - counts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = np.repeat(np.minimum(counts, size), n)
    out = width.astype(U64)
    for k in range(size):
        at = first + k
        h = words[np.minimum(at, max(len(words) - 1, 0))] if len(words) else out
        out = np.where(k < width, mix(out * U64(0xD1B54A32D192ED03) + h), out)
    return out, n


def per_row(positions: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many of the ascending positions fall in each row of a chunk."""
    return np.diff(np.searchsorted(positions, own))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, for work that makes Python objects of them."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def lean(f: Callable) -> Callable:
    """f over the batches of a partition, after which the worker gives its free memory back: it goes on to serve other stages."""

    @functools.wraps(f)
    def run(batches):
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run
