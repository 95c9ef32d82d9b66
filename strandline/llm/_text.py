"""Letters of whole texts as arrays of code points, and labelled samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import bytes_of

#: Code points below this have table entries; the few above are looked up one by one.
_TOP = 0x20000
_tables: dict = {}


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code point, and whether it is a letter, by code point."""
    if "lower" not in _tables:
        chars = [chr(c) for c in range(_TOP)]
        _tables["lower"] = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint32)
        _tables["letter"] = np.array([c.isalpha() for c in chars])
    return _tables["lower"], _tables["letter"]


def code_points(column: pa.Array, limit: int):
    """(first row, end row, lower-case code points, letter flags, offsets) of runs of rows; invalid bytes become U+FFFD."""
    data, offsets = bytes_of(column)
    lower, letter = tables()
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        part = data[offsets[i] : offsets[j]]
        # a code point begins at each byte that isn't a continuation
        own = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))[offsets[i : j + 1] - offsets[i]]
        cp = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        if len(cp) != own[-1]:  # some bytes are not UTF-8
            texts = [part[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i], strict=True)]
            own = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
            cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        low = cp < _TOP
        if low.all():
            yield i, j, lower[cp], letter[cp], own
        else:
            at = np.minimum(cp, _TOP - 1)
            rare, back = np.unique(cp[~low], return_inverse=True)
            c, f = lower[at], letter[at]
            c[~low] = rare[back]
            f[~low] = np.array([chr(x).isalpha() for x in rare])[back]
            yield i, j, c, f, own
        i = j


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key is an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(labels: DataFrame, label: str, learn: Column, each: int) -> DataFrame:
    """doc_id and label (0 or 1) of about `each` rows of each label among those to learn from, chosen by a hash of the id.

    Other labels and null ids are left out; of several labels of an id the largest holds.
    """
    rows = labels.filter(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    many = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    fine = 1 << 30
    part = F.pmod(F.xxhash64("doc_id"), F.lit(fine))
    keep = F.lit(False)
    for k, n in many.items():
        keep = keep | ((F.col("label") == k) & (part < min(fine, int(fine * each / n))))
    return rows.filter(keep)
