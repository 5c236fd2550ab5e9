"""Words and shingles of whole Arrow batches as numpy arrays.

A word is a maximal run of bytes that are ASCII digits, ASCII letters or at
least 0x80, after ASCII lower-casing. On valid UTF-8 this is the same as
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` over code points. Hashes are 64-bit
polynomials over the bytes followed by a finaliser; equal words have equal
hashes in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import written

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that are worked on at once.
BLOCK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = True
IS_WORD[128:] = True

_POWERS: list[np.ndarray] = []


def release() -> None:
    """Give freed memory back to the system: workers live on for the next stage's tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps it


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x ^= x >> np.uint64(27)
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 18, 1 << (n - 1).bit_length())
        up = np.full(size, BASE, dtype=np.uint64)
        down = np.full(size, np.uint64(pow(int(BASE), -1, 1 << 64)), dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range by itself."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, lower-cased bytes) of the words; no word crosses a text."""
    low = LOWER[data]
    m = IS_WORD[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    edge[0] = edge[-1] = True
    before = np.empty(len(low), dtype=bool)
    before[:1] = False
    before[1:] = m[:-1]
    after = np.empty(len(low), dtype=bool)
    after[-1:] = False
    after[:-1] = m[1:]
    starts = np.flatnonzero(m & (~before | edge[:-1]))
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    return starts, ends, low


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of low[start:end]; works through the bytes in blocks."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + BLOCK, side="right")), i + 1)
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = powers(b - a + 1)
        total = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum((low[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix64(out)


class Words:
    """Words of a run of texts: hashes, and ``first[k]:first[k + 1]`` for text k."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.low = word_spans(data, offsets)
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = span_hashes(self.low, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.low[self.starts[i] : self.ends[i]].tobytes()


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words; fewer words, but not none, are one shingle."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * BASE + hashes[i : n - k + 1 + i]
    return mix64(out + np.uint64(k))


def row_tag(text: str) -> Column:
    """Hash of a row's text: with the doc_id it tells rows apart where doc_ids repeat."""
    return F.coalesce(F.xxhash64(F.col(text).cast("string")), F.lit(0))


def spare(columns: list[str]) -> str:
    """A prefix that begins none of the columns' names, for columns that stand beside them."""
    prefix = "__"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def only_rows(docs: DataFrame, kept: DataFrame, text: str, doc_id: str) -> DataFrame:
    """One row of ``docs`` for every ``of`` in ``kept`` (doc_id, tag, of), columns unchanged whatever their names.

    Where several rows of an ``of`` are in ``kept``, one with the smallest tag stays.
    """
    chosen = written(kept.groupBy("of").agg(F.min(F.struct("tag", "doc_id")).alias("row"), F.count(F.lit(1)).alias("n")), "kept-rows")
    mark, key, tag, n = (spare(docs.columns) + c for c in ("mark", "id", "tag", "n"))
    rows = chosen.select(F.col("row.doc_id").alias(key), F.col("row.tag").alias(tag), F.col("n").alias(n))
    same = F.col(key).eqNullSafe(docs[doc_id].cast("long")) & (F.col(tag) == F.col(mark))
    marked = docs.withColumn(mark, row_tag(text))
    if rows.filter(F.col(n) > 1).isEmpty():
        return marked.join(rows.drop(n), same, "left_semi").drop(mark)
    once = marked.join(rows.filter(F.col(n) == 1).drop(n), same, "left_semi")
    ties = marked.join(rows.filter(F.col(n) > 1).drop(n), same, "left_semi").dropDuplicates([doc_id, mark])
    return once.unionByName(ties).drop(mark)
