"""Operator 2: benchmark decontamination with a generalised suffix automaton.

The automaton holds the words of the benchmark items. Every document's words
are streamed through it; the longest match that ends at a word says which
windows end there. A window is ``window`` consecutive words of an item; an
item with fewer words, but not none, is one window. All words of an occurrence
are hit.

The automaton is sent to every task, so items are taken in blocks of at most
``block_words`` words; each block is one automaton and one pass over the
documents, and the hits of the blocks are merged per row. A benchmark below that
size, a fixed bound, is one pass; for more, the rows are numbered in one written
table that every pass reads.

``clean`` drops contaminated documents. ``remove_spans`` cuts hit spans above a
length out of the texts and drops documents above a share of hit words.

Null texts have no words: no hits, not contaminated. Null and empty items, and
those without an item_id, have no windows. Items that share an item_id count once. Repeated documents give
repeated results. An empty benchmark leaves every document clean; an empty
document table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.text import Words, groups, spare, texts_of
from lexloom.session import ship, written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
TO_LOWER = bytes.maketrans(UPPER, LOWER)
WINDOW = 13
#: Words of the items that one automaton holds; bounds what is sent to each task.
BLOCK_WORDS = 500_000


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().translate(TO_LOWER))


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, words in numbered:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: window length -> state of that window -> items that have it
        self.ends: dict[int, dict[int, set[str]]] = {}
        for item, words in numbered:
            n = min(window, len(words))
            state, size = 0, 0
            for w in words:
                state, size = self.step(state, size, w)
                if size >= n:
                    self.ends.setdefault(n, {}).setdefault(self.at(state, n), set()).add(item)
        self.shortest = min(self.ends, default=0)

    def _extend(self, last: int, w: int) -> int:
        go, link, length = self.go, self.link, self.length
        if w in go[last]:
            q = go[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, w, q)
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in go[p]:
            go[p][w] = cur
            p = link[p]
        if p >= 0:
            q = go[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        go, link, length = self.go, self.link, self.length
        clone = len(go)
        go.append(dict(go[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and go[p].get(w) == q:
            go[p][w] = clone
            p = link[p]
        return clone

    def step(self, state: int, size: int, w: int) -> tuple[int, int]:
        """The longest suffix of the stream that some item has, after one more word."""
        while state and w not in self.go[state]:
            state = self.link[state]
            size = self.length[state]
        nxt = self.go[state].get(w)
        return (0, 0) if nxt is None else (nxt, size + 1)

    def at(self, state: int, n: int) -> int:
        """The suffix-link ancestor that holds the match's last n words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges that are hit (sorted, disjoint) and the items found."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        state = size = 0
        number, sizes = self.vocabulary.get, sorted(self.ends, reverse=True)
        for i, word in enumerate(words):
            w = number(word)
            if w is None:
                state = size = 0
                continue
            state, size = self.step(state, size, w)
            if size < self.shortest:
                continue
            for n in sizes:
                if n <= size and (items := self.ends[n].get(self.at(state, n))):
                    found |= items
                    a = i + 1 - n
                    while spans and a <= spans[-1][1]:
                        a = min(a, spans.pop()[0])
                    spans.append((a, i + 1))
        return spans, found


def _scan(automaton: Automaton, at: int, own: str):
    """Rows with their word count, hit word ranges (flat) and items; the text is column ``at``."""
    vocabulary = automaton.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            data, offsets = texts_of(batch.column(at))
            counts, hits, items = [], [], []
            for a, b in groups(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if known is None:
                    listed = b" ".join(vocabulary)
                    w = Words(np.frombuffer(listed, np.uint8), np.array([0, len(listed)]))
                    known = np.sort(w.hashes)
                # a match lies within consecutive words of the vocabulary
                place = np.searchsorted(known, words.hashes)
                inside = known[np.minimum(place, len(known) - 1)] == words.hashes if len(known) else np.zeros(len(words.hashes), bool)
                for k in range(b - a):
                    i, j = int(words.first[k]), int(words.first[k + 1])
                    counts.append(j - i)
                    spans, found = [], set()
                    if j > i and automaton.shortest:
                        step = np.diff(np.concatenate(([0], inside[i:j].view(np.int8), [0])))
                        for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
                            if e - s >= automaton.shortest:
                                got, names = automaton.hits([words.word(i + x) for x in range(int(s), int(e))])
                                spans += [int(s) + x for span in got for x in span]
                                found |= names
                    hits.append(spans)
                    items.append(sorted(found))
            yield with_marks(batch, counts, hits, items, own)

    return run


def with_marks(batch: pa.RecordBatch, counts: list, hits: list, items: list, own: str) -> pa.RecordBatch:
    """A batch with three further columns, whose names have the prefix ``own``."""
    marks = [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*batch.columns, *marks], names=[*batch.schema.names, own + "n_words", own + "hits", own + "items"])


def _merge(at: int, own: str):
    """Rows whose last two columns list hits and items of several passes: word counts and unions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns
            rows = pa.RecordBatch.from_arrays(batch.columns[:-2], names=batch.schema.names[:-2])
            data, offsets = texts_of(batch.column(at))
            counts: list[int] = []
            for a, b in groups(offsets):
                counts += np.diff(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).first).tolist()
            hits = [union(each or []) for each in batch.column(last - 2).to_pylist()]
            items = [sorted({x for some in each or [] for x in some}) for each in batch.column(last - 1).to_pylist()]
            yield with_marks(rows, counts, hits, items, own)

    return run


def union(each: list[list[int]]) -> list[int]:
    """Flat union of flat lists of ranges."""
    out: list[int] = []
    for a, b in sorted(pair for hits in each for pair in zip(hits[::2], hits[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def blocks_of(benchmark: DataFrame, block_words: int, item_id: str, text: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of at most ``block_words`` words (a longer item is a block by itself).

    The driver holds one block at a time.
    """
    held, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("string"), text).toLocalIterator():
        words = words_of(row[1])
        if not words or row[0] is None:
            continue
        if held and size + len(words) > block_words:
            yield held
            held, size = [], 0
        held.append((row[0], words))
        size += len(words)
    if held:
        yield held


def marked(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> tuple[DataFrame, str]:
    """``docs`` with n_words, hits (start and end of each hit word range, flat) and items (sorted), and the prefix of their names.

    The prefix begins no name of ``docs``, so no column is hidden or lost.
    """
    ship(docs.sparkSession)
    own = spare(docs.columns)
    row, each, names = own + "row", own + "each", own + "names"
    marks = [T.StructField(own + "n_words", T.LongType()), T.StructField(own + "hits", T.ArrayType(T.LongType())), T.StructField(own + "items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*docs.schema.fields, *marks])
    blocks = blocks_of(benchmark, block_words, item_id, item_text)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return docs.mapInArrow(_scan(Automaton(first, window), docs.columns.index(text), own), schema), own
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    slim = numbered.select(row, text)
    passes = T.StructType([*slim.schema.fields, *marks])
    found = None
    for block in chain((first, second), blocks):
        hits = slim.mapInArrow(_scan(Automaton(block, window), 1, own), passes).filter(F.size(own + "items") > 0).select(row, own + "hits", own + "items")
        hits = written(hits, "hits")
        found = hits if found is None else found.unionByName(hits)
    listed = found.groupBy(row).agg(F.collect_list(own + "hits").alias(each), F.collect_list(own + "items").alias(names))
    both = numbered.join(listed, row, "left").select(*docs.columns, each, names)
    return both.mapInArrow(_merge(docs.columns.index(text), own), schema), own


def n_hit(hits: str) -> Column:
    """Number of hit words."""
    h = F.col(hits)
    return F.aggregate(
        F.transform(h, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("bigint"), lambda a, x: a + x
    )


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, hits (start and end of each hit word range, flat), n_hit and items of every row."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found, own = marked(source, benchmark, **options)
    return found.select("doc_id", F.col(own + "n_words").alias("n_words"), F.col(own + "hits").alias("hits"), n_hit(own + "hits").alias("n_hit"), F.col(own + "items").alias("items"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without its contaminated rows, columns unchanged."""
    found, own = marked(docs, benchmark, window, block_words)
    n = n_hit(own + "hits")
    return found.filter((n == 0) | (20 * n < F.col(own + "n_words"))).select(*docs.columns)


def remove_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    least_words: int = WINDOW,
    most_cover: float = 0.5,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    text: str = "text",
) -> DataFrame:
    """``docs`` with hit spans of at least ``least_words`` words cut out of the text, from their first to their last word.

    Rows of whose words a share above ``most_cover`` is hit go. Columns stay.
    """
    at = docs.columns.index(text)
    found, own = marked(docs, benchmark, window, block_words, text)
    found = found.filter(n_hit(own + "hits") <= F.lit(most_cover) * F.col(own + "n_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, hits in zip(batch.column(at), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                spans = [(a, b) for a, b in zip(hits[::2], hits[1::2], strict=True) if b - a >= least_words]
                texts.append(cut(t.as_py(), spans) if spans else t.as_py())
            columns = [*batch.columns[:-1]]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return found.select(*docs.columns, own + "hits").mapInArrow(run, docs.schema)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the word ranges."""
    raw = text.encode()
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : words.starts[a]])
        at = int(words.ends[b - 1])
    return b"".join([*kept, raw[at:]]).decode()


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, list[str], str]:
    """(n_words, n_hit, items, digest) of one text by comparing every window at every place."""
    words = words_of(text)
    hit, found = set(), set()
    for item, body in items:
        iw = words_of(body)
        if not iw:
            continue
        n = min(window, len(iw))
        for k in range(len(iw) - n + 1):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == iw[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    names = sorted(found)
    return len(words), len(hit), names, hashlib.sha256(",".join(names).encode()).hexdigest()
