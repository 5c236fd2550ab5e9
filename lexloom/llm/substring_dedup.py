"""Operator 10: removal of long repeated byte strings.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else, in the same or another text, is removed. Strings never cross texts, and
are judged on the input. The same search over words instead of bytes reports
the passages of ``passage`` words that another document has too; nothing is
removed for them. A unit is one of the two kinds of symbols.

1. Anchors: each window of ``length`` symbols picks the smallest rolling hash of
   its grams. Equal windows pick equal anchors, so windows need comparing only
   with windows of the same anchor. Anchors are counted over all texts.
2. Contexts: the windows of an anchor that occurs again, with their symbols, go
   to the anchor's partition. In a hot anchor, by count, the windows pick a
   second, longer gram, which splits the anchor; equal windows again pick equal
   grams. A partition sends equal contexts once and knows by itself that they
   repeat.
3. Blocks: contexts whose window hashes repeat are put into a text with
   separators, whose Burrows-Wheeler transform is expanded breadth first:
   intervals of strings of growing length, by backward extension from those of
   the packed first symbols, each setting the common prefix at its right end if
   that is still open. After ``length`` levels the open places have a common
   prefix of at least ``length``.
4. Spans are merged per text and cut out.

The repeated anchors are sent to every task while they are at most
``SENT_ANCHORS`` (a fixed size); beyond that the anchors' places, without their
symbols, meet them in a join, and each text meets the places that are left.

Null counts as empty; texts shorter than ``length`` keep all bytes. Repeated
rows repeat each other, so each loses all bytes if it has ``length`` of them;
rows with the same doc_id and text are one document for passages. Cut texts need
not be valid UTF-8, so they are bytes. Other columns are ignored; an empty table
gives an empty result; very long texts are taken in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.text import BASE, Words, groups, mix64, powers, release
from lexloom.llm.text import texts_of as _texts_of
from lexloom.session import ship, written

LENGTH, GRAM = 400, 100
#: Words of a reported passage (more than 50), and of its grams.
PASSAGE, WORD_GRAM = 51, 12
SENT_ANCHORS = 4_000_000
#: From so many places on an anchor's windows pick a second gram, which has so many symbols of a window's 20.
HOT = ((256, 15), (8192, 19))
#: Symbols of contexts in one transform, and of a text that is hashed at once.
BLOCK, PIECE = 1 << 18, 1 << 18
BYTES, WORDS = 0, 1


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of k bytes."""
    n = len(raw)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix64((total[k:] - total[:-k]) * down[: n - k + 1])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by prefix and suffix minima of blocks."""
    n = len(v) - w + 1
    size = -(-len(v) // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of every anchor of a text; long texts in pieces."""
    n = len(raw)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, max(n - length + 1, 0), PIECE):
        part = raw[at : at + PIECE + length - 1]
        h = gram_hashes(part, gram)
        low = np.uint64((1 << 24) - 1)
        v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        p = (sliding_min(v, length - gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        last = np.concatenate((first[1:], [len(p)])) - 1
        found.append((h[p[first]], first + at, last + at))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes sorted by their first ``depth`` symbols at least, the packed first symbols of each, and how many those are.

    Ranks of the first symbols are tripled in reach while three of them fit in
    a key, doubled beyond that.
    """
    n = len(text)
    bits = int(text.max(initial=1)).bit_length()
    reach = first_reach = min(63 // bits, depth)
    padded = np.zeros(n + reach, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for i in range(reach):
        key = (key << np.uint64(bits)) | padded[i : i + n]
    first = key
    parts = 3 if n < (1 << 21) - 1 else 2
    wide = np.uint64(63 // parts)
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([True], ranked[1:] != ranked[:-1])), dtype=np.uint64)
        if reach >= depth or int(rank[order[-1]]) == n:
            return order, first, first_reach
        key = rank.copy()
        for i in range(1, parts):
            key <<= wide
            key[: max(n - i * reach, 0)] |= rank[i * reach :]
        reach *= parts


def open_places(text: np.ndarray, order: np.ndarray, first: np.ndarray, level: int, length: int) -> np.ndarray:
    """True at i if the suffixes order[i - 1] and order[i] may share ``length`` symbols.

    Breadth-first backward extension: an interval holds the suffixes that start
    with one string. The first intervals are those of the packed first ``level``
    symbols. Where an interval's right end is still open, the neighbours there
    share one symbol less than the string has. Separators (0) are not extended.
    """
    n = len(text)
    before = text[order - 1]
    small = before.astype(np.uint16) if text.max() < 1 << 16 else before
    back = np.empty(n, np.int64)
    back[np.argsort(small, kind="stable")] = np.arange(n)
    head, front = text[order], first[order]
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    starts = np.flatnonzero(np.concatenate(([True], front[1:] != front[:-1])))
    lo, hi = starts, np.concatenate((starts[1:], [n]))
    open_[lo] = False
    zero = np.flatnonzero(text == 0)
    ahead = zero[np.minimum(np.searchsorted(zero, order[lo]), len(zero) - 1)] - order[lo] if len(zero) else np.full(len(lo), n)
    keep = (ahead < 0) | (ahead >= level)
    lo, hi = lo[keep], hi[keep]
    for _ in range(level + 1, length + 1):
        size = hi - lo
        total = int(size.sum())
        if not total:
            break
        origin = np.repeat(np.arange(len(lo)), size)
        places = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + lo[origin]
        real = before[places] != 0
        q, origin = back[places[real]], origin[real]
        if not len(q):
            break
        if 8 * len(q) > n:
            spread = np.full(n, -1, np.int64)
            spread[q] = origin
            q = np.flatnonzero(spread >= 0)
            origin = spread[q]
        else:
            at = np.argsort(q)
            q, origin = q[at], origin[at]
        new = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1] + 1) | (origin[1:] != origin[:-1]) | (head[q[1:]] != head[q[:-1]]))))
        lo, hi = q[new], q[np.concatenate((new[1:], [len(q)])) - 1] + 1
        fresh = open_[hi]
        lo, hi = lo[fresh], hi[fresh]
        open_[hi] = False
    return open_[:n]


def repeated(strings: list[np.ndarray], length: int, low: np.ndarray, high: np.ndarray, apart: bool = False) -> list[np.ndarray]:
    """For each string, which of its windows of ``length`` symbols occur more than once.

    A string stands for all its occurrences, of owners between ``low`` and
    ``high``. Equal windows have more than one occurrence if there are several
    of them or if these owners differ; ``apart`` asks for different owners.
    """
    sizes = np.array([len(s) for s in strings])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    symbols = np.concatenate(strings)
    if symbols.dtype == np.uint8:
        symbols = (np.cumsum(np.bincount(symbols, minlength=256) > 0) - 1)[symbols]
    else:
        symbols = np.unique(symbols, return_inverse=True)[1]
    text = np.zeros(starts[-1], np.uint32)
    text[np.arange(len(symbols)) + np.repeat(np.arange(len(sizes)), sizes)] = symbols.astype(np.uint32) + 1
    order, first, level = suffix_order(text, length)
    left = np.repeat(starts[1:] - 1, sizes + 1) - np.arange(len(text))
    whole = left[order] >= length
    same = open_places(text, order, first, level, length)
    same[1:] &= whole[1:] & whole[:-1]
    same[0] = False
    heads = np.flatnonzero(~same)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)[order]
    several = np.minimum.reduceat(low[owner], heads) != np.maximum.reduceat(high[owner], heads)
    if not apart:
        several |= np.diff(np.concatenate((heads, [len(text)]))) > 1
    flags = np.zeros(len(text), bool)
    flags[order] = several[np.cumsum(~same) - 1] & whole
    return [flags[a : a + max(n - length + 1, 0)] for a, n in zip(starts, sizes, strict=False)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of the runs of True."""
    step = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def window_hashes(bodies: list[np.ndarray], sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, body and place of every window, a block of bodies at a time."""
    out = []
    ends = np.cumsum(sizes)
    i = 0
    while i < len(bodies):
        j = max(int(np.searchsorted(ends, ends[i] - sizes[i] + BLOCK, side="right")), i + 1)
        part = sizes[i:j]
        owner = np.repeat(np.arange(i, j), part)
        place = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
        h = gram_hashes(np.concatenate(bodies[i:j]), length)
        inside = np.flatnonzero((place + length <= np.repeat(part, part))[: len(h)])
        out.append((h[inside], owner[inside], place[inside]))
        i = j
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def block_spans(contexts: list[tuple[object, bytes]], length: int, unit: int = BYTES) -> list[list[tuple[int, int]]]:
    """Spans, relative to its context, of the windows of each (document, symbols) that repeat.

    Words have to repeat in another document. Window hashes leave out what
    cannot repeat; the transform decides. Equal stretches enter it once, with
    the range of their owners.
    """
    kind = SYMBOL[unit]
    bodies = [np.frombuffer(c[1], kind) for c in contexts]
    sizes = np.array([len(b) for b in bodies])
    every, owner, place = window_hashes(bodies, sizes, length)
    _, where, times = np.unique(every, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(times[where] > 1)
    stretches: dict[bytes, list[tuple[int, int]]] = {}
    if len(maybe):
        new = np.flatnonzero(np.concatenate(([True], (maybe[1:] != maybe[:-1] + 1) | (owner[maybe[1:]] != owner[maybe[:-1]]))))
        last = maybe[np.concatenate((new[1:], [len(maybe)])) - 1]
        for i, a, b in zip(owner[maybe[new]].tolist(), place[maybe[new]].tolist(), place[last].tolist(), strict=True):
            stretches.setdefault(bodies[i][a : b + length].tobytes(), []).append((i, a))
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    if not stretches:
        return out
    numbers: dict = {}
    low, high = [], []
    for uses in stretches.values():
        each = [numbers.setdefault(contexts[i][0] if unit == WORDS else (i, a), len(numbers)) for i, a in uses]
        low.append(min(each))
        high.append(max(each))
    found = repeated([np.frombuffer(s, kind) for s in stretches], length, np.array(low), np.array(high), unit == WORDS)
    for uses, flags in zip(stretches.values(), found, strict=True):
        for a, b in runs(flags):
            for i, shift in uses:
                out[i].append((a + shift, b + shift + length - 1))
    return out


SYMBOL = (np.uint8, np.uint32)
#: (length, gram) of each unit; a length of 0 leaves the unit out.
Sizes = tuple[tuple[int, int], ...]
COUNTS_SQL = "hash long, n long"


def group_anchors(symbols: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, hash, first window, last window) of the anchors of a run of texts, as :func:`anchors` finds them in each."""
    n = len(offsets) - 1
    if n == 1 or len(symbols) > 4 * PIECE:
        found = [anchors(symbols[offsets[k] : offsets[k + 1]], length, gram) for k in range(n)]
        return np.repeat(np.arange(n), [len(f[0]) for f in found]), *(np.concatenate(x) for x in zip(*found, strict=True))
    none = np.zeros(0, np.int64)
    if len(symbols) < length:
        return none, none.astype(np.uint64), none, none
    h = gram_hashes(symbols, gram)
    low = np.uint64((1 << 24) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    p = (sliding_min(v, length - gram + 1) & low).astype(np.int64)
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    text = np.repeat(np.arange(n), windows)
    at = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    p = p[at + offsets[text]]
    new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (text[1:] != text[:-1])))) if len(p) else none
    end = np.concatenate((new[1:], [len(p)])) - 1 if len(p) else none
    return text[new], h[p[new]], at[new], at[end]


def _units(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[tuple[list[list], int, np.ndarray, np.ndarray]]:
    """(other columns, unit, symbols, offsets) of runs of texts; texts are the batches' last column."""
    for batch in batches:
        data, offsets = _texts_of(batch.column(batch.num_columns - 1))
        meta = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
        for i, j in groups(offsets, PIECE):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            some = [m[i:j] for m in meta]
            if sizes[BYTES][0]:
                yield some, BYTES, part, at
            if sizes[WORDS][0]:
                words = Words(part, at)
                yield some, WORDS, (words.hashes >> np.uint64(32)).astype(np.uint32), words.first


def unit_anchors(symbols: np.ndarray, offsets: np.ndarray, unit: int, sizes: Sizes) -> tuple[np.ndarray, ...]:
    """Anchors of one unit; the units' hashes differ."""
    text, h, first, last = group_anchors(symbols, offsets, *sizes[unit])
    return text, (mix64(h + np.uint64(unit)) if unit else h), first, last


def _count(sizes: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

        for _, unit, symbols, offsets in _units(batches, sizes):
            _, h, _, _ = unit_anchors(symbols, offsets, unit, sizes)
            held.append(h)
            size += len(h)
            if size > 1 << 20:
                yield out()
                size = 0
        if held:
            yield out()
        release()

    return run


PLACES_SQL = "doc_id long, tag long, unit int, hash long, start long, stop long"


def _places(sizes: Sizes):
    """doc_id, tag, unit, hash, first and last window of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PLACES_SQL.split(", ")]
        held: list[list[np.ndarray | list]] = [[] for _ in names]
        size = 0

        def out() -> pa.RecordBatch:
            columns = [*(pa.array([x for part in c for x in part], pa.int64()) for c in held[:2]), *(pa.array(np.concatenate(c)) for c in held[2:])]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for (docs, tags), unit, symbols, offsets in _units(batches, sizes):
            text, h, first, last = unit_anchors(symbols, offsets, unit, sizes)
            owner = text.tolist()
            kind = np.full(len(h), unit, np.int32)
            for c, v in zip(held, ([docs[k] for k in owner], [tags[k] for k in owner], kind, h.view(np.int64), first, last), strict=True):
                c.append(v)
            size += len(h)
            if size > 1 << 17:
                yield out()
                size = 0
        if size:
            yield out()
        release()

    return run


CONTEXT = pa.schema(
    [("hash", pa.int64()), ("unit", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("starts", pa.list_(pa.int64())), ("span", pa.int64()), ("body", pa.binary())]
)
CONTEXT_SQL = "hash long, unit int, doc_id long, tag long, starts array<long>, span long, body binary"


class Sender:
    """Collects contexts; of equal ones of a partition, the first carries the symbols."""

    def __init__(self, sizes: Sizes):
        self.sizes = sizes
        #: digest of a context -> its first places, until it is known to repeat
        self.seen: dict[bytes, tuple | None] = {}
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, unit: int, doc: int | None, tag: int, symbols: np.ndarray, found: Iterable[tuple[int, int, int, int]]) -> None:
        """(anchor, level, first window, last window) of a text; a hot anchor's windows go by the second gram that each picks."""
        length = self.sizes[unit][0]
        split: list[tuple[int, int, int, list[int]]] = []
        for key, level, a, b, starts in self._new(unit, doc, tag, symbols, ((k, lv, a, b, [a]) for k, lv, a, b in found)):
            if not level:
                self._send(key, unit, doc, tag, symbols[a : b + length], starts)
                continue
            h, first, last = anchors(symbols[a : b + length], length, length * HOT[level - 1][1] // 20)
            mixed = mix64(h ^ np.uint64(key & (1 << 64) - 1)).view(np.int64)
            for k, i, j in zip(mixed.tolist(), first.tolist(), last.tolist(), strict=True):
                split.append((k, 0, a + i, a + j, [x + i for x in starts]))
        for key, _, a, b, starts in self._new(unit, doc, tag, symbols, split):
            self._send(key, unit, doc, tag, symbols[a : b + length], starts)

    def _new(self, unit: int, doc: int | None, tag: int, symbols: np.ndarray, found) -> list[tuple]:
        """The distinct contexts that this partition sees first; places of the others are known to repeat.

        A passage has to come again in another document.
        """
        length = self.sizes[unit][0]
        here: dict[bytes, tuple] = {}
        for key, level, a, b, starts in found:
            digest = hashlib.blake2b(symbols[a : b + length], digest_size=16, key=key.to_bytes(8, "little", signed=True)).digest()
            if digest in here:
                here[digest][4].extend(starts)
            else:
                here[digest] = (key, level, a, b, starts)
        out = []
        for digest, context in here.items():
            place = (unit, doc, tag, context[4], context[3] - context[2] + length)
            if digest not in self.seen:
                out.append(context)
                again = unit == BYTES and len(context[4]) > 1
                self.seen[digest] = None if again else place
                if again:
                    self._known(place)
                continue
            before = self.seen[digest]
            if unit == WORDS and before is not None and before[1:3] == (doc, tag):
                continue
            if before is not None:
                self._known(before)
                self.seen[digest] = None
            self._known(place)
        return out

    def _known(self, place: tuple) -> None:
        """Places that repeat need no symbols; they travel by their document."""
        self.rows.append((((place[1] or 0) ^ place[2]) * int(BASE) % (1 << 63), *place, None))

    def _send(self, key: int, unit: int, doc: int | None, tag: int, symbols: np.ndarray, starts: list[int]) -> None:
        self.rows.append((key, unit, doc, tag, starts, len(symbols), symbols.tobytes()))
        self.size += symbols.nbytes

    def full(self) -> bool:
        return self.size > 8 << 20 or len(self.rows) > 20_000

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), CONTEXT, strict=True)], schema=CONTEXT)
        self.rows.clear()
        self.size = 0
        return out


def hot_level(n: Column) -> Column:
    """0 for anchors of few places, else which of ``HOT`` they have reached."""
    return sum((F.when(n >= least, 1).otherwise(0) for least, _ in HOT), F.lit(0))


def _contexts(sizes: Sizes, sent):
    """Contexts of texts; with ``sent`` (sorted anchors, levels) from their own anchors, else from a third column's places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(sizes)
        for meta, unit, symbols, offsets in _units(batches, sizes):
            if sent is None:
                found = [(k, [(p["hash"], p["level"], p["start"], p["stop"]) for p in places if p["unit"] == unit]) for k, places in enumerate(meta[2])]
            else:
                again, levels = sent.value
                text, h, first, last = unit_anchors(symbols, offsets, unit, sizes)
                if not len(again) or not len(h):
                    continue
                at = np.minimum(np.searchsorted(again, h), len(again) - 1)
                use = np.flatnonzero(again[at] == h)
                each = zip(h[use].view(np.int64).tolist(), levels[at[use]].tolist(), first[use].tolist(), last[use].tolist(), strict=True)
                found = [(k, [c for _, c in some]) for k, some in groupby(zip(text[use].tolist(), each, strict=True), key=lambda x: x[0])]
            for k, contexts in found:
                sender.add(unit, meta[0][k], meta[1][k], symbols[offsets[k] : offsets[k + 1]], contexts)
            if sender.full():
                yield sender.batch()
        if sender.rows:
            yield sender.batch()
        release()

    return run


SPANS_SQL = "doc_id long, tag long, unit int, start long, stop long"


def _blocks(sizes: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit and hash; whole groups are gathered into blocks. Rows without symbols are spans."""
        block: list[tuple] = []
        group: list[tuple] = []
        now, size, held = None, 0, 0
        found: list[tuple] = []

        def close_group() -> None:
            nonlocal size, held
            if len(group) > 1:
                block.extend(group)
                size += held
            group.clear()
            held = 0

        def out() -> Iterator[pa.RecordBatch]:
            if found:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "unit", "start", "stop"])
                found.clear()

        def work() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if block:
                unit = block[0][1]
                for row, spans in zip(block, block_spans([(r[2:4], r[6]) for r in block], sizes[unit][0], unit), strict=True):
                    found.extend((row[2], row[3], unit, start + a, start + b) for start in row[4] for a, b in spans)
            block.clear()
            size = 0
            yield from out()

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for row in zip(*columns, strict=True):
                if row[6] is None:
                    found.extend((row[2], row[3], row[1], start, start + row[5]) for start in row[4])
                    if len(found) > 100_000:
                        yield from out()
                    continue
                if row[:2] != now:
                    close_group()
                    if size > BLOCK or now is not None and row[1] != now[1]:
                        yield from work()
                    now = row[:2]
                group.append(row)
                held += len(row[6]) // SYMBOL[row[1]]().itemsize
        close_group()
        yield from work()
        release()

    return run


def repeated_spans(docs: DataFrame, sizes: Sizes, sent_anchors: int = SENT_ANCHORS) -> DataFrame:
    """doc_id, tag (hash of the text) and sorted spans by unit; only texts that have some.

    ``docs`` has doc_id, tag and text.
    """
    spark = docs.sparkSession
    again = docs.mapInArrow(_count(sizes), COUNTS_SQL).groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1")
    again = written(again.select("hash", hot_level(F.col("n")).alias("level")), "anchors")
    if again.count() <= sent_anchors:
        held = [(np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1)).astype(np.uint8)) for b in again.toArrow().to_batches()]
        h, level = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
        order = np.argsort(h)
        sent = spark.sparkContext.broadcast((h[order], level[order]))
        contexts = docs.mapInArrow(_contexts(sizes, sent), CONTEXT_SQL)
    else:
        places = docs.mapInArrow(_places(sizes), PLACES_SQL).join(again.hint("shuffle_merge"), "hash")
        place = F.struct("unit", "hash", "level", "start", "stop")
        listed = places.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set(place)).alias("places"))
        met = listed.alias("p").join(docs.alias("d").hint("shuffle_merge"), F.col("p.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("p.tag") == F.col("d.tag")))
        contexts = met.select("d.doc_id", "d.tag", "p.places", "d.text").mapInArrow(_contexts(sizes, None), CONTEXT_SQL)
    every = contexts.repartition(F.col("hash")).sortWithinPartitions("unit", "hash").mapInArrow(_blocks(sizes), SPANS_SQL)
    return every.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set(F.struct("unit", "start", "stop"))).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of sorted spans."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


CUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("n_passages", pa.int64()), ("n_passage_words", pa.int64())]
)
CUT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passages long, n_passage_words long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            found: tuple[list, list] = ([], [])
            for s in (spans.as_py() if spans.is_valid else ()):
                found[s["unit"]].append((s["start"], s["stop"]))
            gone, passages = merged(found[BYTES]), merged(found[WORDS])
            kept, at = [], 0
            for a, b in gone:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rows.append((doc, len(raw), sum(b - a for a, b in gone), len(gone), b"".join(kept), len(passages), sum(b - a for a, b in passages)))
        columns = zip(*rows, strict=True) if rows else [[] for _ in CUT]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CUT, strict=True)], schema=CUT)


def cut_repeats(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    length: int = LENGTH,
    gram: int = GRAM,
    sent_anchors: int = SENT_ANCHORS,
    passage: int = PASSAGE,
    word_gram: int = WORD_GRAM,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), n_passages and n_passage_words of every row.

    With a ``passage`` of 0 no passages are looked for.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    source = source.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tag"), "text")
    spans = repeated_spans(source, ((length, gram), (passage, word_gram)), sent_anchors)
    # the side that is held has a row per text with spans, about a hundredth of a partition's bytes, and no hot key
    joined = source.alias("d").join(spans.hint("shuffle_hash").alias("s"), (F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))) & (F.col("d.tag") == F.col("s.tag")), "left")
    return joined.select("d.doc_id", "d.text", "s.spans").mapInArrow(_cut, CUT_SQL)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans and the digest of the remaining bytes.

    n_passages and n_passage_words count the passages of more than 50 words
    that another document has too, whatever their bytes.
    """
    return cut_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_words")


def brute_force(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Spans by looking up every window in a dictionary."""
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    return [merged([(i, i + length) for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1]) for t in texts]




def brute_force_passages(texts: list[str | None], length: int) -> list[list[tuple[int, int]]]:
    """Word ranges whose windows another text has, by looking up every window in a dictionary."""
    raw = [(t or "").encode() for t in texts]
    words = []
    for r in raw:
        w = Words(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        words.append([w.word(i) for i in range(len(w.hashes))])
    owners: dict[tuple, set[int]] = {}
    for t, ws in enumerate(words):
        for i in range(len(ws) - length + 1):
            owners.setdefault(tuple(ws[i : i + length]), set()).add(t)
    return [merged([(i, i + length) for i in range(len(ws) - length + 1) if len(owners[tuple(ws[i : i + length])]) > 1]) for ws in words]
