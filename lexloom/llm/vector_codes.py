"""Operator 13: product codes of vectors by Lloyd's rounds with Hamerly's bounds.

Components become integers, floor(``SCALE`` * x), and vectors are cut into
equal consecutive parts. Each part position has a codebook, which starts as that
part of the vectors with the smallest ids. A round assigns each part to its
nearest entry, then each entry becomes the componentwise floor of its parts'
mean; unused entries stay.

The written state has, beside a vector's integers, for each part its entry, an
upper bound of the distance to it and a lower bound of the distance to the
second nearest. When entries have moved, the bounds are widened by the moves.
An upper bound strictly below the lower one, or below half the way from the
entry to its nearest neighbour, keeps the entry; else the distance is measured,
and only if it is not strictly below either, all entries are scanned in
integers, the lower index first among equals. Bounds are rounded outward, so
they decide nothing that integers would decide otherwise.

A round is one job: tasks read the state and the codebooks (of fixed size),
write the new state and, as one row each, the sums and counts of their parts,
which Spark adds up. The state before the last one is deleted once its follower
stands; a lost executor costs tasks of the running round only.

Rows whose vector is null, or holds a null or a component that is not finite,
are dropped. Vectors whose length is not that of the first one (by id), or no
multiple of the number of parts, cannot be coded: they stay, with null code and
error, and count for nothing. Fewer vectors than entries make smaller codebooks.
A null id comes after all others; rows that share an id are ordered by their
vectors, and each is coded. Repeated rows give repeated results. Empty vectors
have parts without components, at distance 0. Further columns are ignored. An
empty table gives an empty result. Integers beyond ``LIMIT`` are refused, as
sums of their squares could leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import dropped, ship, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LIMIT = 1 << 24
#: Outward rounding of bounds, far above what a few operations on doubles lose.
SLACK = 1e-9
#: Labels with more than one in so many of the rows get their sums by broadcast.
HOT = 10_000

STATE = pa.schema(
    [("vec_id", pa.int64()), ("label", pa.string()), ("ints", pa.list_(pa.int32())), ("code", pa.binary()), ("upper", pa.list_(pa.float64())), ("lower", pa.list_(pa.float64())), ("error", pa.int64()), ("sums", pa.binary())]
)
STATE_SQL = "vec_id long, label string, ints array<int>, code binary, upper array<double>, lower array<double>, error long, sums binary"


def integers(vectors: DataFrame, vector: str, vec_id: str, label: str) -> DataFrame:
    """vec_id, label (as text) and the integers of the rows that are kept."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    inside = F.forall(x, lambda v: F.abs(v * SCALE) < LIMIT)
    checked = F.when(inside, F.transform(x, lambda v: F.floor(v * SCALE).cast("int"))).otherwise(F.raise_error(F.lit(f"components have to be below {LIMIT // SCALE}")))
    return vectors.filter(x.isNotNull() & whole).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), checked.alias("ints"))


class Bounds:
    """Entries, bounds and errors of a batch of vectors against the codebooks."""

    def __init__(self, x: np.ndarray, parts: int, width: int):
        self.x = x.reshape(len(x), parts, width).astype(np.int64)
        self.code = np.zeros((len(x), parts), np.int64)
        self.upper = np.full((len(x), parts), np.inf)
        self.lower = np.zeros((len(x), parts))
        self.scans = 0

    def scan(self, part: int, rows: np.ndarray, book: np.ndarray) -> None:
        """Squared distances to all entries, in integers; ties go to the lower index."""
        x = self.x[rows, part]
        d = np.empty((len(rows), len(book)), np.int64)
        for e in range(len(book)):
            gap = x - book[e]
            d[:, e] = np.einsum("ij,ij->i", gap, gap)
        best = d.argmin(1)
        at = np.arange(len(rows))
        near = d[at, best]
        d[at, best] = np.iinfo(np.int64).max
        second = d.min(1) if len(book) > 1 else np.full(len(rows), np.inf)
        self.code[rows, part] = best
        self.upper[rows, part] = np.sqrt(near.astype(np.float64)) * (1 + SLACK)
        self.lower[rows, part] = np.sqrt(second.astype(np.float64)) * (1 - SLACK)
        self.scans += len(rows)

    def widen(self, moves: np.ndarray) -> None:
        """Entries moved by so much at most: upper bounds grow, lower ones shrink by the largest move of another entry."""
        for p in range(self.code.shape[1]):
            m = moves[p]
            order = np.argsort(m)
            largest = np.full(len(m), m[order[-1]])
            if len(m) > 1:
                largest[order[-1]] = m[order[-2]]
            c = self.code[:, p]
            self.upper[:, p] = (self.upper[:, p] + m[c]) * (1 + SLACK)
            self.lower[:, p] = np.maximum(self.lower[:, p] - largest[c], 0) * (1 - SLACK)

    def assign(self, books: np.ndarray, first: bool) -> None:
        for p, book in enumerate(books):
            if first:
                self.scan(p, np.arange(len(self.x)), book)
                continue
            gaps = np.sqrt(((book[:, None, :] - book[None, :, :]).astype(np.float64) ** 2).sum(2))
            np.fill_diagonal(gaps, np.inf)
            half = gaps.min(1) / 2 * (1 - SLACK)
            safe = np.maximum(self.lower[:, p], half[self.code[:, p]])
            open_ = np.flatnonzero(~(self.upper[:, p] < safe))
            if len(open_):
                gap = self.x[open_, p] - book[self.code[open_, p]]
                self.upper[open_, p] = np.sqrt(np.einsum("ij,ij->i", gap, gap).astype(np.float64)) * (1 + SLACK)
                self.scan(p, open_[~(self.upper[open_, p] < safe[open_])], book)

    def errors(self, books: np.ndarray) -> np.ndarray:
        """Squared distances to the assigned entries, summed over parts."""
        total = np.zeros(len(self.x), np.int64)
        for p, book in enumerate(books):
            gap = self.x[:, p] - book[self.code[:, p]]
            total += np.einsum("ij,ij->i", gap, gap)
        return total

    def sums(self, entries: int) -> np.ndarray:
        """Per part and entry: the count, then the sums of the components."""
        n, parts, width = self.x.shape
        out = np.zeros((parts, entries, width + 1), np.int64)
        for p in range(parts):
            out[p, :, 0] = np.bincount(self.code[:, p], minlength=entries)
            for w in range(width):
                # a batch's sums stay far below 2**53, so doubles hold them exactly
                out[p, :, w + 1] = np.bincount(self.code[:, p], self.x[:, p, w], entries).astype(np.int64)
        return out


def rounded(state: DataFrame, books: np.ndarray, moves: np.ndarray | None, name: str, last: bool) -> DataFrame:
    """The written state after one assignment, with a row of sums per task."""
    parts, entries, width = books.shape
    sent = state.sparkSession.sparkContext.broadcast((books, moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moves = sent.value
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            ints = batch.column("ints")
            b = Bounds(np.asarray(ints.flatten()).reshape(n, parts * width), parts, width)
            if moves is not None:
                b.code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                b.upper = np.asarray(batch.column("upper").flatten()).reshape(n, parts).copy()
                b.lower = np.asarray(batch.column("lower").flatten()).reshape(n, parts).copy()
                b.widen(moves)
            b.assign(books, moves is None)
            if not last:
                total += b.sums(entries)
            codes = b.code.astype(np.uint8)
            spans = pa.array(np.arange(0, n * parts + 1, parts, dtype=np.int32))
            lists = lambda a: pa.ListArray.from_arrays(spans, pa.array(a.ravel()))  # noqa: B023, E731
            none = pa.nulls(n, STATE.field("upper").type)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.nulls(n, ints.type) if last else ints,
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    none if last else lists(b.upper),
                    none if last else lists(b.lower),
                    pa.array(b.errors(books) if last else np.zeros(n, np.int64)),
                    pa.nulls(n, pa.binary()),
                ],
                schema=STATE,
            )
        if not last:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in list(STATE)[:-1]] + [pa.array([total.tobytes()], pa.binary())], schema=STATE)

    columns = [c if c in state.columns else F.lit(None).cast(kind).alias(c) for c, kind in (x.split(" ") for x in STATE_SQL.split(", "))]
    return written(state.filter("ints IS NOT NULL").select(*columns).mapInArrow(run, STATE_SQL), name)


def added(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """The tasks' sums, added in Spark: one number for each place of the codebooks."""
    places = shape[0] * shape[1] * shape[2]

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(places, np.int64)
        for batch in batches:
            for row in batch.column(0):
                total += np.frombuffer(row.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(places, dtype=np.int32)), pa.array(total)], names=["place", "n"])

    rows = state.filter("sums IS NOT NULL").select("sums").mapInArrow(numbers, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(places, np.int64)
    for r in rows:
        out[r["place"]] = r["n"]
    return out.reshape(shape)


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> tuple[DataFrame, np.ndarray | None, DataFrame]:
    """Codes (vec_id, label, code, error), the codebooks, and the rows that cannot be coded (vec_id, label)."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index is one byte")
    ship(vectors.sparkSession)
    kept = written(integers(vectors, vector, vec_id, label), "vector-integers")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints", F.col("label").asc_nulls_last()).limit(entries).collect()
    size = len(first[0]["ints"]) if first else 0
    whole = (F.size("ints") == size) & (F.size("ints") % parts == 0)
    rest = kept.filter(~whole).select("vec_id", "label")
    if not first or size % parts:
        return kept.limit(0).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), None, rest
    state = kept.filter(whole)
    if any(len(r["ints"]) != size for r in first):
        first = state.orderBy(F.col("vec_id").asc_nulls_last(), "ints", F.col("label").asc_nulls_last()).limit(entries).collect()
    books = np.asarray([r["ints"] for r in first], np.int64).reshape(len(first), parts, size // parts).swapaxes(0, 1).copy()
    moves = None
    for k in range(rounds + 1):
        after = rounded(state, books, moves, f"vector-state-{k}", k == rounds)
        if k > 0:
            dropped(state)
        state = after
        if k < rounds:
            total = added(state, (parts, len(first), size // parts + 1))
            counts = total[:, :, :1]
            new = np.where(counts > 0, total[:, :, 1:] // np.maximum(counts, 1), books)
            moves = np.sqrt(((new - books).astype(np.float64) ** 2).sum(2)) * (1 + SLACK)
            books = new
    return state.select("vec_id", "label", "code", "error"), books, rest


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    coded, books, rest = trained(vectors, parts, entries, rounds, vector, vec_id, label)
    flat = [] if books is None else books.reshape(-1).tolist()
    digest = hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()
    rows = coded.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error").unionByName(rest.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    sums = written(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    # labels that many rows share, at most HOT of them, are sent; rows of others meet their sums in a shuffle
    hot = sums.join(F.broadcast(sums.agg(F.sum("n").alias("all"))), F.lit(True)).filter(F.col("n") * HOT > F.col("all")).select("of", "label_error")
    same = F.col("label").eqNullSafe(F.col("of"))
    many = rows.join(F.broadcast(hot), same)
    few = rows.join(F.broadcast(hot.select("of")), same, "left_anti").join(sums.select("of", "label_error"), same)
    return many.unionByName(few).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
