"""Near-duplicate lines: MinHash over byte 3-grams, exact similar pairs by equal parts, and the greedy rule in order."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lexloom.functions.rules import NEAR_THRESHOLD
from lexloom.functions.text import let
from lexloom.session import dropped, ship, slices, written

PERMUTATIONS, BANDS = 128, 8
#: Grams that are dealt into parts by their frequency; all others are by their hash.
FREQUENT = 1 << 16
#: Lines of a key from which it is extended by another part, and parts of a key at most. A line's further keys
#: cost about what thousands of comparisons by sketches do.
HOT, DEEPEST = 4_000, 3
#: Slices of the keys, one after the other, whose shuffles are on disk together with no other's.
SLICES = 8
#: Keys of a bucket, about; keys or pairs that are handled at once; lines of a key up to which keys are taken together.
BUCKET, BLOCK, FEW = 400_000, 1 << 18, 32
#: Columns of a line's sketch, 64 bits each.
WORDS = 4
SKETCH = tuple(f"s{k}" for k in range(WORDS))


def byte_grams(line: Column, n: int = 3) -> Column:
    """Distinct byte n-grams as hex strings."""
    size = F.octet_length(line)
    grams = let(
        F.hex(F.encode(line, "UTF-8")),
        lambda h: F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substr(h, i * 2 - 1, F.lit(2 * n))),
    )
    return F.when(size >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def signature(line: Column, permutations: int = PERMUTATIONS) -> Column:
    """Smallest hash of each permutation; lines below three bytes share the empty sketch."""
    seeds = F.sequence(F.lit(1), F.lit(permutations))
    least = lambda hashes, s: F.coalesce(F.array_min(F.transform(hashes, lambda g: F.xxhash64(g, s))), F.lit((1 << 63) - 1))
    return let(F.transform(byte_grams(line), lambda g: F.xxhash64(g)), lambda hashes: F.transform(seeds, lambda s: least(hashes, s)))


P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def final(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * P2
    h = (h ^ h >> np.uint64(29)) * P3
    return h ^ h >> np.uint64(32)


def gram_hashes(grams: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """For each gram (a number of 24 bits) the hashes whose minima :func:`signature` takes: xxhash64 of (xxhash64 of the hex digits, seed)."""
    with np.errstate(over="ignore"):
        nibbles = (grams.astype(np.uint64)[:, None] >> np.arange(20, -1, -4, dtype=np.uint64)) & np.uint64(15)
        digits = np.frombuffer(b"0123456789ABCDEF", np.uint8).astype(np.uint64)[nibbles.astype(np.int64)]
        four = digits[:, 0] | digits[:, 1] << np.uint64(8) | digits[:, 2] << np.uint64(16) | digits[:, 3] << np.uint64(24)
        h = np.uint64(42 + 6) + P5 ^ four * P1
        h = rotated(h, 23) * P2 + P3
        for k in (4, 5):
            h = rotated(h ^ digits[:, k] * P5, 11) * P1
        h = np.uint64(42 + 8) + P5 ^ rotated(final(h) * P2, 31) * P1
        h = final(rotated(h, 27) * P1 + P4)
        h = (h + P5 + np.uint64(4))[:, None] ^ np.arange(1, permutations + 1, dtype=np.uint64) * P1
        return final(rotated(h, 23) * P2 + P3).view(np.int64)


def signatures(lines: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """id, place and sig, the :func:`signature` of each line, in Arrow batches: a gram is hashed once a block of lines."""
    ship(lines.sparkSession)
    block = 1 << 15

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 1 << 18):
            found = [gram_numbers(t or "") for t in batch.column(2).to_pylist()]
            grams, line = np.concatenate(found), np.repeat(np.arange(len(found)), [len(g) for g in found])
            sig = np.full((len(found), permutations), (1 << 63) - 1, np.int64)
            for at in range(0, len(grams), block):
                here, some = line[at : at + block], grams[at : at + block]
                distinct, which = np.unique(some, return_inverse=True)
                first = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
                low = np.minimum.reduceat(gram_hashes(distinct, permutations)[which.reshape(-1)], first, axis=0)
                sig[here[first]] = np.minimum(sig[here[first]], low)
            edge = pa.array(np.arange(len(found) + 1) * permutations, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(edge, pa.array(sig.reshape(-1)))], names=["id", "place", "sig"])

    rows = lines.select("id", "place", "line")
    return rows.mapInArrow(run, StructType([*rows.schema[:2], StructField("sig", ArrayType(LongType()))]))


def lsh_pairs(lines: DataFrame, threshold: float = NEAR_THRESHOLD, bands: int = BANDS, hot: int = HOT) -> DataFrame:
    """a, b (a before b by ``place``) and similarity of lines whose signatures agree in ``threshold`` of all places.

    Lines with equal signatures are one class: its first line is compared with
    the other classes, and paired with the rest of its own; under the greedy
    rule the first line decides for all of them. Where more than ``hot`` classes
    share a band, they meet on it with a further part of the signature instead:
    of one part more than places may differ, one is equal, so no pair is lost.
    Signatures are much more than the lines: classes go by 128 bits of their
    hashes, and pairs are compared band by band, with that of no other on disk.
    """
    rows = PERMUTATIONS // bands
    cut = [f"band{b}" for b in range(bands)]
    made = signatures(lines).withColumn("one", F.xxhash64("sig")).withColumn("two", F.xxhash64(F.lit(1), "sig"))
    sig = written(made.select("id", "place", "one", "two", *[F.slice("sig", b * rows + 1, rows).alias(c) for b, c in enumerate(cut)]), "minhash")
    first = sig.groupBy("one", "two").agg(F.min(F.struct("place", "id")).alias("first")).select("one", "two", F.col("first.id").alias("id"), F.col("first.place").alias("place"))
    first = written(first, "minhash-classes")
    own = sig.select("one", "two", F.col("id").alias("b")).join(first.select("one", "two", F.col("id").alias("a")), ["one", "two"]).filter("a <> b").select("a", "b", F.lit(1.0).alias("similarity"))
    keys = sig.select("id", "place", F.array(*[F.xxhash64(c) for c in cut]).alias("keys")).join(first.select("id"), "id", "left_semi")
    band = keys.select("id", "place", F.posexplode("keys").alias("band", "key"))
    # at most one key in ``hot`` rows
    many = written(band.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("band", "key"), "minhash-hot")
    if not many.isEmpty():
        parts = min(PERMUTATIONS - math.ceil(threshold * PERMUTATIONS - 1e-9) + 1, PERMUTATIONS)
        # every parts-th place, so that parts are alike in size
        part = lambda k: F.xxhash64(k, F.filter("sig", lambda x, i: i % parts == k))
        whole = sig.select("id", F.concat(*cut).alias("sig")).select("id", F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), part).alias("parts"))
        shared = band.join(many, ["band", "key"], "left_semi").join(whole, "id").select("id", "place", "band", "key", F.explode("parts").alias("part"))
        band = band.join(many, ["band", "key"], "left_anti").unionByName(shared.select("id", "place", "band", F.xxhash64("key", "part").alias("key")))
    a, b = band.alias("a"), band.alias("b")
    near = F.col("a.place") < F.col("b.place")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    pairs = written(pairs.withColumn("same", F.lit(0)), "minhash-pairs")
    for k, c in enumerate(cut):
        # one band of the signatures at a time is shuffled; pairs that can no longer be similar go
        left, right = sig.select(F.col("id").alias("a"), F.col(c).alias("x")), sig.select(F.col("id").alias("b"), F.col(c).alias("y"))
        same = F.col("same") + F.size(F.filter(F.zip_with("x", "y", lambda x, y: x == y), lambda e: e))
        rest = PERMUTATIONS - (k + 1) * rows
        old, pairs = pairs, written(pairs.join(left, "a").join(right, "b").select("a", "b", same.alias("same")).filter((F.col("same") + rest) / F.lit(PERMUTATIONS) >= threshold), "minhash-pairs")
        dropped(old)
    other = pairs.select("a", "b", (F.col("same") / F.lit(PERMUTATIONS)).alias("similarity"))
    return other.unionByName(own)


def gram_numbers(text: str) -> np.ndarray:
    """Distinct byte 3-grams as numbers."""
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.int32)
    return np.unique(raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) if len(raw) > 2 else raw[:0]


def starts(values: np.ndarray) -> np.ndarray:
    """Whether a value of a sorted array is the first of its kind."""
    return np.concatenate([np.ones(min(len(values), 1), bool), values[1:] != values[:-1]])


def flat_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct byte 3-grams of each text end to end, and how many each has."""
    raw = column.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    size = np.diff(ends)
    if not len(size) or size.max() < 3:
        return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
    text = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.int64)
    line = np.repeat(np.arange(len(size)), size)
    inside = line[:-2] == line[2:]
    found = np.sort((line[:-2] << 24 | text[:-2] << 16 | text[1:-1] << 8 | text[2:])[inside])
    found = found[starts(found)]
    return (found & 0xFFFFFF).astype(np.int32), np.bincount(found >> 24, minlength=len(size))


def gram_lists(lines: DataFrame) -> DataFrame:
    """id, n and grams of lines of at least three bytes."""
    ship(lines.sparkSession)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            grams, n = flat_grams(batch.column(1))
            edge = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.ListArray.from_arrays(edge, pa.array(grams))], names=["id", "n", "grams"])

    return lines.select("id", "line").mapInArrow(lists, "id long, n int, grams array<int>").filter("n > 0")


def gram_counts(sets: DataFrame) -> DataFrame:
    """gram and n, the lines that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = np.sort(np.asarray(batch.column(0).flatten()))
            first = np.flatnonzero(starts(grams))
            gram, n = grams[first], np.diff(np.append(first, len(grams)))
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int32()), pa.array(n, pa.int64())], names=["gram", "n"])

    return sets.select("grams").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def apart(nx, ny, threshold: float):
    """Grams that at most are in only one of two similar sets of these sizes; a little more, so that rounding loses no pair."""
    return (nx + ny) * ((1 - threshold) / (1 + threshold)) + 1e-6


def sketches(sets: DataFrame, threshold: float, sure: int, frequent: int) -> DataFrame:
    """A row per line and level: id, n, level, own, parts and the words of the line's sketch.

    A level is a range of sizes; a line is in its own and, as the smaller one of
    a pair, in the next. The grams of a level are dealt into as many parts as
    grams can be apart there and ``sure`` more, so two similar lines are equal in
    at least ``sure`` parts; ``parts`` has 32 bits of a hash of each. The ``frequent`` most
    frequent grams are dealt in turn, so that parts are alike in size. A sketch
    has the parity of the grams that fall to each bit: two lines differ in at
    most as many bits as grams.
    """
    spark = sets.sparkSession
    top = gram_counts(sets).orderBy(F.desc("n"), "gram").limit(frequent).collect()
    sent = spark.sparkContext.broadcast(np.array([r["gram"] for r in top], np.int64))
    width = max(-math.log(threshold), 1e-3)
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), *[pa.int64()] * WORDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = np.full(1 << 24, -1, np.int32)
        turn[sent.value] = np.arange(len(sent.value))
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                ids, n = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1).value_lengths(), np.int64)
                g, line = np.asarray(batch.column(1).flatten(), np.int64), np.repeat(np.arange(len(n)), n)
                h = mixed(g.astype(np.uint64))
                dealt = np.where(turn[g] >= 0, turn[g], (h >> np.uint64(34)).astype(np.int64))
                bits = np.bincount(line * (64 * WORDS) + (h >> np.uint64(20)).astype(np.int64) % (64 * WORDS), minlength=len(n) * 64 * WORDS) & 1
                words = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64).reshape(-1, WORDS)
                place = np.log(n) / width
                own = np.floor(place + 1e-9).astype(np.int64)
                above = np.floor(place + 1 + 1e-6).astype(np.int64)
                for level, some in ((own, own == own), (own + 1, own == own), (above, above > own + 1)):
                    if not some.any():
                        continue
                    has = np.repeat(some, n)
                    level, size = level[some], n[some]
                    largest = np.exp((level + 1) * width + 1e-6)
                    k = np.floor(apart(largest, largest, threshold)).astype(np.int64) + sure
                    edge = np.concatenate([[0], np.cumsum(k)])
                    of = np.repeat(np.arange(len(k)), size)
                    sums = np.zeros(edge[-1], np.uint64)
                    with np.errstate(over="ignore"):
                        np.add.at(sums, edge[of] + dealt[has] % k[of], h[has])
                        part = np.arange(edge[-1]) - np.repeat(edge[:-1], k)
                        parts = mixed(sums + mixed((part + np.repeat(level << 32, k)).astype(np.uint64)))
                    parts = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array((parts >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                    columns = [ids[some], size, level, level == own[some], parts, *words[some].T]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["id", "n", "level", "own", "parts", *SKETCH])

    return sets.select("id", "grams").mapInArrow(run, "id long, n int, level int, own boolean, parts array<int>, " + ", ".join(f"{s} long" for s in SKETCH))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


#: A line under one of its keys, as tasks hand it on.
KEYED = np.dtype([("key", "<u8"), ("id", "<i8"), ("n", "<i4"), ("at", "<i4"), ("level", "<i2"), ("own", "?"), ("sketch", "<u8", (WORDS,))])


def keyed(table: DataFrame, depth: int, deepest: int, turn: int, turns: int, buckets: int) -> DataFrame:
    """bucket and rows: the lines' keys of one slice, packed (:data:`KEYED`).

    A key is a part that can be the ``depth``-th equal one, and behind the first
    the key of the parts before, which end at ``last``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            rows = np.concatenate(held)
            bucket = (mixed(rows["key"]) // np.uint64(turns) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            first = np.flatnonzero(starts(bucket))
            held.clear()
            packed = [rows[i:j].tobytes() for i, j in zip(first, [*first[1:], len(rows)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "rows"])

        for whole in batches:
            ends = np.cumsum(np.asarray(whole.column(4).value_lengths(), np.int64))
            start = 0
            while start < whole.num_rows:
                end = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK, side="right")), start + 1)
                batch, start = whole.slice(start, end - start), end
                id_, n, level, own, parts, before, last, *words = batch.columns
                k = np.asarray(parts.value_lengths(), np.int64)
                line, edge = np.repeat(np.arange(len(k)), k), np.cumsum(k)
                at = np.arange(edge[-1]) - np.repeat(edge - k, k)
                level = np.asarray(level, np.int64)
                part = (level[line] << 54 ^ at << 32 ^ np.asarray(parts.flatten(), np.int64) & 0xFFFFFFFF).astype(np.uint64)
                key = part if depth == 1 else mixed(mixed(part) ^ np.asarray(before, np.int64).view(np.uint64)[line])
                here = (at > np.asarray(last, np.int64)[line]) & (at <= k[line] - (deepest - depth + 1)) & (mixed(key) % np.uint64(turns) == turn)
                line = line[here]
                rows = np.empty(len(line), KEYED)
                rows["key"], rows["at"], rows["level"] = key[here], at[here], level[line]
                rows["id"], rows["n"], rows["own"] = np.asarray(id_)[line], np.asarray(n)[line], own.to_numpy(zero_copy_only=False)[line]
                for w, word in enumerate(words):
                    rows["sketch"][:, w] = np.asarray(word, np.int64).view(np.uint64)[line]
                held.append(rows)
                if sum(map(len, held)) > BLOCK:
                    yield out()
        if sum(map(len, held)):
            yield out()

    return table.select("id", "n", "level", "own", "parts", "key", "last", *SKETCH).mapInArrow(run, "bucket int, rows binary")


def differing(sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which sketches (a row of ``sketch`` per word) differ, in 8 bits: all of them, 256, come out as 0, which lets a pair in."""
    out = np.bitwise_count(sketch[0][i] ^ sketch[0][j])
    for word in sketch[1:]:
        out += np.bitwise_count(word[i] ^ word[j])
    return out


def near_places(rows: np.ndarray, first: np.ndarray, size: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of two rows of one key that can be similar by their sizes and sketches; keys are at ``first``, with ``size`` rows each."""
    n, own, sketch, id_ = rows["n"].astype(np.int64), rows["own"], np.ascontiguousarray(rows["sketch"].T), rows["id"]

    def possible(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        later = (n[i] > n[j]) | (n[i] == n[j]) & (id_[i] > id_[j])
        x, y = np.where(later, j, i), np.where(later, i, j)
        ok = own[y] & (id_[x] != id_[y]) & (n[x] >= n[y] * threshold - 1e-6)
        return np.stack([x[ok], y[ok]])

    few = size <= FEW
    # each row with those of its key that come after it
    left = np.repeat(first[few] + size[few], size[few])
    row = np.arange(len(left)) - np.repeat(np.cumsum(size[few]) - size[few], size[few]) + np.repeat(first[few], size[few])
    after = left - row - 1
    ends = np.cumsum(after)
    start = 0
    while start < len(row):
        end = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK, side="right")), start + 1)
        some, start = slice(start, end), end
        i = np.repeat(row[some], after[some])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[some]) - after[some], after[some])
        x, y = possible(i, j)
        ok = differing(sketch, x, y) <= apart(n[x], n[y], threshold)
        yield x[ok], y[ok]
    for begin, c in zip(first[~few], size[~few], strict=True):
        here = begin + np.argsort(n[begin : begin + c], kind="stable")
        for at in range(0, c, step := max(BLOCK // int(c), 1)):
            some = here[at : at + step]
            rest = here[at:]
            # at most as many as can be apart from the largest; what is let in is looked at again
            room = np.minimum(apart(n[some], n[rest].max(), threshold), 255).astype(np.uint8)
            i, j = np.nonzero(differing(sketch, some[:, None], rest[None, :]) <= room[:, None])
            x, y = possible(some[i[j > i]], rest[j[j > i]])
            ok = differing(sketch, x, y) <= apart(n[x], n[y], threshold)
            yield x[ok], y[ok]


def distinct_pairs(pairs: list[np.ndarray]) -> np.ndarray:
    a, b = np.concatenate(pairs, axis=1)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = starts(a) | starts(b)
    return np.stack([a[first], b[first]])


def meeting(packed: DataFrame, threshold: float, hot: int | None) -> DataFrame:
    """a < b of the lines that share a key and can be similar, level and last null.

    Of keys of more than ``hot`` lines, if that is given, the lines instead: a
    is the line, b the key, with the level and the place of the key's last part.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), KEYED)
        order = np.argsort(rows["key"], kind="stable")
        key = rows["key"][order]
        first = np.flatnonzero(starts(key))
        size = np.diff(np.append(first, len(key)))
        shared = size > 1
        rows, first, size = rows[order[np.repeat(shared, size)]], np.cumsum(size[shared]) - size[shared], size[shared]
        many = size > hot if hot else size < 0
        pairs, held = np.zeros((2, 0), np.int64), []
        for x, y in near_places(rows, first[~many], size[~many], threshold):
            x, y = rows["id"][x], rows["id"][y]
            held.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
            if sum(h.shape[1] for h in held) > BLOCK:
                pairs, held = distinct_pairs([pairs, *held]), []
        pairs = distinct_pairs([pairs, *held])
        over = rows[np.repeat(many, size)]
        none = pa.nulls(pairs.shape[1], pa.int32())
        columns = [[pa.array(pairs[0]), pa.array(over["id"])], [pa.array(pairs[1]), pa.array(over["key"].view(np.int64) if len(over) else over["id"])]]
        columns += [[none, pa.array(over["level"], pa.int32())], [none, pa.array(over["at"])]]
        return pa.Table.from_arrays([pa.chunked_array(c) for c in columns], names=["a", "b", "level", "last"])

    return packed.groupBy("bucket").applyInArrow(run, "a long, b long, level int, last int")


def similar_pairs(lines: DataFrame, threshold: float = NEAR_THRESHOLD, hot: int = HOT, deepest: int = DEEPEST, frequent: int = FREQUENT, turns: int = SLICES) -> DataFrame:
    """a < b (ids) and the exact Jaccard similarity of byte 3-grams, for all pairs at ``threshold`` or more.

    ``lines`` has id (unique) and line. Similar lines of a level are equal in
    ``deepest`` parts or more (:func:`sketches`), so the first of these is not among the
    last parts. Lines meet on a part; where
    more than ``hot`` lines share one, they meet on it with another part behind
    it instead, and so on up to ``deepest`` parts. Lines that meet are compared
    by their sketches, and only those that can be similar by these have their
    grams fetched. No pair is lost: keys of ``deepest`` parts are joined however
    many lines they have. Keys, each with its line's sketch, are much more than
    the lines; they are joined in ``turns`` slices one after the other, each a job whose
    shuffles are deleted before the next. A slice's keys are made from the parts
    in arrays and go to buckets of about ``BUCKET`` keys.
    """
    sets = written(gram_lists(lines), "gram-lists")
    dealt = written(sketches(sets, threshold, deepest, frequent), "gram-parts")
    found: list[DataFrame] = []
    table, depth = dealt.select("*", F.lit(0).cast("long").alias("key"), F.lit(-1).alias("last")), 1
    while True:
        keys = table.agg(F.sum(F.greatest(F.size("parts") - F.col("last") - 1, F.lit(0)))).first()[0] or 0
        buckets = max(lines.sparkSession.sparkContext.defaultParallelism, -(-keys // (turns * BUCKET)))
        met = []
        for turn in range(turns):
            packed = keyed(table, depth, deepest, turn, turns, buckets)
            met.append(written(meeting(packed, threshold, hot if depth < deepest else None).distinct(), "gram-pairs"))
        found += [m.filter("level IS NULL").select("a", "b") for m in met]
        shared = reduce(DataFrame.unionByName, met).filter("level IS NOT NULL").select(F.col("a").alias("id"), "level", "last", F.col("b").alias("key"))
        if depth > 1:
            dropped(table)
        if depth == deepest or shared.isEmpty():
            break
        table, depth = written(shared.join(dealt, ["id", "level"]), "gram-keys"), depth + 1
    dropped(dealt)
    pairs = reduce(DataFrame.unionByName, found).distinct()
    left, right = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
    common = F.size(F.array_intersect("ga", "gb"))
    similar = pairs.join(left, "a").join(right, "b").select("a", "b", (common / (F.size("ga") + F.size("gb") - common)).alias("similarity"))
    return similar.filter(F.col("similarity") >= threshold)


def exact_pairs(lines: DataFrame, threshold: float = NEAR_THRESHOLD) -> DataFrame:
    """:func:`similar_pairs` with the similarity to six places."""
    return similar_pairs(lines, threshold).select("a", "b", F.round("similarity", 6).alias("similarity"))


def greedy_resolve(pairs: DataFrame, report: dict | None = None) -> DataFrame:
    """ids that are dropped: a row stays if no earlier row that stays is similar to it.

    ``pairs`` has a (earlier) and b (later). A row's fate is "none of my earlier
    neighbours stays". Each round puts in what is known: a neighbour that
    stays drops the row, one that goes is forgotten, and a row with a single
    neighbour left has the opposite of its fate, so others depend on that one
    in its place. Such chains halve in every round: n links take about log n
    rounds. A row that depends on a row and on its opposite goes. The first
    undecided row is decided in every round, so it ends. ``report`` gets the
    number of rounds.
    """
    links = written(pairs.select(F.col("b").alias("id"), F.col("a").alias("of"), F.lit(False).alias("opposite")).distinct(), "greedy-links")
    nodes = links.select("id").unionByName(links.select(F.col("of").alias("id"))).distinct()
    # fate: kept is known, or is that of ``root`` (or its opposite); a row that is its own root is open
    fate = written(nodes.select("id", F.lit(None).cast("boolean").alias("kept"), F.col("id").alias("root"), F.lit(False).alias("turned")), "greedy-fates")
    rounds = 0
    while True:
        rounds += 1
        known = fate.select(F.col("id").alias("of"), F.col("kept").alias("k"), F.col("root").alias("r"), F.col("turned").alias("t"))
        # a link's value is whether that neighbour stays; rows of decided neighbours have one, others go on to the root
        value = F.col("k") != F.col("opposite")
        now = links.join(known, "of").select("id", value.alias("value"), F.when(F.col("k").isNull(), F.col("r")).alias("of"), (F.col("t") != F.col("opposite")).alias("opposite"))
        merged = now.groupBy("id", "of").agg(F.max("value").alias("value"), F.min("opposite").alias("low"), F.max("opposite").alias("high"))
        judged = merged.groupBy("id").agg(
            F.max(F.coalesce("value", F.lit(False)) | (F.col("of").isNotNull() & (F.col("low") != F.col("high")))).alias("goes"),
            F.count("of").alias("left"),
            F.min("of").alias("one"),
            F.min(F.when(F.col("of").isNotNull(), F.col("low"))).alias("one_opposite"),
        )
        ahead = fate.select(F.col("id").alias("root"), F.col("kept").alias("rk"), F.col("root").alias("rr"), F.col("turned").alias("rt"))
        own = fate.filter("kept IS NULL AND root <> id").join(ahead, "root").select("id", (F.col("rk") != F.col("turned")).alias("kept"), F.col("rr").alias("root"), (F.col("rt") != F.col("turned")).alias("turned"))
        open_ = fate.filter("kept IS NULL AND root = id").join(judged, "id", "left")
        single = F.col("left") == 1
        decided = F.when(F.col("goes"), F.lit(False)).when(F.coalesce("left", F.lit(0)) == 0, F.lit(True))
        opened = open_.select(
            "id",
            decided.alias("kept"),
            F.when(decided.isNull() & single, F.col("one")).otherwise(F.col("id")).alias("root"),
            F.when(decided.isNull() & single, ~F.col("one_opposite")).otherwise(F.lit(False)).alias("turned"),
        )
        done = fate.filter("kept IS NOT NULL")
        fate = written(done.unionByName(own).unionByName(opened), "greedy-fates")
        waiting = fate.filter("kept IS NULL")
        if waiting.isEmpty():
            break
        still = merged.filter("of IS NOT NULL").select("id", "of", F.explode(F.array_distinct(F.array("low", "high"))).alias("opposite"))
        links = written(still.join(waiting.filter("root = id").select("id"), "id", "left_semi"), "greedy-links")
    if report is not None:
        report["rounds"] = rounds
    return fate.filter("NOT kept").select("id")


def greedy_duplicates(lines: DataFrame, threshold: float = NEAR_THRESHOLD, exact: bool = False) -> DataFrame:
    """ids of the lines dropped by the greedy rule; ``lines`` has id, line and place.

    By signatures, or ``exact`` by the similarity itself. Then equal lines, and
    lines of fewer than three bytes, are one line each: the first of them is
    compared, the others go.
    """
    if not exact:
        return greedy_resolve(lsh_pairs(lines, threshold))
    text = F.when(F.octet_length("line") < 3, F.lit("")).otherwise(F.col("line"))
    keyed = lines.select("id", "place", F.sha2(text, 256).alias("text"))
    first = keyed.groupBy("text").agg(F.min(F.struct("place", "id")).alias("first")).select(F.col("first.id").alias("id"), F.col("first.place").alias("place"))
    first = written(first, "first-lines")
    distinct = lines.select("id", "line").join(first, "id", "left_semi")
    pairs = similar_pairs(distinct, threshold)
    one, two = first.select(F.col("id").alias("a"), F.col("place").alias("pa")), first.select(F.col("id").alias("b"), F.col("place").alias("pb"))
    before = F.col("pa") < F.col("pb")
    ordered = pairs.join(one, "a").join(two, "b").select(F.when(before, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("b"))
    copies = lines.select("id").join(first.select("id"), "id", "left_anti")
    return copies.unionByName(greedy_resolve(ordered))
