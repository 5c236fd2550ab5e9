"""Operator 9: near-duplicates by improved consistent weighted sampling.

A text is the multiset of its shingles of five words. The weight of a shingle
is its count times an inverse document frequency, which falls from 1 for
shingles of at most ``RARE`` of all documents to ``FLOOR`` for one of every
document. ``1 / RARE`` documents without any shingle are counted in, so the
weights follow one rule at every size and stay near 1 in small tables. Document
frequencies come from a count-min sketch of fixed size over all documents, so
its error is a fixed share of their number at any scale. A shingle that a third
of all documents hold weighs 0.80, so two copies in such a group, each with
shingles of its own, need a plain similarity of about 0.83 for a weighted 0.8.

1. Sketch: partitions sum counters, the counters are summed by block.
2. Signatures: consistent weighted samples of each distinct text of a partition
   in bands; texts with the same words collapse within the partition first.
3. Groups: texts that share a band key. A hot key, of more than ``GROUP`` texts
   by count, is first dealt into salted groups of that expected size, whose
   first texts meet in the next level, until one level has them all.
4. Verification: every pair within a group, by weighted Jaccard similarity of
   at least ``THRESHOLD``. A task holds one group at a time and gives back the
   links that connect its verified classes, at most one per text. Texts of a
   hot key that these links leave in different components then meet in pairs of
   blocks, so every two texts of any key are compared or already connected.
5. Classes: connected components of the links by large and small stars in
   turn, whose rounds grow with the logarithm of a chain's length; there is no
   limit to them.

A pair of similarity s shares a group with probability 1 - (1 - s^4)^16: 0.9998
at 0.8. The classes are those of comparing all pairs of every key. The cost of
a hot key grows with the product of the sizes of its unconnected parts.

Null counts as empty. Texts without words are classes of their own row each. A
text of fewer than five words, but not none, is one shingle. Repeated rows are
copies of each other. A null doc_id comes after all others: a class has a null
class_id only if it has no other. ``keep_first`` lets one row of a class stay:
of several with the smallest doc_id one of the smallest text hash. Other columns are ignored. An empty table gives an empty
result. Very long texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.text import BASE, Words, groups, mix64, only_rows, release, row_tag, shingles, texts_of
from lexloom.session import ship, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
RARE, FLOOR = 1 / 200, 0.75
WIDTH_BITS, DEPTH, BLOCK_CELLS = 20, 2, 8192
GROUP = 256
#: Hot keys, and nodes of theirs, are sent to the executors up to this number, joined beyond it.
SENT_KEYS = 1_000_000
#: Columns of the similarity matrix that are worked on at once.
COLUMNS = 4096
SEEDS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * BASE) | np.uint64(1)
ROW_SEEDS = mix64(np.arange(101, 101 + DEPTH, dtype=np.uint64) * BASE) | np.uint64(1)
MULTIPLY = np.uint64(0xD6E8FEB86659FD93)


def cells(h: np.ndarray) -> np.ndarray:
    """Counter of each shingle in each row of the sketch."""
    at = np.stack([(mix64(h * s) >> np.uint64(64 - WIDTH_BITS)).astype(np.int64) for s in ROW_SEEDS])
    return at + (np.arange(DEPTH, dtype=np.int64) << WIDTH_BITS)[:, None]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Words, int]]:
    """(doc_id, tag) of a run of rows, their words and their number."""
    for batch in batches:
        data, offsets = texts_of(batch.column(1))
        docs = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
        for a, b in groups(offsets):
            yield docs[a:b], Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DEPTH << WIDTH_BITS, np.uint32), 0
    for _, words, rows in _texts(batches):
        n += rows
        each = [np.unique(shingles(words.hashes[words.first[k] : words.first[k + 1]], SHINGLE)) for k in range(rows)]
        at = cells(np.concatenate(each)) if each else np.zeros((DEPTH, 0), np.int64)
        for row in at:
            where, times = np.unique(row, return_counts=True)
            total[where] += times.astype(np.uint32)
    blocks = total.reshape(-1, BLOCK_CELLS)
    some = np.flatnonzero(blocks.any(axis=1))
    for i in range(0, len(some), 64):
        part = some[i : i + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array([zlib.compress(blocks[b].tobytes(), 1) for b in part], pa.binary()), pa.array([0] * len(part), pa.int64())],
            names=["block", "cells", "n"],
        )
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([n], pa.int64())], names=["block", "cells", "n"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    n = 0
    for batch in batches:
        for b, c, m in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n += m
            if b >= 0:
                cells_ = np.frombuffer(zlib.decompress(c), np.uint32)
                held[b] = held[b] + cells_ if b in held else cells_.astype(np.int64)
    rows = [(b, zlib.compress(x.tobytes(), 1), 0) for b, x in held.items()] + [(-1, b"", n)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())],
        names=["block", "cells", "n"],
    )


SKETCH_SQL = "block int, cells binary, n long"


def idf_levels(docs: DataFrame) -> np.ndarray:
    """One byte per counter of the sketch: 0 for ``FLOOR`` up to 255 for 1. Two megabytes at any scale."""
    parts = docs.mapInArrow(_count, SKETCH_SQL)
    summed = parts.repartition(F.col("block")).mapInArrow(_sum, SKETCH_SQL)
    total, n = np.zeros((DEPTH << WIDTH_BITS) // BLOCK_CELLS * BLOCK_CELLS, np.int64).reshape(-1, BLOCK_CELLS), 0
    for r in summed.toLocalIterator():
        n += r[2]
        if r[0] >= 0:
            total[r[0]] += np.frombuffer(zlib.decompress(r[1]), np.int64)
    share = np.maximum(total.ravel(), 1) / (n + 1 / RARE)
    scaled = np.clip(np.log(1 / np.minimum(share, 1)) / np.log(1 / RARE), 0, 1)
    return np.rint(scaled * 255).astype(np.uint8)


def weigh(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Level of each shingle: the larger of its counters' levels, as the smaller count is nearer the truth."""
    return levels[cells(h)].max(axis=0)


def idf(level: np.ndarray) -> np.ndarray:
    return FLOOR + (1 - FLOOR) / 255 * level.astype(np.float64)


def signature(h: np.ndarray, weight: np.ndarray) -> list[int]:
    """Band keys of a weighted set by improved consistent weighted sampling."""
    best = np.full(len(SEEDS), np.inf, np.float32)
    chosen = np.zeros(len(SEEDS), np.uint64)
    scale = np.float32(2.0**-42)
    low = np.uint64((1 << 21) - 1)
    rows = np.arange(len(SEEDS))
    for a in range(0, len(h), 2048):
        part, logs = h[a : a + 2048], np.log(weight[a : a + 2048]).astype(np.float32)
        x = part[None, :] * SEEDS[:, None]
        x ^= x >> np.uint64(32)
        x *= MULTIPLY
        x ^= x >> np.uint64(29)
        y = x * BASE
        y ^= y >> np.uint64(32)
        u1 = (x >> np.uint64(43)).astype(np.float32) + np.float32(0.5)
        u2 = ((x >> np.uint64(22)) & low).astype(np.float32) + np.float32(0.5)
        r = -np.log(u1 * u2 * scale)
        u3 = ((x ^ (y >> np.uint64(7))) & low).astype(np.float32) + np.float32(0.5)
        u4 = (y >> np.uint64(43)).astype(np.float32) + np.float32(0.5)
        c = -np.log(u3 * u4 * scale)
        beta = ((y >> np.uint64(21)) & low).astype(np.float32) * np.float32(2.0**-21)
        t = np.floor(logs / r + beta)
        rank = np.log(c) - r * (t - beta) - r
        k = rank.argmin(axis=1)
        value = rank[rows, k]
        better = value < best
        best = np.where(better, value, best)
        mark = mix64(part[k] ^ (t[rows, k].astype(np.int64).astype(np.uint64) * MULTIPLY))
        chosen = np.where(better, mark, chosen)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix64(key * BASE + chosen.reshape(BANDS, ROWS)[:, j])
    return key.view(np.int64).tolist()


NODES = pa.schema(
    [("doc_id", pa.int64()), ("tag", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64())), ("elements", pa.list_(pa.int32())), ("levels", pa.binary())]
)
NODES_SQL = "doc_id long, tag long, node long, bands array<long>, elements array<int>, levels binary"


def elements(h: np.ndarray, times: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A multiset as a set: the i-th copy of a shingle is an element of its own. Sorted 32-bit hashes and levels."""
    if times.max() > 1:
        copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        h, level = np.repeat(h, times), np.repeat(level, times)
        h = np.where(copy > 0, mix64(h + copy.astype(np.uint64) * BASE), h)
    small = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
    order = np.argsort(small, kind="stable")
    return small[order], level[order]


def _nodes(levels_sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        levels = levels_sent.value
        first = TaskContext.get().partitionId() << 33
        known: dict[bytes, int] = {}
        made = 0
        for docs, words, rows in _texts(batches):
            out = []
            for k in range(rows):
                seq = words.hashes[words.first[k] : words.first[k + 1]]
                if not len(seq):
                    out.append((*docs[k], first + made, [], [], b""))
                    made += 1
                    continue
                place = np.arange(len(seq), dtype=np.uint64)
                print_ = np.array([len(seq), np.bitwise_xor.reduce(mix64(seq + place * BASE)), np.add.reduce(mix64(seq ^ (place * MULTIPLY)))], np.uint64).tobytes()
                node = known.get(print_)
                if node is not None:
                    out.append((*docs[k], node, None, None, None))
                    continue
                node = known[print_] = first + made
                made += 1
                h, times = np.unique(shingles(seq, SHINGLE), return_counts=True)
                level = weigh(h, levels)
                e, lv = elements(h, times, level)
                out.append((*docs[k], node, signature(h, times * idf(level)), e, lv.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), NODES, strict=True)], schema=NODES)
        known.clear()
        release()

    return run


def similar_pairs(sets: list[np.ndarray], levels: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix: weighted Jaccard similarity of at least ``threshold``."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    weight = idf(np.concatenate(levels))
    total = np.bincount(owner, weight, minlength=m)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    owner, column, weight = owner[use], number[column[use]], weight[use]
    order = np.argsort(column, kind="stable")
    owner, column, weight = owner[order], column[order], weight[order]
    both = np.zeros((m, m))
    n = int(shared.sum())
    for a in range(0, n, COLUMNS):
        i, j = np.searchsorted(column, (a, a + COLUMNS))
        dense = np.zeros((m, min(COLUMNS, n - a)), np.float32)
        dense[owner[i:j], column[i:j] - a] = np.sqrt(weight[i:j])
        both += dense @ dense.T
    union = total[:, None] + total[None, :] - both
    similar = both >= threshold * union - 1e-4
    np.fill_diagonal(similar, True)  # elements of one set only are not in ``both``
    return similar


def class_links(nodes: list[int], similar: np.ndarray) -> list[tuple[int, int]]:
    """(first, other) for every class of the similarity graph."""
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(similar, 1)), strict=True):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(nodes[root(i)], nodes[i]) for i in range(len(nodes)) if root(i) != i]


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group."""
        now, nodes, sets, levels = None, [], [], []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(nodes) > 1:
                out.extend(class_links(nodes, similar_pairs(sets, levels, threshold)))

        for batch in batches:
            for g, node, e, lv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if g != now:
                    close()
                    now, nodes, sets, levels = g, [], [], []
                nodes.append(node)
                sets.append(e.values.to_numpy())
                levels.append(np.frombuffer(lv.as_py(), np.uint8))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
        nodes, sets, levels = [], [], []
        release()

    return run


def band_rows(nodes: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(node, key) of keys with 2 to ``group`` texts, and (node, key, n) of larger ones, by the counted size of each key."""
    rows = nodes.filter(F.size("bands") > 0).select("node", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = written(sizes.filter(F.col("n") > group), "hot-keys")
    if hot.count() <= SENT_KEYS:
        hot = hot.hint("broadcast")
    return rows.join(hot, "key", "left_anti"), written(rows.join(hot, "key"), "hot-rows")


def candidate_groups(cold: DataFrame, hot: DataFrame, group: int = GROUP) -> DataFrame:
    """Distinct groups (gid, members): all texts of a cold key, salted groups and their first texts of a hot one."""
    every = cold.groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("members")).filter(F.size("members") > 1).select("members")
    most = hot.agg(F.max("n")).first()[0] or 0
    rows = hot.select("node", "key", F.ceil(F.col("n") / group).alias("salts"))
    most = -(-most // group)
    while most > 0:
        salt = F.pmod(F.xxhash64("node", "key"), F.col("salts"))
        level = rows.groupBy("key", "salts", salt.alias("salt")).agg(F.array_sort(F.collect_list("node")).alias("members"))
        every = every.unionByName(level.filter(F.size("members") > 1).select("members"))
        rows = level.filter("salts > 1").select(F.element_at("members", 1).alias("node"), "key", F.ceil(F.col("salts") / group).alias("salts"))
        most = -(-most // group) if most > 1 else 0
    return every.select(F.xxhash64("members").alias("gid"), "members").dropDuplicates(["gid"])


def unmet_groups(hot: DataFrame, parts: DataFrame, group: int = GROUP) -> DataFrame:
    """gid and node: pairs of blocks that hold every pair of texts of a hot key not yet in one component.

    ``parts`` has the component (label) of nodes with links. A component with
    half a group of a key's texts has blocks of its own, which do not meet each
    other; the key's other texts share blocks, which meet all.
    """
    half = max(group // 2, 1)
    placed = written(hot.join(parts.select("node", "label"), "node", "left").select("key", "node", F.coalesce("label", "node").alias("part")), "hot-parts")
    shares = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    several = shares.groupBy("key").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("key")
    shares = written(shares.join(several, "key").withColumn("of", F.when(F.col("n") >= half, F.col("part")).otherwise(F.lit(-1))), "hot-shares")
    slots = shares.groupBy("key", "of").agg(F.ceil(F.sum("n") / half).alias("slots"))
    place = shares.join(slots, ["key", "of"]).select("key", "part", "of", "slots")
    members = placed.join(place, ["key", "part"]).select("key", "of", F.pmod(F.xxhash64("node"), F.col("slots")).alias("slot"), "node")
    blocks = slots.select("key", "of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"))
    other = blocks.select("key", F.col("of").alias("of2"), F.col("slot").alias("slot2"))
    meet = blocks.join(other, "key").filter("of < of2 OR of = -1 AND of2 = -1 AND slot < slot2").withColumn("gid", F.xxhash64("key", "of", "slot", "of2", "slot2"))
    sides = meet.select("gid", "key", "of", "slot").unionByName(meet.select("gid", "key", F.col("of2").alias("of"), F.col("slot2").alias("slot")))
    return sides.join(members, ["key", "of", "slot"]).select("gid", "node")


def smallest(pairs: DataFrame) -> DataFrame:
    """node and the smallest of it and its neighbours, for (node, near)."""
    return pairs.groupBy("node").agg(F.least("node", F.min("near")).alias("low"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest one. Links may come several times."""
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("near"))
    low = smallest(pairs.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near"))))
    return pairs.join(low, "node").select(F.col("low").alias("a"), F.col("near").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to its smallest one."""
    pairs = edges.select(F.col("b").alias("node"), F.col("a").alias("near"))
    low = smallest(pairs)
    moved = pairs.join(low, "node").filter("near > low").select(F.col("low").alias("a"), F.col("near").alias("b"))
    return moved.unionByName(low.select(F.col("low").alias("a"), F.col("node").alias("b"))).distinct()


def all_stars(edges: DataFrame) -> bool:
    """No node has two links from below, or links both ways."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("a").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    return ends.groupBy("node").agg(F.sum("below").alias("n"), F.max("above").alias("both")).filter("n > 1 OR n > 0 AND both > 0").isEmpty()


def stars(edges: DataFrame) -> DataFrame:
    """Links (a, b), a before b, with the same connected components, each a star around its smallest node."""
    edges = written(small_star(edges), "links")
    while not all_stars(edges):
        edges = written(small_star(large_star(edges)), "links")
    return edges


def roots(links: DataFrame) -> DataFrame:
    """node and root (smallest node) of every node with links, from :func:`stars`."""
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def classes_of(edges: DataFrame, least: DataFrame) -> DataFrame:
    """node, root (smallest node) and label (smallest ``least``) of its connected component; only nodes with links (a, b), a before b."""
    member = roots(stars(edges)).join(least, "node")
    label = member.groupBy("root").agg(F.min("least").alias("label"))
    return written(member.join(label, "root").select("node", "root", "label"), "labels")


def near_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class) and kept of every row."""
    return _members(docs, text, doc_id, threshold, group).select("doc_id", "class_id", "kept")


def _members(docs: DataFrame, text: str, doc_id: str, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """:func:`near_classes` with the tag (hash of the text) of every row and ``of``, the first node of its class."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), row_tag(text).alias("tag"))
    levels = spark.sparkContext.broadcast(idf_levels(source))
    nodes = written(source.mapInArrow(_nodes(levels), NODES_SQL), "nodes")
    least = nodes.groupBy("node").agg(F.min("doc_id").alias("least"))
    sets = nodes.filter(F.size("bands") > 0).select("node", "elements", "levels")

    def verified(pairs: DataFrame, sets: DataFrame = sets) -> DataFrame:
        dealt = pairs.join(sets.hint("shuffle_merge"), "node").select("gid", "node", "elements", "levels").repartition(F.col("gid"))
        return written(dealt.sortWithinPartitions("gid", "node").mapInArrow(_verify(threshold), "a long, b long"), "verified")

    cold, hot = band_rows(nodes.select("node", "bands"), group)
    edges = verified(candidate_groups(cold, hot, group).select("gid", F.explode("members").alias("node")))
    if not hot.isEmpty():
        connected = stars(edges)
        unmet = written(unmet_groups(hot, roots(connected).withColumnRenamed("root", "label"), group), "unmet")
        few = written(unmet.select("node").distinct(), "unmet-nodes")
        some = sets.join(few.hint("broadcast"), "node", "left_semi") if few.count() <= SENT_KEYS else sets
        edges = connected.unionByName(verified(unmet, some))
    labels = classes_of(edges, least)
    classes = least.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("of"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("label")).alias("class_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
    return nodes.select("doc_id", "tag", "node").join(classes.hint("shuffle_merge"), "node").select("doc_id", "tag", "of", "class_id", kept)


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of every class, the first; columns unchanged."""
    return only_rows(docs, _members(docs, text, doc_id).filter("kept").select("doc_id", "tag", "of"), text, doc_id)
