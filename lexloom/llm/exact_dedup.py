"""Operator 6: exact deduplication with Patricia tries.

Two levels of tries over normalised byte strings (every run of ASCII white
space is one space):

1. Each input partition inserts its texts into a trie of its own. A terminal
   node holds the smallest identifier and the number of copies, so a partition
   sends one text per group on, however many copies it holds. When a trie
   outgrows its byte budget its largest subtree is spilled: the groups of that
   subtree go to the shuffle, which keeps them on disk, and the nodes are freed.
2. The groups are dealt by (length, content hash); the owner of a partition
   inserts the full byte strings of all its keys into one trie, whose terminals
   hold the final smallest identifier and count. Rows come sorted by that key,
   so between two keys every text of the trie is complete, and when it outgrows
   the budget its largest subtree is given out and freed.

Every row remembers the group of its own partition, and a join on that group
(at most one partition's rows for a group) hands the result back, so a text
that fills a third of the table is never gathered in one task.

Null counts as empty; empty texts are copies of each other. Of rows that share
a doc_id each is a member of its group. A null doc_id comes after all others: it
is the smallest only where a group has no other. ``keep_first`` lets one row of
a group stay: of several with the smallest doc_id one of the smallest text hash.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.text import only_rows, row_tag
from lexloom.session import ship, written

#: Bytes of edge labels that a partition's trie holds before it spills a subtree.
TRIE_BYTES = 64 << 20
SPACES = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"     ")
RUN = re.compile(b"  +")


def normalise(raw: bytes) -> bytes:
    """Each run of space, tab, LF, VT, FF and CR as one space."""
    out = raw.translate(SPACES)
    return RUN.sub(b" ", out) if b"  " in out else out


class Node:
    """Terminals count at least one copy; their owner is null only if all copies' are."""

    __slots__ = ("label", "children", "owner", "count", "key")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] | None = None
        self.owner: int | None = None
        self.count = 0
        self.key: object = 0


def common(a: bytes, at: int, b: bytes) -> int:
    """Length of the common prefix of a[at:] and b."""
    n = min(len(a) - at, len(b))
    if a[at : at + n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[at + low : at + mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Patricia:
    """A compressed radix trie of byte strings with owners at its terminals."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.size = 0

    def insert(self, text: bytes, owner: int | None, count: int, key: object) -> Node:
        """The terminal node of ``text`` after counting it; new terminals keep ``key``."""
        node, at = self.root, 0
        while at < len(text):
            if node.children is None:
                node.children = {}
            child = node.children.get(text[at])
            if child is None:
                child = Node(text[at:])
                self.size += len(child.label) + 200
                node.children[text[at]] = child
                node, at = child, len(text)
                break
            n = common(text, at, child.label)
            if n < len(child.label):
                mid = Node(child.label[:n])
                child.label = child.label[n:]
                mid.children = {child.label[0]: child}
                node.children[text[at]] = mid
                self.size += 200
                child = mid
            node, at = child, at + n
        if not node.count:
            node.key = key
        if node.owner is None or owner is not None and owner < node.owner:
            node.owner = owner
        node.count += count
        return node

    @staticmethod
    def terminals(node: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
        stack = [(node, prefix)]
        while stack:
            x, before = stack.pop()
            text = before + x.label
            if x.count:
                yield text, x
            for child in (x.children or {}).values():
                stack.append((child, text))

    def weight(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.label) + 200
            stack.extend((x.children or {}).values())
        return total

    def spill(self) -> Iterator[tuple[bytes, Node]]:
        """Cut off the largest subtree below the root and yield its terminals."""
        if not self.root.children:
            return
        first = max(self.root.children, key=lambda b: self.weight(self.root.children[b]))
        node = self.root.children.pop(first)
        self.size -= self.weight(node)
        yield from self.terminals(node, b"")

    def drain(self) -> Iterator[tuple[bytes, Node]]:
        yield from self.terminals(self.root, b"")
        self.__init__()


LOCAL = pa.schema(
    [("doc_id", pa.int64()), ("tag", pa.int64()), ("part", pa.int64()), ("group", pa.int64()), ("owner", pa.int64()), ("copies", pa.int64()),
     ("n_bytes", pa.int64()), ("hash", pa.binary()), ("body", pa.binary())]
)
LOCAL_SQL = "doc_id long, tag long, part long, `group` long, owner long, copies long, n_bytes long, hash binary, body binary"


def _local(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        trie, made, rows, size = Patricia(), 0, [], 0

        def groups(found) -> None:
            nonlocal size
            for text, node in found:
                rows.append((None, None, part, node.key, node.owner, node.count, len(text), hashlib.sha256(text).digest(), text))
                size += len(text)

        def out() -> pa.RecordBatch:
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), LOCAL, strict=True)], schema=LOCAL)
            rows.clear()
            size = 0
            return batch

        for batch in batches:
            for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                body = normalise(text.as_buffer().to_pybytes() if text.is_valid else b"")
                node = trie.insert(body, doc, 1, made)
                made += node.count == 1
                rows.append((doc, tag, part, node.key, None, None, None, None, None))
                if trie.size > budget:
                    groups(trie.spill())
                if len(rows) >= 10_000 or size > 16 << 20:
                    yield out()
        for found in trie.drain():
            groups([found])
            if len(rows) >= 10_000 or size > 16 << 20:
                yield out()
        if rows:
            yield out()

    return run


OWNED = pa.schema([("part", pa.int64()), ("group", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("hash", pa.binary())])
OWNED_SQL = "part long, `group` long, keep_id long, group_size long, hash binary"


def _owners(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by (n_bytes, hash): between two such keys the trie's texts are complete."""
        trie, key, rows = Patricia(), None, []

        def give(found: Iterator[tuple[bytes, Node]]) -> Iterator[pa.RecordBatch]:
            for _, node in found:
                digest, members = node.key  # type: ignore[misc]
                rows.extend((part, group, node.owner, node.count, digest) for part, group in members)
                if len(rows) >= 10_000:
                    yield batch_of()

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OWNED, strict=True)], schema=OWNED)
            rows.clear()
            return out

        for batch in batches:
            for part, group, owner, copies, n, digest, text in zip(*(batch.column(i) for i in range(7)), strict=True):
                now = (n.as_py(), digest.as_py())
                if now != key:
                    while trie.size > budget:
                        yield from give(trie.spill())
                    key = now
                node = trie.insert(text.as_buffer().to_pybytes(), owner.as_py(), copies.as_py(), (now[1], []))
                node.key[1].append((part.as_py(), group.as_py()))  # type: ignore[index]
        yield from give(trie.drain())
        if rows:
            yield batch_of()

    return run


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    return _members(docs, text, doc_id, trie_bytes).drop("tag")


def _members(docs: DataFrame, text: str, doc_id: str, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """:func:`exact_groups` with the tag (hash of the text) of every row."""
    spark = docs.sparkSession
    ship(spark)
    local = written(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_tag(text).alias("tag"), F.col(text).cast("string").alias("text")).mapInArrow(
            _local(trie_bytes), LOCAL_SQL
        ),
        "exact-groups",
    )
    groups = local.filter("hash IS NOT NULL").select("part", "group", "owner", "copies", "n_bytes", "hash", "body")
    owned = groups.repartition(F.col("n_bytes"), F.col("hash")).sortWithinPartitions("n_bytes", "hash").mapInArrow(_owners(trie_bytes), OWNED_SQL)
    members = local.filter("hash IS NULL").select("doc_id", "tag", "part", "group")
    return members.join(owned.hint("shuffle_merge"), ["part", "group"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("hash")).alias("text_sha256"),
        "tag",
    )


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of every group of equal texts, the first; columns unchanged."""
    return only_rows(docs, _members(docs, text, doc_id).filter("kept").select("doc_id", "tag", F.col("text_sha256").alias("of")), text, doc_id)
