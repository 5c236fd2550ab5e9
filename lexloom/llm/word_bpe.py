"""Operator 11: BPE encoding and decoding by tree concatenation.

A text is split where the tokenizer's own rules split it: special tokens, white
space, letters, single numbers and the rest. Each word becomes its bytes, the
last one with the mark of a word's end, and adjacent pairs merge by rank, from
the left. A word of more than ``LEAF`` symbols is unsplit text that is long:
its halves are encoded apart, down to leaves, and joined. A join encodes the
tokens around the seam again, in a window that doubles on each side until its
first and its last token are those that the sides have there already.

That is exact. Every merge has a higher rank than the merges that make its two
sides (checked when a model is read), so ranks only rise while a text is
merged, and whether a merge crosses the place between two tokens depends on
these two alone. Tokens that are neighbours in a right encoding stay neighbours
in every text in which each two neighbours are so.

Words of more than ``GIANT`` characters are cut into leaves that are rows of
their own, so that tasks on several machines encode them; each level of the
tree then joins two neighbours per row. Shorter ones are joined within a task.

Null counts as empty; an empty text has no ids. A null doc_id stays null,
repeated rows give repeated results, other columns are ignored, an empty table
gives an empty result. Texts are encoded whole, in sections that end before a
space, so a task holds little more than the text itself. Characters that
Python's Unicode tables do not know yet are lower-cased and split by the
library's own normaliser, as its tables may be newer.

Supported models: BPE with NFC, white space to one space and lower-casing,
split by the pattern below, bytes as symbols, without decoder; others are
refused. Without a decoder, decoding joins the tokens by spaces.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.piece_bpe import DIGEST, DIGEST_SQL
from lexloom.session import ship, written

#: The rules that a supported model states.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES = r"\t-\r \x85\xa0  -     　"
END = "</w>"
#: Up to so many symbols the agenda of a word is a list, above it a heap.
SHORT = 32
#: Symbols of a leaf, and characters from which leaves are rows of their own.
LEAF, GIANT = 4_096, 1 << 20
#: Characters of a section, and what a worker remembers of words.
SECTION, REMEMBERED, LONGEST = 1 << 18, 300_000, 48
CUT = re.compile(r"[ \n]")


def ranges(kinds: str, end: int = sys.maxunicode + 1) -> str:
    """The characters below ``end`` of the Unicode categories that begin so, as the inside of a character class."""
    out, begin = [], -1
    for c in range(end + 1):
        inside = c < end and unicodedata.category(chr(c)).startswith(kinds)
        if inside and begin < 0:
            begin = c
        elif not inside and begin >= 0:
            out.append(f"\\U{begin:08x}-\\U{c - 1:08x}")
            begin = -1
    return "".join(out)


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin 1, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordTokenizer:
    """Encoder and decoder of one model of words."""

    def __init__(self, raw: bytes, leaf: int = LEAF):
        spec = json.loads(raw)
        model, split = spec["model"], spec["pre_tokenizer"]
        kinds = [p["type"] for p in split.get("pretokenizers", [])]
        if model["type"] != "BPE" or spec["normalizer"] != NORMALIZER or kinds != ["Split", "ByteLevel"] or spec["decoder"] is not None:
            raise ValueError("only BPE models of lower-cased words without a decoder are supported")
        cut, level = split["pretokenizers"]
        if cut["pattern"] != {"Regex": PATTERN} or not cut["invert"] or cut["behavior"] != "Removed" or level["add_prefix_space"] or level["use_regex"]:
            raise ValueError("only the usual pattern of words is supported")
        off = [k for k in ("dropout", "unk_token", "continuing_subword_prefix") if model.get(k)] + [k for k in ("byte_fallback", "ignore_merges") if model.get(k)]
        if off or model["end_of_word_suffix"] != END:
            raise ValueError(f"unsupported options of the model: {off}")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens have to match exactly")
        self.raw, self.leaf = raw, leaf
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = {i: t for t, i in [*ids.items(), *self.special.items()]}
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + END] for c in letters]
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self.symbols: dict[int, tuple[int, ...]] = {i: (i,) for i in [*self.inner, *self.last]}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, new = ids[a], ids[b], ids[a + b]
            if left not in self.symbols or right not in self.symbols or new in self.symbols:
                raise ValueError(f"merge {r} uses what later merges make, or makes a token again")
            self.rank[left << 32 | right] = r
            self.made.append(new)
            self.symbols[new] = self.symbols[left] + self.symbols[right]
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        shorts = PATTERN.split("[", 1)[0]
        self.ascii = re.compile(shorts + "[a-z]+|[0-9]|[^\\t-\\r 0-9a-z]+")
        #: pattern of words and class of unknown characters, for texts of the lowest plane (whose classes are bitmaps) and for all
        self.rules = []
        for end in (1 << 16, sys.maxunicode + 1):
            letter, number = ranges("L", end), ranges("N", end)
            self.rules.append((re.compile(f"{shorts}[{letter}]+|[{number}]|[^{SPACES}{letter}{number}]+"), re.compile(f"[{ranges('Cn', end)}]")))
        self.high = re.compile("[^\\x00-\\uffff]")
        self.library = None
        self.known: dict[str, str] = {}
        self.plain: dict[str, str] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """Merge by rank, equal ranks from the left."""
        n, rank, made = len(symbols), self.rank.get, self.made
        if n <= SHORT:
            symbols, none = list(symbols), len(made)
            agenda = [rank(a << 32 | b, none) for a, b in zip(symbols, symbols[1:])]
            while agenda:
                best = min(agenda)
                if best == none:
                    break
                i = agenda.index(best)
                symbols[i : i + 2] = [made[best]]
                agenda.pop(i)
                if i < len(agenda):
                    agenda[i] = rank(symbols[i] << 32 | symbols[i + 1], none)
                if i:
                    agenda[i - 1] = rank(symbols[i - 1] << 32 | symbols[i], none)
            return symbols
        symbols = list(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n or rank(symbols[i] << 32 | symbols[j]) != r:
                continue
            symbols[i], symbols[j] = made[r], -1
            nxt = after[i] = after[j]
            if nxt < n:
                before[nxt] = i
                if (r := rank(symbols[i] << 32 | symbols[nxt])) is not None:
                    heapq.heappush(heap, (r, i))
            prev = before[i]
            if prev >= 0 and (r := rank(symbols[prev] << 32 | symbols[i])) is not None:
                heapq.heappush(heap, (r, prev))
        return [s for s in symbols if s >= 0]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' text from their encodings."""
        if not left or not right:
            return left + right
        k = m = 1
        while True:
            a, b = left[-k:], right[:m]
            window = self.merged([s for t in a + b for s in self.symbols[t]])
            left_agrees = k >= len(left) or window[0] == a[0]
            right_agrees = m >= len(right) or window[-1] == b[-1]
            if left_agrees and right_agrees:
                return left[:-k] + window + right[m:]
            k, m = k if left_agrees else 2 * k, m if right_agrees else 2 * m

    def tree(self, symbols: list[int]) -> list[int]:
        """Encode halves apart and join them."""
        if len(symbols) <= self.leaf:
            return self.merged(symbols)
        half = len(symbols) // 2
        return self.joined(self.tree(symbols[:half]), self.tree(symbols[half:]))

    def base(self, word: bytes, ends: bool = True) -> list[int]:
        """The symbols of a word's bytes; ``ends``: its last byte is the word's end."""
        out = [self.inner[b] for b in word]
        if ends and word:
            out[-1] = self.last[word[-1]]
        return out

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, lower-cased."""
        if text.isascii():
            return self.ascii.findall(text.lower())
        words, new = self.rules[bool(self.high.search(text))]
        if new.search(text):
            return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self._steps().pre_tokenize_str(self.library.normalizer.normalize_str(text))]
        return words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _steps(self):
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.raw.decode())
        return self.library.pre_tokenizer

    def sections(self, text: str) -> Iterator[tuple[int, str]]:
        """(special id or -1, text without special tokens), cut before spaces."""
        parts = self.cut.split(text) if self.cut and "<" in text else [text]
        for part in parts:
            if part in self.special:
                yield self.special[part], part
                continue
            at = 0
            while at < len(part):
                stop = CUT.search(part, at + SECTION) if len(part) - at > SECTION else None
                end = stop.start() if stop else len(part)
                yield -1, part[at:end]
                at = end

    def _learn(self, word: str) -> tuple[str, str]:
        ids = self.tree(self.base(word.encode()))
        out = " ".join(map(str, ids)), " ".join([self.name[i] for i in ids])
        if len(word) <= LONGEST and len(self.known) < REMEMBERED:
            self.known[word], self.plain[word] = out
        return out

    def strings(self, text: str) -> Iterator[tuple[str, str]]:
        """Decimal ids and decoded tokens of a text's sections, both joined by spaces; empty ones are left out."""
        for special, part in self.sections(text):
            if special >= 0:
                yield str(special), self.name[special]
                continue
            words = self.split(part)
            ids = list(map(self.known.get, words))
            tokens = list(map(self.plain.get, words))
            if None in ids:
                for i, x in enumerate(ids):
                    if x is None:
                        ids[i], tokens[i] = self._learn(words[i])
            if ids:
                yield " ".join(ids), " ".join(tokens)

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.strings(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.name[i] for i in ids])

    def digest(self, parts: Iterator[tuple[str, str]]) -> tuple[int, str, str]:
        """Number of ids and the digests of ids and decoded text."""
        n, one, two = 0, hashlib.sha256(), hashlib.sha256()
        for ids, tokens in parts:
            if n:
                one.update(b" ")
                two.update(b" ")
            n += ids.count(" ") + 1
            one.update(ids.encode())
            two.update(tokens.encode())
        return n, one.hexdigest(), two.hexdigest()


_LOADED: dict[tuple[str, int], WordTokenizer] = {}


def loaded(raw: bytes, leaf: int = LEAF) -> WordTokenizer:
    """One tokenizer per worker and model."""
    key = hashlib.sha256(raw).hexdigest(), leaf
    if key not in _LOADED:
        _LOADED[key] = WordTokenizer(raw, leaf)
    return _LOADED[key]


def _named(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encoded(docs: DataFrame, model: bytes, text: str = "text", doc_id: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """doc_id, ids and the decoded text of every row."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(sent.value, leaf)
        for batch in batches:
            for at in range(len(batch)):
                ids = tok.encode(batch.column(1)[at].as_py() or "")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 1), pa.array([ids], pa.list_(pa.int32())), pa.array([tok.decode(ids)], pa.string())], names=["doc_id", "ids", "decoded"]
                )

    return _named(docs, text, doc_id).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: bytes, text: str = "text", doc_id: str = "doc_id", leaf: int = LEAF, giant: int = GIANT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row.

    Texts of more than ``giant`` characters are encoded by several tasks each.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = _named(docs, text, doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(sent.value, leaf)
        for batch in batches:
            found = [tok.digest(tok.strings(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())],
                schema=DIGEST,
            )

    size = F.coalesce(F.length("text"), F.lit(0))
    longest = rows.agg(F.max(size)).first()[0] or 0
    plain = rows.filter(size <= giant).mapInArrow(run, DIGEST_SQL)
    return plain if longest <= giant else plain.unionByName(_giants(rows.filter(size > giant), sent, leaf, giant))


PARTS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("seq", pa.int64()), ("part", pa.int64()), ("ends", pa.bool_()), ("body", pa.binary())])
PARTS_SQL = "doc_id long, row long, seq long, part long, ends boolean, body binary"
IDS = pa.schema([f for f in PARTS if f.name != "ends"])
IDS_SQL = "doc_id long, row long, seq long, part long, body binary"


def _giants(rows: DataFrame, sent, leaf: int, giant: int) -> DataFrame:
    """Digests of very long texts, whose sections and leaves are rows.

    ``seq`` numbers a text's sections and ``part`` the leaves of a word that is
    cut; other sections are part -1.
    """
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "giant-texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, step = loaded(sent.value, leaf), max(leaf, giant)
        for batch in batches:
            for doc, text, row in zip(*(batch.column(c) for c in ("doc_id", "text", "row")), strict=True):
                seq = 0
                one = lambda part, ends, body: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((doc.as_py(), row.as_py(), seq, part, ends, body), PARTS, strict=True)], schema=PARTS)  # noqa: B023, E731
                for special, section in tok.sections(text.as_py()):
                    if special >= 0 or len(section) <= giant:
                        yield one(-1, special >= 0, section.encode())
                        seq += 1
                        continue
                    for word in tok.split(section):
                        raw = word.encode()
                        if len(raw) <= step:
                            yield one(-1, False, raw)
                        else:
                            for part, at in enumerate(range(0, len(raw), step)):
                                yield one(part, at + step >= len(raw), raw[at : at + step])
                        seq += 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(sent.value, leaf)
        for batch in batches:
            out = []
            for part, ends, body in zip(*(batch.column(c).to_pylist() for c in ("part", "ends", "body")), strict=True):
                if part >= 0:
                    ids = tok.tree(tok.base(body, ends))
                else:
                    ids = [tok.special[body.decode()]] if ends else tok.encode(body.decode())
                out.append(np.asarray(ids, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "seq", "part")), pa.array(out, pa.binary())], schema=IDS)

    def join(table: pa.Table) -> pa.Table:
        two = sorted(table.to_pylist(), key=lambda r: r["part"])
        ids = np.frombuffer(two[0]["body"], "<u4").tolist()
        for r in two[1:]:
            ids = loaded(sent.value, leaf).joined(ids, np.frombuffer(r["body"], "<u4").tolist())
        return pa.Table.from_pylist([two[0] | {"part": two[0]["part"] // 2, "body": np.asarray(ids, "<u4").tobytes()}], schema=IDS)

    def finish(table: pa.Table) -> pa.Table:
        tok = loaded(sent.value, leaf)
        found = sorted(zip(table.column("seq").to_pylist(), range(len(table))))
        bodies = (np.frombuffer(table.column("body")[i].as_py(), "<u4").tolist() for _, i in found)
        n, one, two = tok.digest((" ".join(map(str, ids)), tok.decode(ids)) for ids in bodies if ids)
        return pa.Table.from_arrays([table.column("doc_id").slice(0, 1), pa.array([n], pa.int64()), pa.array([one]), pa.array([two])], schema=DIGEST)

    spread = rows.mapInArrow(cut, PARTS_SQL).repartition("row", "seq", "part")
    level = written(spread.mapInArrow(encode, IDS_SQL), "giant-leaves")
    whole = level.filter("part < 0")
    leaves = level.filter("part >= 0")
    most = leaves.agg(F.max("part")).first()[0] or 0
    while most > 0:
        leaves = written(leaves.groupBy("row", "seq", F.floor(F.col("part") / 2).alias("pair")).applyInArrow(join, IDS_SQL), "giant-joined")
        most //= 2
    return whole.unionByName(leaves).groupBy("row").applyInArrow(finish, DIGEST_SQL)
