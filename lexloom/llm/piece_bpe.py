"""Operator 4: SentencePiece encoding and decoding of merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs whose concatenation is a
piece, ordered by score and then from the left, and merges the best until none
is left; symbols outside the vocabulary fall back to their bytes. A text is
first cut where no piece can reach across (a piece has U+2581 only at its
front, and only some characters stand side by side in pieces),
which leaves the result unchanged and lets equal stretches share one encoding.
Short stretches keep the agenda as a list of pair scores, long ones as a heap.
All new stretches of an Arrow batch are checked against the
sentencepiece library, encoding and decoding, in one call each; a difference
raises.

Supported models: type BPE, identity normalisation, dummy prefix, no removal
of white space, byte fallback; others are refused. Null counts as empty, and
an empty text has begin and end ids only. Repeated rows give repeated results;
other columns are ignored; an empty table gives an empty result. Very long
texts and very long stretches are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import ship

MARK = "▁"
STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Up to so many characters the agenda is a list.
SHORT = 32
NONE = float("-inf")
#: Encoded stretches that a worker remembers, and the longest that it remembers.
REMEMBERED, LONGEST = 150_000, 48


def read_model(raw: bytes):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(raw)
    return model


class MergeTokenizer:
    """Encoder and decoder of one merge-type model."""

    def __init__(self, raw: bytes, check: bool = True):
        import sentencepiece

        model = read_model(raw)
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only merge-type models with identity normalisation and a dummy prefix are supported")
        if not (norm.escape_whitespaces and spec.byte_fallback) or spec.treat_whitespace_as_suffix:
            raise ValueError("only models with escaped white space and byte fallback are supported")
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.out: list[bytes] = []
        self.bos = self.eos = -1
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value] = i
                self.out.append(bytes([value]))
                continue
            if p.type in (1, 4, 5):
                if p.type != 1 or MARK in p.piece.lstrip(MARK):
                    raise ValueError("user-defined, unused and inner-mark pieces are not supported")
                self.score[p.piece], self.ids[p.piece] = p.score, i
                self.out.append(p.piece.replace(MARK, " ").encode())
                continue
            self.out.append(b"" if p.type == 3 else " ⁇ ".encode())
            self.bos = i if p.piece == (spec.bos_piece or "<s>") else self.bos
            self.eos = i if p.piece == (spec.eos_piece or "</s>") else self.eos
        self.pairs = {pair for p in self.ids for pair in zip(p, p[1:])}
        self.inner: dict[str, bytes] = {}
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw) if check else None
        self.known: dict[str, bytes] = {}

    def parts(self, stretch: str) -> list[str]:
        """Cut where no piece has the two characters side by side: no merge crosses."""
        pairs, out, at = self.pairs, [], 0
        for i, pair in enumerate(zip(stretch, stretch[1:]), 1):
            if pair not in pairs:
                out.append(stretch[at:i])
                at = i
        out.append(stretch[at:])
        return out

    def fresh_ids(self, stretch: str) -> bytes:
        """Packed ids of a stretch that is not known yet."""
        known, out = self.inner, []
        for part in self.parts(stretch):
            ids = known.get(part)
            if ids is None:
                ids = pack("<%dI" % len(m := self.merge(part)), *m)
                if len(known) < REMEMBERED and len(part) <= LONGEST:
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    def merge(self, stretch: str) -> list[int]:
        """Ids of a stretch by the agenda of adjacent pairs."""
        score = self.score
        n = len(stretch)
        if n <= SHORT:
            return self._pieces(self._merge_short(list(stretch)))
        symbols: list[str] = list(stretch)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            s = score.get(stretch[i : i + 2])
            if s is not None:
                agenda.append((-s, i, i + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue
            joined = symbols[left] = a + b
            symbols[right] = ""
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                s = score.get(joined + symbols[nxt])
                if s is not None:
                    heapq.heappush(agenda, (-s, left, nxt, size + len(symbols[nxt])))
            prev = before[left]
            if prev >= 0:
                s = score.get(symbols[prev] + joined)
                if s is not None:
                    heapq.heappush(agenda, (-s, prev, left, size + len(symbols[prev])))
        return self._pieces(symbols)

    def _merge_short(self, symbols: list[str]) -> list[str]:
        get = self.score.get
        agenda = [get(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = max(agenda)
            if best == NONE:
                break
            i = agenda.index(best)
            joined = symbols[i] = symbols[i] + symbols.pop(i + 1)
            agenda.pop(i)
            if i < len(agenda):
                agenda[i] = get(joined + symbols[i + 1], NONE)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + joined, NONE)
        return symbols

    def _pieces(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        ids = self.ids
        for s in symbols:
            if s:
                i = ids.get(s)
                if i is None:
                    out.extend(self.byte_ids[b] for b in s.encode())
                else:
                    out.append(i)
        return out

    def packed(self, text: str, fresh: dict[str, bytes]) -> bytes:
        """Ids of a text without begin and end, as little-endian 32-bit integers."""
        if not text:
            return b""
        stretches = STRETCH.findall(MARK + text.replace(" ", MARK))
        out = list(map(self.known.get, stretches))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    stretch = stretches[i]
                    ids = fresh.get(stretch)
                    if ids is None:
                        ids = fresh[stretch] = self.fresh_ids(stretch)
                    out[i] = ids
        return b"".join(out)

    def settle(self, fresh: dict[str, bytes]) -> None:
        """Check a batch's new stretches against the library, both ways, then remember them.

        A text's later stretches start with the mark that its spaces are; only
        the mark itself, alone, cannot be given to the library as a text.
        """
        names = [s for s in fresh if s[0] == MARK and len(s) > 1]
        if self.library is not None and names:
            plain = [s[1:].replace(MARK, " ") for s in names]
            found = self.library.encode(plain, num_threads=1)
            for s, ids in zip(names, found, strict=True):
                if pack("<%dI" % len(ids), *ids) != fresh[s]:
                    raise ValueError(f"the library encodes {s[:200]!r} differently")
            every = list(chain.from_iterable(found))
            if self.decode(every) != self.library.decode(every):
                raise ValueError("the library decodes a batch differently")
        room = REMEMBERED - len(self.known)
        for s, ids in fresh.items():
            if room <= 0:
                break
            if len(s) <= LONGEST:
                self.known[s] = ids
                room -= 1
        fresh.clear()

    def encode(self, text: str) -> list[int]:
        """Ids with begin and end."""
        fresh: dict[str, bytes] = {}
        ids = np.frombuffer(self.packed(text, fresh), "<u4").tolist()
        self.settle(fresh)
        return [self.bos, *ids, self.eos]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; the dummy prefix goes."""
        raw = b"".join(map(self.out.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_LOADED: dict[str, MergeTokenizer] = {}


def loaded(raw: bytes, check: bool = True) -> MergeTokenizer:
    """One tokenizer per worker and model."""
    key = f"{hashlib.sha256(raw).hexdigest()}{check}"
    if key not in _LOADED:
        _LOADED[key] = MergeTokenizer(raw, check)
    return _LOADED[key]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DIGEST_SQL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Texts are handed over in parts of so many characters.
PART = 4 << 20


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    docs, texts, size = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        t = text.as_py() or ""
        docs.append(doc)
        texts.append(t)
        size += len(t)
        if size > PART:
            yield docs, texts
            docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def encoded(docs: DataFrame, model: bytes, text: str = "text", doc_id: str = "doc_id", check: bool = True) -> DataFrame:
    """doc_id, ids (with begin and end) and the decoded text of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, fresh = loaded(model, check), {}
        for batch in batches:
            for names, texts in _batches(batch):
                ids = [[tok.bos, *np.frombuffer(tok.packed(t, fresh), "<u4").tolist(), tok.eos] for t in texts]
                tok.settle(fresh)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([tok.decode(i) for i in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded string"
    )


def digests(docs: DataFrame, model: bytes, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row.

    The digests of :func:`encoded`, taken beside the encoder so that ids and
    decoded texts need not leave the worker.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, fresh = loaded(model, check), {}
        first, last = (np.asarray([x], "<u4").tobytes() for x in (tok.bos, tok.eos))
        for batch in batches:
            for names, texts in _batches(batch):
                packed = [first + tok.packed(t, fresh) + last for t in texts]
                tok.settle(fresh)
                plain = [tok.decode(np.frombuffer(p, "<u4").tolist()).encode() for p in packed]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()),
                        pa.array([len(p) // 4 for p in packed], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in plain], pa.string()),
                    ],
                    schema=DIGEST,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST_SQL)
