"""Operator 8: token counts by a count-only Viterbi search.

The vocabulary is a unigram model: an Aho-Corasick automaton lists the pieces
that end at each character, and dynamic programming carries the best score and
the number of pieces of the best path, never the path itself. A character that
no piece covers costs the lowest score less 10 and falls back to its UTF-8
bytes. The tie rules are those of the sentencepiece library: candidates to a
place come by ascending start, the unknown character last, and a candidate
replaces the stored one only if its score is greater.

No piece reaches across the front of a U+2581, so the search runs per stretch
between those, and equal stretches share one search.

Public tokenizer files here have merge-type scores (ranks); ``unigram_model``
turns the same pieces into a unigram model with score -ln(id + 1), rounded to a
sixteenth, which the library loads too and against which the counts are tested.
The library adds scores in 32 bits. While a text's sums are exact in 32 bits
(multiples of some power of two, within 2**24 of them; for sixteenths some
130,000 pieces), a stretch's search does not depend on where it stands and is
remembered; from there on, and for scores of any other kind, every stretch is
searched with the 32-bit sums that the library has at its place.

Null counts as empty: 0 tokens. Begin and end ids are not counted. Repeated
rows give repeated results; other columns are ignored; an empty table gives an
empty result; very long texts are counted whole. Models with scores above 0 or
below -1e6, user-defined pieces, normalisation or without byte fallback are
refused.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.piece_bpe import LONGEST, MARK, REMEMBERED, STRETCH, read_model
from lexloom.session import ship

UNK_PENALTY = 10.0


def unigram_model(raw: bytes) -> bytes:
    """The pieces of any model as a unigram model whose scores fall with the logarithm of the id, in sixteenths."""
    model = read_model(raw)
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = -round(math.log(i + 1) * 16) / 16
    return model.SerializeToString()


class Counter:
    """Counts the pieces of texts under one unigram model."""

    def __init__(self, raw: bytes):
        model = read_model(raw)
        spec, norm = model.trainer_spec, model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        if spec.model_type != 1 or not spec.byte_fallback:
            raise ValueError("only unigram models with byte fallback are supported")
        self.automaton = ahocorasick.Automaton()
        lowest = 0.0
        for p in model.pieces:
            if p.type in (4, 5):
                raise ValueError("user-defined and unused pieces are not supported")
            if p.type != 1:
                continue
            if not -1e6 <= p.score <= 0 or MARK in p.piece.lstrip(MARK):
                raise ValueError("scores above 0 or below -1e6 and inner-mark pieces are not supported")
            self.automaton.add_word(p.piece, (len(p.piece), p.score))
            lowest = min(lowest, p.score)
        self.automaton.make_automaton()
        self.unknown = float(np.float32(lowest - UNK_PENALTY))
        #: sums of scores are exact in 32 bits up to here; 0 if the scores have no common step
        steps = [s for s in (2.0**-k for k in range(12)) if all((p.score / s).is_integer() for p in model.pieces if p.type == 1) and (self.unknown / s).is_integer()]
        self.exact = 2**24 * steps[0] if steps else 0.0
        #: stretch -> pieces and score of its best path
        self.known: dict[str, tuple[int, float]] = {}

    def search(self, stretch: str) -> tuple[int, float]:
        """Pieces and score of the best path over a stretch that starts at 0."""
        n = len(stretch)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        self._walk(stretch, best, count, float)
        return count[n], best[n]

    def search_from(self, stretch: str, base: np.float32) -> tuple[int, np.float32]:
        """Pieces of the best path over a stretch, and the 32-bit sum at its end, from the sum before it."""
        n = len(stretch)
        best, count = [base] * (n + 1), [0] * (n + 1)
        self._walk(stretch, best, count, np.float32)
        return count[n], best[n]

    def _walk(self, stretch: str, best: list, count: list[int], add) -> None:
        """Best sums and piece counts at every place; ``add`` rounds a sum."""
        n = len(stretch)
        at, found, alone = 1, False, False
        for end, (length, score) in self.automaton.iter(stretch):
            j = end + 1
            while at < j:
                if not alone:
                    self._unknown(stretch, best, count, at, found, add)
                at += 1
                found = alone = False
            i = j - length
            c = add(best[i] + score)
            if not found or c > best[j]:
                best[j], count[j], found = c, count[i] + 1, True
            if length == 1:
                alone = True
        while at <= n:
            if not alone:
                self._unknown(stretch, best, count, at, found, add)
            at += 1
            found = alone = False

    def _unknown(self, stretch: str, best: list, count: list[int], j: int, found: bool, add) -> None:
        """The character that ends at j as an unknown one: as many tokens as bytes."""
        c = add(best[j - 1] + self.unknown)
        if not found or c > best[j]:
            best[j], count[j] = c, count[j - 1] + len(stretch[j - 1].encode())

    def count(self, text: str) -> int:
        """Number of pieces of the whole text."""
        if not text:
            return 0
        known = self.known
        stretches = STRETCH.findall(MARK + text.replace(" ", MARK))
        if not self.exact:
            return self._count_from(stretches)
        got = list(map(known.get, stretches))
        if None in got:
            for k, g in enumerate(got):
                if g is None:
                    s = stretches[k]
                    g = got[k] = known.get(s) or self.search(s)
                    if len(known) < 2 * REMEMBERED and len(s) <= LONGEST:
                        known[s] = g
        if len(text) * -self.unknown > self.exact and sum(g[1] for g in got) - max(map(len, stretches)) * -self.unknown < -self.exact:
            return self._count_from(stretches)
        return sum(g[0] for g in got)

    def _count_from(self, stretches: list[str]) -> int:
        total, base = 0, np.float32(0)
        for s in stretches:
            n, base = self.search_from(s, base)
            total += n
        return total


_LOADED: dict[str, Counter] = {}


def loaded(raw: bytes) -> Counter:
    """One counter per worker and model."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Counter(raw)
    return _LOADED[key]


def token_counts(docs: DataFrame, model: bytes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and n_tokens of every row; ``model`` is a serialised unigram model."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(model)
        for batch in batches:
            n = [counter.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long"
    )
