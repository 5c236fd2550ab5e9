"""Operator 5: toxicity by a convolutional text classifier.

A word's embedding is the sum of those of the buckets to which the word and
its first ``FRONT`` bytes are hashed; filters of several widths slide over the whole
text, each is max-pooled, and a logistic layer gives a logit. Every labelled
text that may be learned takes part; none is sampled or left out.

1. Partitions count, for each label, the texts that use a bucket. Buckets that fewer
   than ``MIN_TEXTS`` texts use have an embedding of 0. The ``OWN`` buckets that tell most
   about the label (likelihood ratio) have embeddings of their own, further ones share
   ``SHARED`` by their hash, so a network's size does not depend on the data.
2. ``FOLDS`` networks learn each without one fold of the rows. Rows are dealt into slices
   and shards by a hash of doc_id. In a round each shard of a slice takes a copy of
   each network on by Adam (plain numpy; gradients flow only through the pooled
   places), and the copies' parameters and moments are averaged by rows. A task sees about
   ``STEPS`` batches in all, so the shards grow in number with the rows; few rows are passed
   several times.
3. The classifier is the networks' mean, as one network with all their filters.

The threshold is calibrated by language, as guessed from the text itself, on
the logits that all these rows get from the network that has not seen them,
counted in steps of 1 / ``GRID``: the logit that separates best becomes score 0.5 for that language, where a
missed text counts as ``MISSED`` wrongly found ones. Rows of other languages count too, with a
weight that falls from 1 as the language has more rows of its own than
``LANGUAGE_ROWS``.

Only the text is an input of a score. Null counts as empty; a text without
words pools to 0 everywhere and gets a score like any other. Without labels of
both kinds every score is the share of 1 among them (0 if there are none).
Labels that are null are ignored; of several labels for a doc_id each counts
once. Repeated rows give repeated results; other
columns are ignored; an empty table gives an empty result; very long texts are
scored whole, in pieces that overlap by the widest filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.text import Words, groups, mix64, span_hashes, texts_of
from lexloom.session import dropped, ship, written

FOLDS, MISSED = 4, 2.0
#: Bytes of a word that its second bucket is of, and what tells that from a whole word.
FRONT, SALT = 6, np.uint64(0x5851F42D4C957F2D)
BITS, MIN_TEXTS = 21, 3
DIM, FILTERS, WIDTHS = 12, 12, (1, 2, 3)
ALL = np.arange(FILTERS)
STEPS, BATCH, RATE = 1_200, 32, 0.01
LANGUAGE_ROWS = 20
#: Buckets with embeddings of their own, and embeddings for all others.
OWN, SHARED = 1 << 15, 1 << 12
#: A slice's rows at about least, slices at most, words that a task holds at about most.
SLICE_ROWS, SLICES, TASK_WORDS = 20_000, 12, 16_000_000
#: From and up to which sizes Spark filters one side of a join by the keys of the other.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "16g",
}
#: Numbers in a piece of a network that is averaged, logits' steps in 1 and their limit.
PIECE, GRID, FARTHEST = 1 << 16, 256, 100
#: Frequent function words by which the language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in that is it for was with be by on as are this from",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine",
    "fr": "le la les et des est une dans que qui pour sur pas au par avec il du",
    "es": "el los las una que por con para del se su al lo como más pero sus y",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def _hashes(text: str) -> np.ndarray:
    raw = text.encode()
    return Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashes


HINTS = [np.sort(_hashes(words)) for words in FUNCTION_WORDS.values()]


def both(words: Words) -> np.ndarray:
    """Hashes of the words and of their first bytes, as two rows."""
    fronts = span_hashes(words.low, words.starts, np.minimum(words.ends, words.starts + FRONT))
    return np.stack([words.hashes, mix64(fronts ^ SALT)])


def language(hashes: np.ndarray) -> int:
    """Index into LANGUAGES of the list with most hits."""
    if not len(hashes):
        return len(HINTS)
    hits = [int((h[np.minimum(np.searchsorted(h, hashes), len(h) - 1)] == hashes).sum()) for h in HINTS]
    return int(np.argmax(hits)) if max(hits) else len(HINTS)


@dataclass
class Network:
    """Rows of ``tables`` are embeddings times filters: a filter's response is a sum of looked-up rows."""

    rows: np.ndarray  # bucket -> row, 0 for buckets without embedding
    embed: np.ndarray
    kernels: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float = 0.0
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))
    constant: float | None = None
    tables: list[np.ndarray] | None = None
    #: embeddings and kernels of the networks whose mean this is
    parts: list[tuple[np.ndarray, list[np.ndarray]]] | None = None

    def compile(self) -> None:
        parts = self.parts or [(self.embed, self.kernels)]
        self.tables = [np.concatenate([np.einsum("vd,kdf->kvf", e, k[i]).astype(np.float32) for e, k in parts], axis=2) for i in range(len(WIDTHS))]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        return self.rows[(hashes >> np.uint64(64 - BITS)).astype(np.int64)]

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        """Highest response of every filter over a text; 0 where no word has one."""
        f = len(self.biases[0])
        best = np.zeros(f * len(WIDTHS), np.float32)
        step = 1 << 15
        for a in range(0, ids.shape[1], step):
            part, front = ids[:, a : a + step + max(WIDTHS) - 1]
            for i, (t, b, w) in enumerate(zip(self.tables, self.biases, WIDTHS, strict=True)):
                n = len(part) - w + 1
                if n <= 0:
                    continue
                r = t[0].take(part[:n], axis=0)
                r += t[0].take(front[:n], axis=0)
                for k in range(1, w):
                    r += t[k].take(part[k : n + k], axis=0)
                    r += t[k].take(front[k : n + k], axis=0)
                at = slice(i * f, (i + 1) * f)
                np.maximum(best[at], r.max(0) + b, out=best[at])
        return best

    def logit(self, ids: np.ndarray) -> float:
        return float(self.pooled(ids) @ self.out + self.bias)


def kept_buckets(texts: list[np.ndarray]) -> np.ndarray:
    """Buckets of words that enough texts use."""
    buckets = [np.unique((h >> np.uint64(64 - BITS)).astype(np.int64)) for h in texts]
    used, times = np.unique(np.concatenate(buckets) if buckets else np.zeros(0, np.int64), return_counts=True)
    return used[times >= MIN_TEXTS]


def mean_of(nets: list[Network]) -> Network:
    """One network whose logit is the mean of the networks' logits; they share their buckets."""
    out = np.stack([n.out.reshape(len(WIDTHS), -1) for n in nets], axis=1).reshape(-1) / len(nets)
    biases = [np.concatenate([n.biases[i] for n in nets]) for i in range(len(WIDTHS))]
    parts = [(n.embed.astype(np.float32), n.kernels) for n in nets]
    return Network(nets[0].rows, parts[0][0][:0], [], biases, out, float(np.mean([n.bias for n in nets])), parts=parts)


def rows_of(buckets: np.ndarray) -> np.ndarray:
    """Embedding of every bucket: the first ``OWN`` of ``buckets`` have their own, further ones share, others have none (0)."""
    rows = np.zeros(1 << BITS, np.int32)
    rows[buckets[:OWN]] = np.arange(1, len(buckets[:OWN]) + 1)
    rows[buckets[OWN:]] = OWN + 1 + buckets[OWN:] % SHARED
    return rows


def fresh(rows: np.ndarray, seed: int) -> Network:
    """A network that has learned nothing."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (rows.max() + 1, DIM))
    embed[0] = 0
    kernels = [rng.normal(0, 0.5 / np.sqrt(w * DIM), (w, DIM, FILTERS)) for w in WIDTHS]
    return Network(rows, embed, kernels, [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.3, FILTERS * len(WIDTHS)))


@dataclass
class Moments:
    """Adam's state: steps made, and both moments of every parameter; those of the output bias stand apart."""

    each: dict[str, list[np.ndarray]]
    bias: np.ndarray
    t: int = 0


def still(net: Network) -> Moments:
    return Moments({name: [np.zeros_like(p), np.zeros_like(p)] for name, p in _parameters(net)}, np.zeros(2))


def advance(net: Network, past: Moments, ids: list[np.ndarray], y: list[float], weight: list[float], rng: np.random.Generator) -> None:
    """One pass of Adam over texts given as embeddings' numbers, in batches of random order."""
    grads = {name: np.zeros_like(p) for name, p in _parameters(net)}
    order = rng.permutation(len(ids))
    for start in range(0, len(order), BATCH):
        past.t += 1
        g_bias = 0.0
        for g in grads.values():
            g.fill(0)
        for d in order[start : start + BATCH]:
            g_bias += _backward(net, ids[d], y[d], weight[d] / BATCH, grads)
        for name, p in _parameters(net):
            _adam(p, grads[name] + 1e-5 * p, *past.each[name], past.t)
        past.bias[:] = 0.9 * past.bias[0] + 0.1 * g_bias, 0.999 * past.bias[1] + 0.001 * g_bias**2
        net.bias -= float(RATE * (past.bias[0] / (1 - 0.9**past.t) / (np.sqrt(past.bias[1] / (1 - 0.999**past.t)) + 1e-8)))
        net.embed[0] = 0


def balanced(clean: float, toxic: float) -> tuple[float, float]:
    """Weights of either label's texts, which give both labels half of the whole."""
    return (clean + toxic) / (2 * max(1.0, clean)), (clean + toxic) / (2 * max(1.0, toxic))


def train(texts: list[np.ndarray], y: np.ndarray, seed: int = 11, kept: np.ndarray | None = None) -> Network:
    """Fit a network in this process to texts given as word hashes."""
    net = fresh(rows_of(kept_buckets(texts) if kept is None else kept), seed)
    if not len(texts) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    ids, past, rng = [net.ids(h) for h in texts], still(net), np.random.default_rng(seed)
    toxic = float((y > 0).sum())
    both_weights = balanced(len(y) - toxic, toxic)
    while past.t < STEPS:
        advance(net, past, ids, y.tolist(), [both_weights[int(v > 0)] for v in y], rng)
    return net


def packed(net: Network, past: Moments) -> np.ndarray:
    """All that training changes as one vector."""
    named = _parameters(net)
    parts = [p for _, p in named] + [past.each[name][i] for i in (0, 1) for name, _ in named]
    return np.concatenate([*(p.ravel() for p in parts), [net.bias, *past.bias, past.t]]).astype(np.float32)


def unpacked(vector: np.ndarray) -> tuple[Network, Moments]:
    """The network, without its buckets, and the moments of :func:`packed`."""
    size = (len(vector) - 4) // 3
    shapes = [(DIM * FILTERS * w, (w, DIM, FILTERS)) for w in WIDTHS] + [(FILTERS, (FILTERS,)) for _ in WIDTHS]
    shapes = [(FILTERS * len(WIDTHS), (FILTERS * len(WIDTHS),)), *shapes]
    embed = size - sum(n for n, _ in shapes)
    shapes = [(embed, (embed // DIM, DIM)), *shapes]
    cuts = np.cumsum([n for n, _ in shapes])[:-1]
    sets = [[p.reshape(shape).copy() for p, (_, shape) in zip(np.split(vector[i * size : (i + 1) * size], cuts), shapes, strict=True)] for i in range(3)]
    embed, out, *rest = sets[0]
    bias, b1, b2, t = (float(x) for x in vector[-4:])
    net = Network(np.zeros(0, np.int32), embed, rest[: len(WIDTHS)], rest[len(WIDTHS) :], out, bias)
    each = {name: [sets[1][i], sets[2][i]] for i, (name, _) in enumerate(_parameters(net))}
    return net, Moments(each, np.array([b1, b2]), round(t))


def _parameters(net: Network) -> list[tuple[str, np.ndarray]]:
    named = [("embed", net.embed), ("out", net.out)]
    return named + [(f"k{i}", k) for i, k in enumerate(net.kernels)] + [(f"b{i}", b) for i, b in enumerate(net.biases)]


def _adam(p: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, t: int) -> None:
    m *= 0.9
    m += 0.1 * g
    v *= 0.999
    v += 0.001 * g * g
    p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def _backward(net: Network, ids: np.ndarray, y: float, weight: float, grads: dict[str, np.ndarray]) -> float:
    """Add one text's gradients; returns the gradient of the output bias."""
    x = net.embed.take(ids[0], axis=0)
    x += net.embed.take(ids[1], axis=0)
    # a row for every place in a filter
    weights = np.concatenate([k.transpose(0, 2, 1).reshape(-1, DIM) for k in net.kernels])
    responses = weights @ x.T
    pooled = np.zeros(FILTERS * len(WIDTHS), x.dtype)
    places, first = np.zeros(len(weights), np.int64), 0
    for i, (b, w) in enumerate(zip(net.biases, WIDTHS, strict=True)):
        n, own = ids.shape[1] - w + 1, slice(first, first + w * FILTERS)
        first += w * FILTERS
        if n <= 0:
            continue
        r = responses[own][:FILTERS, :n]
        for j in range(1, w):
            r = r + responses[own][j * FILTERS : (j + 1) * FILTERS, j : n + j]
        at = r.argmax(1)
        pooled[i * FILTERS : (i + 1) * FILTERS] = np.maximum(r[ALL, at] + b, 0)
        places[own] = (at + np.arange(w)[:, None]).ravel()
    z = float(pooled @ net.out) + net.bias
    g = (1 / (1 + math.exp(-min(max(z, -30.0), 30.0))) - y) * weight
    grads["out"] += g * pooled
    d = g * net.out * (pooled > 0)
    if not d.any():
        return g
    filters = d.reshape(len(WIDTHS), FILTERS)
    each = np.repeat(filters, WIDTHS, axis=0).reshape(-1, 1)
    change, first = x.take(places, axis=0) * each, 0
    for i, w in enumerate(WIDTHS):
        grads[f"b{i}"] += filters[i]
        grads[f"k{i}"] += change[first : first + w * FILTERS].reshape(w, FILTERS, DIM).transpose(0, 2, 1)
        first += w * FILTERS
    used = np.flatnonzero(each)
    weights, places = (weights * each)[used], places[used]
    for row in ids:
        np.add.at(grads["embed"], row.take(places), weights)
    return g


def best_cut(logits: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The threshold with the least weight of errors, midway in the widest gap among equals."""
    order = np.argsort(logits)
    z, t = logits[order], y[order]
    w = np.ones(len(z)) if weight is None else weight[order]
    wrong = (w * (t == 0)).sum() + np.concatenate(([0.0], np.cumsum(w * (t == 1)) - np.cumsum(w * (t == 0))))
    edges = np.concatenate(([z[0] - 2], (z[1:] + z[:-1]) / 2, [z[-1] + 2]))
    gaps = np.concatenate(([1.0], z[1:] - z[:-1], [1.0]))
    wrong[gaps == 0] = np.inf  # equal logits are on one side
    good = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    return float(edges[good[np.argmax(gaps[good])]])


def examples(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int | None = None, positives: int | None = None) -> DataFrame:
    """doc_id, y, lang, bucket and words (as buckets) of every labelled text that may be learned.

    Only where the caller asks for it, of about ``rows`` texts at most, ``positives`` of them labelled 1.
    """
    ship(docs.sparkSession)
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & learn)
    if rows is not None:
        most = rows if positives is None else positives
        n = {r[0]: r[1] for r in y.groupBy("y").count().collect()}
        h = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 20))
        share = F.when(F.col("y") == 1, min(1.0, most / max(1, n.get(1, 0)))).otherwise(min(1.0, (rows - most) / max(1, n.get(0, 0))))
        y = y.filter(h < share * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(2))
            langs, words_of = [], []
            for a, b in groups(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                buckets = (both(words) >> np.uint64(64 - BITS)).astype(np.int32)
                langs += [language(words.hashes[words.first[k] : words.first[k + 1]]) for k in range(b - a)]
                words_of += [buckets[:, words.first[k] : words.first[k + 1]].tobytes() for k in range(b - a)]
            columns = [batch.column(0), batch.column(1), pa.array(langs, pa.int32()), pa.array(words_of, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "y", "lang", "words"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # one kind of join at every size, so that disk grows with the input
    hashed = texts.join(y.hint("merge"), "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, lang int, words binary")
    return hashed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(100)))


def written_examples(rows: DataFrame) -> DataFrame:
    """``rows`` as a table; Spark may drop texts without a label before it shuffles, whatever the sizes, by a Bloom filter of the labels' doc_ids."""
    conf = rows.sparkSession.conf
    before = {key: conf.get(key, None) for key in BLOOM}
    for key, value in BLOOM.items():
        conf.set(key, value)
    try:
        return written(rows, "toxicity-examples")
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, positives: int) -> list[tuple[np.ndarray, float, int]]:
    """Words, label and bucket of a few texts for :func:`train`, to try networks in one process; no query uses it."""
    out = examples(docs, labels, label, learn, rows, positives).select("words", "y", "bucket", "doc_id").toLocalIterator()
    return [(_buckets(r[0]).astype(np.uint64) << np.uint64(64 - BITS), float(r[1]), r[2]) for r in sorted(out, key=lambda r: (r[3], r[1]))]


def _buckets(words: bytes | pa.Buffer) -> np.ndarray:
    return np.frombuffer(words, np.int32).reshape(2, -1)


def bucket_counts(rows: DataFrame) -> DataFrame:
    """bucket, clean and toxic: the texts of either label that use the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for y, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n[int(y > 0), np.unique(_buckets(words.as_buffer()))] += 1
        used = np.flatnonzero(n.any(axis=0))
        for a in range(0, len(used), PIECE):
            at = used[a : a + PIECE]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(n[i, at].astype(np.int64)) for i in (0, 1))], names=["bucket", "clean", "toxic"])

    counted = rows.select("y", "words").mapInArrow(run, "bucket int, clean long, toxic long")
    return counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def likelihood_ratio(used: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How much using a bucket tells about the label: twice the log likelihood ratio, of the texts of either label that use it."""
    out = np.zeros(used.shape[1])
    n = total.sum()
    for seen, of in ((used, used.sum(axis=0)), (total[:, None] - used, n - used.sum(axis=0))):
        for i in (0, 1):
            out += 2 * seen[i] * np.log(np.maximum(seen[i], 1) / np.maximum(of * total[i] / n, 1e-300))
    return out


def chosen_buckets(rows: DataFrame, total: np.ndarray) -> np.ndarray:
    """Buckets that at least ``MIN_TEXTS`` texts use, those that tell most about the label first; at most 2 ** ``BITS``."""
    found = bucket_counts(rows).filter(F.col("clean") + F.col("toxic") >= MIN_TEXTS).toArrow()
    bucket, clean, toxic = (c.to_numpy() for c in found.columns)
    tells = likelihood_ratio(np.stack([clean, toxic]).astype(float), total)
    return bucket[np.lexsort((bucket, -tells))]


def one_round(rows: DataFrame, mapping: np.ndarray, networks: list[np.ndarray], left_out: list[int], weights: list[tuple[float, float]], shards: int, passes: int, seed: int) -> list[np.ndarray]:
    """Every shard takes every network on over its rows outside the fold left out; the mean of what the shards have made of each."""
    sent = rows.sparkSession.sparkContext.broadcast((mapping.astype(np.uint16), networks))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value[0]
        for batch in batches:
            ids = pa.array([numbers[_buckets(w.as_buffer())].tobytes() for w in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ids], names=["doc_id", "y", "fold", "ids"])

    def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, float, np.ndarray]]:
        for batch in batches:
            net, shard, y = (batch.column(i).to_pylist() for i in range(3))
            for k, s, v, ids in zip(net, shard, y, batch.column(3), strict=True):
                yield k, s, float(v), np.frombuffer(ids.as_buffer(), np.uint16).reshape(2, -1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, shard), group in groupby(rows_in(batches), key=lambda r: r[:2]):
            own = list(group)
            net, past = unpacked(sent.value[1][k])
            rng = np.random.default_rng((seed, k, shard))
            for _ in range(passes):
                advance(net, past, [r[3] for r in own], [r[2] for r in own], [weights[k][int(r[2] > 0)] for r in own], rng)
            vector = packed(net, past) * np.float32(len(own))
            pieces = [vector[a : a + PIECE].tobytes() for a in range(0, len(vector), PIECE)]
            numbers = [pa.array([x] * len(pieces), pa.int32()) for x in (k, len(own))]
            yield pa.RecordBatch.from_arrays(
                [numbers[0], pa.array(range(len(pieces)), pa.int32()), numbers[1], pa.array(pieces, pa.binary())], names=["net", "piece", "n", "sums"]
            )

    def mean(table: pa.Table) -> pa.Table:
        total = np.zeros(len(np.frombuffer(table["sums"][0].as_buffer(), np.float32)))
        for v in table["sums"]:
            total += np.frombuffer(v.as_buffer(), np.float32)
        total /= sum(table["n"].to_pylist())
        return pa.table({"net": table["net"][:1], "piece": table["piece"][:1], "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    dealt = (
        rows.select("doc_id", "y", (F.col("bucket") % FOLDS).cast("int").alias("fold"), "words")
        .mapInArrow(number, "doc_id long, y int, fold int, ids binary")
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(shards)).cast("int"))
        .withColumn("left", F.explode(F.array(*(F.struct(F.lit(i).alias("net"), F.lit(k).alias("fold")) for i, k in enumerate(left_out)))))
        .filter(F.col("left.fold") != F.col("fold"))
        .select(F.col("left.net").alias("net"), "shard", "y", "ids", "doc_id")
        .repartitionById(len(left_out) * shards, F.col("net") * shards + F.col("shard"))
        .sortWithinPartitions("net", "shard", "doc_id", "y", "ids")
        .select("net", "shard", "y", "ids")
    )
    made = dealt.mapInArrow(learn, "net int, piece int, n int, sums binary")
    mean_parts = written(made.groupBy("net", "piece").applyInArrow(mean, "net int, piece int, part binary"), "toxicity-networks")
    parts = {(r["net"], r["piece"]): r["part"] for r in mean_parts.toArrow().to_pylist()}
    dropped(mean_parts)
    sent.destroy()
    # a network none of whose rows are in this slice stays as it is
    return [
        np.concatenate([np.frombuffer(parts[k, i], np.float32) for i in range(-(-len(old) // PIECE))]) if (k, 0) in parts else old
        for k, old in enumerate(networks)
    ]


def unseen_logits(rows: DataFrame, nets: list[Network], mapping: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(lang, y, logit, rows) of all rows, by the network that has not seen them; logits in steps of 1 / ``GRID``."""
    sent = rows.sparkSession.sparkContext.broadcast((mapping, [(n.embed, n.kernels, n.biases, n.out, n.bias) for n in nets]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Network(sent.value[0], *parts) for parts in sent.value[1]]
        for net in own:
            net.compile()
        for batch in batches:
            step = [
                round(min(max(net.logit(net.rows[_buckets(w.as_buffer())]), -FARTHEST), FARTHEST) * GRID)
                for net, w in ((own[b % len(own)], w) for b, w in zip(batch.column(2).to_pylist(), batch.column(3), strict=True))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(step, pa.int32())], names=["lang", "y", "step"])

    steps = rows.select("lang", "y", "bucket", "words").mapInArrow(run, "lang int, y int, step int")
    found = [(r[0], r[1], r[2] / GRID, r[3]) for r in steps.groupBy("lang", "y", "step").count().orderBy("lang", "y", "step").collect()]
    sent.destroy()
    return found


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int | None = None, positives: int | None = None, steps: int = STEPS) -> Network:
    """Networks without one fold each, taken on in rounds over all rows; their mean, calibrated on what each has not seen."""
    table = written_examples(examples(docs, labels, label, learn, rows, positives))
    counts = table.groupBy((F.col("bucket") % FOLDS).alias("fold"), (F.col("y") > 0).cast("int").alias("y"))
    n, words = np.zeros((FOLDS, 2)), 0
    for fold, y, rows_here, size in counts.agg(F.count(F.lit(1)), F.sum(F.octet_length("words"))).collect():
        n[fold, y], words = rows_here, words + size // 8
    total = n.sum(axis=0)
    if not total.all():
        net = fresh(rows_of(np.zeros(0, np.int64)), 0)
        net.constant = float(total[1] / max(1.0, total.sum()))
        return net
    # too few rows to leave some out: one network, which sees all
    left_out = list(range(FOLDS)) if (total - n).all() else [-1]
    mapping = rows_of(chosen_buckets(table, total))
    weights = [balanced(*(total - (n[k] if k >= 0 else 0))) for k in left_out]
    shown = total.sum() * (1 - 1 / FOLDS if len(left_out) > 1 else 1)
    slices = int(min(SLICES, -(-total.sum() // SLICE_ROWS)))
    passes = int(max(1, -(-steps * BATCH // shown)))
    shards = int(max(1, shown // (steps * BATCH), -(-words // (slices * TASK_WORDS))))
    vectors = []
    for i in range(len(left_out)):
        net = fresh(mapping, 11 + i)
        vectors.append(packed(net, still(net)))
    slice_of = F.pmod(F.xxhash64("doc_id", F.lit(37)), F.lit(slices))
    # a slice of all rows is passed at once; of several, each in turn
    for i in range(1 if slices == 1 else passes * slices):
        vectors = one_round(table.filter(slice_of == i % slices), mapping, vectors, left_out, weights, shards, passes if slices == 1 else 1, i)
    nets = [unpacked(v)[0] for v in vectors]
    lang, y, z, times = (np.array(c) for c in zip(*unseen_logits(table, nets, mapping), strict=True))
    dropped(table)
    for one in nets:
        one.rows = mapping
    net = mean_of(nets)
    if len(left_out) == 1:
        net.shift[:] = best_cut(z, y, times)
        return net
    cost = times * np.where(y == 1, MISSED, 1.0)
    for k in range(len(LANGUAGES)):
        own = min(times[(lang == k) & (y == 1)].sum(), times[(lang == k) & (y == 0)].sum())
        net.shift[k] = best_cut(z, y, cost * np.where(lang == k, 1.0, LANGUAGE_ROWS / (LANGUAGE_ROWS + own)))
    return net


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, rows: int | None = None, positives: int | None = None
) -> DataFrame:
    """doc_id, score and predicted of every row; ``learn`` says which labels may be used.

    All of them are learned from, unless ``rows`` asks for about so many at most, ``positives`` of them labelled 1.
    """
    spark = docs.sparkSession
    ship(spark)
    usable = F.lit(True) if learn is None else learn
    sent = spark.sparkContext.broadcast(fit(docs, labels, "toxic", usable, rows, positives))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        if net.tables is None and net.constant is None:
            net.compile()
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            scores = []
            for a, b in groups(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                hashes = both(words)
                for k in range(b - a):
                    h = hashes[:, words.first[k] : words.first[k + 1]]
                    z = net.logit(net.ids(h)) - net.shift[language(h[0])] if net.constant is None else 0.0
                    scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))) if net.constant is None else net.constant)
            s = np.array(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int"
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted; labels of held-out rows are not learned.

    A row without doc_id teaches nothing and so counts as held out.
    """
    rest = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    out = toxicity_scores(docs, labels, rest() != 0)
    return out.select("doc_id", F.coalesce(rest() == 0, F.lit(True)).alias("held_out"), "score", "predicted")
