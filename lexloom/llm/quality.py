"""Operator 3: quality classifier with random Fourier features.

1. Every text becomes a short vector of document statistics (shares of byte
   classes, word lengths, repetition, entropy), computed from the whole text.
2. Random Fourier features approximate a Gaussian kernel over the standardised
   vectors. Partitions sum the normal equations of the labelled rows by fold;
   the sums give ridge weights, and weights without each fold.
3. Isotonic regression over fixed bins of the raw score makes it a probability.
   Each labelled row enters it with the score of the fit that has not seen its
   fold.

Labels are learned from a bounded sample: at most about ``TRAIN_ROWS`` labelled
rows, chosen by a hash of doc_id. Only statistics of the text are inputs of a
score. Without labels, or with labels of one kind, every score is the share of
1 among them (0.5 if there are none).

Null counts as empty; an empty text has all statistics 0 and gets a score like
any other. Labels that are null are ignored; of several labels for a doc_id
each counts. Repeated rows give repeated results; other columns are ignored;
an empty table gives an empty result; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.text import Words, groups, release, texts_of
from lexloom.session import ship, written

#: At most about so many labelled rows are learned from.
TRAIN_ROWS = 200_000
#: Random features, kernel width in standard deviations, ridge, parts that sum the equations.
FEATURES, WIDTH, RIDGE, PARTS = 384, 4.0, 1e-3, 8
BINS, FOLDS = 400, 4

#: Byte classes of the statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" ",
    "line": b"\n\r",
    "stop": b".",
    "comma": b",;:",
    "shout": b"!?",
    "symbol": b"#$%&*+=@^_|~<>{}[]\\/",
    "quote": b"\"'()-",
}


def class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.uint8)
    for i, members in enumerate(CLASSES.values()):
        table[list(members)] = i
    table[128:] = len(CLASSES) + 1
    return table


TABLE = class_table()
N_CLASSES = len(CLASSES) + 2
N_STATS = N_CLASSES + 14


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics per text."""
    n = len(offsets) - 1
    out = np.zeros((n, N_STATS))
    words = Words(data, offsets)
    kind = TABLE[data]
    lengths = (words.ends - words.starts).astype(np.float64)
    text_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    size = np.diff(offsets).astype(np.float64)
    counts = np.bincount(text_of_byte * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    safe = np.maximum(size, 1)
    out[:, :N_CLASSES] = counts / safe[:, None]
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, -1], 1)
    for k in range(n):
        a, b = int(words.first[k]), int(words.first[k + 1])
        row = out[k, N_CLASSES:]
        row[0] = np.log1p(size[k])
        row[1] = counts[k, 0] / letters[k]
        if a == b:
            continue
        h, w = words.hashes[a:b], lengths[a:b]
        values, times = np.unique(h, return_counts=True)
        m = b - a
        row[2] = np.log1p(m)
        row[3], row[4] = w.mean(), w.std()
        row[5] = len(values) / m
        row[6] = len(values) / np.sqrt(m)
        p = times / m
        row[7] = -(p * np.log(p)).sum() / max(np.log(m), 1)
        row[8] = times.max() / m
        row[9] = (w > 12).mean()
        row[10] = (w < 3).mean()
        if m > 3:
            pairs = np.unique(h[1:] * np.uint64(3) ^ h[:-1])
            row[11] = len(pairs) / (m - 1)
        row[12] = size[k] / m
        row[13] = (counts[k, 4] + 1) / m
    return out


STATS = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float64()))])


def stats_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and statistics of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            parts = [statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in groups(offsets)]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * N_STATS), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], schema=STATS)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, stats array<double>"
    )


@dataclass
class Model:
    """Everything that scoring needs; its size does not depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return features(z, self.omega, self.phase) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.interp(self.raw(x), self.edges, self.levels)


def features(z: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Random Fourier features, the standardised statistics themselves, and 1."""
    return np.hstack([np.sqrt(2 / len(phase)) * np.cos(z @ omega + phase), z, np.ones((len(z), 1))])


def crc_rest(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo ``modulus``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % modulus


def training_rows(stats: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int) -> DataFrame:
    """stats and y of the labelled rows that may be learned from, about ``limit`` at most, with a bucket 0 to 99."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter(
        F.col("y").isNotNull() & learn
    )
    share = min(1.0, limit / max(1, y.count()))
    h = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20))
    return stats.join(y.filter(h < int(share * (1 << 20))), "doc_id").select(
        "stats", "y", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(100)).alias("bucket")
    )


def fit(rows: DataFrame, n_features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = 7) -> Model:
    """Ridge weights from partition-summed normal equations, then isotonic levels."""
    rows = written(rows.repartition(PARTS, "bucket"), "quality-train")
    k = N_STATS

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * k + 2)
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, k)
            y = np.asarray(batch.column(1))
            total += np.concatenate([x.sum(0), (x * x).sum(0), [len(y), y.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["sums"])

    sums = np.sum([r[0] for r in rows.select("stats", "y").mapInArrow(moments, "sums array<double>").collect()], axis=0)
    sums = np.asarray(sums, float).reshape(-1) if np.size(sums) else np.zeros(2 * k + 2)
    n, ones = sums[-2], sums[-1]
    if n == 0 or ones in (0, n):
        zero = np.zeros(k)
        return Model(zero, zero + 1, np.zeros((k, 1)), np.zeros(1), np.zeros(1), np.zeros(1), np.zeros(1), 0.5 if n == 0 else float(ones / n))
    mean = sums[:k] / n
    scale = np.sqrt(np.maximum(sums[k : 2 * k] / n - mean * mean, 1e-12))
    scale[scale < 1e-5] = 1.0
    rng = np.random.default_rng(seed)
    omega, phase = rng.normal(size=(k, n_features)) / width, rng.uniform(0, 2 * np.pi, n_features)
    d = n_features + k + 1

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, k)
            yield features(np.clip((x - mean) / scale, -8, 8), omega, phase), np.asarray(batch.column(1)), np.asarray(batch.column(2)) % FOLDS

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((FOLDS, d, d)), np.zeros((FOLDS, d))
        for f, y, fold in parts_of(batches):
            for i in range(FOLDS):
                use = fold == i
                gram[i] += f[use].T @ f[use]
                right[i] += f[use].T @ y[use]
        for i in range(FOLDS):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([gram[i].tobytes()], pa.binary()), pa.array([right[i].tobytes()], pa.binary())], names=["fold", "gram", "rhs"]
            )

    gram, right = np.zeros((FOLDS, d, d)), np.zeros((FOLDS, d))
    for r in rows.mapInArrow(equations, "fold int, gram binary, rhs binary").toLocalIterator():
        gram[r[0]] += np.frombuffer(r[1]).reshape(d, d)
        right[r[0]] += np.frombuffer(r[2])
    penalty = np.full(d, ridge * n)
    penalty[-1] = 1e-9
    every, rhs = gram.sum(axis=0) + np.diag(penalty), right.sum(axis=0)
    weights = np.linalg.solve(every, rhs)
    others = np.stack([np.linalg.solve(every - gram[i], rhs - right[i]) for i in range(FOLDS)], axis=1)
    edges = np.linspace(-0.5, 1.5, BINS)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS))
        for f, y, fold in parts_of(batches):
            raw = (f @ others)[np.arange(len(y)), fold]
            at = np.clip(np.rint((raw + 0.5) / 2 * (BINS - 1)), 0, BINS - 1).astype(int)
            total[0] += np.bincount(at, minlength=BINS)
            total[1] += np.bincount(at, y, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["bins"])

    total = np.sum([np.frombuffer(r[0]).reshape(2, BINS) for r in rows.mapInArrow(binned, "bins binary").collect()], axis=0)
    return Model(mean, scale, omega, phase, weights, edges, isotonic(edges, total[0], total[1]))


def isotonic(edges: np.ndarray, count: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Non-decreasing levels at ``edges`` by pooling adjacent violators; gaps are interpolated.

    Half a row of each end's label smooths pools of few rows.
    """
    pools: list[list[float]] = []
    for x, c, o in zip(edges, count, ones, strict=True):
        if not c:
            continue
        pools.append([x * c, c, o, x, x])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            b = pools.pop()
            a = pools[-1]
            pools[-1] = [a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3], b[4]]
    xs, ys = [], []
    for _, c, o, lo, hi in pools:
        level = (o + 0.5 * o / c) / (c + 0.5) if c else 0.5
        level = min(max(level, 0.5 / (c + 1)), 1 - 0.5 / (c + 1))
        xs += [lo, hi]
        ys += [level, level]
    ys = list(np.maximum.accumulate(ys))
    return np.interp(edges, xs, ys)


def scored(stats: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every row of statistics."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            s = m.score(np.asarray(batch.column(1).flatten()).reshape(-1, N_STATS)) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())],
                names=["doc_id", "score", "predicted"],
            )

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column | None = None, train_rows: int = TRAIN_ROWS, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every row; ``learn`` says which labels may be used."""
    stats = written(stats_table(docs), "quality-stats")
    usable = F.lit(True) if learn is None else learn
    return scored(stats, fit(training_rows(stats, labels, "quality", usable, train_rows)), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column | None = None, train_rows: int = TRAIN_ROWS, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, columns unchanged.

    Statistics of all rows are taken once more instead of being joined, so no
    text is shuffled.
    """
    spark = docs.sparkSession
    usable = F.lit(True) if learn is None else learn
    model = fit(training_rows(written(stats_table(docs), "quality-stats"), labels, "quality", usable, train_rows))
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            data, offsets = texts_of(batch.column(at))
            parts = [m.score(statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in groups(offsets)]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) >= threshold))
        release()

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted; labels of held-out rows are not learned.

    A row without doc_id teaches nothing and so counts as held out.
    """
    out = quality_scores(docs, labels, crc_rest("doc_id", 4) != 2)
    return out.select("doc_id", F.coalesce(crc_rest("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "score", "predicted")
