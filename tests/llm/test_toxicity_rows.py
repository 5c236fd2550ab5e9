"""Operator 5 learns from every labelled row that it may learn from: counts, networks and thresholds."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lexloom.llm import toxicity


def rare(toxic=800, clean=2_000):
    """Texts of rare words, toxic and clean ones, each word in three texts to learn from and a held-out one."""
    rng, plain = random.Random(5), [f"plain{i}" for i in range(60)]
    learned, held, i, n = [], [], 0, toxic + clean
    while len(learned) < 3 * n or len(held) < n:
        (learned if zlib.crc32(str(i).encode()) % 5 else held).append(i)
        i += 1
    docs = []
    for k in range(n):
        word = f"{rng.randrange(10**6):06d}x{k}"
        docs += [(i, " ".join([*rng.sample(plain, 3), word]), int(k < toxic)) for i in (*learned[3 * k : 3 * k + 3], held[k])]
    return docs


def test_rare_words_of_all_rows_are_learned(spark):
    """A sample of 5,000 of the 8,400 rows has few words three times."""
    docs = rare()
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxic int").cache()
    got = {r.doc_id: r for r in toxicity.report(frame.select("doc_id", "text"), frame.select("doc_id", "toxic")).collect()}
    assert len(got) == len(docs)
    held = [(got[i].predicted, y) for i, _, y in docs if got[i].held_out]
    assert np.mean([p for p, y in held if y]) > 0.9
    assert np.mean([p for p, y in held if not y]) < 0.05


def test_texts_with_a_bucket_are_counted_in_all_rows(spark):
    docs = rare(600, 1_100)
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    rows = toxicity.examples(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), "toxic", F.lit(True)).cache()
    assert rows.count() == len(docs)
    want = {}
    for r in rows.collect():
        for b in set(np.frombuffer(r.words, np.int32).tolist()):
            want.setdefault(b, [0, 0])[r.y] += 1
    assert {r.bucket: [r.clean, r.toxic] for r in toxicity.bucket_counts(rows).collect()} == want


def test_a_round_is_the_mean_of_its_shards(spark):
    """Copies that the shards take on, averaged by rows, against the same steps in this process."""
    docs = rare(20, 30)
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    rows = toxicity.examples(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), "toxic", F.lit(True)).cache()
    mapping = toxicity.rows_of(toxicity.chosen_buckets(rows, np.array([120.0, 80.0])))
    net = toxicity.fresh(mapping, 11)
    start = toxicity.packed(net, toxicity.still(net))
    for left_out in (-1, 2):
        (got,) = toxicity.one_round(rows, mapping, [start], [left_out], [(1.0, 2.0)], 3, 2, 7)
        shard = F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(3))
        total, n = np.zeros(len(start)), 0
        for s in range(3):
            own = [r for r in rows.filter(shard == s).orderBy("doc_id").collect() if r.bucket % toxicity.FOLDS != left_out]
            net, past = toxicity.unpacked(start)
            ids = [mapping[np.frombuffer(r.words, np.int32).reshape(2, -1)] for r in own]
            rng = np.random.default_rng((7, 0, s))
            for _ in range(2):
                toxicity.advance(net, past, ids, [float(r.y) for r in own], [1.0 + r.y for r in own], rng)
            total, n = total + len(own) * toxicity.packed(net, past).astype(float), n + len(own)
        assert np.allclose(got, total / n, atol=1e-4)
        assert not np.allclose(got, start, atol=1e-2)


def test_further_buckets_share_embeddings():
    buckets = np.random.default_rng(1).permutation(1 << toxicity.BITS)[: toxicity.OWN + 9_000]
    rows = toxicity.rows_of(buckets)
    assert (rows[buckets[: toxicity.OWN]] == np.arange(1, toxicity.OWN + 1)).all()
    assert rows[buckets[toxicity.OWN :]].min() > toxicity.OWN and rows.max() <= toxicity.OWN + toxicity.SHARED < 1 << 16
    assert np.count_nonzero(rows) == len(buckets)


def test_equal_logits_are_on_one_side():
    z, y = np.array([0.0, 0.0, 1.0, 1.0]), np.array([1.0, 0.0, 0.0, 1.0])
    assert toxicity.best_cut(z, y, np.array([1.0, 5.0, 1.0, 9.0])) == 0.5
