"""Signatures in batches equal the expression; hot bands lose no pair."""

import random

from pyspark.sql import functions as F

from lexloom.operators import neardup


def table(spark, texts):
    return spark.createDataFrame([(i * 7, t) for i, t in enumerate(texts)], "id long, line string").withColumn("place", F.struct(F.col("id").alias("doc_id"), F.lit(0).alias("pos")))


def test_signatures_equal_the_expression(spark):
    rng = random.Random(6)
    texts = ["", "ab", "abc", "é😀é", "a" * 50, None] + ["".join(rng.choice("abcdéß 😀") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    texts.append("".join(chr(rng.randint(32, 0xD000)) for _ in range(30_000)))
    lines = table(spark, texts)
    want = {r.id: r.sig for r in lines.select("id", neardup.signature(F.coalesce("line", F.lit(""))).alias("sig")).collect()}
    assert {r.id: r.sig for r in neardup.signatures(lines).collect()} == want


def test_hot_bands_lose_no_pair(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefghij ") for _ in range(400))
    texts = [base[:k] + rng.choice("xyz") + base[k + 1 :] for k in (rng.randrange(400) for _ in range(40))] + [base[: rng.randint(250, 400)] for _ in range(40)]
    lines = table(spark, sorted(set(texts)))
    pairs = lambda hot: {(r.a, r.b, r.similarity) for r in neardup.lsh_pairs(lines, hot=hot).collect()}
    assert pairs(3) == pairs(10_000) and len(pairs(3)) > 50
