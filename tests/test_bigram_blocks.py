"""Bigram scores over blocks of texts: what is shuffled, and that neither blocks nor parts change a score."""

import random

import numpy as np

from lexloom.operators import minpair
from lexloom.plans import catalogue as Q


def test_numbers_in_planes():
    x = np.array([0, 1, 255, 256, 1 << 40, (1 << 62) + 5])
    assert minpair.unpacked(minpair.packed(x)).tolist() == x.tolist() and minpair.unpacked(minpair.packed(x[:0])).tolist() == []


def test_blocks_change_nothing(spark):
    r = random.Random(3)
    words = ["a", "b", "<s>", "é", "x y", "\t", *(f"w{i}" for i in range(60))]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(12))) for _ in range(300)] + ["  a\n\nb ", "", "a b"] * 40
    pairs = spark.createDataFrame([("s", i, t, None if i % 50 == 0 else f"{t} zz a") for i, t in enumerate(texts)], "subset string, pair_id long, sentence_good string, sentence_bad string")
    rows = minpair.rows_of(pairs, pairs.selectExpr("sentence_good AS text"))
    both = rows.unionByName(pairs.selectExpr("subset", "pair_id + 1000 AS pair_id", "sentence_good", "sentence_bad", "sentence_good AS text", "0L AS at"))
    one, many = (sorted(minpair.bigram_wide(both, block=b).collect(), key=lambda x: x.pair_id) for b in (1 << 20, 500))
    assert len(one) == 2 * len(texts) and one == many
    assert [x[2:] for x in one[: len(texts)]] == [x[2:] for x in one[len(texts) :]]


def test_no_row_for_each_term(spark):
    """Before, every distinct term of every text was a row of two shuffles."""
    for name in ("sentence_logprob", "macro_average", "imbalance_bins"):
        plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "prev" not in plan and "Window" not in plan
