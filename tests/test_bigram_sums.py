"""Bigram scores: sums that no order changes, one shuffle of terms, token differences without a model."""

import math
from collections import Counter

from lexloom.operators import minpair
from lexloom.plans import catalogue as Q
from lexloom.plans import inputs as I

TEXTS = ["a a b c a b", "b b a  c\na", "", "c", "d d e f g h i j k l m n o p a b c d e f", None]


def test_scores_of_both_forms(spark):
    corpus = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    pairs = spark.createDataFrame([("s", 1, "a a b c", "a a b c"), ("s", 2, "x b a", "b x a"), ("t", 1, "", "a")], "subset string, pair_id long, sentence_good string, sentence_bad string")
    grams = Counter(g for t in TEXTS if t for w in [t.split()] for g in zip(["<s>", *w], w))
    v, cp = len({b for _, b in grams}), Counter()
    for (a, _), n in grams.items():
        cp[a] += n
    want = lambda t: sum(math.log((grams[g] + 1) / (cp[g[0]] + v)) for w in [t.split()] for g in zip(["<s>", *w], w)) if t else None
    close = lambda x, y: x is None and y is None or abs(x - y) < 1e-11
    got = minpair.bigram_wide(minpair.rows_of(pairs, corpus)).collect()
    texts = {(r.subset, r.pair_id): r for r in pairs.collect()}
    assert len(got) == 3
    for r in got:
        p = texts[r.subset, r.pair_id]
        assert close(r.lp_good, want(p.sentence_good)) and close(r.lp_bad, want(p.sentence_bad))
        assert (r.n_tokens_good, r.n_chars_good, r.n_bytes_bad) == (len(p.sentence_good.split()), len(p.sentence_good), len(p.sentence_bad))
    long = minpair.bigram_scores(minpair.sides(pairs), corpus).collect()
    assert len(long) == 6 and all(close(r.lp, want(texts[r.subset, r.pair_id][f"sentence_{r.side}"])) for r in long)


def test_equal_sides_tie(spark):
    """Sides of the same words tie, in whatever order their parts are added."""
    texts = [f"w{i % 7} w{i % 7} " + " ".join(f"w{(i * k * k) % 211}" for k in range(400)) for i in range(200)]
    pairs = spark.createDataFrame([("s", i, t, t) for i, t in enumerate(texts)], "subset string, pair_id long, sentence_good string, sentence_bad string")
    for parts in (1, 7):
        rows = minpair.rows_of(pairs.repartition(parts), pairs.selectExpr("sentence_good AS text"))
        assert minpair.bigram_wide(rows).filter("lp_good <> lp_bad").count() == 0


def test_what_is_shuffled(spark):
    """Words meet once; differences in tokens need no model."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    d = "/root/testdata/sf0.001"
    assert plan(Q.QUERIES["pair_metrics"](spark, d)).count("SortMergeJoin") == 0
    assert "Window" not in plan(Q.QUERIES["imbalance_pairs"](spark, d)) and "Join" not in plan(Q.QUERIES["imbalance_pairs"](spark, d))
    assert I.pair_rows(spark, d).filter("pair_id IS NOT NULL").drop("text").exceptAll(I.pairs(spark, d)).count() == 0


def test_category_table_scores_once(spark):
    """Both halves of the table read one table of errors; no terms are counted in its own plan."""
    plan = Q.QUERIES["category_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" not in plan
