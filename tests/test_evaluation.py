"""Minimal-pair metrics, training shapes, tokenizers and the oracles."""

import math

import pytest
from pyspark.sql import functions as F

from lexloom.functions import rules as R
from lexloom.operators import minpair, tokenize, training


def sides(spark, rows):
    return minpair.wide(spark.createDataFrame(rows, "subset string, pair_id long, side string, lp double, n_tokens int, n_chars int, n_bytes int"))


def test_uniform_model(spark):
    ln = minpair.LN256
    rows = [("s", 1, "good", -2 * ln, 2, 3, 3), ("s", 1, "bad", -ln, 1, 2, 2), ("s", 2, "good", -ln, 1, 2, 2), ("s", 2, "bad", -2 * ln, 2, 3, 3), ("t", 3, "good", None, 0, 0, 0), ("t", 3, "bad", -1.0, 1, 1, 1)]
    got = {r.pair_id: r for r in minpair.pair_metrics(sides(spark, rows)).collect()}
    assert [got[2][f"{m}_correct"] for m in R.METRICS] == [True, False, True, True]
    assert [got[1][f"{m}_correct"] for m in R.METRICS][:2] == [False, False]
    assert not any(got[3][f"{m}_correct"] for m in R.METRICS)
    acc = minpair.subset_accuracy(minpair.pair_metrics(sides(spark, rows)))
    assert minpair.macro_average(acc).first()["raw_log_prob"] == pytest.approx((0.5 + 0) / 2)


def test_arrow_scorer(spark):
    pairs = spark.createDataFrame([("s", 1, "a b c", "a b")], "subset string, pair_id long, sentence_good string, sentence_bad string")
    out = {r.side: r for r in minpair.sentence_scores(minpair.score(minpair.sides(pairs), minpair.uniform_scorer)).collect()}
    assert out["good"].lp == pytest.approx(-3 * math.log(256)) and out["bad"].n_tokens == 2


def test_p_value():
    assert minpair.p_value(0.0, 10) == 1.0
    assert minpair.p_value(0.5, 20) == pytest.approx(0.0247, abs=2e-4)
    assert minpair.p_value(-0.9, 5) == pytest.approx(0.0374, abs=2e-4)


def test_correlation_without_variance(spark):
    e = spark.createDataFrame([("m", 1, 0.0), ("m", 1, 1.0), ("k", 0, 0.0), ("k", 1, 1.0)], "metric string, abs_delta int, error double")
    assert {r.metric: r.r for r in minpair.correlation(e).collect()} == {"m": 0.0, "k": pytest.approx(1.0)}


def test_category():
    names = {c: [s for s in R.SUBSETS if f(s)] for c, f in (("wh", lambda s: "wh_" in s or "wh-" in s), ("agreement", lambda s: "agreement" in s), ("npi", lambda s: "npi" in s))}
    assert [len(v) for v in names.values()] == [8, 16, 7] and len(R.SUBSETS) == 67


def test_shapes(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, [7, 8, 9]), (3, [])], "doc_id long, ids array<int>")
    rows = {r.doc_id: r for r in training.batches(df, "ids", 2).collect()}
    assert rows[1].input_ids == [5, 6, 0] and rows[1].labels == [5, 6, -100] and rows[1].attention_mask == [1, 1, 0] and rows[3].width == 0
    x, y = training.shifted(F.col("ids"))
    assert [tuple(r) for r in df.select(x, y).collect()] == [([5], [6]), ([7, 8], [8, 9]), ([], [])]
    assert df.select(training.framed(F.col("ids"), -1, -1)).first()[0] == [1, 5, 6, 2]
    assert [r.id for r in training.packed(df, block=2).orderBy("block", "pos").collect()] == [5, 6, 7, 8, 9]
    assert training.required_vocab(100, [3, None, 120]) == 121


def test_early_stop(spark):
    log = spark.createDataFrame([("r", e, v) for e, v in enumerate([0.1, 0.3, 0.3, 0.2, 0.9], 1)], "run string, epoch int, value double")
    assert tuple(training.best_epochs(log).first()) == ("r", 2, 0.3, 4)


def test_rolling_mean(spark):
    log = spark.createDataFrame([(i, float(i)) for i in range(1, 301)], "step long, value double")
    assert {r.step: r["mean"] for r in training.rolling_mean(log, "step", "value").collect()} == {100: 50.5, 200: 150.5, 300: 250.5}


def python_bpe(counts, merges):
    words = {w: list("▁" + w) for w in counts}
    learned = []
    for _ in range(merges):
        pairs: dict = {}
        for w, s in words.items():
            for p in zip(s, s[1:], strict=False):
                pairs[p] = pairs.get(p, 0) + counts[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        learned.append("".join(best))
        for w, s in words.items():
            out: list = []
            for x in s:
                if out and (out[-1], x) == best:
                    out[-1] = "".join(best)
                else:
                    out.append(x)
            words[w] = out
    return learned


def test_bpe_training_and_encoding(spark):
    text = ["low lower lowest", "newer newest wide low", "low low new"]
    lines = spark.createDataFrame([(t,) for t in text], "line string")
    vocab = tokenize.train_bpe(lines, 8)
    counts: dict = {}
    for w in " ".join(text).split():
        counts[w] = counts.get(w, 0) + 1
    rows = vocab.orderBy("id").collect()
    want = python_bpe(counts, 8)
    assert [r.piece for r in rows if r.kind == "learned"][: len(want)] == want
    assert [r.piece for r in rows[:5]] == [*R.SPECIALS_MARKED, "@@"] and rows[5].piece == "<0x00>"
    v = tokenize.vocabulary(vocab, "bpe")
    for t in ("low newest", "slow ünder", "a@@ low"):
        assert tokenize.decode(v.pieces(t)) == t
    report = tokenize.granularity(lines, v, "t", ["er", "est"]).first()
    assert report.avg_tokens_per_word == pytest.approx(sum(len(v.pieces(w)) * n for w, n in counts.items()) / sum(counts.values()))


def test_unigram_training(spark):
    lines = spark.createDataFrame([("the cat the hat the bat",), ("that cat that hat",)], "line string")
    vocab = tokenize.train_unigram(lines, 20)
    v = tokenize.vocabulary(vocab, "unigram")
    assert tokenize.decode(v.pieces("the cat")) == "the cat" and len(v.pieces("the")) < 4


ORACLES = ("phase1_stats", "phase2_stats", "quality_threshold", "nearest_prefix_mixture", "morph_split_marked", "morph_split_plain", "macro_average", "vocab_sweep", "imbalance_bins", "error_trend", "benchmark_table", "pad_batches", "early_stop", "glue_metrics", "phase1_reasons", "phase1_removed", "corpus_files", "pair_files", "training_pair_files", "split_files", "rule_file", "vocab_file", "result_files", "benchmark_markdown", "packed_blocks", "pseudo_likelihood", "final_order", "final_files", "budget_prefix_cut", "nearest_prefix_cut", "uniform_accuracy", "granularity_rows", "imbalance_corr", "category_corr", "near_dup_exact_pairs", "pair_file_counts")


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, name):
    import duckdb

    from lexloom.plans import catalogue, files  # noqa: F401

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, d).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(str([round(v, 5) if isinstance(v, float) else v for v in r]) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False))
    assert key(got) == key(want)
