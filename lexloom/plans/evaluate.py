"""Command lines of tokenizers and minimal pairs: training, reports, scores, sweep, imbalance and the result table.

``python -m lexloom.plans.evaluate COMMAND --help`` tells each command's
options. Sentences are scored by a bigram model of a folder of corpora.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import morphology as M
from lexloom.functions import rules as R
from lexloom.operators import minpair, report, tokenize
from lexloom.session import written
from lexloom.sources import corpora, sinks

AFFIXES = sorted({*R.PREFIXES, *R.SUFFIXES})
CELLS = ["tokens_per_1k_chars", "avg_tokens_per_word", "morph_align", "sum", "mean", "bpc", "bpb"]


def vocabularies(spark: SparkSession, lines: DataFrame, sizes: list[int], kind: str, segment: str) -> dict[int, DataFrame]:
    """A vocabulary per size. A smaller merge-type one is the largest one's first merges, so one training does for all."""
    cut = {"none": F.col("line"), "plain": M.plain_line(F.col("line")), "marked": M.marked_line(F.col("line"))}[segment]
    rows = lines.select(cut.alias("line"))
    if kind == "unigram":
        return {n: tokenize.train_unigram(rows, n) for n in sizes}
    family = (R.SPECIALS_MARKED, R.MARKER) if segment == "marked" else (R.SPECIALS_PLAIN, "[MASK]")
    largest = written(tokenize.train_bpe(rows, max(sizes), *family), "vocabulary")
    learned = F.col("kind") == "learned"
    return {n: largest.filter(~learned | (F.length("piece") == 1) | (F.col("score") > -n)) for n in sizes}


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    for n, vocab in vocabularies(spark, corpora.read_corpora(spark, a.input_dir), a.sizes, a.kind, a.segment).items():
        sinks.write_vocab(vocab, f"{a.output_dir}/{n}/tokenizer.vocab")


def loaded(spark: SparkSession, path: str, kind: str) -> tokenize.Vocabulary:
    """A vocabulary file, or the one in a folder of that name."""
    return tokenize.vocabulary(corpora.read_vocab(spark, corpora.first_existing(spark, f"{path}/tokenizer.vocab", path)), kind)


def tokenizer_report(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = tokenize.granularity(corpora.read_corpora(spark, a.input_dir), loaded(spark, a.vocab, a.kind), a.name, AFFIXES)
    sinks.write_document(spark, rows.first().asDict(), a.output)


def scored_pairs(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Both sides of all pairs with their scores, written once."""
    text = corpora.read_corpora(spark, a.corpus_dir).select(F.col("line").alias("text"))
    pairs = corpora.read_pairs(spark, a.pairs_dir)
    return written(minpair.bigram_wide(minpair.rows_of(pairs, text)), "scored-pairs")


def pairs(spark: SparkSession, a: argparse.Namespace) -> None:
    accuracy = minpair.subset_accuracy(minpair.pair_metrics(scored_pairs(spark, a)))
    rows = [r.asDict() for r in accuracy.collect()]  # one per subset
    averages = {m: sum(r[m] for r in rows) / len(rows) for m in R.METRICS} if rows else {}
    subsets = {r["subset"]: {m: r[m] for m in R.METRICS} for r in sorted(rows, key=lambda r: r["subset"])}
    sinks.write_document(spark, {"subsets": subsets, "averages": averages}, a.output)


def sweep(spark: SparkSession, a: argparse.Namespace) -> None:
    lengths = minpair.cut_lengths(minpair.sides(corpora.read_pairs(spark, a.pairs_dir)), loaded(spark, a.vocab, "bpe"), a.sizes)
    rows = minpair.sweep(scored_pairs(spark, a), lengths).collect()  # one per size
    sinks.write_document(spark, [r.asDict() for r in rows], a.output)


def imbalance(spark: SparkSession, a: argparse.Namespace) -> None:
    metrics = minpair.imbalance(minpair.pair_metrics(scored_pairs(spark, a)))
    errors = minpair.long_errors(metrics)
    # a row per metric, and per metric and category
    overall = [r.asDict() for r in minpair.correlation(errors).collect()]
    by_category = [r.asDict() for r in minpair.correlation(errors.filter("category IS NOT NULL"), ("category", "metric")).collect()]
    sinks.write_document(spark, {"overall": overall, "categories": by_category}, f"{a.output}/correlations")
    sinks.records_json(metrics.select("subset", "pair_id", "category", "delta", "abs_delta"), f"{a.output}/pairs")


def table(spark: SparkSession, a: argparse.Namespace) -> None:
    """``--model LABEL=RESULTS`` and ``--tokenizer REPORT`` files in one Markdown table."""
    models = []
    for item in a.model:
        label, path = item.split("=", 1)
        averages = json.loads(spark.read.text(path, wholetext=True).first()[0])["averages"]
        models.append((label, *(float(averages[m]) for m in R.METRICS)))
    figures = None
    for path in a.tokenizer:
        one = corpora.read_tokenizer_report(spark, path).withColumn("morph_percent", F.col("morph_alignment_score") * 100)
        figures = one if figures is None else figures.unionByName(one)
    if figures is None:
        figures = spark.createDataFrame([], "tokenizer string, tokens_per_1000_chars double, avg_tokens_per_word double, morph_percent double")
    rows = report.benchmark_table(spark.createDataFrame(models, "label string, " + ", ".join(f"{m} double" for m in R.METRICS)), figures)
    order = [m[0] for m in models]
    found = sorted(rows.select("model", *CELLS).collect(), key=lambda r: order.index(r["model"]))
    sinks.write_lines(spark.createDataFrame([(sinks.markdown(["model", *CELLS], [tuple(r) for r in found]),)], "line string"), a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    commands = p.add_subparsers(required=True)

    def command(name: str, run, *options: tuple) -> None:
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        for option, kwargs in options:
            c.add_argument(option, **kwargs)

    needed = {"required": True}
    kind = ("--kind", {"choices": ["bpe", "unigram"], "default": "bpe"})
    sources = (("--pairs-dir", needed), ("--corpus-dir", needed), ("--output", needed))
    sizes = ("--sizes", {"type": int, "nargs": "+", "default": [5_000, 10_000, 30_000]})
    command("train", train, ("--input-dir", needed), ("--output-dir", needed), sizes, kind, ("--segment", {"choices": ["none", "plain", "marked"], "default": "none"}))
    command("tokenizer-report", tokenizer_report, ("--input-dir", needed), ("--vocab", needed), ("--name", needed), ("--output", needed), kind)
    command("pairs", pairs, *sources)
    command("sweep", sweep, *sources, ("--vocab", needed), sizes)
    command("imbalance", imbalance, *sources)
    command("table", table, ("--model", {"action": "append", "required": True}), ("--tokenizer", {"action": "append", "default": []}), ("--output", needed))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.appName("lexloom-evaluate").getOrCreate(), a)


if __name__ == "__main__":
    main()
