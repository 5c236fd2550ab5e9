"""Result tables and the cleaning report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T


def benchmark_table(models: DataFrame, tokenizers: DataFrame) -> DataFrame:
    """Models with their tokenizer's figures by label rule; missing cells are '-'.

    A label with Baseline takes the baseline tokenizer, Morph-<size> the one of
    that size.
    """
    size = F.regexp_extract("label", r"-([^-]*)$", 1)
    key = F.when(F.col("label").contains("Baseline"), "baseline").when(F.col("label").contains("Morph-"), F.concat(F.lit("morph_"), size))
    cell = lambda c: F.coalesce(c, F.lit("-"))
    number = lambda c, n: F.when(F.col(c).isNotNull(), F.format_string(f"%.{n}f", F.round(F.col(c), n)))
    out = models.withColumn("tokenizer", key).join(F.broadcast(tokenizers), "tokenizer", "left")
    return out.select(
        F.col("label").alias("model"),
        cell(number("tokens_per_1000_chars", 2)).alias("tokens_per_1k_chars"),
        cell(number("avg_tokens_per_word", 2)).alias("avg_tokens_per_word"),
        cell(F.concat(number("morph_percent", 1), F.lit("%"))).alias("morph_align"),
        *[cell(number(m, 4)).alias(n) for m, n in (("raw_log_prob", "sum"), ("normalized_log_prob", "mean"), ("bpc", "bpc"), ("bpb", "bpb"))],
    )


def granularity_rows(models: DataFrame, tokenizers: DataFrame) -> DataFrame:
    """Per size: per-token and per-byte accuracy, their difference, tokens per character; only sizes with both."""
    return models.join(tokenizers, "size").select(
        "size", "normalized_log_prob", "bpb", (F.col("normalized_log_prob") - F.col("bpb")).alias("delta"), "compression_ratio"
    )


def category_table(by_category: DataFrame, overall: DataFrame) -> DataFrame:
    """r to three places and sample size per category, and the overall row."""
    one = lambda df, c: df.select(c.alias("category"), "metric", F.round("r", 3).alias("r"), "n")
    return one(by_category, F.col("category")).unionByName(one(overall, F.lit("Overall")))


def with_averages(accuracy: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Averages over subsets, recomputed from the rows."""
    return accuracy.agg(*[F.avg(m).alias(m) for m in metrics])


def summary(stats: DataFrame, phase2_lines: int) -> DataFrame:
    """Totals over corpora and the share of raw lines that phase 2 keeps."""
    out = stats.agg(*[F.sum(c).alias(c) for c in ("input_lines", "input_tokens", "output_lines", "output_tokens")])
    return out.withColumn("phase2_lines", F.lit(phase2_lines)).withColumn("retention", T.percent(F.col("phase2_lines"), F.col("input_lines")))
