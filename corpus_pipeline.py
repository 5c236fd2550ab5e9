"""A corpus pipeline over the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. All stages but the
last keep the columns of ``documents``.

1. quality: documents whose score is below 0.7 go.
2. exact dedup: of equal texts the smallest doc_id stays.
3. near dedup: of a class of near-duplicates the smallest doc_id stays.
4. decontamination: documents of which the benchmark covers a twentieth go.
5. encoding: token counts and digests of ids and decoded text.

Stages work on rows: rows that share a doc_id are judged one by one, and of
equal rows one stays. Null counts as an empty text, which is scored, is a copy
of other empty texts in stage 2, and has no words for stages 3 and 4. A null
doc_id comes after all others where the smallest is looked for; such rows teach
the classifier nothing. Further columns pass through stages 1 to 4 under their
names, whatever those are. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, exact_dedup, near_dedup, piece_bpe, quality
from lexloom.llm.queries import table, tokenizer_path
from lexloom.session import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), quality.crc_rest(F.col("doc_id"), 4) != 2)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(docs, piece_bpe.model_bytes(tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("encode", encode_stage),
]

#: SQL cannot express the classifier, the sampling or the tokenizer; a test compares run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
