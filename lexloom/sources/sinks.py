"""Writers of the pipeline's files; every path may be in any store Spark writes to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources import corpora


def write_lines(df: DataFrame, path: str, column: str = "line", single_file: bool = False) -> None:
    """One line of text per row."""
    out = df.select(column)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").text(path)


def write_ordered(df: DataFrame, path: str, *order: str, column: str = "line") -> None:
    """One line of text per row, in order over the part files' names, and their manifest beside them.

    Ranges of the order are sorted each; the manifest at ``path``_manifest lists
    the parts in order with the number of lines of each.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(column).write.mode("overwrite").text(path)
    rows = corpora.read_lines(spark, path).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))
    files = sorted(spark.read.text(path).inputFiles())
    # one row per part
    lines = {r["doc_id"]: r["lines"] for r in rows.collect()}
    write_document(spark, [{"part": f.rsplit("/", 1)[-1], "lines": lines.get(k, 0)} for k, f in enumerate(files)], f"{path}_manifest")


def million(n: int) -> int:
    return n // 1_000_000


def phase_names(target: int, top: float, sample: int) -> dict[str, str]:
    """File names that follow from the sizes asked for."""
    return {
        "phase2": f"clean_{million(target)}M_full",
        "phase3": f"clean_{million(target)}M_top{int(top * 100)}",
        "phase4": f"clean_{max(1, million(sample))}M",
    }


def write_document(spark: SparkSession, value: object, path: str) -> None:
    """A small JSON document, indented by two, as one file in a folder."""
    text = json.dumps(value, indent=2, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    """piece TAB score in id order, without quoting."""
    rows = vocab.orderBy("id").select(F.concat_ws("\t", "piece", F.col("score").cast("string")).alias("value"))
    rows.coalesce(1).write.mode("overwrite").text(path)


def results_json(accuracy: DataFrame) -> DataFrame:
    """One row with the flat subset-to-accuracy object; subsets are a fixed, small set."""
    return accuracy.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("subset", "accuracy"))))).alias("json"))


def records_json(df: DataFrame, path: str) -> None:
    """JSON records, one per line."""
    df.write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """JSON lines in one folder per split."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def markdown(header: list[str], rows: list[tuple]) -> str:
    """A table in Markdown; null cells are '-'."""
    cell = lambda v: "-" if v is None else str(v)
    out = ["| " + " | ".join(header) + " |", "| " + " | ".join("---" for _ in header) + " |"]
    return "\n".join(out + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])
