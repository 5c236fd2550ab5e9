"""The curation pipeline from corpora to the report, and its command line."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from lexloom.operators import curate
from lexloom.session import written
from lexloom.sources import corpora, sinks


def run(lines: DataFrame, target_tokens: int = 10_000_000, top: float = 0.70, sample_tokens: int = 1_000_000, seed: int = 42, near: float | None = None) -> dict:
    """All phases; returns the kept lines of each and the report.

    Phase results are written once in the shared folder and reused.
    """
    one = written(curate.phase1(lines), "phase1")
    two = written(curate.phase2(curate.kept(one), target_tokens, seed, near), "phase2")
    full = two.filter("reason IS NULL").select("corpus", "doc_id", "pos", "line", "n_tokens")
    three = written(curate.scored(full), "phase3")
    best = written(curate.top_fraction(three, top, seed), "top")
    four = written(curate.nearest_prefix(best, sample_tokens, seed).select("corpus", "doc_id", "pos", "line", "n_tokens", "h"), "phase4")
    report = {
        "config": {"target_tokens": target_tokens, "top_percent": top, "sample_tokens": sample_tokens, "random_seed": seed},
        "phases": {
            "phase1": {"stats": rows(curate.stats(one)), "removed": rows(curate.reasons(one))},
            "phase2": {"stats": rows(curate.stats(two)), "removed": rows(curate.reasons(two))},
            "phase3": {"threshold": curate.threshold_of(best).first()[0], "histogram": rows(curate.histogram(three)), "kept": best.count()},
            "phase4": {"mixture": rows(curate.mixture_of(four, sample_tokens))},
        },
    }
    raw, left = one.count(), full.count()
    report["summary"] = {"input_lines": raw, "phase2_lines": left, "retention": f"{100 * left / raw:.2f}%" if raw else None}
    return {"phase1": one, "phase2": full, "phase3": best, "phase4": four, "report": report}


def rows(df: DataFrame) -> list[dict]:
    """A small result as dictionaries."""
    return sorted((r.asDict() for r in df.collect()), key=lambda r: str(list(r.values())))


def write(result: dict, folder: str, target_tokens: int, top: float, sample_tokens: int) -> None:
    """Text files of phases 2 to 4, the last one in its seeded order, and the report."""
    for phase, name in sinks.phase_names(target_tokens, top, sample_tokens).items():
        if phase == "phase4":
            sinks.write_ordered(result[phase], f"{folder}/{name}", "h", "corpus", "doc_id", "pos")
        else:
            sinks.write_lines(result[phase], f"{folder}/{name}")
    spark = result["phase1"].sparkSession
    sinks.write_document(spark, result["report"], f"{folder}/cleaning_report")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Clean text corpora.")
    p.add_argument("--input-dir", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--random-seed", type=int, default=42)
    p.add_argument("--target-tokens", type=int, default=10_000_000)
    p.add_argument("--top-percent", type=float, default=0.70)
    p.add_argument("--sample-tokens", type=int, default=1_000_000)
    p.add_argument("--near-dedup", type=float, default=None, help="similarity from which later lines are dropped")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lexloom-clean").getOrCreate()
    result = run(corpora.read_corpora(spark, a.input_dir), a.target_tokens, a.top_percent, a.sample_tokens, a.random_seed, a.near_dedup)
    write(result, a.output_dir, a.target_tokens, a.top_percent, a.sample_tokens)



if __name__ == "__main__":
    main()
