"""Phase 1 over a stream of lines: the stateless cleaners, then first copies only.

Which copy of a line counts as first is the order of arrival; the set of kept
lines is that of the batch operator. With an event-time column the state of
seen lines is bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import cleaners as C
from lexloom.functions import text as T


def kept_lines(lines: DataFrame, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """corpus, line (cleaned) and hash of lines that pass every filter, each text once per corpus."""
    out = lines.withColumn("norm", T.normalize_ws(F.col("line")))
    out = out.withColumn("clean", C.cleaned(F.col("corpus"), F.col("norm")))
    out = out.filter(C.line_reason(F.col("norm"), F.col("clean")).isNull()).withColumn("h", T.line_hash(F.col("clean")))
    if event_time is not None:
        out = out.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["corpus", "h"])
    else:
        out = out.dropDuplicates(["corpus", "h"])
    return out.select("corpus", F.col("clean").alias("line"), "h", *([event_time] if event_time else []))


def reason_counts(lines: DataFrame, event_time: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Lines per corpus, reason and time window, for monitoring; late lines are counted up to ``delay``."""
    norm = T.normalize_ws(F.col("line"))
    reason = F.coalesce(C.line_reason(norm, C.cleaned(F.col("corpus"), norm)), F.lit("kept"))
    return (
        lines.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, window), "corpus", reason.alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
