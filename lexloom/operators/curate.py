"""Curation operators: cleaning, exact deduplication, sampling, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import cleaners as C
from lexloom.functions import rules as R
from lexloom.functions import text as T
from lexloom.session import written

#: Leading hex digits of the order hash that make a bucket of a running sum.
BUCKET_DIGITS = 3


def corpus_rank(corpus: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in R.CORPORA]), corpus).cast("int")


def mark_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with the column ``first``: whether the row is the first of its keys.

    Minima are combined before the shuffle, and rows meet them on keys and
    order together, so a frequent key is not gathered anywhere.
    """
    firsts = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__o")).select(*keys, *[F.col(f"__o.{c}").alias(c) for c in order], F.lit(True).alias("__first"))
    return df.join(firsts, [*keys, *order], "left").withColumn("first", F.coalesce("__first", F.lit(False))).drop("__first")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in keys])).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def cleaned_lines(lines: DataFrame) -> DataFrame:
    """Every line with norm, clean, n_in, n_out, h (hash of clean) and the reason that its own text gives.

    ``lines`` has corpus, doc_id, pos and line. Each step is evaluated once.
    """
    out = T.once(lines, norm=T.normalize_ws(F.col("line")))
    out = T.once(out, clean=C.cleaned(F.col("corpus"), F.col("norm")))
    return T.once(
        out,
        n_in=T.count_words(F.col("norm")),
        n_out=T.count_tokens(F.col("clean")),
        h=T.line_hash(F.col("clean")),
        reason=C.line_reason(F.col("norm"), F.col("clean")),
    )


def phase1(lines: DataFrame) -> DataFrame:
    """:func:`cleaned_lines` with later copies of a corpus's text marked; a null reason keeps a line.

    Cleaned lines are written once, as the marking reads them twice.
    """
    out = written(cleaned_lines(lines), "cleaned")
    # dropped lines get a key of their own, so they are no copies of each other
    key = F.when(F.col("reason").isNull(), F.col("h")).otherwise(F.concat_ws("#", F.lit("-"), "doc_id", "pos"))
    out = mark_first(out.withColumn("key", key), ["corpus", "key"], ["doc_id", "pos"])
    reason = F.when(F.col("reason").isNull() & ~F.col("first"), "exact_duplicate").otherwise(F.col("reason"))
    return out.withColumn("reason", reason).drop("key", "first")


def text_counts(lines: DataFrame) -> DataFrame:
    """corpus, reason, h (of kept texts), n lines, n_in tokens of all of them and n_out of one."""
    out = cleaned_lines(lines).select("corpus", "reason", F.when(F.col("reason").isNull(), F.col("h")).alias("h"), "n_in", "n_out")
    return out.groupBy("corpus", "reason", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("n_in").alias("n_in"), F.max("n_out").alias("n_out"))


def phase1_stats(lines: DataFrame) -> DataFrame:
    """:func:`stats` of phase 1 without marking any line: one of each kept text stays."""
    kept_text = F.col("reason").isNull()
    return text_counts(lines).groupBy("corpus").agg(
        F.sum("n").alias("input_lines"),
        F.sum("n_in").alias("input_tokens"),
        F.sum(F.when(kept_text, 1).otherwise(0)).alias("output_lines"),
        F.sum(F.when(kept_text, F.col("n_out")).otherwise(0)).cast("long").alias("output_tokens"),
    )


def phase1_reasons(lines: DataFrame) -> DataFrame:
    """:func:`reasons` of phase 1 without marking any line: the further ones of a kept text are its copies."""
    again = F.when(F.col("reason").isNull(), F.col("n") - 1).otherwise(F.col("n"))
    out = text_counts(lines).select("corpus", F.coalesce("reason", F.lit("exact_duplicate")).alias("reason"), again.alias("n"))
    return out.groupBy("corpus", "reason").agg(F.sum("n").alias("n")).filter("n > 0")


def kept(df: DataFrame) -> DataFrame:
    """Surviving lines of phase 1, stripped as the next phase reads them."""
    return (
        df.filter("reason IS NULL")
        .select("corpus", "doc_id", "pos", F.trim("clean").alias("line"))
        .filter("line <> ''")
        .withColumn("n_tokens", T.count_tokens(F.col("line")))
    )


def stats(df: DataFrame) -> DataFrame:
    """Per corpus: lines and tokens in and out, and lines removed by reason."""
    dropped = F.col("reason").isNotNull()
    total = df.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("input_lines"),
        F.sum("n_in").cast("long").alias("input_tokens"),
        F.sum(F.when(~dropped, 1).otherwise(0)).cast("long").alias("output_lines"),
        F.sum(F.when(~dropped, F.col("n_out")).otherwise(0)).cast("long").alias("output_tokens"),
    )
    return total


def reasons(df: DataFrame) -> DataFrame:
    """Lines removed per corpus and reason."""
    return df.filter("reason IS NOT NULL").groupBy("corpus", "reason").agg(F.count(F.lit(1)).alias("n"))


def targets(total: int, mixture: dict[str, float] | None = None) -> dict[str, int]:
    """Token budget of each corpus, truncated."""
    return {c: int(total * p) for c, p in (mixture or R.MIXTURE).items()}


def target_table(df: DataFrame, total: int, mixture: dict[str, float] | None = None) -> DataFrame:
    """corpus and target as a small table."""
    return df.sparkSession.createDataFrame(sorted(targets(total, mixture).items()), "corpus string, target long")


def running_total(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``df`` with ``total`` of the key and ``cum``, the running sum of ``value`` in the order ``h``, ``order``.

    Buckets of the leading digits of ``h`` are summed first; each bucket's
    window then starts from the sum of those before it, so a key's rows are
    spread over many tasks however few keys there are.
    """
    with_bucket = df.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    sums = with_bucket.groupBy(key, "bucket").agg(F.sum(value).alias("s"))
    w = Window.partitionBy(key).orderBy("bucket")
    # at most 4096 buckets for each corpus of a fixed list
    before = sums.select(
        key,
        "bucket",
        (F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("before"),
        F.sum("s").over(Window.partitionBy(key)).alias("total"),
    )
    inner = Window.partitionBy(key, "bucket").orderBy("h", *order).rowsBetween(Window.unboundedPreceding, 0)
    return with_bucket.join(before, [key, "bucket"]).withColumn("cum", F.sum(value).over(inner) + F.col("before")).drop("bucket", "before")


def budget_prefix(df: DataFrame, total: int, seed: int = 42, mixture: dict[str, float] | None = None) -> DataFrame:
    """Strict prefix in seeded order up to each corpus's budget; a corpus within its budget stays whole.

    Corpora without a share are left out.
    """
    t = F.broadcast(target_table(df, total, mixture))
    out = running_total(df.withColumn("h", T.order_hash(seed, F.col("line"))), "corpus", ["doc_id", "pos"], "n_tokens")
    return out.join(t, "corpus").filter((F.col("total") <= F.col("target")) | (F.col("cum") <= F.col("target")))


def sample_order() -> list[Column]:
    """Order of the sampled list: corpora in turn, whole corpora by place, others by hash."""
    whole = F.col("total") <= F.col("target")
    return [corpus_rank(F.col("corpus")).alias("corpus_rank"), F.when(whole, F.lit("")).otherwise(F.col("h")).alias("rank_hash")]


def nearest_prefix(df: DataFrame, total: int, seed: int = 42, mixture: dict[str, float] | None = None) -> DataFrame:
    """Prefix in seeded order; the first line over the budget counts if that is strictly closer."""
    t = F.broadcast(target_table(df, total, mixture))
    out = running_total(df.withColumn("h", T.order_hash(seed, F.col("line"))), "corpus", ["doc_id", "pos"], "n_tokens").join(t, "corpus")
    before = F.col("cum") - F.col("n_tokens")
    over = (before <= F.col("target")) & (F.col("cum") > F.col("target")) & (F.col("cum") - F.col("target") < F.col("target") - before)
    return out.filter((F.col("cum") <= F.col("target")) | over)


def phase2(lines: DataFrame, total: int, seed: int = 42, near: float | None = None) -> DataFrame:
    """Budget sample, global exact deduplication and content filters; every sampled line with its reason.

    With ``near``, lines that come after a similar one get the reason near_duplicate.
    """
    sampled = budget_prefix(lines, total, seed).select("corpus", "doc_id", "pos", "line", "n_tokens", *sample_order())
    marked = mark_first(sampled.withColumn("key", T.line_hash(F.col("line"))), ["key"], ["corpus_rank", "rank_hash", "doc_id", "pos"])
    reason = F.when(~F.col("first"), "global_duplicate").otherwise(C.content_reason(F.col("line")))
    out = T.once(marked, reason=reason).drop("key", "first").withColumn("n_in", F.col("n_tokens")).withColumn("n_out", F.col("n_tokens"))
    if near is not None:
        from lexloom.operators import neardup

        ids = out.filter("reason IS NULL").withColumn("id", F.xxhash64("corpus", "doc_id", "pos"))
        dropped = neardup.greedy_duplicates(ids.select("id", "line", F.struct("corpus_rank", "rank_hash", "doc_id", "pos").alias("place")), near)
        out = out.withColumn("id", F.xxhash64("corpus", "doc_id", "pos")).join(dropped.withColumn("near", F.lit(True)), "id", "left")
        out = out.withColumn("reason", F.coalesce("reason", F.when(F.col("near"), "near_duplicate"))).drop("id", "near")
    return out


def scored(lines: DataFrame) -> DataFrame:
    return T.once(lines, score=T.quality_score(F.col("line")))


def histogram(df: DataFrame) -> DataFrame:
    """Lines per score bucket."""
    return df.groupBy(T.score_bucket(F.col("score")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def top_fraction(df: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """The best floor(n * share) rows by score, ties in seeded order.

    Scores have two places, so at most 10,001 counts decide the threshold; only
    the rows at the threshold are ordered.
    """
    counts = df.groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score")).collect()
    left = int(sum(r["n"] for r in counts) * share)
    threshold, admit = None, 0
    for r in counts:
        if left <= 0:
            break
        threshold, admit = r["score"], min(left, r["n"])
        left -= r["n"]
    if threshold is None:
        return df.limit(0)
    above = df.filter(F.col("score") > threshold)
    if left >= 0:
        return df.filter(F.col("score") >= threshold)
    return above.unionByName(ordered_head(df.filter(F.col("score") == threshold), admit, seed))


def ordered_head(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The first n rows in seeded order, without one global sort.

    Counts per leading digits of the hash say which buckets are in whole and
    where the cut falls; only that bucket is ordered.
    """
    keyed = df.withColumn("h", T.order_hash(seed, F.col("line"))).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    cut, left = "", n
    for r in keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("bucket").collect():
        cut = r["bucket"]
        if left <= r["n"]:
            break
        left -= r["n"]
    last = keyed.filter(F.col("bucket") == cut).orderBy("h", "line", "doc_id", "pos").limit(left)
    return keyed.filter(F.col("bucket") < cut).unionByName(last).drop("h", "bucket")


def threshold_of(df: DataFrame) -> DataFrame:
    """The lowest score kept, 0 if nothing is."""
    return df.agg(F.coalesce(F.min("score"), F.lit(0.0)).alias("threshold"))


def mixture_of(df: DataFrame, total: int) -> DataFrame:
    """Lines and tokens per corpus against the target."""
    got = df.groupBy("corpus").agg(F.count(F.lit(1)).alias("lines"), F.sum("n_tokens").cast("long").alias("tokens"))
    return target_table(df, total).join(got, "corpus", "left").select("corpus", "target", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def seeded_places(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with place, from 1, in the order ``h`` then ``order``, bucket by bucket of the leading digits of ``h``."""
    keyed = df.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    # at most 4096 buckets
    before = counts.select("bucket", (F.sum("c").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"))
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("h", *order)) + F.col("before")
    return keyed.join(F.broadcast(before), "bucket").withColumn("place", at).drop("bucket", "before")


def sample_of(df: DataFrame, k: int, key: Column, order: list[str], seed: int = 42) -> DataFrame:
    """At most k rows, the first in seeded order of ``key``, then ``order``.

    Each task keeps its k first rows, and these are merged: nothing is sorted
    or shuffled whole.
    """
    return df.withColumn("h", T.order_hash(seed, key)).orderBy("h", *order).limit(k).drop("h")


def hash_split(df: DataFrame, column: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """``df`` with split: the first floor(n * share) rows in seeded order are train, the rest validation."""
    n = df.count()
    head = int(n * share)
    placed = seeded_places(df.withColumn("h", T.order_hash(seed, F.col(column))), df.columns)
    return placed.withColumn("split", F.when(F.col("place") <= head, "train").otherwise("validation")).drop("h", "place")
