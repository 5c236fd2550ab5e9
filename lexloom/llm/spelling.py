"""Operator 12: spelling variants by a symmetric-delete join.

Words are taken from the texts and counted. Every word emits itself and its
distinct single deletions, as 64-bit hashes of their code points, so a word of
n letters costs n + 1 rows of fixed size whatever its length. Words that share
a key are candidates; their texts are joined back and verified: the distance
has to be exactly one insertion, deletion or replacement. Candidates that only
share a hash, or differ by a moved letter, go there.

A word's form is the near word with the largest count (the smallest in
code-point order among equals), if that is at least ``RATIO`` times the word's
own; else it has none. Roots follow forms by pointer doubling: a round joins
roots to their roots, and a chain of forms, whose counts grow by ``RATIO`` at
each step, has at most 19 links, so five rounds end it.

A key is shared by words that have one letter more at some place, at most the
alphabet's size times the key's length; that bound, not the number of rows,
limits a key's pairs. Counts are added before they are shuffled, so a frequent
word is one row per task. Every join is a merge of two shuffled sides: tables of
words are a small part of their size as files, so what looks small enough to be
broadcast is not, and the driver holds none of them.

Null texts have no words; a null doc_id is written as nothing before the colon.
Empty texts have no words; a very long run is one word, whole. Repeated rows
count each. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.text import mix64, powers
from lexloom.session import ship, written

#: Runs of letters, and the rule by which some occurrences lose a letter.
RUN, UPPER, LOWER = "[A-Za-zÀ-ÿ]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGE = 31
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10


def counted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word and n: distinct words that are long and frequent enough."""
    # shorter runs can make no word; a match starts at a run's first letter, as letters before it would belong to it
    long = RUN[:-1] + f"{{{LEAST_LENGTH},}}"
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("of"), F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(long), F.lit(0))).alias("run"))
    runs = runs.select("of", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("of", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % DAMAGE == 0, less).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def keys_of(word: str) -> np.ndarray:
    """Hashes of the word and of its distinct single deletions, in time linear in its length."""
    codes = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(codes)
    up, _ = powers(n + 1)
    with np.errstate(over="ignore"):
        front = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * up[:n], out=front[1:])
        # what stands behind a deleted letter moves one place to the front
        behind = np.zeros(n, np.uint64)
        behind[:-1] = np.cumsum((codes[1:] * up[: n - 1])[::-1])[::-1]
        # deletions from a run of one letter are equal: the first one counts
        distinct = np.ones(n, bool)
        distinct[1:] = codes[1:] != codes[:-1]
        return mix64(np.concatenate([front[-1:], (front[:-1] + behind)[distinct]]))


KEYS = pa.schema([("id", pa.int64()), ("key", pa.int64())])


def keyed(words: DataFrame) -> DataFrame:
    """id and key: a row for each word's own key and each of its deletions."""
    ship(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            keys = [keys_of(w) for w in words]
            sizes = [len(k) for k in keys]
            if sizes:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate(keys).view(np.int64))], schema=KEYS)

    return words.select("id", "word").mapInArrow(run, "id long, key long")


def near_pairs(words: DataFrame) -> DataFrame:
    """Both orders of the pairs of words at distance one: a, b (ids), word and n of b.

    ``words`` has id (unique), word and n.
    """
    keys = keyed(words)
    left, right = keys.select(F.col("id").alias("a"), "key"), keys.select(F.col("id").alias("b"), "key")
    candidates = left.join(right.hint("merge"), "key").filter("a < b").select("a", "b").distinct()
    one = words.select(F.col("id").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a"))
    two = words.select(F.col("id").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b"))
    close = candidates.join(one.hint("merge"), "a").join(two.hint("merge"), "b").filter(F.levenshtein("word_a", "word_b", 1) == 1)
    both = F.array(
        F.struct("a", "b", F.col("word_b").alias("word"), F.col("n_b").alias("n")),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("word_a").alias("word"), F.col("n_a").alias("n")),
    )
    return close.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """id and root of the words that have a form; ``forms`` has id and root, the form's id."""
    state = written(forms.select("id", "root"), "spelling-roots")
    while True:
        # words without a form are their own roots and so have no row to go on to
        ahead = state.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = written(state.join(ahead.hint("merge"), "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        state = moved.select("id", "root")
        if moved.filter("moved").isEmpty():
            return state


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = written(written(counted(docs, text, doc_id), "spelling-counts").withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    # smallest by (-n, word): the largest count, the first word among equals
    best = near_pairs(words).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), "word", "b")).alias("best"))
    close = written(words.join(best.hint("merge"), "id", "left").withColumn("takes", F.coalesce(-F.col("best.m") >= ratio * F.col("n"), F.lit(False))), "spelling-near")
    found = roots(close.filter("takes").select("id", F.col("best.b").alias("root")))
    names = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    named = found.join(names.hint("merge"), "root").select("id", "root_word")
    return close.join(named.hint("merge"), "id", "left").select(
        "word",
        F.when(F.col("takes"), F.col("best.word")).alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("takes"), -F.col("best.m")).alias("form_n"),
    )
