"""Minimal-pair evaluation: scoring, the four metrics, accuracies, sweeps, imbalance."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from lexloom.functions import rules as R
from lexloom.functions import text as T
from lexloom.operators.tokenize import KNOWN, SPACE, Vocabulary
from lexloom.session import ship, slices

LN2 = math.log(2)
LN256 = math.log(256)
METRICS = R.METRICS
SIZES = ("n_tokens", "n_chars", "n_bytes")
#: Steps of a logarithm's first part, and bytes of text in a block of the bigram model.
UNIT, BLOCK = 1 << 22, 8 << 20


class Scorer(Protocol):
    """Stands in for a model: one list of token losses for each text."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def uniform_scorer(texts: list[str]) -> list[list[float]]:
    """ln 256 for each white-space token."""
    return [[LN256] * len(t.split()) for t in texts]


def sides(pairs: DataFrame) -> DataFrame:
    """Long form: subset, pair_id, side and text."""
    return pairs.select(
        "subset",
        "pair_id",
        F.explode(F.create_map(F.lit("good"), "sentence_good", F.lit("bad"), "sentence_bad")).alias("side", "text"),
    )


def score(long: DataFrame, scorer: Scorer) -> DataFrame:
    """``long`` with token_nll from an Arrow-batched scorer."""
    ship(long.sparkSession)
    at = long.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            losses = scorer([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(losses, pa.list_(pa.float64()))], names=[*batch.schema.names, "token_nll"])

    return long.mapInArrow(run, StructType([*long.schema, StructField("token_nll", ArrayType(DoubleType()))]))


def masked(losses: Column, labels: Column, ignore: int = -100) -> Column:
    """Losses whose label is not the ignored one."""
    return F.transform(F.filter(F.arrays_zip(losses.alias("l"), labels.alias("y")), lambda x: x["y"] != ignore), lambda x: x["l"])


def sentence_scores(scored: DataFrame) -> DataFrame:
    """Per side: summed log-probability, number of labels, characters and bytes."""
    return scored.select(
        "subset",
        "pair_id",
        "side",
        (-F.aggregate("token_nll", F.lit(0.0), lambda a, x: a + x)).alias("lp"),
        F.size("token_nll").alias("n_tokens"),
        F.length("text").alias("n_chars"),
        F.octet_length("text").alias("n_bytes"),
    )


def rows_of(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows for :func:`bigram_wide` where pairs and corpus are different tables; ``at`` tells equal texts of the corpus apart."""
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    return pairs.select("subset", "pair_id", "sentence_good", "sentence_bad", *none("text"), F.lit(None).cast("long").alias("at")).unionByName(
        corpus.select(
            *none("subset"), F.lit(None).cast(pairs.schema["pair_id"].dataType).alias("pair_id"), *none("sentence_good", "sentence_bad"), "text", F.monotonically_increasing_id().alias("at")
        )
    )


def packed(numbers: np.ndarray) -> bytes:
    """First bytes of all numbers, then all second ones and so on, which compresses well where they are sorted or small."""
    return numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)


@dataclass
class Bigrams:
    """The words of a block's texts: ``words`` are sorted, everything else has places in it.

    ``corpus``, ``good`` and ``bad`` have the word before, the word and the row
    of each word; rows whose good side is the corpus text (``same``) have no
    words of their own in ``good``.
    """

    words: pa.Array
    corpus: np.ndarray
    good: np.ndarray
    bad: np.ndarray
    same: np.ndarray

    @classmethod
    def of(cls, texts: pa.Table) -> Bigrams:
        text, good, bad = (pc.replace_substring(texts.column(c).combine_chunks().cast(pa.large_string()), "\n", " ") for c in ("text", "sentence_good", "sentence_bad"))
        same = pc.fill_null(pc.equal(text, good), False)
        lists = [pc.split_pattern(c, " ") for c in (text, pc.if_else(same, pa.scalar(None, pa.large_string()), good), bad)]
        found, row = [c.flatten() for c in lists], [pc.list_parent_indices(c).to_numpy() for c in lists]
        kept = [pc.greater(pc.binary_length(c), 0) for c in found]
        coded = pa.concat_arrays([pa.array(["<s>"], pa.large_string()), *(c.filter(k) for c, k in zip(found, kept, strict=True))]).dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        at, out, start = place[coded.indices.to_numpy()], [], 1
        for r, k in zip(row, kept, strict=True):
            r = r[k.to_numpy(zero_copy_only=False)]
            word = at[start : start + len(r)]
            before = np.concatenate([at[:1], word[:-1]])[: len(r)]
            before[np.flatnonzero(r[1:] != r[:-1]) + 1] = at[0]
            out.append(np.stack([before, word, r]))
            start += len(r)
        return cls(coded.dictionary.take(order), *out, same.to_numpy(zero_copy_only=False))

    def parts(self, n: int) -> list[np.ndarray]:
        """Places of the words that fall to each of ``n`` parts."""
        return parted(np.fromiter((zlib.crc32(w.encode()) for w in self.words.to_pylist()), np.int64, len(self.words)) % n, n)

    def numbers(self, answers: dict[int, tuple[bytes, bytes]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number and how often a word follows it, from the answers of the ``n`` parts."""
        number, followed = np.zeros((2, len(self.words)), np.int64)
        for part, places in enumerate(self.parts(n)):
            if len(places):
                number[places], followed[places] = map(unpacked, answers[part])
        return number, followed

    def terms(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block's distinct bigrams as numbers, and for each word of ``corpus``, ``good`` and ``bad`` together its place in them."""
        before, word, _ = np.concatenate([self.corpus, self.good, self.bad], axis=1)
        return np.unique(number[before] << 32 | number[word], return_inverse=True)


def parted(of: np.ndarray, n: int) -> list[np.ndarray]:
    """Places of 0 to n - 1 in ``of``, each in order."""
    return np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=n))[:-1])


def term_parts(terms: np.ndarray, n: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        mixed = terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return parted((mixed >> np.uint64(32)).astype(np.int64) % n, n)


ASKED = "part int, block int, keys binary, counts binary"
ANSWERED = "block int, part int, first binary, second binary"


def block_words(docs: DataFrame, n: int) -> DataFrame:
    """For each block and part its distinct words, and how often the corpus has them and has a word behind them."""

    def run(table: pa.Table) -> pa.Table:
        b, out = Bigrams.of(table), []
        said, followed = (np.bincount(b.corpus[k], minlength=len(b.words)) for k in (1, 0))
        for part, places in enumerate(b.parts(n)):
            if len(places):
                out.append((part, table["block"][0].as_py(), "\n".join(b.words.take(pa.array(places)).to_pylist()).encode(), packed(np.concatenate([said[places], followed[places]]))))
        return rows_table(out, ASKED)

    return docs.groupBy("block").applyInArrow(run, ASKED)


def word_numbers(words: DataFrame, n: int) -> DataFrame:
    """Answers for :meth:`Bigrams.numbers`, frequent words have small numbers; ``fresh`` adds up to the number of the corpus's distinct words."""

    def run(table: pa.Table) -> pa.Table:
        lists = pc.split_pattern(table["keys"].combine_chunks().cast(pa.large_string()), "\n")
        coded = lists.flatten().dictionary_encode()
        at, size = coded.indices.to_numpy(), len(coded.dictionary)
        counts = np.concatenate([unpacked(c).reshape(2, -1) for c in table["counts"].to_pylist()], axis=1)
        said, followed = (np.bincount(at, c, size).astype(np.int64) for c in counts)
        name = np.empty(size, np.int64)
        name[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(size)
        number = np.empty(size, np.int64)
        number[np.lexsort((name, -said))] = np.arange(size)
        ends, part, out = lists.offsets.to_numpy(), table["part"][0].as_py(), []
        for k, block in enumerate(table["block"].to_pylist()):
            here = at[ends[k] - ends[0] : ends[k + 1] - ends[0]]
            out.append((block, part, packed(number[here] * n + part), packed(followed[here]), 0 if k else int((said > 0).sum())))
        return rows_table(out, ANSWERED + ", fresh long")

    return words.groupBy("part").applyInArrow(run, ANSWERED + ", fresh long")


def block_terms(docs: DataFrame, numbers: DataFrame, n: int) -> DataFrame:
    """For each block and part its distinct bigrams as numbers, and how often the corpus has them."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        b, out = Bigrams.of(table), []
        terms, at = b.terms(b.numbers(answers_of(answers), n)[0])
        counts = np.bincount(at[: b.corpus.shape[1]], minlength=len(terms))
        for part, places in enumerate(term_parts(terms, n)):
            if len(places):
                out.append((part, table["block"][0].as_py(), packed(terms[places]), packed(counts[places])))
        return rows_table(out, ASKED)

    return docs.groupBy("block").cogroup(numbers.groupBy("block")).applyInArrow(run, ASKED)


def term_totals(terms: DataFrame, n: int) -> DataFrame:
    """How often the whole corpus has each block's bigrams; parts are counted from ``n`` on."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = ([unpacked(x) for x in table[c].to_pylist()] for c in ("keys", "counts"))
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts)).astype(np.int64)[at]
        each = np.split(total, np.cumsum([len(k) for k in keys])[:-1])
        return rows_table([(block, n + part, packed(t), b"") for block, part, t in zip(table["block"].to_pylist(), table["part"].to_pylist(), each, strict=True)], ANSWERED)

    return terms.groupBy("part").applyInArrow(run, ANSWERED)


def answers_of(table: pa.Table) -> dict[int, tuple[bytes, bytes]]:
    return {r["part"]: (r["first"], r["second"]) for r in table.select(["part", "first", "second"]).to_pylist()}


def rows_table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [f.split() for f in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def block_sums(docs: DataFrame, answers: DataFrame, n: int) -> DataFrame:
    """Per row of a pair the sums of both sides' log-probabilities, in two parts, and their sizes; ``docs`` has v, the number of distinct words."""
    keys = docs.select("subset", "pair_id").schema
    sums = [f"{part}_{side}" for side in ("good", "bad") for part in ("high", "low")]
    sizes = [f"{v}_{side}" for side in ("good", "bad") for v in SIZES]

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        b, found = Bigrams.of(table), answers_of(answers)
        number, followed = b.numbers(found, n)
        terms, at = b.terms(number)
        total = np.zeros(len(terms), np.int64)
        for part, places in enumerate(term_parts(terms, n)):
            if len(places):
                total[places] = unpacked(found[n + part][0])
        edge = np.cumsum([b.corpus.shape[1], b.good.shape[1]])
        seen = dict(zip(("corpus", "good", "bad"), np.split(at, edge), strict=True))
        up, down = np.log(total + 1.0) * UNIT, -np.log(followed + float(table["v"][0].as_py() if table.num_rows else 1)) * UNIT

        def added(side: str) -> list[np.ndarray]:
            before, _, row = getattr(b, side)
            out = [np.bincount(row, minlength=table.num_rows)]
            for x, k in ((up, seen[side]), (down, before)):
                high = np.floor(x)
                out += [np.bincount(row, v[k], table.num_rows) for v in (high, np.round((x - high) * UNIT))]
            return [out[0], out[1] + out[3], out[2] + out[4]]

        whole, columns = added("corpus"), {}
        for side in ("good", "bad"):
            text = table[f"sentence_{side}"].combine_chunks()
            none = pc.is_null(text).to_numpy(zero_copy_only=False)
            n_tokens, high, low = (np.where(b.same, w, x) if side == "good" else x for w, x in zip(whole, added(side), strict=True))
            for name, x, kind in (("high", high, pa.int64()), ("low", low, pa.int64()), ("n_tokens", n_tokens, pa.int32())):
                # sums of whole numbers below 2^53
                columns[f"{name}_{side}"] = pa.array(x.astype(np.int64), kind, mask=none)
            columns[f"n_chars_{side}"], columns[f"n_bytes_{side}"] = pc.utf8_length(text).cast(pa.int32()), pc.binary_length(text).cast(pa.int32())
        out = pa.table([table["subset"], table["pair_id"], *(columns[c] for c in (*sums, *sizes))], names=["subset", "pair_id", *sums, *sizes])
        return out.filter(pc.or_(pc.is_valid(table["sentence_good"]), pc.is_valid(table["sentence_bad"])))

    schema = StructType([*keys, *(StructField(c, LongType()) for c in sums), *(StructField(c, IntegerType()) for c in sizes)])
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def bigram_wide(rows: DataFrame, build: Callable[[DataFrame], DataFrame] | None = None, block: int = BLOCK) -> DataFrame:
    """One row per pair with both sides' scores under an add-one bigram model of the words of ``rows.text``.

    ``rows`` has subset, pair_id, sentence_good, sentence_bad and text, each of
    which may be null: a row can be a pair, a text of the corpus, or both; or
    ``build`` makes these columns from what it has and keeps ``block``. The
    first word follows <s>. A bigram's log-probability is ln(c + 1) less
    ln(cp + v), so all that a row needs are counts of its bigrams and words.

    Texts are dealt into blocks of about ``block`` bytes, and only they are shuffled whole.
    A block asks for its distinct words, and gets each word's number and how
    often something follows it; then for its distinct bigrams, now pairs of
    numbers, and gets how often the corpus has them. Words and bigrams are dealt
    into parts, so a frequent one is a single entry of each block; no model
    leaves the executors. Sums are of whole numbers (2^-44 each), so they do
    not depend on the order, and sides of the same terms tie.
    """
    ship(rows.sparkSession)
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in rows.schema if isinstance(f.dataType, StringType)]
    size = rows.agg(F.sum(sum(texts[1:], texts[0]))).first()[0] or 0
    blocks = size // block + 1
    n = blocks // 2 + 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)).cast("int")).repartition("block")
    docs = (build(dealt) if build else dealt).select("block", "subset", "pair_id", "text", "sentence_good", "sentence_bad")
    numbers = word_numbers(block_words(docs, n), n)
    answers = numbers.drop("fresh")
    totals = term_totals(block_terms(docs, answers, n), n)
    v = numbers.agg(F.coalesce(F.sum("fresh"), F.lit(0)).alias("v"))
    scores = block_sums(docs.join(F.broadcast(v), F.lit(True)), answers.unionByName(totals), n)
    sides_ = ("good", "bad")
    both = scores.groupBy("subset", "pair_id").agg(
        *[F.sum(f"{part}_{s}").alias(f"{part}_{s}") for s in sides_ for part in ("high", "low")],
        *[(F.sum if name == "n_tokens" else F.max)(f"{name}_{s}").cast("int").alias(f"{name}_{s}") for s in sides_ for name in SIZES],
    )
    lp = lambda side: F.when(F.col(f"n_tokens_{side}") > 0, F.col(f"high_{side}") / UNIT + F.col(f"low_{side}") / (UNIT * UNIT)).alias(f"lp_{side}")
    return both.select("subset", "pair_id", *[c for side in sides_ for c in (lp(side), *(F.col(f"{v}_{side}") for v in SIZES))])


def tall(pairs: DataFrame) -> DataFrame:
    """Side scores from rows with both sides; the reverse of :func:`wide`."""
    side = lambda s: F.struct(F.lit(s).alias("side"), *[F.col(f"{v}_{s}").alias(v) for v in ("lp", *SIZES)])
    return pairs.select("subset", "pair_id", F.inline(F.array(side("good"), side("bad")))).filter("n_chars IS NOT NULL")


def bigram_scores(long: DataFrame, corpus: DataFrame) -> DataFrame:
    """Side scores under an add-one bigram model of the words of ``corpus.text``; see :func:`bigram_wide`."""
    pick = lambda s: F.when(F.col("side") == s, F.col("text")).alias(f"sentence_{s}")
    # a text that is null is there, without words
    sides_ = long.withColumn("text", F.coalesce("text", F.lit("")))
    return tall(bigram_wide(rows_of(sides_.select("subset", "pair_id", pick("good"), pick("bad")), corpus)))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \n]+"), lambda x: x != "")


def token_counts(pairs: DataFrame) -> DataFrame:
    """Words of both sides of each pair."""
    return pairs.select("subset", "pair_id", *[F.size(_words(F.col(f"sentence_{s}"))).alias(f"n_tokens_{s}") for s in ("good", "bad")])


def wide(side_scores: DataFrame) -> DataFrame:
    """One row per pair with both sides."""
    values = ["lp", *SIZES]
    pick = lambda side, v: F.max(F.when(F.col("side") == side, F.col(v))).alias(f"{v}_{side}")
    return side_scores.groupBy("subset", "pair_id").agg(*[pick(s, v) for s in ("good", "bad") for v in values])


def metric_values(side: str) -> dict[str, Column]:
    """The four scores of a side; null where there is nothing to divide by."""
    lp, n = F.col(f"lp_{side}"), lambda v: F.nullif(F.col(f"{v}_{side}"), F.lit(0))
    return {
        "raw_log_prob": lp,
        "normalized_log_prob": lp / n("n_tokens"),
        "bpc": -lp / (LN2 * n("n_chars")),
        "bpb": -lp / (LN2 * n("n_bytes")),
    }


def pair_metrics(pairs: DataFrame) -> DataFrame:
    """Both scores and the verdict of each metric; ties and missing scores are wrong."""
    good, bad = metric_values("good"), metric_values("bad")
    better = lambda m: good[m] > bad[m] if m.endswith("log_prob") else good[m] < bad[m]
    return pairs.select(
        *pairs.columns,
        *[good[m].alias(f"{m}_good") for m in METRICS],
        *[bad[m].alias(f"{m}_bad") for m in METRICS],
        *[F.coalesce(better(m), F.lit(False)).alias(f"{m}_correct") for m in METRICS],
    )


def mean_nll_correct(pairs: DataFrame) -> DataFrame:
    """Pairs whose good side has the lower mean loss per token."""
    good, bad = metric_values("good")["normalized_log_prob"], metric_values("bad")["normalized_log_prob"]
    return pairs.withColumn("correct", F.coalesce(-good < -bad, F.lit(False)))


def subset_accuracy(metrics: DataFrame, by: tuple[str, ...] = ("subset",)) -> DataFrame:
    """Share of right pairs per subset and metric."""
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"), *[F.avg(F.col(f"{m}_correct").cast("double")).alias(m) for m in METRICS]
    )


def macro_average(accuracy: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Unweighted mean over subsets."""
    aggs = [F.avg(m).alias(m) for m in METRICS]
    return accuracy.groupBy(*by).agg(*aggs) if by else accuracy.agg(*aggs)


def sweep(pairs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Macro accuracy per vocabulary size: log-probabilities stay, token counts change.

    ``lengths`` has vocab_size, subset, pair_id, n_tokens_good and n_tokens_bad.
    """
    joined = pairs.drop("n_tokens_good", "n_tokens_bad").join(lengths, ["subset", "pair_id"])
    return macro_average(subset_accuracy(pair_metrics(joined), ("vocab_size", "subset")), ("vocab_size",)).orderBy("vocab_size")


def cut_lengths(long: DataFrame, vocab: Vocabulary, cuts: list[int]) -> DataFrame:
    """vocab_size, subset, pair_id and the tokens of both sides under the first merges of a model, for each cut.

    Each distinct word of a block of texts is encoded once, whatever the number
    of cuts, and no word is shuffled. A task remembers words, of ``KNOWN`` letters together at most.
    """
    spark = long.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known, letters = sent.value, {}, 0
        for batch in slices(batches, 3, 1 << 20):
            texts = [[w for w in re.split("[ \n]+", t or "") if w] for t in batch.column(3).to_pylist()]
            number: dict[str, int] = {}
            at = np.array([number.setdefault(w, len(number)) for words in texts for w in words], np.int64)
            each = np.zeros((len(number), len(cuts)), np.int64)
            for word, i in number.items():
                found = known.get(word)
                if found is None:
                    found = v.cut_counts(SPACE + word, cuts)
                    letters += len(word)
                    if letters > KNOWN:
                        known.clear()
                        letters = len(word)
                    known[word] = found
                each[i] = found
            said = np.array([len(words) for words in texts], np.int64)
            some = np.flatnonzero(said)
            ends = np.cumsum(said)[some]
            sums = np.add.reduceat(each[at], ends - said[some], axis=0) if len(some) else each[:0]
            counts = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * len(cuts), pa.int32()), pa.array(sums.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(some)) for k in range(3)], counts], names=["subset", "pair_id", "side", "counts"])

    rows = long.select("subset", "pair_id", "side", "text")
    counted = rows.mapInArrow(run, StructType([*rows.schema[:3], StructField("counts", ArrayType(LongType()))]))
    both = [(s, k, F.coalesce(F.sum(F.when(F.col("side") == s, F.col("counts")[k])), F.lit(0)).alias(f"{s}{k}")) for s in ("good", "bad") for k in range(len(cuts))]
    sums = counted.groupBy("subset", "pair_id").agg(*[c for _, _, c in both])
    out = F.array(*[F.struct(F.lit(c).alias("vocab_size"), F.col(f"good{k}").alias("n_tokens_good"), F.col(f"bad{k}").alias("n_tokens_bad")) for k, c in enumerate(cuts)])
    return sums.select("subset", "pair_id", F.inline(out)).select("vocab_size", "subset", "pair_id", "n_tokens_good", "n_tokens_bad")


def category(subset: Column) -> Column:
    """Linguistic category of a subset name, null for the others."""
    return F.when(subset.contains("wh_") | subset.contains("wh-"), "wh-movement").when(subset.contains("agreement"), "agreement").when(subset.contains("npi"), "NPIs")


def imbalance(metrics: DataFrame) -> DataFrame:
    """Difference in tokens of each pair, with its category."""
    delta = F.col("n_tokens_good") - F.col("n_tokens_bad")
    return metrics.withColumn("delta", delta).withColumn("abs_delta", F.abs(delta)).withColumn("category", category(F.col("subset")))


def long_errors(pairs: DataFrame) -> DataFrame:
    """One row per pair and metric: abs_delta and error."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), (~F.col(f"{m}_correct")).cast("double").alias("error")) for m in METRICS])
    return pairs.select("subset", "pair_id", "category", "abs_delta", F.inline(each))


def correlation(errors: DataFrame, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Pearson r of token difference and error, 0 without variance, and its two-sided p."""
    x, y = F.col("abs_delta").cast("double"), F.col("error")
    r = F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    out = errors.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(r, F.lit(0.0)).alias("r"))
    return T.once(out, p=p_column(F.col("r"), F.col("n")))


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of positive numbers: Stirling's series eight steps further on."""
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(1.0), lambda a, k: a * (x + k))
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def p_column(r: Column, n: Column) -> Column:
    """Two-sided p of Pearson's r over n rows, for aggregated rows.

    The t-distribution by the regularised incomplete beta function, whose
    continued fraction is evaluated from its end; its terms needed grow with the
    root of n.
    """
    x, a = 1 - r * r, (n - 2) / 2
    swap = x > (a + 1) / (a + 2.5)
    one, two, at = F.when(swap, F.lit(0.5)).otherwise(a), F.when(swap, a).otherwise(F.lit(0.5)), F.when(swap, r * r).otherwise(x)
    bound = F.struct(one.alias("a"), two.alias("b"), at.alias("x"))

    def beta(v: Column) -> Column:
        a, b, x = v["a"], v["b"], v["x"]
        terms = F.sequence((F.lit(64) + 4 * F.sqrt(a + b)).cast("int"), F.lit(1), F.lit(-1))

        def term(k: Column) -> Column:
            m = F.floor(k / 2)
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            return F.when(k % 2 == 0, even).otherwise(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

        fraction = F.aggregate(terms, F.lit(1.0), lambda f, k: 1 + term(k) / f)
        front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.log(x) + b * F.log1p(-x)) / a
        return front / fraction

    inside = T.let(bound, beta)
    whole = F.when(swap, 1 - inside).otherwise(inside)
    return F.when((n < 3) | (r == 0), F.lit(1.0)).when(F.abs(r) >= 1, F.lit(0.0)).otherwise(whole)


def p_value(r: float, n: int) -> float:
    """Two-sided p of Pearson's r: t-distribution by the regularised incomplete beta function."""
    if n < 3 or r == 0:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + n * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + n / (c if abs(c) > tiny else tiny)
            h *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * h


def bins(errors: DataFrame) -> DataFrame:
    """Accuracy by token difference 0, 1, 2, 3, 4+; empty bins are zeros."""
    spark = errors.sparkSession
    base = spark.createDataFrame([(m, b) for m in METRICS for b in range(5)], "metric string, bin int")
    got = errors.groupBy("metric", F.least("abs_delta", F.lit(4)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.avg("error").alias("e"))
    label = F.when(F.col("bin") == 4, "4+").otherwise(F.col("bin").cast("string"))
    return F.broadcast(base).join(got, ["metric", "bin"], "left").select(
        "metric",
        label.alias("bin"),
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce(1 - F.col("e"), F.lit(0.0)).alias("accuracy"),
        F.coalesce("e", F.lit(0.0)).alias("error_rate"),
    )


def error_by_delta(errors: DataFrame) -> DataFrame:
    """Error rate per token difference."""
    return errors.groupBy("metric", "abs_delta").agg(F.count(F.lit(1)).alias("count"), F.avg("error").alias("error_rate"))


def error_trend(by_delta: DataFrame) -> DataFrame:
    """Least-squares line through the error rates; slope 0 through a single difference."""
    x, y = F.col("abs_delta").cast("double"), F.col("error_rate")
    slope = F.coalesce(F.covar_pop(x, y) / F.nullif(F.var_pop(x), F.lit(0.0)), F.lit(0.0))
    return by_delta.groupBy("metric").agg(slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"))


def gap_rank(accuracy: DataFrame) -> DataFrame:
    """Difference of bpb and per-token accuracy by subset, with both rankings."""
    # rounded, so that equal accuracies tie whatever their last bits
    gap = accuracy.select("subset", F.round(F.col("bpb") - F.col("normalized_log_prob"), 9).alias("gap"))
    # at most as many rows as there are subsets
    return gap.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gap"), "subset"))).withColumn(
        "abs_rank", F.row_number().over(Window.orderBy(F.desc(F.abs("gap")), "subset"))
    )


def margin_loss(pairs: DataFrame, margin: float = 0.5, weight: float = 0.3) -> DataFrame:
    """Mean hinge of the score margin, mean loss, and their weighted total."""
    hinge = F.greatest(F.lit(0.0), margin - (F.col("lp_good") - F.col("lp_bad")))
    ce = -F.col("lp_good") / F.nullif(F.col("n_tokens_good"), F.lit(0))
    return pairs.agg(F.avg(hinge).alias("margin"), F.avg(ce).alias("ce")).withColumn("total", F.col("ce") + weight * F.col("margin"))


def preference(pairs: DataFrame) -> DataFrame:
    """How often the good side scores higher."""
    won = F.sum(F.when(F.col("lp_good") > F.col("lp_bad"), 1).otherwise(0)).cast("long")
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), won.alias("preferred")).withColumn("percent", F.col("preferred") / F.nullif(F.col("pairs"), F.lit(0)) * 100)


def pseudo_log_likelihood(masked_losses: DataFrame) -> DataFrame:
    """Encoder score: the losses of all positions under every single mask, summed per sentence, per position of the padded width.

    ``masked_losses`` has subset, pair_id, side, mask_pos, token_nll and width.
    """
    total = F.aggregate("token_nll", F.lit(0.0), lambda a, x: a + x)
    return masked_losses.groupBy("subset", "pair_id", "side").agg((F.sum(total) / F.nullif(F.max("width"), F.lit(0))).alias("score"))
