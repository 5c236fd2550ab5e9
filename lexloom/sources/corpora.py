"""Readers: text corpora, minimal pairs, vocabularies, rule and result files."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import rules as R
from lexloom.session import written

LOG = logging.getLogger(__name__)
PAIR = T.StructType([T.StructField(n, T.StringType()) for n in ("sentence_good", "sentence_bad")])
RAW_PAIR = T.StructType([T.StructField(n, T.StringType()) for n in ("correct", "incorrect", "good_sentence", "bad_sentence", "category")])
FLAT, METRIC = T.MapType(T.StringType(), T.DoubleType()), T.StructType([T.StructField(m, T.DoubleType()) for m in R.METRICS])
NESTED = T.StructType([T.StructField("subsets", T.MapType(T.StringType(), METRIC)), T.StructField("averages", METRIC)])
SWEEP = T.ArrayType(T.StructType([T.StructField("vocab_size", T.IntegerType()), *METRIC.fields]))
TOKENIZER = T.StructType(
    [T.StructField("tokenizer", T.StringType()), T.StructField("vocab_size", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in ("compression_ratio", "tokens_per_1000_chars", "avg_tokens_per_word", "morph_alignment_score")]
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def present(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """The paths that exist; others are logged and skipped."""
    found = {}
    for name, path in paths.items():
        if exists(spark, path):
            found[name] = path
        else:
            LOG.warning("skipping %s: %s not found", name, path)
    return found


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, as a fallback chain."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(paths[-1])


def lines_from_documents(docs: DataFrame, modulo: int = len(R.CORPORA)) -> DataFrame:
    """corpus, doc_id, pos and line: texts split at line feeds; the corpus follows the number in ``source``."""
    number = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(0)) % modulo
    corpus = F.element_at(F.array(*[F.lit(c) for c in R.CORPORA]), number + 1)
    return docs.select(corpus.alias("corpus"), "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, pos and line of a text file or a folder of them, in the order of their names and of their lines.

    ``doc_id`` is the file's place among the names. ``pos`` rises within a file:
    the byte at which the row's split starts plus the row's place in its task.
    A line has a byte at least, and a task that reads a split of full size reads
    nothing else, so rows of a split come before those of the next one whatever
    task reads them.
    """
    rows = spark.read.text(path)
    # both sides name files without an authority as scheme:/ or scheme:///
    plain = lambda c: F.regexp_replace(c, "^([^:/]+):/+", "$1:/")
    place = spark.createDataFrame(list(enumerate(sorted(rows.inputFiles()))), "doc_id long, file string").withColumn("file", plain("file"))
    at = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # one row per file
    return rows.select(plain(F.col("_metadata.file_path")).alias("file"), at.alias("pos"), F.col("value").alias("line")).join(F.broadcast(place), "file").select("doc_id", "pos", "line")


def read_corpora(spark: SparkSession, folder: str, suffix: str = ".train") -> DataFrame:
    """Corpus text files, or folders of part files, as lines in file order; missing corpora are skipped with a warning."""
    parts = None
    for name, path in present(spark, {c: f"{folder}/{c}{suffix}" for c in R.CORPORA}).items():
        one = read_lines(spark, path).select(F.lit(name).alias("corpus"), "doc_id", "pos", "line")
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return spark.createDataFrame([], "corpus string, doc_id long, pos long, line string")
    return parts


def first_lines(lines: DataFrame, n: int = 5000) -> DataFrame:
    """The first n lines in (doc_id, pos) order."""
    return lines.orderBy("doc_id", "pos").limit(n)


def read_pairs(spark: SparkSession, folder: str, subsets: list[str] | None = None) -> DataFrame:
    """subset, pair_id, sentence_good, sentence_bad; looks in ``folder``, then in ``folder``/data; missing subsets are skipped."""
    paths = {}
    for s in subsets or R.SUBSETS:
        for path in (f"{folder}/{s}.jsonl", f"{folder}/data/{s}.jsonl"):
            if exists(spark, path):
                paths[s] = path
                break
        else:
            LOG.warning("skipping subset %s", s)
    if not paths:
        return spark.createDataFrame([], "subset string, pair_id long, sentence_good string, sentence_bad string")
    rows = spark.read.schema(PAIR).json(list(paths.values()))
    return rows.select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl(?:/[^/]*)?$", 1).alias("subset"), F.monotonically_increasing_id().alias("pair_id"), "sentence_good", "sentence_bad"
    )


def normalise_pairs(rows: DataFrame) -> DataFrame:
    """Training pairs of both shapes as good_sentence, bad_sentence, category; malformed rows go."""
    names = set(rows.columns)
    get = lambda n: F.col(n) if n in names else F.lit(None).cast("string")
    first = get("correct").isNotNull() & get("incorrect").isNotNull()
    second = get("good_sentence").isNotNull() & get("bad_sentence").isNotNull()
    return rows.filter(first | second).select(
        F.when(first, get("correct")).otherwise(get("good_sentence")).alias("good_sentence"),
        F.when(first, get("incorrect")).otherwise(get("bad_sentence")).alias("bad_sentence"),
        F.coalesce(get("category"), F.lit("unknown")).alias("category"),
    )


def raw_training_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of pair files with what could not be parsed, whole, in ``broken``."""
    schema = T.StructType([*RAW_PAIR.fields, T.StructField("broken", T.StringType())])
    return spark.read.schema(schema).json(path, multiLine=not path.endswith(".jsonl"), columnNameOfCorruptRecord="broken")


def read_training_pairs(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or one JSON array in files that are not .jsonl; broken and malformed rows go."""
    return normalise_pairs(raw_training_pairs(spark, path))


def pair_file_report(spark: SparkSession, path: str) -> DataFrame:
    """Per folder of pair files: rows, broken ones, malformed ones and those that are read."""
    rows = raw_training_pairs(spark, path).select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1).alias("folder"))
    has = lambda one, two: F.col(one).isNotNull() & F.col(two).isNotNull()
    broken, whole = F.col("broken").isNotNull(), has("correct", "incorrect") | has("good_sentence", "bad_sentence")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return rows.groupBy("folder").agg(
        F.count(F.lit(1)).alias("rows"), count(broken).alias("broken"), count(~broken & ~whole).alias("malformed"), count(~broken & whole).alias("pairs")
    )


def natural_lines(lines: DataFrame, max_lines: int = 10_000, seed: int = 42) -> DataFrame:
    """Lines of more than ten characters, at most ``max_lines`` in seeded order."""
    from lexloom.functions import text as X

    kept = lines.select("doc_id", "pos", F.trim("line").alias("line")).filter(F.length("line") > 10)
    return kept.orderBy(X.order_hash(seed, F.col("line")), "doc_id", "pos").limit(max_lines)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """id, piece, score and kind of a TAB-separated vocabulary; ids follow the lines of one file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("id", "row"))
    piece = F.substring_index("row", "\t", 1)
    return with_kind(rows.select("id", piece.alias("piece"), F.substring_index("row", "\t", -1).cast("double").alias("score")))


def with_kind(vocab: DataFrame) -> DataFrame:
    """Class of each piece: special, byte, user or learned."""
    specials = [*R.SPECIALS_MARKED, *R.SPECIALS_PLAIN]
    return vocab.withColumn(
        "kind",
        F.when(F.col("piece").isin(specials), "special").when(F.col("piece").rlike(r"^<0x[0-9A-F]{2}>$"), "byte").when(F.col("piece").isin("[MASK]", R.MARKER), "user").otherwise("learned"),
    )


def read_rules(spark: SparkSession, path: str) -> tuple[list[str], list[str], str]:
    """Prefixes, suffixes (longest first) and marker of a rule file; nothing but the marker if it is missing."""
    if not exists(spark, path):
        return [], [], R.MARKER
    raw = json.loads(spark.read.text(path, wholetext=True).first()[0])
    order = lambda key: sorted(raw.get(key, []), key=len, reverse=True)
    return order("prefixes"), order("suffixes"), raw.get("morpheme_marker", R.MARKER)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """subset, metric and value of a result file of any of the three shapes."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    nested = raw.select(F.from_json("v", NESTED).alias("r")).select(F.explode("r.subsets").alias("subset", "m"))
    long = nested.select("subset", F.explode(F.create_map(*[x for m in R.METRICS for x in (F.lit(m), F.col(f"m.{m}"))])).alias("metric", "value"))
    wrapped = raw.select(F.explode(F.from_json(F.get_json_object("v", "$.results"), FLAT)).alias("subset", "value"))
    flat = raw.filter(F.get_json_object("v", "$.results").isNull() & F.get_json_object("v", "$.subsets").isNull()).select(
        F.explode(F.from_json("v", FLAT)).alias("subset", "value")
    )
    single = wrapped.unionByName(flat).select("subset", F.lit("accuracy").alias("metric"), "value")
    return long.unionByName(single).filter("value IS NOT NULL")


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """Records of a vocabulary sweep."""
    return spark.read.text(path, wholetext=True).select(F.inline(F.from_json("value", SWEEP)))


def read_tokenizer_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENIZER).json(path, multiLine=True)


def scrape_averages(output: DataFrame, column: str = "value") -> DataFrame:
    """metric and value of the lines after 'Average Accuracies:' of captured output; other lines are ignored.

    ``output`` has one captured output per row.
    """
    tail = F.regexp_extract(column, r"(?s)Average Accuracies:(.*)", 1)
    row = output.select(F.explode(F.split(tail, "\n")).alias("row"))
    out = row.select(F.trim(F.substring_index("row", ":", 1)).alias("metric"), F.trim(F.substring_index("row", ":", -1)).try_cast("double").alias("value"))
    return out.filter(F.col("value").isNotNull() & (F.col("metric") != ""))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with n, the row numbers from 0 over a total order.

    Ranges of rows are numbered each from the rows before it, so no task sees
    them all.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    # one row per range
    before = counts.select("range", (F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("before"))
    at = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(before), "range").withColumn("n", at + F.col("before")).drop("range", "before")
