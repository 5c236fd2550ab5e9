"""Queries that write files into the shared folder and read them back, and shapes of training data over all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexloom.functions import morphology as M
from lexloom.functions import rules as R
from lexloom.functions import text as X
from lexloom.operators import minpair, report, training
from lexloom.plans import catalogue as Q
from lexloom.plans import inputs as I
from lexloom.plans import pipeline
from lexloom.plans.catalogue import query
from lexloom.session import shared_dir, written
from lexloom.sources import corpora, sinks

#: Corpora that ``corpus_files`` writes; the reader has to skip the one that is missing.
WRITTEN = R.CORPORA[:-1]
#: Subsets that ``pair_files`` writes, in turn into the folder and its data folder.
SUBSETS = R.SUBSETS[:4]


def folder(spark) -> str:
    return f"{shared_dir(spark)}/lexloom/files-{uuid.uuid4().hex}"


def values(rows, names: str) -> str:
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


@query(f"WITH {I.LINES} SELECT corpus, line, count(*) AS n FROM lines WHERE corpus <> '{R.CORPORA[-1]}' GROUP BY ALL")
def corpus_files(spark, d):
    """Text files of all corpora but one, read back as lines."""
    at, lines = folder(spark), I.lines(spark, d)
    for c in WRITTEN:
        sinks.write_lines(lines.filter(F.col("corpus") == c), f"{at}/{c}.train")
    return corpora.read_corpora(spark, at).groupBy("corpus", "line").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {I.LINES} SELECT doc_id, pos, line FROM lines ORDER BY doc_id, pos LIMIT 5000")
def first_lines_scan(spark, d):
    return corpora.first_lines(I.lines(spark, d)).select("doc_id", "pos", "line")


@query(f"WITH {I.LINES}, k AS (SELECT doc_id, pos, trim(line) AS line FROM lines WHERE length(trim(line)) > 10) SELECT doc_id, pos, line FROM k ORDER BY md5('42|' || line), doc_id, pos LIMIT 10000")
def natural_sample(spark, d):
    return corpora.natural_lines(I.lines(spark, d))


@query(f"WITH {I.LINES}, k AS (SELECT doc_id, pos, trim(line) AS line FROM lines WHERE length(trim(line)) > 10) SELECT doc_id, pos, line FROM k ORDER BY md5('42|' || line), doc_id, pos LIMIT 500")
def natural_sample_cut(spark, d):
    """The seeded sample where it cuts at every size."""
    return corpora.natural_lines(I.lines(spark, d), 500)


@query(f"WITH {I.PAIRS} SELECT subset, sentence_good, sentence_bad, count(*) AS n FROM pairs WHERE subset IN ({', '.join(f"'{s}'" for s in SUBSETS)}) GROUP BY ALL")
def pair_files(spark, d):
    """JSON lines of four subsets, half of them in the fallback folder; all other subsets' files are missing and have to be skipped."""
    at, pairs = folder(spark), I.pairs(spark, d)
    for i, s in enumerate(SUBSETS):
        sinks.records_json(pairs.filter(F.col("subset") == s).select("sentence_good", "sentence_bad"), f"{at}/{'data/' * (i % 2)}{s}.jsonl")
    return corpora.read_pairs(spark, at).groupBy("subset", "sentence_good", "sentence_bad").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {I.PAIRS} SELECT sentence_good AS good_sentence, sentence_bad AS bad_sentence, CASE WHEN pair_id % 2 = 0 THEN subset ELSE 'unknown' END AS category, count(*) AS n
FROM pairs WHERE pair_id % 5 < 4 GROUP BY ALL"""
)
def training_pair_files(spark, d):
    """JSON lines of both shapes and of rows without a bad side, read back in one shape."""
    k, path = F.col("pair_id") % 5, f"{folder(spark)}/pairs.jsonl"
    raw = I.pairs(spark, d).select(
        F.when(k < 2, F.col("sentence_good")).alias("correct"),
        F.when(k < 2, F.col("sentence_bad")).alias("incorrect"),
        F.when(k >= 2, F.col("sentence_good")).alias("good_sentence"),
        F.when((k >= 2) & (k < 4), F.col("sentence_bad")).alias("bad_sentence"),
        F.when(F.col("pair_id") % 2 == 0, F.col("subset")).alias("category"),
    )
    sinks.records_json(raw, path)
    return corpora.read_training_pairs(spark, path).groupBy("good_sentence", "bad_sentence", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {I.PAIRS}, s AS (SELECT pair_id, subset, CASE WHEN row_number() OVER (ORDER BY md5('42|' || sentence_good), subset, pair_id) <= floor(count(*) OVER () * CAST(0.9 AS DOUBLE))
  THEN 'train' ELSE 'validation' END AS split FROM pairs) SELECT split, subset, pair_id FROM s"""
)
def split_files(spark, d):
    """A folder of JSON lines for each split."""
    path = f"{folder(spark)}/splits"
    sinks.write_splits(Q.curate.hash_split(I.pairs(spark, d), "sentence_good").select("split", "subset", "pair_id"), path)
    return spark.read.schema("subset string, pair_id long, split string").json(path).select("split", "subset", "pair_id")


@query(
    f"""WITH {I.PAIRS}, k AS (SELECT CASE WHEN pair_id % 2 = 0 THEN 'even' ELSE 'odd' END AS folder, pair_id % 7 = 0 AS broken, pair_id % 5 = 4 AS malformed FROM pairs)
SELECT folder, count(*) AS rows, count(*) FILTER (broken) AS broken, count(*) FILTER (NOT broken AND malformed) AS malformed, count(*) FILTER (NOT broken AND NOT malformed) AS pairs FROM k GROUP BY folder"""
)
def pair_file_counts(spark, d):
    """Pair files in which some rows break off and some lack the bad side: what is read and what is not, per folder."""
    at, pairs = folder(spark), I.pairs(spark, d)
    k = F.col("pair_id")
    row = F.to_json(F.struct(F.col("sentence_good").alias("correct"), F.when(k % 5 < 4, F.col("sentence_bad")).alias("incorrect")))
    lines = pairs.select("pair_id", F.when(k % 7 == 0, F.concat(F.lit("{"), F.substring(row, F.lit(2), F.length(row) - 2), F.lit('"'))).otherwise(row).alias("line"))
    for rest, name in enumerate(("even", "odd")):
        sinks.write_lines(lines.filter(k % 2 == rest), f"{at}/{name}.jsonl")
    each = [corpora.pair_file_report(spark, f"{at}/{name}.jsonl").select(F.lit(name).alias("folder"), "rows", "broken", "malformed", "pairs") for name in ("even", "odd")]
    return each[0].unionByName(each[1])


_LONGEST = {k: Q._sql_affix("low", v, k == "prefix", 0) for k, v in (("prefix", R.PREFIXES), ("suffix", R.SUFFIXES))}


@query(f"WITH {Q._WORDS}, l AS (SELECT lower(word) AS low FROM words), f AS ({' UNION ALL '.join(f"SELECT '{k}' AS kind, {v} AS affix FROM l" for k, v in _LONGEST.items())}) SELECT kind, affix, count(*) AS n FROM f WHERE affix <> '' GROUP BY ALL")
def rule_file(spark, d):
    """Distinct words by the longest prefix and suffix of a rule file; a missing file has none."""
    at = folder(spark)
    sinks.write_document(spark, {"prefixes": list(R.PREFIXES), "suffixes": list(R.SUFFIXES), "morpheme_marker": R.MARKER}, f"{at}/config.json")
    found = dict(zip(("prefix", "suffix"), corpora.read_rules(spark, corpora.first_existing(spark, f"{at}/none.json", f"{at}/config.json")), strict=False))
    missing, _, _ = corpora.read_rules(spark, f"{at}/none.json")
    low = F.lower("word")
    each = F.array(*[F.struct(F.lit(k).alias("kind"), M.longest_affix(low, v + missing, k == "prefix").alias("affix")) for k, v in found.items()])
    rows = Q._words(spark, d).select(F.inline(each)).filter("affix <> ''")
    return rows.groupBy("kind", "affix").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {I.LINES}, w AS (SELECT unnest({I.toks('line')}) AS piece FROM lines), c AS (SELECT piece, count(*) AS n FROM w GROUP BY piece),
v AS (SELECT row_number() OVER (ORDER BY n DESC, piece) - 1 AS id, piece FROM c)
SELECT id, piece, round(CAST(-id AS DOUBLE), 6) + 0.0 AS score, CASE WHEN piece IN ({', '.join(f"'{x}'" for x in [*R.SPECIALS_MARKED, *R.SPECIALS_PLAIN])}) THEN 'special'
  WHEN regexp_matches(piece, '^<0x[0-9A-F]{{2}}>$') THEN 'byte' WHEN piece IN ('[MASK]', '{R.MARKER}') THEN 'user' ELSE 'learned' END AS kind FROM v"""
)
def vocab_file(spark, d):
    """The lines' words by falling count as a vocabulary file with ranks as scores, read back with the class of each piece."""
    words = I.lines(spark, d).select(F.explode(X.tokens(F.col("line"))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    ranked = corpora.numbered(words.withColumn("down", -F.col("n")), "down", "piece").select(F.col("n").alias("id"), "piece", (-F.col("n")).cast("double").alias("score"))
    path = f"{folder(spark)}/tokenizer.vocab"
    sinks.write_vocab(ranked, path)
    return corpora.read_vocab(spark, path)


_LONG = " UNION ALL ".join(f"SELECT subset, '{m}' AS metric, round({m}, 6) + 0.0 AS value FROM acc" for m in R.METRICS)


@query(f"WITH {I.ACCURACY} {_LONG} UNION ALL SELECT subset || ' flat', 'accuracy', round(bpb, 6) + 0.0 FROM acc UNION ALL SELECT subset || ' wrapped', 'accuracy', round(bpc, 6) + 0.0 FROM acc")
def result_files(spark, d):
    """Result files of the three shapes, one reader for all."""
    at = folder(spark)
    rows = [r.asDict() for r in Q._accuracy(spark, d).collect()]  # as many as there are subsets
    nested = {"subsets": {r["subset"]: {m: r[m] for m in R.METRICS} for r in rows}, "averages": {}}
    flat, wrapped = ({f"{r['subset']} {n}": r[m] for r in rows} for n, m in (("flat", "bpb"), ("wrapped", "bpc")))
    out = None
    one_row = sinks.results_json(spark.createDataFrame(list(flat.items()), "subset string, accuracy double"))
    sinks.write_lines(one_row, f"{at}/flat.json", "json", single_file=True)
    for name, value in (("nested", nested), ("flat", None), ("wrapped", {"results": wrapped})):
        if value is not None:
            sinks.write_document(spark, value, f"{at}/{name}.json")
        one = corpora.read_results(spark, f"{at}/{name}.json")
        out = one if out is None else out.unionByName(one)
    return out


@query(Q.ORACLES["vocab_sweep"])
def sweep_file(spark, d):
    """Records of the vocabulary sweep in one document, read back."""
    at = f"{folder(spark)}/sweep.json"
    sinks.write_document(spark, [r.asDict() for r in Q.QUERIES["vocab_sweep"](spark, d).collect()], at)
    return corpora.read_sweep(spark, at)


@query(f"WITH {I.ACCURACY} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(round(avg({m}), 4), 6) + 0.0 AS value FROM acc" for m in R.METRICS))
def printed_averages(spark, d):
    """Averages scraped from captured output; what stands before the heading is ignored."""
    row = minpair.macro_average(Q._accuracy(spark, d)).select(
        F.concat(
            F.lit("Loading: 3\nAverage Accuracies:\n"),
            *[F.concat(F.lit(f"  {m}: "), F.format_string("%.4f", F.round(m, 4)), F.lit("\n")) for m in R.METRICS],
        ).alias("value")
    )
    return corpora.scrape_averages(row)


@query(Q.ORACLES["imbalance_pairs"])
def imbalance_file(spark, d):
    """Pair details as JSON records, read back."""
    path = f"{folder(spark)}/imbalance.json"
    sinks.records_json(Q._imbalance(spark, d).select("subset", "pair_id", "category", "delta", "abs_delta"), path)
    return spark.read.schema("subset string, pair_id long, category string, delta long, abs_delta long").json(path)


_CELLS = "tokens_per_1k_chars avg_tokens_per_word morph_align sum mean bpc bpb".split()


@query(f"WITH b AS ({Q.ORACLES['benchmark_table']}) SELECT '| ' || model || ' | ' || {' || chr(32) || chr(124) || chr(32) || '.join(_CELLS)} || ' |' AS line FROM b UNION ALL SELECT '| model | {' | '.join(_CELLS)} |' UNION ALL SELECT '| {' | '.join(['---'] * 8)} |'")
def benchmark_markdown(spark, d):
    """The benchmark table as a Markdown file, read back by line."""
    path = f"{folder(spark)}/table.md"
    rows = report.benchmark_table(Q._models(spark, d), Q._tokenizers(spark, d)).select("model", *_CELLS).collect()  # one per model
    sinks.write_lines(spark.createDataFrame([(sinks.markdown(["model", *_CELLS], [tuple(r) for r in rows]),)], "line string"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


_PHASES = dict(zip(sinks.phase_names(Q.TARGET, Q.TOP, Q.SAMPLE).items(), ("kept2", "top3", "p4"), strict=True))


@query(f"WITH {Q._NEAREST} " + " UNION ALL ".join(f"SELECT '{p}' AS phase, '{n}' AS name, count(*) AS lines FROM {t}" for (p, n), t in _PHASES.items()))
def phase_files(spark, d):
    """The phases' files by the names that follow from the sizes asked for, and their lines as they are found after writing."""
    at = folder(spark)
    names = sinks.phase_names(Q.TARGET, Q.TOP, Q.SAMPLE)
    full = written(Q._full(spark, d), "full")
    best = written(Q.curate.top_fraction(written(Q.curate.scored(full), "scored"), Q.TOP), "top")
    for rows, name in zip((full, best, Q.curate.nearest_prefix(best, Q.SAMPLE)), names.values(), strict=True):
        sinks.write_lines(rows, f"{at}/{name}")
    found = corpora.present(spark, {p: f"{at}/{n}" for p, n in names.items()})
    out = None
    for phase, path in found.items():
        one = spark.read.text(path).agg(F.count(F.lit(1)).alias("lines")).select(F.lit(phase).alias("phase"), F.lit(path.rsplit("/", 1)[1]).alias("name"), "lines")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {I.PHASE1} SELECT corpus, count(*) AS input_lines, CAST(sum(n_in) AS BIGINT) AS input_tokens, CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS output_lines FROM p1 GROUP BY corpus")
def cleaning_report_file(spark, d):
    """Phase 1 of the pipeline's report document, read back."""
    path = f"{folder(spark)}/cleaning_report"
    sinks.write_document(spark, pipeline.run(I.lines(spark, d), Q.TARGET, Q.TOP, Q.SAMPLE)["report"], path)
    rows = "array<struct<corpus:string,input_lines:long,input_tokens:long,output_lines:long>>"
    return spark.read.text(path, wholetext=True).select(F.inline(F.from_json(F.get_json_object("value", "$.phases.phase1.stats"), rows)))


@query(f"WITH {Q._FIGURES} SELECT tokenizer, {Q.r6('compression_ratio', 'tokens_per_1000_chars', 'avg_tokens_per_word')} FROM toks_")
def tokenizer_report_file(spark, d):
    """A report document per tokenizer, read back."""
    at = folder(spark)
    out = None
    for r in Q._tokenizers(spark, d).collect():  # one row per tokenizer
        sinks.write_document(spark, {k: r[k] for k in ("tokenizer", "compression_ratio", "tokens_per_1000_chars", "avg_tokens_per_word")}, f"{at}/{r['tokenizer']}.json")
        one = corpora.read_tokenizer_report(spark, f"{at}/{r['tokenizer']}.json").select("tokenizer", "compression_ratio", "tokens_per_1000_chars", "avg_tokens_per_word")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH {Q._IDS}, f AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM ids), o AS (SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS o FROM f)
SELECT CAST(floor(o / 64) AS BIGINT) AS block, count(*) AS n, CAST(sum((o % 64 + 1) * id) AS BIGINT) AS mark FROM o GROUP BY 1"""
)
def packed_blocks(spark, d):
    """Ids of all documents laid end to end in blocks of 64."""
    out = training.packed(Q._id_rows(spark, d))
    return out.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("pos") + 1) * F.col("id")).alias("mark"))


@query(
    f"""WITH {I.PAIRS}, w AS (SELECT subset, pair_id, side, list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x: length(x)) AS n FROM sides),
m AS (SELECT *, max(len(n)) OVER (PARTITION BY subset) AS width FROM w)
SELECT subset, pair_id, side, round(CAST(list_sum(n) AS DOUBLE) / width, 6) + 0.0 AS score FROM m"""
)
def pseudo_likelihood(spark, d):
    """Sentence scores from one loss per masked position (here the length of its word), over the width of the subset."""
    words = minpair.sides(I.pairs(spark, d)).withColumn("w", F.filter(F.split("text", " "), lambda x: x != ""))
    width = words.groupBy("subset").agg(F.max(F.size("w")).alias("width"))
    masked = words.select("subset", "pair_id", "side", F.posexplode("w").alias("mask_pos", "x")).withColumn("token_nll", F.array(F.length("x").cast("double")))
    return minpair.pseudo_log_likelihood(masked.join(F.broadcast(width), "subset"))


@query(f"WITH {I.ACCURACY} SELECT {', '.join(f'round(avg({m}), 6) + 0.0 AS {m}' for m in R.METRICS)} FROM acc")
def averages_fallback(spark, d):
    """Averages of a result without any, from its rows."""
    return report.with_averages(Q._accuracy(spark, d), R.METRICS)


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 500")
def first_rows(spark, d):
    return training.first_rows(I.table(spark, d, "documents").select("doc_id", "text"), 500, "doc_id")


@query(f"WITH {Q._NEAREST} SELECT row_number() OVER (ORDER BY h, corpus, doc_id, pos) AS place, line FROM p4")
def final_files(spark, d):
    """The lines of the last phase as they stand in its files, read in the order of the files' names."""
    path = f"{folder(spark)}/final"
    sinks.write_ordered(Q._phase4(spark, d), path, "h", "corpus", "doc_id", "pos")
    return corpora.numbered(corpora.read_lines(spark, path), "doc_id", "pos").select((F.col("n") + 1).alias("place"), "line")


@query(f"WITH {Q._NEAREST} SELECT corpus, doc_id, pos, row_number() OVER (ORDER BY h, corpus, doc_id, pos) AS place FROM p4")
def final_order(spark, d):
    """The place of every line of the last phase in the seeded order in which it is written."""
    from lexloom.operators.curate import seeded_places

    return seeded_places(Q._phase4(spark, d), ["corpus", "doc_id", "pos"]).select("corpus", "doc_id", "pos", "place")
