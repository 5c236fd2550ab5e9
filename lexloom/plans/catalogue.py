"""Named queries over the driver tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import cleaners as C
from lexloom.functions import morphology as M
from lexloom.functions import rules as R
from lexloom.functions import text as X
from lexloom.operators import curate, minpair, neardup, report, tokenize, training
from lexloom.plans import inputs as I
from lexloom.session import written
from lexloom.sources import corpora

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The curation command line's budgets of tokens and its share of best lines.
TARGET, SAMPLE, TOP = 10_000_000, 1_000_000, 0.70
#: Merges and pieces of the trained vocabularies, of those that only feed another query, and cuts of the sweep.
MERGES, PIECES, SOME_MERGES, SOME_PIECES = 5_000, 5_000, 1_000, 2_000
CUTS = [100, 200, 400, 600, 800, 1_000]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def put(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return longs(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def longs(df: DataFrame) -> DataFrame:
    """32-bit integers as 64-bit ones, doubles to six places: what both engines agree on."""
    out = []
    for c in df.schema:
        col = F.col(f"`{c.name}`")
        if isinstance(c.dataType, T.IntegerType):
            col = col.cast("long")
        elif isinstance(c.dataType, T.DoubleType):
            col = F.round(col, 6) + 0.0
        out.append(col.alias(c.name))
    return df.select(*out)


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n.split('.')[-1]}" for n in names)


# ---------------------------------------------------------------- scans and projections


@query(f"WITH {I.LINES} SELECT corpus, doc_id, pos, line FROM lines")
def lines_scan(spark, d):
    return I.lines(spark, d)


@query(f"WITH {I.LINES} SELECT doc_id, pos, {I.norm('line')} AS norm FROM lines")
def normalize_ws(spark, d):
    return I.lines(spark, d).select("doc_id", "pos", X.normalize_ws(F.col("line")).alias("norm"))


@query(f"WITH {I.LINES} SELECT doc_id, pos, CAST(len({I.toks('line')}) AS BIGINT) AS n_tokens, CAST(length(line) AS BIGINT) AS n_chars, CAST(strlen(line) AS BIGINT) AS n_bytes, sha256(line) AS h FROM lines")
def token_counts(spark, d):
    x = F.col("line")
    return I.lines(spark, d).select(
        "doc_id", "pos", X.count_tokens(x).alias("n_tokens"), F.length(x).alias("n_chars"), F.octet_length(x).alias("n_bytes"), X.line_hash(x).alias("h")
    )


def _cleaner(name: str, corpus: str) -> None:
    def run(spark, d):
        norm = X.normalize_ws(F.col("line"))
        return I.lines(spark, d).select("doc_id", "pos", C.CLEANERS[corpus](norm).alias("clean"))

    run.__name__ = name
    query(f"WITH {I.LINES}, n AS (SELECT *, {I.norm('line')} AS norm FROM lines) SELECT doc_id, pos, {I.CLEAN[corpus]} AS clean FROM n")(run)


for _name, _corpus in (
    ("clean_bnc", "bnc_spoken"),
    ("clean_childes", "childes"),
    ("clean_gutenberg", "gutenberg"),
    ("clean_subtitles", "open_subtitles"),
    ("clean_wiki", "simple_wiki"),
    ("clean_switchboard", "switchboard"),
):
    _cleaner(_name, _corpus)


@query(f"WITH {I.LINES} SELECT doc_id, pos, regexp_replace(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}_\\s]+', ''), '[^\\p{{L}}\\p{{N}}_\\s]+$', '') AS word FROM (SELECT doc_id, pos, {I.toks('line')}[1] AS w FROM lines) WHERE w IS NOT NULL")
def strip_edges(spark, d):
    w = F.get(X.tokens(F.col("line")), 0)
    return I.lines(spark, d).select("doc_id", "pos", w.alias("w")).filter("w IS NOT NULL").select("doc_id", "pos", X.strip_edges(F.col("w")).alias("word"))


@query()
def read_vocab_classes(spark, d):
    """Piece classes of a vocabulary trained on the documents' words."""
    return tokenize.vocab_classes(tokenize.train_bpe(I.lines(spark, d), SOME_MERGES))


@query("SELECT conv_id, CAST(turn AS BIGINT) AS turn, array_to_string(list_filter([role, text], lambda x: x IS NOT NULL), ' ') AS joined, coalesce(CAST(text AS VARCHAR), '') AS body FROM conversations")
def field_concat(spark, d):
    t = I.table(spark, d, "conversations")
    return t.select("conv_id", "turn", X.joined_fields(F.col("role"), F.col("text")).alias("joined"), X.text_or_empty(F.col("text")).alias("body"))


# ---------------------------------------------------------------- phase 1


@query(f"WITH {I.PHASE1} SELECT corpus, doc_id, pos, clean, reason FROM p1")
def phase1_reasons(spark, d):
    return curate.phase1(I.lines(spark, d)).select("corpus", "doc_id", "pos", "clean", "reason")


@query(
    f"""WITH {I.PHASE1} SELECT corpus, count(*) AS input_lines, CAST(sum(n_in) AS BIGINT) AS input_tokens,
  CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS output_lines, CAST(coalesce(sum(n_out) FILTER (reason IS NULL), 0) AS BIGINT) AS output_tokens FROM p1 GROUP BY corpus"""
)
def phase1_stats(spark, d):
    return curate.phase1_stats(I.lines(spark, d))


@query(f"WITH {I.PHASE1} SELECT corpus, reason, count(*) AS n FROM p1 WHERE reason IS NOT NULL GROUP BY ALL")
def phase1_removed(spark, d):
    return curate.phase1_reasons(I.lines(spark, d))


@query(f"WITH {I.LINES} SELECT doc_id, pos, round(length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) / length(line), 6) + 0.0 AS ratio FROM lines WHERE length(line) > 0 AND length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) / length(line) >= 0.6")
def alpha_filter(spark, d):
    return I.lines(spark, d).select("doc_id", "pos", X.alpha_ratio(F.col("line")).alias("ratio")).filter(F.col("ratio") >= R.MIN_ALPHA)


@query(f"WITH {I.LINES} SELECT doc_id, pos, line FROM lines WHERE length(line) BETWEEN 10 AND 500")
def length_filter(spark, d):
    return I.lines(spark, d).filter(F.length("line").between(R.MIN_CHARS, R.MAX_CHARS)).select("doc_id", "pos", "line")


@query(f"WITH {I.LINES} SELECT corpus, doc_id, pos, line FROM lines QUALIFY row_number() OVER (PARTITION BY corpus, line ORDER BY doc_id, pos) = 1")
def exact_dedup_corpus(spark, d):
    keyed = I.lines(spark, d).withColumn("h", X.line_hash(F.col("line")))
    return curate.keep_first(keyed, ["corpus", "h"], ["doc_id", "pos"]).drop("h")


@query(f"WITH {I.LINES} SELECT corpus, doc_id, pos, line FROM lines QUALIFY row_number() OVER (PARTITION BY line ORDER BY list_position({I._CORPORA}, corpus), doc_id, pos) = 1")
def exact_dedup_global(spark, d):
    keyed = I.lines(spark, d).withColumn("h", X.line_hash(F.col("line"))).withColumn("cr", curate.corpus_rank(F.col("corpus")))
    return curate.keep_first(keyed, ["h"], ["cr", "doc_id", "pos"]).drop("h", "cr")


# ---------------------------------------------------------------- phase 2


@query(f"WITH {I.LINES} SELECT doc_id, pos FROM lines WHERE {I.URL}")
def url_filter(spark, d):
    return I.lines(spark, d).filter(X.has_url(F.col("line"))).select("doc_id", "pos")


@query(f"WITH {I.LINES} SELECT doc_id, pos, round({I.CODE}, 6) + 0.0 AS share FROM lines WHERE {I.CODE} > 0.10")
def code_filter(spark, d):
    return I.lines(spark, d).select("doc_id", "pos", X.code_share(F.col("line")).alias("share")).filter(F.col("share") > R.CODE_SHARE)


@query(f"WITH {I.LINES} SELECT doc_id, pos, round({I.TABLE}, 6) + 0.0 AS share FROM lines WHERE {I.TABLE} > 0.30")
def table_filter(spark, d):
    return I.lines(spark, d).select("doc_id", "pos", X.table_share(F.col("line")).alias("share")).filter(F.col("share") > R.TABLE_SHARE)


@query(f"WITH {I.LINES}, n AS (SELECT CAST(sum(len({I.toks('line')})) AS BIGINT) AS n FROM lines) SELECT corpus, CAST(floor(n * CAST(share AS DOUBLE)) AS BIGINT) AS target FROM n, {I.SHARES}")
def mixture_targets(spark, d):
    """Each corpus's share of as many tokens as all lines have."""
    lines = I.lines(spark, d)
    return curate.target_table(lines, lines.agg(F.sum(X.count_tokens(F.col("line")))).first()[0] or 0)


@query(f"WITH {I.PHASE1}, {I.sampled(TARGET)} SELECT corpus, doc_id, pos, n_tokens, cum FROM s1 WHERE total <= target OR cum <= target")
def budget_prefix(spark, d):
    return curate.budget_prefix(_kept(spark, d), TARGET).select("corpus", "doc_id", "pos", "n_tokens", "cum")


@query(f"WITH {I.PHASE1}, {I.sampled_share(8)} SELECT corpus, doc_id, pos, n_tokens, cum FROM s1 WHERE total <= target OR cum <= target")
def budget_prefix_cut(spark, d):
    """The sample under a budget of an eighth of the table's own tokens, which every corpus exceeds."""
    kept = _kept(spark, d)
    return curate.budget_prefix(kept, _tokens(kept) // 8).select("corpus", "doc_id", "pos", "n_tokens", "cum")


@query(f"WITH {I.PHASE1}, {I.sampled_share(8)} SELECT corpus, doc_id, pos, n_tokens FROM s1 WHERE cum <= target OR (cum - n_tokens <= target AND cum > target AND cum - target < target - (cum - n_tokens))")
def nearest_prefix_cut(spark, d):
    """The nearest sample under that budget."""
    kept = _kept(spark, d)
    return curate.nearest_prefix(kept, _tokens(kept) // 8).select("corpus", "doc_id", "pos", "n_tokens")


def _tokens(lines) -> int:
    return lines.agg(F.sum("n_tokens")).first()[0] or 0


@query(f"WITH {I.phase2(TARGET)} SELECT corpus, doc_id, pos, reason FROM p2")
def phase2_reasons(spark, d):
    return _phase2(spark, d).select("corpus", "doc_id", "pos", "reason")


@query(
    f"""WITH {I.phase2(TARGET)} SELECT corpus, count(*) AS input_lines, CAST(sum(n_tokens) AS BIGINT) AS input_tokens,
  CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS output_lines, CAST(coalesce(sum(n_tokens) FILTER (reason IS NULL), 0) AS BIGINT) AS output_tokens FROM p2 GROUP BY corpus"""
)
def phase2_stats(spark, d):
    return curate.stats(_phase2(spark, d))


def _kept(spark, d):
    """Phase boundaries are written once, as the sampling after them reads them twice."""
    return written(curate.kept(curate.phase1(I.lines(spark, d))), "kept1")


def _phase2(spark, d):
    return curate.phase2(_kept(spark, d), TARGET)


def _full(spark, d):
    return _phase2(spark, d).filter("reason IS NULL").select("corpus", "doc_id", "pos", "line", "n_tokens")


def _scored(spark, d):
    return written(curate.scored(_full(spark, d)), "scored")


# ---------------------------------------------------------------- phases 3 and 4


@query(f"WITH {I.scored(TARGET)} SELECT corpus, doc_id, pos, score + 0.0 AS score FROM p3")
def quality_score(spark, d):
    return curate.scored(_full(spark, d)).select("corpus", "doc_id", "pos", "score")


@query(f"WITH {I.scored(TARGET)} SELECT (CAST(floor(score / 10) AS BIGINT) * 10) || '-' || (CAST(floor(score / 10) AS BIGINT) * 10 + 9) AS bucket, count(*) AS n FROM p3 GROUP BY 1")
def quality_histogram(spark, d):
    return curate.histogram(curate.scored(_full(spark, d)))


@query(f"WITH {I.top(TARGET, TOP)} SELECT corpus, doc_id, pos, score + 0.0 AS score FROM top3")
def top_fraction(spark, d):
    return curate.top_fraction(_scored(spark, d), TOP).select("corpus", "doc_id", "pos", "score")


@query(f"WITH {I.top(TARGET, TOP)} SELECT coalesce(min(score), 0.0) + 0.0 AS threshold FROM top3")
def quality_threshold(spark, d):
    return curate.threshold_of(curate.top_fraction(_scored(spark, d), TOP))


_NEAREST = f"""{I.top(TARGET, TOP)}, {I.sampled(SAMPLE, 'top3', 's4')},
p4 AS (SELECT * FROM s4 WHERE cum <= target OR (cum - n_tokens <= target AND cum > target AND cum - target < target - (cum - n_tokens)))"""


@query(f"WITH {_NEAREST} SELECT corpus, doc_id, pos, n_tokens FROM p4")
def nearest_prefix(spark, d):
    return _phase4(spark, d).select("corpus", "doc_id", "pos", "n_tokens")


def _phase4(spark, d):
    return curate.nearest_prefix(written(curate.top_fraction(_scored(spark, d), TOP), "top"), SAMPLE)


@query(f"WITH {_NEAREST} SELECT t.corpus, t.target, count(p.line) AS lines, CAST(coalesce(sum(p.n_tokens), 0) AS BIGINT) AS tokens FROM s4t t LEFT JOIN p4 p USING (corpus) GROUP BY t.corpus, t.target")
def nearest_prefix_mixture(spark, d):
    return curate.mixture_of(_phase4(spark, d), SAMPLE)


@query(
    f"""WITH {I.phase2(TARGET)} SELECT count(*) AS input_lines, CAST(sum(n_in) AS BIGINT) AS input_tokens, count(*) FILTER (reason IS NULL) AS output_lines,
  CAST(sum(n_out) FILTER (reason IS NULL) AS BIGINT) AS output_tokens, (SELECT count(*) FROM kept2) AS phase2_lines,
  printf('%.2f%%', round((SELECT count(*) FROM kept2) / count(*) * 100, 2)) AS retention FROM p1"""
)
def cleaning_summary(spark, d):
    one = written(curate.phase1(I.lines(spark, d)), "phase1")
    return report.summary(curate.stats(one), curate.phase2(curate.kept(one), TARGET).filter("reason IS NULL").count())


# ---------------------------------------------------------------- morphology


def _sql_affix(word: str, affixes: list[str], front: bool, spare: int) -> str:
    f = "starts_with" if front else "ends_with"
    return "CASE " + " ".join(f"WHEN {f}({word}, '{a}') AND length({word}) > {len(a) + spare} THEN '{a}'" for a in M.longest_first(affixes)) + " ELSE '' END"


_WORDS = f"{I.LINES}, words AS (SELECT DISTINCT unnest({I.toks('line')}) AS word FROM lines)"
_MARKED = f"""{_WORDS},
m1 AS (SELECT word, lower(word) AS low, {_sql_affix('lower(word)', R.PREFIXES, True, 2)} AS p FROM words),
m2 AS (SELECT *, low[length(p) + 1:] AS rest FROM m1),
m3 AS (SELECT *, {_sql_affix('rest', R.SUFFIXES + R.INFLECTIONS, False, 2)} AS s FROM m2),
marked AS (SELECT word, CASE WHEN length(word) <= 3 THEN word ELSE CASE WHEN p <> '' THEN p || '@@' ELSE '' END || rest[1:length(rest) - length(s)]
  || CASE WHEN s <> '' THEN '@@' || s ELSE '' END END AS parts FROM m3)"""
_PLAIN = f"""{_WORDS},
q0 AS (SELECT word, lower(regexp_replace(regexp_replace(word, '^[^\\p{{L}}\\p{{N}}_\\s]+', ''), '[^\\p{{L}}\\p{{N}}_\\s]+$', '')) AS low FROM words),
q1 AS (SELECT *, {_sql_affix('low', R.PREFIXES, True, 0)} AS p FROM q0),
q2 AS (SELECT *, low[length(p) + 1:] AS rest FROM q1),
q3 AS (SELECT *, {_sql_affix('rest', R.SUFFIXES + R.INFLECTIONS, False, 0)} AS s FROM q2),
plain AS (SELECT word, CASE WHEN word LIKE '*%' OR word LIKE '[%' OR word = '...' OR low = '' THEN word
  ELSE array_to_string(list_filter([p, rest[1:length(rest) - length(s)], s], lambda x: x <> ''), ' ') END AS parts FROM q3)"""


def _words(spark, d):
    return I.lines(spark, d).select(F.explode(X.tokens(F.col("line"))).alias("word")).distinct()


@query(f"WITH {_MARKED} SELECT word, parts FROM marked")
def morph_split_marked(spark, d):
    return _words(spark, d).select("word", F.array_join(M.split_marked(F.col("word")), "").alias("parts"))


@query(f"WITH {_PLAIN} SELECT word, parts FROM plain")
def morph_split_plain(spark, d):
    return _words(spark, d).select("word", M.plain_line(F.col("word")).alias("parts"))


def _segmented(table: str, keep: str) -> str:
    return f"""SELECT doc_id, pos, string_agg({keep}, ' ' ORDER BY i) AS line FROM (
  SELECT doc_id, pos, unnest({I.toks('line')}) AS word, generate_subscripts({I.toks('line')}, 1) AS i FROM lines) JOIN {table} USING (word) GROUP BY doc_id, pos"""


@query(f"WITH {_MARKED} {_segmented('marked', chr(67) + 'ASE WHEN regexp_matches(word, ' + chr(39) + '\\p{L}' + chr(39) + ') THEN parts ELSE word END')}")
def morph_corpus_marked(spark, d):
    out = I.lines(spark, d).filter(X.count_tokens(F.col("line")) > 0)
    return out.select("doc_id", "pos", M.marked_line(F.col("line")).alias("line"))


@query(f"WITH {_PLAIN} {_segmented('plain', 'parts')}")
def morph_corpus_plain(spark, d):
    out = I.lines(spark, d).filter(X.count_tokens(F.col("line")) > 0)
    return out.select("doc_id", "pos", M.plain_line(F.col("line")).alias("line"))


_AFFIXES = sorted({*R.PREFIXES, *R.SUFFIXES})


@query(
    f"""WITH {_PLAIN}, each AS (SELECT unnest({I.toks('line')}) AS word FROM lines),
parts AS (SELECT unnest(string_split(parts, ' ')) AS part FROM each JOIN plain USING (word))
SELECT count(*) AS parts, CAST(count(*) FILTER (part IN ({', '.join(f"'{a}'" for a in _AFFIXES)})) AS BIGINT) AS aligned FROM parts"""
)
def morph_alignment(spark, d):
    parts = I.lines(spark, d).select(F.explode(F.split(M.plain_line(F.col("line")), " ")).alias("part")).filter("part <> ''")
    return parts.agg(F.count(F.lit(1)).alias("parts"), F.sum(F.when(F.col("part").isin(_AFFIXES), 1).otherwise(0)).alias("aligned"))


# ---------------------------------------------------------------- pairs and metrics


@query(
    f"""WITH {I.PAIRS}, raw AS (SELECT pair_id, CASE WHEN pair_id % 3 = 0 THEN sentence_good END AS correct, CASE WHEN pair_id % 3 = 0 THEN sentence_bad END AS incorrect,
  CASE WHEN pair_id % 3 = 1 THEN sentence_good END AS good_sentence, CASE WHEN pair_id % 3 < 2 THEN sentence_bad END AS bad_sentence, CASE WHEN pair_id % 6 = 0 THEN subset END AS category FROM pairs)
SELECT coalesce(correct, good_sentence) AS good_sentence, CASE WHEN correct IS NOT NULL THEN incorrect ELSE bad_sentence END AS bad_sentence, coalesce(category, 'unknown') AS category
FROM raw WHERE (correct IS NOT NULL AND incorrect IS NOT NULL) OR (good_sentence IS NOT NULL AND bad_sentence IS NOT NULL)"""
)
def pair_normalise(spark, d):
    k, p = F.col("pair_id") % 3, I.pairs(spark, d)
    raw = p.select(
        F.when(k == 0, F.col("sentence_good")).alias("correct"),
        F.when(k == 0, F.col("sentence_bad")).alias("incorrect"),
        F.when(k == 1, F.col("sentence_good")).alias("good_sentence"),
        F.when(k < 2, F.col("sentence_bad")).alias("bad_sentence"),
        F.when(F.col("pair_id") % 6 == 0, F.col("subset")).alias("category"),
    )
    return corpora.normalise_pairs(raw)


@query(f"WITH {I.PAIRS} SELECT subset, pair_id, side, CAST(length(text) AS BIGINT) AS n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes FROM sides")
def pair_lengths(spark, d):
    return minpair.sides(I.pairs(spark, d)).select("subset", "pair_id", "side", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"))


def _wide(spark, d):
    """Scores of both sides of all pairs; what reads them does so once."""
    return minpair.bigram_wide(I.texts(spark, d), I.paired)


def _metrics(spark, d):
    return minpair.pair_metrics(_wide(spark, d))


def _imbalance(spark, d):
    """Differences in tokens, which need no scores."""
    return minpair.imbalance(minpair.token_counts(I.pairs(spark, d)))


def _accuracy(spark, d):
    return minpair.subset_accuracy(_metrics(spark, d))


def _errors(spark, d):
    return minpair.long_errors(minpair.imbalance(_metrics(spark, d)))


@query(f"WITH {I.BIGRAM} SELECT subset, pair_id, side, {r6('lp')}, n_tokens, n_chars, n_bytes FROM side_scores")
def sentence_logprob(spark, d):
    return minpair.tall(_wide(spark, d))


@query(f"WITH {I.METRIC} SELECT subset, pair_id, {r6(*[f'{m}_{s}' for m in R.METRICS for s in ('good', 'bad')])}, {', '.join(f'{m}_correct' for m in R.METRICS)} FROM metrics")
def pair_metrics(spark, d):
    return _metrics(spark, d).select("subset", "pair_id", *[f"{m}_{s}" for m in R.METRICS for s in ("good", "bad", "correct")])


@query(f"WITH {I.ACCURACY} SELECT subset, pairs, {r6(*R.METRICS)} FROM acc")
def subset_accuracy(spark, d):
    return _accuracy(spark, d)


@query(f"WITH {I.ACCURACY} SELECT {', '.join(f'round(avg({m}), 6) + 0.0 AS {m}' for m in R.METRICS)} FROM acc")
def macro_average(spark, d):
    return minpair.macro_average(_accuracy(spark, d))


@query(f"WITH {I.BIGRAM} SELECT subset, count(*) AS pairs, round(avg(CAST(coalesce(-lp_good / nullif(n_tokens_good, 0) < -lp_bad / nullif(n_tokens_bad, 0), false) AS DOUBLE)), 6) + 0.0 AS accuracy FROM wide GROUP BY subset")
def mean_nll_accuracy(spark, d):
    out = minpair.mean_nll_correct(_wide(spark, d))
    return out.groupBy("subset").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


@query(
    f"""WITH {I.BIGRAM}, sizes(vocab_size, k) AS (VALUES (1000, 2), (5000, 3), (10000, 4), (20000, 6)),
lens AS (SELECT vocab_size, subset, pair_id, {', '.join(f"CAST(list_sum(list_transform(string_split(sentence_{s}, ' '), lambda w: (length(w) + k - 1) // k)) AS BIGINT) AS tok_{s}" for s in ('good', 'bad'))} FROM pairs, sizes),
j AS (SELECT * FROM wide JOIN lens USING (subset, pair_id)),
m AS (SELECT vocab_size, subset, {', '.join(f"avg(CAST(coalesce({I.value(m, 'good', 'tok') if m == 'normalized_log_prob' else I.value(m, 'good')} {'>' if m.endswith('log_prob') else '<'} {I.value(m, 'bad', 'tok') if m == 'normalized_log_prob' else I.value(m, 'bad')}, false) AS DOUBLE)) AS {m}" for m in R.METRICS)} FROM j GROUP BY ALL)
SELECT CAST(vocab_size AS BIGINT) AS vocab_size, {', '.join(f'round(avg({m}), 6) + 0.0 AS {m}' for m in R.METRICS)} FROM m GROUP BY vocab_size"""
)
def vocab_sweep(spark, d):
    """Token counts of the sweep stand in for tokenizers of growing size: pieces of k characters."""
    sizes = F.array(*[F.struct(F.lit(v).alias("vocab_size"), F.lit(k).alias("k")) for v, k in ((1000, 2), (5000, 3), (10000, 4), (20000, 6))])
    p = I.pairs(spark, d).select("*", F.inline(sizes))
    count = lambda c: F.aggregate(F.split(c, " "), F.lit(0), lambda a, w: a + F.floor((F.length(w) + F.col("k") - 1) / F.col("k")).cast("int"))
    lengths = p.select("vocab_size", "subset", "pair_id", count("sentence_good").alias("n_tokens_good"), count("sentence_bad").alias("n_tokens_bad"))
    return minpair.sweep(_wide(spark, d), lengths)


_DISPLAY = {"raw_log_prob": "Raw Log-Prob", "normalized_log_prob": "Normalized (per token)", "bpc": "Bits per Character", "bpb": "Bits per Byte"}


@query(
    f"""WITH {I.ERRORS}, by_size AS (SELECT metric, CAST(floor(pair_id / 100) AS BIGINT) * 1000 AS size, avg(error) AS e FROM errors GROUP BY ALL)
SELECT CASE metric {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _DISPLAY.items())} END AS metric, CAST(size // 1000 AS VARCHAR) || 'k' AS size, {r6('e')} FROM by_size"""
)
def plot_labels(spark, d):
    """Error rates of pairs in hundreds under the names that plots show."""
    rows = _errors(spark, d).groupBy("metric", (F.floor(F.col("pair_id") / 100) * 1000).alias("size")).agg(F.avg("error").alias("e"))
    return rows.select(X.pretty_metric(F.col("metric")).alias("metric"), X.k_label(F.col("size")).alias("size"), "e")


@query(f"WITH {I.ERRORS} SELECT subset, pair_id, category, delta, abs_delta FROM imb")
def imbalance_pairs(spark, d):
    return _imbalance(spark, d).select("subset", "pair_id", "category", "delta", "abs_delta")


@query(
    f"""WITH {I.ERRORS}, base AS (SELECT m.metric, b.bin FROM (VALUES {', '.join(f"('{m}')" for m in R.METRICS)}) m(metric), (VALUES (0), (1), (2), (3), (4)) b(bin)),
got AS (SELECT metric, least(abs_delta, 4) AS bin, count(*) AS n, avg(error) AS e FROM errors GROUP BY ALL)
SELECT metric, CASE bin WHEN 4 THEN '4+' ELSE CAST(bin AS VARCHAR) END AS bin, coalesce(n, 0) AS count, round(coalesce(1 - e, 0), 6) + 0.0 AS accuracy, round(coalesce(e, 0), 6) + 0.0 AS error_rate
FROM base LEFT JOIN got USING (metric, bin)"""
)
def imbalance_bins(spark, d):
    return minpair.bins(_errors(spark, d))


@query(f"WITH {I.ERRORS}, c AS (SELECT metric, count(*) AS n, {I.CORR} AS r FROM errors GROUP BY metric) SELECT metric, n, {r6('r', 'p')} FROM {I.p_value('c', 'metric')}")
def imbalance_corr(spark, d):
    return minpair.correlation(_errors(spark, d))


_BY = f"{I.ERRORS}, cat AS (SELECT category, metric, count(*) AS n, {I.CORR} AS r FROM errors WHERE category IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_BY} SELECT category, metric, n, {r6('r', 'p')} FROM {I.p_value('cat', 'category, metric')}")
def category_corr(spark, d):
    return minpair.correlation(_errors(spark, d).filter("category IS NOT NULL"), ("category", "metric"))


@query(f"WITH {_BY} SELECT category, metric, round(r, 3) + 0.0 AS r, n FROM cat UNION ALL SELECT 'Overall', metric, round({I.CORR}, 3) + 0.0, count(*) FROM errors GROUP BY metric")
def category_table(spark, d):
    # written, as it is read twice
    e = written(_errors(spark, d), "errors")
    return report.category_table(minpair.correlation(e.filter("category IS NOT NULL"), ("category", "metric")), minpair.correlation(e))


@query(f"WITH {I.ERRORS} SELECT subset, pair_id, metric, abs_delta, error FROM errors ORDER BY md5('42|' || metric || ' ' || pair_id), subset, metric, pair_id LIMIT 2000")
def plot_sample(spark, d):
    """Two thousand points of the imbalance plots."""
    return curate.sample_of(_errors(spark, d).drop("category"), 2_000, F.concat_ws(" ", "metric", F.col("pair_id").cast("string")), ["subset", "metric", "pair_id"])


_DELTA = f"{I.ERRORS}, by_delta AS (SELECT metric, abs_delta, count(*) AS count, avg(error) AS error_rate FROM errors GROUP BY ALL)"


@query(f"WITH {_DELTA} SELECT metric, abs_delta, count, {r6('error_rate')} FROM by_delta")
def error_by_delta(spark, d):
    return minpair.error_by_delta(_errors(spark, d))


@query(
    f"""WITH {_DELTA}, s AS (SELECT metric, coalesce(covar_pop(CAST(abs_delta AS DOUBLE), error_rate) / nullif(var_pop(abs_delta), 0), 0) AS slope, avg(error_rate) AS y, avg(abs_delta) AS x FROM by_delta GROUP BY metric)
SELECT metric, {r6('slope')}, round(y - slope * x, 6) + 0.0 AS intercept FROM s"""
)
def error_trend(spark, d):
    return minpair.error_trend(minpair.error_by_delta(_errors(spark, d)))


@query(
    f"""WITH {I.ACCURACY}, g AS (SELECT subset, bpb - normalized_log_prob AS gap FROM acc)
SELECT subset, {r6('gap')}, row_number() OVER (ORDER BY round(gap, 9) DESC, subset) AS rank, row_number() OVER (ORDER BY round(abs(gap), 9) DESC, subset) AS abs_rank FROM g"""
)
def metric_gap_rank(spark, d):
    return minpair.gap_rank(_accuracy(spark, d))


_IN_AFFIXES = f"IN ({', '.join(f"'{a}'" for a in _AFFIXES)})"
_UNIFORM = f"""uni AS (SELECT subset, pair_id, side, -len({I.toks('text')}) * CAST({minpair.LN256!r} AS DOUBLE) AS lp, len({I.toks('text')}) AS n_tokens, length(text) AS n_chars, strlen(text) AS n_bytes FROM sides),
uwide AS (SELECT g.subset, g.pair_id, {', '.join(f'{s}.{c} AS {c}_{n}' for s, n in (('g', 'good'), ('b', 'bad')) for c in ('lp', 'n_tokens', 'n_chars', 'n_bytes'))}
  FROM uni g JOIN uni b ON g.pair_id = b.pair_id AND g.side = 'good' AND b.side = 'bad'),
uacc AS (SELECT subset, count(*) AS pairs, {', '.join(f'avg(CAST({I.correct(m)} AS DOUBLE)) AS {m}' for m in R.METRICS)} FROM uwide GROUP BY subset)"""
_FIGURES = f"""{_PLAIN}, said AS (SELECT word, count(*) AS n FROM (SELECT unnest({I.toks('line')}) AS word FROM lines) GROUP BY word),
cut AS (SELECT n, string_split(parts, ' ') AS p FROM said JOIN plain USING (word)),
tok_counts AS (SELECT 'baseline' AS tokenizer, 0 AS size, sum(n) AS tokens, sum(CASE WHEN word {_IN_AFFIXES} OR lower(word) {_IN_AFFIXES} THEN n ELSE 0 END) AS aligned FROM said
  UNION ALL SELECT 'morph_5000', 5000, sum(n * len(p)), sum(n * len(list_filter(p, lambda x: x {_IN_AFFIXES}))) FROM cut),
toks_ AS (SELECT tokenizer, size, tokens / chars AS compression_ratio, tokens / chars * 1000 AS tokens_per_1000_chars, tokens / words AS avg_tokens_per_word, aligned / tokens * 100 AS morph_percent
  FROM tok_counts, (SELECT CAST(sum(length(trim(line))) AS DOUBLE) AS chars FROM lines), (SELECT CAST(sum(n) AS DOUBLE) AS words FROM said))"""
_MODELS = f"""{I.ACCURACY}, {_UNIFORM}, {_FIGURES},
avgs AS (SELECT 'bigram' AS scorer, {', '.join(f'avg({m}) AS {m}' for m in R.METRICS)} FROM acc UNION ALL SELECT 'uniform', {', '.join(f'avg({m})' for m in R.METRICS)} FROM uacc),
labels_(label, size, scorer) AS (VALUES ('Baseline-Clean', 0, 'bigram'), ('Morph-5000', 5000, 'uniform'), ('Morph-10000', 10000, 'bigram'), ('Other', 1, 'uniform')),
models AS (SELECT * FROM labels_ JOIN avgs USING (scorer))"""


def _uniform(spark, d):
    """Accuracies under the scorer that gives every token the same loss."""
    scored = minpair.sentence_scores(minpair.score(minpair.sides(I.pairs(spark, d)), minpair.uniform_scorer))
    # whole multiples of the loss, without the last bits of long sums
    scored = scored.withColumn("lp", F.round(F.col("lp") / minpair.LN256) * minpair.LN256)
    return minpair.subset_accuracy(minpair.pair_metrics(minpair.wide(scored)))


@query(f"WITH {I.PAIRS}, {_UNIFORM} SELECT subset, pairs, {r6(*R.METRICS)} FROM uacc")
def uniform_accuracy(spark, d):
    """What the metrics say of a model that knows nothing but the number of tokens."""
    return _uniform(spark, d)


def _models(spark, d):
    """Models by label, each with the averages of its scorer."""
    averages = lambda accuracy, name: minpair.macro_average(accuracy).withColumn("scorer", F.lit(name))
    both = averages(_accuracy(spark, d), "bigram").unionByName(averages(_uniform(spark, d), "uniform"))
    rows = [("Baseline-Clean", 0, "bigram"), ("Morph-5000", 5000, "uniform"), ("Morph-10000", 10000, "bigram"), ("Other", 1, "uniform")]
    return spark.createDataFrame(rows, "label string, size int, scorer string").join(F.broadcast(both), "scorer")


def _tokenizers(spark, d):
    """Figures of two tokenizers over all lines: whole words, and words cut by the rules."""
    lines = I.lines(spark, d)
    words = lines.select(F.explode(X.tokens(F.col("line"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    aligned = lambda parts: F.size(F.filter(parts, lambda p: p.isin(_AFFIXES) | F.lower(p).isin(_AFFIXES)))
    cuts = X.once(words, whole=F.array("word"), parts=F.split(M.plain_line(F.col("word")), " "))
    each = F.array(*[F.struct(F.lit(t).alias("tokenizer"), F.lit(k).alias("size"), F.size(c).alias("pieces"), aligned(F.col(c)).alias("aligned")) for t, k, c in (("baseline", 0, "whole"), ("morph_5000", 5000, "parts"))])
    sums = cuts.select("n", F.inline(each)).groupBy("tokenizer", "size").agg(F.sum("n").alias("words"), F.sum(F.col("n") * F.col("pieces")).alias("tokens"), F.sum(F.col("n") * F.col("aligned")).alias("aligned"))
    chars = lines.agg(F.sum(F.length(F.trim("line"))).alias("chars"))
    ratio = F.col("tokens") / F.col("chars")
    return sums.join(F.broadcast(chars), F.lit(True)).select(
        "tokenizer", "size", ratio.alias("compression_ratio"), (ratio * 1000).alias("tokens_per_1000_chars"), (F.col("tokens") / F.col("words")).alias("avg_tokens_per_word"), (F.col("aligned") / F.col("tokens") * 100).alias("morph_percent")
    )


@query(f"WITH {_FIGURES} SELECT tokenizer, CAST(size AS BIGINT) AS size, {r6('compression_ratio', 'tokens_per_1000_chars', 'avg_tokens_per_word', 'morph_percent')} FROM toks_")
def tokenizer_figures(spark, d):
    """Tokens per character and word, and the share of pieces that are affixes."""
    return _tokenizers(spark, d)


@query(
    f"""WITH {_MODELS} SELECT size, {r6('normalized_log_prob', 'bpb')}, round(normalized_log_prob - bpb, 6) + 0.0 AS delta, round(CAST(compression_ratio AS DOUBLE), 6) + 0.0 AS compression_ratio
FROM (SELECT CAST(m.size AS BIGINT) AS size, normalized_log_prob, bpb, compression_ratio FROM models m JOIN toks_ t ON m.size = t.size)"""
)
def granularity_rows(spark, d):
    return report.granularity_rows(_models(spark, d), _tokenizers(spark, d))


_CELL = "coalesce(printf('%.{n}f', round(CAST({c} AS DOUBLE), {n})), '-') AS {a}"


@query(
    f"""WITH {_MODELS} SELECT label AS model, {_CELL.format(n=2, c='tokens_per_1000_chars', a='tokens_per_1k_chars')}, {_CELL.format(n=2, c='avg_tokens_per_word', a='avg_tokens_per_word')},
  coalesce(printf('%.1f', round(CAST(morph_percent AS DOUBLE), 1)) || '%', '-') AS morph_align, {', '.join(_CELL.format(n=4, c=m, a=a) for m, a in (('raw_log_prob', 'sum'), ('normalized_log_prob', 'mean'), ('bpc', 'bpc'), ('bpb', 'bpb')))}
FROM models m LEFT JOIN toks_ t ON t.tokenizer = CASE WHEN contains(label, 'Baseline') THEN 'baseline' WHEN contains(label, 'Morph-') THEN 'morph_' || regexp_extract(label, '-([^-]*)$', 1) END"""
)
def benchmark_table(spark, d):
    return report.benchmark_table(_models(spark, d), _tokenizers(spark, d))


# ---------------------------------------------------------------- training data and metrics


@query(f"WITH {I.PAIRS} SELECT pair_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || sentence_good), subset, pair_id) <= floor(count(*) OVER () * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'validation' END AS split FROM pairs")
def train_val_split(spark, d):
    return curate.hash_split(I.pairs(spark, d), "sentence_good").select("pair_id", "split")


@query(f"WITH {I.PAIRS}, m AS (SELECT 'paired' AS type FROM pairs UNION ALL SELECT 'natural' FROM documents) SELECT type, count(*) AS n, round(count(*) / (SELECT count(*) FROM m), 6) + 0.0 AS share FROM m GROUP BY type")
def mix_dataset(spark, d):
    natural = I.table(spark, d, "documents").select("text")
    return training.proportions(training.mixed(natural, I.pairs(spark, d)))


def _id_rows(spark, d):
    return I.table(spark, d, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w) + 3).alias("ids"))


_IDS = "ids AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w) + 3) AS ids FROM documents)"
_BATCH = f"""{_IDS}, b AS (SELECT doc_id, doc_id % 8 AS shard, CAST(floor((row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) - 1) / 16) AS BIGINT) AS batch, ids[1:1024] AS ids FROM ids),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY shard, batch) AS width FROM b)"""


@query(
    f"""WITH {_BATCH} SELECT doc_id, shard, batch, CAST(width AS BIGINT) AS width, array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda i: 0)), ' ') AS input_ids,
  array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda i: -100)), ' ') AS labels,
  array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(width - len(ids)), lambda i: 0)), ' ') AS attention_mask FROM w"""
)
def pad_batches(spark, d):
    out = training.batches(_id_rows(spark, d), "ids", 16, shards=8, max_len=1024)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return out.select("doc_id", "shard", "batch", "width", text("input_ids"), text("labels"), text("attention_mask"))


@query(f"WITH {_IDS} SELECT doc_id, array_to_string(list_concat([1], ids, [2])[1:1024], ' ') AS framed, array_to_string(ids[1:len(ids) - 1], ' ') AS inputs, array_to_string(ids[2:], ' ') AS labels FROM ids")
def frame_shift(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    ids = F.col("ids")
    x, y = training.shifted(ids)
    return _id_rows(spark, d).select("doc_id", text(training.truncated(training.framed(ids, 1, 2), 1024)).alias("framed"), text(x).alias("inputs"), text(y).alias("labels"))


@query("WITH m AS (SELECT doc_id, CAST(floor(doc_id / 16) AS BIGINT) AS batch, doc_id % 7 = 0 AS is_pair FROM documents) SELECT doc_id, batch, is_pair FROM m QUALIFY NOT bool_or(is_pair) OVER (PARTITION BY batch) OR is_pair")
def paired_collation(spark, d):
    m = I.table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch"), (F.col("doc_id") % 7 == 0).alias("is_pair"))
    return training.paired_first(m)


@query(
    f"""WITH {I.BIGRAM}, m AS (SELECT avg(greatest(0.0, 0.5 - (lp_good - lp_bad))) AS margin, avg(-lp_good / nullif(n_tokens_good, 0)) AS ce FROM wide)
SELECT {r6('margin', 'ce')}, round(ce + 0.3 * margin, 6) + 0.0 AS total FROM m"""
)
def margin_loss(spark, d):
    return minpair.margin_loss(_wide(spark, d))


@query(f"WITH {I.BIGRAM} SELECT count(*) AS pairs, CAST(count(*) FILTER (lp_good > lp_bad) AS BIGINT) AS preferred, round(count(*) FILTER (lp_good > lp_bad) / count(*) * 100, 6) + 0.0 AS percent FROM wide")
def preference_report(spark, d):
    return minpair.preference(_wide(spark, d))


@query("WITH l AS (SELECT event_id + 1 AS step, value FROM events), w AS (SELECT step, avg(value) OVER (ORDER BY step RANGE BETWEEN 99 PRECEDING AND CURRENT ROW) AS mean FROM l) SELECT step, round(mean, 6) + 0.0 AS mean FROM w WHERE step % 100 = 0")
def rolling_margin(spark, d):
    log = I.table(spark, d, "events").select((F.col("event_id") + 1).alias("step"), "value")
    return training.rolling_mean(log, "step", "value")


_TASKS = """p AS (SELECT unnest(['mrpc', 'sst2']) AS task, CASE WHEN length(d.text) % 4 = 0 THEN 0 ELSE 1 END AS prediction, quality AS label FROM labels l JOIN documents d USING (doc_id) WHERE quality IS NOT NULL AND d.text IS NOT NULL),
c AS (SELECT task, count(*) AS n, avg(CAST(prediction = label AS DOUBLE)) AS accuracy, sum(CASE WHEN prediction = 1 AND label = 1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN prediction = 1 AND label <> 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN prediction <> 1 AND label = 1 THEN 1 ELSE 0 END) AS fn FROM p GROUP BY task),
g AS (SELECT task, n, accuracy, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)"""


def _tasks(spark, d):
    j = I.table(spark, d, "labels").join(I.table(spark, d, "documents"), "doc_id").filter("quality IS NOT NULL AND text IS NOT NULL")
    return j.select(F.explode(F.array(F.lit("mrpc"), F.lit("sst2"))).alias("task"), F.when(F.length("text") % 4 == 0, 0).otherwise(1).alias("prediction"), F.col("quality").alias("label"))


@query(f"WITH {_TASKS} SELECT task, n, {r6('accuracy', 'f1')}, round(CASE task WHEN 'mrpc' THEN f1 ELSE accuracy END, 6) + 0.0 AS metric FROM g")
def glue_metrics(spark, d):
    return training.task_metrics(_tasks(spark, d))


@query(f"WITH {_TASKS} SELECT round(avg(CASE task WHEN 'mrpc' THEN f1 ELSE accuracy END), 6) + 0.0 AS average FROM g")
def glue_average(spark, d):
    return training.task_metrics(_tasks(spark, d)).agg(F.avg("metric").alias("average"))


_LOG = "log AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value FROM events WHERE value IS NOT NULL)"


def _log(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return I.table(spark, d, "events").filter("value IS NOT NULL").select(F.col("user_id").alias("run"), F.row_number().over(w).alias("epoch"), "value")


@query(
    f"""WITH {_LOG}, b AS (SELECT *, max(value) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM log),
i AS (SELECT *, max(CASE WHEN before IS NULL OR value > before THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last FROM b),
s AS (SELECT run, coalesce(min(epoch) FILTER (epoch - last >= 2), max(epoch)) AS stop_epoch FROM i GROUP BY run)
SELECT run, arg_min(epoch, (-value, epoch)) AS best_epoch, round(max(value), 6) + 0.0 AS best_value, stop_epoch FROM log JOIN s USING (run) WHERE epoch <= stop_epoch GROUP BY run, stop_epoch"""
)
def early_stop(spark, d):
    return training.best_epochs(_log(spark, d))


@query(f"WITH {_LOG} SELECT run, CAST(floor((epoch - 1) / 5) AS BIGINT) AS epoch, round(avg(value), 6) + 0.0 AS loss FROM log GROUP BY ALL")
def epoch_loss(spark, d):
    return training.epoch_means(_log(spark, d).select("run", F.floor((F.col("epoch") - 1) / 5).alias("epoch"), F.col("value").alias("loss")))


@query(f"WITH {_IDS}, p AS (SELECT unnest(ids) AS y, generate_subscripts(ids, 1) AS i FROM ids) SELECT round(avg(CASE WHEN i % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy FROM p WHERE y <> 4")
def lm_token_accuracy(spark, d):
    """Predictions are right at every third position; label 4 is ignored."""
    guess = F.transform("ids", lambda x, i: F.when((i + 1) % 3 == 0, x).otherwise(-1))
    return training.token_accuracy(_id_rows(spark, d).withColumn("guess", guess), "guess", "ids", 4)


# ---------------------------------------------------------------- near duplicates and tokenizers

_SIMILAR = f"""{I.LINES},
u AS (SELECT sha256(line) AS h, hex(encode(line)) AS x, strlen(line) AS n, count(*) AS c FROM lines WHERE strlen(line) >= 3 GROUP BY line),
s AS (SELECT h, c, list_distinct(list_transform(generate_series(1, n - 2), lambda i: x[2 * i - 1:2 * i + 4])) AS g FROM u),
e AS (SELECT h, unnest(g) AS gram, len(g) AS n FROM s), f AS (SELECT gram, count(*) AS df FROM e GROUP BY gram),
o AS (SELECT h, n, gram, row_number() OVER (PARTITION BY h ORDER BY df, gram) AS place FROM e JOIN f USING (gram)),
p AS (SELECT h, n, gram, place FROM o WHERE place <= n - ceil(n * CAST({R.NEAR_THRESHOLD} AS DOUBLE) - 1e-9) + 1),
met AS (SELECT DISTINCT a.h AS a, b.h AS b FROM p a JOIN p b ON a.gram = b.gram AND a.h < b.h WHERE least(a.n, b.n) >= greatest(a.n, b.n) * CAST({R.NEAR_THRESHOLD} AS DOUBLE) - 1e-6
  AND (1 + least(a.n - a.place, b.n - b.place)) * CAST({1 + R.NEAR_THRESHOLD} AS DOUBLE) >= (a.n + b.n) * CAST({R.NEAR_THRESHOLD} AS DOUBLE) - 1e-6),
j AS (SELECT a, b, x.c AS n_a, y.c AS n_b, len(list_intersect(x.g, y.g)) AS i, len(x.g) + len(y.g) AS t FROM met JOIN s x ON x.h = a JOIN s y ON y.h = b)"""


def _distinct_lines(spark, d):
    """Distinct lines with their number of copies."""
    rows = I.lines(spark, d).groupBy("line").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id())
    return written(rows, "distinct-lines")


@query(f"WITH {_SIMILAR} SELECT a, b, n_a, n_b, round(i / (t - i), 6) + 0.0 AS similarity FROM j WHERE i / (t - i) >= CAST({R.NEAR_THRESHOLD} AS DOUBLE)")
def near_dup_exact_pairs(spark, d):
    """Pairs of different lines by hash, with the copies of each, whose sets of byte 3-grams are similar."""
    lines = _distinct_lines(spark, d)
    pairs = neardup.similar_pairs(lines, R.NEAR_THRESHOLD)
    side = lambda k: lines.select(F.col("id").alias(k), X.line_hash(F.col("line")).alias(f"h_{k}"), F.col("n").alias(f"c_{k}"))
    low = F.col("h_a") < F.col("h_b")
    pick = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    out = pairs.join(side("a"), "a").join(side("b"), "b")
    return out.select(pick("h_a", "h_b").alias("a"), pick("h_b", "h_a").alias("b"), pick("c_a", "c_b").alias("n_a"), pick("c_b", "c_a").alias("n_b"), "similarity")


def _placed_lines(spark, d):
    """The first line of each text with an id and its place."""
    kept = curate.keep_first(I.lines(spark, d).withColumn("h", X.line_hash(F.col("line"))), ["h"], ["doc_id", "pos"]).drop("h")
    return kept.withColumn("id", F.xxhash64("doc_id", "pos")).withColumn("place", F.struct("doc_id", "pos"))


@query()
def near_dup_minhash(spark, d):
    """Lines kept by the greedy rule over MinHash candidates."""
    keyed = _placed_lines(spark, d)
    return keyed.join(neardup.greedy_duplicates(keyed), "id", "left_anti").select("corpus", "doc_id", "pos")


@query()
def near_dup_greedy(spark, d):
    """Lines kept by the greedy rule over all pairs that are similar."""
    keyed = _placed_lines(spark, d)
    return keyed.join(neardup.greedy_duplicates(keyed, exact=True), "id", "left_anti").select("corpus", "doc_id", "pos")


@query()
def bpe_train(spark, d):
    """A merge-type vocabulary of all lines' words."""
    return tokenize.train_bpe(I.lines(spark, d), MERGES)


@query()
def bpe_variant_train(spark, d):
    """The other family of vocabularies: its specials, over segmented lines."""
    lines = I.lines(spark, d).select(M.plain_line(F.col("line")).alias("line"))
    return tokenize.train_bpe(lines, SOME_MERGES, R.SPECIALS_PLAIN, "[MASK]")


@query()
def bpe_encode(spark, d):
    """All documents encoded with a trained merge-type vocabulary."""
    v = tokenize.vocabulary(tokenize.train_bpe(I.lines(spark, d), SOME_MERGES), "bpe")
    return tokenize.encode(I.table(spark, d, "documents").select("doc_id", "text"), v).select("doc_id", F.size("ids").alias("n_ids"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"))


@query()
def unigram_train(spark, d):
    """A unigram vocabulary of all lines' words."""
    return tokenize.train_unigram(I.lines(spark, d), PIECES)


@query()
def unigram_encode(spark, d):
    """All documents encoded with a trained unigram vocabulary."""
    v = tokenize.vocabulary(tokenize.train_unigram(I.lines(spark, d), SOME_PIECES), "unigram")
    return tokenize.encode(I.table(spark, d, "documents").select("doc_id", "text"), v).select("doc_id", F.size("ids").alias("n_ids"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"))


@query()
def tokenizer_report(spark, d):
    """Granularity of a trained vocabulary over all lines."""
    v = tokenize.vocabulary(tokenize.train_bpe(I.lines(spark, d), SOME_MERGES), "bpe")
    return tokenize.granularity(I.lines(spark, d), v, f"bpe_{SOME_MERGES}", _AFFIXES)


@query()
def trained_sweep(spark, d):
    """The vocabulary sweep over one trained model: token counts under its first merges, for each cut."""
    v = tokenize.vocabulary(tokenize.train_bpe(I.lines(spark, d), max(CUTS)), "bpe")
    lengths = minpair.cut_lengths(minpair.sides(I.pairs(spark, d)), v, CUTS)
    return minpair.sweep(_wide(spark, d), lengths)
