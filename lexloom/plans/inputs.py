"""Inputs of the catalogue's queries, built alike in Spark and in DuckDB SQL from the driver's tables.

The texts of ``documents`` have no speaker tags, time stamps or headings, so
lines get a deterministic decoration that gives every cleaner work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import rules as R
from lexloom.functions import text as X
from lexloom.session import spread
from lexloom.sources import corpora


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus, doc_id, pos, line."""
    raw = corpora.lines_from_documents(table(spark, sf_dir, "documents")).withColumn("pos", F.col("pos").cast("long"))
    raw = X.once(raw.withColumnRenamed("line", "x"), k=(F.col("doc_id") * 31 + F.col("pos")) % 11)
    k, x = F.col("k"), F.col("x")
    decorated = (
        F.when(k == 0, F.concat(F.lit("*CHI: "), x))
        .when(k == 1, F.concat(x, F.lit(" [laughs]")))
        .when(k == 2, "CHAPTER XI")
        .when(k == 3, F.concat(F.lit("= = = "), x, F.lit(" = = =")))
        .when(k == 4, F.concat(F.lit("A: "), x))
        .when(k == 5, "00:00:01,000 --> 00:00:02,000")
        .when(k == 6, F.concat(F.lit("<meta> "), x))
        .when(k == 7, F.concat(F.lit("  "), x, F.lit("\t ")))
        .when(k == 8, F.concat(x, F.lit(" www.example.org")))
        .when(k == 9, F.concat(F.lit("{ a; } "), F.replace(x, F.lit(" "), F.lit("; "))))
        .otherwise(x)
    )
    return X.once(raw, line=decorated).select("corpus", "doc_id", "pos", "line")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subset, pair_id, sentence_good, sentence_bad from the words of documents.

    The bad side swaps the first two words; every third one also loses its last
    word and every third one repeats it.
    """
    return _worded(table(spark, sf_dir, "documents").select("doc_id", "text")).filter(F.size("w") >= 4).select(*_pair())


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts, each with its pair, which is null where a text has no pair."""
    return paired(table(spark, sf_dir, "documents"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of all documents that have one, as they are stored."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("text IS NOT NULL")


def paired(docs: DataFrame) -> DataFrame:
    """Texts with their pairs, from doc_id and text; ``block`` is kept where it is there."""
    kept = [c for c in docs.columns if c in ("block", "text")]
    return _worded(docs.select("doc_id", *kept)).filter("text IS NOT NULL").select(*kept, *[F.when(F.size("w") >= 4, c).alias(n) for n, c in zip(PAIR, _pair(), strict=True)])


PAIR = ("subset", "pair_id", "sentence_good", "sentence_bad")


def _worded(docs: DataFrame) -> DataFrame:
    return X.once(docs, w=F.filter(F.split("text", r"[ \n]+"), lambda w: w != ""))


def _pair() -> list[Column]:
    k, less = F.col("doc_id") % 3, lambda by: F.greatest(F.size("w") - by, F.lit(0))
    tail = F.when(k == 0, F.slice("w", F.lit(3), less(3))).when(k == 1, F.concat(F.slice("w", F.lit(3), less(2)), F.slice("w", F.greatest(F.size("w"), F.lit(1)), F.lit(1)))).otherwise(F.slice("w", F.lit(3), less(2)))
    names = F.array(*[F.lit(s) for s in R.SUBSETS])
    columns = (
        F.element_at(names, (F.col("doc_id") % len(R.SUBSETS) + 1).cast("int")),
        F.col("doc_id"),
        F.array_join("w", " "),
        F.array_join(F.concat(F.slice("w", 2, 1), F.slice("w", 1, 1), tail), " "),
    )
    return [c.alias(n) for n, c in zip(PAIR, columns, strict=True)]


#: White space as the line functions see it, for RE2.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
DIGIT = r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: t <> '')"


_CORPORA = "[" + ", ".join(f"'{c}'" for c in R.CORPORA) + "]"
_SUBSETS = "[" + ", ".join(f"'{s}'" for s in R.SUBSETS) + "]"

LINES = f"""
lines0 AS (
  SELECT {_CORPORA}[coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 6 + 1] AS corpus, doc_id,
    unnest(string_split(coalesce(text, ''), chr(10))) AS x, CAST(generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS BIGINT) AS pos
  FROM documents),
lines AS (
  SELECT corpus, doc_id, pos, CASE (doc_id * 31 + pos) % 11 WHEN 0 THEN '*CHI: ' || x WHEN 1 THEN x || ' [laughs]' WHEN 2 THEN 'CHAPTER XI'
    WHEN 3 THEN '= = = ' || x || ' = = =' WHEN 4 THEN 'A: ' || x WHEN 5 THEN '00:00:01,000 --> 00:00:02,000' WHEN 6 THEN '<meta> ' || x
    WHEN 7 THEN '  ' || x || chr(9) || ' ' WHEN 8 THEN x || ' www.example.org' WHEN 9 THEN '{{ a; }} ' || replace(x, ' ', '; ') ELSE x END AS line
  FROM lines0)"""

PAIRS = f"""
pair_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
pairs AS (
  SELECT {_SUBSETS}[doc_id % {len(R.SUBSETS)} + 1] AS subset, doc_id AS pair_id, array_to_string(w, ' ') AS sentence_good,
    array_to_string(list_concat([w[2], w[1]], CASE doc_id % 3 WHEN 0 THEN w[3:len(w) - 1] WHEN 1 THEN list_concat(w[3:len(w)], [w[len(w)]]) ELSE w[3:len(w)] END), ' ') AS sentence_bad
  FROM pair_words WHERE len(w) >= 4),
sides AS (SELECT subset, pair_id, 'good' AS side, sentence_good AS text FROM pairs UNION ALL SELECT subset, pair_id, 'bad', sentence_bad FROM pairs)"""

_STAMP = r"\p{Nd}{1,2}:\p{Nd}{2}:\p{Nd}{2}[,.]\p{Nd}+"
CLEAN = {
    "bnc_spoken": "CASE WHEN regexp_matches(norm, '^[<\\[]') THEN '' ELSE norm END",
    "childes": "regexp_replace(regexp_replace(norm, '^\\*[A-Z]+:\\s*', ''), '\\[.*?\\]', '', 'g')",
    "gutenberg": "CASE WHEN regexp_matches(norm, '(?i)^\\*?CHAPTER\\s+[IVXLCDM0-9]+\\*?$') OR "
    + " OR ".join(f"contains(lower(norm), '{m}')" for m in R.BOOK_MARKERS)
    + " THEN '' ELSE norm END",
    "open_subtitles": "CASE WHEN len({t}) = 1 THEN '' ELSE {c} END".format(
        t=toks(f"regexp_replace(regexp_replace(norm, '{_STAMP}\\s*-->\\s*{_STAMP}', '', 'g'), '^\\p{{Nd}}+$', '')".replace("{{", "{").replace("}}", "}")),
        c=f"regexp_replace(regexp_replace(norm, '{_STAMP}\\s*-->\\s*{_STAMP}', '', 'g'), '^\\p{{Nd}}+$', '')".replace("{{", "{").replace("}}", "}"),
    ),
    "simple_wiki": "regexp_replace(norm, '^=+\\s*.*?\\s*=+$', '')",
    "switchboard": "regexp_replace(norm, '^[AB]:\\s*', '')",
}

PHASE1 = f"""{LINES},
n1 AS (SELECT *, {norm('line')} AS norm FROM lines),
n2 AS (SELECT *, CASE corpus {' '.join(f"WHEN '{c}' THEN {x}" for c, x in CLEAN.items())} ELSE norm END AS clean, len({toks('norm')}) AS n_in FROM n1),
n3 AS (SELECT *, CASE WHEN norm = '' THEN 'empty' WHEN clean = '' THEN 'corpus_specific'
    WHEN length(regexp_replace(clean, '[^\\p{{L}}]', '', 'g')) / length(clean) < {R.MIN_ALPHA} THEN 'low_alpha_ratio'
    WHEN length(clean) NOT BETWEEN {R.MIN_CHARS} AND {R.MAX_CHARS} THEN 'length' END AS r0, len({toks('clean')}) AS n_out FROM n2),
p1 AS (SELECT *, CASE WHEN r0 IS NULL AND row_number() OVER (PARTITION BY corpus, r0, clean ORDER BY doc_id, pos) > 1 THEN 'exact_duplicate' ELSE r0 END AS reason FROM n3),
kept1 AS (SELECT corpus, doc_id, pos, trim(clean) AS line, len({toks('clean')}) AS n_tokens FROM p1 WHERE reason IS NULL AND trim(clean) <> '')"""


def target_values(total: int) -> str:
    return ", ".join(f"('{c}', CAST({int(total * p)} AS BIGINT))" for c, p in R.MIXTURE.items())


SHARES = "(VALUES " + ", ".join(f"('{c}', {p})" for c, p in R.MIXTURE.items()) + ") AS m(corpus, share)"


def sampled_share(part: int) -> str:
    """As ``sampled``, against the ``part``-th part of the kept lines' own tokens."""
    own = f"SELECT corpus, CAST(floor((SELECT CAST(sum(n_tokens) AS BIGINT) // {part} FROM kept1) * CAST(share AS DOUBLE)) AS BIGINT) FROM {SHARES}"
    return sampled(0).replace(f"VALUES {target_values(0)}", own)


URL = "regexp_matches(line, '(?i)https?://|www\\.|\\.com|\\.org|\\.net')"
CODE = f"coalesce(len(list_filter({toks('line')}, lambda t: regexp_matches(t, '[{{}};]'))) / nullif(len({toks('line')}), 0), 0.0)"
TABLE = f"coalesce((length(line) - length(regexp_replace(line, '[{DIGIT}.,;:|()\\[\\]{{}}]', '', 'g'))) / nullif(length(line), 0), 0.0)"


def sampled(total: int, source: str = "kept1", name: str = "s1") -> str:
    """Running sums in seeded order against each corpus's target."""
    return f"""
{name}t(corpus, target) AS (VALUES {target_values(total)}),
{name}0 AS (SELECT *, md5('42|' || line) AS h FROM {source}),
{name} AS (SELECT s.*, t.target, CAST(sum(n_tokens) OVER (PARTITION BY corpus ORDER BY h, doc_id, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum,
    CAST(sum(n_tokens) OVER (PARTITION BY corpus) AS BIGINT) AS total FROM {name}0 s JOIN {name}t t USING (corpus))"""


def phase2(total: int) -> str:
    return f"""{PHASE1}, {sampled(total)},
b2 AS (SELECT corpus, doc_id, pos, line, n_tokens, list_position({_CORPORA}, corpus) AS cr, CASE WHEN total <= target THEN '' ELSE h END AS rh
  FROM s1 WHERE total <= target OR cum <= target),
p2 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY line ORDER BY cr, rh, doc_id, pos) > 1 THEN 'global_duplicate' WHEN {URL} THEN 'url'
    WHEN {CODE} > {R.CODE_SHARE} THEN 'code' WHEN {TABLE} > {R.TABLE_SHARE} THEN 'table_or_list' END AS reason FROM b2),
kept2 AS (SELECT corpus, doc_id, pos, line, n_tokens FROM p2 WHERE reason IS NULL)"""


_P = "(length(regexp_replace(line, '[^.,;:!?]', '', 'g')) / nullif(length(line), 0))"
_GRAMS = "list_transform(generate_series(1, len(t) - 2), lambda i: array_to_string(t[i:i + 2], ' '))"
SCORE = f"""CASE WHEN length(line) = 0 THEN 0.0 ELSE round(
    least(length(line) / 100, 1.0) * 20 + length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) / nullif(length(line), 0) * 40
    + (1 - length(regexp_replace(line, '[^{DIGIT}]', '', 'g')) / nullif(length(line), 0)) * 15
    + CASE WHEN {_P} >= CAST(0.02 AS DOUBLE) AND {_P} <= CAST(0.10 AS DOUBLE) THEN 15.0 WHEN {_P} < CAST(0.02 AS DOUBLE) THEN {_P} / CAST(0.02 AS DOUBLE) * 15
      ELSE greatest(CAST(0.0 AS DOUBLE), 1 - ({_P} - CAST(0.10 AS DOUBLE)) / CAST(0.10 AS DOUBLE)) * 15 END
    + CASE WHEN len(t) >= 3 THEN len(list_distinct({_GRAMS})) / len({_GRAMS}) * 10 ELSE 10.0 END, 2) END"""


def scored(total: int) -> str:
    return f"""{phase2(total)},
t3 AS (SELECT *, {toks('line')} AS t FROM kept2),
p3 AS (SELECT corpus, doc_id, pos, line, n_tokens, CAST({SCORE} AS DOUBLE) AS score FROM t3)"""


def top(total: int, share: float) -> str:
    return f"""{scored(total)},
o3 AS (SELECT *, row_number() OVER (ORDER BY score DESC, md5('42|' || line), line, doc_id, pos) AS rn, count(*) OVER () AS c FROM p3),
top3 AS (SELECT corpus, doc_id, pos, line, n_tokens, score FROM o3 WHERE rn <= CAST(floor(c * CAST({share} AS DOUBLE)) AS BIGINT))"""


BIGRAM = f"""{PAIRS},
doc_words AS (SELECT list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
doc_grams AS (SELECT unnest(list_concat(['<s>'], w[1:len(w) - 1])) AS prev, unnest(w) AS word FROM doc_words WHERE len(w) > 0),
cnt AS (SELECT prev, word, count(*) AS c FROM doc_grams GROUP BY ALL),
cp AS (SELECT prev, sum(c) AS cp FROM cnt GROUP BY prev), v AS (SELECT count(DISTINCT word) AS v FROM cnt),
side_words AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '') AS w FROM sides),
asked AS (SELECT subset, pair_id, side, text, unnest(list_concat(['<s>'], w[1:len(w) - 1])) AS prev, unnest(w) AS word FROM side_words),
side_scores AS (SELECT subset, pair_id, side, sum(ln((coalesce(c, 0) + 1) / (coalesce(cp, 0) + v))) AS lp, CAST(count(*) AS BIGINT) AS n_tokens,
    CAST(max(length(text)) AS BIGINT) AS n_chars, CAST(max(strlen(text)) AS BIGINT) AS n_bytes
  FROM asked LEFT JOIN cnt USING (prev, word) LEFT JOIN cp USING (prev), v GROUP BY subset, pair_id, side),
wide AS (SELECT g.subset, g.pair_id, {', '.join(f'{s}.{c} AS {c}_{n}' for s, n in (('g', 'good'), ('b', 'bad')) for c in ('lp', 'n_tokens', 'n_chars', 'n_bytes'))}
  FROM side_scores g JOIN side_scores b ON g.pair_id = b.pair_id AND g.side = 'good' AND b.side = 'bad')"""


def value(metric: str, side: str, tokens: str = "n_tokens") -> str:
    return {
        "raw_log_prob": f"lp_{side}",
        "normalized_log_prob": f"lp_{side} / nullif({tokens}_{side}, 0)",
        "bpc": f"-lp_{side} / (ln(2) * nullif(n_chars_{side}, 0))",
        "bpb": f"-lp_{side} / (ln(2) * nullif(n_bytes_{side}, 0))",
    }[metric]


def correct(metric: str) -> str:
    return f"coalesce({value(metric, 'good')} {'>' if metric.endswith('log_prob') else '<'} {value(metric, 'bad')}, false)"


METRIC = f"{BIGRAM},\nmetrics AS (SELECT *, {', '.join(f'{value(m, s)} AS {m}_{s}' for m in R.METRICS for s in ('good', 'bad'))}, {', '.join(f'{correct(m)} AS {m}_correct' for m in R.METRICS)} FROM wide)"
ACCURACY = f"{METRIC},\nacc AS (SELECT subset, count(*) AS pairs, {', '.join(f'avg(CAST({m}_correct AS DOUBLE)) AS {m}' for m in R.METRICS)} FROM metrics GROUP BY subset)"
CATEGORY = "CASE WHEN contains(subset, 'wh_') OR contains(subset, 'wh-') THEN 'wh-movement' WHEN contains(subset, 'agreement') THEN 'agreement' WHEN contains(subset, 'npi') THEN 'NPIs' END"
ERRORS = f"""{METRIC},
imb AS (SELECT *, n_tokens_good - n_tokens_bad AS delta, abs(n_tokens_good - n_tokens_bad) AS abs_delta, {CATEGORY} AS category FROM metrics),
errors AS ({' UNION ALL '.join(f"SELECT subset, pair_id, category, abs_delta, '{m}' AS metric, CAST(NOT {m}_correct AS DOUBLE) AS error FROM imb" for m in R.METRICS)})"""
CORR = "coalesce(covar_pop(CAST(abs_delta AS DOUBLE), error) / nullif(stddev_pop(abs_delta) * stddev_pop(error), 0), 0)"


def p_value(source: str, keys: str) -> str:
    """Rows of ``source`` (with ``keys``, n and r) with the two-sided p of r."""
    term = "CASE WHEN k % 2 = 0 THEN (k // 2) * (b - (k // 2)) * x / ((a + 2 * (k // 2) - 1) * (a + 2 * (k // 2))) ELSE -(a + (k // 2)) * (a + b + (k // 2)) * x / ((a + 2 * (k // 2)) * (a + 2 * (k // 2) + 1)) END"
    return f"""(SELECT {keys}, n, r, CASE WHEN n < 3 OR r = 0 THEN 1.0 WHEN abs(r) >= 1 THEN 0.0 WHEN swap THEN 1 - beta ELSE beta END AS p FROM (
  SELECT *, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(greatest(x, 1e-300)) + b * ln(greatest(1 - x, 1e-300))) / a
    / list_reduce(list_concat([CAST(1.0 AS DOUBLE)], list_transform(range(300, 0, -1), lambda k: {term})), lambda f, d: 1 + d / f) AS beta
  FROM (SELECT *, CASE WHEN swap THEN 0.5 ELSE h END AS a, CASE WHEN swap THEN h ELSE 0.5 END AS b, CASE WHEN swap THEN r * r ELSE 1 - r * r END AS x
    FROM (SELECT *, greatest(n - 2, 1) / 2 AS h, 1 - r * r > (greatest(n - 2, 1) / 2 + 1) / (greatest(n - 2, 1) / 2 + 2.5) AS swap FROM {source}))))"""
