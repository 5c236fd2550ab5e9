"""Scalar text functions as Column builders; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import rules as R

#: Fixed value: what counts as white space.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Fixed value: characters that count as digits: decimal digits, superscripts and subscripts.
DIGIT = r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"


def normalize_ws(line: Column) -> Column:
    """White-space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(line, SPACE, " "))


def tokens(line: Column) -> Column:
    """White-space tokens, none for blank text."""
    return F.filter(F.split(normalize_ws(line), " "), lambda t: t != "")


def count_tokens(line: Column) -> Column:
    return F.size(tokens(line))


def line_hash(line: Column) -> Column:
    return F.sha2(line, 256)


def removed_chars(line: Column, keep: str) -> Column:
    """Number of characters outside the regular-expression class ``keep`` negated."""
    return F.length(F.regexp_replace(line, keep, ""))


def alpha_chars(line: Column) -> Column:
    return removed_chars(line, r"[^\p{L}]")


def digit_chars(line: Column) -> Column:
    return removed_chars(line, f"[^{DIGIT}]")


def alpha_ratio(line: Column) -> Column:
    """Share of letters, null for empty text."""
    return alpha_chars(line) / F.nullif(F.length(line), F.lit(0))


def strip_edges(word: Column) -> Column:
    """Without punctuation at both edges."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}_\s]+|[^\p{L}\p{N}_\s]+$", "")


#: Fixed value: what makes a line one with an address.
URL = r"(?i)https?://|www\.|\.com|\.org|\.net"


def has_url(line: Column) -> Column:
    return line.rlike(URL)


def code_share(line: Column) -> Column:
    """Share of tokens with a brace or semicolon; 0 without tokens."""
    share = let(tokens(line), lambda t: F.size(F.filter(t, lambda x: x.rlike("[{};]"))) / F.nullif(F.size(t), F.lit(0)))
    return F.coalesce(share, F.lit(0.0))


def table_share(line: Column) -> Column:
    """Share of digits and table punctuation; 0 for empty text."""
    inside = F.length(line) - F.length(F.regexp_replace(line, f"[{DIGIT}.,;:|()\\[\\]{{}}]", ""))
    return F.coalesce(inside / F.nullif(F.length(line), F.lit(0)), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """Two-place percentage as text, null where the whole is 0."""
    return F.when(whole != 0, F.format_string("%.2f%%", F.round(part / F.nullif(whole, F.lit(0)) * 100, 2)))


def k_label(n: Column) -> Column:
    """10000 as '10k'."""
    return F.concat((n / 1000).cast("int").cast("string"), F.lit("k"))


def joined_fields(*fields: Column) -> Column:
    return F.concat_ws(" ", *fields)


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def pretty_metric(name: Column) -> Column:
    """Display names of the four metrics."""
    return (
        F.when(name == "raw_log_prob", "Raw Log-Prob")
        .when(name == "normalized_log_prob", "Normalized (per token)")
        .when(name == "bpc", "Bits per Character")
        .when(name == "bpb", "Bits per Byte")
        .otherwise(name)
    )


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``: inside a lambda it would be evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are evaluated once however often they are used.

    A generator of one row stands between the projections, which the optimizer
    would otherwise merge by writing each expression out at every use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def count_words(norm: Column) -> Column:
    """Number of tokens of a line whose white space is normalised."""
    return F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1)


def distinct_trigrams(t: Column) -> Column:
    """Share of distinct word 3-grams; at least three tokens."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 2, F.lit(1))), lambda i: F.array_join(F.slice(t, i, 3), " "))
    return let(grams, lambda g: F.size(F.array_distinct(g)) / F.nullif(F.size(g), F.lit(0)))


def quality_score(line: Column) -> Column:
    """0 to 100 for a stripped line: length, letters, digits, punctuation, repetition."""
    n = F.length(line)
    size = F.nullif(n, F.lit(0))
    length = F.least(n / 100, F.lit(1.0)) * R.W_LENGTH
    alpha = alpha_chars(line) / size * R.W_ALPHA
    digit = (1 - digit_chars(line) / size) * R.W_DIGIT
    p = removed_chars(line, r"[^.,;:!?]") / size
    punct = (
        F.when((p >= 0.02) & (p <= 0.10), F.lit(float(R.W_PUNCT)))
        .when(p < 0.02, p / 0.02 * R.W_PUNCT)
        .otherwise(F.greatest(F.lit(0.0), 1 - (p - 0.10) / 0.10) * R.W_PUNCT)
    )
    repeat = let(tokens(line), lambda t: F.when(F.size(t) >= 3, distinct_trigrams(t) * R.W_REPEAT).otherwise(F.lit(float(R.W_REPEAT))))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(length + alpha + digit + punct + repeat, 2))


def score_bucket(score: Column) -> Column:
    low = (F.floor(score / 10) * 10).cast("int")
    return F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string"))


def order_hash(seed: int, line: Column) -> Column:
    """Seeded pseudo-random order that every engine reproduces."""
    return F.md5(F.concat(F.lit(f"{seed}|"), line).cast("binary"))
