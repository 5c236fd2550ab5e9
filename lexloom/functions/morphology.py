"""Rule-based morphological segmentation as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import rules as R
from lexloom.functions import text as T


def longest_first(affixes: list[str]) -> list[str]:
    """Stable order by falling length."""
    return sorted(affixes, key=len, reverse=True)


def _affix(word: Column, affixes: list[str], front: bool, spare: int) -> Column:
    """The longest affix that leaves more than ``spare`` characters, or ''."""
    if not affixes:
        return F.lit("")
    any_of = "|".join(re.escape(a) for a in longest_first(affixes))
    # the shortest stem that an affix follows leaves the longest affix
    pattern = rf"(?s)\A({any_of})(?=.{{{spare + 1}}})" if front else rf"(?s)\A.{{{spare + 1},}}?({any_of})\z"
    return F.regexp_extract(word, pattern, 1)


def longest_affix(word: Column, affixes: list[str], front: bool) -> Column:
    """The longest affix that is shorter than the word, or ''."""
    return _affix(word, affixes, front, 0)


def split_marked(word: Column) -> Column:
    """Segmentation with boundary marks: words of at most three characters stay as they are."""
    low = F.lower(word)

    def with_prefix(p: Column) -> Column:
        rest = F.substr(low, F.length(p) + 1)
        return T.let(
            _affix(rest, R.SUFFIXES + R.INFLECTIONS, False, 2),
            lambda s: F.filter(
                F.array(
                    F.when(p != "", F.concat(p, F.lit(R.MARKER))).otherwise(""),
                    F.substr(rest, F.lit(1), F.length(rest) - F.length(s)),
                    F.when(s != "", F.concat(F.lit(R.MARKER), s)).otherwise(""),
                ),
                lambda x: x != "",
            ),
        )

    return F.when(F.length(word) <= 3, F.array(word)).otherwise(T.let(_affix(low, R.PREFIXES, True, 2), with_prefix))


def split_plain(word: Column, prefixes: list[str] | None = None, suffixes: list[str] | None = None) -> Column:
    """Segmentation without marks: an affix only has to be shorter than the word."""
    prefixes = R.PREFIXES if prefixes is None else prefixes
    suffixes = R.SUFFIXES + R.INFLECTIONS if suffixes is None else suffixes

    def with_prefix(p: Column) -> Column:
        rest = F.substr(word, F.length(p) + 1)
        return T.let(
            _affix(rest, suffixes, False, 0),
            lambda s: F.filter(F.array(p, F.substr(rest, F.lit(1), F.length(rest) - F.length(s)), s), lambda x: x != ""),
        )

    return T.let(_affix(word, prefixes, True, 0), with_prefix)


def marked_line(line: Column) -> Column:
    """A line whose words with a letter are segmented and joined without space."""
    return F.array_join(
        F.transform(T.tokens(line), lambda w: F.when(w.rlike(r"\p{L}"), F.array_join(split_marked(w), "")).otherwise(w)), " "
    )


def plain_line(line: Column, prefixes: list[str] | None = None, suffixes: list[str] | None = None) -> Column:
    """A line whose parts are words of their own; marks and bare punctuation pass through."""

    def parts(w: Column) -> Column:
        special = w.startswith("*") | w.startswith("[") | (w == "...")
        return T.let(
            T.strip_edges(w),
            lambda c: F.when(special | (c == ""), F.array(w)).otherwise(split_plain(F.lower(c), prefixes, suffixes)),
        )

    return F.array_join(F.flatten(F.transform(T.tokens(line), parts)), " ")
