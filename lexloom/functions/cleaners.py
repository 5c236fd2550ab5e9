"""Per-corpus line cleaners and first-match removal reasons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import rules as R
from lexloom.functions import text as T

_STAMP = r"\p{Nd}{1,2}:\p{Nd}{2}:\p{Nd}{2}[,.]\p{Nd}+"


def bnc_spoken(line: Column) -> Column:
    """Lines that open with a tag or bracket are dropped."""
    return F.when(line.rlike(r"^[<\[]"), "").otherwise(line)


def childes(line: Column) -> Column:
    """Speaker tag and bracketed annotations are cut out."""
    return F.regexp_replace(F.regexp_replace(line, r"^\*[A-Z]+:\s*", ""), r"\[.*?\]", "")


def gutenberg(line: Column) -> Column:
    """Chapter markers and boilerplate are dropped."""
    marked = F.lit(False)
    for m in R.BOOK_MARKERS:
        marked = marked | F.lower(line).contains(m)
    return F.when(line.rlike(r"(?i)^\*?CHAPTER\s+[IVXLCDM0-9]+\*?$") | marked, "").otherwise(line)


def open_subtitles(line: Column) -> Column:
    """Time spans are cut out, numbers and single words are dropped."""
    cut = F.regexp_replace(F.regexp_replace(line, rf"{_STAMP}\s*-->\s*{_STAMP}", ""), r"^\p{Nd}+$", "")
    return F.when(T.count_tokens(cut) == 1, "").otherwise(cut)


def simple_wiki(line: Column) -> Column:
    """Section headings are dropped."""
    return F.regexp_replace(line, r"^=+\s*.*?\s*=+$", "")


def switchboard(line: Column) -> Column:
    """Speaker tags are cut off."""
    return F.regexp_replace(line, r"^[AB]:\s*", "")


CLEANERS: dict[str, Callable[[Column], Column]] = {
    "bnc_spoken": bnc_spoken,
    "childes": childes,
    "gutenberg": gutenberg,
    "open_subtitles": open_subtitles,
    "simple_wiki": simple_wiki,
    "switchboard": switchboard,
}


def cleaned(corpus: Column, line: Column) -> Column:
    """The corpus's cleaner; unknown corpora keep the line."""
    out = None
    for name, f in CLEANERS.items():
        out = F.when(corpus == name, f(line)) if out is None else out.when(corpus == name, f(line))
    return out.otherwise(line)


def line_reason(norm: Column, clean: Column) -> Column:
    """First reason to drop a line before deduplication, null to keep it."""
    return (
        F.when(norm == "", "empty")
        .when(clean == "", "corpus_specific")
        .when(T.alpha_ratio(clean) < R.MIN_ALPHA, "low_alpha_ratio")
        .when(~F.length(clean).between(R.MIN_CHARS, R.MAX_CHARS), "length")
    )


def content_reason(line: Column) -> Column:
    """First content filter that a line meets, null if none."""
    return (
        F.when(T.has_url(line), "url")
        .when(T.code_share(line) > R.CODE_SHARE, "code")
        .when(T.table_share(line) > R.TABLE_SHARE, "table_or_list")
    )
