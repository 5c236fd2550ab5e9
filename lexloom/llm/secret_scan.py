"""Operator 7: secret scanning with DataFrame functions only.

Base spans come from three patterns. The method adds spans: candidate strings
of a character class are scanned with a sliding window whose Shannon entropy
is kept up to date from running character counts; windows above the class's
threshold are joined into one span per candidate unless an allow-list pattern
suppresses the candidate. Offsets are code points, the end is exclusive.

Null and empty texts have no spans. Rows are independent: repeated rows give
repeated results, other columns are ignored, an empty table gives an empty
result. Very long texts are one row and stay whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, with the shortest length of the tested group.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE_KINDS = (("assign", ASSIGN, 1, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: As HEX and ACCESS take whole runs, these find the same spans faster.
FAST = {"hex": r"[0-9a-f]{24,}", "access": r"AKIA[A-Z0-9]{16,}"}


@dataclass(frozen=True)
class EntropyClass:
    """Candidates of one alphabet, and from how many bits a window counts."""

    kind: str
    pattern: str
    alphabet: str
    window: int
    bits: float


CLASSES = (
    EntropyClass("ent_hex", r"[0-9A-Fa-f]{20,}", "0123456789abcdef", 20, 2.9501),
    EntropyClass(
        "ent_b64", r"[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.6501
    ),
)
#: Candidates that are no secrets: without a digit, only digits, dated or dotted numbers, UUIDs, word-like slugs.
ALLOW = (
    r"^[^0-9]*$",
    r"^[0-9_+/=-]*$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]+([-_/][A-Za-z]+)*([-_/]?[0-9]{1,4})?$",
)
#: Matches that are folded at once.
CHUNK = 256
SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"


def _found(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Spans of the matches whose group has at least ``least`` characters.

    The text between matches and the matches themselves give the offsets by
    running sums.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    parts = F.transform(
        F.arrays_zip(gaps.alias("g"), whole.alias("m"), tested.alias("t")),
        lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("m"), F.length(x["t"]).alias("t")),
    )

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (begin + x["m"]).alias("stop"))
        return F.struct(
            (begin + F.coalesce(x["m"], F.lit(0))).alias("at"),
            F.when(x["t"] >= least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    # appending copies the list, so matches are folded in chunks and only the chunks' lists are gathered
    def chunk(acc: Column, part: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("out"))
        return _let(F.aggregate(part, start, step), lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")))

    def folded(every: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / CHUNK).cast("int"))
        chunks = F.transform(starts, lambda i: F.slice(every, i * CHUNK + 1, F.lit(CHUNK)))
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(chunks, start, chunk, lambda a: F.flatten(a["out"]))

    return F.when(text.rlike(pattern), _let(parts, folded)).otherwise(F.array().cast(SPAN))


def _bits(count: Column) -> Column:
    """count * log2(count), 0 for 0."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hot_windows(candidate: Column, c: EntropyClass) -> Column:
    """(first, last) index of the windows whose entropy reaches the threshold; -1 if none.

    ``held`` is the sum of n*log2(n) over the window's character counts; a
    character that comes or leaves changes one count and so one term.
    """
    w = c.window
    chars = F.split(F.lower(candidate) if c.kind == "ent_hex" else candidate, "")
    codes = F.filter(F.transform(chars, lambda x: F.instr(F.lit(c.alphabet), x)), lambda x: x > 0)
    #: Each step has the character that comes and the one that leaves, 0 for none.
    steps = lambda a: F.arrays_zip(a.alias("came"), F.concat(F.array_repeat(F.lit(0), w), a).alias("left"))
    start = F.struct(
        F.array_repeat(F.lit(0), len(c.alphabet)).alias("n"),
        F.lit(0.0).alias("held"),
        F.lit(0).alias("i"),
        F.lit(-1).alias("first"),
        F.lit(-1).alias("last"),
    )

    def step(acc: Column, x: Column) -> Column:
        came, left = x["came"], x["left"]
        there = F.when(left > 0, F.element_at(acc["n"], left)).otherwise(F.lit(0))
        present = F.element_at(acc["n"], came) - F.when(left == came, 1).otherwise(0)
        return _let(
            F.struct(
                (acc["held"] - _bits(there) + _bits(there - 1) - _bits(present) + _bits(present + 1)).alias("held"),
                F.transform(
                    acc["n"], lambda v, k: v + F.when(k + 1 == came, 1).otherwise(0) - F.when(k + 1 == left, 1).otherwise(0)
                ).alias("n"),
                (acc["i"] + 1).alias("i"),
            ),
            lambda y: _let(
                (y["i"] >= w) & (F.lit(math.log2(w)) - y["held"] / w >= c.bits),
                lambda hot: F.struct(
                    y["n"].alias("n"),
                    y["held"].alias("held"),
                    y["i"].alias("i"),
                    F.when(hot & (acc["first"] < 0), y["i"] - w).otherwise(acc["first"]).alias("first"),
                    F.when(hot, y["i"] - w).otherwise(acc["last"]).alias("last"),
                ),
            ),
        )

    return _let(
        codes,
        lambda a: F.aggregate(
            F.filter(steps(a), lambda x: x["came"].isNotNull()),
            start,
            step,
            lambda z: F.struct(z["first"].alias("first"), z["last"].alias("last")),
        ),
    )


def _entropy(text: Column, c: EntropyClass, rank: int) -> Column:
    spans = _found(text, c.pattern, 0, c.window, c.kind, rank)

    def scan(s: Column) -> Column:
        word = F.substring(text, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))
        allowed = F.lit(False)
        for pattern in ALLOW:
            allowed = allowed | word.rlike(pattern)
        hot = F.when(~allowed, _hot_windows(word, c))
        return F.struct(s["start"].alias("s"), hot.alias("hot"))

    hits = F.filter(F.transform(spans, scan), lambda x: x["hot"].isNotNull() & (x["hot"]["first"] >= 0))
    return F.transform(
        hits,
        lambda x: F.struct(
            (x["s"] + x["hot"]["first"]).alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(c.kind).alias("kind"),
            (x["s"] + x["hot"]["last"] + c.window).alias("stop"),
        ),
    ).cast(SPAN)


def secret_spans(docs: DataFrame, text: str = "text", classes: tuple[EntropyClass, ...] = CLASSES) -> DataFrame:
    """``docs`` with the column ``secret_spans``: start, rank, kind, stop; by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    kinds = [
        _found(t, FAST.get(kind, pattern), group, least, kind, rank) for rank, (kind, pattern, group, least) in enumerate(BASE_KINDS)
    ]
    kinds += [_entropy(t, c, len(BASE_KINDS) + i) for i, c in enumerate(classes)]
    return docs.withColumn("secret_spans", F.array_sort(F.concat(*kinds)))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of their spans, and all spans."""
    out = secret_spans(docs.select("doc_id", "text")).select("doc_id", "secret_spans")
    s = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("bigint")
    return out.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter(s, lambda x: x["rank"] < len(BASE_KINDS))), 256).alias("base_sha256"),
        joined(s).alias("spans"),
    )
