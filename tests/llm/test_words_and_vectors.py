"""Tree-joined BPE against the tokenizer library, spelling variants and vector codes against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lexloom.llm import spelling, vector_codes, word_bpe
from lexloom.llm.piece_bpe import model_bytes
from lexloom.llm.queries import tokenizer_path

# ------------------------------------------------------------------ 11


@pytest.fixture(scope="module")
def raw():
    return model_bytes(tokenizer_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library(raw):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(raw.decode())


ALPHABETS = ("ab", "aab", "abcdefghijklmnopqrstuvwxyz", "äöüßÉ", "!?.-'", "thecat", "日本語テキスト", "és̀", "😀👍🏽")
TEXTS = [
    "",
    " ",
    "Hello<|endoftext|>World <|startoftext|> it's I'LL don't <|nothing|>",
    "ΑΣ Σ ΣΑΣ İstanbul ǅ ﬁ Å̊",
    "a b c　d\x85e\x1cf\tg\r\nh\x0bi",
    "1234 ¼ ² Ⅷ ٣ x1y2",
    "\U00010d50Ɤ new letters Ᲊ",
    "\x00\x01 control ﻿​",
    "x" * 5_000,
    "the quick brown fox " * 300,
]


@pytest.mark.parametrize("leaf", [2, 3, 7, word_bpe.LEAF])
def test_ids_equal_library(raw, library, leaf):
    tok = word_bpe.WordTokenizer(raw, leaf=leaf)
    rng = random.Random(leaf)
    texts = TEXTS + ["".join(rng.choice(a) for _ in range(rng.randint(1, 150))) for a in ALPHABETS for _ in range(60)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert tok.encode(text) == want, text[:80]
        assert tok.decode(want) == library.decode(want, skip_special_tokens=False)


def test_every_kind_of_character(raw, library):
    """Each block of code points by a few, so that categories and lower-casing are those of the library."""
    tok, rng = word_bpe.WordTokenizer(raw), random.Random(5)
    points = [c for block in range(0, 0x110000, 256) for c in rng.sample(range(block, block + 256), 2) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}a!{chr(c)}! {chr(c)}" for c in [*range(0x500), *points]]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert tok.encode(text) == want.ids, ascii(text)


def test_joins_agree_with_whole(raw):
    """Any cut of a word, joined again, gives the encoding of the whole word."""
    tok, rng = word_bpe.WordTokenizer(raw), random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice(rng.choice(ALPHABETS[:6])) for _ in range(rng.randint(2, 60))).encode()
        symbols = tok.base(word)
        at = rng.randrange(len(symbols) + 1)
        assert tok.joined(tok.merged(symbols[:at]), tok.merged(symbols[at:])) == tok.merged(symbols)


def test_merge_order_by_rescans(raw):
    """The agenda against the rule itself: the lowest rank, from the left, again and again."""
    tok, rng = word_bpe.WordTokenizer(raw), random.Random(8)
    for n in (1, 5, 31, 32, 33, 80):
        symbols = tok.base("".join(rng.choice("etaoins") for _ in range(n)).encode())
        plain = list(symbols)
        while True:
            ranked = [(r, i) for i in range(len(plain) - 1) if (r := tok.rank.get(plain[i] << 32 | plain[i + 1])) is not None]
            if not ranked:
                break
            r, i = min(ranked)
            plain[i : i + 2] = [tok.made[r]]
        assert tok.merged(symbols) == plain


def digest(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    plain = library.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()


def test_word_digests(spark, raw, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "y"), (3, "again", "z"), (3, "again", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(word_bpe.digests(docs, raw).collect(), key=str)
    assert [tuple(r) for r in got] == sorted((tuple(digest(library, d, t)) for d, t, _ in rows), key=lambda r: str(spark_row(r)))
    assert word_bpe.digests(docs.limit(0), raw).count() == 0
    full = {r.doc_id: r for r in word_bpe.encoded(docs.filter("doc_id = 2"), raw).collect()}
    assert full[2].ids == library.encode(TEXTS[2], add_special_tokens=False).ids and "<|endoftext|>" in full[2].decoded


def spark_row(r):
    from pyspark.sql import Row

    return Row(doc_id=r[0], n_tokens=r[1], ids_sha256=r[2], decoded_sha256=r[3])


def test_giant_texts_are_shared_out(spark, raw, library):
    """Leaves as rows and their joins give the digests of the whole texts."""
    rng = random.Random(4)
    run = lambda n: "".join(rng.choice("etaoinshrdlé") for _ in range(n))
    texts = [run(900), "a b " + run(333) + "<|endoftext|>" + run(500) + "!!!" * 90 + " c", "short", " ".join(run(5) for _ in range(200)), "z" * 700]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {tuple(r) for r in word_bpe.digests(docs, raw, leaf=16, giant=100).collect()}
    assert got == {tuple(digest(library, i, t)) for i, t in enumerate(texts)}


def test_other_models_are_refused(raw):
    import json

    spec = json.loads(raw)
    for change in ({"decoder": {"type": "BPEDecoder"}}, {"normalizer": None}, {"model": spec["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError):
            word_bpe.WordTokenizer(json.dumps(spec | change).encode())


# ------------------------------------------------------------------ 12


def brute_variants(docs):
    counts = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, close = {}, {}
    for w in n:
        others = [v for v in n if v != w and near(w, v)]
        close[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], close[w], n[form[w]] if form[w] is not None else None))
    return out


def test_spelling_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdeéüÿ") for _ in range(rng.randint(6, 11))) for _ in range(12)]
    docs = []
    for doc_id in range(120):
        words = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.6)), len(base) - 1)]
            if rng.random() < 0.08:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", rng.choice("abé"), w[at] * 2]) + w[at + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((doc_id, rng.choice([" ", "1", ", "]).join(words)))
    docs += [(None, "NULLword NULLword"), (500, None), (501, ""), (3, docs[3][1]), (3, docs[3][1]), (502, "É" * 20 + "x" + "÷" * 8), (503, "É" * 20 + "x" + "÷" * 8)]
    # a chain of forms
    docs += [(600 + i, "chainab " * 10) for i in range(80)] + [(700 + i, "chainac " * 10) for i in range(6)] + [(710 + i, "chainacd") for i in range(4)]
    rows = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], "doc_id long, text string, word string, n string")
    want = brute_variants(docs)
    assert {tuple(r) for r in spelling.variants(rows).collect()} == want
    assert any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want)


def test_spelling_awkward(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).count() == 0
    long = "qwertyuiop" * 3_000
    rows = [(i, long) for i in range(3)] + [(i, long[1:]) for i in range(3, 6)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 2 and all(r.n_near == 1 and r.form is None and r.root == r.word for r in got.values())


def test_deletion_keys():
    for word in ("aabbb", "abc", "a", "éé", "abcabc"):
        parts = {word[:i] + word[i + 1 :] for i in range(len(word))}
        keys = spelling.keys_of(word).tolist()
        assert len(keys) == len(set(keys)) == 1 + len(parts)
        # a deletion's key is the key of that word
        assert set(keys[1:]) == {int(spelling.keys_of(p)[0]) for p in parts if p} | ({0} if "" in parts else set()) or "" in parts


def test_root_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100 + i, 40) for i in range(5)]
    got = {r.id: r.root for r in spelling.roots(spark.createDataFrame(links, "id long, root long")).collect()}
    assert got == {a: 40 for a, _ in links}


# ------------------------------------------------------------------ 13


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd in integers: every distance at every round."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(4096 * np.float64(np.float32(c)))) for c in v] for _, v, _ in kept], dtype=np.int64).reshape(len(kept), parts, -1)
    order = sorted(range(len(kept)), key=lambda k: kept[k][0])[:entries]
    books = np.stack([x[order, p] for p in range(parts)])

    def assign():
        d = np.stack([((x[:, p, None, :] - books[p][None]) ** 2).sum(2) for p in range(parts)], axis=1)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[code[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    code, d = assign()
    error = d.sum(1)
    by = collections.Counter()
    for (_, _, label), e in zip(kept, error, strict=True):
        by[label] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return {(i, bytes(c.astype(np.uint8)).hex(), int(e), by[label], digest) for (i, _, label), c, e in zip(kept, code, error, strict=True)}


SCHEMA = "vec_id long, embedding array<float>, label int, code string, ints int"


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties", "few"])
def test_codes_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    n = {"few": 9}.get(kind, 400)
    v = rng.normal(0, 0.2, (n, 16))
    if kind == "clusters":
        v = rng.normal(0, 0.5, (6, 16))[rng.integers(0, 6, n)] + rng.normal(0, 0.01, (n, 16))
    if kind == "ties":
        v = rng.integers(-2, 3, (n, 16)) / 4096
    rows = [(int(i), [float(np.float32(c)) for c in v[i]], None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(n)]
    rows += [(n + 1, None, 1), (n + 2, [None] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [float("inf")] + [0.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(3)
    assert {tuple(r) for r in vector_codes.codes(df).collect()} == brute_codes(rows)


def test_bounds_save_scans():
    """Bounds decide nothing otherwise, and scans get fewer as entries settle."""
    rng = np.random.default_rng(1)
    x = np.floor(4096 * (rng.normal(0, 0.5, (16, 32))[rng.integers(0, 16, 3000)] + rng.normal(0, 0.03, (3000, 32)))).astype(np.int64)
    books = x[:16].reshape(16, 8, 4).swapaxes(0, 1).copy()
    b, scans = vector_codes.Bounds(x, 8, 4), []
    for k in range(6):
        before = b.scans
        b.assign(books, k == 0)
        scans.append(b.scans - before)
        d = ((b.x[:, :, None, :] - books[None]) ** 2).sum(3)
        assert (b.code == d.argmin(2)).all()
        total = b.sums(16)
        new = np.where(total[:, :, :1] > 0, total[:, :, 1:] // np.maximum(total[:, :, :1], 1), books)
        b.widen(np.sqrt(((new - books).astype(float) ** 2).sum(2)) * (1 + vector_codes.SLACK))
        books = new
    assert scans[0] == 8 * 3000 and scans[-1] < scans[0] // 5


def test_codes_awkward(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes.codes(empty).count() == 0
    bare = spark.createDataFrame([(1, [], 1, "x", 1), (2, [], None, "x", 1)], SCHEMA)
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.codes(bare).collect()} == {(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0)}
    mixed = [(1, [0.5] * 8, 1, "x", 1), (1, [0.5] * 8, 1, "x", 1), (2, [0.1] * 16, 1, "x", 1), (None, [0.25] * 8, 2, "x", 1)]
    got = sorted((r.vec_id or 0, r.code or "", r.error) for r in vector_codes.codes(spark.createDataFrame(mixed, SCHEMA)).collect())
    assert got == [(0, "02" * 8, 0), (1, "00" * 8, 0), (1, "00" * 8, 0), (2, "", None)]
    with pytest.raises(Exception, match="components have to be below"):
        vector_codes.codes(spark.createDataFrame([(1, [1e9] * 8, 1, "x", 1)], SCHEMA)).count()
