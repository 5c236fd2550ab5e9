"""Operators against brute force, the tokenizer library, and held-out labels, with the awkward inputs each has to take."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lexloom.llm import decontaminate, exact_dedup, html_extract, near_dedup, piece_bpe, quality, secret_scan, substring_dedup, token_count, toxicity
from lexloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, hits string, lang string"


def frame(spark, texts, first=0):
    """Documents with a clashing extra column and null elsewhere."""
    return spark.createDataFrame([(first + i, t, "x", None) for i, t in enumerate(texts)], DOCS)


def words(n, seed, size=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}é" for _ in range(n)]


LONG = " ".join(words(20_000, 1, 5000))
AWKWARD = [None, "", " ", "one", "one", "\t\n", "a b c", LONG, LONG, "é ß 日本 😀", "\x00"]


@pytest.fixture(scope="module")
def model():
    return piece_bpe.model_bytes(tokenizer_path())


# ------------------------------------------------------------------ 1


def test_html_regions():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>"
        "<div class='ad'>Buy now</div><aside>side</aside><article><h1>Head &amp; line</h1><p>First  <b>bold</b>\n text that is long enough to count.</p>"
        "<p>Short.</p><form><input>mail</form><p>Second paragraph, also long enough to be the content.<section class='comments'><p>me too</p></section></article>"
        "<div id=cookie-notice>We use cookies</div><footer>&copy; site</footer></body></html>"
    )
    assert html_extract.extract(page) == (
        "Head & line\nFirst bold text that is long enough to count.\nShort.\nSecond paragraph, also long enough to be the content."
    )


def test_html_whole_article():
    long, lead, end = "long text " * 90, "lead words " * 27, "end words " * 20
    wrap = lambda x: f"<body><div class=nav>Menu</div>{x}</body>"
    for page in (
        f"<article><h1>Head</h1><section><p>{long}</section><section><p>{lead}</section></article>",
        f"<article><h1>Head</h1><section><p>{long}</section><section><p>{lead}</section><section><p>{end}</section></article>",
        f"<article><h1>Head</h1><p>{lead}<blockquote><p>{long}</blockquote><p>{end}</article>",
        f"<article><p>{long}<h2 id='related-work'>Related work</h2><p>{lead}</article>",
        f"<article><p>{long}<div class='article-side'><p>{long.upper()}</div></article>",
        f"<div><h1>Head</h1><p>{lead}<blockquote><p>{long}</blockquote><p>{end}</div>",
    ):
        got = html_extract.extract(wrap(page))
        for part in (x for x in (long, long.upper(), lead, end, "Head<", "Related work<") if x in page):
            assert part.strip().rstrip("<") in got, (part[:20], page[:60])
        assert "Menu" not in got


def test_html_votes_decide(monkeypatch):
    """Without names and articles only the ratios tell content from a list of links."""
    links = "".join(f"<li><a href=/{i}>Go to part {i}</a></li>" for i in range(30))
    text = "".join(f"<p>{'plain words of the text ' * 12}</p>" for _ in range(4))
    page = f"<body><div><ul>{links}</ul></div><div><h2>Title</h2>{text}</div></body>"
    got = html_extract.extract(page)
    assert got.startswith("Title\nplain words") and "Go to" not in got
    monkeypatch.setattr(html_extract, "threshold", lambda values: 0.0)
    assert "Go to part 3" in html_extract.extract(page)


def test_html_doubtful_blocks():
    long = "long text of the article " * 30
    keep = (
        f"<article><div class='article-header'><h1>Title</h1></div><p>{long}</p></article>",
        f"<article><h1>Title</h1><p>{long} <span class='share'>market share</span> <math><mi>x</mi></math></p></article>",
        f"<div class='nav-layout'><article><h1>Title</h1><p>{long}</p></article></div>",
        f"<div class='content header'><h1>Title</h1><p>{long}</p></div>",
    )
    for page in keep:
        assert html_extract.extract(f"<body><nav>Menu</nav>{page}</body>").startswith("Title\n" + long.strip())
    assert html_extract.extract(keep[1]).endswith("market share x")
    for gone in (
        f"<section class='comments'><h2>Replies</h2><p>{'me too ' * 300}</p></section>",
        "<article class='comment'><p>first!</p></article>",
        "<div class='advert'><p>Buy this now, it is cheap and good for all of you.</p></div>",
        "<div class='share'><a>f</a> <a>t</a></div>",
        "<p>a<button>Click</button></p>",
    ):
        got = html_extract.extract(f"<body><main><h1>Title</h1><p>{long}</p>{gone}<p>The end.</p></main></body>")
        assert got.replace("\na\n", "\n") == f"Title\n{long.strip()}\nThe end.", gone[:40]


def test_html_broken_and_deep():
    import time

    assert html_extract.extract("<p>a<![foo[bar]]>b</p>") == "ab"
    rng = random.Random(1)
    marks = ["<", ">", "<![", "[", "]]>", "<!--", "-->", "<p>", "</p>", "<div class=ad>", "</div>", "a", "&amp", "&#x", '"', "<a href=", " ", "<script>", "</script>", "<?", "<td>", "<li>", "<svg>", "\x00"]
    for _ in range(3000):
        html_extract.extract("".join(rng.choice(marks) for _ in range(rng.randrange(25))))
    start = time.time()
    assert html_extract.extract("<div>x" * 50_000).count("x") == 50_000
    assert html_extract.extract("<div>x" * 25_000 + "</section>" * 25_000).count("x") == 25_000
    assert time.time() - start < 4


def test_html_awkward(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>x"), (3, None, "<p>x"), (4, "u", "plain"), (5, "u", "<nav>only</nav>"), (6, "u", "<p>" + "a " * 50_000)]
    got = {(r.page_id, r.text, r.n_chars) for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(1, "", 0), (2, "", 0), (3, "x", 1), (4, "plain", 5), (5, "", 0), (6, ("a " * 50_000).strip(), 99_999)}
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    clash = spark.createDataFrame([(1, "u", "<p>x", "y", 5)], "page_id long, url string, html string, text string, n_chars long")
    assert [tuple(r) for r in html_extract.main_text(clash).collect()] == [(1, "u", "x", 1)]


def test_smoothing_and_threshold():
    assert html_extract.smoothed([1.0, 1.0, 1.0], 1.0) == pytest.approx([1, 1, 1])
    assert 1 < html_extract.threshold([0.0, 1.0, 9.0, 10.0]) < 9


# ------------------------------------------------------------------ 2


@pytest.mark.parametrize("block", [10_000, 20])
def test_decontaminate_brute_force(spark, block):
    items = [("1", " ".join(words(20, 5, 6))), ("2", " ".join(words(13, 6, 6))), ("10", "Short ONE"), ("10", "short one"), ("3", None), ("4", "!!"), ("5", " ".join(words(30, 7, 6)))]
    texts = [*AWKWARD, items[0][1], "x " + items[0][1].upper() + " y", "a short one, short", " ".join(words(400, 8, 6)), (items[4][1] or "") + " " + (items[6][1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = frame(spark, texts)
    # rows come from a shuffle, twice each
    found = decontaminate.contamination(docs.unionAll(docs).repartition(5), bench, block_words=block)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, list(r["items"])))
    for i, t in enumerate(texts):
        assert len(got[i]) == 2 and got[i][0] == got[i][1]
        if t is not LONG:
            assert got[i][0] == decontaminate.brute_force(t, items)[:3], t
    assert decontaminate.contamination(docs.limit(0), bench, block_words=block).count() == 0


@pytest.mark.parametrize("block", [10_000, 20])
def test_decontaminate_spans(spark, block):
    """Spans above the length limit are cut, rows above the coverage limit go, by row and not by doc_id."""
    one, two, short = " ".join(words(20, 5)), " ".join(words(30, 6)), " ".join(words(15, 7))
    bench = spark.createDataFrame([(1, one), (2, two), (None, "a b"), (3, short)], "item_id long, text string")
    rest = " ".join(words(100, 8))
    rows = [(0, None), (1, f"{rest}, {one}! {rest} {two.upper().replace('É', 'é')}."), (1, rest), (2, two), (2, rest), (3, f"{rest} {short} end"), (4, "")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_words int").repartition(3)
    got = decontaminate.remove_spans(docs, bench, least_words=20, block_words=block)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(0, None), (1, f"{rest}, ! {rest} ."), (1, rest), (2, rest), (3, f"{rest} {short} end"), (4, "")], key=str)
    kept = decontaminate.clean(docs, bench, block_words=block)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 4] and kept.columns == docs.columns


def test_decontaminate_drops_only_contaminated(spark):
    item = " ".join(words(20, 5))
    docs = frame(spark, ["clean text", item, LONG + " " + item, None])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [0, 2, 3]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench.filter("item_id > 1")).collect()) == [0, 1, 2, 3]
    assert decontaminate.clean(docs, bench).columns == docs.columns


# ------------------------------------------------------------------ 3 and 5


def labelled(spark, n=600):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        good, bad = rng.random() < 0.6, rng.random() < 0.25
        t = words(rng.randrange(20, 60), i) + (["nastyword"] if bad else [])
        rng.shuffle(t)
        docs.append((i, " ".join(t) if good else " ".join(w.upper() + "!!" for w in t), "x", None))
        labels.append((i, int(good), int(bad)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(rows, labels, label):
    truth = {r.doc_id: r[label] for r in labels.collect()}
    return np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out])


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    rows = quality.report(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert held(rows, labels, "quality") > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_awkward(spark):
    docs = frame(spark, AWKWARD)
    some = spark.createDataFrame([(0, 1), (1, 0), (3, None), (4, 1), (4, 1)], "doc_id long, quality int")
    assert quality.report(docs, some).count() == len(AWKWARD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.report(docs, none).collect()} == {0.5}
    assert quality.report(docs.limit(0), some).count() == 0


def test_isotonic_is_monotone():
    edges = np.linspace(0, 1, 50)
    rng = np.random.default_rng(1)
    count = rng.integers(0, 9, 50).astype(float)
    level = quality.isotonic(edges, count, np.minimum(count, rng.integers(0, 9, 50)))
    assert (np.diff(level) >= 0).all() and level.min() >= 0 and level.max() <= 1


def test_quality_equals_plain_ridge(spark):
    """Weights and calibration of the summed equations against numpy over all rows at once."""
    docs, labels = labelled(spark, 300)
    stats = quality.stats_table(docs)
    rows = quality.training_rows(stats, labels, "quality", quality.F.lit(True), 10_000)
    model = quality.fit(rows)
    got = rows.collect()
    x, y, fold = np.array([r.stats for r in got]), np.array([r.y for r in got]), np.array([r.bucket for r in got]) % quality.FOLDS
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-5] = 1
    f = quality.features(np.clip((x - mean) / scale, -8, 8), model.omega, model.phase)
    ridge = np.diag([quality.RIDGE * len(y)] * (f.shape[1] - 1) + [1e-9])
    assert np.allclose(model.raw(x), f @ np.linalg.solve(f.T @ f + ridge, f.T @ y), atol=1e-5)
    raw = np.zeros(len(y))
    for i in range(quality.FOLDS):
        m = fold != i
        raw[~m] = f[~m] @ np.linalg.solve(f[m].T @ f[m] + ridge, f[m].T @ y[m])
    at = np.clip(np.rint((raw + 0.5) / 2 * (quality.BINS - 1)), 0, quality.BINS - 1).astype(int)
    level = quality.isotonic(model.edges, np.bincount(at, minlength=quality.BINS), np.bincount(at, y, minlength=quality.BINS))
    assert np.allclose(model.levels, level)


def test_toxicity_logit_by_loops():
    """The looked-up convolution and pooling against nested loops."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 1 << 62, (2, rng.integers(1, 30))).astype(np.uint64) * np.uint64(3) for _ in range(12)] * 4
    net = toxicity.train(texts, np.array([1.0, 0.0] * 24))
    net.compile()
    for h in texts[:12]:
        ids = net.ids(h)
        z = net.bias
        for i, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = 0.0
                for a in range(ids.shape[1] - w + 1):
                    r = sum((net.embed[ids[0, a + j]] + net.embed[ids[1, a + j]]) @ net.kernels[i][j][:, f] for j in range(w)) + net.biases[i][f]
                    best = max(best, r)
                z += best * net.out[i * toxicity.FILTERS + f]
        assert abs(z - net.logit(ids)) < 1e-3 * max(1, abs(z))
    other = toxicity.train(texts, np.array([1.0, 0.0] * 24), 5)
    other.compile()
    both = toxicity.mean_of([net, other])
    both.compile()
    for h in texts[:12]:
        ids = net.ids(h)
        assert abs(both.logit(ids) - (net.logit(ids) + other.logit(ids)) / 2) < 1e-3


def test_toxicity_gradients_by_differences():
    """Each parameter's gradient against a small step of it."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 1 << 62, (2, 9)).astype(np.uint64) * np.uint64(3) for _ in range(4)] * 3
    net = toxicity.train(texts, np.array([1.0, 0.0, 1.0, 0.0] * 3))
    ids, y = net.ids(texts[0]), 0.0

    def loss():
        x = net.embed[ids[0]] + net.embed[ids[1]]
        z = net.bias
        for i, w in enumerate(toxicity.WIDTHS):
            r = np.stack([sum(x[a + j] @ net.kernels[i][j] for j in range(w)) + net.biases[i] for a in range(len(x) - w + 1)])
            z += np.maximum(r.max(0), 0) @ net.out[i * toxicity.FILTERS : (i + 1) * toxicity.FILTERS]
        return np.log1p(np.exp(-z)) if y else np.log1p(np.exp(z))

    net.out *= 0.1
    grads = {name: np.zeros_like(p) for name, p in toxicity._parameters(net)}
    toxicity._backward(net, ids, y, 1.0, grads)
    for name, p in toxicity._parameters(net):
        flat, g = p.reshape(-1), grads[name].reshape(-1)
        for k in rng.choice(np.flatnonzero(g) if g.any() else [0], 5):
            old, step = flat[k], 1e-6
            flat[k] = old + step
            up = loss()
            flat[k] = old - step
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * step) - g[k]) < 1e-4 * max(1, abs(g[k])), name


def test_best_cut_tries_every_place():
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 40):
        z, y, w = rng.normal(size=n).round(1), rng.integers(0, 2, n).astype(float), rng.uniform(0.1, 2, n)
        cut = toxicity.best_cut(z, y, w)
        errors = lambda c: (w * ((z >= c) != (y == 1))).sum()  # noqa: B023, E731
        places = [z.min() - 1, *((a + b) / 2 for a, b in zip(sorted(set(z)), sorted(set(z))[1:], strict=False)), z.max() + 1]
        assert errors(cut) <= min(map(errors, places)) + 1e-9


def test_toxicity_repeated_labels(spark):
    docs, _ = labelled(spark, 40)
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels, "toxic", toxicity.F.lit(True), 100, 50)
    assert sorted(r[1] for r in rows) == [0.0, 0.0, 1.0, 1.0]


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    rows = toxicity.report(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert held(rows, labels, "toxic") > 0.95


def test_toxicity_awkward(spark):
    docs = frame(spark, AWKWARD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.report(docs, none).collect()} == {0.0}
    assert toxicity.report(docs.limit(0), none).count() == 0


# ------------------------------------------------------------------ 4 and 8

STRANGE = ["", " ", "  a  b ", "▁", "a▁b", "日本語\x00\t\n", "😀" * 9, " " * 77, "<s>x</s>", "<0x41>", "x" * 3000, "é ß 𒀀𒀁 the and"]


def test_pieces_equal_library(model):
    import sentencepiece

    sp, tok = sentencepiece.SentencePieceProcessor(model_proto=model), piece_bpe.MergeTokenizer(model)
    rng = random.Random(2)
    texts = STRANGE + ["".join(rng.choice("abe ▁.,#é\n日😀") for _ in range(rng.randrange(80))) for _ in range(300)] + [LONG[:20_000]]
    for t in texts:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert tok.encode(t) == ids
        assert tok.decode(ids) == sp.decode(ids)


def test_digests(spark, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    for r in piece_bpe.digests(frame(spark, AWKWARD), model).collect():
        ids = sp.encode(AWKWARD[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert [list(r.ids) for r in piece_bpe.encoded(frame(spark, ["a b"]), model).collect()] == [sp.encode("a b", add_bos=True, add_eos=True)]
    assert piece_bpe.digests(frame(spark, []), model).count() == 0


def test_counts_equal_library(spark, model):
    import sentencepiece

    raw = token_count.unigram_model(model)
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    rng = random.Random(4)
    texts = STRANGE + [None, LONG] + ["".join(rng.choice("theraniog ▁.é") for _ in range(rng.randrange(120))) for _ in range(300)]
    got = {r.doc_id: r.n_tokens for r in token_count.token_counts(frame(spark, texts), raw).collect()}
    assert got == {i: len(sp.encode(t or "")) for i, t in enumerate(texts)}


def test_counts_of_other_scores_and_long_texts(model):
    """Scores without a common step, many equal scores, and texts beyond the exact 32-bit sums."""
    import sentencepiece

    rng = random.Random(9)
    for kind in ("any", "few", "steep"):
        proto = piece_bpe.read_model(token_count.unigram_model(model))
        for p in proto.pieces:
            if p.type == 1:
                p.score = {"any": -rng.random() * 12, "few": -rng.randrange(1, 4), "steep": -rng.randrange(1, 400) * 256.0}[kind]
        raw = proto.SerializeToString()
        sp, counter = sentencepiece.SentencePieceProcessor(model_proto=raw), token_count.Counter(raw)
        texts = ["".join(rng.choice("theraniog .é日") for _ in range(rng.randrange(200))) for _ in range(60)] + ["the rain on " * 3000]
        assert [counter.count(t) for t in texts] == [len(sp.encode(t)) for t in texts]
    raw = token_count.unigram_model(model)
    sp, counter = sentencepiece.SentencePieceProcessor(model_proto=raw), token_count.Counter(raw)
    for n in (20_000, 300_000):
        text = "".join(rng.choice("theraniog é日") for _ in range(n))
        assert counter.count(text) == len(sp.encode(text))


def test_empty_tables(spark, model):
    docs = frame(spark, [])
    raw = token_count.unigram_model(model)
    assert piece_bpe.encoded(docs, model).count() == token_count.token_counts(docs, raw).count() == secret_scan.report(docs).count() == 0


def test_library_check_covers_known_parts(model):
    tok = piece_bpe.MergeTokenizer(model)
    tok.encode("the rain")
    tok.inner["t"] = tok.inner.get("t", b"") + b"\x01\x00\x00\x00"
    tok.inner["the"] = b"\x01\x00\x00\x00"
    tok.inner["▁the"] = b"\x01\x00\x00\x00"
    with pytest.raises(ValueError):
        tok.encode("the" + "日" + " the" + "日" + "the")


def test_wrong_models_are_refused(model):
    with pytest.raises(ValueError):
        piece_bpe.MergeTokenizer(token_count.unigram_model(model))
    with pytest.raises(ValueError):
        token_count.Counter(model)


# ------------------------------------------------------------------ 6


@pytest.mark.parametrize("budget", [1 << 26, 500])
def test_exact_groups(spark, budget):
    rng = random.Random(1)
    pool = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(12))) for _ in range(40)]
    texts = AWKWARD + [rng.choice(pool) for _ in range(300)]
    norm = lambda t: __import__("re").sub(rb"[\x20\x09-\x0d]+", b" ", (t or "").encode())
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(norm(t), []).append(i)
    rows = exact_dedup.exact_groups(frame(spark, texts).repartition(3), trie_bytes=budget).collect()
    assert len(rows) == len(texts)
    for r in rows:
        key = norm(texts[r.doc_id])
        assert (r.keep_id, r.group_size, r.kept) == (groups[key][0], len(groups[key]), r.doc_id == groups[key][0])
        assert r.text_sha256 == hashlib.sha256(key).hexdigest()
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_patricia_spills_and_counts():
    trie = exact_dedup.Patricia()
    for i, t in enumerate([b"abc", b"abd", b"ab", b"", b"abc", b"xyz"]):
        trie.insert(t, 10 - i, 1, i)
    spilled = {t: (n.owner, n.count) for t, n in trie.spill()}
    assert spilled == {b"abc": (6, 2), b"abd": (9, 1), b"ab": (8, 1)}
    assert {t: (n.owner, n.count) for t, n in trie.drain()} == {b"": (7, 1), b"xyz": (5, 1)}


# ------------------------------------------------------------------ 7


def test_secret_spans(spark):
    import re

    key = "AKIA" + "B2" * 10
    texts = [*AWKWARD, f"x {key} y AKIASHORT", "Password: hunter2x token='abc' api_key=abcdef1", "é😀 " + "0123456789abcdef" * 3, "token:token:abcdefgh", "zz 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b zz", "a" * 60, "id 123e4567-e89b-12d3-a456-426614174000"]
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    )
    for r in secret_scan.report(frame(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        found = sorted((m.start(), k, kind, m.end()) for k, (kind, p, g, least) in enumerate(kinds) for m in p.finditer(t) if len(m[g]) >= least)
        base = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t[:80]
        assert base in r.spans or all(x in r.spans.split(",") for x in base.split(",") if x)
        added = [x for x in r.spans.split(",") if x.startswith("ent_")]
        assert bool(added) == (r.doc_id in (13, 15)), (t[:80], added)


def test_secrets_many_matches(spark):
    """A text of more matches than one chunk holds: every span, in time that grows with the text."""
    import time

    text = "pässe token=abcdef1 " * 20_000
    start = time.time()
    r = secret_scan.report(frame(spark, [text])).first()
    assert time.time() - start < 20
    spans = r.spans.split(",")
    assert r.n_assign == 20_000 and spans[0] == "assign:6:19" and spans[-1] == f"assign:{20 * 19_999 + 6}:{20 * 19_999 + 19}"


def test_secret_windows_of_any_size(spark):
    one = (secret_scan.EntropyClass("ent_x", r"[A-Za-z0-9]{18,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 18, 3.0),)
    rows = secret_scan.secret_spans(frame(spark, ["x q7Rt2Lm9Xc4Vb8Nz1Ks6 y"]), classes=one).first()["secret_spans"]
    assert [(s.kind, s.start, s.stop) for s in rows] == [("ent_x", 2, 22)]


# ------------------------------------------------------------------ 9


def edited(base, n, seed):
    rng = random.Random(seed)
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("group", [256, 4])
def test_near_classes(spark, group):
    a, b = words(300, 11, 5000), words(300, 12, 5000)
    texts = [None, "", "...", "x y", "X, y!", " ".join(a), *[edited(a, 2, s) for s in range(30)], " ".join(b), edited(b, 3, 99), edited(b, 100, 98), LONG, LONG, " ".join(words(300, 13, 5000))]
    rows = {r.doc_id: r for r in near_dedup.near_classes(frame(spark, texts).repartition(3), group=group).collect()}
    assert len(rows) == len(texts)
    want = [0, 1, 2, 3, 3, *[5] * 31, 36, 36, 38, 39, 39, 41]
    assert [rows[i].class_id for i in range(len(texts))] == want
    assert all(rows[i].kept == (i == want[i]) for i in rows)
    assert near_dedup.near_classes(frame(spark, [])).count() == 0


def test_hot_key_star(spark):
    """Copies similar to their original only, in keys of many groups: the classes of comparing all pairs."""
    a = words(300, 21, 5000)
    texts = [*[edited(a, 5, 1000 + s) for s in range(1000)], " ".join(a)]
    docs = frame(spark, texts).repartition(3)
    small, whole = ({r.doc_id: r.class_id for r in near_dedup.near_classes(docs, group=g).collect()} for g in (8, 5000))
    assert small == whole
    assert sum(c == whole[1000] for c in whole.values()) > 900


@pytest.mark.parametrize("n", [3, 30, 900])
def test_chains_of_any_length(spark, n):
    """Links in a row, given in a random order of their nodes, and pairs beside them."""
    order = list(range(n))
    random.Random(n).shuffle(order)
    links = [(min(x, y), max(x, y)) for x, y in zip(order, order[1:])] + [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(5)]
    edges = spark.createDataFrame(links, "a long, b long").repartition(3)
    nodes = sorted({x for link in links for x in link})
    least = spark.createDataFrame([(x, 50_000 - x) for x in nodes], "node long, least long")
    got = {r.node: (r.root, r.label) for r in near_dedup.classes_of(edges, least).collect()}
    want = {x: (0, 50_001 - n) for x in range(n)} | {x: (x // 2 * 2, 50_000 - x // 2 * 2 - 1) for x in nodes if x >= 10_000}
    assert got == want
    assert near_dedup.classes_of(edges.limit(0), least).count() == 0


def near_roots(texts):
    """The smallest index of each text's class by comparing all pairs, and the classes that a pair within 0.003 of the threshold could change."""
    n, df, bags = len(texts), {}, []
    for t in texts:
        raw = (t or "").encode()
        h = near_dedup.shingles(near_dedup.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashes, 5)
        bags.append(dict(zip(*(x.tolist() for x in np.unique(h, return_counts=True)), strict=True)))
        for x in bags[-1]:
            df[x] = df.get(x, 0) + 1
    weight = {x: 0.75 + 0.25 * min(1, max(0, np.log((n + 200) / c) / np.log(200))) for x, c in df.items()}
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    edge = set()
    for i in range(n):
        for j in range(i):
            both = sum(min(bags[i][x], bags[j][x]) * weight[x] for x in bags[i].keys() & bags[j].keys())
            union = sum(c * weight[x] for b in (bags[i], bags[j]) for x, c in b.items()) - both
            if not both:
                continue
            if abs(both / union - 0.8) < 0.003:
                edge.add((i, j))
            elif both >= 0.8 * union and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return root, {root(i) for pair in edge for i in pair}


@pytest.mark.parametrize("n", [190, 210])
def test_near_classes_all_pairs(spark, n):
    """The classes of comparing all pairs by the weighted similarity, on either side of 200 rows."""
    rng = random.Random(n)
    bases = [words(rng.randrange(60, 200), 100 + i, 3000) for i in range(20)]
    texts = [edited(b := rng.choice(bases), rng.randrange(len(b) // 12), i) for i in range(n)]
    root, unsure = near_roots(texts)
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(frame(spark, texts).repartition(3)).collect()}
    assert len({root(i) for i in range(n)}) > 10 and len(unsure) < 20
    sure = [i for i in range(n) if root(i) not in unsure]
    assert len({(got[i], root(i)) for i in sure}) == len({got[i] for i in sure}), "texts of different classes were joined"
    # a pair at 0.8 is sampled with a probability of 0.9998: one link of them all may be missed
    assert len({got[i] for i in sure}) <= len({root(i) for i in sure}) + 1


def test_repeated_identifiers_and_nulls(spark):
    """One row of a group stays, by row and not by doc_id; a null doc_id comes last."""
    a, b = " ".join(words(60, 41, 5000)), " ".join(words(60, 42, 5000))
    rows = [(1, a), (1, a), (2, b), (1, b), (0, b + " "), (None, b), (None, "x y z"), (None, "x  y z"), (None, None), (7, ""), (8, None)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, tag string, n string").repartition(3)
    exact = sorted(((r.doc_id, " ".join((r.text or "").split())[:9]) for r in exact_dedup.keep_first(docs).collect()), key=str)
    assert exact == sorted([(1, a[:9]), (0, b[:9]), (1, b[:9]), (None, "x y z"), (7, "")], key=str)
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert found >= {(1, 1, 2, True), (None, None, 2, True), (None, 7, 3, False), (7, 7, 3, True), (0, 0, 1, True), (None, 1, 3, False)}
    near = [(r.doc_id, (r.text or "")[:9]) for r in near_dedup.keep_first(docs).collect()]
    assert sorted(x for x in near if len(x[1]) > 6) == sorted([(1, a[:9]), (0, b[:9])]) and exact_dedup.keep_first(docs).columns == docs.columns
    assert sum(x == (None, "x y z") or x == (None, "x  y z") for x in near) == 1
    assert exact_dedup.keep_first(docs.limit(0)).count() == near_dedup.keep_first(docs.limit(0)).count() == 0


def test_sampling_estimates_weighted_similarity():
    rng = np.random.default_rng(5)
    h = near_dedup.mix64(rng.integers(0, 1 << 62, 600).astype(np.uint64))
    w = rng.choice([1.0, 2.0, 0.75], 600)
    near_dedup_bands = near_dedup.signature(h[:500], w[:500]), near_dedup.signature(h[50:], w[50:])
    same = w[50:500].sum() / w.sum()
    hits = sum(x == y for x, y in zip(*near_dedup_bands, strict=True))
    assert 0 < hits < 16 and abs(hits / 16 - same**4) < 0.45
    sets = [np.sort((h[a:b] >> np.uint64(32)).astype(np.uint32).view(np.int32)) for a, b in ((0, 500), (0, 500), (200, 600))]
    levels = [np.full(len(s), 255, np.uint8) for s in sets]
    assert near_dedup.similar_pairs(sets, levels, 0.8).tolist() == [[True, True, False], [True, True, False], [False, False, True]]


# ------------------------------------------------------------------ 10


@pytest.mark.parametrize(("sent", "hot"), [(4_000_000, None), (0, None), (4_000_000, ((3, 15), (9, 19))), (0, ((3, 15), (9, 19)))])
def test_substrings_brute_force(spark, monkeypatch, sent, hot):
    if hot:
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        # workers read the levels of the module, so the second grams stay the default ones there
    rng = random.Random(6)
    base = "".join(rng.choice("abcdé ") for _ in range(3000))
    texts = [*AWKWARD, *[base[a : a + rng.randrange(300)] + "".join(rng.choice("xyz") for _ in range(rng.randrange(80))) for a in (rng.randrange(2900) for _ in range(40))], "ab" * 200, "q" * 500]
    raw = [(t or "").encode() for t in texts]
    want = substring_dedup.brute_force(raw, 60)
    passages = substring_dedup.brute_force_passages(texts, 9)
    rows = substring_dedup.cut_repeats(frame(spark, texts).repartition(3), length=60, gram=20, sent_anchors=sent, passage=9, word_gram=3).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t, s = raw[r.doc_id], want[r.doc_id]
        kept = b"".join(t[x:y] for x, y in zip([0, *[b for _, b in s]], [*[a for a, _ in s], len(t)], strict=True))
        assert (r.n_bytes, r.n_spans, bytes(r.kept)) == (len(t), len(s), kept)
        assert (r.n_passages, r.n_passage_words) == (len(passages[r.doc_id]), sum(b - a for a, b in passages[r.doc_id])), r.doc_id
    assert substring_dedup.report(frame(spark, [])).count() == 0


def test_passages_of_another_document(spark):
    """Repeats within one document are no passage; copies of it and edited ones are."""
    line, other = " ".join(words(60, 31, 5000)), " ".join(words(70, 32, 5000))
    texts = [f"{line} x {line}", f"a {other} b", f"c {other.replace(chr(119), chr(87))}! d", f"e {' '.join(other.split()[:50])} f", f"{line[:-1]}"]
    got = {r.doc_id: (r.n_passages, r.n_passage_words) for r in substring_dedup.report(frame(spark, texts)).collect()}
    assert got == {0: (2, 118), 1: (1, 70), 2: (1, 70), 3: (0, 0), 4: (1, 59)}


def test_windows_of_repeated_strings():
    rng = random.Random(8)
    for _ in range(40):
        n, letters = rng.choice((5, 8, 20)), rng.choice((b"ab", b"abc", bytes(range(97, 117))))
        base = bytes(rng.choice(letters) for _ in range(200))
        strings = [base[a : a + rng.randrange(60)] + bytes(rng.choice(letters) for _ in range(rng.randrange(30))) for a in (rng.randrange(150) for _ in range(6))]
        count: dict = {}
        for s in strings:
            for i in range(len(s) - n + 1):
                count[s[i : i + n]] = count.get(s[i : i + n], 0) + 1
        owner = np.arange(len(strings))
        got = substring_dedup.repeated([np.frombuffer(x, np.uint8) for x in strings], n, owner, owner)
        assert [g.tolist() for g in got] == [[count[s[i : i + n]] > 1 for i in range(len(s) - n + 1)] for s in strings]


# ------------------------------------------------------------------ pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 300)
    extra = [(1000 + i, t, "x", None) for i, t in enumerate(["copy of " + " ".join(words(80, 77)), "copy  of " + " ".join(words(80, 77)), " ".join(words(30, 78))])]
    every = docs.unionByName(spark.createDataFrame(extra, DOCS)).withColumnRenamed("hits", "source")
    bench = spark.createDataFrame([(1, " ".join(words(30, 78)))], "item_id long, text string")
    for name, df in (("documents", every), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert 1000 in got and 1001 not in got and 1002 not in got
    assert len(good & got) > 0.95 * len(good) and len(got - good - {1000}) < 0.05 * len(good)


def test_pipeline_brute_force(spark, tmp_path, model):
    """run() against its stages by plain loops; only the quality scores are taken from the operator."""
    import re

    import corpus_pipeline
    import sentencepiece

    docs, labels = labelled(spark, 150)
    rng = random.Random(5)
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = [texts[r.doc_id] for r in labels.filter("quality = 1").collect()]
    items = [(1, " ".join(words(30, 900))), (2, " ".join(words(13, 901)))]
    extra = [t.replace(" ", "  ") for t in good[:8]] + [edited(t.split(), 1, 7) for t in good[5:20]]
    extra += [f"{rng.choice(good)} {items[0][1]}", f"{good[3]} {good[4]} {items[1][1]}", items[1][1], None, "", "\t"]
    for i, t in enumerate(extra):
        texts[1000 + i] = t
    rows = [(i, t, "en", "s", 1) for i, t in sorted(texts.items())]
    every = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for name, df in (("documents", every), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    scores = {r.doc_id: r.predicted for r in quality.report(every, labels).collect()}
    left = [(i, t) for i, t in sorted(texts.items()) if scores[i]]
    seen = {}
    for i, t in left:
        seen.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), (i, t))
    left = sorted(seen.values(), key=lambda x: x[0])
    root, unsure = near_roots([t for _, t in left])
    plain = [(t or "").strip() for _, t in left]
    left = [x for k, x in enumerate(left) if root(k) == k or not plain[k] or root(k) in unsure]
    loose = {left[k][0] for k in range(len(left)) if unsure}
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    want = {}
    for i, t in left:
        n, hit, *_ = decontaminate.brute_force(t, [(str(k), b) for k, b in items])
        if hit == 0 or 20 * hit < n:
            ids = sp.encode(t or "", add_bos=True, add_eos=True)
            want[i] = (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not loose, "the fixture has a pair at the threshold"
    assert got == want and len(want) < len(texts) - 20


def test_pipeline_stages_awkward(spark, tmp_path):
    """Nulls, ties, repeated rows and clashing names in every stage, and the empty table."""
    import corpus_pipeline

    docs, labels = labelled(spark, 60)
    a = " ".join(words(60, 70))
    odd = [(i, t, "x", None) for i, t in ((None, a), (None, a), (5000, a), (5000, a), (5001, None), (5002, ""), (5002, "other " + a), (5003, "x"))]
    every = docs.unionByName(spark.createDataFrame(odd, DOCS)).withColumnRenamed("hits", "node").withColumn("tag", quality.F.lit(3)).withColumn("score", quality.F.lit(None).cast("double"))
    labels.unionByName(spark.createDataFrame([(None, 1, None), (5000, None, 1)], "doc_id long, quality int, toxic int")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (3, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, every, str(tmp_path))
        rows = out.collect()
        if name != "encode":
            assert out.columns == every.columns and set(rows) <= set(every.collect()), name
        kept = [(r.doc_id, r.text) for r in rows if r.doc_id is None or r.doc_id >= 5000] if name != "encode" else []
        if name == "exact_dedup":
            assert sorted(kept, key=str) == sorted([(5000, a), (5001, None), (5002, "other " + a), (5003, "x")], key=str) or sorted(kept, key=str) == sorted([(5000, a), (5002, ""), (5002, "other " + a), (5003, "x")], key=str)
        if name == "near_dedup":
            # texts without words are no copies; "other" adds one shingle of fifty-seven
            assert sorted(kept, key=str) == sorted([(5000, a), (5001, None), (5002, ""), (5003, "x")], key=str)
        if name == "decontaminate":
            assert (5003, "x") not in kept and len(kept) == len(odd) - 1
        if name == "encode":
            assert len(rows) == every.count()
        assert stage(spark, every.limit(0), str(tmp_path)).count() == 0, name
