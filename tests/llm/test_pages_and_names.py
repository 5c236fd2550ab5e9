"""Main text of generated pages against a version over their trees, and columns whose names clash with helper columns."""

import random
import re

import pytest

from lexloom.llm import html_extract
from lexloom.llm.html_extract import extract, smoothed, threshold

LONG = "long words of body text that go on and on for the reader. " * 4
CLASSES = (None, None, "content", "related", "ad", "reader-comments", "promo-code-guide", "replies-to-critics", "share", "nav-layout", "header")


# ------------------------------------------------------------------ pages as trees: (tag, class, children), leaves (tag, text, links)


def leaf(rng):
    kind = rng.random()
    if kind < 0.2:
        return rng.choice(["h1", "h2", "h3"]), f"Heading {rng.randrange(1000)}", 0
    if kind < 0.65:
        return "p", LONG[: rng.randrange(60, len(LONG))].strip() + str(rng.randrange(1000)), 0
    return "p", f"short {rng.randrange(1000)}", rng.randrange(4)


def tree(rng, depth=0, article=False):
    children = []
    for _ in range(rng.randrange(1, 5)):
        if depth < 3 and rng.random() < 0.45:
            tag = rng.choice(["div", "section", "div", "main" if not article and depth < 2 else "div", "article" if not article else "section"])
            children.append(tree_of(rng, tag, depth, article or tag in ("main", "article")))
        else:
            children.append(leaf(rng))
    return children


def tree_of(rng, tag, depth, article):
    name = None if tag in ("main", "article") else rng.choice(CLASSES)
    return tag, name, tree(rng, depth + 1, article)


def html_of(node):
    if not isinstance(node[2], list):
        tag, text, links = node
        return f"<{tag}>{text}{''.join(f'<a href=x>l{k}</a>' for k in range(links))}</{tag}>"
    tag, name, children = node
    mark = f' class="{name}"' if name else ""
    return f"<{tag}{mark}>{''.join(map(html_of, children))}</{tag}>"


def brute_text(root, sigma=1.0):
    """The rules of the module's docstring, over the tree and by the definitions."""
    lines = []  # text, tags, prose, path of (node, doubt)

    def walk(node, path, inside):
        if not isinstance(node[2], list):
            tag, text, links = node
            lines.append((text + "".join(f"l{k}" for k in range(links)), 1 + 2 * links, links == 0, path))
            return
        tag, name, children = node
        words = (name or "").split("-")
        sure = words[-1] in ("ad", "comments")
        maybe = any(w in ("related", "ad", "comments", "promo", "replies", "share", "nav") for w in words) or not inside and "header" in words
        doubt = name is not None and (sure or maybe)
        for c in children:
            walk(c, [*path, (id(node), tag, doubt, sure)], inside or tag in ("main", "article"))

    for c in root:
        walk(c, [], False)
    lines = [x for x in lines if x[0]]
    if not lines:
        return ""
    smooth = smoothed([len(t) / n for t, n, _, _ in lines], sigma)
    cut = threshold(smooth)
    votes = [len(x[0]) if s >= cut else 0 for x, s in zip(lines, smooth, strict=True)]
    plain = any(any(tag in ("main", "article") and not any(d for _, _, d, _ in path[: k + 1]) for k, (_, tag, _, _) in enumerate(path)) for _, _, _, path in every_path(root))

    def gone(path):
        for k, (node, _, doubt, sure) in enumerate(path):
            own = [(x, v) for x, v in zip(lines, votes, strict=True) if len(x[3]) > k and x[3][k][0] == node]
            chars, tags = sum(len(x[0]) for x, _ in own), sum(x[1] for x, _ in own)
            few = plain or 2 * sum(v for _, v in own) < sum(votes)
            if doubt and few and (sure or chars < cut * max(1, tags)):
                return True
        return False

    out = [gone(x[3]) for x in lines]
    held = [0 if o else v for o, v in zip(out, votes, strict=True)]
    total = sum(held)
    top = lambda path: next((n for n, tag, _, _ in path if tag in ("main", "article")), None)
    tops = {top(x[3]) for x, v in zip(lines, held, strict=True) if v} - {None}
    if tops and 2 * sum(v for x, v in zip(lines, held, strict=True) if top(x[3]) in tops) >= total:
        keep = [top(x[3]) in tops for x in lines]
    else:
        paths = [[n for n, _, _, _ in x[3]] for x in lines]
        voting = [p for p, v in zip(paths, held, strict=True) if v]
        if total:
            shared = []
            for level in zip(*voting, strict=False):
                if len(set(level)) > 1:
                    break
                shared.append(level[0])
        else:
            shared = every_path(root)[-1][3:4] and deepest_last(root)
        other = lambda prefix: sum(1 for x, p, o in zip(lines, paths, out, strict=True) if p[: len(prefix)] == prefix and not o and not x[2])
        while shared and other(shared[:-1]) == other(shared):
            shared = shared[:-1]
        keep = [p[: len(shared)] == shared for p in paths]
    return "\n".join(x[0] for x, k, o in zip(lines, keep, out, strict=True) if k and not o)


def every_path(root):
    """(None, None, None, path) of every container, empty ones too."""
    found = []

    def walk(node, path):
        if isinstance(node[2], list):
            words = (node[1] or "").split("-")
            sure = words[-1] in ("ad", "comments")
            inside = any(tag in ("main", "article") for _, tag, _, _ in path)
            maybe = any(w in ("related", "ad", "comments", "promo", "replies", "share", "nav") for w in words) or not inside and "header" in words
            path = [*path, (id(node), node[0], node[1] is not None and (sure or maybe), sure)]
            found.append((None, None, None, path))
            for c in node[2]:
                walk(c, path)

    for c in root:
        walk(c, [])
    return found or [(None, None, None, [])]


def deepest_last(root):
    return [n for n, _, _, _ in every_path(root)[-1][3]]


def pages(n, seed, article=False):
    rng = random.Random(seed)
    for _ in range(n):
        root = [("article", None, tree(rng, 1, True))] if article else tree(rng)
        yield root, "<html><head><title>T</title></head><nav><a href=x>Menu</a></nav>" + "".join(map(html_of, root)) + "<footer>foot</footer></html>"


def test_pages_brute_force():
    for root, page in pages(1_500, 1):
        assert extract(page) == brute_text(root), page


@pytest.mark.parametrize("part", ["smoothed", "threshold"])
def test_parts_of_the_method_decide_in_articles(monkeypatch, part):
    """Without smoothing, and without a threshold, blocks inside articles are judged otherwise on some pages."""
    every = [page for _, page in pages(400, 2, article=True)]
    assert all("<article>" in page for page in every)
    whole = [extract(page) for page in every]
    monkeypatch.setattr(html_extract, part, (lambda values, sigma: values) if part == "smoothed" else (lambda values: 0.0))
    assert sum(a != extract(page) for a, page in zip(whole, every, strict=True)) >= 5


BODY = "".join(f"<p>{LONG}</p>" for _ in range(9))


@pytest.mark.parametrize(
    ("page", "parts"),
    [
        (f"<div><h1>HEAD</h1><p>Intro {LONG}</p><div>{BODY}</div><p>Outro</p></div>", ("HEAD", "Intro", "Outro")),
        (f"<main><h1>HEAD</h1><p>Intro</p><article>{BODY}</article><p>Outro</p></main>", ("HEAD", "Intro", "Outro")),
        (f"<article>{BODY}{BODY}</article><article><h2>SECOND</h2>{BODY}</article>", ("SECOND",)),
        (f"<main><h1>HEAD</h1><article>{BODY}</article><article><h2>SECOND</h2>{BODY}</article></main>", ("HEAD", "SECOND")),
        (f"<article>{BODY}<section class='replies-to-critics'><p>Critics {LONG}</p></section></article>", ("Critics",)),
        (f"<article>{BODY}<div class='promo-code-guide'><p>Guide {LONG}</p></div></article>", ("Guide",)),
    ],
)
def test_no_part_of_an_article_is_lost(page, parts):
    got = extract(f"<body><nav><a>Menu</a></nav>{page}<footer>Foot</footer></body>")
    assert all(p in got for p in parts) and got.count(LONG.strip()) >= 9 and not re.search("Menu|Foot", got)


# ------------------------------------------------------------------ names

NAMES = ("__mark", "__id", "__tag", "__hits", "__items", "__n_words", "__row", "___n", "n_words", "hits", "items", "row", "n")


def test_helper_names_are_free(spark, tmp_path, monkeypatch):
    """Every stage keeps columns that are called like its helpers, with their values."""
    import corpus_pipeline
    from lexloom.llm import decontaminate

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [" ".join(word() for _ in range(40)) for _ in range(12)]
    texts += [texts[0], texts[1] + " more", "", ""]
    columns = ["doc_id", "text", *NAMES]
    docs = spark.createDataFrame([(i, t, *(f"{n}{i}" for n in NAMES)) for i, t in enumerate(texts)], ", ".join([f"doc_id long, text string, {', '.join(f'{n} string' for n in NAMES)}"]))
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[2]), (2, texts[3])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "exact_dedup", "near_dedup", "decontaminate"):
        got = stages[name](spark, docs, str(tmp_path))
        assert got.columns == columns
        for r in got.collect():
            assert [r[n] for n in NAMES] == [f"{n}{r.doc_id}" for n in NAMES]
    kept = {r.doc_id for r in stages["exact_dedup"](spark, docs, str(tmp_path)).collect()}
    assert kept == set(range(len(texts))) - {12, 15}
    clean = {r.doc_id for r in stages["decontaminate"](spark, docs, str(tmp_path)).collect()}
    assert clean == set(range(len(texts))) - {2, 3}
    items = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    for block_words in (1_000, 10):
        cut = decontaminate.remove_spans(docs, items, most_cover=1.0, block_words=block_words).collect()
        assert cut[0].asDict().keys() == set(columns) and {r.doc_id: r.text.strip() for r in cut}[2] == ""
        assert all([r[n] for n in NAMES] == [f"{n}{r.doc_id}" for n in NAMES] for r in cut)


def test_text_identifiers_and_rows_without(spark):
    """A doc_id given as text is read as a number; rows without one are held out."""
    from lexloom.llm import piece_bpe, quality, toxicity
    from lexloom.llm.queries import tokenizer_path

    rows = spark.createDataFrame([("7", "some text"), (None, "more text")], "doc_id string, text string")
    got = {r.doc_id for r in piece_bpe.digests(rows, piece_bpe.model_bytes(tokenizer_path())).collect()}
    assert got == {7, None}
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    for report in (quality.report, toxicity.report):
        assert {r.doc_id: r.held_out for r in report(rows.withColumn("doc_id", rows.doc_id.cast("long")), labels).collect()}[None] is True
