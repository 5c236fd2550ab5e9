"""Hand vectors, loops on the driver and metamorphic checks for the curation operators."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import cleaners, morphology
from lexloom.functions import rules as R
from lexloom.functions import text as X
from lexloom.operators import curate, neardup
from lexloom.sources import corpora, sinks

LINES = "corpus string, doc_id long, pos long, line string"
VECTORS = [
    ("bnc_spoken", "   ", "empty", None),
    ("bnc_spoken", "<pause> something was said here", "corpus_specific", None),
    ("childes", "*MOT: look at the   big dog", None, "look at the big dog"),
    ("childes", "[laughs]", "corpus_specific", None),
    ("childes", "*CHI: [x] [y]", "low_alpha_ratio", None),
    ("childes", "look at that dog [points]", None, "look at that dog "),
    ("gutenberg", "*Chapter XI*", "corpus_specific", None),
    ("gutenberg", "This eBook is for everyone", "corpus_specific", None),
    ("open_subtitles", "00:00:01,000 --> 00:00:02,500", "corpus_specific", None),
    ("open_subtitles", "Unbelievable", "corpus_specific", None),
    ("simple_wiki", "= = = History = = =", "corpus_specific", None),
    ("switchboard", "A:\twell that is right", None, "well that is right"),
    ("switchboard", "a" * 9, "length", None),
    ("switchboard", "a" * 10, None, "a" * 10),
    ("switchboard", "b" * 500, None, "b" * 500),
    ("switchboard", "c" * 501, "length", None),
    ("switchboard", "aaaaaa1111", None, "aaaaaa1111"),
    ("other", "an unknown corpus stays", None, "an unknown corpus stays"),
    ("switchboard", "well that is right", "exact_duplicate", None),
    ("switchboard", "nbsp\u00a0and\u001cfile é ß", None, "nbsp and file é ß"),
]


def test_phase1_vectors(spark):
    df = spark.createDataFrame([(c, 1, i, line) for i, (c, line, _, _) in enumerate(VECTORS)], LINES)
    got = {r.pos: r for r in curate.phase1(df).collect()}
    for i, (corpus, line, reason, clean) in enumerate(VECTORS):
        assert got[i].reason == reason, (corpus, line)
        if reason is None:
            assert got[i].clean == clean
    rows = curate.stats(curate.phase1(df)).agg(F.sum("input_lines"), F.sum("output_lines")).first()
    removed = curate.reasons(curate.phase1(df)).agg(F.sum("n")).first()[0]
    assert rows[0] == len(VECTORS) and rows[1] + removed == rows[0]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("line", "reason"),
    [("visit WWW.example now please", "url"), ("a b c d e f g h i j;", None), ("a b c;", "code"), ("12.5, 44 | 91", "table_or_list"), ("see http://x {a};", "url"), ("plain words here", None)],
)
def test_content_reason(spark, line, reason):
    assert one(spark, line, cleaners.content_reason) == reason


def python_score(line):
    if not line:
        return 0.0
    n, t = len(line), line.split()
    p = sum(c in ".,;:!?" for c in line) / n
    punct = 15 if 0.02 <= p <= 0.1 else p / 0.02 * 15 if p < 0.02 else max(0, 1 - (p - 0.1) / 0.1) * 15
    grams = [tuple(t[i : i + 3]) for i in range(len(t) - 2)]
    repeat = len(set(grams)) / len(grams) * 10 if len(t) >= 3 else 10
    return min(n / 100, 1) * 20 + sum(c.isalpha() for c in line) / n * 40 + (1 - sum(c.isdigit() for c in line) / n) * 15 + punct + repeat


def test_quality_score(spark):
    lines = ["", "one", "a b c a b c a b c", "x" * 100, "x" * 101, "word, word. word! more; text:", "1234 5678 words", "é ß text with ²"]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select("x", X.quality_score(F.col("x")).alias("s"))
    for r in df.collect():
        assert r.s == pytest.approx(python_score(r.x), abs=0.011), r.x


WORDS = {
    "played": ("play@@ed", "play ed"),
    "Unhappily": ("un@@happi@@ly", "un happi ly"),
    "running": ("runn@@ing", "runn ing"),
    "quickly.": ("quickly.", "quick ly"),
    "reopened": ("re@@open@@ed", "re open ed"),
    "investigation": ("in@@vestiga@@tion", "in vestiga tion"),
    "under": ("un@@der", "un d er"),
    "need": ("need", "ne ed"),
    "red": ("red", "re d"),
    "sing": ("sing", "s ing"),
    "ness": ("nes@@s", "nes s"),
    "The": ("The", "the"),
    "CAT": ("CAT", "cat"),
    "*star": (None, "*star"),
    "...": (None, "..."),
}


def test_segmentation_vectors(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    out = df.select("w", F.array_join(morphology.split_marked(F.col("w")), "").alias("m"), morphology.plain_line(F.col("w")).alias("p"))
    for r in out.collect():
        marked, plain = WORDS[r.w]
        assert r.p == plain and (marked is None or r.m == marked), r


def loop_prefix(rows, target, nearest):
    total, kept = 0, []
    for row in rows:
        if total + row[1] > target:
            if nearest and abs(total + row[1] - target) < abs(total - target):
                kept.append(row[0])
            break
        total += row[1]
        kept.append(row[0])
    return kept


@pytest.mark.parametrize("total", [0, 37, 400, 100_000])
def test_budget_prefixes(spark, total):
    import hashlib

    rng = random.Random(total)
    rows = [(rng.choice(["childes", "gutenberg", "unknown"]), i, 0, " ".join(["w%d" % i] * rng.randrange(1, 9))) for i in range(200)]
    df = spark.createDataFrame(rows, LINES).withColumn("n_tokens", X.count_tokens(F.col("line")))
    key = lambda r: (hashlib.md5(f"42|{r[3]}".encode()).hexdigest(), r[1])
    for nearest, got in ((False, curate.budget_prefix(df, total)), (True, curate.nearest_prefix(df, total))):
        want = set()
        for corpus in ("childes", "gutenberg"):
            own = sorted((r for r in rows if r[0] == corpus), key=key)
            want |= set(loop_prefix([(r[1], len(r[3].split())) for r in own], int(total * R.MIXTURE[corpus]), nearest))
        assert {r.doc_id for r in got.select("doc_id").collect()} == want


def test_top_fraction_is_the_sorted_head(spark):
    rng = random.Random(3)
    rows = [("childes", i, 0, f"line {i}", float(rng.randrange(6))) for i in range(300)]
    df = spark.createDataFrame(rows, LINES + ", score double")
    for share in (0.0, 0.33, 0.5, 1.0):
        want = df.orderBy(F.desc("score"), X.order_hash(42, F.col("line")), "line").limit(int(300 * share))
        assert {r.doc_id for r in curate.top_fraction(df, share).collect()} == {r.doc_id for r in want.collect()}
    assert curate.top_fraction(df.limit(0), 0.5).count() == 0


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([("childes", i, 0, f"t{i % 7}") for i in range(50)], LINES)
    once = curate.keep_first(df, ["line"], ["doc_id", "pos"])
    assert {r.doc_id for r in once.collect()} == set(range(7))
    assert curate.keep_first(once, ["line"], ["doc_id", "pos"]).count() == 7


def test_greedy_resolution(spark):
    rng = random.Random(9)
    for _ in range(3):
        edges = sorted({tuple(sorted(rng.sample(range(25), 2))) for _ in range(40)})
        dropped: set = set()
        for i in range(25):
            if any(b == i and a not in dropped for a, b in edges):
                dropped.add(i)
        got = neardup.greedy_resolve(spark.createDataFrame(edges, "a long, b long"))
        assert {r.id for r in got.collect()} == dropped


def test_minhash_finds_similar_lines(spark):
    a = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(0, a), (1, a + "s"), (2, "completely different words are standing in this other line"), (3, "ab"), (4, "xy")]
    lines = spark.createDataFrame(rows, "id long, line string").withColumn("place", F.struct("id"))
    assert {r.id for r in neardup.greedy_duplicates(lines).collect()} == {1, 4}
    assert [(r.a, r.b) for r in neardup.exact_pairs(lines).collect()] == [(0, 1)]


def test_split_and_pairs(spark):
    df = spark.createDataFrame([(i, f"s{i}") for i in range(101)], "id long, s string")
    out = curate.hash_split(df, "s")
    assert out.filter("split = 'train'").count() == 90 and out.count() == 101
    raw = spark.createDataFrame([("a", "b", None, None, None), (None, None, "c", "d", "k"), ("x", None, None, None, None)], corpora.RAW_PAIR)
    assert [tuple(r) for r in corpora.normalise_pairs(raw).collect()] == [("a", "b", "unknown"), ("c", "d", "k")]


def test_sources_and_sinks(spark, tmp_path):
    d = str(tmp_path)
    os.makedirs(f"{d}/in")
    with open(f"{d}/in/childes.train", "w") as f:
        f.write("*MOT: hello there you\n\nsecond line of text\n")
    got = corpora.read_corpora(spark, f"{d}/in").orderBy("doc_id", "pos").collect()
    assert [r.line for r in got] == ["*MOT: hello there you", "", "second line of text"] and {r.corpus for r in got} == {"childes"}
    with open(f"{d}/v.vocab", "w") as f:
        f.write('<unk>\t0\n@@\t0\n<0x41>\t0\n"\t-1\n▁a\t-2.5\n')
    v = corpora.read_vocab(spark, f"{d}/v.vocab").orderBy("id").collect()
    assert [(r.id, r.piece, r.score, r.kind) for r in v] == [(0, "<unk>", 0, "special"), (1, "@@", 0, "user"), (2, "<0x41>", 0, "byte"), (3, '"', -1, "learned"), (4, "▁a", -2.5, "learned")]
    os.makedirs(f"{d}/p/data")
    with open(f"{d}/p/data/wh_island.jsonl", "w") as f:
        f.write('{"sentence_good": "a b", "sentence_bad": "b a", "x": 1}\n')
    assert [(r.subset, r.sentence_good) for r in corpora.read_pairs(spark, f"{d}/p").collect()] == [("wh_island", "a b")]
    for name, body in (("flat", '{"s1": 0.5, "s2": 1.0}'), ("wrapped", '{"scoring_method": "x", "results": {"s1": 0.5, "s2": 1.0}}')):
        with open(f"{d}/{name}.json", "w") as f:
            f.write(body)
        assert sorted((r.subset, r.value) for r in corpora.read_results(spark, f"{d}/{name}.json").collect()) == [("s1", 0.5), ("s2", 1.0)]
    scraped = spark.createDataFrame([("noise: 1\nAverage Accuracies:\nbpc: 0.5\nbad line\nbpb: x\n",)], "value string")
    assert [(r.metric, r.value) for r in corpora.scrape_averages(scraped).collect()] == [("bpc", 0.5)]
    assert corpora.read_rules(spark, f"{d}/none.json") == ([], [], "@@")
    assert sinks.phase_names(10_000_000, 0.7, 500_000) == {"phase2": "clean_10M_full", "phase3": "clean_10M_top70", "phase4": "clean_1M"}
    assert sinks.markdown(["a", "b"], [(1, None)]).splitlines()[-1] == "| 1 | - |"


def test_pipeline_and_stream(spark, tmp_path):
    from lexloom.plans import inputs, pipeline
    from lexloom.streaming import clean

    lines = inputs.lines(spark, "/root/testdata/sf0.001")
    result = pipeline.run(lines, target_tokens=30_000, sample_tokens=5_000)
    mixture = result["report"]["phases"]["phase4"]["mixture"]
    assert sum(r["tokens"] for r in mixture) > 0
    pipeline.write(result, str(tmp_path / "out"), 30_000, 0.7, 5_000)
    assert spark.read.text(str(tmp_path / "out" / "clean_1M")).count() == result["phase4"].count()
    lines.select("corpus", "doc_id", "pos", "line").write.json(str(tmp_path / "lines"))
    stream = clean.kept_lines(spark.readStream.schema(LINES).json(str(tmp_path / "lines")))
    q = stream.writeStream.format("memory").queryName("kept_stream").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = curate.phase1(lines).filter("reason IS NULL")
    assert spark.table("kept_stream").count() == batch.count()


@pytest.mark.parametrize("spare", [0, 2])
def test_affixes_are_the_longest_that_fit(spark, spare):
    import random

    from lexloom.functions import morphology as M
    from lexloom.functions import rules as R

    rng = random.Random(spare)
    both = [*R.PREFIXES, *R.SUFFIXES]
    words = [a + rng.choice(["", "x", "é😀", "xyz"]) + rng.choice(both) for a in both for _ in range(3)] + ["", "a", *both]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for affixes, front in ((R.PREFIXES, True), (R.SUFFIXES + R.INFLECTIONS, False)):
        for r in df.select("w", M._affix(F.col("w"), affixes, front, spare).alias("a")).collect():
            fits = (a for a in M.longest_first(affixes) if (r.w.startswith(a) if front else r.w.endswith(a)) and len(r.w) > len(a) + spare)
            assert r.a == next(fits, ""), r.w


def test_chain_longer_than_any_cap_resolves(spark):
    """Rows in a chain: every second one stays, however long the chain is."""
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert sorted(r.id for r in neardup.greedy_resolve(pairs).collect()) == list(range(1, 61, 2))
