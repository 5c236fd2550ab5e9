"""Similar pairs and the greedy rule against loops, orders of files, p-values, samples, broken rows."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import curate, minpair, neardup
from lexloom.sources import corpora, sinks


def grams(s):
    b = s.encode()
    return {b[i : i + 3] for i in range(len(b) - 2)}


def near_lines(rng):
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(50)]
    # lines of equal sets of grams, and lines without any
    out = {"ab", "a", "", "é", "éé", "abcabcabc", "abcabcabcabc"}
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 14))]
        for _ in range(rng.randint(1, 7)):
            line = list(base)
            if rng.random() < 0.7:
                line[rng.randrange(len(line))] = rng.choice(words)
            out.add(" ".join(line))
    return sorted(out)


@pytest.mark.parametrize(("threshold", "hot", "deepest", "frequent"), [(0.85, 500, 3, 1 << 16), (0.85, 2, 3, 40), (0.6, 20, 2, 40), (1.0, 2, 2, 0)])
def test_similar_pairs_brute_force(spark, threshold, hot, deepest, frequent):
    lines = near_lines(random.Random(1))
    sets = [grams(s) for s in lines]
    near = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b}
    want = {p: s for p, s in near.items() if s >= threshold}
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = {(r.a, r.b): r.similarity for r in neardup.similar_pairs(df, threshold, hot, deepest, frequent).collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in got)


def sequential(links, n):
    before: dict = {}
    for a, b in links:
        before.setdefault(b, []).append(a)
    kept: set = set()
    for v in range(n):
        if not any(u in kept for u in before.get(v, ())):
            kept.add(v)
    return set(range(n)) - kept


@pytest.mark.parametrize(("n", "links"), [(30, 40), (200, 230), (300, 1200)])
def test_greedy_equals_loop(spark, n, links):
    rng = random.Random(n)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(links)}
    assert {r.id for r in neardup.greedy_resolve(spark.createDataFrame(list(pairs), "a long, b long")).collect()} == sequential(pairs, n)


def test_greedy_chain_takes_few_rounds(spark):
    report: dict = {}
    pairs = [(i, i + 1) for i in range(9_999)]
    got = {r.id for r in neardup.greedy_resolve(spark.createDataFrame(pairs, "a long, b long"), report).collect()}
    assert got == set(range(1, 10_000, 2)) and report["rounds"] < 20


def test_greedy_lines_brute_force(spark):
    lines = near_lines(random.Random(6))
    rows = [(i, s, i) for i, s in enumerate([*lines, *lines[:20]])]
    kept: list = []
    want = set()
    for i, s, _ in rows:
        a = grams(s)
        if any((not a and not b) or (a and b and len(a & b) / len(a | b) >= 0.85) for b in kept):
            want.add(i)
        else:
            kept.append(a)
    df = spark.createDataFrame(rows, "id long, line string, place long")
    assert {r.id for r in neardup.greedy_duplicates(df, 0.85, exact=True).collect()} == want


def test_folder_is_read_in_name_order(spark, tmp_path):
    """Parts of unequal sizes, split into several tasks, with empty lines."""
    want = []
    for part, n in enumerate((5, 4_000, 50, 0, 1)):
        lines = [f"{part} {k} {'x' * (k % 40)}" if k % 7 else "" for k in range(n)]
        want += lines
        folder = tmp_path / "a b.train"
        folder.mkdir(exist_ok=True)
        (folder / f"part-{part:05d}.txt").write_text("".join(f"{line}\n" for line in lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = corpora.read_lines(spark, f"file://{tmp_path}/a b.train")
        assert rows.rdd.getNumPartitions() > 5
        assert [r.line for r in rows.orderBy("doc_id", "pos").collect()] == want
        numbered = corpora.numbered(rows, "doc_id", "pos").collect()
        assert {r.n: r.line for r in numbered} == dict(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ordered_write_and_manifest(spark, tmp_path):
    import json

    rng = random.Random(3)
    rows = [(rng.random(), f"line {k}") for k in range(500)]
    path = f"file://{tmp_path}/out"
    sinks.write_ordered(spark.createDataFrame(rows, "h double, line string").repartition(7), path, "h")
    assert [r.line for r in corpora.read_lines(spark, path).orderBy("doc_id", "pos").collect()] == [line for _, line in sorted(rows)]
    manifest = json.loads(spark.read.text(f"{path}_manifest", wholetext=True).first()[0])
    assert sum(m["lines"] for m in manifest) == 500 and [m["part"] for m in manifest] == sorted(m["part"] for m in manifest)


#: Published two-sided critical values of Pearson's r: (r, n, p).
CRITICAL = [(0.9969, 3, 0.05), (0.8783, 5, 0.05), (0.6319, 10, 0.05), (0.7646, 10, 0.01), (0.4438, 20, 0.05), (0.2787, 50, 0.05), (0.1966, 100, 0.05), (0.2565, 100, 0.01)]


def test_p_values(spark):
    rows = [*((r, n) for r, n, _ in CRITICAL), (0.0, 10), (1.0, 10), (-1.0, 10), (0.5, 2), (-0.4438, 20), (0.002, 1_000_000), (1e-5, 10**9)]
    got = [r.p for r in spark.createDataFrame(rows, "r double, n long").coalesce(1).select(minpair.p_column(F.col("r"), F.col("n")).alias("p")).collect()]
    for (_, _, p), g in zip(CRITICAL, got, strict=False):
        assert g == pytest.approx(p, rel=0.02)
    assert got[len(CRITICAL) : len(CRITICAL) + 5] == pytest.approx([1.0, 0.0, 0.0, 1.0, 0.05], abs=1e-3)
    assert got[-2:] == pytest.approx([0.0455, 0.7518], abs=1e-3)
    for (r, n), g in zip(rows[:-2], got[:-2], strict=True):
        assert g == pytest.approx(minpair.p_value(r, n), abs=1e-9)


def test_sample_of_k(spark):
    df = spark.createDataFrame([(i, f"t{i % 50}") for i in range(200)], "id long, t string").repartition(5)
    import hashlib

    want = sorted(range(200), key=lambda i: (hashlib.md5(f"42|t{i % 50}".encode()).hexdigest(), i))[:30]
    assert sorted(r.id for r in curate.sample_of(df, 30, F.col("t"), ["id"]).collect()) == sorted(want)
    assert curate.sample_of(df, 500, F.col("t"), ["id"]).count() == 200


def test_broken_rows_are_counted(spark, tmp_path):
    (tmp_path / "one").mkdir()
    rows = ['{"correct": "a", "incorrect": "b"}', '{"correct": "a", "incorr', '{"good_sentence": "a"}', '{"good_sentence": "a", "bad_sentence": "b", "category": "c"}', "not json", "[1, 2]"]
    (tmp_path / "one" / "p.jsonl").write_text("\n".join(rows) + "\n")
    path = f"file://{tmp_path}/one/p.jsonl"
    r = corpora.pair_file_report(spark, path).first()
    assert (r.folder, r["rows"], r.broken, r.malformed, r.pairs) == ("one", 6, 3, 1, 2)
    assert corpora.read_training_pairs(spark, path).count() == 2
    (tmp_path / "array.json").write_text('[{"correct": "a", "incorrect": "b"}, {"good_sentence": "c"}]')
    assert corpora.read_training_pairs(spark, f"file://{tmp_path}/array.json").count() == 1
