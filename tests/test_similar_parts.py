"""The similarity join by equal parts: what similar lines share, and that long lines cost rows in proportion."""

import random

from pyspark.sql import functions as F

from lexloom.operators import neardup

LETTERS = "etaoin"


def test_parts_and_sketches(spark):
    r = random.Random(5)
    base = ["".join(r.choice(LETTERS + "shrdlu ") for _ in range(n)) for n in (20, 60, 200, 500)]
    lines = [t[:i] + "#" + t[i + 1 :] for t in base for i in range(0, len(t), 9)] + base
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    rows = neardup.sketches(neardup.gram_lists(df), 0.85, 2, 50).collect()
    by = {}
    for x in rows:
        by.setdefault(x.level, []).append(x)
    grams = [{t.encode()[i : i + 3] for i in range(len(t.encode()) - 2)} for t in lines]
    met = 0
    for level in by.values():
        for x in level:
            for y in level:
                if x.id < y.id and (x.own or y.own) and len(grams[x.id] & grams[y.id]) >= 0.85 * len(grams[x.id] | grams[y.id]):
                    met += 1
                    assert sum(p == q for p, q in zip(x.parts, y.parts, strict=True)) >= 2
                    bits = sum(bin((x[s] ^ y[s]) & (1 << 64) - 1).count("1") for s in neardup.SKETCH)
                    assert bits <= len(grams[x.id] ^ grams[y.id]) <= neardup.apart(x.n, y.n, 0.85)
    assert met > 100


def test_rows_of_keys(spark, monkeypatch):
    """Lines of the same grams, all of them hot: keys were extended by every further gram."""
    r = random.Random(7)
    lines = ["".join(r.choice(LETTERS) for _ in range(300)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    rows, whole = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda d, name="table": rows.append((name, (out := whole(d, name)).count())) or out)
    assert neardup.similar_pairs(df, 0.85, 5, 3).filter(F.col("a") == F.col("b")).count() == 0
    assert sum(n for name, n in rows if name == "gram-keys") < 60 * 300
