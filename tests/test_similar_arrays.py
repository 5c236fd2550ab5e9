"""Lines of a key are compared in arrays: the same pairs as by brute force, and no further keys for a thousand lines."""

import random

from lexloom.operators import neardup


def test_lines_of_a_key_are_compared_where_they_are(spark, monkeypatch):
    r = random.Random(3)
    base = "".join(r.choice("etaoinshrdlu ") for _ in range(60))
    # two changed letters of sixty: all lines share some parts, few are similar
    lines = sorted({base[:i] + a + base[i + 1 : j] + b + base[j + 1 :] for a in "#%é" for b in "#%" for i in range(0, 58, 2) for j in range(i + 1, 60, 3)})[:1200]
    grams = [{t.encode()[i : i + 3] for i in range(len(t.encode()) - 2)} for t in lines]
    want = {(a, b) for b in range(len(lines)) for a in range(b) if len(grams[a] & grams[b]) >= 0.85 * len(grams[a] | grams[b])}
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    names, whole = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda d, name="table": names.append(name) or whole(d, name))
    got = {(x.a, x.b) for x in neardup.similar_pairs(df, 0.85, turns=1).collect()}
    assert got == want and len(lines) > 1000 and len(want) > 1000
    assert "gram-keys" not in names
