"""Signatures are compared band by band: the same pairs as from whole ones, which no table of classes or pairs holds."""

import random

from pyspark.sql import functions as F

from lexloom.operators import neardup


def test_signatures_are_compared_by_bands(spark, monkeypatch):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefghij ") for _ in range(300))
    texts = [base[:k] + "#" + base[k + 1 :] for k in range(0, 300, 15)] + [base[:k] for k in (200, 250, 280)] + ["", "ab"]
    lines = spark.createDataFrame([(i * 7, t) for i, t in enumerate(texts)], "id long, line string").withColumn("place", F.struct(F.col("id").alias("doc_id"), F.lit(0).alias("pos")))
    sig = {r.id: r.sig for r in neardup.signatures(lines).collect()}
    ids = sorted(sig)
    same = {(a, b): sum(x == y for x, y in zip(sig[a], sig[b], strict=True)) / 128 for a in ids for b in ids if a < b}
    # pairs of which some band is equal, as the join meets them; the first of equal signatures is compared with the others
    first = {i: min(j for j in ids if sig[j] == sig[i]) for i in ids}
    met = lambda a, b: any(sig[a][k : k + 16] == sig[b][k : k + 16] for k in range(0, 128, 16))
    want = {(a, b): s for (a, b), s in same.items() if first[b] == a or first[a] == a and first[b] == b and s >= 0.85 and met(a, b)}
    tables, whole = {}, neardup.written
    monkeypatch.setattr(neardup, "written", lambda d, name="table": tables.update({name: d.dtypes}) or whole(d, name))
    got = {(r.a, r.b): r.similarity for r in neardup.lsh_pairs(lines, 0.85).collect()}
    assert got == want and len(want) > 20
    assert not any(kind.startswith("array") for name in tables if name != "minhash" for _, kind in tables[name])
