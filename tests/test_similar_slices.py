"""The similarity join in slices: the same pairs as by brute force, and no shuffle that outlives its slice."""

import random
import time

from pyspark.sql import functions as F

from lexloom.operators import neardup
from lexloom.session import written


def shuffled_files(spark) -> set[str]:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "shuffle_" in f}


def test_written_leaves_no_shuffle(spark):
    before = shuffled_files(spark)
    # held, so that no garbage collection can be what deletes them
    df = spark.range(1000, numPartitions=4).repartition(3)
    out = written(df)
    for _ in range(50):
        if not (left := shuffled_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 1000


def test_slices_lose_no_pair(spark, monkeypatch):
    r = random.Random(11)
    base = ["".join(r.choice("etaoinshrdlu ") for _ in range(n)) for n in (12, 40, 40, 120, 300)]
    lines = sorted({t[:i] + c + t[i + 1 :] for t in base for i in range(0, len(t), 7) for c in "#"} | set(base))
    grams = [{t.encode()[i : i + 3] for i in range(len(t.encode()) - 2)} for t in lines]
    want = {(a, b) for b in range(len(lines)) for a in range(b) if len(grams[a] & grams[b]) >= 0.85 * len(grams[a] | grams[b])}
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    names, whole = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda d, name="table": names.append(name) or whole(d, name))
    for hot in (500, 4):
        names.clear()
        got = {(x.a, x.b) for x in neardup.similar_pairs(df, 0.85, hot, turns=3).collect()}
        assert got == want and len(want) > 100
        assert names.count("gram-pairs") == (3 if hot == 500 else 9)
