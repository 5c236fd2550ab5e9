"""No table of words passes through the driver."""

from lexloom.llm import spelling


def test_no_broadcast(spark):
    docs = spark.createDataFrame([(i, "spelling spellings spelling walking walkings walking") for i in range(4)], "doc_id long, text string")
    words = spelling.written(spelling.counted(docs), "words").withColumn("id", spelling.F.monotonically_increasing_id())
    for df in (spelling.near_pairs(words), spelling.variants(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert {r.word: r.n_near for r in spelling.variants(docs).collect()}["spelling"] == 1
