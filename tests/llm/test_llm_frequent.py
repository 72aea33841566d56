from residuum.llm.frequent import most_frequent


def test_most_frequent_rows(spark):
    rows = [(f"k{i}", n) for i, n in enumerate([5000, 4000, 900, 7, 7, 7, 1, 1, 1, 1])]
    counts = spark.createDataFrame(rows, "key string, n long")
    assert sorted(r.n for r in most_frequent(counts, "n", 5).collect()) == [900, 4000, 5000]
    assert most_frequent(counts, "n", 6).count() == 6
    assert most_frequent(counts, "n", 100).count() == 10
    assert most_frequent(counts.limit(0), "n", 3).count() == 0
