"""Checks of keys with more than one value."""

from tidemark.operators import quality


def test_tasks_of_conflicts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "GROUP_ROWS", 100)
    rows = [(1, i % 3 * 1.0) for i in range(900)] + [(2, 5.0)] * 50 + [(3, None), (3, 1.0), (4, None), (None, 1.0), (None, 2.0), (5, 0.0), (5, -0.0)] + [(i, 1.0) for i in range(10, 53)]
    df = spark.createDataFrame(rows, "k int, value double").repartition(5)
    found = quality.conflicts(df, ["k"])
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 3, 900), (None, 2, 2)]
    assert found.rdd.getNumPartitions() == 10
    assert quality.conflicts(df.limit(0), ["k"]).count() == 0
