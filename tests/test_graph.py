"""Components of chains, and documents that merge through any key."""

import os

import pytest

from tidemark import shared
from tidemark.operators import graph, search


def test_chains_of_links_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30, 0, -1)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.id: r.component for r in graph.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 32)} | {100: 100, 101: 100}
    assert graph.components(edges.limit(0)).count() == 0


def test_documents_merge_along_a_long_chain(spark):
    rows = [(i, f"u{i // 2}", f"d{(i + 1) // 2}") for i in range(90)] + [(200, None, None), (201, "x", None), (202, "x", "y")]
    df = spark.createDataFrame(rows, "id long, url string, digest string")
    got = {r.id: r.canonical_id for r in search.merge_documents(df, "id", ["url", "digest"]).collect()}
    assert got == {i: 0 for i in range(90)} | {200: 200, 201: 201, 202: 201}


def test_discarded_tables_are_gone(spark):
    df = shared.materialize(spark.range(3))
    assert df.count() == 3
    shared.discard(df, None, spark.range(2))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound|FILE_NOT_EXIST"):
        df.collect()


def test_a_session_deletes_what_it_has_written(spark):
    shared.clear(spark)
    kept, gone = shared.materialize(spark.range(3)), shared.materialize(spark.range(4))
    shared.discard(gone)
    folder = shared.shared_folder(spark).removeprefix("file://")
    there = lambda: [f for f in os.listdir(folder) if f.startswith("tidemark-")]
    assert kept.count() == 3 and len(there()) >= 1
    before = len(there())
    assert shared.clear(spark) == 1 and shared.clear(spark) == 0 and len(there()) == before - 1
