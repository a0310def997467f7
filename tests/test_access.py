"""Slices of curated tables, and every reason to refuse one."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.plans import access
from tidemark.plans.artifact import Refused


@pytest.fixture(scope="module")
def curated(spark):
    day = lambda m: dt.date(2024, m, 1)
    rows = [("loans", "TL", day(1), 1.0, None, None), ("loans", "TL", day(2), 2.0, 1.0, None), ("loans", "FX", day(1), 5.0, 5.0, None), ("old", "TL", day(1), 9.0, 9.0, day(2)), ("twice", "TL", day(1), 1.0, 1.0, None), ("twice", "TL", day(1), 2.0, 2.0, None)]
    facts = spark.createDataFrame(rows, "entity string, currency string, period date, value double, value_flow double, retired_on date")
    return access.Curated(facts, ("entity", "currency"), {"stock": "value", "cumulative_ytd": "value_flow"}, retired="retired_on")


def test_a_slice_is_one_series_with_the_values_its_semantics_call_for(curated):
    assert [(str(r.period), r.value) for r in access.load_slice(curated, "stock", {"entity": "loans", "currency": "TL"}).orderBy("period").collect()] == [("2024-01-01", 1.0), ("2024-02-01", 2.0)]
    assert [r.value for r in access.load_slice(curated, "cumulative_ytd", {"entity": "loans", "currency": "TL"}).orderBy("period").collect()] == [None, 1.0]


@pytest.mark.parametrize(
    ("semantics", "wanted", "says"),
    [("stock", {"bank": "x"}, "no columns"), ("ratio", {"entity": "loans"}, "no values of kind"), ("stock", {"entity": "nothing"}, "nothing has"), ("stock", {"entity": "old"}, "retired"), ("stock", {"entity": "loans"}, r"also name \['currency'\]"), ("stock", {"entity": "twice"}, "rows repeat")],
)
def test_ambiguous_retired_and_unknown_slices_are_refused(curated, semantics, wanted, says):
    with pytest.raises(Refused, match=says):
        access.load_slice(curated, semantics, wanted)


def test_empty_and_null_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "büyüme %12,5 oldu, 1.234 adet; 2024'te -3")], "i int, t string")
    got = {r.i: (r.s, r.n) for r in df.select("i", access.search_text([F.col("t")]).alias("s"), access.numbers_in_prose(F.col("t")).alias("n")).collect()}
    assert got[1] == ("", None) and got[2] == ("", []) and got[3][1] == [12.5, 1234.0, 2024.0, -3.0]
    assert access.quarter_starts(F.lit("2024-05-05").cast("date"), F.lit("2023-01-01").cast("date")) is not None


def test_numbers_in_prose_are_read_as_written(spark):
    told = {
        "3.5": [3.5], "12.5%": [12.5], "%12,5": [12.5], "1,234.5": [1234.5], "1.234,5": [1234.5], "678.970": [678970.0], "1.234.567": [1234567.0], "1,234,567": [1234567.0], "2024-05": [], "2024-05-17'de": [], "05.03.2021 günü 7": [7.0],
        "2021-2025 arası": [2021.0, 2025.0], "-%52,2": [52.2], "-3,25 puan": [-3.25], "(-4)": [-4.0], "0.5.": [0.5], "12,": [12.0], "1.2.3": [], "x1 v2.0": [], "1.5 milyon, 2 kez": [1.5, 2.0], "12345.678": [12345.678], "": [],
    }
    df = spark.createDataFrame(list(told.items()), "t string, want array<double>")
    for r in df.select("t", "want", access.numbers_in_prose(F.col("t")).alias("got")).collect():
        assert r.got == r.want, r.t


def test_only_claims_need_support(spark):
    claims = spark.createDataFrame([(1, "60 ayda, 2021 yılında (202512) %80,2 daraldı"), (2, "245.3 oldu"), (3, "150 adet, 1.234"), (4, "100,04"), (5, None)], "k int, t string")
    facts = spark.createDataFrame([(1, -80.21), (2, 245.34), (3, 900.0), (3, None), (4, 100.0)], "k int, v double")
    assert sorted((r.k, r.number) for r in access.unsupported_numbers(claims, facts, "k", "t", "v").collect()) == [(3, 150.0), (3, 1234.0)]


def test_search_text_keeps_first_spellings_in_order_and_is_fast(spark):
    df = spark.createDataFrame([("Kredi KREDİ konut", "Konut kredi Çek cek")], "a string, b string")
    assert df.select(access.search_text([F.col("a"), F.col("b")]).alias("s")).first().s == "Kredi konut Çek"
    long = spark.range(1).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("w"), i % 15_000))).alias("t"))
    assert len(long.select(access.search_text([F.col("t")]).alias("s")).first().s.split()) == 15_000


def test_hierarchies_read_their_rows_once(spark):
    rows = [("a", "top", 10.0), ("a", "x", 4.0), ("a", "y", 5.0), ("a", "x1", 1.0), ("a", "x2", None), ("b", "top", 3.0), ("b", "x", 3.0), ("c", "x", 1.0), ("c", "x1", 9.0), ("d", "top", 50.0), ("d", "top", 3.0), ("d", "y", 3.0)]
    df = spark.createDataFrame(rows, "k string, code string, v double")
    parent_of = spark.createDataFrame([("x", "top"), ("y", "top"), ("x1", "x"), ("x2", "x"), ("y", "other")], "code string, parent string")
    found = quality.hierarchy_differences(df, ["k"], parent_of, "code", "v", absolute=0.5)
    assert sorted((r.k, r.parent, r.parent_value, r.children_sum) for r in found.collect()) == [("a", "top", 10.0, 9.0), ("a", "x", 4.0, 1.0), ("c", "x", 1.0, 9.0), ("d", "top", 50.0, 3.0)]
    assert found.columns == ["k", "parent", "parent_value", "children_sum", "difference"]


def test_checks_on_empty_and_null_rows(spark):
    none = spark.createDataFrame([], "k string, label string, v double, t double, f double, c int")
    assert quality.risk_weight_differences(none, ["k"], "label", "v", "t").count() == quality.missing_flows(none, ["k"], "v", "f").count() == quality.broken_sequences(none, ["k"], "c").count() == 0
    rows = spark.createDataFrame([("a", "%20 risk", 100.0, 70.0, None, 1), ("a", "50 % risk", 100.0, 70.0, 1.0, 2), ("b", None, 5.0, 9.0, None, 2), ("b", "x", None, 9.0, None, None)], none.schema)
    assert [r.k for r in quality.risk_weight_differences(rows, ["k"], "label", "v", "t").collect()] == ["b"]
    assert {r.k: r.n_missing for r in quality.missing_flows(rows, ["k"], "v", "f").collect()} == {"a": 1, "b": 1}
    assert [r.k for r in quality.broken_sequences(rows, ["k"], "c").collect()] == ["b"]
