"""Checks of a result, statements that reproduce columns, and spans of time in questions."""

import datetime as dt

import pytest

from tidemark.functions import windows
from tidemark.plans import findings
from tidemark.plans.artifact import Artifact, Line, Made, Quantity
from tidemark.plans.findings import Asked, examine


def table(spark, rows, **lines):
    frame = spark.createDataFrame([(dt.date(2021, m, 1), *values) for m, *values in rows], "period date, " + ", ".join(f"{c} double" for c in lines))
    return Artifact(frame, lines)


def failing(*args, **kw):
    return {f.check for f in examine(*args, **kw) if not f.passed}


LOANS = Line("loans", Quantity("stock", "milyon TL"), "monthly")
CITED = [{"column": "loans", "table": "observations"}]


def test_a_sound_result_passes_everything(spark):
    sound = table(spark, [(1, 1.0), (2, 2.0)], loans=LOANS)
    assert not failing(sound, citations=CITED) and all(f.stops or f.passed for f in examine(sound, citations=CITED))


@pytest.mark.parametrize(
    ("rows", "lines", "found"),
    [
        ([(1, 1.0), (1, 2.0)], {"loans": LOANS}, {"periods_occur_once"}),
        ([(1, None)], {"loans": LOANS}, {"columns_have_values", "columns_cover_the_periods"}),
        ([(1, 1.0)], {"loans": Line("loans", Quantity("stock", None))}, {"columns_have_units"}),
        ([(1, 1.0)], {"loans": Line("loans", Quantity(unit="adet"))}, {"columns_have_semantics"}),
        ([(1, 1.0)], {"loans": Line("loans", Quantity("stock", "adet"), citation={"unit_verified": False})}, {"external_units_are_verified"}),
        ([(1, 1.0)], {"gone": Line("gone", Quantity("rate", "%"), made=Made("change", ("nothing",), ("1",)))}, {"derived_columns_keep_inputs"}),
        ([(1, 1.0, 2.0)], {"loans": LOANS, "share": Line("share", Quantity("ratio", "%"), "monthly", made=Made("ratio", ("loans", "gone")))}, {"derived_columns_keep_inputs"}),
        ([(1, 1.0, 1.0)], {"loans": LOANS, "x": Line("x", Quantity("stock", "bin TL"), "monthly")}, {"fetched_columns_are_cited", "amounts_share_a_unit"}),
        ([(1, 1.0, 1.0)], {"loans": LOANS, "fx": Line("fx", Quantity("rate", "TL"), "daily")}, {"fetched_columns_are_cited", "columns_have_one_grain"}),
        ([(m, float(m), 1.0 if m % 3 == 0 else None) for m in range(1, 13)], {"loans": LOANS, "q": Line("q", Quantity("stock", "adet"), "quarterly", made=Made("sum_columns", ("loans", "q")))}, {"columns_have_one_grain", "derived_columns_have_one_grain"}),
    ],
)
def test_each_fault_is_found(spark, rows, lines, found):
    assert failing(table(spark, rows, **lines), citations=CITED) == found


def test_what_was_asked_and_not_given():
    asked = Asked(("anomaly",), ("no daily data",), ("external",), {"amount": "s1", "rate": "s1"})
    facts = [{"op": "chart", "chart": {"note": "two axes only", "dropped": ["x"]}}]
    assert failing(Artifact(), facts, failed=["step 0"], asked=asked) == {"answers_what_was_asked", "roles_are_different_series", "steps_ran", "analyses_ran", "charts_are_whole", "there_is_a_table"}
    assert not failing(Artifact(), asked=Asked(cleared=True))
    assert not failing(Artifact(), [{"op": "discover"}], asked=Asked(metadata_only=True)) and failing(Artifact(), asked=Asked(metadata_only=True))


def test_statements_give_the_cited_values_back(spark):
    rows = [(dt.date(2021, m, 1), e, r, float(m)) for m in (1, 2, 3) for e in ("it's", "other\\") for r in ("a", "b")]
    spark.createDataFrame(rows, "period date, entity string, region string, `own value` double").createOrReplaceTempView("cited_facts")
    citation = {"table": "cited_facts", "filters": {"entity": "it's"}, "without": {"region": "b"}, "start": "2021-02-01", "end": "2021-03-01", "value_column": "own value"}
    assert [r.value for r in spark.sql(findings.reproducing_sql(citation)).collect()] == [2.0, 3.0]
    assert [r.value for r in spark.sql(findings.reproducing_sql({"table": "cited_facts", "filters": {"entity": "other\\"}, "summed": True, "value_column": "own value"})).collect()] == [2.0, 4.0, 6.0]
    assert findings.reproducing_sql({"column": "x"}) is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2021-2025 arası", ("2021-01-01", "2025-12-01")), ("2021 sonundan itibaren", ("2021-12-01", None)), ("2024 sonuna kadar", (None, "2024-12-01")), ("202103-202209", ("2021-03-01", "2022-09-01")),
        ("Mart 2021 ile Haziran 2022", ("2021-03-01", "2022-06-01")), ("2021 ocak - 2022 mayıs", ("2021-01-01", "2022-05-01")), ("2024 ilk 3 ay", ("2024-01-01", "2024-03-01")), ("2024'ün ikinci yarısı", ("2024-07-01", "2024-12-01")),
        ("since 2020", ("2020-01-01", None)), ("2024-06", ("2024-01-01", "2024-12-01")), ("2024 2. çeyrek", ("2024-04-01", "2024-06-01")), ("", (None, None)), (None, (None, None)), ("1.5 milyon", (None, None)),
    ],
)
def test_windows_of_questions(text, want):
    assert windows.window(text) == want


def test_base_periods_and_single_months():
    assert [windows.base_period(t) for t in ("2021 fiyatlarıyla", "Mart 2021 fiyatlarıyla", "son ay fiyatlarıyla", "konut fiyat endeksi", None)] == ["2021-12-01", "2021-03-01", "end", None, None]
    assert [windows.single_month(t) for t in ("Haziran 2024", "2024-06 dağılımı", "2024", "2024-06 ve 2024-07")] == ["2024-06-01", "2024-06-01", None, None]
