"""A build from archives to tables, and what stops one."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.test_sources import write_table
from tidemark.operators.quality import ValidationError
from tidemark.plans import build
from tidemark.sources import published


def rows(a, b):
    return [["Toplam (2+3)", "bold", str(a + b), "0", str(a + b)], ["Bir", "italic", str(a), "0", str(a)], ["İki", "italic", str(b), "0", str(b)]]


@pytest.fixture
def archive(tmp_path):
    for name in ("stock", "ytd"):
        (tmp_path / name).mkdir()
        for month in range(1, 5):
            write_table(tmp_path / name, f"2021_{month:02d}.json", rows(10 * month, 5 * month))
    return tmp_path


def datasets(archive):
    return [build.Dataset("stock", str(archive / "stock"), "milyon TL"), build.Dataset("ytd", str(archive / "ytd"), "milyon TL", "cumulative_ytd")]


def test_a_build_writes_tables_flows_and_evidence(spark, archive, tmp_path):
    tables, checks = build.monthly(spark, datasets(archive))
    out = str(tmp_path / "out")
    first = build.write(spark, out, tables, checks)
    now = build.current(spark, out, views=True)
    assert set(now) == {"observations", "entities", "metrics", "footnotes"}
    flows = spark.sql("SELECT month(period) AS m, value, value_flow FROM observations WHERE dataset = 'ytd' AND entity_key = 'toplam/bir' AND currency = 'TL' ORDER BY 1").collect()
    assert [(r.value, r.value_flow) for r in flows] == [(10.0, 10.0), (20.0, 10.0), (30.0, 10.0), (40.0, 10.0)]
    assert now["observations"].where("dataset = 'stock' AND value_flow IS NOT NULL").isEmpty()
    assert {(r.entity_key, r.n_children) for r in now["entities"].where("dataset = 'stock'").collect()} == {("toplam", 2), ("toplam/bir", 0), ("toplam/iki", 0)}
    report = spark.read.parquet(f"{out}/reports")
    assert report.where("passed").count() == len(checks) and {r.build for r in report.collect()} == {first}
    second = build.write(spark, out, {"observations": tables["observations"]}, [])
    assert second != first and set(build.current(spark, out)) == {"observations"}


@pytest.mark.parametrize(
    ("change", "says"),
    [
        (lambda r: r[:2], "published throughout"),
        (lambda r: [["Toplam (2+3)", "bold", "99", "0", "99"], *r[1:]], "true sums"),
        (lambda r: [*r, ["Üç", "italic", "1", "0", "1"]], "published throughout"),
        (lambda r: [*r, r[2]], "keys occur once"),
    ],
)
def test_changed_archives_stop_a_build(spark, archive, tmp_path, change, says):
    write_table(archive / "stock", "2021_03.json", change(rows(30, 15)))
    tables, checks = build.monthly(spark, datasets(archive))
    with pytest.raises(ValidationError, match=says):
        build.write(spark, str(tmp_path / "out"), tables, checks)
    assert not (tmp_path / "out").exists()


def test_registered_lives_excuse_an_absence(spark, archive):
    write_table(archive / "stock", "2021_01.json", rows(10, 5)[:2])
    observations = build.monthly(spark, datasets(archive))[0]["observations"]
    assert [(r.entity_key, r.period) for r in build.absent_periods(observations).collect()] == [("toplam/iki", dt.date(2021, 1, 1))]
    life = spark.createDataFrame([("stock", "toplam/iki", dt.date(2021, 2, 1), None)], "dataset string, entity_key string, first_valid date, last_valid date")
    assert build.absent_periods(observations, life).isEmpty()


def test_weekly_tables_and_their_checks(spark, tmp_path):
    items = [{"item_id": 5, "display": "", "label": "Toplam (2+3)"}, {"item_id": 6, "display": "", "label": "Bir"}, {"item_id": 7, "display": "", "label": "İki"}]
    (tmp_path / "c.json").write_text(json.dumps({"tables": [{"table_id": 1, "items": items}]}))
    row = lambda day, *v: f"<tr><td>{day}</td>" + "".join(f"<td>{x}</td>" for x in v) + "</tr>"
    html = "<table><tr><th>T</th></tr>" + row("5.02.2021", 3, 0, 3, 1, 0, 1, 2, 0, 2) + row("12.02.2021", 9, 0, 9, 1, 0, 1, 2, 0, 2) + "</table>"
    (tmp_path / "w.json").write_text(json.dumps({"request": {"items": [5, 6, 7]}, "table_html": html}))
    tables, checks = build.weekly(spark, str(tmp_path / "w.json"), str(tmp_path / "c.json"))
    assert tables["weekly_observations"].count() == 18
    assert {r.check: r.n_failures for r in build.evidence(checks).collect() if r.n_failures} == {"weekly labels state true sums": 2}


def test_macro_tables_units_and_coverage(spark, tmp_path):
    lists, archive = tmp_path / "lists", tmp_path / "archive"
    lists.mkdir(), archive.mkdir()
    entry = lambda code, name, **k: {"SERIE_CODE": code, "DATAGROUP_CODE": "g", "SERIE_NAME": name, "FREQUENCY_STR": "AYLIK", "START_DATE": "01-01-2021", "END_DATE": "01-06-2021", "SEVIYE": 1, "UST_SERIE_CODE": "-1"} | k
    (lists / "g.json").write_text(json.dumps([entry("A", "Kredi"), entry("B", "Faiz (%)", FREQUENCY_STR="ÜÇ AYLIK"), entry("C", "Kayıp", SEVIYE=2)]))
    (tmp_path / "groups.json").write_text(json.dumps([{"TOPIC_TITLE_TR": " Konu ", "DATAGROUPS": [{"DATAGROUP_CODE": "g", "DATAGROUP_TYPE": "Grup", "BIRIMI": "Milyon TL", "DATASOURCE": ""}]}]))
    items = [{"Tarih": f"2021-{m}", "A": str(m), "B": str(m) if m % 3 == 0 else None} for m in range(1, 6)] + [{"Tarih": "2021-6", "B": "6"}]
    (archive / "x.json").write_text(json.dumps({"datagroup": "g", "series": ["A", "B"], "response": {"items": items}}))
    declared = spark.createDataFrame([("g", None, 0, "stock", "last"), ("g", "B", 0, "rate", "avg")], "datagroup string, series_code string, tier int, semantics string, monthly_rule string")
    catalogue = published.read_series_list(spark, str(lists), str(tmp_path / "groups.json"), declared)
    got = {r.series_code: r for r in catalogue.collect()}
    assert (got["A"].unit, got["A"].category, got["A"].native_frequency, got["A"].parent_series, got["A"].datasource) == ("milyon TL", "Konu", "monthly", None, None)
    assert (got["B"].unit, got["B"].temporal_semantics, got["B"].monthly_rule, got["B"].native_frequency) == ("%", "rate", "avg", "quarterly")
    tables, checks = build.macro(spark, str(archive), catalogue, "2021-01-01", "2021-12-01")
    owed = {r.series_code: (r.strict, r.n_owed, r.n_missing) for r in build.coverage_verdict(tables["macro_observations"], catalogue, "2021-01-01", "2021-12-01").collect()}
    assert owed == {"A": (True, 6, 1), "B": (True, 2, 0), "C": (False, 6, 6)}
    failed = {r.check for r in build.evidence(checks).collect() if not r.passed}
    assert failed == {"headline macro series are complete", "other macro series are complete"}


def scanned(df):
    """Rows that the scan of a plan without exchanges gave."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_a_slice_reads_one_file_of_many(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("'d' || id % 4 AS dataset", "'k' || lpad(cast(id % 40 AS string), 2, '0') AS entity_key", "'m' AS metric", "'TL' AS currency", "add_months(DATE'2000-01-01', cast(id / 40 AS int)) AS period", "rand(1) AS value")
    out = str(tmp_path / "out")
    build.write(spark, out, {"observations": rows}, [], files=20)
    table = build.current(spark, out)["observations"]
    assert len(table.inputFiles()) >= 15 and table.count() == 20_000
    one = table.where("dataset = 'd3' AND entity_key = 'k07'")
    assert one.count() == 500 and scanned(one) <= 2000
    part = table.where("dataset = 'd3' AND entity_key = 'k07' AND period >= DATE'2041-01-01'")
    assert part.count() == 8 and scanned(part) <= 2000
    assert one.select("value", F.input_file_name().alias("f")).select("f").distinct().count() <= 2


def test_agreement_of_pairs(spark):
    pairs = spark.createDataFrame([("a", 100.4, 100.0), ("a", 5.0, 0.0), ("b", 101.0, 100.0), ("c", None, 1.0)], "k string, fine_value double, coarse_value double")
    assert {r.k: (r.n_common, r.agrees) for r in build.agreement(pairs, ["k"]).collect()} == {"a": (1, True), "b": (1, False), "c": (0, False)}
