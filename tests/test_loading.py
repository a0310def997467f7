"""Series of plans out of curated sources, and what is refused."""

import datetime as dt

import pytest

from tidemark.functions import registry
from tidemark.plans import findings
from tidemark.plans.artifact import Refused
from tidemark.plans.loading import Source, executor, load
from tidemark.plans.plan import Step, parse

COLUMNS = "period date, dataset string, entity_key string, entity_name string, metric string, currency string, value double, value_flow double, unit string, temporal_semantics string, retired_on date"


@pytest.fixture(scope="module")
def facts(spark):
    day = lambda m: dt.date(2024, m, 1)
    rows = [(day(m), "d", "loans", "Krediler", k, c, 100.0 * m + i, None, "milyon TL", "stock", None) for m in (1, 2, 3) for i, (k, c) in enumerate([("balance", "total"), ("balance", "TL"), ("limit", "total")])]
    rows += [(day(m), "d", "profit", "Kâr", "balance", "total", 10.0 * m, 10.0, "milyon TL", "cumulative_ytd", None) for m in (1, 2, 3)]
    rows += [(day(1), "d", "old", "Eski", "balance", "total", 1.0, None, "milyon TL", "stock", day(2)), (day(1), "d", "odd", "Çift", "a", "X", 1.0, None, "adet", "stock", None), (day(1), "d", "odd", "Çift", "b", "Y", 1.0, None, "adet", "stock", None)]
    df = spark.createDataFrame(rows, COLUMNS)
    df.createOrReplaceTempView("loading_facts")
    return df


@pytest.fixture(scope="module")
def source(facts):
    return Source(facts, "loading_facts", flow="value_flow", retired="retired_on")


@pytest.fixture(scope="module")
def regional(spark):
    rows = [(dt.date(2024, 3, 1), "n", k, k, r, v, u, s) for k, u, s, values in (("loans", "bin TL", "stock", (1.0, 2.0, 50.0)), ("npl", "%", "ratio", (3.0, 4.0, 5.0))) for r, v in zip(("İSTANBUL", "ANKARA", "YURT DIŞI"), values, strict=True)]
    facts = spark.createDataFrame(rows, "period date, dataset string, entity_key string, entity_name string, province string, value double, unit string, temporal_semantics string")
    facts.createOrReplaceTempView("loading_regional")
    return Source(facts, "loading_regional", metric=None, currency=None, region="province", abroad=("YURT DIŞI",), grain="quarterly")


def values(found):
    return [r.value for r in found[0].orderBy("period").collect()]


def test_headline_slices_flows_and_citations(spark, source):
    loans = load(source, Step("fetch_series", key="loans"))
    assert values(loans) == [100.0, 200.0, 300.0] and loans[1].quantity.kind == "stock"
    assert values(load(source, Step("fetch_series", key="loans", currency="TL"))) == [101.0, 201.0, 301.0]
    profit = load(source, Step("fetch_series", key="profit"))
    assert values(profit) == [10.0, 10.0, 10.0] and profit[1].quantity.kind == "flow"
    assert values(load(source, Step("fetch_series", key="profit", year_to_date=True))) == [10.0, 20.0, 30.0]
    assert values(load(source, Step("fetch_series", key="old", include_retired=True))) == [1.0]
    old = load(source, Step("fetch_series", key="old", include_retired=True))
    limit = load(source, Step("fetch_series", key="loans", metric="limit", dataset="d"))
    for found in (loans, profit, old, limit):
        assert [r.value for r in spark.sql(findings.reproducing_sql(found[1].citation)).collect()] == values(found)


@pytest.mark.parametrize(("step", "says"), [({"key": "none"}, "has no"), ({"key": "loans", "currency": "USD"}, "no currency"), ({"key": "old"}, "retired"), ({"key": "odd"}, "name a metric"), ({"key": "loans", "region": "Ankara"}, "no regions")])
def test_slices_are_refused_not_guessed(source, step, says):
    with pytest.raises(Refused, match=says):
        load(source, Step("fetch_series", **step))


def test_regions_are_summed_named_or_refused(spark, regional):
    country = load(regional, Step("fetch_series", key="loans"))
    assert values(country) == [3.0] == [r.value for r in spark.sql(findings.reproducing_sql(country[1].citation)).collect()]
    assert values(load(regional, Step("fetch_series", key="npl", region="istanbul"))) == [3.0]
    for step, says in ((Step("fetch_series", key="npl"), "never summed"), (Step("fetch_series", key="loans", region="Paris"), "no region")):
        with pytest.raises(Refused, match=says):
            load(regional, step)


def test_every_citation_of_regions_reads_the_rows_that_were_summed(spark):
    day = dt.date(2024, 3, 1)
    names = ["İSTANBUL", "Istanbul", "ANKARA", None, "YURT DIŞI", "Yurt Dışı", "KIBRIS", "it's"]
    rows = [(d, k, f"name {d}", r, 10.0**i * f, None if d < day or k == "live" else dt.date(2024, 1, 1), "TL", "stock") for i, r in enumerate(names) for d, f in ((day, 1), (dt.date(2024, 6, 1), 2)) for k in ("live", "mixed")]
    facts = spark.createDataFrame(rows, "period date, entity_key string, entity_name string, province string, value double, retired_on date, unit string, temporal_semantics string")
    facts.createOrReplaceTempView("loading_abroad")
    source = Source(facts, "loading_abroad", metric=None, currency=None, dataset=None, region="province", abroad=("yurt disi", "Kıbrıs"), retired="retired_on")
    for step, want in (
        (Step("fetch_series", key="live"), [10001111.0, 20002222.0]), (Step("fetch_series", key="live", region="istanbul"), [1.0, 10.0, 2.0, 20.0]), (Step("fetch_series", key="live", region="It's"), [1e7, 2e7]),
        (Step("fetch_series", key="mixed", include_retired=True), [10001111.0, 20002222.0]),
    ):
        found, line = load(source, step)
        told = [(r.period, r.value) for r in spark.sql(findings.reproducing_sql(line.citation)).collect()]
        assert sorted(told) == sorted((r.period, r.value) for r in found.collect()) and sorted(v for _, v in told) == sorted(want)
        assert line.label == "name 2024-06-01"
    with pytest.raises(Refused, match="retired"):
        load(source, Step("fetch_series", key="mixed"))


def test_loading_takes_one_job_for_what_it_chooses(spark, source, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    ran = []
    for name in ("collect", "first", "head", "isEmpty", "count", "take", "toPandas"):
        monkeypatch.setattr(DataFrame, name, lambda self, *a, real=getattr(DataFrame, name), name=name, **k: ran.append(name) or real(self, *a, **k))
    load(source, Step("fetch_series", key="loans"))
    assert ran == ["collect"]


def test_a_plan_over_sources_repairs_keys_and_never_substitutes(spark, source, regional):
    index = spark.createDataFrame([("m", "loans", "krediler", "", "milyon TL", "stock", "monthly", None, 0)], "source string, key string, name string, context string, unit string, semantics string, grain string, tier int, depth int")
    plan, dropped = parse({"steps": [{"op": "discover", "query": "krediler"}, {"op": "fetch_series", "source": "m", "key": "loans_total"}, {"op": "fetch_series", "source": "external", "key": "loans"}, {"op": "fetch_series", "source": "r", "key": "loans", "region": "Ankara", "name": "ankara"}]})
    out = executor({"m": source, "r": regional}, index).run(plan)
    assert not dropped and [f.split(":")[0] for f in out.failed] == ["step 2 fetch_series"]
    assert out.citations[0]["repaired"] == "loans" and out.facts[0]["found"][0]["key"] == "loans"
    assert {c: x.quantity.unit for c, x in out.artifact.lines.items()} == {"loans": "milyon TL", "ankara": "bin TL"}


def test_functions_by_name_in_statements(spark):
    registry.register(spark)
    html = "<table><tr><th>Tarih</th><th>Değer</th></tr><tr><td>Ocak 2021</td><td>1,5</td></tr><tr><td>Şubat 2021</td><td>2,5</td></tr></table><p>x</p>"
    spark.createDataFrame([(html,), ("<p>none</p>",), (None,)], "html string").createOrReplaceTempView("registry_pages")
    assert [(r.name, str(r.period), r.value) for r in spark.sql("SELECT s.* FROM registry_pages, LATERAL page_series(html) s ORDER BY period").collect()] == [("Değer", "2021-01-01", 1.5), ("Değer", "2021-02-01", 2.5)]
    assert spark.sql("SELECT g.cells FROM registry_pages, LATERAL page_grids(html) g WHERE g.row = 1").first().cells == ["Ocak 2021", "1,5"]
    assert spark.sql("SELECT slug_text(' Çalışan  Sayısı ') AS s, page_text('<p>a</p>') AS t, share_pct(1, 0) AS p").first().asDict() == {"s": "calisan_sayisi", "t": "a", "p": None}


def test_notes_columns_and_sources_come_in_by_the_plan(spark, source, tmp_path):
    from tests.test_workbooks import write_book
    from tidemark.sources.zone import Zone

    (tmp_path / "x.csv").write_text("Tarih,Deger\n2024-01-05,\"1.234,5\"\n2024-01-20,\"2.000,0\"\n2024-02-01,\"3,5\"\n")
    (tmp_path / "p.html").write_text("<table><tr><th>Tarih</th><th>Bir</th></tr><tr><td>Ocak 2024</td><td>1,5</td></tr><tr><td>Şubat 2024</td><td>2,5</td></tr></table>")
    (tmp_path / "none.html").write_text("<p>nothing</p>")
    write_book(tmp_path / "b.xlsx", {"Sayfa": [["Tarih", "İki"], ["2024-01-01", 3.0], ["2024-02-01", 4.0]]})
    notes = spark.createDataFrame([("d", "old", dt.date(2020, 1, 1), dt.date(2020, 2, 1), 2), ("d", "new", dt.date(2024, 1, 1), dt.date(2024, 2, 1), 1), ("e", "x", None, None, 1)], "dataset string, footnote string, first_period date, last_period date, n_periods long")
    zone = Zone(spark, f"file://{tmp_path}/zone")
    run = executor({"m": source}, notes=notes, zone=zone, archived=lambda url: f"file://{tmp_path}/{url.rsplit('/', 1)[1].split('#')[0]}").run
    steps = [
        {"op": "footnotes", "dataset": "d"}, {"op": "footnotes", "dataset": "none"}, {"op": "ingest_external", "url": "http://h/x.csv", "value_column": "deger", "unit": "TL", "rule": "sum", "name": "x"},
        {"op": "ingest_source", "url": "http://h/p.html"}, {"op": "ingest_source", "url": "http://h/p.html#part"}, {"op": "ingest_source", "url": "http://h/b.xlsx"}, {"op": "ingest_source", "url": "http://h/none.html"},
    ]
    plan, dropped = parse({"steps": steps})
    out = run(plan)
    assert not dropped and [f.split(":")[0] for f in out.failed] == ["step 1 footnotes", "step 6 ingest_source"]
    assert [n["footnote"] for n in out.facts[0]["notes"]] == ["new", "old"]
    assert [(str(r.period), r.x) for r in out.artifact.frame.orderBy("period").collect()] == [("2024-01-01", 3234.5), ("2024-02-01", 3.5)]
    assert out.citations[0]["unit_verified"] is False and out.artifact.lines["x"].unit == "TL"
    assert [f["source"]["unchanged"] for f in out.facts if f["op"] == "ingest_source"] == [False, True, False]
    assert sorted((r.series_key.split("/", 1)[1], str(r.period), r.value) for r in zone.read("observations").collect()) == [("page/bir", "2024-01-01", 1.5), ("page/bir", "2024-02-01", 2.5), ("sayfa/iki", "2024-01-01", 3.0), ("sayfa/iki", "2024-02-01", 4.0)]


def test_steps_have_the_fields_of_their_operation():
    _, dropped = parse({"steps": [{"op": "discover", "query": "a", "sensitivity": "high"}, {"op": "analyze", "operation": "changepoint", "column": "a", "sensitivity": "odd"}, {"op": "analyze", "operation": "anomaly", "column": "a", "window": 2}, {"op": "ingest_external", "url": "u"}, {"op": "analyze", "operation": "changepoint", "column": "a", "sensitivity": "high", "window": None}]})
    assert [d.split(": ", 1)[1] for d in dropped] == ["discover does not read ['sensitivity']", "unknown sensitivity 'odd'", "a window has 3 periods or more", "ingest_external needs value_column"]
