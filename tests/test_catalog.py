"""Every registered query against its DuckDB SQL, and those without SQL for rows of a stable form."""

import datetime as dt
import math

import duckdb
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, dt.datetime | dt.date):
        return str(v)[:10]
    return round(v, 9) if isinstance(v, float) else v


def rows(found, columns, names):
    order = [names.index(c) for c in columns]
    return sorted(([plain(r[i]) for i in order] for r in found), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    assert rows(df.collect(), columns, df.columns) == rows(cursor.fetchall(), columns, names)


CORE = {"change_points", "granger_pairs", "html_to_text", "page_assets"}


def test_queries_without_sql_are_known():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == CORE


def test_change_points_of_all_series_are_those_of_each_alone(spark, duck):
    """That cuts are the cheapest of all is tested on arrays; here, that series do not mix."""
    from tidemark.operators import changepoints

    got = {}
    for r in catalog.queries()["change_points"](spark, SF).collect():
        got.setdefault(r.c_nationkey, []).append(str(r.period)[:10])
    series = {}
    for k, p, v in duck.execute("SELECT c_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE), round(sum(o_totalprice), 2) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY 1, 2").fetchall():
        series.setdefault(k, []).append((p, v))
    assert set(got) <= set(series) and len(series) > 20
    for key, rows in series.items():
        one = spark.createDataFrame([(key, p, v) for p, v in rows], "k long, period date, value double")
        alone = sorted(str(r.period)[:10] for r in changepoints.change_points(one, ["k"], "level", "high").collect())
        assert alone == sorted(got.get(key, [])), key


def test_granger_pairs_against_sums_of_squares(spark):
    """The F-tests again, from residual sums of squares of regressions that are solved by normal equations."""
    import numpy as np

    from tidemark.catalog import orders_monthly, price_monthly
    from tidemark.operators.causality import f_tail

    both = orders_monthly(spark, SF, "o_orderstatus").join(price_monthly(spark, SF), "period").orderBy("o_orderstatus", "period").toPandas()
    found = catalog.queries()["granger_pairs"](spark, SF).collect()
    assert {r.o_orderstatus for r in found} == set(both.o_orderstatus)
    for r in found:
        assert r.reason is None
        v = both[both.o_orderstatus == r.o_orderstatus][["value", "price"]].dropna().to_numpy(float)
        v = np.diff(v, axis=0) if r.differenced else v
        v = (v - v.mean(axis=0)) / v.std(axis=0)
        n = len(v) - r.lag

        def rss(y, columns):
            x = np.column_stack([np.ones(n), *columns])
            e = y - x @ np.linalg.solve(x.T @ x, x.T @ y)
            return float(e @ e)

        for p, (a, b) in ((r.p_forward, (0, 1)), (r.p_backward, (1, 0))):
            past = [[v[r.lag - k : len(v) - k, c] for k in range(1, r.lag + 1)] for c in (a, b)]
            full, short = rss(v[r.lag :, a], past[0] + past[1]), rss(v[r.lag :, a], past[0])
            free = n - 2 * r.lag - 1
            assert p == pytest.approx(f_tail((short - full) / r.lag / (full / free), r.lag, free), abs=1e-6)


def test_page_assets_against_a_parser(spark):
    """At most ten links a page, files first, each once, as another parser finds them."""
    from html.parser import HTMLParser
    from urllib.parse import urlsplit

    class Links(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = []

        def handle_starttag(self, tag, attrs):
            self.found += [v for k, v in attrs if tag == "a" and k == "href" and v]

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {}
    for r in catalog.queries()["page_assets"](spark, SF).collect():
        got.setdefault(r.page_id, set()).add(r.link)
    checked = 0
    for i, row in pages.items():
        parser = Links()
        parser.feed(row.html or "")
        parts = urlsplit(row.url)
        want = {f"{parts.scheme}://{parts.netloc}{h}" if h.startswith("/") and not h.startswith("//") else h for h in parser.found if not h.startswith(("#", "mailto:", "javascript:"))}
        assert len(got.get(i, ())) == min(10, len(want)) and got.get(i, set()) <= want, (i, sorted(want)[:5], sorted(got.get(i, set()))[:5])
        checked += len(want)
    assert checked > 100


def test_html_text_leaves_chrome_out(spark):
    got = catalog.queries()["html_to_text"](spark, SF).collect()
    assert got and all(r.text and "<" not in r.text and "track(" not in r.text for r in got)


def test_entry_is_the_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 60
