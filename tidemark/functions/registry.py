"""The library's functions by name, for statements of `spark.sql`.

Text keys are SQL functions, so they stay inside generated code; page text is an Arrow function, and
pages to links, grids and series are table functions that give rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions import pages
from tidemark.functions.labels import LETTERS, PLAIN
from tidemark.sources import grids

FOLDED = f"regexp_replace(lower(translate(t, '{LETTERS}', '{PLAIN}')), '\\\\p{{M}}+', '')"
SQL_FUNCTIONS = {
    "fold_text": ("t STRING", "STRING", FOLDED),
    "slug_text": ("t STRING", "STRING", f"trim(BOTH '_' FROM regexp_replace({FOLDED.replace('translate(t,', 'translate(trim(t),')}, '[^a-z0-9]+', '_'))"),
    "share_pct": ("a DOUBLE, b DOUBLE", "DOUBLE", "100 * try_divide(a, b)"),
    "source_id": ("u STRING", "STRING", "substring(sha2(concat(lower(regexp_extract(trim(u), '^[A-Za-z][A-Za-z0-9+.-]*:', 0)), regexp_replace(regexp_replace(trim(u), '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '[?]?(#.*)?$', '')), 256), 1, 12)"),
}


@F.udtf(returnType="grid int, row int, cells array<string>")
class PageGrids:
    """Every row of every table of a page."""

    def eval(self, html: str):
        for g, grid in enumerate(pages.html_grids(html)):
            for r, cells in enumerate(grid):
                yield g, r, [c if c is None else str(c) for c in cells]


@F.udtf(returnType="name string, period date, value double")
class GridSeries:
    """The series that the tables of a page hold; tables without any give no rows."""

    def eval(self, html: str):
        for grid in pages.html_grids(html):
            try:
                yield from grids.series_of(grid)
            except grids.NoSeries:
                continue


def register(spark: SparkSession) -> list[str]:
    """Registers all functions in a session and returns their names."""
    for name, (parameters, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("page_text", pages.html_to_text)
    spark.udtf.register("page_grids", PageGrids)
    spark.udtf.register("page_series", GridSeries)
    return [*SQL_FUNCTIONS, "page_text", "page_grids", "page_series"]
