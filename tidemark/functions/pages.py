"""Text and links out of HTML for reading pages, and tables as grids."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without readable text.
CHROME = frozenset(("script", "style", "nav", "header", "footer", "aside", "noscript", "form", "head"))


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = [], []

    def handle_starttag(self, tag, attrs):
        if tag in CHROME:
            self.depth.append(tag)

    def handle_endtag(self, tag):
        if tag in self.depth:
            while self.depth.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def readable(html: str | None, most: int | None = None) -> str:
    """The text outside chrome elements, one line per stretch; at most ``most`` characters if given."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    text = "\n".join(line for part in reader.parts if (line := " ".join(part.split())))
    return text if most is None else text[:most]


@F.pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    """`readable` for a column."""
    return html.map(readable)


def links(html: Column, base: Column | None = None) -> Column:
    """All link targets of a page in order, each once; site-relative ones are joined to the base's host."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1)))
    if base is None:
        return found
    host = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    return F.transform(found, lambda u: F.when(F.startswith(u, F.lit("/")), F.concat(host, u)).otherwise(u))


def type_hint(url: Column) -> Column:
    """pdf, excel, csv, image, text or html, by the path's ending."""
    path = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return F.when(path.rlike(r"\.pdf$"), "pdf").when(path.rlike(r"\.xlsx?$"), "excel").when(path.rlike(r"\.csv$"), "csv").when(path.rlike(r"\.(png|jpe?g|gif|webp)$"), "image").when(path.rlike(r"\.txt$"), "text").otherwise("html")


def assets(pages: DataFrame, id_col: str, url_col: str, html_col: str, most: int) -> DataFrame:
    """At most ``most`` distinct links of each page, files before pages, in page order."""
    from pyspark.sql import Window

    found = pages.select(id_col, F.posexplode(links(F.col(html_col), F.col(url_col))).alias("pos", "link")).withColumn("type_hint", type_hint(F.col("link")))
    order = Window.partitionBy(id_col).orderBy((F.col("type_hint") == "html").cast("int"), "pos")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def rank_links(found: DataFrame, words: list[str], text: str = "link") -> DataFrame:
    """Adds overlap, the number of question words a link has, for ordering."""
    return found.withColumn("overlap", F.size(F.array_intersect(F.array(*map(F.lit, words)), F.split(F.lower(text), "[^a-z0-9]+"))))


def canonical_url(url: Column) -> Column:
    """An address as identity: without white space around it and without fragment, its scheme in lower case.
    Hosts, paths and queries are kept as they are; ids that were given once must not change."""
    bare = F.regexp_replace(F.trim(url), r"[?]?(#.*)?$", "")
    scheme = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    return F.concat(F.lower(scheme), F.substring(bare, F.length(scheme) + 1, F.length(bare)))


def source_id(url: Column) -> Column:
    """Twelve hexadecimal digits that name a source."""
    return F.substring(F.sha2(canonical_url(url), 256), 1, 12)


class _Grids(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.rows, self.cell = [], None, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            a = dict(attrs)
            number = lambda n: min(int(a[n]), 1000) if (a.get(n) or "").isdigit() and int(a[n]) > 0 else 1
            self.cell = [[], number("rowspan"), number("colspan")]
            self.rows[-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None
        elif tag == "table" and self.rows is not None:
            self.tables.append(spread(self.rows))
            self.rows = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0].append(data)


def spread(rows: list[list]) -> list[list[str]]:
    """Cells (parts, rowspan, colspan) as a full grid: a spanning cell's text stands in all its places."""
    grid: list[dict[int, str]] = [{} for _ in rows]
    for y, row in enumerate(rows):
        x = 0
        for parts, down, across in row:
            while x in grid[y]:
                x += 1
            text = " ".join("".join(parts).split())
            for dy in range(min(down, len(rows) - y)):
                for dx in range(across):
                    grid[y + dy][x + dx] = text
            x += across
    width = max((max(g, default=-1) + 1 for g in grid), default=0)
    return [[g.get(x, "") for x in range(width)] for g in grid]


def html_grids(html: str | None) -> list[list[list[str]]]:
    """All tables of a page as grids."""
    reader = _Grids()
    reader.feed(html or "")
    return reader.tables


def markdown_grids(text: str | None) -> list[list[list[str]]]:
    """Tables written with bars, as recognised text has them; rule lines are dropped."""
    out, rows = [], []
    for line in [*(text or "").splitlines(), ""]:
        if line.strip().startswith("|"):
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if not all(c and set(c) <= set("-: ") for c in cells):
                rows.append(cells)
        elif rows:
            out.append(rows)
            rows = []
    return out


def continued(grids: list[list[list[str]]]) -> list[list[list[str]]]:
    """Neighbouring grids with one header as one table."""
    out: list[list[list[str]]] = []
    for g in grids:
        if out and g and out[-1][0] == g[0]:
            out[-1] = out[-1] + g[1:]
        elif g:
            out.append(list(g))
    return out
