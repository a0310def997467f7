"""Series out of grids of cells: which row is the header, whether periods run down or across, and the
contract of an extracted table."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import ENGLISH, MONTHS

NAMES = {n: i for i, names in enumerate(MONTHS, 1) for n in names} | {n: i for i, n in enumerate(ENGLISH, 1)}
SCHEMA = "series_name string, period date, value double"


class NoSeries(ValueError):
    """A grid without dates, or without numbers beside them."""


def period_of(cell: str | None, year: str | None = None) -> dt.date | None:
    """The date a cell says: year-first, day-first, month and year, or a month beside a year cell."""
    first, *rest = (cell or "").strip().replace("İ", "i").replace("I", "ı").lower().split("/")
    # A name's translation behind a slash falls away; slashes before digits stay.
    text = "".join([first.rstrip(), *(" " + " ".join(p.split()[1:]) if p.strip()[:1].isascii() and p.strip()[:1].isalpha() else "/" + p for p in rest)]).strip()
    for name, number in sorted(NAMES.items(), key=lambda n: -len(n[0])):
        text = re.sub(rf"\b{name.replace('i', '[iı]')}\b", str(number), text)
    if year and re.fullmatch(r"\d{1,2}", text) and re.fullmatch(r"(?:19|20)\d{2}", year.strip()):
        text = f"{text}.{year.strip()}"
    for pattern, order in ((r"(\d{4})-(\d{1,2})-(\d{1,2})", (1, 2, 3)), (r"(\d{1,2})[./\- ](\d{1,2})[./\- ](\d{4})", (3, 2, 1)), (r"(\d{1,2})[./\- ](\d{4})", (2, 1, 0)), (r"(\d{4})[./\- ](\d{1,2})", (1, 2, 0))):
        if m := re.fullmatch(pattern, text):
            y, mo, d = (int(m.group(g)) if g else 1 for g in order)
            try:
                return dt.date(y, mo, d) if 1900 <= y <= 2100 else None
            except ValueError:
                return None
    return None


def number_of(cell: str | None, comma: bool) -> float | None:
    """A number under its column's convention."""
    text = re.sub(r"[\s ]", "", cell or "").rstrip("%")
    text = text.replace(".", "").replace(",", ".") if comma else text.replace(",", "")
    return float(text) if re.fullmatch(r"-?\d+(?:\.\d+)?", text) else None


def commas(cells: list[str | None]) -> bool:
    """Whether a column writes decimals with a comma: some number can only be read so, and none has groups by comma."""
    comma = point = False
    for cell in cells:
        bare = "".join((cell or "").split()).rstrip("%").removeprefix("-")
        parts, signs = re.split("[.,]", bare), [c for c in bare if c in ".,"]
        if not signs or not all(p.isdecimal() for p in parts):
            continue
        last, kinds = signs[-1], set(signs)
        groups = parts[1:-1] if len(kinds) == 2 else parts[1:]
        grouped = len(parts[0]) <= 3 and all(len(p) == 3 for p in groups)
        whole = len(kinds) == 1 or signs.count(last) == 1
        comma |= (grouped and whole and (last == ",") == (len(kinds) == 2)) or signs == [","]
        point |= grouped and whole and (last == ".") == (len(kinds) == 2)
    return comma and not point


def series_of(grid: list[list[str]]) -> list[tuple[str, dt.date, float]]:
    """(name, period, value) of a grid. Periods across the top make it turned; title, unit and footnote rows
    have no period and fall away; a year column beside a month column is read with it."""
    if max((sum(period_of(c) is not None for c in row) for row in grid), default=0) >= 2 and max((sum(period_of(r[i]) is not None for r in grid) for i in range(min(map(len, grid)))), default=0) <= 1:
        grid = [list(c) for c in zip(*grid, strict=True)]
    width = min(map(len, grid), default=0)
    rates = [sum(period_of(r[i]) is not None for r in grid) for i in range(width)]
    year_at = None
    if not rates or max(rates) < 2:
        found = [(y, m) for y in range(width) for m in range(width) if y != m and sum(period_of(r[m], r[y]) is not None for r in grid) >= 2]
        if not found:
            raise NoSeries("no column of the grid has dates")
        year_at, at = found[0]
    else:
        at = rates.index(max(rates))
    periods = [period_of(r[at], r[year_at] if year_at is not None else None) for r in grid]
    first = next(i for i, p in enumerate(periods) if p)
    out = []
    for i in range(width):
        if i in (at, year_at):
            continue
        body = [(p, r[i]) for p, r in zip(periods, grid, strict=True) if p]
        comma = commas([c for _, c in body])
        name = next((grid[j][i].strip() for j in range(first - 1, -1, -1) if grid[j][i].strip()), f"column {i + 1}")
        out += [(name, p, v) for p, c in body if (v := number_of(c, comma)) is not None]
    if not out:
        raise NoSeries("no numbers beside the dates")
    return out


def grid_series(cells: DataFrame, sheet: list[str]) -> DataFrame:
    """Series of all sheets of a long table (sheet columns, row, col, text); a sheet is one group, and one
    without a series gives no rows."""
    keys = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in sheet)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="row", columns="col", values="text", aggfunc="first").fillna("")
        try:
            found = series_of(wide.astype(str).values.tolist())
        except NoSeries:
            found = []
        out = pd.DataFrame(found, columns=["series_name", "period", "value"])
        for i, k in enumerate(sheet):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return cells.groupBy(*sheet).applyInPandas(one, f"{keys}, {SCHEMA}")


@dataclass(frozen=True)
class Contract:
    """What a caller who has seen the source says of an extracted table: its columns in order and which are numbers, the
    unit and the period, where it comes from, and how its numbers are written. Nothing is guessed from the table."""

    columns: tuple[str, ...]
    numeric: tuple[str, ...]
    unit: str
    period: str
    url: str
    fetched_at: str
    location: str
    verified: bool = False
    decimal: str = "."
    thousands: str = ""

    def faults(self) -> list[str]:
        """Why the contract itself cannot stand."""
        found = []
        if not self.columns or len(set(self.columns)) != len(self.columns) or not all(self.columns):
            found.append("columns must be named, each once")
        if not self.numeric or not set(self.numeric) <= set(self.columns):
            found.append("some of the columns must be numeric")
        if self.decimal not in (".", ",") or self.thousands not in ("", ",", ".", " ") or self.decimal == self.thousands:
            found.append("the separators must be told apart")
        found += [f"{name} is missing" for name in ("unit", "period", "url", "fetched_at", "location") if not (getattr(self, name) or "").strip()]
        return found if self.verified else [*found, "the source is not verified"]


def certified(cells: DataFrame, keys: list[str], contract: Contract) -> tuple[DataFrame, DataFrame]:
    """The values of all tables that keep a contract, and what is wrong with the others.

    ``cells`` has the tables' keys, row and col from 1 and text; the first row is the header. Values are (keys, row,
    column, text, number, value, unit, period, url, location): number is the decimal as written, in plain form, value the
    same as a decimal where it has at most 20 digits before the point and 18 behind it. Errors are (keys, row, column,
    why); a table with any has no values. Tables are checked together, by one aggregate a row and one a table.
    """
    if faults := contract.faults():
        raise ValueError("; ".join(faults))
    n, names = len(contract.columns), F.array(*map(F.lit, contract.columns))
    column = F.get(names, F.col("col") - 1)
    text, numeric = F.trim("text"), column.isin(*contract.numeric)
    mark = lambda c: {".": r"\.", " ": " "}.get(c, c)
    whole = f"([0-9]+|[0-9]{{1,3}}({mark(contract.thousands)}[0-9]{{3}})+)" if contract.thousands else "[0-9]+"
    written = text.rlike(f"^[+-]?{whole}({mark(contract.decimal)}[0-9]+)?$")
    header = F.col("row") == 1
    why = F.when(F.col("col") > n, "more cells than columns").when(header & ~text.eqNullSafe(column), "another header").when(~header & (F.coalesce(text, F.lit("")) == ""), "an empty cell").when(~header & numeric & ~written, "no number")
    told = cells.select(*keys, "row", "col", column.alias("column"), text.alias("text"), numeric.alias("numeric"), why.alias("why"))
    none = F.lit(None).cast("string").alias("column")
    rows = told.groupBy(*keys, "row").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("col") <= n, F.col("col"))).alias("filled"))
    uneven = rows.withColumn("why", F.when(F.col("filled") < n, "cells are missing").when(F.col("n") > n, "more cells than columns")).where("why IS NOT NULL").select(*keys, "row", none, "why")
    bare = rows.groupBy(*keys).agg(F.min("row").alias("first"), F.count("*").alias("n")).where("first <> 1 OR n < 2").select(*keys, F.lit(None).cast("int").alias("row"), none, F.lit("no header or no rows").alias("why"))
    errors = told.where("why IS NOT NULL").select(*keys, "row", "column", "why").unionByName(uneven).unionByName(bare).distinct()
    plain = F.replace(F.replace(F.col("text"), F.lit(contract.thousands), F.lit("")) if contract.thousands else F.col("text"), F.lit(contract.decimal), F.lit("."))
    number = F.when(F.col("numeric"), F.ltrim(plain, F.lit("+")))
    good = told.where("row > 1").join(errors.select(*keys).distinct(), keys, "left_anti")
    origin = {"unit": contract.unit, "period": contract.period, "url": contract.url, "location": contract.location}
    return good.select(*keys, "row", "column", "text", number.alias("number"), number.try_cast("decimal(38,18)").alias("value"), *(F.lit(v).alias(k) for k, v in origin.items())), errors


def table_errors(table: dict, most_rows: int = 5000) -> list[str]:
    """What breaks the contract of an extracted table: columns named once, full rows, periods that are
    dates and occur once, values that are decimal numbers."""
    columns, rows, found = table.get("columns") or [], table.get("rows") or [], []
    if not columns or len(set(columns)) != len(columns):
        found.append("columns must be named, each once")
    if not rows or len(rows) > most_rows:
        found.append(f"between 1 and {most_rows} rows are needed")
    seen = set()
    for i, row in enumerate(rows[:most_rows]):
        if len(row) != len(columns):
            found.append(f"row {i} has {len(row)} cells")
            continue
        period = period_of(str(row[0]))
        if period is None or period in seen:
            found.append(f"row {i}: {'no period' if period is None else 'the period occurs twice'}")
        seen.add(period)
        found += [f"row {i}: {v!r} is no number" for v in row[1:] if v not in (None, "") and number_of(str(v), False) is None]
    return found
