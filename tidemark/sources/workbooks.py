"""Sector workbooks: cells of spreadsheet files, and the tables that stand in them, found by their layout.

A workbook is a zip of XML parts. Spark lists and reads the files; a task goes through one workbook's sheets as a
stream of cells. What the cells mean is DataFrame work from there on: the column of names is the one with the
most text, numbers or ranks stand left of it and measures right of it; rows above the first with measures are the
header; columns of shares are left out; parents come from the order of rows. Two layouts are read alike: one row a
coded sector, and main sectors, ranked anew each month, with indented sub-sectors below them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import labels

CELLS = "file string, sheet_no int, sheet string, row int, col int, text string, number double"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Names of rows that hold the sum of all, and words of headers of shares.
TOTALS, SHARES = ("toplam", "total", "genel_toplam"), ("%", "pay", "oran", "share", "yuzde")
#: Rows that go on at a time.
BATCH = 20_000


def place_of(reference: str) -> tuple[int, int]:
    """Row and column, from 1, of a reference such as BC12."""
    letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", reference).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits), col


def texts_of(part) -> str:
    """All the text of a string item, its runs joined."""
    return "".join(t.text or "" for t in part.iter(f"{MAIN}t"))


def sheet_cells(content: bytes) -> Iterator[tuple[int, str, int, int, str | None, float | None]]:
    """(sheet number, sheet, row, column, text, number) of every cell that holds something, sheet by sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = [texts_of(x) for x in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot().iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
        for number, sheet in enumerate(ElementTree.parse(book.open("xl/workbook.xml")).getroot().iter(f"{MAIN}sheet"), 1):
            target = targets[sheet.get(LINK)].lstrip("/")
            row = col = 0
            for event, part in ElementTree.iterparse(book.open(target if target.startswith("xl/") else f"xl/{target}"), ("start", "end")):
                if event == "start" and part.tag == f"{MAIN}row":
                    row, col = int(part.get("r") or row + 1), 0
                elif event == "end" and part.tag == f"{MAIN}c":
                    row, col = place_of(part.get("r")) if part.get("r") else (row, col + 1)
                    kind, value = part.get("t"), part.findtext(f"{MAIN}v")
                    if kind == "inlineStr":
                        text = texts_of(part)
                    elif value is not None and kind == "s":
                        text = shared[int(value)]
                    else:
                        text = value
                    if text not in (None, ""):
                        yield number, sheet.get("name"), row, col, (None if kind in (None, "n") else text), (float(text) if kind in (None, "n") else None)
                elif event == "end" and part.tag == f"{MAIN}row":
                    part.clear()


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all workbooks of a folder. A file that is no workbook fails the read, with its name."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = []
                try:
                    for cell in sheet_cells(content.as_py()):
                        held.append((file, *cell))
                        if len(held) >= BATCH:
                            yield rows_of(held)
                            held = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                    raise ValueError(f"{file} is no workbook: {e}") from e
                yield rows_of(held)

    def rows_of(held):
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], k) for i, k in enumerate(kinds)], [c.split()[0] for c in CELLS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!~.]*.xlsx").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, CELLS)


def sector_tables(cells: DataFrame) -> DataFrame:
    """The tables of sheets in long form: file, sheet, period, row, sector_code, sector_name, parent_code, is_total, metric
    and value.

    The period is in the file's name. A code is the number left of the name, as two digits, where every sector of the
    sheet has one of its own and no sector is indented; where numbers are ranks, it is the slug of the name. A
    metric is the slug of its column's header. Rows of notes have no measures and fall away; a cell without a number in a
    row that has others is a row with a null value.
    """
    sheet = ["file", "sheet"]
    named = cells.where(F.col("text").isNotNull() & ~F.trim("text").rlike("^[0-9]*$")).groupBy(*sheet, "col").agg(F.countDistinct("text").alias("n"))
    name_col = named.groupBy(*sheet).agg(F.max_by("col", F.struct("n", -F.col("col"))).alias("name_col"))
    placed = cells.join(name_col, sheet)
    rows = placed.groupBy(*sheet, "row", "name_col").agg(
        F.max(F.when(F.col("col") == F.col("name_col"), F.col("text"))).alias("name"),
        F.max(F.when(F.col("col") == F.col("name_col") - 1, F.coalesce("text", F.format_string("%.0f", "number")))).alias("number"),
        F.count(F.when(F.col("col") > F.col("name_col"), F.col("number"))).alias("n_measures"),
    )
    total = labels.slug(F.coalesce("name", F.lit(""))).isin(*TOTALS) | labels.slug(F.coalesce("number", F.lit(""))).isin(*TOTALS)
    numbered = F.coalesce(F.trim("number").rlike("^[0-9]+$"), F.lit(False))
    data = rows.withColumns({"is_total": total, "numbered": numbered}).where("n_measures > 0 AND (name IS NOT NULL OR is_total)")
    first = data.groupBy(*sheet).agg(F.min("row").alias("first_row"))
    # The nearest text above the table heads a column; a column of shares says so, or adds up to 100.
    heads = placed.join(first, sheet).where("row < first_row AND text IS NOT NULL AND col > name_col").groupBy(*sheet, "col").agg(F.max_by("text", "row").alias("head"))
    figures = placed.select(*sheet, "row", "col", F.col("number").alias("value"))
    totals = figures.join(data.where("is_total").select(*sheet, "row"), [*sheet, "row"]).groupBy(*sheet, "col").agg(F.max("value").alias("total"))
    columns = figures.join(name_col, sheet).join(data.select(*sheet, "row"), [*sheet, "row"]).where("col > name_col AND value IS NOT NULL").select(*sheet, "col").distinct().join(heads, [*sheet, "col"], "left").join(totals, [*sheet, "col"], "left")
    folded = labels.fold(F.coalesce("head", F.lit("")))
    share = F.exists(F.array(*map(F.lit, SHARES)), lambda w: F.contains(folded, w)) | (F.col("head").isNull() & F.coalesce(F.abs(F.col("total") - 100) < 0.5, F.lit(False)))
    columns = columns.where(~share).select(*sheet, "col", labels.slug(F.coalesce("head", F.concat(F.lit("column "), F.col("col").cast("string")))).alias("metric"))
    indented = F.startswith("name", F.lit(" ")) & ~F.col("numbered") & ~F.col("is_total")
    kinds = data.withColumn("indented", F.coalesce(indented, F.lit(False))).withColumn("own", labels.slug(F.coalesce("name", "number")))
    sectors = kinds.where("NOT is_total").groupBy(*sheet).agg((F.bool_and("numbered") & (F.count_distinct("number") == F.count("*")) & ~F.bool_or("indented")).alias("coded"))
    order = Window.partitionBy(*sheet).orderBy("row")
    above = F.last(F.when(~F.col("indented") & ~F.col("is_total"), F.col("own")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    parents = kinds.withColumn("parent_code", F.when(F.col("indented"), above)).join(sectors, sheet, "left")
    code = F.when(F.col("is_total"), "TOTAL").when(F.coalesce("coded", F.lit(False)), F.lpad(F.trim("number"), 2, "0")).otherwise(F.col("own"))
    bare = parents.select(*sheet, "row", code.alias("sector_code"), F.trim(F.coalesce("name", "number")).alias("sector_name"), "parent_code", "is_total", "indented")
    period = labels.date_of(F.regexp_extract("file", r"(\d{4})_(\d{2})", 1).try_cast("int"), F.regexp_extract("file", r"(\d{4})_(\d{2})", 2).try_cast("int"), F.lit(1))
    out = bare.join(columns, sheet).join(figures, [*sheet, "row", "col"], "left")
    return out.select(*sheet, period.alias("period"), "row", "sector_code", "sector_name", "parent_code", "is_total", "indented", "metric", "value")


def sector_errors(tables: DataFrame, mains: int | None = None, subs: int = 0) -> DataFrame:
    """(file, sheet, why): tables without a period or a total, of other than so many sectors, with a sub-sector before any
    main one, with a sector twice, or with a cell empty."""
    per_row = tables.groupBy("file", "sheet", "period", "row", "sector_code", "parent_code", "is_total", "indented").agg(F.bool_or(F.col("value").isNull()).alias("empty"))
    told = per_row.groupBy("file", "sheet", "period").agg(
        F.count_if("is_total").alias("totals"), F.count_if(F.expr("NOT is_total AND NOT indented")).alias("mains"), F.count_if("indented").alias("subs"), F.count_if(F.expr("indented AND parent_code IS NULL")).alias("orphans"),
        F.count_if("empty").alias("gaps"), (F.count("*") - F.count_distinct(F.struct(F.coalesce("parent_code", F.lit("")), "sector_code"))).alias("twice"),
    )
    wrong = F.lit(False) if mains is None else (F.col("mains") != mains) | (F.col("subs") != subs)
    faults = {"no period": F.col("period").isNull(), "no total": F.col("totals") != 1, "sectors": wrong, "a sub-sector before any sector": F.col("orphans") > 0, "an empty cell": F.col("gaps") > 0, "a sector twice": F.col("twice") > 0}
    found = told.select("file", "sheet", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(w)) for w, c in faults.items())))).alias("why"))
    return found
