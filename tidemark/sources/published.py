"""Readers of archived responses: monthly tables, series envelopes, item catalogues and weekly tables.

A response is one JSON file; Spark lists and splits the directory, and everything after the read is
DataFrame work, so an archive of any size is parsed in parallel. What must hold for a file is returned
as rows of failures by `check_*`, to be enforced before anything is written.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import labels
from tidemark.functions.pages import html_grids

# The layout of the archived responses and the columns that are not measures.
TABLE = "success BOOLEAN, Json STRUCT<colNames: ARRAY<STRING>, colModels: ARRAY<STRUCT<name: STRING>>, caption: STRING, uyari: STRING, data: STRUCT<rows: ARRAY<STRUCT<id: STRING, cell: ARRAY<STRING>>>>>"
META = ("BankaAdi", "BasitSira", "Ad", "BasitFont")
PROVINCE_META = ("EftKodu", "Yil", "Ay", "Sehir", "Grup")
SUFFIXES = (("Toplam", "total"), ("Tp", "TL"), ("Yp", "FX"))
ENVELOPE = "datagroup STRING, series ARRAY<STRING>, startDate STRING, endDate STRING, fetched_at STRING, response STRING"
CATALOGUE = "tables ARRAY<STRUCT<table_id: INT, items: ARRAY<STRUCT<item_id: INT, display: STRING, label: STRING>>>>"
SERIES = "SERIE_CODE STRING, DATAGROUP_CODE STRING, SERIE_NAME STRING, SERIE_NAME_ENG STRING, FREQUENCY_STR STRING, START_DATE STRING, END_DATE STRING, SEVIYE INT, UST_SERIE_CODE STRING"
GROUPS = "TOPIC_TITLE_TR STRING, DATAGROUPS ARRAY<STRUCT<DATAGROUP_CODE: STRING, DATAGROUP_TYPE: STRING, BIRIMI: STRING, DATASOURCE: STRING>>"
FREQUENCIES = {"GÜNLÜK": "daily", "İŞ GÜNÜ": "business_daily", "HAFTALIK(CUMA)": "weekly", "HAFTALIK(ÇARŞAMBA)": "weekly", "AYDA İKİ KEZ": "semimonthly", "AYLIK": "monthly", "ÜÇ AYLIK": "quarterly", "ALTI AYLIK": "semiannual", "YILLIK": "annual"}
WEEKLY = "request STRUCT<items: ARRAY<INT>>, table_html STRING"
RETIRED = r"\(?\s*(\d{1,2})[./](\d{1,2})[./](\d{4})\s*(?:tarihinden itibaren|itibariyle|sonras)"


def _json(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def number(text: Column) -> Column:
    """A cell: a plain number, else one with points for thousands and a comma; empty and other text is null."""
    bare = F.trim(text)
    return F.coalesce(bare.try_cast("double"), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"))


def split_measure(field: Column, simple: Column, by_currency: Column) -> Column:
    """(metric, currency) of a measure column. ``simple`` tables have nothing but currency columns;
    only tables split ``by_currency`` have suffixes that say one."""
    none = F.lit(None).cast("string")
    plain = F.struct(labels.slug(labels.split_camel(field)).alias("metric"), none.alias("currency"))
    out = plain
    for suffix, currency in reversed(SUFFIXES):
        stem = F.substring(field, F.lit(1), F.length(field) - len(suffix))
        ended = F.struct(labels.slug(labels.split_camel(stem)).alias("metric"), F.lit(currency).alias("currency"))
        whole = F.struct(F.when(simple, "balance").otherwise(suffix.lower()).alias("metric"), F.lit(currency).alias("currency"))
        out = F.when((simple | by_currency) & (field == suffix), whole).when(by_currency & ~simple & F.endswith(field, F.lit(suffix)), ended).otherwise(out)
    return out


def table_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The rows of monthly table files as published, one at least for each file: what `read_tables`, `check_tables` and
    `read_notes` all derive from, so that a caller can write them once and give them to each."""
    raw = _json(spark, path, TABLE).withColumn("names", F.transform("Json.colModels", lambda m: m["name"]))
    parts = [F.regexp_extract("file", r"(\d{4})_(\d{2})", i).try_cast("int") for i in (1, 2)]
    return raw.select("file", "names", "success", labels.date_of(parts[0], parts[1], F.lit(1)).alias("period"), labels.caption_unit(F.col("Json.caption")).alias("stated_unit"), F.col("Json.uyari").alias("note"), F.posexplode_outer("Json.data.rows").alias("pos", "row"))


def read_tables(spark: SparkSession, path: str, dataset: str, unit: str | None = None, semantics: str = "stock", hierarchy: str = "leading", entity_type: str = "item", rows: DataFrame | None = None, keep_file: bool = False) -> DataFrame:
    """Monthly tables of one dataset in long form: one row per period, entity, metric and currency.

    A ``leading`` parent comes before its italic children, a ``trailing`` one, in bold, after them. Cells
    without a number are left out. ``rows`` are those of `table_rows` if they have been read; ``keep_file`` adds the
    name of each row's file.
    """
    rows = (table_rows(spark, path) if rows is None else rows).where("row IS NOT NULL")
    at = lambda name: F.element_at("row.cell", F.array_position("names", name).cast("int"))
    rows = rows.select("file", "names", "period", "stated_unit", (F.col("pos") + 1).alias("row_position"), "row.cell", F.trim(at("Ad")).alias("label"), F.lower(F.trim(at("BasitFont"))).alias("font"))
    rows = rows.withColumn("d", labels.strip_decorations(F.col("label"))).withColumn("own_key", labels.slug(F.col("d.name")))
    order = Window.partitionBy("file").orderBy("row_position")
    if hierarchy == "leading":
        above = F.last(F.when(F.col("font") != "italic", F.col("own_key")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        parent = F.when(F.col("font") == "italic", above)
    elif hierarchy == "trailing":
        below = F.first(F.when(F.col("font") == "bold", F.col("own_key")), True).over(order.rowsBetween(1, Window.unboundedFollowing))
        parent = F.when(F.col("font") != "bold", below)
    else:
        raise ValueError(f"unknown hierarchy {hierarchy!r}")
    rows = rows.withColumn("parent_key", parent)
    measures = F.filter(F.arrays_zip("names", "cell"), lambda m: ~m["names"].isin(*META))
    fields = F.transform(measures, lambda m: m["names"])
    rows = rows.withColumns({"measures": measures, "simple": F.forall(fields, lambda f: f.isin("Tp", "Yp", "Toplam")), "by_currency": F.exists(fields, lambda f: f.rlike("(Tp|Yp)$"))})
    long = rows.withColumn("m", F.explode("measures")).withColumn("s", split_measure(F.col("m.names"), F.col("simple"), F.col("by_currency")))
    out = long.select(
        "period", F.lit(dataset).alias("dataset"), F.lit(entity_type).alias("entity_type"), labels.qualified(F.col("parent_key"), F.col("own_key")).alias("entity_key"), F.col("d.name").alias("entity_name"), "parent_key", "row_position", F.col("s.metric").alias("metric"), F.col("s.currency").alias("currency"),
        number(F.col("m.cell")).alias("value"), F.coalesce(F.col("d.unit"), F.col("stated_unit"), F.lit(unit).cast("string")).alias("unit"), F.lit(semantics).alias("temporal_semantics"), F.nullif(F.col("d.formula"), F.lit("")).alias("formula"), F.nullif(F.col("d.footnote"), F.lit("")).alias("footnote"),
        *(["file"] if keep_file else []),
    )
    return out.where("value IS NOT NULL")


def check_tables(spark: SparkSession, path: str, unit: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Files that report no success, have no rows or layout, no period in their name, or another unit than declared."""
    rows = (table_rows(spark, path) if rows is None else rows).groupBy("file", "success", "period", "stated_unit", "names").agg(F.count("row").alias("n"))
    layout = F.size(F.array_intersect("names", F.array(*map(F.lit, META[1:])))) == len(META) - 1
    why = F.when(~F.coalesce("success", F.lit(False)), "no success").when(F.col("n") == 0, "no rows").when(~F.coalesce(layout, F.lit(False)), "layout").when(F.col("period").isNull(), "no period")
    if unit:
        why = why.when(F.col("stated_unit").isNotNull() & (F.col("stated_unit") != unit), "unit")
    return rows.select("file", why.alias("why")).where("why IS NOT NULL")


def check_keys(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return observations.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def file_notes(rows: DataFrame, dataset: str) -> DataFrame:
    """dataset, footnote, period and file of every file with a note, from the rows of `table_rows`."""
    text = F.trim(F.regexp_replace(F.regexp_replace("note", "<[^>]+>", " "), r"\s+", " "))
    return rows.groupBy("file", "period").agg(F.first("note", True).alias("note")).select(F.lit(dataset).alias("dataset"), text.alias("footnote"), "period", "file").where("footnote <> ''")


def note_spans(notes: DataFrame) -> DataFrame:
    """Each distinct note of a dataset with the span and number of periods it was published for."""
    return notes.groupBy("dataset", "footnote").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count("*").alias("n_periods"))


def read_notes(spark: SparkSession, path: str, dataset: str, rows: DataFrame | None = None) -> DataFrame:
    """The notes of a dataset's files with their spans."""
    return note_spans(file_notes(table_rows(spark, path) if rows is None else rows, dataset))


def read_provinces(spark: SparkSession, path: str, dataset: str, unit: str) -> DataFrame:
    """Quarterly tables by province and group in long form."""
    rows = table_rows(spark, path).where("row IS NOT NULL")
    at = lambda name: F.element_at("row.cell", F.array_position("names", name).cast("int"))
    rows = rows.select(at("EftKodu").try_cast("int").alias("group_code"), labels.date_of(at("Yil").try_cast("int"), at("Ay").try_cast("int"), F.lit(1)).alias("period"), F.trim(at("Sehir")).alias("province"), F.trim(at("Grup")).alias("group_name"), F.filter(F.arrays_zip("names", "row.cell"), lambda m: ~m["names"].isin(*PROVINCE_META)).alias("m"))
    long = rows.withColumn("m", F.explode("m"))
    return long.select("period", F.lit(dataset).alias("dataset"), "province", "group_code", "group_name", labels.slug(labels.split_camel(F.col("m.names"))).alias("metric"), F.col("m.names").alias("metric_name"), number(F.col("m.cell")).alias("value"), F.lit(unit).alias("unit")).where("value IS NOT NULL")


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Series envelopes as (date, datagroup, series_code, value, grain); absent and empty values are left out."""
    raw = _json(spark, path, ENVELOPE).withColumn("items", F.from_json("response", "items ARRAY<MAP<STRING, STRING>>")["items"])
    items = raw.select("datagroup", "series", F.explode("items").alias("item")).select("datagroup", "item", F.explode("series").alias("series_code"))
    when = labels.parse_period_label(F.try_element_at("item", F.lit("Tarih")))
    value = F.try_element_at("item", F.replace("series_code", F.lit("."), F.lit("_"))).try_cast("double")
    return items.select(when["date"].alias("date"), "datagroup", "series_code", value.alias("value"), when["grain"].alias("grain")).where("value IS NOT NULL")


def reconcile_overlaps(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Year files overlap: each (series, date) once, and those that disagree."""
    one = observations.groupBy("datagroup", "series_code", "date").agg(F.min("value").alias("value"), F.max("value").alias("__most"), F.min("grain").alias("grain"))
    return one.drop("__most"), one.where(F.col("value") != F.col("__most")).select("datagroup", "series_code", "date")


def read_series_list(spark: SparkSession, path: str, groups_path: str, declared: DataFrame) -> DataFrame:
    """The catalogue of series: the archived lists beside what is known of their groups.

    ``declared`` says by datagroup its tier, semantics and monthly_rule, and may name a series_code where one
    series differs from its group; it is a registry of some hundred rows and is left to the planner to
    broadcast. A group without metadata leaves its columns null; a series of no declared group is left out.
    """
    rows = spark.read.schema(SERIES).option("multiLine", True).json(path)
    groups = spark.read.schema(GROUPS).option("multiLine", True).json(groups_path).select(F.trim("TOPIC_TITLE_TR").alias("category"), F.explode("DATAGROUPS").alias("g"))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    groups = groups.select(F.col("g.DATAGROUP_CODE").alias("datagroup"), F.trim("g.DATAGROUP_TYPE").alias("datagroup_name"), "category", text("g.BIRIMI").alias("unit_source"), text("g.DATASOURCE").alias("datasource"))
    of_group = declared.where("series_code IS NULL").drop("series_code")
    of_series = declared.where("series_code IS NOT NULL").select("datagroup", "series_code", *(F.col(c).alias(f"own_{c}") for c in ("tier", "semantics", "monthly_rule")))
    known = F.create_map(*(F.lit(x) for pair in FREQUENCIES.items() for x in pair))
    day = lambda c: F.try_to_date(F.col(c), "dd-MM-yyyy")
    joined = rows.withColumnsRenamed({"DATAGROUP_CODE": "datagroup", "SERIE_CODE": "series_code"}).join(of_group, "datagroup").join(of_series, ["datagroup", "series_code"], "left").join(groups, "datagroup", "left")
    semantics = F.coalesce("own_semantics", "semantics")
    return joined.select(
        "series_code", "datagroup", F.coalesce("own_tier", "tier").alias("tier"), F.trim("SERIE_NAME").alias("name"), text("SERIE_NAME_ENG").alias("name_en"), "datagroup_name", "category",
        labels.resolve_unit(F.col("SERIE_NAME"), F.col("unit_source"), semantics, F.col("own_semantics").isNotNull()).alias("unit"), "unit_source", "datasource",
        F.coalesce(F.try_element_at(known, F.col("FREQUENCY_STR")), F.col("FREQUENCY_STR")).alias("native_frequency"), semantics.alias("temporal_semantics"), F.coalesce("own_monthly_rule", "monthly_rule").alias("monthly_rule"),
        F.col("SEVIYE").alias("level"), F.nullif("UST_SERIE_CODE", F.lit("-1")).alias("parent_series"), day("START_DATE").alias("published_start"), day("END_DATE").alias("published_end"),
    )


def select_series(catalogue: DataFrame, wanted: list[str] | None = None, max_level: int | None = None) -> DataFrame:
    """A catalogue narrowed to listed codes, or to a level; a missing level counts as 1."""
    if wanted is not None:
        return catalogue.where(F.col("series_code").isin(*wanted)) if wanted else catalogue.limit(0)
    return catalogue if max_level is None else catalogue.where(F.coalesce("level", F.lit(1)) <= max_level)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The item catalogue of weekly tables: names, formulas, retirement, and positions among active items."""
    items = _json(spark, path, CATALOGUE).select(F.explode("tables").alias("t")).select("t.table_id", F.posexplode("t.items").alias("pos", "i"))
    label = F.col("i.label")
    gone = labels.date_of(*(F.regexp_extract(label, RETIRED, g).try_cast("int") for g in (3, 2, 1)))
    d = labels.strip_decorations(F.regexp_replace(label, r"\s*\([^()]*(?:itibaren|itibariyle|sonras)[^()]*\)\s*$", ""))
    items = items.select("table_id", "pos", "i.item_id", d.alias("d"), gone.alias("retired_on"))
    rank = F.row_number().over(Window.partitionBy("table_id", F.col("retired_on").isNull()).orderBy("pos"))
    return items.select("table_id", "item_id", F.when(F.col("retired_on").isNull(), rank).alias("row_position"), labels.slug(F.col("d.name")).alias("entity_key"), F.col("d.name").alias("entity_name"), F.nullif(F.col("d.formula"), F.lit("")).alias("formula"), "retired_on")


def attach_parents(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with the key of the one whose additive formula names their position, and positions claimed twice."""
    claims = items.where("formula IS NOT NULL AND retired_on IS NULL").select("table_id", F.col("entity_key").alias("parent_key"), F.explode(labels.formula_terms(F.col("formula"))).alias("t")).select("table_id", "parent_key", F.col("t.position").alias("row_position")).distinct()
    twice = claims.groupBy("table_id", "row_position").agg(F.countDistinct("parent_key").alias("n")).where("n > 1")
    one = claims.groupBy("table_id", "row_position").agg(F.min("parent_key").alias("parent_key"))
    return items.join(one, ["table_id", "row_position"], "left"), twice


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def first_grid(html: pd.Series) -> pd.Series:
    """The first table of every page of a batch as a grid."""
    return html.map(lambda h: next(iter(html_grids(h)), []))


def read_weekly(spark: SparkSession, path: str) -> DataFrame:
    """Weekly tables as (period, item_id, currency, value): after the date, three columns for each requested item."""
    rows = _json(spark, path, WEEKLY).select("request.items", F.explode(first_grid("table_html")).alias("row"))
    day = labels.parse_date(F.element_at("row", 1))
    cells = rows.where(day.isNotNull()).select(day.alias("period"), "items", F.posexplode(F.slice("row", 2, F.size("row"))).alias("pos", "cell"))
    currency = F.element_at(F.array(F.lit("TL"), F.lit("FX"), F.lit("total")), F.pmod("pos", F.lit(3)) + 1)
    item = F.try_element_at("items", F.floor(F.col("pos") / 3).cast("int") + 1)
    value = F.replace(F.replace(F.trim("cell"), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return cells.select("period", item.alias("item_id"), currency.alias("currency"), value.alias("value")).where("item_id IS NOT NULL AND value IS NOT NULL")


def read_delimited(spark: SparkSession, path: str, value_column: str, period_column: str | None = None, rule: str = "last", delimiter: str = ",") -> DataFrame:
    """A value column of a delimited file by month: number and date conventions are decided per column.

    Without ``period_column`` the first column is taken in which nine tenths of the cells are dates.
    """
    from tidemark.operators.series import aggregate_monthly

    raw = spark.read.option("header", True).option("sep", delimiter).csv(path)
    by_lower = {c.lower(): c for c in raw.columns}
    if value_column not in raw.columns:
        if value_column.lower() not in by_lower:
            raise ValueError(f"no column {value_column!r}; there are {raw.columns}")
        value_column = by_lower[value_column.lower()]
    others = [c for c in raw.columns if c != value_column]
    numeric = lambda c: F.avg(F.col(c).try_cast("double").isNotNull().cast("int"))
    facts = raw.agg(labels.comma_decimals(F.col(value_column)).alias("comma"), *(F.avg(labels.parse_date(F.col(c)).isNotNull().cast("int")).alias(f"d{i}") for i, c in enumerate(others)), *(numeric(c).alias(f"n{i}") for i, c in enumerate(others))).first()
    if period_column is None:
        good = [(-(facts[f"d{i}"] or 0), i, c) for i, c in enumerate(others) if (facts[f"d{i}"] or 0) >= 0.9 and (facts[f"n{i}"] or 0) < 0.5]
        if not good:
            raise ValueError(f"no column of {raw.columns} looks like dates; name one")
        period_column = min(good)[2]
    parsed = raw.select(labels.parse_date(F.col(period_column)).alias("date"), labels.parse_number(F.col(value_column), F.lit(facts.comma)).alias("value")).where("date IS NOT NULL AND value IS NOT NULL")
    return aggregate_monthly(parsed, [], "date", "value", rule).select("period", "value")
