"""Building the curated tables: read, check, derive, index and write.

Every check is a frame of the rows that fail. All checks of a build are counted in one union, so one
action decides; its rows are kept as the quality report beside the tables. A failed check that stops a
build raises before anything is written. A build's tables go to a folder of its own, and its report is
written last: readers follow the newest report, so they see a whole build or the one before.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import analytics, quality, series
from tidemark.shared import materialize
from tidemark.sources import published

KEYS = ["dataset", "entity_key", "metric", "currency"]
EDGE = ["dataset", "period", "metric", "currency"]
#: Two figures of one sum agree within two units or a twentieth of a percent.
ABSOLUTE, RELATIVE = 2.0, 0.0005


@dataclass(frozen=True)
class Dataset:
    """A declared monthly dataset and where its archive lies."""

    name: str
    path: str
    unit: str | None = None
    semantics: str = "stock"
    hierarchy: str = "leading"
    entity_type: str = "item"


@dataclass(frozen=True)
class Check:
    """Rows that fail, and whether one of them stops the build."""

    name: str
    failures: DataFrame
    stops: bool = True


def evidence(checks: list[Check]) -> DataFrame:
    """One row a check: passed, how many rows fail, and one of them as JSON."""
    rows = [c.failures.agg(F.count("*").alias("n_failures"), F.min(F.to_json(F.struct("*"))).alias("example")).select(F.lit(c.name).alias("check"), F.lit(c.stops).alias("stops"), "n_failures", "example") for c in checks]
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.col("n_failures") == 0)


def absent_periods(observations: DataFrame, lifecycles: DataFrame | None = None) -> DataFrame:
    """Periods that a dataset has and an entity has not, within the entity's registered life; an entity without
    a registered life is expected in all. ``lifecycles`` is (dataset, entity_key, first_valid, last_valid)."""
    have = observations.select("dataset", "entity_key", "period").distinct()
    entities = have.select("dataset", "entity_key").distinct()
    if lifecycles is None:
        lives = entities.withColumns({"first_valid": F.lit(None).cast("date"), "last_valid": F.lit(None).cast("date")})
    else:
        lives = entities.join(lifecycles.select("dataset", "entity_key", "first_valid", "last_valid"), ["dataset", "entity_key"], "left")
    due = lives.join(have.select("dataset", "period").distinct(), "dataset").where("(first_valid IS NULL OR period >= first_valid) AND (last_valid IS NULL OR period <= last_valid)")
    return due.select("dataset", "entity_key", "period").join(have, ["dataset", "entity_key", "period"], "left_anti")


def label_identities(observations: DataFrame) -> DataFrame:
    """Rows whose value is not the signed sum of the rows their own label names. Rows in percent, and sums of
    which a part is absent, are left out."""
    rows = observations.where("unit IS NULL OR unit <> '%'").withColumns({"currency": F.coalesce("currency", F.lit("")), "metric": F.coalesce("metric", F.lit(""))})
    stated = rows.where("formula IS NOT NULL").select(*EDGE, "entity_key", F.col("value").alias("stated"), F.explode(labels.formula_terms(F.col("formula"))).alias("t"))
    terms = stated.select(*EDGE, "entity_key", "stated", F.col("t.sign").alias("sign"), F.col("t.position").alias("row_position"))
    parts = rows.select(*EDGE, "row_position", "value")
    sums = terms.join(parts, [*EDGE, "row_position"], "left").groupBy(*EDGE, "entity_key", "stated").agg(F.sum(F.col("sign") * F.col("value")).alias("expected"), F.count("*").alias("n_terms"), F.count("value").alias("n_found"))
    return sums.where("n_terms = n_found").where(F.abs(F.col("stated") - F.col("expected")) > F.greatest(F.lit(ABSOLUTE), RELATIVE * F.abs("stated"))).drop("n_terms", "n_found")


def with_flows(observations: DataFrame) -> DataFrame:
    """Adds value_flow: year-to-date values as flows, null for other semantics. One window a series; rows of other
    semantics pass through it unchanged, so nothing is read twice."""
    flows = series.decumulate(observations, KEYS)
    return flows.withColumn("value_flow", F.when(F.col("temporal_semantics") == "cumulative_ytd", F.col("value_flow")))


def metric_catalogue(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics with their span and counts. Null keys are groups of their own."""
    return observations.groupBy(*keys).agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.countDistinct("period").alias("n_periods"), F.count("*").alias("n_observations"))


def entities(observations: DataFrame) -> DataFrame:
    """The index that searches go through: one row an entity, with what it is published in."""
    latest = observations.groupBy("dataset", "entity_key").agg(*(F.max_by(c, "period").alias(c) for c in ("entity_name", "parent_key", "unit", "temporal_semantics", "formula", "footnote")))
    index = analytics.entity_index(observations, ["dataset", "entity_key"], ["currency", "metric"])
    parents = observations.where("parent_key IS NOT NULL").select("dataset", F.col("parent_key").alias("entity_key"), F.col("entity_key").alias("child")).distinct().groupBy("dataset", "entity_key").agg(F.count("*").alias("n_children"))
    return index.join(latest, ["dataset", "entity_key"]).join(parents, ["dataset", "entity_key"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def monthly(spark: SparkSession, datasets: list[Dataset], lifecycles: DataFrame | None = None) -> tuple[dict[str, DataFrame], list[Check]]:
    """The monthly tables of all datasets and their checks.

    The archive is parsed once: its rows as published, and the observations made of them, are written to the shared
    folder, and every table and check reads those.
    """
    parsed = [materialize(published.table_rows(spark, d.path)) for d in datasets]
    read = [published.read_tables(spark, d.path, d.name, d.unit, d.semantics, d.hierarchy, d.entity_type, rows) for d, rows in zip(datasets, parsed, strict=True)]
    observations = materialize(with_flows(reduce(DataFrame.unionByName, read)))
    checks = [Check(f"layout of {d.name}", published.check_tables(spark, d.path, d.unit, rows)) for d, rows in zip(datasets, parsed, strict=True)]
    checks += [
        Check("monthly keys occur once", published.check_keys(observations, ["period", *KEYS])),
        Check("monthly entities are published throughout", absent_periods(observations, lifecycles)),
        Check("monthly labels state true sums", label_identities(observations)),
        Check("year-to-date values have flows", quality.missing_flows(observations.where("temporal_semantics = 'cumulative_ytd'"), KEYS, "value", "value_flow")),
    ]
    notes = reduce(DataFrame.unionByName, [published.read_notes(spark, d.path, d.name, rows) for d, rows in zip(datasets, parsed, strict=True)])
    return {"observations": observations, "entities": entities(observations), "metrics": metric_catalogue(observations, ["dataset", "metric", "currency", "unit"]), "footnotes": notes}, checks


def weekly(spark: SparkSession, path: str, catalogue: str) -> tuple[dict[str, DataFrame], list[Check]]:
    """The weekly tables: the item catalogue with parents, observations of its items, and their checks."""
    items, twice = published.attach_parents(published.read_items(spark, catalogue))
    rows = published.read_weekly(spark, path)
    facts = rows.join(items, "item_id").withColumns({"dataset": F.concat(F.lit("weekly_"), F.col("table_id")), "metric": F.lit("balance"), "unit": F.lit(None).cast("string")})
    live = facts.where("retired_on IS NULL")
    checks = [
        Check("weekly items are known", rows.join(items, "item_id", "left_anti").select("item_id").distinct()),
        Check("weekly positions have one parent", twice),
        Check("weekly keys occur once", published.check_keys(rows, ["period", "item_id", "currency"])),
        Check("weekly labels state true sums", label_identities(live)),
        Check("retired weekly items end", facts.where("period >= retired_on").select("item_id", "period"), stops=False),
    ]
    return {"weekly_items": items, "weekly_observations": facts}, checks


def macro(spark: SparkSession, archive: str, series_list: DataFrame, start: str, end: str) -> tuple[dict[str, DataFrame], list[Check]]:
    """The macro tables: native observations, months by each series' rule, and coverage by tier. ``series_list``
    is the catalogue of `published.read_series_list`, with monthly_rule and tier declared."""
    native, conflicts = published.reconcile_overlaps(published.read_envelopes(spark, archive))
    declared = native.join(series_list.select("series_code", "monthly_rule"), "series_code")
    months = series.aggregate_monthly(declared, ["series_code", "datagroup"], "date", "value", F.col("monthly_rule"))
    covered = coverage_verdict(months, series_list, start, end)
    checks = [
        Check("overlapping files agree", conflicts),
        Check("macro series are in the catalogue", native.join(series_list, "series_code", "left_anti").select("series_code").distinct()),
        Check("macro series have a unit", series_list.where("unit IS NULL").select("series_code"), stops=False),
        Check("headline macro series are complete", covered.where("strict AND n_missing > 0")),
        Check("other macro series are complete", covered.where("NOT strict AND n_missing > 0"), stops=False),
    ]
    return {"macro_native": native, "macro_observations": months, "macro_series": series_list}, checks


def coverage_verdict(months: DataFrame, series_list: DataFrame, start: str, end: str) -> DataFrame:
    """Per series: how many months it owes within its published span and the window, and how many are missing.
    Quarterly series owe the closing months of quarters only; series of tier 0 at the first level are strict,
    the others only reported. A series without any month misses all it owes."""
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    first = F.greatest(low, F.coalesce(F.trunc("published_start", "month"), low))
    last = F.least(high, F.coalesce(F.trunc("published_end", "month"), high))
    spine = F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))).otherwise(F.array().cast("array<date>"))
    quarterly = F.coalesce(F.col("native_frequency") == "quarterly", F.lit(False))
    owed = F.filter(spine, lambda m: ~quarterly | (F.month(m) % 3 == 0))
    have = months.groupBy("series_code").agg(F.collect_set("period").alias("have"))
    strict = (F.col("tier") == 0) & (F.coalesce("level", F.lit(1)) == 1)
    found = F.coalesce("have", F.array().cast("array<date>"))
    return series_list.join(have, "series_code", "left").select("series_code", F.coalesce(strict, F.lit(False)).alias("strict"), F.size(owed).alias("n_owed"), F.size(F.array_except(owed, found)).alias("n_missing"))


def agreement(pairs: DataFrame, keys: list[str], fine: str = "fine_value", coarse: str = "coarse_value", tolerance: float = 0.005) -> DataFrame:
    """Per pair of series: common periods, the largest relative difference, and whether it is within the tolerance.
    Periods whose coarse value is 0 say nothing."""
    gap = F.abs(F.try_divide(F.col(fine) - F.col(coarse), F.col(coarse)))
    return pairs.groupBy(*keys).agg(F.count(gap).alias("n_common"), F.max(gap).alias("largest"), F.coalesce(F.max(gap) <= tolerance, F.lit(False)).alias("agrees"))


def enforce(report: list) -> None:
    """Raises ValidationError with the checks of a report that stop a build."""
    failed = [r for r in report if r.stops and not r.passed]
    if failed:
        raise quality.ValidationError("; ".join(f"{r.check}: {r.n_failures} rows, such as {r.example}" for r in failed))


#: What slices name, in the order in which tables are laid out.
LAYOUT = ("dataset", "entity_key", "series_code", "metric", "currency", "period")


def laid_out(df: DataFrame, files: int | None = None) -> DataFrame:
    """The rows in ranges of what slices name, and in that order within each, so that the bounds of files and row groups
    tell a slice by dataset, key and period which few of them it needs. ``files`` is the number of ranges; by default
    the adaptive plan makes them of its usual size."""
    by = [c for c in LAYOUT if c in df.columns]
    if not by:
        return df
    return (df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)).sortWithinPartitions(*by)


def write(spark: SparkSession, out: str, tables: dict[str, DataFrame], checks: list[Check], files: int | None = None) -> str:
    """Writes all tables as one build and returns its name, or raises ValidationError with the checks that stop it."""
    report = evidence(checks).collect() if checks else []
    enforce(report)
    name = uuid.uuid4().hex
    for table, df in tables.items():
        laid_out(df, files).write.parquet(f"{out}/builds/{name}/{table}")
    schema = "check string, stops boolean, n_failures bigint, example string, passed boolean"
    done = spark.createDataFrame(report, schema).withColumns({"build": F.lit(name), "tables": F.lit(",".join(sorted(tables))), "finished_at": F.current_timestamp()})
    if not report:
        done = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema).schema), F.lit(name).alias("build"), F.lit(",".join(sorted(tables))).alias("tables"), F.current_timestamp().alias("finished_at"))
    done.coalesce(1).write.mode("append").parquet(f"{out}/reports")
    return name


def current(spark: SparkSession, out: str, views: bool = False) -> dict[str, DataFrame]:
    """The tables of the newest whole build, as temporary views too if asked."""
    newest = spark.read.parquet(f"{out}/reports").orderBy(F.desc("finished_at")).first()
    found = {t: spark.read.parquet(f"{out}/builds/{newest.build}/{t}") for t in newest.tables.split(",")}
    if views:
        for t, df in found.items():
            df.createOrReplaceTempView(t)
    return found
