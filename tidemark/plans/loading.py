"""Series for plans out of curated sources: which slice a step means, and every reason not to guess one.

A `Source` says what its columns are. A step that leaves out the metric or the currency gets the headline
ones, one aggregate tells which there are; a key that nothing has is repaired by discovery within its
source, and the citation says so. A request is never widened: not from a region to the country, not from
one source to another.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import labels, pages, registry
from tidemark.functions.labels import slug
from tidemark.plans import access, discovery
from tidemark.plans.artifact import Line, Quantity, Refused
from tidemark.plans.plan import Executor, Step
from tidemark.shared import materialize
from tidemark.sources import grids, published, workbooks
from tidemark.sources.zone import Zone

#: Metrics by how much they stand for a whole row, and the currency of totals.
HEADLINE = ("balance", "toplam", "toplam_nakdi", "nakdi", "rasyo")
TOTAL = "total"


@dataclass(frozen=True)
class Source:
    """Facts of one source. ``table`` is the name that citations give; columns that a source lacks are None.

    ``flow`` has the flows of year-to-date rows; ``region`` is summed over where a step names none, without
    ``abroad``. ``unit``, ``semantics`` and ``label`` are columns of the facts.
    """

    facts: DataFrame
    table: str
    key: str = "entity_key"
    metric: str | None = "metric"
    currency: str | None = "currency"
    dataset: str | None = "dataset"
    region: str | None = None
    abroad: tuple[str, ...] = ()
    value: str = "value"
    flow: str | None = None
    retired: str | None = None
    grain: str = "monthly"
    unit: str = "unit"
    semantics: str = "temporal_semantics"
    label: str = "entity_name"


def chosen(present: list[str | None], asked: str | None, preferred: tuple[str, ...], what: str) -> str | None:
    """The value of a column that a step means: the asked one, else a preferred one, else the only one."""
    there = sorted(p for p in present if p is not None)
    if asked is not None:
        if asked not in there:
            raise Refused(f"no {what} {asked!r}; there are {there}")
        return asked
    best = next((p for p in preferred if p in there), there[0] if len(there) == 1 else None)
    if best is None and there:
        raise Refused(f"name a {what} of {there}")
    return best


@dataclass(frozen=True)
class Slice:
    """Rows that agree in all that names a series: their columns' values, how many there are and how many live."""

    dataset: str | None
    metric: str | None
    currency: str | None
    kind: str | None
    unit: str | None
    n: int
    live: int
    label: tuple
    regions: frozenset[str]


def slices(source: Source, step: Step) -> list[Slice]:
    """What there is under a step's key, by one aggregate: a row for each dataset, metric, currency, kind and unit.

    Of regions only the spellings that the step's, or those abroad, have in the table.
    """
    named = [slug(F.lit(r)) for r in ([step.region] if step.region else source.abroad)]
    spelled = F.collect_set(F.when(slug(F.col(source.region)).isin(*named), F.col(source.region))) if source.region and named else F.array().cast("array<string>")
    live = F.col(source.retired).isNull() if source.retired and not step.include_retired else F.lit(True)
    columns = {"dataset": source.dataset, "metric": source.metric, "currency": source.currency, "kind": source.semantics, "unit": source.unit}
    by = [(F.col(c) if c else F.lit(None).cast("string")).alias(n) for n, c in columns.items()]
    rows = source.facts.where(F.col(source.key) == step.key)
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(live).alias("live"), F.max(F.struct("period", F.col(source.label).alias("label"))).alias("label"), spelled.alias("regions"))
    return [Slice(r.dataset, r.metric, r.currency, r.kind, r.unit, r.n, r.live, tuple(r.label), frozenset(r.regions)) for r in found.collect()]


def load(source: Source, step: Step) -> tuple[DataFrame, Line]:
    """(period, value) of the series a step means, with its line and a citation that reproduces it.

    One aggregate tells all that a step's key has; what the step leaves open is chosen from that. Each choice
    narrows the rows and is a condition of the citation, so its statement reads the same rows.
    """
    if step.region and not source.region:
        raise Refused(f"{source.table} has no regions, so {step.region!r} cannot be answered from it")
    found = slices(source, step)
    rows, conditions = source.facts.where(F.col(source.key) == step.key), [(source.key, "is", [step.key])]
    if not found:
        raise Refused(f"{source.table} has no {step.key!r}")
    if step.dataset and source.dataset:
        found = [x for x in found if x.dataset == step.dataset]
        if not found:
            raise Refused(f"{source.table} has no {step.key!r} in {step.dataset!r}")
    found = [x for x in found if x.live]
    if not found:
        raise Refused(f"{step.key!r} is retired; ask for it with include_retired")
    if source.retired and not step.include_retired:
        rows = rows.where(F.col(source.retired).isNull())
        conditions.append((source.retired, "null", []))
    for column, name, asked, preferred in ((source.dataset, "dataset", step.dataset, ()), (source.metric, "metric", step.metric, HEADLINE), (source.currency, "currency", step.currency, (TOTAL,))):
        if column:
            value = chosen(list({getattr(x, name) for x in found}), asked, preferred, name)
            if value is not None:
                rows, found = rows.where(F.col(column) == value), [x for x in found if getattr(x, name) == value]
                conditions.append((column, "is", [value]))
    kinds, units = {x.kind for x in found} - {None}, {x.unit for x in found} - {None}
    if len(kinds) > 1 or len(units) > 1:
        raise Refused(f"{step.key!r} mixes {sorted(kinds)} in {sorted(units)}")
    kind, unit = next(iter(kinds), "unknown"), next(iter(units), None)
    value, told = source.value, kind
    if kind == "cumulative_ytd" and source.flow and not step.year_to_date:
        value, told = source.flow, "flow"
    citation = {"table": source.table, "value_column": value}
    spelled = sorted(set().union(*(x.regions for x in found)))
    if source.region and step.region:
        if not spelled:
            raise Refused(f"{source.table} has no region {step.region!r}")
        rows = rows.where(F.col(source.region).isin(spelled))
        conditions.append((source.region, "in", spelled))
    elif source.region:
        if kind in ("ratio", "rate") or unit == "%":
            raise Refused(f"{step.key!r} is a ratio, which is never summed over regions; name one")
        rows = access.national_sum(rows, ["period"], source.region, list(source.abroad), value)
        if spelled:
            conditions.append((source.region, "not in", spelled))
        citation["summed"] = True
    citation["conditions"] = [list(c) for c in conditions]
    series = rows.select("period", F.col(value).cast("double").alias("value"))
    label = max((x.label for x in found), key=lambda p: (p[0] is not None, p[0], p[1] or ""))[1]
    line = Line(step.name or step.key.rsplit("/", 1)[-1], Quantity(told, unit), source.grain, label or step.key, source.table, citation=citation)
    return series, line


def executor(sources: dict[str, Source], index: DataFrame | None = None, domain: discovery.Domain | None = None, notes: DataFrame | None = None, zone: Zone | None = None, archived: Callable[[str], str] | None = None, **tools: Callable) -> Executor:
    """An executor over named sources; ``index`` makes discovery an operation and repairs keys that nothing has.

    ``notes`` are those of `published.read_notes`. ``archived`` gives the path at which a file has been put for its
    address; with it files are read as columns, and with ``zone`` whole sources are landed.
    """

    def fetch(step: Step) -> tuple[DataFrame, Line]:
        if step.source not in sources:
            raise Refused(f"no source {step.source!r}; there are {sorted(sources)}")
        source = sources[step.source]
        try:
            return load(source, step)
        except Refused:
            known = not source.facts.where(F.col(source.key) == step.key).isEmpty()
            near = None if known or index is None else discovery.discover(index.where(F.col("source") == step.source), (step.key or "").replace("_", " ").replace("/", " "), 1, domain).first()
            if near is None or near.key == step.key:
                raise
            series, line = load(source, replace(step, key=near.key))
            return series, replace(line, citation=line.citation | {"asked": step.key, "repaired": near.key})

    if index is not None:
        tools.setdefault("discover", lambda text: discovery.discover_concepts(index, text, domain=domain))
    if notes is not None:
        tools.setdefault("footnotes", lambda dataset: notes_of(notes, dataset))
    if archived is not None:
        spark = next(iter(sources.values())).facts.sparkSession if sources else zone.spark
        tools.setdefault("ingest_external", lambda step: external_column(spark, archived(step.url), step))
        if zone is not None:
            tools.setdefault("ingest_source", lambda url: land(zone, archived(url), url))
    return Executor(fetch, **tools)


def notes_of(notes: DataFrame, dataset: str, most: int = 20) -> list[dict]:
    """The notes of a dataset, those published last first, ``most`` of them; refuses a dataset without any."""
    found = notes.where(F.col("dataset") == dataset).orderBy(F.desc("last_period"), F.desc("n_periods"), "footnote").limit(most).collect()
    if not found:
        raise Refused(f"no notes of {dataset!r}")
    return [r.asDict() for r in found]


def external_column(spark: SparkSession, path: str, step: Step) -> tuple[DataFrame, Line]:
    """(period, value) of a column of a delimited file by month, with its line; its unit is as told, and not verified."""
    rule = step.rule or "last"
    if rule not in ("last", "avg", "sum"):
        raise Refused(f"unknown rule {rule!r}")
    frame = published.read_delimited(spark, path, step.value_column, step.period_column, rule)
    citation = {"url": step.url, "value_column": step.value_column, "rule": rule, "unit_verified": False}
    return frame, Line(step.name or step.value_column, Quantity("flow" if rule == "sum" else "unknown", step.unit), "monthly", step.value_column, "external", citation=citation)


def land(zone: Zone, path: str, url: str) -> dict:
    """Lands the series that an archived page or workbook holds: what has landed, and whether its content was there already.

    Its tables are read in tasks, one sheet or page each; a file without a series is refused.
    """
    spark = zone.spark
    content = spark.read.format("binaryFile").load(path)
    source_id, digest = content.select(pages.source_id(F.lit(url)), F.sha2("content", 256)).first()
    if zone.is_current(source_id, digest):
        return {"source_id": source_id, "unchanged": True}
    if path.lower().endswith(".xlsx"):
        found = grids.grid_series(workbooks.read_cells(spark, path).withColumn("text", F.coalesce("text", F.col("number").cast("string"))), ["sheet"])
    else:
        registry.register(spark)
        html = content.select(F.decode("content", "UTF-8").alias("html"))
        html.createOrReplaceTempView("__landed_page")
        found = spark.sql("SELECT 'page' AS sheet, s.name AS series_name, s.period, s.value FROM __landed_page, LATERAL page_series(html) s")
    rows = materialize(found.select(F.concat_ws("/", F.lit(source_id), labels.slug(F.col("sheet")), labels.slug(F.col("series_name"))).alias("series_key"), F.col("series_name").alias("name"), "period", "value"))
    if rows.isEmpty():
        raise Refused(f"{url} holds no series")
    series = rows.groupBy("series_key").agg(F.min("name").alias("name"))
    months = rows.groupBy("series_key", F.trunc("period", "month").alias("period")).agg(F.max_by("value", "period").alias("value"))
    native = rows.select("series_key", F.col("period").alias("date"), "value")
    version = zone.write(source_id, url, digest, {"series": series, "observations": months, "observations_native": native})
    return {"source_id": source_id, "unchanged": False, "version": version, "n_series": series.count()}
