"""A typed plan of twelve operations and its executor over an Artifact.

A plan is data: steps with known fields only. Before running, steps that cannot run are dropped with
their reason and names are repaired; while running, a step that fails is recorded and the others go
on. The fetch window is widened by the longest lag and cut back at the end, so differences at its start
have their history.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import causality, changepoints, outliers, series
from tidemark.plans import findings
from tidemark.plans.artifact import Artifact, Line, Refused

OPS = ("discover", "fetch_series", "transform", "analyze", "find_periods", "chart", "footnotes", "ingest_source", "ingest_external", "read_url", "search", "clear_table")
TRANSFORMS = ("index_to_base", "deflate", "change", "net_change", "sum_columns", "ratio", "in_usd")
ANALYSES = ("anomaly", "changepoint", "causality", "decompose")
NEEDS = {"fetch_series": ("key",), "transform": ("operation",), "analyze": ("operation",), "find_periods": ("column",), "discover": ("query",), "read_url": ("url",), "search": ("query",), "ingest_source": ("url",), "ingest_external": ("url", "value_column"), "footnotes": ("dataset",)}


@dataclass(frozen=True)
class Step:
    """One operation and its arguments; what an operation does not use stays None."""

    op: str
    operation: str | None = None
    key: str | None = None
    source: str | None = None
    dataset: str | None = None
    currency: str | None = None
    metric: str | None = None
    column: str | None = None
    columns: tuple[str, ...] = ()
    against: str | None = None
    name: str | None = None
    periods: int | None = None
    base_period: str | None = None
    direction: str = "down"
    against_direction: str = "up"
    query: str | None = None
    url: str | None = None
    kind: str | None = None
    rule: str | None = None
    region: str | None = None
    year_to_date: bool = False
    include_retired: bool = False
    sensitivity: str | None = None
    window: int | None = None
    unit: str | None = None
    value_column: str | None = None
    period_column: str | None = None


#: The fields that each operation reads; a step with others is not what it seems and is dropped.
READS = {
    "discover": {"query"}, "fetch_series": {"key", "source", "dataset", "currency", "metric", "name", "rule", "region", "year_to_date", "include_retired"}, "transform": {"operation", "column", "columns", "against", "name", "periods", "base_period"},
    "analyze": {"operation", "column", "columns", "against", "kind", "sensitivity", "window"}, "find_periods": {"column", "columns", "direction", "against", "against_direction"}, "chart": {"columns", "kind"}, "footnotes": {"dataset"}, "ingest_source": {"url"},
    "ingest_external": {"url", "value_column", "period_column", "unit", "rule", "name"}, "read_url": {"url"}, "search": {"query"}, "clear_table": set(),
}


@dataclass(frozen=True)
class Plan:
    """Steps and the window of the answer."""

    steps: tuple[Step, ...]
    start: str | None = None
    end: str | None = None


def parse(raw: dict) -> tuple[Plan, list[str]]:
    """A plan from plain data, and why steps were dropped. Unknown fields of a step make it invalid."""
    known, steps, dropped = {f.name for f in fields(Step)}, [], []
    for i, item in enumerate(raw.get("steps", [])):
        extra, op = set(item) - known, item.get("op")
        why = f"unknown fields {sorted(extra)}" if extra else f"unknown op {op!r}" if op not in OPS else None
        if not why and (odd := {k for k, v in item.items() if v is not None} - READS[op] - {"op"}):
            why = f"{op} does not read {sorted(odd)}"
        if not why:
            step = Step(**{k: tuple(v) if k == "columns" else v for k, v in item.items()})
            step, why = repaired(step)
        if why:
            dropped.append(f"step {i}: {why}")
        else:
            steps.append(step)
    return Plan(tuple(steps), raw.get("start"), raw.get("end")), dropped


def repaired(step: Step) -> tuple[Step, str | None]:
    """A step with columns moved to where its operation reads them, and why it still cannot run."""
    if step.columns and not step.column and step.operation != "sum_columns" and step.op in ("transform", "analyze", "find_periods"):
        step = replace(step, column=step.columns[0], against=step.against or (step.columns[1] if len(step.columns) > 1 else None))
    if step.op == "transform" and step.name and step.name == step.column:
        step = replace(step, name=f"{step.name}_{step.operation}")
    for need in NEEDS.get(step.op, ()):
        if not getattr(step, need):
            return step, f"{step.op} needs {need}"
    if step.sensitivity is not None and step.sensitivity not in changepoints.MULTIPLES:
        return step, f"unknown sensitivity {step.sensitivity!r}"
    if step.window is not None and step.window < 3:
        return step, "a window has 3 periods or more"
    if step.op == "transform" and step.operation not in TRANSFORMS or step.op == "analyze" and step.operation not in ANALYSES:
        return step, f"unknown operation {step.operation!r}"
    return step, None


def longest_lag(plan: Plan) -> int:
    """Rows before the window that differences look back on."""
    return max([s.periods or 1 for s in plan.steps if s.op == "transform" and s.operation in ("change", "net_change")] + [1 for s in plan.steps if s.op == "find_periods"], default=0)


def widened(start: str | None, months: int) -> str | None:
    """A start so many months earlier."""
    if not start or not months:
        return start
    d = dt.date.fromisoformat(start)
    n = d.year * 12 + d.month - 1 - months
    return dt.date(n // 12, n % 12 + 1, 1).isoformat()


Loader = Callable[[Step], tuple[DataFrame, Line]]


@dataclass
class Outcome:
    """What a run gave: the table, facts by step, citations, and the steps that failed."""

    artifact: Artifact
    facts: list[dict] = field(default_factory=list)
    citations: list[dict] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)


class Executor:
    """Runs plans. ``load`` gives a step's series as (period, value) with its line; the other callables are
    optional, and an operation without its callable fails as a recorded step."""

    def __init__(self, load: Loader, **tools: Callable):
        self.load, self.tools = load, tools

    def run(self, plan: Plan, artifact: Artifact | None = None) -> Outcome:
        """Runs all steps in order and cuts the table to the plan's window."""
        out, early = Outcome(artifact or Artifact()), widened(plan.start, longest_lag(plan))
        for i, step in enumerate(plan.steps):
            try:
                getattr(self, f"_{step.op}")(step, out, (early, plan.end))
            except (Refused, ValueError, KeyError) as e:
                out.failed.append(f"step {i} {step.op}: {e}")
        if out.artifact.frame is not None:
            out.artifact = out.artifact.window(plan.start, plan.end)
        return out

    def _tool(self, name: str) -> Callable:
        if name not in self.tools:
            raise Refused(f"{name} is not available")
        return self.tools[name]

    def _discover(self, step, out, window):
        out.facts.append({"op": "discover", "found": self._tool("discover")(step.query)})

    def _fetch_series(self, step, out, window):
        frame, line = self.load(step)
        if line.grain in ("daily", "weekly"):
            frame = series.aggregate_monthly(frame.withColumnRenamed("period", "day"), [], "day", "value", step.rule or "last").select("period", "value")
        start, end = window
        if start:
            frame = frame.where(F.col("period") >= F.lit(start).cast("date"))
        if end:
            frame = frame.where(F.col("period") <= F.lit(end).cast("date"))
        twice = frame.groupBy("period").count().where("count > 1").limit(1).count()
        if twice:
            raise Refused(f"{step.key!r} has more than one value a period; name its metric or currency")
        if frame.where("value IS NOT NULL").isEmpty():
            raise Refused(f"{step.key!r} has no values in the window")
        name = step.name or line.column
        out.artifact = out.artifact.add(name, frame.withColumnRenamed("value", name), replace(line, column=name))
        out.citations.append({"column": name, "key": step.key, **line.citation})

    def _transform(self, step, out, window):
        a, name = out.artifact, step.name
        calls = {
            "index_to_base": lambda: a.index_to_base(step.column, step.base_period, name), "deflate": lambda: a.deflate(step.column, step.against, step.base_period, name), "change": lambda: a.change(step.column, step.periods or 1, name), "net_change": lambda: a.net_change(step.column, step.periods or 1, name),
            "sum_columns": lambda: a.sum_columns(list(step.columns), name), "ratio": lambda: a.ratio(step.column, step.against, name), "in_usd": lambda: a.in_usd(step.column, step.against, name),
        }
        out.artifact = calls[step.operation]()

    def _analyze(self, step, out, window):
        a, line = out.artifact, out.artifact.line(step.column)
        one = a.frame.select("period", F.lit(step.column).alias("key"), F.col(step.column).alias("value"))
        if step.operation == "decompose":
            found = a.decompose(step.column, step.against)
        elif step.operation == "anomaly":
            scores = outliers.score(one, ["key"], "auto", step.window or 12, semantics=line.quantity.kind)
            found = [r.asDict() for r in outliers.classify(scores, ["key"]).orderBy("period").collect()]
        elif step.operation == "changepoint":
            if line.quantity.kind == "cumulative_ytd":
                raise Refused(f"{step.column!r} is year-to-date; de-cumulate it first")
            level = line.quantity.kind in ("rate", "ratio") or line.unit == "%"
            kind = step.kind or ("level" if level else "trend")
            found = [r.asDict() for r in changepoints.change_points(one, ["key"], kind, step.sensitivity or "medium", in_points=level).orderBy("period").collect()]
        else:
            a.line(step.against)
            pair = a.frame.select("period", F.lit("pair").alias("key"), F.col(step.column).alias("target"), F.col(step.against).alias("predictor"))
            row = causality.granger_pairs(pair, ["key"], "target", "predictor").first()
            if row is None or row.reason:
                raise Refused(row.reason if row else "the table has no rows")
            found = row.asDict()
        out.facts.append({"op": step.operation, "column": step.column, "result": found})

    def _find_periods(self, step, out, window):
        out.artifact.line(step.column)
        hits = series.moves(out.artifact.frame, [], step.column, step.direction, step.against, step.against_direction).orderBy("period").collect()
        out.facts.append({"op": "find_periods", "column": step.column, "periods": [str(r.period) for r in hits]})

    def _chart(self, step, out, window):
        columns = list(step.columns) or list(out.artifact.lines)
        # Breaks that an earlier step found in a charted column are marked.
        breaks = sorted({str(r["period"]) for f in out.facts if f["op"] == "changepoint" and f["column"] in columns for r in f["result"]})
        out.facts.append({"op": "chart", "chart": out.artifact.chart(columns, step.kind or "line", tuple(breaks))})

    def _footnotes(self, step, out, window):
        out.facts.append({"op": "footnotes", "notes": self._tool("footnotes")(step.dataset)})

    def _ingest_source(self, step, out, window):
        out.facts.append({"op": "ingest_source", "source": self._tool("ingest_source")(step.url)})

    def _ingest_external(self, step, out, window):
        frame, line = self._tool("ingest_external")(step)
        name = step.name or line.column
        out.artifact = out.artifact.add(name, frame.withColumnRenamed("value", name), replace(line, column=name, origin="external"))
        out.citations.append({"column": name, "url": step.url, **line.citation})

    def _read_url(self, step, out, window):
        out.facts.append({"op": "read_url", "text": self._tool("read_url")(step.url)})

    def _search(self, step, out, window):
        out.facts.append({"op": "search", "hits": self._tool("search")(step.query)})

    def _clear_table(self, step, out, window):
        out.artifact = Artifact()


def verify(out: Outcome, asked: findings.Asked | None = None) -> list[str]:
    """What stops a result from being told; `findings.examine` has the rest."""
    found = findings.examine(out.artifact, out.facts, out.citations, out.failed, asked)
    return [p for f in found if f.stops for p in f.problems]
