"""What must hold of a result before it is told, and the statements that reproduce its columns.

Each check is a function of a `Case` that yields what is wrong, if anything. Facts about the data come
from one aggregate over the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import functions as F

from tidemark.plans.artifact import Artifact, Line

#: A column may lack a tenth of the periods that it could have.
MOST_MISSING = 0.1


@dataclass(frozen=True)
class Finding:
    """A check, what it found wrong (nothing if it passed), and whether that stops the answer."""

    check: str
    problems: tuple[str, ...]
    stops: bool

    @property
    def passed(self) -> bool:
        """Whether nothing is wrong."""
        return not self.problems


@dataclass(frozen=True)
class Asked:
    """What a question asked for, as far as a result can fall short of it."""

    analyses: tuple[str, ...] = ()
    limitations: tuple[str, ...] = ()
    missing_sources: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)
    metadata_only: bool = False
    cleared: bool = False


class Case:
    """A result beside what was asked."""

    def __init__(self, artifact: Artifact, facts: list[dict], citations: list[dict], failed: list[str], asked: Asked):
        self.artifact, self.facts, self.citations, self.failed, self.asked = artifact, facts, citations, failed, asked

    @property
    def lines(self) -> dict[str, Line]:
        """The lines of the table's columns."""
        return self.artifact.lines

    @property
    def empty(self) -> bool:
        """Whether there is no table."""
        return self.artifact.frame is None

    @cached_property
    def measured(self) -> dict[str, int]:
        """Rows, periods, rows that close a quarter, and for every column its values in all rows and in those."""
        closing = F.month("period") % 3 == 0
        columns = [f(c) for c in self.lines for f in (lambda c: F.count(F.col(c)).alias(f"all:{c}"), lambda c: F.count(F.when(closing, F.col(c))).alias(f"closing:{c}"))]
        return self.artifact.frame.agg(F.count("*").alias("rows"), F.countDistinct("period").alias("periods"), F.count_if(closing).alias("closing_rows"), *columns).first().asDict()

    def charts(self) -> Iterator[dict]:
        """Charts that were made."""
        return (f["chart"] for f in self.facts if f.get("op") == "chart")


_CHECKS: list[tuple[str, bool, bool, Callable]] = []


def check(stops: bool = True, table: bool = True):
    """Registers a check; those of a ``table`` are skipped where there is none."""

    def register(f):
        _CHECKS.append((f.__name__, stops, table, f))
        return f

    return register


@check(table=False)
def answers_what_was_asked(case):
    """Limits of what can be answered, and sources asked for by name that gave nothing."""
    yield from case.asked.limitations
    yield from (f"{s} gave nothing" for s in case.asked.missing_sources)


@check(table=False)
def roles_are_different_series(case):
    """Two roles of a question must not be played by one series."""
    played = list(case.asked.roles.values())
    yield from (f"{s} stands for several roles" for s in sorted({s for s in played if played.count(s) > 1}))


@check(stops=False, table=False)
def steps_ran(case):
    """Steps that failed."""
    yield from case.failed


@check(stops=False, table=False)
def analyses_ran(case):
    """Analyses that were asked for and not made."""
    made = {f.get("op") for f in case.facts}
    yield from (f"{a} was not made" for a in case.asked.analyses if a not in made)


@check(stops=False, table=False)
def charts_are_whole(case):
    """Notes of charts, and columns that a chart leaves out."""
    for chart in case.charts():
        if chart.get("note"):
            yield chart["note"]
        yield from (f"{c} is not in the chart" for c in chart.get("dropped", ()))


@check(table=False)
def there_is_a_table(case):
    """A table, unless it was cleared or only metadata was asked for."""
    if case.empty and not case.asked.cleared and not (case.asked.metadata_only and any(f.get("op") == "discover" for f in case.facts)):
        yield "no table"


@check()
def analyses_read_present_columns(case):
    """Analyses of columns that are gone."""
    yield from (f"{f['op']} read {f['column']}, which is gone" for f in case.facts if f.get("column") and f["column"] not in case.lines)


@check()
def columns_have_units(case):
    """Columns without a unit."""
    yield from (f"{c} has no unit" for c, x in case.lines.items() if not x.unit)


@check()
def columns_have_semantics(case):
    """Columns of unknown kind."""
    yield from (f"{c} is of unknown kind" for c, x in case.lines.items() if not x.quantity.kind or x.quantity.kind == "unknown")


@check()
def fetched_columns_are_cited(case):
    """Columns that nothing in the table made and that no citation names."""
    cited = {c["column"] for c in case.citations}
    yield from (f"{c} has no citation" for c, x in case.lines.items() if x.made is None and c not in cited)


@check()
def derived_columns_keep_inputs(case):
    """Derived columns of which an input, whichever, is gone."""
    known = set(case.lines) | {c["column"] for c in case.citations}
    for c, x in case.lines.items():
        gone = [i for i in x.made.inputs if i not in known] if x.made is not None else []
        if gone or (x.made is not None and not x.made.inputs):
            yield f"{c} is derived from what is not there: {gone}"


@check()
def columns_have_values(case):
    """Columns that are null throughout."""
    yield from (f"{c} has no values" for c in case.lines if not case.measured[f"all:{c}"])


@check(stops=False)
def columns_cover_the_periods(case):
    """Columns that lack more than a tenth of the periods; quarterly ones are judged by the months that close quarters."""
    for c, x in case.lines.items():
        part, whole = ("closing", "closing_rows") if x.grain == "quarterly" else ("all", "rows")
        due = case.measured[whole]
        if due and due - case.measured[f"{part}:{c}"] > MOST_MISSING * due:
            yield f"{c} has {case.measured[f'{part}:{c}']} of {due} periods"


@check()
def amounts_share_a_unit(case):
    """Amounts of money in several units; a price in money is none."""
    money = {x.unit for x in case.lines.values() if "TL" in (x.unit or "") and x.quantity.kind != "rate"}
    if len(money) > 1:
        yield f"mixed monetary units {sorted(money)}"


@check(stops=False)
def external_units_are_verified(case):
    """Columns whose unit was only read off a file."""
    yield from (f"the unit of {c} is not verified" for c, x in case.lines.items() if x.citation.get("unit_verified") is False)


@check()
def derived_columns_have_one_grain(case):
    """Columns made from others of different grains."""
    for c, x in case.lines.items():
        grains = {case.lines[i].grain for i in (x.made.inputs if x.made else ()) if i in case.lines} - {None}
        if len(grains) > 1:
            yield f"{c} joins {sorted(grains)}"


@check(stops=False)
def columns_have_one_grain(case):
    """A table of several grains."""
    grains = {x.grain for x in case.lines.values()} - {None}
    if len(grains) > 1:
        yield f"{sorted(grains)} side by side"


@check()
def periods_occur_once(case):
    """Periods that occur twice. The order of rows is made when they are shown."""
    if case.measured["rows"] != case.measured["periods"]:
        yield "a period occurs twice"


def examine(artifact: Artifact, facts: list[dict] = (), citations: list[dict] = (), failed: list[str] = (), asked: Asked | None = None) -> list[Finding]:
    """Every check of a result; those of the table only where there is one."""
    case = Case(artifact, list(facts), list(citations), list(failed), asked or Asked())
    return [Finding(name, tuple(f(case)), stops) for name, stops, table, f in _CHECKS if not (table and case.empty)]


def quoted(value) -> str:
    """A literal of SQL."""
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value)


def condition(column: str, test: str, values: list) -> str:
    """A condition of SQL on a quoted column: is, in, not in (which nulls are) or null."""
    name = "`" + column.replace("`", "``") + "`"
    listed = ", ".join(quoted(v) for v in values)
    if test == "null":
        return f"{name} IS NULL"
    if test == "is":
        return f"{name} <=> {listed}"
    if test == "in":
        return f"{name} IN ({listed})"
    if test == "not in":
        return f"({name} IS NULL OR {name} NOT IN ({listed}))"
    raise ValueError(f"unknown test {test!r}")


def reproducing_sql(citation: dict) -> str | None:
    """The statement that gives a cited column back, or None if the citation names no table.

    A citation says its table, its conditions (column, test, values), its span, the value column, and whether
    regions are summed; columns and tables are quoted, values escaped. Equalities may also be given as filters, and
    what is left out as without: column to value, or to a list of values.
    """
    if not citation.get("table"):
        return None
    name = lambda c: "`" + c.replace("`", "``") + "`"
    conditions = [condition(c, "is", [v]) for c, v in citation.get("filters", {}).items()]
    conditions += [condition(c, "not in", v if isinstance(v, list) else [v]) for c, v in citation.get("without", {}).items()]
    conditions += [condition(c, test, values) for c, test, values in citation.get("conditions", ())]
    conditions += [f"period {sign} DATE {quoted(citation[end])}" for end, sign in (("start", ">="), ("end", "<=")) if citation.get(end)]
    value = name(citation.get("value_column", "value"))
    summed = citation.get("summed")
    where = " WHERE " + " AND ".join(conditions) if conditions else ""
    return f"SELECT period, {f'sum({value})' if summed else value} AS value FROM {name(citation['table'])}{where}{' GROUP BY period' if summed else ''} ORDER BY period"
