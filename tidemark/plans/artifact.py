"""The table of an analysis: one row a period, one lineage a column, never changed in place.

Adding a column is a full join on the period, so a series of another span loses nothing. Every
operation first checks units, grains and temporal semantics and refuses what would be a wrong number.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import analytics, series


class Refused(ValueError):
    """An operation whose result would not mean what it says."""


#: What numbers of a kind are, and what their units add to that. Guards speak of these traits only.
KIND_TRAITS = {"stock": {"amount", "level"}, "flow": {"amount"}, "net_change": {"amount"}, "cumulative_ytd": {"running"}, "index": {"price"}, "rate": {"price"}, "ratio": {"price"}}
COUNTED = {"endeks", "adet", "gün", "gun", "kişi", "kisi"}


@dataclass(frozen=True)
class Quantity:
    """A kind of number and its unit."""

    kind: str = "unknown"
    unit: str | None = None

    @property
    def traits(self) -> set[str]:
        """All traits of the kind and the unit."""
        found, unit = set(KIND_TRAITS.get(self.kind, ())), (self.unit or "").lower()
        found |= {"percent", "without size"} if unit == "%" else {"without size"} if unit in COUNTED or not unit else set()
        return found | ({"lira"} if "TL" in (self.unit or "") else set())


@dataclass(frozen=True)
class Rule:
    """Which quantities an operation takes, first and others, what it gives and what it calls its result."""

    name: str
    needs: frozenset[str] = frozenset()
    bars: frozenset[str] = frozenset()
    other_needs: frozenset[str] = frozenset()
    alike: tuple[str, ...] = ()
    kind: str | None = None
    unit: str | None = None

    def result(self, first: Quantity) -> Quantity:
        """The quantity of the result."""
        return Quantity(self.kind or first.kind, self.unit or first.unit)


PERCENT, SIZELESS, RUNNING = frozenset({"percent"}), frozenset({"without size"}), frozenset({"running"})
RULES = {
    "index_to_base": Rule("{0}_index", bars=PERCENT, kind="index", unit="endeks"),
    "deflate": Rule("{0}_real", bars=PERCENT, other_needs=frozenset({"price"})),
    "change": Rule("{0}_growth_{n}", bars=RUNNING, kind="rate", unit="%"),
    "net_change": Rule("{0}_difference_{n}", needs=frozenset({"level"}), bars=SIZELESS, kind="net_change"),
    "sum_columns": Rule("sum_of_{all}", needs=frozenset({"amount"}), bars=SIZELESS, other_needs=frozenset({"amount"}), alike=("unit", "kind", "grain")),
    "ratio": Rule("{0}_per_{1}", alike=("unit", "grain"), kind="ratio"),
    "in_usd": Rule("{0}_usd", needs=frozenset({"lira"})),
    "decompose": Rule("{0}", bars=PERCENT, other_needs=frozenset({"price"})),
    "pie": Rule("{0}", bars=SIZELESS, alike=("unit",)),
}


@dataclass(frozen=True)
class Made:
    """The operation that made a column, the columns that it read, and its details, such as periods."""

    operation: str
    inputs: tuple[str, ...]
    details: tuple[str, ...] = ()

    def __str__(self) -> str:
        return f"{self.operation}({', '.join((*self.inputs, *map(str, self.details)))})"


@dataclass(frozen=True)
class Line:
    """What a column's numbers are, and where they come from: a published series or an operation."""

    column: str
    quantity: Quantity = Quantity()
    grain: str | None = None
    label: str = ""
    origin: str | None = None
    made: Made | None = None
    citation: dict = field(default_factory=dict, hash=False)

    @property
    def unit(self) -> str | None:
        """The unit of the numbers."""
        return self.quantity.unit

    def metadata(self) -> dict:
        """The lineage as column metadata, which Spark keeps through joins and filters."""
        return {"kind": self.quantity.kind, "unit": self.unit, "grain": self.grain, "label": self.label or self.column, "origin": self.origin, "made": str(self.made) if self.made else None}


@dataclass(frozen=True)
class Artifact:
    """A period-indexed frame and the lines of its columns."""

    frame: DataFrame | None = None
    lines: dict[str, Line] = field(default_factory=dict)

    def add(self, column: str, frame: DataFrame, line: Line, how: str = "full") -> Artifact:
        """The table with a column of (period, column) beside the others."""
        one = frame.select("period", F.col(column).alias(column, metadata=line.metadata()))
        kept = self.frame.drop(column) if self.frame is not None and column in self.lines else self.frame
        rest = {k: v for k, v in self.lines.items() if k != column}
        return Artifact(one if kept is None else kept.join(one, "period", how), rest | {column: line})

    def admit(self, operation: str, columns: list[str]) -> list[Line]:
        """The lines of an operation's columns, if its rule takes them."""
        rule, lines = RULES[operation], [self.line(c) for c in columns]
        for i, x in enumerate(lines):
            traits, needs = x.quantity.traits, rule.other_needs if i else rule.needs
            if (missing := needs - traits) or (barred := rule.bars & traits if not i or rule.other_needs == rule.needs else set()):
                raise Refused(f"{operation}: {x.column!r} is {x.quantity.kind} in {x.unit}, " + (f"not {' and '.join(sorted(missing))}" if missing else f"so {' and '.join(sorted(barred))}"))
        for what in rule.alike:
            found = {getattr(x, what, None) or getattr(x.quantity, what, None) for x in lines} - ({None} if operation == "ratio" and what == "grain" else set())
            if len(found) > 1:
                raise Refused(f"{operation}: {columns} differ in {what}: {sorted(map(str, found))}")
        return lines

    def _derive(self, operation: str, columns: list[str], name: str | None, compute, periods: int = 1, quantity: Quantity | None = None, detail: tuple[str, ...] = ()) -> Artifact:
        """The table with the column that ``compute(name)`` adds, under the name and quantity of the rule."""
        first, rule = self.admit(operation, columns)[0], RULES[operation]
        name = name or rule.name.format(*columns, n=periods, all="_".join(columns))
        line = Line(name, quantity or rule.result(first.quantity), first.grain, first.label, None, Made(operation, tuple(columns), tuple(detail)))
        frame = compute(name)
        return Artifact(frame.withColumn(name, F.col(name).alias(name, metadata=line.metadata())), self.lines | {name: line})

    def line(self, column: str) -> Line:
        """A column's lineage; refuses unknown columns."""
        if column not in self.lines:
            raise Refused(f"no column {column!r}; there are {sorted(self.lines)}")
        return self.lines[column]

    def index_to_base(self, column: str, base_period: str | None = None, name: str | None = None) -> Artifact:
        """100 at the base period."""
        self.admit("index_to_base", [column])
        base = series.base_value(self.frame, [], base_period, column).first()
        if base is None or not base.base:
            raise Refused(f"{column!r} has nothing to index by at {base_period or 'its start'}")
        return self._derive("index_to_base", [column], name, lambda n: series.index_to_base(self.frame, [], base_period, column, n), detail=(str(base.base_period),))

    def deflate(self, column: str, deflator: str, base_period: str | None = None, name: str | None = None) -> Artifact:
        """In prices of the base period."""
        return self._derive("deflate", [column, deflator], name, lambda n: series.deflate(self.frame, [], deflator, base_period, column, n))

    def change(self, column: str, periods: int = 1, name: str | None = None) -> Artifact:
        """Percent change over ``periods`` rows."""
        return self._derive("change", [column], name, lambda n: series.change(self.frame, [], whole_number(periods), column, n), periods, detail=(str(periods),))

    def net_change(self, column: str, periods: int = 1, name: str | None = None) -> Artifact:
        """Difference of a stock over ``periods`` rows."""
        return self._derive("net_change", [column], name, lambda n: series.net_change(self.frame, [], whole_number(periods), column, n), periods, detail=(str(periods),))

    def sum_columns(self, columns: list[str], name: str | None = None) -> Artifact:
        """The sum of amounts of one kind."""
        if len(columns) < 2 or len(set(columns)) < len(columns):
            raise Refused(f"sum_columns: {columns} are not two or more different columns")
        return self._derive("sum_columns", columns, name, lambda n: self.frame.withColumn(n, series.sum_columns(columns)))

    def ratio(self, a: str, b: str, name: str | None = None, as_percent: bool = True) -> Artifact:
        """One column over another of the same unit and grain."""
        value = series.share(a, b) if as_percent else series.safe_ratio(F.col(a), F.col(b))
        return self._derive("ratio", [a, b], name, lambda n: self.frame.withColumn(n, value), quantity=Quantity("ratio", "%" if as_percent else "oran"))

    def in_usd(self, column: str, rate: str, name: str | None = None) -> Artifact:
        """A TL amount at a TL rate."""
        (line,), fx = self.admit("in_usd", [column]), self.line(rate)
        if fx.unit != "TL":
            raise Refused(f"in_usd: {rate!r} is in {fx.unit}, not in TL a dollar")
        dollars = Quantity(line.quantity.kind, line.unit.replace("TL", "USD"))
        return self._derive("in_usd", [column, rate], name, lambda n: self.frame.withColumn(n, series.safe_ratio(F.col(column), F.col(rate))), quantity=dollars)

    def window(self, start: str | None = None, end: str | None = None) -> Artifact:
        """Periods from start to end. Applied after differences, whose lags need what lies before."""
        frame = self.frame
        if start:
            frame = frame.where(F.col("period") >= F.lit(start).cast("date"))
        if end:
            frame = frame.where(F.col("period") <= F.lit(end).cast("date"))
        return replace(self, frame=frame)

    def subset(self, columns: list[str]) -> Artifact:
        """Some columns; periods with none of them are dropped."""
        for c in columns:
            self.line(c)
        return Artifact(self.frame.select("period", *columns).na.drop("all", subset=columns), {c: self.lines[c] for c in columns})

    def summary(self) -> list[dict]:
        """First, last, extremes and change of every column, in one pass."""
        return [r.asDict() for r in series.summarise(self.frame, {c: x.unit for c, x in self.lines.items()}).collect()]

    def decompose(self, nominal: str, deflator: str) -> dict:
        """Growth of an amount split into price and real growth."""
        self.admit("decompose", [nominal, deflator])
        found = series.decompose_growth(self.frame, [], nominal, deflator).first()
        if found is None:
            raise Refused("two aligned observations are needed")
        years = series.year_end_growth(self.frame, [], nominal, deflator).orderBy("year").collect()
        return found.asDict() | {"by_year": [y.asDict() for y in years]}

    def by_unit(self) -> list[list[str]]:
        """Columns grouped by unit."""
        groups: dict[str | None, list[str]] = {}
        for c, x in self.lines.items():
            groups.setdefault(x.unit, []).append(c)
        return list(groups.values())

    def to_markdown(self, rows: int = 6) -> str:
        """The first and last rows as a table."""
        names = ["period", *self.lines]
        head = analytics.head_tail(self.frame.select(names), rows).orderBy("period").collect()
        cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
        return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in head)])

    def chart(self, columns: list[str] | None = None, kind: str = "line", breaks: tuple[str, ...] = ()) -> dict:
        """A chart as data: traces, axes by unit (two at most; beyond that all are rebased to 100), break markers.

        A pie takes the last period of columns in one additive unit that are not negative.
        """
        columns = columns or list(self.lines)
        units = list(dict.fromkeys(self.line(c).unit for c in columns))
        picked = self.subset(columns)
        if kind == "pie":
            self.admit("pie", columns)
            last = analytics.latest(picked.frame).first()
            if any((last[c] or 0) < 0 for c in columns):
                raise Refused("pie: parts below zero")
            return {"kind": "pie", "unit": units[0], "period": str(last.period), "slices": {c: last[c] for c in columns}}
        rebased = len(units) > 2
        frame = picked.frame
        if rebased:
            for c in columns:
                frame = series.index_to_base(frame, [], None, c, f"{c}__i").drop(c).withColumnRenamed(f"{c}__i", c)
            units = ["endeks"]
        rows = frame.orderBy("period").collect()
        axis = lambda c: 1 if rebased else units.index(self.lines[c].unit) + 1
        return {"kind": kind, "units": units, "rebased": rebased, "x": [str(r.period) for r in rows], "traces": [{"column": c, "label": self.lines[c].label or c, "axis": axis(c), "y": [r[c] for r in rows]} for c in columns], "breaks": list(breaks)}


def whole_number(periods) -> int:
    """A number of periods to look back; refuses what is none."""
    if type(periods) is not int or periods < 1:
        raise Refused(f"{periods!r} is no number of periods")
    return periods
