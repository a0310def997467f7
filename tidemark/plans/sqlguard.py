"""Read-only SQL over known tables: the statement is parsed by Spark and its parsed plan is what is checked."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.artifact import Refused

#: Parsed plans of these kinds change something or reach outside, or hide what they name.
FORBIDDEN = re.compile(r"UnresolvedIdentifier|Insert|Create|Drop|Alter|Delete|Update|Merge|Truncate|Replace|Load|Set|Reset|Cache|Uncache|Refresh|Analyze|Command|Statement$|Describe|Explain|AddJar|AddFile|Script")

#: Groups of Spark's own functions that only compute from their arguments; the others read the session or the machine.
COMPUTING = frozenset("agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs xml_funcs".split())
TABLE_FUNCTIONS = frozenset(("range", "explode", "posexplode", "inline", "stack", "explode_outer", "posexplode_outer", "inline_outer"))
SUBQUERIES = frozenset(("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"))


def check_function(spark: SparkSession, parts: list[str], allowed: frozenset[str]) -> None:
    """Raises Refused unless a function is in a group of COMPUTING or among the ``allowed``; qualified names never are."""
    name = ".".join(parts).lower()
    if len(parts) == 1 and name in allowed:
        return
    catalyst = spark._jvm.org.apache.spark.sql.catalyst
    info = catalyst.analysis.FunctionRegistry.builtin().lookupFunction(catalyst.FunctionIdentifier(name)) if len(parts) == 1 else None
    if info is None or not info.isDefined() or info.get().getGroup() not in COMPUTING:
        raise Refused(f"the function {name} is not allowed")


def relations(spark: SparkSession, statement: str, allowed: frozenset[str] = frozenset()) -> set[str]:
    """Names of the tables that a query reads, without those it defines itself; raises Refused unless it is one query
    whose functions compute from their arguments only, or are among the ``allowed``."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as e:
        raise Refused(f"not one SQL query: {str(e).splitlines()[0][:200]}") from None
    found: set[str] = set()

    def walk(node, own: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if FORBIDDEN.search(kind):
            raise Refused(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedWith":
            pairs = node.cteRelations()
            for i in range(pairs.size()):
                walk(pairs.apply(i)._2().child(), own)
                own = own | {pairs.apply(i)._1().lower()}
        elif kind == "UnresolvedRelation":
            name = node.name().replace("`", "")
            if name.lower() not in own:
                found.add(name)
        elif kind == "UnresolvedTableValuedFunction" and (called := node.name().mkString(".").lower()) not in TABLE_FUNCTIONS | allowed:
            raise Refused(f"unknown table function {called}")
        elif kind == "Generate" and node.generator().getClass().getSimpleName() == "UnresolvedGenerator":
            check_function(spark, node.generator().name().unquotedString().split("."), allowed)
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), own)
        expressions = node.expressions()
        for i in range(expressions.size()):
            inside(expressions.apply(i), own)

    def inside(expression, own: frozenset[str]) -> None:
        kind = expression.getClass().getSimpleName()
        if "UnresolvedIdentifier" in kind:
            raise Refused(f"only plain names are allowed, not {kind}")
        if kind == "UnresolvedFunction":
            names = expression.nameParts()
            check_function(spark, [names.apply(i) for i in range(names.size())], allowed)
        elif kind == "UnresolvedGenerator":
            check_function(spark, expression.name().unquotedString().split("."), allowed)
        elif kind in SUBQUERIES:
            walk(expression.plan(), own)
        children = expression.children()
        for i in range(children.size()):
            inside(children.apply(i), own)

    walk(plan, frozenset())
    return found


def run_sql(spark: SparkSession, statement: str, tables: dict[str, DataFrame], limit: int = 200, functions: tuple[str, ...] = ()) -> DataFrame:
    """At most ``limit`` rows of one query over the given tables only; ``functions`` are registered ones that it may call."""
    unknown = {r for r in relations(spark, statement, frozenset(f.lower() for f in functions)) if r.lower() not in {t.lower() for t in tables}}
    if unknown:
        raise Refused(f"unknown tables: {sorted(unknown)}")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement).limit(limit)


@dataclass(frozen=True)
class Expectation:
    """What a statement must give: how many rows at least and at most, columns, and values somewhere in a column."""

    rows: tuple[int, int | None] = (1, None)
    columns: tuple[str, ...] = ()
    values: dict[str, float | str] = field(default_factory=dict, hash=False)
    tolerance: float = 0.0


def run_all(spark: SparkSession, statements: dict[str, tuple[str, Expectation]], tables: dict[str, DataFrame], limit: int = 200) -> DataFrame:
    """Runs named statements and says how each meets what is expected of it: (name, n_rows, met, why).

    A statement that is refused or fails does not stop the others. At most ``limit`` rows of each reach the driver.
    """
    out = []
    for name, (statement, expected) in statements.items():
        try:
            found = run_sql(spark, statement, tables, limit).toPandas()
        except Exception as e:
            out.append((name, 0, False, str(e).splitlines()[0][:300]))
            continue
        least, most = expected.rows
        why = [f"{len(found)} rows"] * (len(found) < least or (most is not None and len(found) > most))
        why += [f"no column {c}" for c in (*expected.columns, *expected.values) if c not in found.columns]
        for column, value in expected.values.items():
            near = (lambda x, v=value: abs(float(x) - v) <= expected.tolerance * abs(v)) if isinstance(value, int | float) else (lambda x, v=value: str(x) == v)
            if column in found.columns and not any(near(x) for x in found[column].dropna()):
                why.append(f"{column} is never {value}")
        out.append((name, len(found), not why, "; ".join(why) or None))
    return spark.createDataFrame(out, "name string, n_rows int, met boolean, why string")
