import datetime as dt

import pytest

from tidemark.plans.artifact import Artifact, Line, Quantity, Refused
from tidemark.plans.plan import Executor, Plan, Step, parse, verify, widened
from tidemark.plans.sqlguard import relations, run_sql


def frame(spark, values, start=2020):
    return spark.createDataFrame([(dt.date(start + i // 12, i % 12 + 1, 1), float(v)) for i, v in enumerate(values)], "period date, value double")


@pytest.fixture
def loaded(spark):
    data = {"loans": (frame(spark, [100 + 5 * i for i in range(36)]), Line("loans", Quantity("stock", "milyon TL"), "monthly", origin="s/loans")), "prices": (frame(spark, [50 + i for i in range(36)]), Line("prices", Quantity("index", "endeks"), "monthly", origin="s")), "rate": (frame(spark, [20 - i % 3 for i in range(36)]), Line("rate", Quantity("rate", "%"), "monthly", origin="s"))}
    return lambda step: data[step.key]


def test_a_plan_end_to_end(loaded):
    raw = {"start": "2021-01-01", "end": "2021-12-01", "steps": [{"op": "fetch_series", "key": "loans"}, {"op": "fetch_series", "key": "prices"}, {"op": "fetch_series", "key": "rate"}, {"op": "transform", "operation": "deflate", "columns": ["loans", "prices"]}, {"op": "transform", "operation": "change", "column": "loans", "periods": 12}, {"op": "transform", "operation": "index_to_base", "column": "rate"}, {"op": "analyze", "operation": "decompose", "column": "loans", "against": "prices"}, {"op": "find_periods", "column": "rate"}, {"op": "chart"}, {"op": "search", "query": "x"}, {"op": "dance"}, {"op": "fetch_series", "key": "x", "colour": 1}]}
    plan, dropped = parse(raw)
    assert len(dropped) == 2 and len(plan.steps) == 10
    out = Executor(loaded).run(plan)
    assert [f.split(":")[0] for f in out.failed] == ["step 5 transform", "step 9 search"]
    rows = out.artifact.frame.orderBy("period").collect()
    assert len(rows) == 12 and rows[0].loans_growth_12 == pytest.approx(100 * (160 / 100 - 1))
    assert out.artifact.lines["loans_real"].unit == "milyon TL" and out.artifact.frame.schema["loans_real"].metadata["made"] == "deflate(loans, prices)"
    facts = {f["op"]: f for f in out.facts}
    assert facts["chart"]["chart"]["rebased"] and facts["find_periods"]["periods"] and facts["decompose"]["result"]["real_pct"] < 150
    assert verify(out) == []


def test_guards_refuse(spark, loaded):
    a = Artifact()
    for k in ("loans", "rate"):
        df, line = loaded(Step("fetch_series", key=k))
        a = a.add(k, df.withColumnRenamed("value", k), line)
    weekly = a.add("w", loaded(Step("f", key="loans"))[0].withColumnRenamed("value", "w"), Line("w", Quantity("stock", "milyon TL"), "weekly"))
    ytd = a.add("y", loaded(Step("f", key="loans"))[0].withColumnRenamed("value", "y"), Line("y", Quantity("cumulative_ytd", "milyon TL")))
    for call in (lambda: a.index_to_base("rate"), lambda: a.deflate("loans", "loans"), lambda: a.ratio("loans", "rate"), lambda: weekly.ratio("loans", "w"), lambda: ytd.change("y"), lambda: a.net_change("rate"), lambda: a.sum_columns(["loans", "rate"]), lambda: a.in_usd("rate", "loans"), lambda: a.change("nothing"), lambda: a.net_change("loans", 0), lambda: a.chart(["rate"], "pie")):
        with pytest.raises(Refused):
            call()
    assert weekly.sum_columns  # the table itself is unchanged by refusals
    assert len(a.summary()) == 2 and "| period |" in a.to_markdown(2)


def test_outer_add_keeps_all_periods(spark):
    a = Artifact().add("a", frame(spark, range(24)).withColumnRenamed("value", "a"), Line("a")).add("b", frame(spark, range(24), 2021).withColumnRenamed("value", "b"), Line("b"))
    assert a.frame.count() == 36 and a.subset(["b"]).frame.count() == 24
    assert widened("2021-01-01", 13) == "2019-12-01" and widened(None, 3) is None


def test_sql_guard(spark):
    t = {"facts": frame(spark, range(5))}
    assert run_sql(spark, "WITH c AS (SELECT * FROM facts WHERE value > (SELECT avg(value) FROM facts)) SELECT count(*) AS n FROM c", t).first().n == 2
    assert run_sql(spark, "SELECT * FROM facts", t, 3).count() == 3
    assert relations(spark, "SELECT * FROM a, b WHERE x IN (SELECT y FROM c)") == {"a", "b", "c"}
    for bad in ("DROP TABLE facts", "SELECT * FROM other", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc`", "INSERT INTO facts VALUES (1)", "SELECT * FROM facts, secret", "SELECT * FROM facts WHERE value IN (SELECT v FROM secret)", "SET spark.x=1", "SELECT reflect('java.lang.System', 'exit', 1) FROM facts"):
        with pytest.raises(Refused):
            run_sql(spark, bad, t)


def test_sql_guard_knows_functions_by_the_plan(spark):
    from tidemark.functions import registry
    from tidemark.plans.sqlguard import Expectation, run_all

    t = {"facts": frame(spark, range(5))}
    outside = ("java_method", "reflect", "try_reflect", "input_file_name", "current_user", "uuid", "raise_error")
    arguments = "'java.lang.System', 'getProperty', 'user.home'"
    for bad in (
        *(f"SELECT {f}({arguments}) FROM facts" for f in outside), f"select `java_method`({arguments})", f"select reflect/**/({arguments})", f"SELECT max(upper(JAVA_METHOD({arguments}))) OVER (PARTITION BY 1) FROM facts", f"SELECT builtin.reflect({arguments})", f"SELECT system.builtin.reflect({arguments})",
        f"SELECT IDENTIFIER('reflect')({arguments})", "SELECT * FROM IDENTIFIER('secret')", f"SELECT transform(array(1), x -> reflect({arguments}))", f"SELECT * FROM facts WHERE EXISTS (SELECT reflect({arguments}))", f"SELECT * FROM facts LATERAL VIEW reflect({arguments}) v", "SELECT no_such_function(value) FROM facts", f"WITH c AS (SELECT reflect({arguments}) AS x) SELECT * FROM c",
        f"SELECT * FROM VALUES (reflect({arguments})) AS v(x)", f"SELECT count(*) FROM facts GROUP BY reflect({arguments}) HAVING max(value) > 0", f"SELECT * FROM facts ORDER BY reflect({arguments})", f"SELECT * FROM facts a JOIN facts b ON a.value = reflect({arguments})", "SELECT * FROM sql_keywords()",
    ):
        with pytest.raises(Refused):
            run_sql(spark, bad, t)
    good = (
        "SELECT count(*) AS n, sum(value) AS s, percentile(value, 0.5) AS p, max_by(value, period) AS m FROM facts", "SELECT lag(value) OVER (ORDER BY period) AS l, row_number() OVER (ORDER BY period) AS r FROM facts", "SELECT upper('a') || 'b' AS u, coalesce(NULL, 1) AS c, date_trunc('month', period) AS d, cast(value AS int) AS i FROM facts",
        "SELECT transform(array(1, 2), x -> x + 1) AS t, to_json(named_struct('a', 1)) AS j, CASE WHEN value > 1 THEN 1 END AS k, value BETWEEN 1 AND 2 AS b, value IN (1, 2) AS i, try_divide(1, 0) AS z FROM facts", "SELECT x FROM facts LATERAL VIEW explode(array(1, 2)) v AS x", "SELECT * FROM range(3)", "SELECT current_date() AS d", "SELECT period FROM facts GROUP BY ALL",
    )
    assert all(run_sql(spark, sql, t).count() for sql in good)
    registry.register(spark)
    with pytest.raises(Refused, match="slug_text"):
        run_sql(spark, "SELECT slug_text('A b') AS s", t)
    assert run_sql(spark, "SELECT slug_text('A b') AS s", t, functions=("slug_text",)).first().s == "a_b"
    said = {r.name: (r.met, r.why) for r in run_all(spark, {"rows": ("SELECT * FROM facts", Expectation((5, 5), ("value",))), "few": ("SELECT * FROM facts", Expectation((9, None))), "value": ("SELECT sum(value) AS s FROM facts", Expectation(values={"s": 1e9})), "near": ("SELECT 100.4 AS s, 'a' AS t", Expectation(values={"s": 100.0, "t": "a"}, tolerance=0.01)), "bad": ("DROP TABLE facts", Expectation())}, t).collect()}
    assert said["rows"] == said["near"] == (True, None) and said["few"] == (False, "5 rows") and said["value"][1] == "s is never 1000000000.0" and not said["bad"][0]


def test_failing_steps_do_not_stop_a_plan(loaded):
    out = Executor(loaded, discover=lambda q: [q]).run(Plan((Step("fetch_series", key="none"), Step("discover", query="q"), Step("fetch_series", key="loans"), Step("analyze", operation="anomaly", column="loans"), Step("analyze", operation="causality", column="loans", against="loans"))))
    assert len(out.failed) == 1 and [f["op"] for f in out.facts][:2] == ["discover", "anomaly"]
