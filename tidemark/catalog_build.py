"""Queries of the build, its checks, discovery by rules and functions by name, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import orders_monthly, query
from tidemark.functions import labels, pages, registry
from tidemark.operators import analytics, outliers
from tidemark.plans import access, batch, build, discovery, findings
from tidemark.session import table

_M = "CAST(date_trunc('month', o_orderdate) AS DATE)"


#: Kinds of series: name, unit of the group, semantics, declared apart from the group, and the unit that follows.
_KINDS = (
    ("Tutar", "Milyon TL", "stock", False, "milyon TL"), ("Altın - TL/kg", "TL/kg, USD/ons", "rate", False, "TL/kg"), ("Faiz", "%, milyon TL", "rate", False, "%"), ("Bakiye", "Milyon TL, %", "stock", False, "milyon TL"),
    ("Fonlama maliyeti", "Milyon TL", "rate", True, "%"), ("Endeks", None, "index", False, "endeks"), ("Adı yok", None, "stock", False, None), ("Kişi sayısı", "Bin Kişi", "stock", False, "bin kişi"),
)


@query("SELECT c_custkey, [" + ", ".join("NULL" if k[4] is None else f"'{k[4]}'" for k in _KINDS) + "][c_custkey % 8 + 1] AS unit FROM customer")
def unit_resolution(spark, sf_dir):
    """The unit of series by their groups, their names and what they are."""
    at = lambda i: F.get(F.array(*(F.lit(k[i]) for k in _KINDS)), (F.col("c_custkey") % 8).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", labels.resolve_unit(F.concat_ws(" ", at(0), F.col("c_custkey").cast("string")), at(1), at(2), at(3)).alias("unit"))


_TOLD = "translate(format('{:,.2f}', %s), ',.', '.,')"


@query(f"""
SELECT o_orderkey, told, CASE WHEN k = 1 THEN told ELSE '+' || told END AS signed FROM (SELECT o_orderkey, o_orderkey % 4 AS k, CASE o_orderkey % 4
WHEN 0 THEN CASE WHEN v * 1000000.0 >= 1e9 THEN {_TOLD % "v * 1000000.0 / 1e9"} || ' milyar TL' ELSE {_TOLD % "v * 1000000.0 / 1e6"} || ' milyon TL' END
WHEN 1 THEN '%-' || {_TOLD % "v"} WHEN 2 THEN translate(format('{{:,.0f}}', v), ',', '.') || ' adet' ELSE {_TOLD % "v"} || ' endeks' END AS told FROM (SELECT o_orderkey, o_totalprice AS v FROM orders))""")
def told_quantities(spark, sf_dir):
    """Figures as they are told, at the scale that leaves at least 1."""
    k = F.col("o_orderkey") % 4
    value, unit = F.when(k == 1, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")), F.get(F.array(*map(F.lit, ("milyon TL", "%", "adet", "endeks"))), k.cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.format_quantity(value, unit).alias("told"), labels.format_quantity(value, unit, True).alias("signed"))


@query(f"""
WITH a AS (SELECT o_orderstatus, {_M} AS period, sum(o_totalprice) AS f, sum(CASE WHEN o_orderkey % 97 <> 0 THEN o_totalprice END) AS c FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, count(*) AS n_common, round(max(abs((f - c) / c)), 9) AS largest, max(abs((f - c) / c)) <= 0.05 AS agrees FROM a WHERE c <> 0 GROUP BY 1""")
def agreement_verdict(spark, sf_dir):
    """Whether sums over nearly all orders agree with those over all, by status."""
    orders = table(spark, sf_dir, "orders").withColumn("period", F.trunc("o_orderdate", "month"))
    pairs = orders.groupBy("o_orderstatus", "period").agg(F.sum("o_totalprice").alias("fine_value"), F.sum(F.when(F.col("o_orderkey") % 97 != 0, F.col("o_totalprice"))).alias("coarse_value"))
    return build.agreement(pairs, ["o_orderstatus"], tolerance=0.05).withColumn("largest", F.round("largest", 9))


def _by_customer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_custkey % 50 = 0")
    return orders.select(F.concat(F.lit("c"), "o_custkey").alias("series_code"), F.trunc("o_orderdate", "month").alias("period"), "o_custkey")


@query(f"""
WITH m AS (SELECT DISTINCT o_custkey, {_M} AS period FROM orders WHERE o_custkey % 50 = 0), s AS (SELECT DISTINCT o_custkey FROM m),
o AS (SELECT o_custkey, unnest(generate_series(greatest(DATE '1996-01-01', CASE WHEN o_custkey % 100 = 0 THEN DATE '1997-03-01' ELSE DATE '1996-01-01' END), DATE '1998-12-01', INTERVAL 1 MONTH))::DATE AS period FROM s),
d AS (SELECT * FROM o WHERE o_custkey % 150 <> 0 OR month(period) % 3 = 0)
SELECT 'c' || o_custkey AS series_code, o_custkey % 100 = 50 AS strict, count(*) AS n_owed, count(*) - count(m.period) AS n_missing FROM d LEFT JOIN m USING (o_custkey, period) GROUP BY ALL""")
def coverage_strict(spark, sf_dir):
    """Months that series owe and miss: some start later, some are quarterly, those of tier 0 are strict."""
    months = _by_customer(spark, sf_dir)
    k = F.col("o_custkey")
    catalogue = months.select("series_code", "o_custkey").distinct().select(
        "series_code", F.when(k % 100 == 50, 0).otherwise(1).alias("tier"), F.lit(None).cast("int").alias("level"), F.when(k % 150 == 0, "quarterly").otherwise("monthly").alias("native_frequency"),
        F.when(k % 100 == 0, F.lit("1997-03-09").cast("date")).alias("published_start"), F.lit(None).cast("date").alias("published_end"),
    )
    return build.coverage_verdict(months, catalogue, "1996-01-01", "1998-12-01").select("series_code", "strict", F.col("n_owed").cast("long").alias("n_owed"), F.col("n_missing").cast("long").alias("n_missing"))


@query(f"""
WITH s AS (SELECT o_orderpriority AS dataset, {_M} AS period, sum(o_totalprice) AS t, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1, 2)
SELECT dataset, period, round(t, 2) AS stated, round(f + o, 2) AS expected FROM s WHERE f IS NOT NULL AND o IS NOT NULL AND abs(t - (f + o)) > greatest(2.0, 0.0005 * abs(t))""")
def label_identity(spark, sf_dir):
    """Totals whose label names two of their parts and whose value is another sum."""
    orders = table(spark, sf_dir, "orders").withColumn("period", F.trunc("o_orderdate", "month"))
    parts = orders.groupBy(F.col("o_orderpriority").alias("dataset"), "period", F.coalesce("o_orderstatus", F.lit("")).alias("entity_key")).agg(F.sum("o_totalprice").alias("value")).withColumn("row_position", F.when(F.col("entity_key") == "F", 2).when(F.col("entity_key") == "O", 3).otherwise(4))
    totals = parts.groupBy("dataset", "period").agg(F.sum("value").alias("value")).withColumns({"entity_key": F.lit("total"), "row_position": F.lit(1), "formula": F.lit("(2+3)")})
    rows = totals.unionByName(parts, allowMissingColumns=True).withColumns({"unit": F.lit("TL"), "metric": F.lit(None).cast("string"), "currency": F.lit(None).cast("string")})
    return build.label_identities(rows).select("dataset", "period", F.round("stated", 2).alias("stated"), F.round("expected", 2).alias("expected"))


@query(f"""
WITH h AS (SELECT DISTINCT 'd' AS dataset, o_custkey % 40 AS e, {_M} AS period FROM orders WHERE o_custkey % 3 = 0), p AS (SELECT DISTINCT period FROM h), e AS (SELECT DISTINCT e FROM h)
SELECT 'd' AS dataset, e.e AS entity_key, p.period FROM e, p WHERE (e.e <> 6 OR p.period >= DATE '1997-01-01') AND (e.e <> 9 OR p.period <= DATE '1998-01-01') AND NOT EXISTS (SELECT 1 FROM h WHERE h.e = e.e AND h.period = p.period)""")
def absent_entities(spark, sf_dir):
    """Months that a table has and one of its entities lacks within its registered life."""
    orders = table(spark, sf_dir, "orders").where("o_custkey % 3 = 0")
    rows = orders.select(F.lit("d").alias("dataset"), (F.col("o_custkey") % 40).alias("entity_key"), F.trunc("o_orderdate", "month").alias("period"))
    lives = spark.sql("SELECT 'd' AS dataset, * FROM VALUES (6L, DATE '1997-01-01', CAST(NULL AS DATE)), (9L, NULL, DATE '1998-01-01') AS v(entity_key, first_valid, last_valid)")
    return build.absent_periods(rows, lives)


@query("SELECT o_orderstatus, nullif(o_orderpriority, '1-URGENT') AS priority, CAST(min(o_orderdate) AS DATE) AS first_period, CAST(max(o_orderdate) AS DATE) AS last_period, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_periods, count(*) AS n_observations FROM orders GROUP BY 1, 2")
def metric_catalogue(spark, sf_dir):
    """Spans and counts by keys of which one can be null."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"), F.to_date("o_orderdate").alias("period"))
    return build.metric_catalogue(rows, ["o_orderstatus", "priority"])


@query(f"SELECT {_M} AS period, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND {_M} BETWEEN DATE '1996-01-01' AND DATE '1997-12-01' GROUP BY 1")
def reproduced_column(spark, sf_dir):
    """The values of a citation, by the statement made from it."""
    orders = table(spark, sf_dir, "orders").withColumn("period", F.trunc("o_orderdate", "month"))
    orders.createOrReplaceTempView("reproduced_column_facts")
    citation = {"table": "reproduced_column_facts", "filters": {"o_orderstatus": "F"}, "without": {"o_orderpriority": "5-LOW"}, "start": "1996-01-01", "end": "1997-12-01", "value_column": "o_totalprice", "summed": True}
    return spark.sql(findings.reproducing_sql(citation)).withColumn("value", F.round("value", 2))


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 40 AND l_linenumber = p_size % 7 + 1")
def facts_by_two_keys(spark, sf_dir):
    """Facts beside the live rows of an index, by two keys."""
    index = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 7 + 1).alias("l_linenumber"), "p_name", F.when(F.col("p_size") > 40, F.lit("2020-01-01").cast("date")).alias("retired_on"))
    return access.facts_with_index(table(spark, sf_dir, "lineitem"), index, ("l_partkey", "l_linenumber")).select("l_orderkey", "l_linenumber", "p_name")


@query(f"""
WITH o AS (SELECT {_M} AS period, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1),
l AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r, sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS n FROM lineitem GROUP BY 1),
u AS (SELECT 'orders' AS source, period, 'filled' AS ratio, 100 * f / nullif(o, 0) AS value FROM o UNION ALL SELECT 'orders', period, 'part', 100 * p / nullif(o, 0) FROM o UNION ALL SELECT 'items', period, 'returned', 100 * r / nullif(n, 0) FROM l)
SELECT source, period, ratio, round(value, 6) AS value FROM u WHERE value IS NOT NULL""")
def ratio_families(spark, sf_dir):
    """Ratios of two sources in one table."""
    orders = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("period"), F.col("o_orderstatus").alias("metric")).agg(F.sum("o_totalprice").alias("value"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("period"), F.col("l_returnflag").alias("metric")).agg(F.sum("l_quantity").cast("double").alias("value"))
    found = access.ratio_table({"orders": (orders, {"filled": ("F", "O"), "part": ("P", "O")}), "items": (items, {"returned": ("R", "N")})}, ["period"])
    return found.withColumn("value", F.round("value", 6))


@query("""
WITH c AS (SELECT c_nationkey, c_custkey, CAST(ceil(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) / 5.0) AS INTEGER) AS batch FROM customer)
SELECT c_nationkey, batch, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY CAST(c_custkey AS VARCHAR)) AS codes, count(*) AS n_codes FROM c GROUP BY 1, 2""")
def request_batches(spark, sf_dir):
    """Customers of each nation in requests of five."""
    return access.request_batches(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_custkey", 5)


@query("""
SELECT p_partkey, (contains(t, 'toplam')::INT + contains(t, 'total')::INT + contains(t, 'widget')::INT + contains(t, 'small')::INT) AS score FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'total ' ELSE '' END || p_name AS t FROM part) ORDER BY score DESC, p_partkey LIMIT 30""")
def landed_ranking(spark, sf_dir):
    """Series of a landed file by the words of a question in another language."""
    rows = table(spark, sf_dir, "part").withColumn("kind", F.when(F.col("p_size") % 2 == 0, "total").otherwise(""))
    return access.rank_landed(rows, "TOPLAM small widget?", ["kind", "p_name"], ["p_partkey"], 30).select("p_partkey", F.col("score").cast("int").alias("score"))


_SCORE = """
WITH p AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'macro' WHEN 1 THEN 'finturk' ELSE 'bulletin' END AS source, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') || '_' || p_partkey AS key, lower(p_name) AS name, lower(p_type) AS context, CASE WHEN p_size < 15 THEN '%' WHEN p_size < 30 THEN 'milyon TL' ELSE 'adet' END AS unit, p_size % 2 AS tier, p_size % 4 AS depth FROM part),
t(term, weight) AS (VALUES ('small widget orani', 4.0), ('small', 1.0), ('widget', 1.0), ('orani', 1.0)),
h AS (SELECT p.*, sum(CASE WHEN contains(key, term) THEN CASE WHEN starts_with(key, term) THEN 3 ELSE 2 END * weight ELSE 0 END + CASE WHEN contains(name, term) THEN 1.5 * weight WHEN contains(context, term) THEN 0.6 * weight ELSE 0 END) AS base, sum(CASE WHEN weight = 1.0 AND (contains(key, term) OR contains(name, term) OR contains(context, term)) THEN 1 ELSE 0 END) AS n FROM p, t GROUP BY ALL),
s AS (SELECT *, base + 2.0 * greatest(n - 1, 0) + CASE WHEN unit = '%' THEN 3 WHEN unit = 'milyon TL' THEN -3 ELSE 0 END + CASE tier WHEN 0 THEN 3 ELSE 1 END - 1.5 * depth - least(length(key), 90) / 45.0 AS raw FROM h WHERE base > 0)
SELECT p_partkey, CAST(round(CASE WHEN source = 'finturk' THEN 0.4 * raw ELSE raw END, 6) AS DOUBLE) AS score FROM s ORDER BY CASE WHEN source = 'finturk' THEN 0.4 * raw ELSE raw END DESC, key, source LIMIT 40"""


def _part_index(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.when(size % 3 == 0, "macro").when(size % 3 == 1, "finturk").otherwise("bulletin").alias("source"), F.concat_ws("_", labels.slug(F.col("p_name")), "p_partkey").alias("key"), F.lower("p_name").alias("name"), F.lower("p_type").alias("context"),
        F.when(size < 15, "%").when(size < 30, "milyon TL").otherwise("adet").alias("unit"), F.lit("stock").alias("semantics"), F.lit("monthly").alias("grain"), (size % 2).alias("tier"), (size % 4).alias("depth"),
    )


@query(_SCORE)
def discovery_rules(spark, sf_dir):
    """An index ranked by the terms of a question for a ratio, units, tiers, depths and sources."""
    return discovery.discover(_part_index(spark, sf_dir), "small widget oranı", 40).select("p_partkey", F.round("score", 6).alias("score"))


_MANY = _SCORE[: _SCORE.index("t(term, weight)")] + """
q AS (SELECT min(p_partkey) AS question_id, lower(p_name) || ' economy orani' AS text FROM part GROUP BY p_name),
w AS (SELECT question_id, word, CASE WHEN length(word) > 6 THEN word[1:5] END AS stem FROM (SELECT question_id, unnest(string_split(text, ' ')) AS word FROM q)),
t AS (SELECT question_id, text AS term, 4.0 AS weight FROM q UNION ALL SELECT question_id, word, 1.0 FROM w UNION ALL SELECT question_id, stem, 0.8 FROM w WHERE stem IS NOT NULL),
b AS (SELECT question_id, p.*, sum(CASE WHEN contains(key, term) THEN CASE WHEN starts_with(key, term) THEN 3 ELSE 2 END * weight ELSE 0 END + CASE WHEN contains(name, term) THEN 1.5 * weight WHEN contains(context, term) THEN 0.6 * weight ELSE 0 END) AS base FROM t JOIN p ON contains(key, term) OR contains(name, term) OR contains(context, term) GROUP BY ALL),
n AS (SELECT question_id, p_partkey, count(DISTINCT word) AS n FROM w JOIN p ON contains(key, coalesce(stem, word)) OR contains(name, coalesce(stem, word)) OR contains(context, coalesce(stem, word)) GROUP BY ALL),
s AS (SELECT *, base + 2.0 * greatest(n - 1, 0) + CASE WHEN unit = '%' THEN 3 WHEN unit = 'milyon TL' THEN -3 ELSE 0 END + CASE tier WHEN 0 THEN 3 ELSE 1 END - 1.5 * depth - least(length(key), 90) / 45.0 AS raw FROM b JOIN n USING (question_id, p_partkey)),
r AS (SELECT *, round(CASE WHEN source = 'finturk' THEN 0.4 * raw ELSE raw END, 9) AS score FROM s)
SELECT question_id, CAST(rank AS INT) AS rank, p_partkey, CAST(round(score, 6) AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key, source) AS rank FROM r) WHERE rank <= 10"""


@query(_MANY)
def discover_many(spark, sf_dir):
    """The index searched for a table of questions at once: postings, one equi-join, and a top list for each."""
    questions = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("question_id")).select("question_id", F.concat(F.lower("p_name"), F.lit(" economy oranı")).alias("text"))
    return batch.discover_all(_part_index(spark, sf_dir), questions, 10).select("question_id", "rank", "p_partkey", F.round("score", 6).alias("score"))


@query("SELECT page_id, substr(sha256(regexp_replace(url, '#.*$', '')), 1, 12) AS source_id FROM pages")
def source_ids(spark, sf_dir):
    """Ids of addresses, written with another case of the scheme, a fragment and white space."""
    return table(spark, sf_dir, "pages").select("page_id", pages.source_id(F.concat(F.lit(" "), F.regexp_replace("url", "^http", "HTTP"), F.lit("#part "))).alias("source_id"))


@query("SELECT n_nationkey, lower(n_name) AS folded, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, round(100.0 * n_regionkey / nullif(n_nationkey, 0), 9) AS pct, substr(sha256('http://X.y/' || n_name), 1, 12) AS source_id FROM nation")
def functions_by_name(spark, sf_dir):
    """The registered functions, called from a statement."""
    registry.register(spark)
    table(spark, sf_dir, "nation").createOrReplaceTempView("functions_by_name_nation")
    return spark.sql("SELECT n_nationkey, fold_text(n_name) AS folded, slug_text(n_name) AS slug, round(share_pct(n_regionkey, n_nationkey), 9) AS pct, source_id(concat('HTTP://X.y/', n_name, '#f')) AS source_id FROM functions_by_name_nation")


@query(f"""
WITH m AS (SELECT o_orderpriority, {_M} AS period, sum(CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice ELSE 1.0 END) AS value FROM orders WHERE o_custkey % 9 = 0 GROUP BY 1, 2), g AS (SELECT *, lag(value) OVER w AS b, date_diff('month', lag(period) OVER w, period) AS gap FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY period)), k AS (SELECT *, median(abs(value)) OVER (PARTITION BY o_orderpriority) AS typical FROM g)
SELECT o_orderpriority, period FROM k WHERE b IS NOT NULL AND abs(b) >= 0.05 * typical""")
def flow_zero_guard(spark, sf_dir):
    """Months of a flow whose change can be scored: not those after a month near zero."""
    orders = table(spark, sf_dir, "orders").where("o_custkey % 9 = 0").withColumn("period", F.trunc("o_orderdate", "month"))
    monthly = orders.groupBy("o_orderpriority", "period").agg(F.sum(F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice")).otherwise(1.0)).alias("value"))
    return outliers.scored(monthly, ["o_orderpriority"], "change", semantics="flow").select("o_orderpriority", "period")


@query(f"""
WITH m AS (SELECT o_orderstatus, {_M} AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2) SELECT * FROM (SELECT o_orderstatus, period, round(value - lag(value) OVER (PARTITION BY o_orderstatus ORDER BY period), 6) AS scored FROM m) WHERE scored IS NOT NULL""")
def scored_differences(spark, sf_dir):
    """Differences that outliers of rates are judged by; the months here have no gaps."""
    return outliers.scored(orders_monthly(spark, sf_dir, "o_orderstatus"), ["o_orderstatus"], "auto", semantics="rate").select("o_orderstatus", "period", F.round("scored", 6).alias("scored"))


@query(f"""
WITH l AS (SELECT {_M} AS period, sum(o_totalprice) AS a, sum(CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END) AS b FROM orders GROUP BY 1), d AS (SELECT period, 100 * (b - a) / a AS divergence FROM l WHERE b IS NOT NULL),
m AS (SELECT avg(divergence) AS mean, stddev_samp(divergence) AS dev FROM d)
SELECT period, round(divergence, 6) AS divergence_pct, coalesce(divergence < mean - 3 * dev OR divergence > mean + 3 * dev, true) OR divergence < -9 OR divergence > -5 AS out_of_band FROM d, m""")
def hard_bounds(spark, sf_dir):
    """Divergence of two sources of one figure, out of its band or of bounds that hold besides."""
    orders = table(spark, sf_dir, "orders").withColumn("period", F.trunc("o_orderdate", "month"))
    left = orders.groupBy(F.lit("all").alias("g"), "period").agg(F.sum("o_totalprice").alias("left_value"))
    right = orders.where("o_orderkey % 13 <> 0").groupBy(F.lit("all").alias("g"), "period").agg(F.sum("o_totalprice").alias("right_value"))
    found = analytics.reconcile(left, right, ["g"], (-9.0, -5.0))
    return found.select("period", F.round("divergence_pct", 6).alias("divergence_pct"), "out_of_band")


@query("SELECT * FROM (VALUES ('listed_nation', 'n_name', 'string'), ('listed_nation', 'n_nationkey', 'int'), ('listed_nation', 'n_regionkey', 'int'), ('listed_region', 'r_name', 'string'), ('listed_region', 'r_regionkey', 'int')) t(table_name, column_name, type)")
def listed_tables(spark, sf_dir):
    """The tables of a session and their columns, as its own statements list them."""
    for name in ("nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"listed_{name}")
    found = [(r.tableName, c.col_name, c.data_type.replace("bigint", "int")) for r in spark.sql("SHOW TABLES LIKE 'listed_*'").collect() for c in spark.sql(f"DESCRIBE TABLE {r.tableName}").collect()]
    return spark.createDataFrame(found, "table_name string, column_name string, type string")
