"""Queries of the series access layer, of its checks and of label functions, each beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import orders_monthly, query
from tidemark.functions import labels
from tidemark.operators import analytics, quality, search, series
from tidemark.plans import access, findings, loading
from tidemark.plans.plan import Step
from tidemark.session import table
from tidemark.sources import published

_M = "CAST(date_trunc('month', o_orderdate) AS DATE)"


def _curated(spark, sf_dir):
    """Monthly order values and counts by status and priority, as a curated source."""
    orders = table(spark, sf_dir, "orders").withColumn("period", F.trunc("o_orderdate", "month"))
    facts = orders.groupBy("o_orderstatus", "o_orderpriority", "period").agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.count("*").cast("double").alias("value_flow"))
    return access.Curated(facts, ("o_orderstatus", "o_orderpriority"), {"stock": "value", "cumulative_ytd": "value_flow"})


@query(f"SELECT {_M} AS period, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1")
def load_slice(spark, sf_dir):
    """One series out of a curated table."""
    return access.load_slice(_curated(spark, sf_dir), "stock", {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN value WHEN event_type = 'view' THEN -value END AS chosen FROM events")
def value_column_choice(spark, sf_dir):
    """The value column that each row's kind calls for."""
    rows = table(spark, sf_dir, "events").withColumn("negative", -F.col("value"))
    return rows.select("event_id", access.choose_value(F.col("event_type"), {"click": "value", "view": "negative"}).alias("chosen"))


@query("SELECT p_partkey FROM part WHERE NOT (p_size > 25 AND p_size % 2 = 0)")
def retired_filter(spark, sf_dir):
    """Rows that are not retired."""
    return access.active(table(spark, sf_dir, "part").withColumn("retired_on", F.when((F.col("p_size") > 25) & (F.col("p_size") % 2 == 0), F.lit("2020-01-01").cast("date")))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE NOT coalesce(CASE WHEN p_size < 40 THEN p_brand = 'Brand#2' END, false)")
def informational_filter(spark, sf_dir):
    """Rows that count towards totals; a missing flag counts as false."""
    return access.without_informational(table(spark, sf_dir, "part").withColumn("is_informational", F.when(F.col("p_size") < 40, F.col("p_brand") == "Brand#2"))).select("p_partkey")


@query("SELECT c_mktsegment, round(sum(c_acctbal), 2) AS value, count(DISTINCT n_name) AS n_regions FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name NOT IN (SELECT min(n_name) FROM nation) GROUP BY 1")
def national_sum(spark, sf_dir):
    """Balances over all nations but one that counts as abroad, named without regard to case."""
    abroad = table(spark, sf_dir, "nation").agg(F.min("n_name").alias("n")).first().n
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "n_name", F.col("c_acctbal").alias("value"))
    return access.national_sum(rows, ["c_mktsegment"], "n_name", [abroad.title()]).withColumn("value", F.round("value", 2))


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = (SELECT lower(max(n_name)) FROM nation)")
def province_slice(spark, sf_dir):
    """A region, however its name is cased."""
    wanted = table(spark, sf_dir, "nation").agg(F.max("n_name").alias("n")).first().n
    return access.region_slice(table(spark, sf_dir, "nation"), f"  {wanted.swapcase()} ", "n_name").select("n_nationkey", "n_name")


@query(f"""
WITH s AS (SELECT {_M} AS period, substr(o_orderpriority, 2) AS suffix, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS part, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS whole FROM orders GROUP BY 1, 2)
SELECT period, suffix, round(100 * part / whole, 4) AS share_pct FROM s WHERE part IS NOT NULL AND whole IS NOT NULL""")
def derived_share(spark, sf_dir):
    """One series over another for each suffix that both have."""
    orders = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("period"), F.concat("o_orderstatus", F.substring("o_orderpriority", 2, 99)).alias("series"), F.col("o_totalprice").alias("value"))
    return access.derived_share(orders, ["period"], "F", "O").withColumn("share_pct", F.round("share_pct", 4))


@query("SELECT t.k || '_' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g'), '_') AS series_key, replace(t.p, '%s', n_name) AS series_name FROM nation, (VALUES ('share', 'Share of %s'), ('growth', '%s, yearly growth')) t(k, p)")
def derived_catalogue(spark, sf_dir):
    """Derived series of all regions by templates."""
    templates = spark.createDataFrame([("share", "Share of %s"), ("growth", "%s, yearly growth")], "template_key string, pattern string")
    return access.expand_templates(table(spark, sf_dir, "nation"), templates, "n_name")


@query(f"""
WITH m AS (SELECT o_orderstatus, {_M} AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2), z AS (SELECT *, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z_score FROM m WINDOW w AS (PARTITION BY o_orderstatus))
SELECT o_orderstatus, period, round(z_score, 6) AS z_score FROM z WHERE z_score IS NOT NULL ORDER BY abs(z.z_score) DESC, o_orderstatus, period LIMIT 6""")
def top_anomalies(spark, sf_dir):
    """The six months furthest from their series' mean."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderstatus")
    scores = orders_monthly(spark, sf_dir, "o_orderstatus").withColumn("z_score", F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_samp("value").over(w)))
    return access.top_anomalies(scores, 6, order=["o_orderstatus", "period"]).select("o_orderstatus", "period", F.round("z_score", 6).alias("z_score"))


@query("SELECT DISTINCT c_mktsegment, c_mktsegment || ' Ankara ' || n_name || ' value' AS search_text FROM customer JOIN nation ON c_nationkey = n_nationkey")
def search_texts(spark, sf_dir):
    """Search texts with each word once, in its first spelling."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = [F.col("c_mktsegment"), F.lit("Ankara  ANKARA"), F.lower("c_mktsegment"), F.col("n_name"), F.lit("ankârâ value")]
    return rows.select("c_mktsegment", access.search_text(parts).alias("search_text")).distinct()


@query("WITH s AS (SELECT o_orderstatus, date_trunc('quarter', min(o_orderdate)) AS a, date_trunc('quarter', max(o_orderdate)) AS b FROM orders GROUP BY 1) SELECT o_orderstatus, CAST(unnest(generate_series(a, b, INTERVAL 3 MONTH)) AS DATE) AS quarter FROM s")
def quarter_sequence(spark, sf_dir):
    """All quarters between the first and last order of each status."""
    spans = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return spans.select("o_orderstatus", F.explode(access.quarter_starts(F.col("a"), F.col("b"))).alias("quarter"))


@query("""
WITH s AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1), y AS (SELECT *, unnest(range(year(a), year(b) + 1)) AS y FROM s)
SELECT o_custkey, greatest(a, make_date(y, 1, 1)) AS slice_start, least(b, make_date(y, 12, 31)) AS slice_end FROM y""")
def request_slices(spark, sf_dir):
    """Each customer's span in requests of a calendar year."""
    spans = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return access.request_slices(spans, ["o_custkey"], "a", "b")


@query("""
WITH s AS (SELECT o_orderstatus, sum(o_totalprice * CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '5-LOW' THEN 0.2 END) AS weighted_sum, 1000.0 * count(*) AS total FROM orders GROUP BY 1)
SELECT o_orderstatus, round(weighted_sum, 2) AS weighted_sum, round(total, 2) AS total FROM s WHERE abs(total - coalesce(weighted_sum, 0)) > greatest(2.0, 0.0005 * abs(total))""")
def risk_weight_identity(spark, sf_dir):
    """Totals that are not the sum of rows weighted by the percentage in their labels."""
    from pyspark.sql import Window

    label = F.when(F.col("o_orderpriority") == "1-URGENT", "weighted at %100").when(F.col("o_orderpriority") == "5-LOW", "20% weight").otherwise("none")
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", label.alias("label"), F.col("o_totalprice").alias("value"), (F.count("*").over(Window.partitionBy("o_orderstatus")) * 1000.0).alias("t"))
    found = quality.risk_weight_differences(rows, ["o_orderstatus"], "label", "value", "t")
    return found.select("o_orderstatus", F.round("weighted_sum", 2).alias("weighted_sum"), F.round("total", 2).alias("total"))


@query("SELECT o_orderpriority, count(o_totalprice) AS n_values, count(*) FILTER (WHERE o_custkey % 7 = 0) AS n_missing FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_custkey % 7 = 0) > 0")
def decumulate_complete(spark, sf_dir):
    """Published values without a flow, by series."""
    rows = table(spark, sf_dir, "orders").withColumn("flow", F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice")))
    return quality.missing_flows(rows, ["o_orderpriority"], "o_totalprice", "flow")


@query("WITH f AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS distinct_codes, min(l_linenumber) AS first_code, max(l_linenumber) AS last_code FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1) SELECT * FROM f WHERE n <> distinct_codes OR first_code <> 1 OR last_code <> n")
def code_sequences(spark, sf_dir):
    """Orders whose lines, without those of some parts, are not numbered 1 to n."""
    return quality.broken_sequences(table(spark, sf_dir, "lineitem").where("l_partkey % 5 <> 0"), ["l_orderkey"], "l_linenumber")


@query("""
WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host FROM pages), f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM h WHERE host = 'example.org' OR host LIKE '%.example.org')
SELECT page_id, url FROM f WHERE n = 1 ORDER BY page_id LIMIT 25""")
def hit_filter(spark, sf_dir):
    """The first 25 addresses of one domain, each once."""
    return search.filter_hits(table(spark, sf_dir, "pages").select("page_id", "url"), "url", ["page_id"], ["example.org"], 25)


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_roots, count(*) AS n_citations FROM lineitem GROUP BY 1")
def distinct_roots(spark, sf_dir):
    """How many suppliers the lines of an order go back to."""
    return search.distinct_roots(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query("""SELECT o_orderkey, number FROM (SELECT o_orderkey, round(o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 5000 ELSE 0 END, 2) AS number, o_totalprice FROM orders)
WHERE abs(number - o_totalprice) > greatest(0.02 * o_totalprice, 0.05) AND NOT (number = floor(number) AND (abs(number) < 100 OR number BETWEEN 1900 AND 2100 OR number BETWEEN 190001 AND 210012 AND number % 100 BETWEEN 1 AND 12))""")
def unsupported_numbers(spark, sf_dir):
    """Numbers that sentences state, in several ways of writing them, and the facts do not bear out."""
    orders = table(spark, sf_dir, "orders")
    said = F.round(F.col("o_totalprice") + F.when(F.col("o_orderkey") % 3 == 0, 5000).otherwise(0), 2)
    written = F.when(F.col("o_orderkey") % 4 == 0, labels.format_number(said)).when(F.col("o_orderkey") % 4 == 1, F.format_number(said, 2)).otherwise(F.format_string("%.2f", said))
    claims = orders.select("o_orderkey", F.concat(F.lit("12 ayda, 2024-05 ve 2021 sonunda toplam "), written, F.lit(" TL, -%3 oldu")).alias("claim"))
    return access.unsupported_numbers(claims, orders.select("o_orderkey", "o_totalprice"), "o_orderkey", "claim", "o_totalprice").withColumn("number", F.round("number", 2))


@query("""WITH f AS (SELECT c_nationkey, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE n_name END AS region, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_mktsegment AS entity, round(sum(c_acctbal), 2) AS value FROM f WHERE region IS NULL OR region NOT IN ('NATION_3', 'NATION_7', 'NATION_11') GROUP BY 1""")
def cited_national_sums(spark, sf_dir):
    """What the statements give that national figures of a source cite: rows without a region count, those abroad do not."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    region = F.when(F.col("c_custkey") % 7 != 0, F.col("n_name"))
    facts = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.to_date(F.lit("2024-01-01")).alias("period"), F.col("c_mktsegment").alias("entity_key"), F.col("c_mktsegment").alias("entity_name"), region.alias("region"), F.col("c_acctbal").alias("value"), F.lit("TL").alias("unit"), F.lit("stock").alias("temporal_semantics"))
    facts.createOrReplaceTempView("cited_national_facts")
    source = loading.Source(facts, "cited_national_facts", metric=None, currency=None, dataset=None, region="region", abroad=("Nation 3", "nation-7", "NATİON_11"))
    parts = []
    for segment in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"):
        _, line = loading.load(source, Step("fetch_series", key=segment))
        parts.append(spark.sql(findings.reproducing_sql(line.citation)).select(F.lit(segment).alias("entity"), F.round("value", 2).alias("value")))
    return reduce(DataFrame.unionByName, parts)


@query("SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'private' ELSE 'public' END AS canonical, c_nationkey, round(sum(c_acctbal), 2) AS c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') GROUP BY 1, 2")
def crosswalk_side_sum(spark, sf_dir):
    """A side's values over the codes of each canonical sector."""
    crosswalk = spark.createDataFrame([("BUILDING", "private"), ("MACHINERY", "public"), ("FURNITURE", "public")], "c_mktsegment string, canonical string")
    return analytics.side_sum(table(spark, sf_dir, "customer"), crosswalk, ["c_nationkey"], "c_mktsegment", "c_acctbal").withColumn("c_acctbal", F.round("c_acctbal", 2))


def _observations(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.lit("g").alias("datagroup"), F.concat_ws("-", "l_orderkey", "l_partkey").alias("series_code"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("value"), F.lit("day").alias("grain"))


@query("SELECT l_orderkey || '-' || l_partkey AS series_code, CAST(l_shipdate AS DATE) AS date, min(l_quantity) AS value FROM lineitem GROUP BY 1, 2")
def overlap_once(spark, sf_dir):
    """Observations of overlapping files, each once."""
    return published.reconcile_overlaps(_observations(spark, sf_dir))[0].select("series_code", "date", "value")


@query("SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS period, o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) < DATE '1993-01-01') OR (o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) > DATE '1997-06-30')")
def outside_lifecycle(spark, sf_dir):
    """Rows before or after an entity's registered life; an open bound excludes nothing."""
    lives = spark.sql("SELECT * FROM VALUES ('F', DATE '1993-01-01', CAST(NULL AS DATE)), ('O', NULL, DATE '1997-06-30'), ('P', NULL, NULL) AS v(o_orderstatus, first_valid, last_valid)")
    return quality.outside_lifecycle(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", F.to_date("o_orderdate").alias("period")), lives, "o_orderstatus").select("o_orderstatus", "period", "o_orderkey")


_WORDS = ("İstanbul Şubesi", "IĞDIR ili", "Çalışan Sayısı (kişi)", "kâr – zarar", "ÖZ KAYNAKLAR")
_LISTED = "[" + ", ".join(f"'{w}'" for w in _WORDS) + "]"


def _picked(words: tuple, number) -> Column:
    """The word at the place that a column's remainder names."""
    return F.get(F.array(*(F.lit(w) for w in words)), F.pmod(number, F.lit(len(words))).cast("int"))


@query(f"SELECT c_custkey, regexp_replace(lower(strip_accents(translate(x, 'ıİI', 'iii'))), '[^a-z0-9 ()–]', '', 'g') AS folded, trim(regexp_replace(lower(strip_accents(translate(x, 'ıİI', 'iii'))), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM (SELECT c_custkey, {_LISTED}[c_custkey % 5 + 1] || ' ' || c_custkey AS x FROM customer)")
def turkish_keys(spark, sf_dir):
    """Accented and dotted letters of names, folded and as keys."""
    x = F.concat_ws(" ", _picked(_WORDS, F.col("c_custkey")), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", labels.fold(x).alias("folded"), labels.slug(x).alias("slug"))


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 50 <> 0 THEN round(o_totalprice, 2) END AS number FROM orders")
def parsed_numbers(spark, sf_dir):
    """Numbers under the convention that each priority's cells show; some cells are no numbers."""
    said = F.round("o_totalprice", 2)
    written = F.when(F.col("o_orderpriority") < "3", labels.format_number(said)).otherwise(F.format_number(said, 2))
    cells = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 50 != 0, written).otherwise("yok").alias("text"))
    rule = cells.groupBy("o_orderpriority").agg(labels.comma_decimals(F.col("text")).alias("comma"))
    return cells.join(rule, "o_orderpriority").select("o_orderkey", "o_orderpriority", labels.parse_number(F.col("text"), F.col("comma")).alias("number"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders")
def parsed_dates(spark, sf_dir):
    """Dates written in two languages and several orders; some are no dates."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    month, year = F.get(F.array(*(F.lit(names[0].capitalize()) for names in labels.MONTHS)), F.month(d) - 1), F.year(d).cast("string")
    written = (
        F.when(k % 5 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(d, "d.M.yyyy")).when(k % 5 == 2, F.concat_ws(" ", F.dayofmonth(d).cast("string"), month, year))
        .when(k % 5 == 3, F.when(k % 2 == 0, F.concat_ws("/", year, F.month(d).cast("string"))).otherwise(F.concat(month, F.lit(" / "), F.date_format(d, "MMMM"), F.lit(" "), year))).otherwise(F.concat(F.lit("31.02."), year))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.parse_date(written).alias("date"))


@query("""SELECT p_partkey, CAST(t.sign AS INT) AS sign, CAST(t.position AS INT) AS position FROM (SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN [{'sign': 1, 'position': p_size}, {'sign': 1, 'position': p_size + 1}, {'sign': -1, 'position': p_size + 2}]
WHEN 1 THEN [{'sign': 1, 'position': p_size}, {'sign': 1, 'position': p_size + 1}, {'sign': 1, 'position': p_size + 2}, {'sign': 1, 'position': p_size + 3}] WHEN 2 THEN [{'sign': 1, 'position': p_size}, {'sign': -1, 'position': p_size + 1}, {'sign': -1, 'position': p_size + 2}] END) AS t FROM part)""")
def formula_positions(spark, sf_dir):
    """Signed positions that formulas of labels name; formulas that divide have none."""
    a, b, c, d = ((F.col("p_size") + i).cast("string") for i in range(4))
    k = F.col("p_partkey") % 4
    formula = F.when(k == 0, F.concat(F.lit("("), a, F.lit("+"), b, F.lit("-"), c, F.lit(")"))).when(k == 1, F.concat(F.lit("("), a, F.lit("+..+"), d, F.lit(")"))).when(k == 2, F.concat(a, F.lit("-("), b, F.lit("+"), c, F.lit(")"))).otherwise(F.concat(F.lit("("), a, F.lit("/"), b, F.lit(")")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(labels.formula_terms(formula)).alias("t")).select("p_partkey", F.col("t.sign").alias("sign"), F.col("t.position").alias("position"))


@query(f"""
WITH m AS (SELECT o_orderpriority, {_M} AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2) SELECT o_orderpriority, period, round(value - lag(value, 1) OVER (PARTITION BY o_orderpriority ORDER BY period), 2) AS diff FROM m""")
def level_differences(spark, sf_dir):
    """Differences of a level from row to row."""
    return series.net_change(orders_monthly(spark, sf_dir, "o_orderpriority"), ["o_orderpriority"], 1, "value", "diff").select("o_orderpriority", "period", F.round("diff", 2).alias("diff"))
