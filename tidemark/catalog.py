"""Registry of the library's own queries, each beside the DuckDB SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import analytics, outliers, quality, search, series
from tidemark.session import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its oracle SQL if SQL can express it."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


@lru_cache(maxsize=1)
def _load_rest() -> None:
    from tidemark import catalog_access, catalog_build, catalog_custom  # noqa: F401  these register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    _load_rest()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """The DuckDB SQL each query is checked against."""
    _load_rest()
    return dict(_SQL)


# Series of the test tables ------------------------------------------------------------------------


def orders_monthly(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Order value by month, of all orders or by a column."""
    orders = table(spark, sf_dir, "orders").withColumn("period", F.trunc("o_orderdate", "month"))
    return orders.groupBy(*([by] if by else []), "period").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def price_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price of a unit shipped by month."""
    items = table(spark, sf_dir, "lineitem").withColumn("period", F.trunc("l_shipdate", "month"))
    return items.groupBy("period").agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 4).alias("price"))


ORDERS = "orders_m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1)"
BY_STATUS = "status_m AS (SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"
PRICE = "price_m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, round(sum(l_extendedprice) / sum(l_quantity), 4) AS price FROM lineitem GROUP BY 1)"
EVENT_DAYS = "event_d AS (SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value), 4) AS value, count(*) AS n FROM events GROUP BY 1, 2)"


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event value and number by type and day."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("value"), F.count("*").alias("n"))


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# Transforms ---------------------------------------------------------------------------------------


@query(f"""
WITH {ORDERS}, {PRICE}, j AS (SELECT * FROM orders_m JOIN price_m USING (period)),
b AS (SELECT arg_min(value, period) AS bv, arg_min(price, period) AS bp FROM j),
k AS (SELECT period, value, price, 100 * value / NULLIF(bv, 0) AS value_index, value * (bp / NULLIF(price, 0)) AS real_value FROM j, b)
SELECT period, value, price, round(value_index, 4) AS value_index, round(real_value, 4) AS real_value,
round(100 * (value / NULLIF(lag(value) OVER w, 0) - 1), 4) AS mom_pct, round(100 * (value / NULLIF(lag(value, 12) OVER w, 0) - 1), 4) AS yoy_pct
FROM k WINDOW w AS (ORDER BY period)""")
def index_deflate_monthly(spark, sf_dir):
    """Monthly order value indexed to its first month, deflated by shipped prices, with changes."""
    both = orders_monthly(spark, sf_dir).join(price_monthly(spark, sf_dir), "period")
    out = series.deflate(series.index_to_base(both, [], name="value_index"), [], "price", name="real_value")
    out = series.change(series.change(out, [], 1, name="mom_pct"), [], 12, name="yoy_pct")
    return _rounded(out.select("period", "value", "price", "value_index", "real_value", "mom_pct", "yoy_pct"))


@query(f"""
WITH {BY_STATUS} SELECT o_orderstatus, period, value, round(100 * (value / NULLIF(lag(value) OVER w, 0) - 1), 4) AS mom_pct,
round(100 * (value / NULLIF(lag(value, 12) OVER w, 0) - 1), 4) AS yoy_pct FROM status_m WINDOW w AS (PARTITION BY o_orderstatus ORDER BY period)""")
def mom_yoy_change(spark, sf_dir):
    """Changes by one and twelve rows of every status' series."""
    df = orders_monthly(spark, sf_dir, "o_orderstatus")
    return _rounded(series.change(series.change(df, ["o_orderstatus"], 1, name="mom_pct"), ["o_orderstatus"], 12, name="yoy_pct"))


@query(f"WITH {BY_STATUS} SELECT o_orderstatus, period, value, round(value - lag(value, 3) OVER (PARTITION BY o_orderstatus ORDER BY period), 4) AS net_change FROM status_m")
def net_change(spark, sf_dir):
    """Difference over three rows."""
    return _rounded(series.net_change(orders_monthly(spark, sf_dir, "o_orderstatus"), ["o_orderstatus"], 3))


@query(f"""
WITH {BY_STATUS}, g AS (SELECT *, 100 * (value / NULLIF(lag(value) OVER w, 0) - 1) AS m, 100 * (value / NULLIF(lag(value, 12) OVER w, 0) - 1) AS y FROM status_m WINDOW w AS (PARTITION BY o_orderstatus ORDER BY period))
SELECT o_orderstatus, period, value, round(m, 4) AS mom_pct, round(y, 4) AS yoy_pct FROM g WHERE m IS NOT NULL OR y IS NOT NULL""")
def growth_table(spark, sf_dir):
    """The growth table: rows with a change only."""
    return _rounded(series.growth_table(orders_monthly(spark, sf_dir, "o_orderstatus"), ["o_orderstatus"]))


@query("""
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 2) AS a, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 2) AS n, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 2) AS r,
round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) + sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 2) AS a_plus_r,
round(100 * sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) / NULLIF(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 0), 4) AS r_over_n
FROM lineitem GROUP BY 1""")
def sum_columns(spark, sf_dir):
    """Sums and shares of the columns of a wide table; a missing part gives a missing sum."""
    items = table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("period"), "l_returnflag", "l_quantity")
    wide = items.groupBy("period").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.sum("l_quantity"), 2)).select("period", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))
    return wide.select("*", F.round(series.sum_columns(["a", "r"]), 2).alias("a_plus_r"), F.round(series.share("r", "n"), 4).alias("r_over_n"))


@query("""
WITH s AS (SELECT n_regionkey, round(sum(s_acctbal), 2) AS supply FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
c AS (SELECT n_regionkey, round(sum(c_acctbal), 2) AS custom FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT n_regionkey, supply, custom, round(100 * supply / NULLIF(custom, 0), 4) AS share_pct, round(supply / 32.5, 4) AS supply_usd FROM s JOIN c USING (n_regionkey)""")
def ratio_share(spark, sf_dir):
    """Two sides by region, their ratio, and one of them at a rate."""
    nation = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.round(F.sum("s_acctbal"), 2).alias("supply"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.round(F.sum("c_acctbal"), 2).alias("custom"))
    return s.join(c, "n_regionkey").select("*", F.round(series.share("supply", "custom"), 4).alias("share_pct"), F.round(series.safe_ratio(F.col("supply"), F.lit(32.5)), 4).alias("supply_usd"))


@query(f"""
WITH {ORDERS}, {PRICE}, d AS (SELECT period, value, price, value - lag(value) OVER w AS value_change, price - lag(price) OVER w AS price_change FROM orders_m JOIN price_m USING (period) WINDOW w AS (ORDER BY period))
SELECT period, value, price, round(value_change, 4) AS value_change, round(price_change, 4) AS price_change FROM d WHERE price_change < 0 AND value_change <= 0""")
def find_periods(spark, sf_dir):
    """Months in which prices fell and order value did not rise."""
    both = orders_monthly(spark, sf_dir).join(price_monthly(spark, sf_dir), "period")
    out = series.moves(both, [], "price", "down", "value", "down")
    return _rounded(out.select("period", "value", "price", "value_change", "price_change"))


@query(f"""
WITH {BY_STATUS}, {PRICE}, j AS (SELECT * FROM status_m JOIN price_m USING (period)),
e AS (SELECT o_orderstatus, arg_min(value, period) AS a, arg_max(value, period) AS b, arg_min(price, period) AS c, arg_max(price, period) AS d, min(period) AS period_start, max(period) AS period_end, count(*) AS n FROM j GROUP BY 1),
g AS (SELECT *, b / a - 1 AS gn, d / c - 1 AS gp FROM e WHERE n >= 2)
SELECT o_orderstatus, period_start, period_end, round(100 * gn, 4) AS nominal_pct, round(100 * gp, 4) AS price_pct, round(100 * ((1 + gn) / (1 + gp) - 1), 4) AS real_pct,
round(CASE WHEN gn > 0 AND gp > -1 THEN ln(1 + gp) / ln(1 + gn) END, 4) AS price_share,
CASE WHEN (1 + gn) / (1 + gp) - 1 < -0.02 THEN 'price' WHEN (1 + gn) / (1 + gp) - 1 > 0.02 THEN 'real' ELSE 'even' END AS reading FROM g""")
def decompose_growth(spark, sf_dir):
    """Growth of each status' order value split into price and real growth."""
    both = orders_monthly(spark, sf_dir, "o_orderstatus").join(price_monthly(spark, sf_dir), "period")
    out = series.decompose_growth(both, ["o_orderstatus"], "value", "price")
    return _rounded(out.select("o_orderstatus", "period_start", "period_end", "nominal_pct", "price_pct", "real_pct", "price_share", "reading"))


@query(f"""
WITH {ORDERS}, {PRICE}, d AS (SELECT year(period) AS year, value / lag(value) OVER w - 1 AS n, price / lag(price) OVER w - 1 AS p FROM orders_m JOIN price_m USING (period) WHERE month(period) = 12 WINDOW w AS (ORDER BY period))
SELECT CAST(year AS INTEGER) AS year, round(100 * n, 4) AS nominal_pct, round(100 * p, 4) AS price_pct, round(100 * ((1 + n) / (1 + p) - 1), 4) AS real_pct FROM d WHERE n IS NOT NULL""")
def year_end_growth(spark, sf_dir):
    """Growth from December to December, split into price and real growth."""
    both = orders_monthly(spark, sf_dir).join(price_monthly(spark, sf_dir), "period")
    return _rounded(series.year_end_growth(both, [], "value", "price"))


@query(f"""
WITH {ORDERS}, {PRICE}, j AS (SELECT * FROM orders_m FULL JOIN price_m USING (period)),
s AS (SELECT 'value' AS "column", 'TL' AS unit, arg_min(value, period) AS first, arg_max(value, period) AS last, min(period) AS "from", max(period) AS "to", min(value) AS min, max(value) AS max, count(*) AS n FROM j WHERE value IS NOT NULL
UNION ALL SELECT 'price', '%', arg_min(price, period), arg_max(price, period), min(period), max(period), min(price), max(price), count(*) FROM j WHERE price IS NOT NULL)
SELECT *, round(CASE WHEN unit = '%' THEN last - first ELSE 100 * (last / first - 1) END, 4) AS change FROM s""")
def column_summary(spark, sf_dir):
    """First, last, extremes, change and number of every column of an outer-aligned table."""
    both = series.outer_align([orders_monthly(spark, sf_dir), price_monthly(spark, sf_dir)])
    return _rounded(series.summarise(both, {"value": "TL", "price": "%"}))


# Alignment, joins and set operations --------------------------------------------------------------


@query(f"""
WITH {EVENT_DAYS} SELECT event_type, CAST(date_trunc('month', day) AS DATE) AS period, round(avg(value), 4) AS value_avg, arg_max(value, day) AS value_last,
CASE WHEN event_type = 'purchase' THEN round(sum(value), 4) END AS value_sum, count(*) AS n_native,
round(CASE WHEN event_type = 'purchase' THEN sum(value) WHEN event_type = 'click' THEN arg_max(value, day) ELSE avg(value) END, 4) AS value FROM event_d GROUP BY 1, 2""")
def align_monthly_rules(spark, sf_dir):
    """Daily event values as months, by the rule of each type."""
    rule = F.when(F.col("event_type") == "purchase", "sum").when(F.col("event_type") == "click", "last").otherwise("avg")
    return _rounded(series.aggregate_monthly(events_daily(spark, sf_dir), ["event_type"], "day", "value", rule))


@query(f"""
WITH {ORDERS}, c AS (SELECT period, round(sum(value) OVER (PARTITION BY year(period) ORDER BY period), 2) AS ytd FROM orders_m)
SELECT period, ytd, round(CASE WHEN row_number() OVER w = 1 THEN ytd ELSE ytd - lag(ytd) OVER w END, 2) AS value_flow FROM c WINDOW w AS (PARTITION BY year(period) ORDER BY period)""")
def decumulate_ytd(spark, sf_dir):
    """A year-to-date series turned back into flows."""
    year = Window.partitionBy(F.year("period")).orderBy("period")
    ytd = orders_monthly(spark, sf_dir).select("period", F.round(F.sum("value").over(year), 2).alias("ytd"))
    return _rounded(series.decumulate(ytd, [], "ytd"), 2)


@query(f"WITH {ORDERS}, {PRICE} SELECT period, value, price FROM orders_m FULL JOIN price_m USING (period)")
def outer_align_two_series(spark, sf_dir):
    """Two series side by side; months of either are kept."""
    return series.outer_align([orders_monthly(spark, sf_dir), price_monthly(spark, sf_dir)])


@query("""
SELECT r_name, count(DISTINCT c_custkey) AS n_customers, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def crosswalk_rollup(spark, sf_dir):
    """Orders rolled up from customer by nation to region. Orders are first summed by customer, so only
    one row a customer meets the dimensions."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    dims = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return per.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(dims, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("n_customers"), F.round(F.sum("t"), 2).alias("total"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_membership(spark, sf_dir):
    """Customers with an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def anti_unknown_codes(spark, sf_dir):
    """Customer keys of orders that a part of the customers does not have."""
    known = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return analytics.unknown_codes(table(spark, sf_dir, "orders"), known, "o_custkey")


@query("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def union_by_name(spark, sf_dir):
    """Two tables under each other by column names; a missing column is null."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_union(spark, sf_dir):
    """Nations of customers or suppliers."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT l_partkey AS partkey FROM lineitem WHERE l_quantity >= 49 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount >= 0.09")
def intersect_codes(spark, sf_dir):
    """Parts that sold both in bulk and at a high discount."""
    items = table(spark, sf_dir, "lineitem")
    return items.where("l_quantity >= 49").select(F.col("l_partkey").alias("partkey")).intersect(items.where("l_discount >= 0.09").select("l_partkey"))


@query("SELECT p_partkey AS partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 49")
def except_codes(spark, sf_dir):
    """Parts that never sold in bulk."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey")).subtract(table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select("l_partkey"))


@query(f"WITH {BY_STATUS} SELECT o_orderstatus, period, value FROM status_m WHERE period = (SELECT max(period) FROM status_m)")
def latest_snapshot(spark, sf_dir):
    """All series at the table's last month."""
    return analytics.latest(orders_monthly(spark, sf_dir, "o_orderstatus"))


@query("SELECT l_partkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def topk_groups(spark, sf_dir):
    """The twenty parts with most lines."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")).orderBy(F.desc("n"), "l_partkey").limit(20)


@query("""
SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, count(DISTINCT l_suppkey) AS n_suppliers, coalesce(round(sum(l_extendedprice) FILTER (WHERE l_discount BETWEEN 0.05 AND 0.07), 2), 0) AS mid_discount, min(CAST(l_shipdate AS DATE)) AS first_ship
FROM lineitem GROUP BY ALL""")
def filter_agg(spark, sf_dir):
    """Filtered and distinct aggregates in one pass."""
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.countDistinct("l_suppkey").alias("n_suppliers"), F.coalesce(F.round(F.sum(F.when(F.col("l_discount").between(0.05, 0.07), F.col("l_extendedprice"))), 2), F.lit(0.0)).alias("mid_discount"), F.min(F.to_date("l_shipdate")).alias("first_ship")
    )


@query("""
WITH w AS (SELECT c_nationkey, avg(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) AS building, avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal END) AS machinery FROM customer GROUP BY 1)
SELECT c_nationkey, round(building, 4) AS building, round(machinery, 4) AS machinery, round(100 * building / NULLIF(machinery, 0), 4) AS ratio_pct FROM w""")
def pivot_ratio(spark, sf_dir):
    """Long to wide by metric, means in the cells, and a ratio of two of them."""
    wide = analytics.pivot_metrics(table(spark, sf_dir, "customer"), ["c_nationkey"], ["BUILDING", "MACHINERY"], "c_mktsegment", "c_acctbal").toDF("c_nationkey", "building", "machinery")
    return _rounded(analytics.ratios(wide, ["c_nationkey", "building", "machinery"], {"ratio_pct": ("building", "machinery")}))


@query("""
WITH f AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, max(CASE WHEN o_orderpriority = '1-URGENT' THEN n END) AS urgent, max(CASE WHEN o_orderpriority = '5-LOW' THEN n END) AS low FROM f GROUP BY 1""")
def conditional_max_pivot(spark, sf_dir):
    """Long to wide by conditional maxima."""
    f = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    pick = lambda p, n: F.max(F.when(F.col("o_orderpriority") == p, F.col("n"))).alias(n)
    return f.groupBy("o_orderstatus").agg(pick("1-URGENT", "urgent"), pick("5-LOW", "low"))


@query("SELECT c_nationkey, metric, round(value, 2) AS value FROM (UNPIVOT (SELECT c_nationkey, CAST(count(*) AS DOUBLE) AS n, sum(c_acctbal) AS balance FROM customer GROUP BY 1) ON n, balance INTO NAME metric VALUE value)")
def unpivot_measures(spark, sf_dir):
    """Wide to long."""
    wide = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("n"), F.sum("c_acctbal").alias("balance"))
    return _rounded(wide.unpivot(["c_nationkey"], ["n", "balance"], "metric", "value"), 2)


@query(f"WITH {ORDERS} (SELECT * FROM orders_m ORDER BY period LIMIT 3) UNION (SELECT * FROM orders_m ORDER BY period DESC LIMIT 3)")
def head_tail_preview(spark, sf_dir):
    """The first and last three months."""
    return analytics.head_tail(orders_monthly(spark, sf_dir), 3)


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name ILIKE '%an%' OR regexp_matches(n_name, '^[JK]') OR (c_mktsegment IS DISTINCT FROM 'BUILDING' AND c_acctbal BETWEEN 0 AND 100) GROUP BY 1")
def predicate_mix(spark, sf_dir):
    """Case-insensitive, pattern, null-safe and range predicates together."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    wanted = F.col("n_name").ilike("%an%") | F.col("n_name").rlike("^[JK]") | (~F.col("c_mktsegment").eqNullSafe("BUILDING") & F.col("c_acctbal").between(0, 100))
    return joined.where(wanted).groupBy("n_name").agg(F.count("*").alias("n"))


# Outliers, frequency and statistics ---------------------------------------------------------------

SCORED = f"""{BY_STATUS}, g AS (SELECT *, date_diff('day', lag(period) OVER w, period) AS gap, lag(value) OVER w AS pv FROM status_m WINDOW w AS (PARTITION BY o_orderstatus ORDER BY period)),
m AS (SELECT o_orderstatus, median(gap) AS typical FROM g GROUP BY 1),
s AS (SELECT o_orderstatus, period, value, 100 * (value / NULLIF(pv, 0) - 1) / greatest(1, round_even(gap / typical, 0)) AS scored FROM g JOIN m USING (o_orderstatus) WHERE pv IS NOT NULL AND pv <> 0),
r AS (SELECT *, CASE WHEN count(*) OVER w >= 12 THEN avg(scored) OVER w END AS roll_mean, CASE WHEN count(*) OVER w >= 12 THEN stddev_pop(scored) OVER w END AS roll_std, CASE WHEN count(*) OVER w >= 12 THEN quantile_cont(scored, 0.25) OVER w END AS q1, CASE WHEN count(*) OVER w >= 12 THEN quantile_cont(scored, 0.75) OVER w END AS q3
FROM s WINDOW w AS (PARTITION BY o_orderstatus ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, (scored - roll_mean) / NULLIF(roll_std, 0) AS z_score, q1 - 1.0 * (q3 - q1) AS lower_fence, q3 + 1.0 * (q3 - q1) AS upper_fence FROM r),
o AS (SELECT *, coalesce(abs(z_score) >= 1.8 AND (scored < lower_fence OR scored > upper_fence), false) AS is_outlier FROM z)"""


def _scores(spark, sf_dir):
    # Wider bounds than the default three deviations, so that the smooth test series have flags to classify.
    return outliers.score(orders_monthly(spark, sf_dir, "o_orderstatus"), ["o_orderstatus"], "change", 12, 1.8, 1.0)


@query(f"WITH {SCORED} SELECT o_orderstatus, period, round(scored, 4) AS scored, round(roll_mean, 4) AS roll_mean, round(z_score, 3) AS z_score, round(lower_fence, 4) AS lower_fence, round(upper_fence, 4) AS upper_fence, is_outlier FROM o")
def outlier_scores(spark, sf_dir):
    """Every point against its trailing window."""
    out = _scores(spark, sf_dir).select("o_orderstatus", "period", "scored", "roll_mean", "z_score", "lower_fence", "upper_fence", "is_outlier")
    return _rounded(out.withColumn("z_score", F.round("z_score", 3)))


@query(f"""
WITH {SCORED}, n AS (SELECT *, array_agg(scored) OVER (PARTITION BY o_orderstatus ORDER BY period ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS nx FROM o)
SELECT o_orderstatus, period, round(scored, 4) AS scored, CASE WHEN scored > roll_mean THEN 'above' ELSE 'below' END AS direction,
CASE WHEN nx IS NULL OR len(nx) = 0 THEN 'undetermined' WHEN 2 * len(list_filter(nx, lambda x: CASE WHEN scored > roll_mean THEN x > upper_fence ELSE x < lower_fence END)) >= len(nx) THEN 'regime_start' ELSE 'spike' END AS kind FROM n WHERE is_outlier""")
def outlier_classify(spark, sf_dir):
    """Flags as spikes, regime starts or undetermined."""
    return _rounded(outliers.classify(_scores(spark, sf_dir), ["o_orderstatus"], 3).select("o_orderstatus", "period", "scored", "direction", "kind"))


@query("""
WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS period FROM orders), g AS (SELECT *, lag(period) OVER w AS after, date_diff('day', lag(period) OVER w, period) AS gap FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY period)),
m AS (SELECT o_custkey, median(gap) AS typical FROM g GROUP BY 1)
SELECT o_custkey, after, period AS before, CAST(greatest(1, round_even(gap / typical, 0)) - 1 AS INTEGER) AS missing_periods FROM g JOIN m USING (o_custkey) WHERE greatest(1, round_even(gap / typical, 0)) > 1""")
def gaps_and_spans(spark, sf_dir):
    """Where customers' orders pause for more than their typical gap."""
    days = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("period")).distinct()
    return series.find_gaps(days, ["o_custkey"])


@query("""
WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS period FROM orders), g AS (SELECT *, date_diff('day', lag(period) OVER (PARTITION BY o_custkey ORDER BY period), period) AS gap FROM d)
SELECT o_custkey, CASE WHEN count(*) >= 3 THEN CASE WHEN median(gap) <= 1.5 THEN 'day' WHEN median(gap) <= 8 THEN 'week' WHEN median(gap) <= 35 THEN 'month' WHEN median(gap) <= 100 THEN 'quarter' ELSE 'year' END END AS frequency, count(*) AS n_obs FROM g GROUP BY 1""")
def infer_frequency(spark, sf_dir):
    """Each customer's order frequency."""
    days = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("period")).distinct()
    return series.frequency(days, ["o_custkey"])


@query(f"""
WITH {BY_STATUS}, c AS (SELECT o_orderstatus, period, round(sum(value) OVER (PARTITION BY o_orderstatus, year(period) ORDER BY period), 2) AS value FROM status_m UNION ALL SELECT o_orderstatus || '_flow', period, value FROM status_m),
s AS (SELECT *, lag(value) OVER w AS pv, lag(period) OVER w AS pp FROM c WINDOW w AS (PARTITION BY o_orderstatus ORDER BY period)),
f AS (SELECT *, month(period) = 1 AND pp = period - INTERVAL 1 MONTH AND pv <> 0 AS jan, month(period) <> 1 AND pv IS NOT NULL AS ins FROM s),
v AS (SELECT o_orderstatus, CASE WHEN count(*) FILTER (WHERE jan) >= 2 THEN bool_and(abs(value) / abs(NULLIF(pv, 0)) < 0.3) FILTER (WHERE jan) END AS january_resets,
CASE WHEN count(*) FILTER (WHERE ins) >= 10 THEN avg(CASE WHEN value >= pv THEN 1.0 ELSE 0.0 END) FILTER (WHERE ins) >= 0.9 END AS rises_within_years, count(*) AS n_obs FROM f GROUP BY 1)
SELECT *, coalesce(n_obs >= 14 AND january_resets AND rises_within_years, false) AS year_to_date FROM v""")
def ytd_heuristic(spark, sf_dir):
    """Which series look year-to-date: running totals do, the flows they come from do not."""
    flows = orders_monthly(spark, sf_dir, "o_orderstatus")
    year = Window.partitionBy("o_orderstatus", F.year("period")).orderBy("period")
    totals = flows.withColumn("value", F.round(F.sum("value").over(year), 2))
    both = totals.unionByName(flows.withColumn("o_orderstatus", F.concat("o_orderstatus", F.lit("_flow"))))
    return series.looks_year_to_date(both, ["o_orderstatus"])


@query(f"""
WITH {BY_STATUS}, g AS (SELECT *, date_diff('day', lag(period) OVER w, period) AS gap, lag(value) OVER w AS pv FROM status_m WINDOW w AS (PARTITION BY o_orderstatus ORDER BY period)), m AS (SELECT o_orderstatus, median(gap) AS typical FROM g GROUP BY 1)
SELECT o_orderstatus, period, value, round(CASE WHEN value > 0 AND pv > 0 THEN 100 * (ln(value) - ln(pv)) / greatest(1, round_even(gap / typical, 0)) END, 4) AS growth_pct FROM g JOIN m USING (o_orderstatus)""")
def log_growth(spark, sf_dir):
    """Log growth per period."""
    return _rounded(series.log_growth(orders_monthly(spark, sf_dir, "o_orderstatus"), ["o_orderstatus"]).select("o_orderstatus", "period", "value", "growth_pct"))


@query(f"""
WITH {ORDERS}, {PRICE}, j AS (SELECT *, row_number() OVER (ORDER BY period) AS i FROM orders_m JOIN price_m USING (period)), k AS (SELECT unnest(range(-6, 7)) AS lag)
SELECT CAST(lag AS INTEGER) AS lag, round(CASE WHEN count(*) >= 3 THEN corr(c.price, e.value) END, 6) AS correlation, count(*) AS n_pairs FROM k JOIN j e ON true JOIN j c ON c.i = e.i - lag GROUP BY 1""")
def lead_lag_corr(spark, sf_dir):
    """Correlation of order value with earlier and later prices."""
    both = orders_monthly(spark, sf_dir).join(price_monthly(spark, sf_dir), "period")
    return _rounded(series.lead_lag(both, [], "price", "value", 6), 6)


@query(f"WITH {BY_STATUS}, p AS (SELECT *, lag(value, 12) OVER (PARTITION BY o_orderstatus ORDER BY period) AS b FROM status_m) SELECT o_orderstatus, round(CASE WHEN count(*) >= 26 THEN corr(value, b) END, 6) AS autocorrelation FROM p GROUP BY 1")
def autocorr_seasonal(spark, sf_dir):
    """Correlation with the value twelve rows before."""
    return _rounded(series.autocorrelation(orders_monthly(spark, sf_dir, "o_orderstatus"), ["o_orderstatus"], 12), 6)


@query(f"WITH {BY_STATUS} SELECT o_orderstatus, round(regr_slope(value, date_diff('day', DATE '1995-01-01', period)), 4) AS slope, round(regr_intercept(value, date_diff('day', DATE '1995-01-01', period)), 2) AS intercept, round(regr_r2(value, date_diff('day', DATE '1995-01-01', period)), 6) AS r2 FROM status_m GROUP BY 1")
def trend_line(spark, sf_dir):
    """Least-squares line of each series over days."""
    t = F.datediff("period", F.lit("1995-01-01").cast("date"))
    return orders_monthly(spark, sf_dir, "o_orderstatus").groupBy("o_orderstatus").agg(F.round(F.regr_slope("value", t), 4).alias("slope"), F.round(F.regr_intercept("value", t), 2).alias("intercept"), F.round(F.regr_r2("value", t), 6).alias("r2"))


# Quality ------------------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period FROM orders), s AS (SELECT o_custkey, min(period) AS a, max(period) AS b FROM d GROUP BY 1),
x AS (SELECT o_custkey, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS period FROM s) SELECT o_custkey, period FROM x ANTI JOIN d USING (o_custkey, period)""")
def continuity_missing(spark, sf_dir):
    """Months between a customer's first and last order in which they ordered nothing."""
    months = table(spark, sf_dir, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("period")).distinct()
    return quality.missing_periods(months, ["o_custkey"])


@query("""
WITH i AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS children_sum FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_totalprice AS parent_value, children_sum, round(o_totalprice - children_sum, 2) AS difference FROM orders JOIN i ON o_orderkey = l_orderkey WHERE abs(o_totalprice - children_sum) > greatest(2.0, 0.0005 * abs(o_totalprice))""")
def hierarchy_identity(spark, sf_dir):
    """Orders whose total is not the sum of their lines."""
    totals = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("order").alias("code"), F.col("o_totalprice").alias("value"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.lit("line").alias("code"), F.round(F.sum("l_extendedprice"), 2).alias("value"))
    parents = spark.createDataFrame([("line", "order")], "code string, parent string")
    found = quality.hierarchy_differences(totals.unionByName(lines), ["o_orderkey"], parents, "code", "value")
    return found.select("o_orderkey", "parent_value", "children_sum", F.round("difference", 2).alias("difference"))


@query("""
WITH l AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS left_value FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2),
r AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS right_value FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2),
d AS (SELECT *, 100 * (right_value - left_value) / NULLIF(left_value, 0) AS dv FROM l JOIN r USING (o_orderpriority, period)),
b AS (SELECT *, avg(dv) OVER w - 3 * stddev_samp(dv) OVER w AS lo, avg(dv) OVER w + 3 * stddev_samp(dv) OVER w AS hi FROM d WINDOW w AS (PARTITION BY o_orderpriority))
SELECT o_orderpriority, period, left_value, right_value, round(dv, 4) AS divergence_pct, round(lo, 4) AS band_lower, round(hi, 4) AS band_upper, NOT coalesce(dv BETWEEN lo AND hi, false) AS out_of_band FROM b""")
def reconciliation_band(spark, sf_dir):
    """Two halves of the orders as two sources: their divergence and its band."""
    orders = table(spark, sf_dir, "orders").withColumn("period", F.trunc("o_orderdate", "month"))
    side = lambda odd, name: orders.where(F.col("o_orderkey") % 2 == odd).groupBy("o_orderpriority", "period").agg(F.round(F.sum("o_totalprice"), 2).alias(name))
    return _rounded(analytics.reconcile(side(0, "left_value"), side(1, "right_value"), ["o_orderpriority"]))


@query("""
WITH q AS (SELECT o_orderpriority AS old_key, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, count(*) AS a FROM orders GROUP BY 1, 2), p AS (SELECT o_orderstatus AS new_key, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, count(*) AS b FROM orders GROUP BY 1, 2),
r AS (SELECT old_key, new_key, avg(CASE WHEN abs(a - b) <= 0.2 * greatest(abs(a), 1e-12) THEN 1.0 ELSE 0.0 END) AS agreement, count(*) AS n_common FROM q JOIN p USING (period) GROUP BY 1, 2)
SELECT old_key, new_key, round(agreement, 6) AS agreement, n_common FROM (SELECT *, row_number() OVER (PARTITION BY old_key ORDER BY agreement DESC, n_common DESC, new_key) AS i FROM r) WHERE i = 1""")
def superseded_match(spark, sf_dir):
    """For every series of one kind the series of another that agrees with it best."""
    orders = table(spark, sf_dir, "orders").withColumn("period", F.trunc("o_orderdate", "quarter"))
    side = lambda c, k: orders.groupBy(F.col(c).alias(k), "period").agg(F.count("*").alias("value"))
    return _rounded(quality.best_successors(side("o_orderpriority", "old_key"), side("o_orderstatus", "new_key"), ["period"], 0.2), 6)


@query("""
WITH f AS (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS fine_value FROM orders GROUP BY 1, 2), c AS (SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS coarse_value FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, c.period, date, fine_value, coarse_value FROM f JOIN c USING (o_orderstatus) WHERE last_day(date) = date AND c.period = CAST(date_trunc('month', date) AS DATE)""")
def month_end_alignment(spark, sf_dir):
    """Values of month ends beside those of their months."""
    fine = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.to_date("o_orderdate").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return quality.month_end_pairs(fine, orders_monthly(spark, sf_dir, "o_orderstatus"), ["o_orderstatus"])


@query("SELECT l_orderkey, l_partkey, count(DISTINCT l_quantity) AS n_values, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_quantity) > 1")
def overlap_conflict(spark, sf_dir):
    """Keys with more than one value."""
    return quality.conflicts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], "l_quantity")


@query(f"""
WITH {EVENT_DAYS}, s AS (SELECT DISTINCT event_type, CAST(unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS period FROM event_d)
SELECT event_type, count(*) AS expected, count(day) AS present, round(count(day) / count(*), 6) AS coverage FROM s LEFT JOIN event_d USING (event_type) WHERE day IS NULL OR day = period GROUP BY 1""".replace("USING (event_type) WHERE day IS NULL OR day = period", "ON s.event_type = event_d.event_type AND day = period").replace("SELECT event_type, count(*) AS expected", "SELECT s.event_type, count(*) AS expected"))
def coverage_report(spark, sf_dir):
    """How many days of a published span each event type has."""
    days = events_daily(spark, sf_dir).select("event_type", F.col("day").alias("period"))
    spans = days.select("event_type").distinct().withColumns({"published_start": F.lit("2023-12-30").cast("date"), "published_end": F.lit("2024-02-02").cast("date")})
    return _rounded(quality.coverage(days, spans, "event_type", step="1 day"), 6)


# Indexes, search and documents --------------------------------------------------------------------


@query("""
SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_period, max(CAST(o_orderdate AS DATE)) AS last_period, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_periods, count(*) AS n_observations, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS o_orderstatus_list FROM orders GROUP BY 1""")
def entity_index(spark, sf_dir):
    """One row per customer: span, counts and the list of statuses."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("period"), "o_orderstatus")
    return analytics.entity_index(orders, ["o_custkey"], ["o_orderstatus"])


@query("""
WITH e AS (SELECT 'r' || r_regionkey AS entity_key, r_name AS entity_name, NULL AS parent_key FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation),
k AS (SELECT parent_key, count(DISTINCT entity_key) AS n FROM e GROUP BY 1)
SELECT e.entity_key, e.entity_name, e.parent_key, coalesce(k.n, 0) AS n_children, p.entity_name AS parent_name FROM e LEFT JOIN k ON k.parent_key = e.entity_key LEFT JOIN e p ON p.entity_key = e.parent_key""")
def hierarchy_children(spark, sf_dir):
    """Regions and nations as one index with children counted and parents named."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("entity_key"), F.col("r_name").alias("entity_name"), F.lit(None).cast("string").alias("parent_key"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("entity_key"), F.col("n_name").alias("entity_name"), F.concat(F.lit("r"), "n_regionkey").alias("parent_key"))
    return analytics.with_children(r.union(n))


TERMS = {"lemon": 4.0, "brass": 3.0, "blue": 1.0, "st": 0.8}


def _score_sql(terms: dict[str, float]) -> str:
    at = []
    for t, w in terms.items():
        at.append(f"CASE WHEN contains(k, '{t}') THEN CASE WHEN starts_with(k, '{t}') THEN {3 * w} ELSE {2 * w} END ELSE 0 END + CASE WHEN contains(n, '{t}') THEN {1.5 * w} WHEN contains(c, '{t}') THEN {0.6 * w} ELSE 0 END")
    hits = " + ".join(f"CAST(contains(k, '{t}') OR contains(n, '{t}') OR contains(c, '{t}') AS INTEGER)" for t in terms)
    return " + ".join(at) + f" + 2.0 * greatest({hits} - 1, 0)"


PARTS = "p AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS k, lower(p_name) AS n, lower(p_type || ' ' || p_brand) AS c FROM part)"


def _scored_parts(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    # Each text is folded once a row, however many terms look at it.
    folded = F.struct(labels.slug(F.col("p_name")).alias("k"), labels.fold(F.col("p_name")).alias("n"), labels.fold(F.concat_ws(" ", "p_type", "p_brand")).alias("c"))
    score = labels.let(folded, lambda x: search.term_score(x["k"], x["n"], x["c"], TERMS))
    return parts.select("p_partkey", "p_brand", F.round(score, 4).alias("score")).where("score > 0")


@query(f"WITH {PARTS} SELECT p_partkey, CAST(round({_score_sql(TERMS)}, 4) AS DOUBLE) AS score FROM p WHERE {_score_sql(TERMS)} > 0 ORDER BY score DESC, p_partkey LIMIT 50")
def term_score_search(spark, sf_dir):
    """Parts by weighted terms in key, name and context."""
    return _scored_parts(spark, sf_dir).drop("p_brand").orderBy(F.desc("score"), "p_partkey").limit(50)


@query(f"WITH {PARTS}, s AS (SELECT p.p_partkey, p_brand, CAST(round({_score_sql(TERMS)}, 4) AS DOUBLE) AS score FROM p JOIN part USING (p_partkey)), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS i FROM s WHERE score > 0) SELECT p_partkey, p_brand, score FROM r WHERE i <= 2")
def diversify_cap(spark, sf_dir):
    """The best two parts of every brand."""
    return analytics.diversify(_scored_parts(spark, sf_dir), "p_brand", [F.desc("score"), "p_partkey"], 2)


QUERY_VECTOR = [round(0.3 * ((7 * i) % 11 - 5) / 5, 3) for i in range(64)]
COSINE = f"list_dot_product(CAST(embedding AS DOUBLE[]), {QUERY_VECTOR}) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product({QUERY_VECTOR}, {QUERY_VECTOR})))"


@query(f"SELECT vec_id, round({COSINE}, 6) AS score FROM embeddings ORDER BY {COSINE} DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    """The twenty vectors nearest to a query vector."""
    return _rounded(search.cosine_topk(table(spark, sf_dir, "embeddings"), QUERY_VECTOR, 20, "vec_id", "embedding"), 6)


@query(f"""
WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY {COSINE} DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 30), b AS (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) AS rank FROM embeddings QUALIFY rank <= 30),
u AS (SELECT vec_id, 1.0 / (60 + rank) AS part FROM a UNION ALL SELECT vec_id, 0.5 / (60 + rank) FROM b) SELECT vec_id, round(sum(part), 8) AS rrf FROM u GROUP BY 1""")
def rrf_fusion(spark, sf_dir):
    """A vector list and a label list fused by weighted reciprocal ranks."""
    rows = table(spark, sf_dir, "embeddings")
    a = search.ranked(search.cosine_topk(rows, QUERY_VECTOR, 30, "vec_id", "embedding"), [F.desc("score"), "vec_id"])
    b = search.ranked(rows.select("vec_id", "label").orderBy("label", "vec_id").limit(30), ["label", "vec_id"])
    return _rounded(search.fuse([a, b], "vec_id", [1.0, 0.5]), 8)


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS canonical_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS n_copies FROM documents")
def exact_dedup(spark, sf_dir):
    """Every document with the smallest id of its text."""
    return search.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT DISTINCT p_name, lower(p_name) AS folded, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') || '/' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS qualified FROM part")
def slug_fold_keys(spark, sf_dir):
    """Folded names and keys of parts, alone and under their brand."""
    parts = table(spark, sf_dir, "part")
    name = F.col("p_name")
    return parts.select(name, labels.fold(name).alias("folded"), labels.slug(name).alias("slug"), labels.qualified(labels.slug(F.col("p_brand")), labels.slug(name)).alias("qualified")).distinct()


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, substr(props, 1, 20) AS excerpt, substr(sha256(props), 1, 12) AS source_id FROM events")
def json_scalars(spark, sf_dir):
    """Scalars out of stored JSON, an excerpt window and a short content id."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.substring("props", 1, 20).alias("excerpt"), F.substring(F.sha2("props", 256), 1, 12).alias("source_id"))


@query(f"""
WITH {BY_STATUS}, m AS (SELECT o_orderstatus, arg_max(value, period) - arg_min(value, period) AS d FROM status_m GROUP BY 1)
SELECT a.o_orderstatus AS one, b.o_orderstatus AS other, CAST(sign(a.d * b.d) AS INTEGER) AS agreement FROM (VALUES ('F', 'O'), ('F', 'P'), ('O', 'P')) n(one, other) JOIN m a ON a.o_orderstatus = one JOIN m b ON b.o_orderstatus = other""")
def movement_agreement(spark, sf_dir):
    """Whether named pairs of series moved the same way from end to end."""
    m = orders_monthly(spark, sf_dir, "o_orderstatus").groupBy("o_orderstatus").agg((F.max_by("value", "period") - F.min_by("value", "period")).alias("d"))
    a, b = m.select(F.col("o_orderstatus").alias("one"), F.col("d").alias("d1")), m.select(F.col("o_orderstatus").alias("other"), F.col("d").alias("d2"))
    pairs = spark.createDataFrame([("F", "O"), ("F", "P"), ("O", "P")], "one string, other string")
    return pairs.join(a, "one").join(b, "other").select("one", "other", F.signum(F.col("d1") * F.col("d2")).cast("int").alias("agreement"))


@query(f"""
WITH {PARTS}, r AS (SELECT p_partkey, row_number() OVER (ORDER BY {_score_sql(TERMS)} DESC, p_partkey) AS rank FROM p WHERE {_score_sql(TERMS)} > 0),
q AS (SELECT p_partkey, rank FROM (SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_quantity = 50) LEFT JOIN (SELECT * FROM r WHERE rank <= 500) USING (p_partkey))
SELECT round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS recall_at_10, round(avg(CASE WHEN rank <= 500 THEN 1 ELSE 0 END), 6) AS recall_at_500, count(*) AS n FROM q""")
def recall_at_k(spark, sf_dir):
    """Share of wanted parts among the first of a ranked list."""
    top = search.ranked(_scored_parts(spark, sf_dir).orderBy(F.desc("score"), "p_partkey").limit(500), [F.desc("score"), "p_partkey"])
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return _rounded(search.recall_at(wanted.join(top, "p_partkey", "left"), [10, 500]), 6)
