"""Queries that SQL cannot express: registered without oracle SQL and tested by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import orders_monthly, price_monthly, query
from tidemark.functions import pages
from tidemark.operators import causality, changepoints
from tidemark.session import table


@query()
def change_points(spark, sf_dir):
    """Breaks in the level of every customer nation's monthly order value."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("period"), "o_totalprice")
    nations = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    monthly = orders.join(nations, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "period").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return changepoints.change_points(monthly, ["c_nationkey"], "level", "high")


@query()
def granger_pairs(spark, sf_dir):
    """Whether prices precede the order value of each status, or the other way."""
    both = orders_monthly(spark, sf_dir, "o_orderstatus").join(price_monthly(spark, sf_dir), "period")
    return causality.granger_pairs(both, ["o_orderstatus"], "value", "price")


@query()
def html_to_text(spark, sf_dir):
    """Readable text of every page."""
    return table(spark, sf_dir, "pages").select("page_id", pages.html_to_text("html").alias("text"))


@query()
def page_assets(spark, sf_dir):
    """Up to ten links of every page, with a type and a short id."""
    found = pages.assets(table(spark, sf_dir, "pages"), "page_id", "url", "html", 10)
    return found.withColumn("source_id", pages.source_id(F.col("link")))
