"""Derived tables: ratios, reconciliation, indexes of what can be found, and set operations on codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import safe_ratio


def pivot_metrics(df: DataFrame, keys: list[str], metrics: list[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """Long to wide by metric; several values of a cell are averaged."""
    return df.groupBy(*keys).pivot(metric, metrics).agg(F.avg(value))


def ratios(wide: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """100 * a / b for every named pair of columns."""
    return wide.select(*keys, *((100 * safe_ratio(F.col(a), F.col(b))).alias(n) for n, (a, b) in pairs.items()))


def side_sum(df: DataFrame, crosswalk: DataFrame, keys: list[str], code: str = "code", value: str = "value") -> DataFrame:
    """Sums a side's values over the codes each canonical sector has in the crosswalk; the crosswalk is a
    dimension table, left to the planner's size check for broadcasting."""
    return df.join(crosswalk, code).groupBy("canonical", *keys).agg(F.sum(value).alias(value))


def reconcile(left: DataFrame, right: DataFrame, group: list[str], hard: tuple[float, float] | None = None, period: str = "period") -> DataFrame:
    """Divergence of right from left in percent, its band of three deviations by group, and what is out of it.

    A group of one period has no deviation, so no band, and counts as out of it. ``hard`` bounds hold besides.
    """
    both = left.join(right, [*group, period]).where("left_value IS NOT NULL AND right_value IS NOT NULL")
    both = both.withColumn("divergence_pct", 100 * safe_ratio(F.col("right_value") - F.col("left_value"), F.col("left_value")))
    w = Window.partitionBy(*group)
    mean, std = F.avg("divergence_pct").over(w), F.stddev_samp("divergence_pct").over(w)
    out = both.withColumns({"band_lower": mean - 3 * std, "band_upper": mean + 3 * std})
    inside = F.coalesce(F.col("divergence_pct").between(F.col("band_lower"), F.col("band_upper")), F.lit(False))
    if hard:
        inside = inside & F.col("divergence_pct").between(*hard)
    return out.withColumn("out_of_band", ~inside)


def entity_index(df: DataFrame, keys: list[str], lists: list[str], period: str = "period") -> DataFrame:
    """One row per entity: span, counts, and the sorted distinct values of each list column, comma-joined, null if none."""
    agg = [F.min(period).alias("first_period"), F.max(period).alias("last_period"), F.countDistinct(period).alias("n_periods"), F.count("*").alias("n_observations")]
    for c in lists:
        joined = F.array_join(F.array_sort(F.collect_set(c)), ",")
        agg.append(F.when(joined != "", joined).alias(f"{c}_list"))
    return df.groupBy(*keys).agg(*agg)


def with_children(index: DataFrame, key: str = "entity_key", parent: str = "parent_key", name: str = "entity_name") -> DataFrame:
    """Adds n_children and parent_name by two joins of the index with itself."""
    children = index.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("__p")).agg(F.countDistinct(key).alias("n_children"))
    parents = index.select(F.col(key).alias("__k"), F.col(name).alias("parent_name")).dropDuplicates(["__k"])
    return index.join(children, F.col(key) == F.col("__p"), "left").join(parents, F.col(parent) == F.col("__k"), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).drop("__p", "__k")


def diversify(ranked: DataFrame, group: str, order: list, per_group: int = 8, limit: int | None = None) -> DataFrame:
    """At most ``per_group`` rows of each group in rank order, then at most ``limit`` in all."""
    kept = ranked.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= per_group).drop("__n")
    return kept.orderBy(*order).limit(limit) if limit else kept


def latest(df: DataFrame, period: str = "period", keys: list[str] | None = None) -> DataFrame:
    """The rows of the last period, of the table or of each of ``keys``."""
    if keys:
        newest = F.max(period).over(Window.partitionBy(*keys))
        return df.withColumn("__last", newest).where(F.col(period) == F.col("__last")).drop("__last")
    return df.join(df.agg(F.max(period).alias("__last")), F.col(period) == F.col("__last")).drop("__last")


def unknown_codes(facts: DataFrame, dimension: DataFrame, code: str) -> DataFrame:
    """Codes of the facts that the dimension does not have."""
    return facts.select(code).distinct().join(dimension.select(code), code, "left_anti")


def head_tail(df: DataFrame, n: int, period: str = "period") -> DataFrame:
    """The first and the last ``n`` rows by period, each row once, by two bounded sorts."""
    return df.orderBy(period).limit(n).union(df.orderBy(F.desc(period)).limit(n)).distinct()
