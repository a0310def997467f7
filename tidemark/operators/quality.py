"""Checks that stop a bad build: each gives the rows that fail, and `enforce` raises on any."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a task that groups nearly distinct rows, and tasks that share the rows of one key and value.
GROUP_ROWS, SALTS = 250_000, 16


class ValidationError(ValueError):
    """A check that must hold does not; the message has its name and the first failures."""


def enforce(name: str, failures: DataFrame, show: int = 5) -> None:
    """Raises ValidationError if the frame has rows; reads ``show`` of them only."""
    found = failures.limit(show).collect()
    if found:
        raise ValidationError(f"{name}: " + "; ".join(str(r.asDict()) for r in found))


def missing_periods(df: DataFrame, keys: list[str], step: str = "1 month", period: str = "period") -> DataFrame:
    """Periods between an entity's first and last that it has no row for."""
    spans = df.groupBy(*keys).agg(F.min(period).alias("a"), F.max(period).alias("b"))
    spine = spans.select(*keys, F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias(period))
    return spine.join(df.select(*keys, period), [*keys, period], "left_anti")


def outside_lifecycle(df: DataFrame, lifecycles: DataFrame, key: str, period: str = "period") -> DataFrame:
    """Rows before an entity's registered first period or after its last; null bounds are open."""
    joined = df.join(lifecycles.select(key, "first_valid", "last_valid"), key)
    return joined.where((F.col(period) < F.col("first_valid")) | (F.col(period) > F.col("last_valid")))


def hierarchy_differences(df: DataFrame, keys: list[str], parent_of: DataFrame, code: str, value: str, absolute: float = 2.0, relative: float = 0.0005) -> DataFrame:
    """Parents whose value differs from their children's sum by more than max(absolute, relative * |value|).

    ``df`` is evaluated once: a row counts as a child of its parents and, if it is one, as a parent itself, and both
    meet in one aggregate. Parents without a row, or without rows of children, are left out.
    """
    ups = parent_of.groupBy(F.col(code).alias("__node")).agg(F.collect_list("parent").alias("__ups"))
    nodes = ups.join(parent_of.select(F.col("parent").alias("__node"), F.lit(True).alias("__is_parent")).distinct(), "__node", "full")
    part = lambda node, child, own: F.struct(node.alias("node"), child.alias("child"), own.alias("own"))
    # In a struct, so that a null value is still told apart from no row.
    told, none = F.struct(F.col(value).alias("v")), F.lit(None).cast(f"struct<v:{df.schema[value].dataType.simpleString()}>")
    own = F.filter(F.array(part(F.col(code), none, told)), lambda _: F.coalesce("__is_parent", F.lit(False)))
    above = F.transform(F.coalesce("__ups", F.array().cast(f"array<{df.schema[code].dataType.simpleString()}>")), lambda p: part(p, told, none))
    sides = df.join(nodes, F.col(code) == F.col("__node")).select(*keys, F.explode(F.concat(own, above)).alias("s")).select(*keys, F.col("s.node").alias("parent"), "s.child", "s.own")
    sums = sides.groupBy(*keys, "parent").agg(F.collect_list("own").alias("__own"), F.sum("child.v").alias("children_sum"), F.count("child").alias("__n"))
    both = sums.where("__n > 0").select(*keys, "parent", F.explode("__own").alias("__own"), "children_sum").select(*keys, "parent", F.col("__own.v").alias("parent_value"), "children_sum")
    found = both.withColumn("difference", F.col("parent_value") - F.col("children_sum"))
    return found.where(F.abs("difference") > F.greatest(F.lit(absolute), relative * F.abs("parent_value")))


def formula_differences(df: DataFrame, keys: list[str], terms: DataFrame, position: str, value: str, absolute: float = 2.0, relative: float = 0.0005) -> DataFrame:
    """Rows whose value is not the signed sum of the rows that their label's formula names.

    ``terms`` has (position, sign, term_position); rows of a formula that are absent make it incomplete
    and are left to the continuity check.
    """
    needed = terms.groupBy(position).agg(F.count("*").alias("__need"))
    parts = df.select(*keys, F.col(position).alias("term_position"), F.col(value).alias("__v")).join(terms, "term_position")
    sums = parts.groupBy(*keys, position).agg(F.sum(F.col("sign") * F.col("__v")).alias("expected"), F.count("*").alias("__have")).join(needed, position).where("__have = __need")
    both = df.join(sums.drop("__have", "__need"), [*keys, position])
    return both.where(F.abs(F.col(value) - F.col("expected")) > F.greatest(F.lit(absolute), relative * F.abs(value)))


def conflicts(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Keys that occur with more than one value.

    Tasks grow in number with the rows, GROUP_ROWS each, so what one holds does not grow. Rows that agree in key and value
    are first counted in up to SALTS tasks, so those of a very frequent key do not meet as rows.
    """
    tasks = max(1, -(-df.count() // GROUP_ROWS))
    salted = df.select(*keys, value, (F.spark_partition_id() % SALTS).alias("__salt"))
    counted = salted.repartition(tasks, *keys, value, "__salt").groupBy(*keys, value, "__salt").agg(F.count("*").alias("__n"))
    met = counted.repartition(tasks, *keys).groupBy(*keys)
    return met.agg(F.countDistinct(value).alias("n_values"), F.sum("__n").alias("n_rows")).where("n_values > 1")


def coverage(df: DataFrame, spans: DataFrame, key: str, period: str = "period", step: str = "1 month") -> DataFrame:
    """Per series: periods expected in its published span, present ones and their share."""
    spine = spans.select(key, F.explode(F.sequence("published_start", "published_end", F.expr(f"INTERVAL {step}"))).alias(period))
    have = df.select(key, period, F.lit(1).alias("__have")).distinct()
    return spine.join(have, [key, period], "left").groupBy(key).agg(F.count("*").alias("expected"), F.count("__have").alias("present"), (F.count("__have") / F.count("*")).alias("coverage"))


def best_successors(old: DataFrame, new: DataFrame, on: list[str], tolerance: float) -> DataFrame:
    """For each retired series the current one that agrees best where both have values: an equi-join on
    ``on`` and one argmax by retired series; ties go to the smaller key."""
    both = old.select("old_key", *on, F.col("value").alias("a")).join(new.select("new_key", *on, F.col("value").alias("b")), on)
    near = F.abs(F.col("a") - F.col("b")) <= tolerance * F.greatest(F.abs("a"), F.lit(1e-12))
    rated = both.groupBy("old_key", "new_key").agg(F.avg(near.cast("double")).alias("agreement"), F.count("*").alias("n_common"))
    first = Window.partitionBy("old_key").orderBy(F.desc("agreement"), F.desc("n_common"), "new_key")
    return rated.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def month_end_pairs(fine: DataFrame, coarse: DataFrame, keys: list[str], date: str = "date", period: str = "period") -> DataFrame:
    """Fine rows that fall on the last day of a month beside the coarse row of that month."""
    ends = fine.where(F.last_day(date) == F.col(date)).withColumn(period, F.trunc(date, "month")).withColumnRenamed("value", "fine_value")
    return ends.join(coarse.withColumnRenamed("value", "coarse_value"), [*keys, period])


def risk_weight_differences(df: DataFrame, keys: list[str], label: str, value: str, total: str, absolute: float = 2.0, relative: float = 0.0005) -> DataFrame:
    """Keys whose ``total`` is not the sum of their rows, each times the percentage that its label states."""
    weight = F.regexp_extract(F.col(label), r"%\s*([0-9]+)|([0-9]+)\s*%", 0)
    share = F.regexp_replace(weight, "[^0-9]", "").try_cast("double") / 100
    sums = df.groupBy(*keys).agg(F.sum(F.when(share.isNotNull(), share * F.col(value))).alias("weighted_sum"), F.max(total).alias("total"))
    return sums.where(F.abs(F.col("total") - F.coalesce("weighted_sum", F.lit(0.0))) > F.greatest(F.lit(absolute), relative * F.abs("total")))


def missing_flows(df: DataFrame, keys: list[str], value: str, flow: str) -> DataFrame:
    """Per key, how many published year-to-date values have no flow; only keys that have any."""
    return df.groupBy(*keys).agg(F.count(value).alias("n_values"), F.count_if(F.col(value).isNotNull() & F.col(flow).isNull()).alias("n_missing")).where("n_missing > 0")


def broken_sequences(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    """Keys whose codes are not exactly 1 to n: a gap, a repeat or a code below 1."""
    facts = df.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(code).alias("distinct_codes"), F.min(code).alias("first_code"), F.max(code).alias("last_code"))
    return facts.where((F.col("n") != F.col("distinct_codes")) | (F.col("first_code") != 1) | (F.col("last_code") != F.col("n")))
