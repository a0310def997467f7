"""Operators over period-indexed series in bulk: every function takes a long table of many series and
partitions its windows by the series' keys, so one plan serves one series or a million.

Gaps in publication are rows that are not there: lags are positional unless said otherwise.
Divisions by zero and by null give null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: list[str], period: str = "period"):
    """The window of a series in period order."""
    return Window.partitionBy(*keys).orderBy(period)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


def percent_change(value: Column, before: Column) -> Column:
    """100 * (value / before - 1)."""
    return 100 * (safe_ratio(value, before) - 1)


def change(df: DataFrame, keys: list[str], periods: int = 1, value: str = "value", name: str = "change_pct", period: str = "period") -> DataFrame:
    """Percent change over ``periods`` rows of a series."""
    return df.withColumn(name, percent_change(F.col(value), F.lag(value, periods).over(ordered(keys, period))))


def net_change(df: DataFrame, keys: list[str], periods: int = 1, value: str = "value", name: str = "net_change", period: str = "period") -> DataFrame:
    """Difference over ``periods`` rows of a series."""
    return df.withColumn(name, F.col(value) - F.lag(value, periods).over(ordered(keys, period)))


def growth_table(df: DataFrame, keys: list[str], value: str = "value", period: str = "period") -> DataFrame:
    """mom_pct and yoy_pct by 1 and 12 rows; rows where both are null are left out."""
    grown = change(change(df, keys, 1, value, "mom_pct", period), keys, 12, value, "yoy_pct", period)
    return grown.where(F.col("mom_pct").isNotNull() | F.col("yoy_pct").isNotNull())


def base_value(df: DataFrame, keys: list[str], base_period: str | None = None, value: str = "value", period: str = "period") -> DataFrame:
    """Each series' value at ``base_period`` or at its first non-null period from then on."""
    known = df.where(F.col(value).isNotNull())
    if base_period:
        known = known.where(F.col(period) >= F.lit(base_period).cast("date"))
    return known.groupBy(*keys).agg(F.min_by(value, period).alias("base"), F.min(period).alias("base_period"))


def _with_base(df: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(base, keys) if keys else df.crossJoin(base)  # without keys the base is one row


def index_to_base(df: DataFrame, keys: list[str], base_period: str | None = None, value: str = "value", name: str = "index", period: str = "period") -> DataFrame:
    """100 * value / base; null where the base is 0."""
    base = base_value(df, keys, base_period, value, period).drop("base_period")
    return _with_base(df, base, keys).withColumn(name, 100 * safe_ratio(F.col(value), F.col("base"))).drop("base")


def deflate(df: DataFrame, keys: list[str], deflator: str, base_period: str | None = None, value: str = "value", name: str = "real", period: str = "period") -> DataFrame:
    """value * (deflator at the base / deflator): the value in prices of the base period."""
    base = base_value(df, keys, base_period, deflator, period).drop("base_period")
    return _with_base(df, base, keys).withColumn(name, F.col(value) * safe_ratio(F.col("base"), F.col(deflator))).drop("base")


def sum_columns(columns: list[str]) -> Column:
    """The sum of columns, null where any is null."""
    return reduce(lambda a, b: a + b, map(F.col, columns))


def share(a: str, b: str) -> Column:
    """100 * a / b."""
    return 100 * safe_ratio(F.col(a), F.col(b))


def decumulate(df: DataFrame, keys: list[str], value: str = "value", name: str = "value_flow", period: str = "period") -> DataFrame:
    """Year-to-date values as flows: the difference to the row before within a year, the first present row as it is."""
    year = Window.partitionBy(*keys, F.year(period)).orderBy(period)
    return df.withColumn(name, F.when(F.row_number().over(year) == 1, F.col(value)).otherwise(F.col(value) - F.lag(value).over(year)))


def aggregate_monthly(df: DataFrame, keys: list[str], date: str, value: str, rule: str | Column = "last") -> DataFrame:
    """Daily or weekly rows as months: value_avg, value_last, value_sum, n_native and value by the rule.

    ``rule`` is last, avg or sum, or a column that says it by row. The sum is null unless the rule is
    sum, for which alone it has a meaning.
    """
    rule = F.lit(rule) if isinstance(rule, str) else rule
    known = df.where(F.col(value).isNotNull()).withColumn("period", F.trunc(date, "month")).withColumn("__rule", rule)
    out = known.groupBy(*keys, "period").agg(
        F.avg(value).alias("value_avg"), F.max_by(value, date).alias("value_last"), F.sum(value).alias("value_sum"), F.count("*").alias("n_native"), F.max("__rule").alias("__rule")
    )
    out = out.withColumn("value_sum", F.when(F.col("__rule") == "sum", F.col("value_sum")))
    pick = F.when(F.col("__rule") == "avg", F.col("value_avg")).when(F.col("__rule") == "sum", F.col("value_sum")).when(F.col("__rule") == "last", F.col("value_last"))
    return out.withColumn("value", pick).drop("__rule")


def moves(df: DataFrame, keys: list[str], column: str, direction: str = "down", against: str | None = None, against_direction: str = "up", min_abs_change: float = 0.0, period: str = "period") -> DataFrame:
    """Rows where ``column`` went ``direction`` by more than ``min_abs_change`` while ``against`` rose (up) or did not (down)."""
    w = ordered(keys, period)
    out = df.withColumn(f"{column}_change", F.col(column) - F.lag(column).over(w))
    limit = abs(min_abs_change)
    wanted = F.col(f"{column}_change") < -limit if direction == "down" else F.col(f"{column}_change") > limit
    if against:
        out = out.withColumn(f"{against}_change", F.col(against) - F.lag(against).over(w))
        wanted = wanted & (F.col(f"{against}_change") > 0 if against_direction == "up" else F.col(f"{against}_change") <= 0)
    return out.where(wanted)


def decompose_growth(df: DataFrame, keys: list[str], nominal: str, deflator: str, period: str = "period") -> DataFrame:
    """First-to-last growth of a nominal column split into price and real growth, in percent."""
    both = df.where(F.col(nominal).isNotNull() & F.col(deflator).isNotNull())
    ends = both.groupBy(*keys).agg(
        *(f(c, period).alias(f"{n}_{e}") for c, n in ((nominal, "nominal"), (deflator, "price")) for f, e in ((F.min_by, "first"), (F.max_by, "last"))),
        F.min(period).alias("period_start"), F.max(period).alias("period_end"), F.count("*").alias("n"),
    ).where("n >= 2")
    g = lambda c: safe_ratio(F.col(f"{c}_last"), F.col(f"{c}_first")) - 1
    real = safe_ratio(1 + g("nominal"), 1 + g("price")) - 1
    share_of = F.when((g("nominal") > 0) & (g("price") > -1), safe_ratio(F.log1p(g("price")), F.log1p(g("nominal"))))
    reading = F.when(real < -0.02, "price").when(real > 0.02, "real").otherwise("even")
    return ends.withColumns({"nominal_pct": 100 * g("nominal"), "price_pct": 100 * g("price"), "real_pct": 100 * real, "price_share": share_of, "reading": reading}).drop("n")


def year_end_growth(df: DataFrame, keys: list[str], nominal: str, deflator: str, period: str = "period") -> DataFrame:
    """Growth from one December that is present to the next, split as in `decompose_growth`."""
    w = ordered(keys, period)
    ends = df.where((F.month(period) == 12) & F.col(nominal).isNotNull() & F.col(deflator).isNotNull())
    g = lambda c: safe_ratio(F.col(c), F.lag(c).over(w)) - 1
    out = ends.withColumns({"n": g(nominal), "p": g(deflator)}).where("n IS NOT NULL")
    return out.select(*keys, F.year(period).alias("year"), (100 * F.col("n")).alias("nominal_pct"), (100 * F.col("p")).alias("price_pct"), (100 * (safe_ratio(1 + F.col("n"), 1 + F.col("p")) - 1)).alias("real_pct"))


def summarise(df: DataFrame, columns: dict[str, str], period: str = "period") -> DataFrame:
    """One row per column: first and last non-null value and period, change, extremes and count.

    ``columns`` gives each its unit; the change is in points for % and else in percent. One pass over
    the table: all columns are aggregated together.
    """
    parts = {}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col(period))
        parts |= {f"{c}__first": F.min_by(c, at), f"{c}__last": F.max_by(c, at), f"{c}__from": F.min(at), f"{c}__to": F.max(at), f"{c}__min": F.min(c), f"{c}__max": F.max(c), f"{c}__min_at": F.min_by(period, F.struct(F.col(c).isNull(), F.col(c), F.col(period))), f"{c}__n": F.count(c)}
    wide = df.agg(*(v.alias(k) for k, v in parts.items()))
    names = ("first", "last", "from", "to", "min", "max", "n")
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(u).alias("unit"), *(F.col(f"{c}__{n}").alias(n) for n in names)) for c, u in columns.items()))
    out = wide.select(F.explode(rows).alias("r")).select("r.*")
    change_ = F.when(F.col("unit") == "%", F.col("last") - F.col("first")).otherwise(percent_change(F.col("last"), F.col("first")))
    return out.withColumn("change", change_)


def outer_align(frames: list[DataFrame], period: str = "period") -> DataFrame:
    """Columns of several one-row-a-period frames side by side; periods of any are kept."""
    return reduce(lambda a, b: a.join(b, on=period, how="full"), frames)


def log_growth(df: DataFrame, keys: list[str], value: str = "value", name: str = "growth_pct", period: str = "period") -> DataFrame:
    """Log growth in percent per typical period: across a gap it is divided by the periods spanned.

    Null from or to values that are not positive.
    """
    out = with_spans(df.where(F.col(value).isNotNull()), keys, period)
    before = F.lag(value).over(ordered(keys, period))
    return out.withColumn(name, F.when((F.col(value) > 0) & (before > 0), 100 * (F.ln(value) - F.ln(before)) / F.col("span")))


def with_spans(df: DataFrame, keys: list[str], period: str = "period") -> DataFrame:
    """Adds gap_days to the row before, and span, the gap in median gaps (half to even, 1 at least)."""
    gaps = df.withColumn("gap_days", F.datediff(period, F.lag(period).over(ordered(keys, period))))
    typical = F.median("gap_days").over(Window.partitionBy(*keys))
    return gaps.withColumn("span", F.when(F.col("gap_days").isNotNull(), F.greatest(F.lit(1), F.rint(safe_ratio(F.col("gap_days").cast("double"), typical)).cast("int"))))


def find_gaps(df: DataFrame, keys: list[str], period: str = "period") -> DataFrame:
    """Where more than one period separates two rows: after, before and missing_periods."""
    out = with_spans(df, keys, period).withColumn("after", F.lag(period).over(ordered(keys, period)))
    return out.where("span > 1").select(*keys, "after", F.col(period).alias("before"), (F.col("span") - 1).alias("missing_periods"))


def frequency(df: DataFrame, keys: list[str], period: str = "period") -> DataFrame:
    """Each series' frequency by its median gap in days: day, week, month, quarter or year; null below 3 rows."""
    gaps = df.withColumn("g", F.datediff(period, F.lag(period).over(ordered(keys, period))))
    days = F.median("g")
    name = F.when(days <= 1.5, "day").when(days <= 8, "week").when(days <= 35, "month").when(days <= 100, "quarter").otherwise("year")
    return gaps.groupBy(*keys).agg(F.when(F.count("*") >= 3, name).alias("frequency"), F.count("*").alias("n_obs"))


def looks_year_to_date(df: DataFrame, keys: list[str], value: str = "value", period: str = "period", reset: float = 0.3, rising: float = 0.9) -> DataFrame:
    """Per series: whether every January resets, whether it rises within years, and both together.

    Null verdicts: fewer than two Januaries after a December, or fewer than ten steps within years.
    """
    w = ordered(keys, period)
    steps = df.where(F.col(value).isNotNull()).withColumns({"pv": F.lag(value).over(w), "pp": F.lag(period).over(w)})
    january = (F.month(period) == 1) & (F.col("pp") == F.add_months(period, -1)) & (F.col("pv") != 0)
    resets = F.abs(value) / F.abs("pv") < reset
    inside = (F.month(period) != 1) & F.col("pv").isNotNull()
    ups = F.when(F.col(value) >= F.col("pv"), 1.0).otherwise(0.0)
    out = steps.groupBy(*keys).agg(
        F.when(F.count(F.when(january, 1)) >= 2, F.min(F.when(january, resets))).alias("january_resets"),
        F.when(F.count(F.when(inside, 1)) >= 10, F.avg(F.when(inside, ups)) >= rising).alias("rises_within_years"),
        F.count("*").alias("n_obs"),
    )
    return out.withColumn("year_to_date", F.coalesce((F.col("n_obs") >= 14) & F.col("january_resets") & F.col("rises_within_years"), F.lit(False)))


def lead_lag(df: DataFrame, keys: list[str], cause: str, effect: str, max_lag: int, period: str = "period") -> DataFrame:
    """Correlation of effect(t) with cause(t - lag) for every lag from -max_lag to max_lag, in one pass.

    Positive lags mean that the cause leads. Null below three pairs.
    """
    w = ordered(keys, period)
    # A lag over the series' own rows needs no self-join; each row carries its 2 * max_lag + 1 partners.
    lags = range(-max_lag, max_lag + 1)
    pairs = F.array(*(F.struct(F.lit(k).alias("lag"), (F.lag(cause, k) if k >= 0 else F.lead(cause, -k)).over(w).alias("c")) for k in lags))
    long = df.select(*keys, period, effect, pairs.alias("pairs")).select(*keys, effect, F.explode("pairs").alias("p")).select(*keys, F.col(effect).alias("e"), "p.lag", "p.c")
    both = F.col("e").isNotNull() & F.col("c").isNotNull()
    return long.groupBy(*keys, "lag").agg(F.when(F.count(F.when(both, 1)) >= 3, F.corr(F.when(both, F.col("c")), F.when(both, F.col("e")))).alias("correlation"), F.count(F.when(both, 1)).alias("n_pairs"))


def autocorrelation(df: DataFrame, keys: list[str], lag: int, value: str = "value", period: str = "period") -> DataFrame:
    """Correlation of a series with itself ``lag`` rows before; null below 2 * lag + 2 rows."""
    pairs = df.where(F.col(value).isNotNull()).withColumn("before", F.lag(value, lag).over(ordered(keys, period)))
    return pairs.groupBy(*keys).agg(F.when(F.count("*") >= 2 * lag + 2, F.corr(F.when(F.col("before").isNotNull(), F.col(value)), F.col("before"))).alias("autocorrelation"))
