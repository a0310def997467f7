"""Outliers against a trailing window, for all series of a table at once, by window functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import ordered, safe_ratio, with_spans

#: A previous value below this share of the median magnitude makes a flow's percent change meaningless.
ZERO_GUARD = 0.05


def scored(df: DataFrame, keys: list[str], on: str = "change", value: str = "value", period: str = "period", semantics: str | None = None) -> DataFrame:
    """Adds ``scored``: the level, the difference or the percent change per typical period.

    ``on`` auto takes the difference for rates and ratios and else the change. Rows without a score are
    left out; for flows these include changes from values near 0.
    """
    if on == "auto":
        on = "diff" if semantics in ("rate", "ratio") else "change"
    known = df.where(F.col(value).isNotNull())
    if on == "level":
        return known.withColumn("scored", F.col(value).cast("double"))
    out = with_spans(known, keys, period)
    before = F.lag(value).over(ordered(keys, period))
    raw = F.col(value) - before if on == "diff" else 100 * (safe_ratio(F.col(value), before) - 1)
    if on != "diff" and semantics == "flow":
        typical = F.median(F.abs(value)).over(Window.partitionBy(*keys))
        raw = F.when(F.abs(before) >= ZERO_GUARD * typical, raw)
    return out.withColumn("scored", raw / F.col("span")).where(F.col("scored").isNotNull())


def score(df: DataFrame, keys: list[str], on: str = "change", window: int = 12, z_threshold: float = 3.0, iqr_multiplier: float = 1.5, value: str = "value", period: str = "period", semantics: str | None = None) -> DataFrame:
    """Adds roll_mean, roll_std, z_score, the fences and is_outlier to `scored` rows.

    The baseline is the ``window`` rows before, never the row itself; rows without a full one have nulls.
    An outlier is beyond both the z-score and the interquartile fence.
    """
    if window < 3:
        raise ValueError("window must be 3 or more")
    before = ordered(keys, period).rowsBetween(-window, -1)
    full = lambda c: F.when(F.count("scored").over(before) >= window, c)
    out = scored(df, keys, on, value, period, semantics).withColumns(
        {"roll_mean": full(F.avg("scored").over(before)), "roll_std": full(F.stddev_pop("scored").over(before)), "q1": full(F.percentile("scored", 0.25).over(before)), "q3": full(F.percentile("scored", 0.75).over(before))}
    )
    out = out.withColumns(
        {"z_score": safe_ratio(F.col("scored") - F.col("roll_mean"), F.col("roll_std")), "lower_fence": F.col("q1") - iqr_multiplier * (F.col("q3") - F.col("q1")), "upper_fence": F.col("q3") + iqr_multiplier * (F.col("q3") - F.col("q1"))}
    )
    flag = (F.abs("z_score") >= z_threshold) & ((F.col("scored") < F.col("lower_fence")) | (F.col("scored") > F.col("upper_fence")))
    return out.withColumn("is_outlier", F.coalesce(flag, F.lit(False))).drop("q1", "q3")


def classify(scores: DataFrame, keys: list[str], lookahead: int = 3, period: str = "period") -> DataFrame:
    """The outliers with ``kind``: regime_start if at least half of the next ``lookahead`` rows stay beyond
    the same fence, spike if not, undetermined if no row follows; and ``direction``."""
    after = ordered(keys, period).rowsBetween(1, lookahead)
    following = F.collect_list("scored").over(after)
    above = F.col("scored") > F.col("roll_mean")
    out = scores.withColumn("__next", following).where("is_outlier").withColumn("direction", F.when(above, "above").otherwise("below"))
    still = F.when(above, F.size(F.filter("__next", lambda x: x > F.col("upper_fence")))).otherwise(F.size(F.filter("__next", lambda x: x < F.col("lower_fence"))))
    kind = F.when(F.size("__next") == 0, "undetermined").when(2 * still >= F.size("__next"), "regime_start").otherwise("spike")
    return out.withColumn("kind", kind).drop("__next")
