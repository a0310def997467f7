"""Access to curated series: slices that must mean one series, and the rows and columns that may be shown.

A slice is a conjunction of equalities, which reaches the Parquet scan. One aggregate over it tells
whether periods repeat, and if so by which columns, so an ambiguous request is refused and never summed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import LETTERS, PLAIN, fold, let, slug
from tidemark.operators import analytics
from tidemark.plans.artifact import Refused


QUESTION_FOLD = str.maketrans(LETTERS, PLAIN)


@dataclass(frozen=True)
class Curated:
    """A table of facts: the columns that name a series, its period and, by semantics, its value columns."""

    facts: DataFrame
    names: tuple[str, ...]
    values: dict[str, str]
    period: str = "period"
    retired: str | None = None


def choose_value(semantics: Column, values: dict[str, str]) -> Column:
    """The value column that a row's temporal semantics call for; null for semantics without one."""
    out = F.lit(None).cast("double")
    for kind, column in values.items():
        out = F.when(semantics == kind, F.col(column)).otherwise(out)
    return out


def load_slice(source: Curated, semantics: str, wanted: dict[str, str]) -> DataFrame:
    """(period, value) of the one series that ``wanted`` names.

    Refuses columns and semantics the source does not have, values nobody has, series that are only
    retired, and slices with several rows a period; the message says which columns would tell them apart.
    """
    if unknown := sorted(set(wanted) - set(source.names)):
        raise Refused(f"no columns {unknown}; there are {list(source.names)}")
    if semantics not in source.values:
        raise Refused(f"no values of kind {semantics!r}; there are {sorted(source.values)}")
    rows = source.facts
    for column, value in wanted.items():
        rows = rows.where(F.col(column) == value)
    live = F.col(source.retired).isNull() if source.retired else F.lit(True)
    free = [c for c in source.names if c not in wanted]
    found = rows.agg(F.count("*").alias("n"), F.count_if(live).alias("live"), F.countDistinct(F.when(live, F.col(source.period))).alias("periods"), *(F.countDistinct(F.when(live, F.col(c))).alias(f"d_{c}") for c in free)).first()
    if not found.n:
        raise Refused(f"nothing has {wanted}")
    if not found.live:
        raise Refused(f"{wanted} is retired")
    if found.periods < found.live:
        raise Refused(f"{wanted} is not one series: also name {[c for c in free if found[f'd_{c}'] > 1] or 'nothing, for its rows repeat'}")
    return rows.where(live).select(F.col(source.period).alias("period"), F.col(source.values[semantics]).cast("double").alias("value"))


def active(rows: DataFrame, retired: str = "retired_on") -> DataFrame:
    """Rows of series still published."""
    return rows.where(F.col(retired).isNull())


def without_informational(rows: DataFrame, flag: str = "is_informational") -> DataFrame:
    """Rows that count towards totals; a missing flag counts as false."""
    return rows.where(~F.coalesce(F.col(flag), F.lit(False)))


def region_slice(rows: DataFrame, region: str, column: str) -> DataFrame:
    """Rows of a region, however its name is cased and accented."""
    return rows.where(slug(F.col(column)) == slug(F.lit(region)))


def national_sum(rows: DataFrame, keys: list[str], region: str, abroad: list[str], value: str = "value") -> DataFrame:
    """The sum over regions, without those that lie abroad; rows without a region count."""
    inside = ~F.coalesce(slug(F.col(region)).isin([]) if not abroad else slug(F.col(region)).isin(*(slug(F.lit(a)) for a in abroad)), F.lit(False))
    return rows.where(inside).groupBy(*keys).agg(F.sum(value).alias(value), F.countDistinct(region).alias("n_regions"))


def derived_share(rows: DataFrame, keys: list[str], part: str, whole: str, name: str = "series", value: str = "value") -> DataFrame:
    """100 times one series over another for each suffix they share: ``part`` and ``whole`` are what the
    names begin with. One pass; no join, since both sides meet in the group of their keys and suffix."""
    of = F.when(F.startswith(F.col(name), F.lit(part)), part).when(F.startswith(F.col(name), F.lit(whole)), whole)
    sides = rows.select(*keys, of.alias("__of"), F.substr(F.col(name), F.length(of) + 1).alias("suffix"), value).where(F.col("__of").isNotNull())
    both = sides.groupBy(*keys, "suffix").agg(*(F.sum(F.when(F.col("__of") == p, F.col(value))).alias(n) for p, n in ((part, "part"), (whole, "whole"))))
    return both.where("part IS NOT NULL AND whole IS NOT NULL").select(*keys, "suffix", (100 * F.try_divide("part", "whole")).alias("share_pct"))


def expand_templates(catalogue: DataFrame, templates: DataFrame, region: str) -> DataFrame:
    """Derived series of a catalogue: every template (template_key, pattern with %s) for every region."""
    names = catalogue.select(region).where(F.col(region).isNotNull()).distinct()
    given = templates.agg(F.collect_list(F.struct("template_key", "pattern")).alias("__templates"))  # one row
    pairs = names.crossJoin(given).withColumn("t", F.explode("__templates"))
    return pairs.select(F.concat_ws("_", "t.template_key", slug(F.col(region))).alias("series_key"), F.replace(F.col("t.pattern"), F.lit("%s"), F.col(region)).alias("series_name"))


def top_anomalies(scores: DataFrame, n: int = 6, z: str = "z_score", order: list[str] | None = None) -> DataFrame:
    """The n rows furthest from normal, by the size of z; ties in the given order."""
    return scores.where(F.col(z).isNotNull()).orderBy(F.desc(F.abs(z)), *(order or [])).limit(n)


def search_text(parts: list[Column]) -> Column:
    """The words of several texts, each once in its first spelling, compared without case and accents.

    Words are folded once and sorted by what they fold to, so neighbours tell the first of each.
    """
    words = F.filter(F.split(F.concat_ws(" ", *parts), r"\s+"), lambda w: w != "")
    keyed = F.array_sort(F.transform(words, lambda w, i: F.struct(fold(w).alias("k"), i.alias("i"), w.alias("w"))))
    firsts = let(keyed, lambda k: F.filter(k, lambda x, i: (i == 0) | (x["k"] != F.get(k, i - 1)["k"])))
    return F.array_join(F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w")))), lambda x: x["w"]), " ")


def quarter_starts(first: Column, last: Column) -> Column:
    """First days of all quarters from the one of ``first`` to that of ``last``; null if it would be none."""
    a, b = F.trunc(first, "quarter"), F.trunc(last, "quarter")
    return F.when(a <= b, F.sequence(a, b, F.expr("INTERVAL 3 MONTHS")))


def request_slices(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Requests of at most a calendar year each that cover every span: keys, slice_start and slice_end."""
    years = spans.select(*keys, start, end, F.explode(F.sequence(F.year(start), F.year(end))).alias("y"))
    return years.select(*keys, F.greatest(F.col(start), F.make_date("y", F.lit(1), F.lit(1))).alias("slice_start"), F.least(F.col(end), F.make_date("y", F.lit(12), F.lit(31))).alias("slice_end"))


def request_batches(series: DataFrame, keys: list[str], code: str, size: int = 150) -> DataFrame:
    """The codes of each key in batches of at most ``size``, in order of code: keys, batch (from 1) and codes."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(code))
    rows = series.select(*keys, code).distinct().withColumn("batch", F.ceil(place / size).cast("int"))
    return rows.groupBy(*keys, "batch").agg(F.array_join(F.array_sort(F.collect_list(F.col(code).cast("string"))), ",").alias("codes"), F.count("*").alias("n_codes"))


#: Column words that published files have in one of two languages.
TRANSLATED = {"toplam": "total", "total": "toplam", "hacim": "volume", "volume": "hacim", "miktar": "amount", "amount": "miktar", "sayisi": "number", "adet": "number"}


def rank_landed(rows: DataFrame, question: str, texts: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """Landed series by how many words of a question, or their translations, their texts hold: adds score; rows
    that tie keep ``order``. Words of one or two letters say nothing."""
    words = {w for w in re.split(r"[^a-z0-9]+", question.translate(QUESTION_FOLD).lower()) if len(w) > 2}
    words |= {TRANSLATED[w] for w in words if w in TRANSLATED}
    text = fold(F.concat_ws(" ", *texts))
    score = let(text, lambda t: sum((F.contains(t, F.lit(w)).cast("int") for w in sorted(words)), F.lit(0)))
    found = rows.withColumn("score", score).orderBy(F.desc("score"), *order)
    return found.limit(limit) if limit else found


def ratio_table(families: dict[str, tuple[DataFrame, dict[str, tuple[str, str]]]], keys: list[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """Ratios of several sources in one long table: source, keys, ratio and value. Each source is pivoted once by
    the metrics its ratios name; ratios that cannot be taken are left out."""
    parts = []
    for source, (rows, pairs) in families.items():
        wide = analytics.pivot_metrics(rows, keys, sorted({m for p in pairs.values() for m in p}), metric, value)
        both = F.explode(F.array(*(F.struct(F.lit(n).alias("ratio"), (100 * F.try_divide(F.col(a), F.col(b))).alias("value")) for n, (a, b) in pairs.items())))
        parts.append(wide.select(F.lit(source).alias("source"), *keys, both.alias("r")).select("source", *keys, "r.ratio", "r.value").where("value IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts)


def facts_with_index(facts: DataFrame, index: DataFrame, on: tuple[str, ...] = ("dataset", "entity_key"), live: bool = True) -> DataFrame:
    """Facts beside the index rows of their entities, by both keys; retired entities are left out if ``live``.
    The index is a dimension: the planner broadcasts it where its size allows."""
    rows = index.where(F.col("retired_on").isNull()).drop("retired_on") if live and "retired_on" in index.columns else index
    return facts.join(rows, list(on))


#: Days and months as digits, which state when and not how much: year first or day first.
STAMPS = r"(?<![\w.,-])(?:[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![\w-]|[.,][0-9])"


def numbers_in_prose(text: Column) -> Column:
    """The numbers a sentence states, as doubles, however they are written.

    Of two separators the last marks the decimals, if it comes once. A single comma does so too; a single point does
    unless three digits follow each point and one to three lead, as in thousands. Other digits with several
    separators state no number, nor do dates. A minus counts where it follows no word or digit.
    """
    found = F.regexp_extract_all(F.regexp_replace(text, STAMPS, " "), F.lit(r"(?<![\w.,])(?:(?<![\w)])-)?[0-9]+(?:[.,][0-9]+)*"), F.lit(0))

    def read(token: Column) -> Column:
        points, commas = F.size(F.split(token, r"\.")) - 1, F.size(F.split(token, ",")) - 1
        point_last = F.locate(".", F.reverse(token)) < F.locate(",", F.reverse(token))
        without = lambda mark: F.replace(token, F.lit(mark), F.lit(""))
        comma_decimal = F.replace(without("."), F.lit(","), F.lit("."))
        grouped = lambda mark: token.rlike(f"^-?[0-9]{{1,3}}([{mark}][0-9]{{3}})+$")
        both = F.when(point_last & (points == 1), without(",")).when(~point_last & (commas == 1), comma_decimal)
        one = F.when(commas == 1, comma_decimal).when(commas > 1, F.when(grouped(","), without(","))).when(grouped("."), without(".")).when(points <= 1, token)
        return F.when((points > 0) & (commas > 0), both).otherwise(one).try_cast("double")

    return F.filter(F.transform(found, read), lambda x: x.isNotNull())


def is_claim(number: Column) -> Column:
    """False for whole numbers that give structure and claim nothing: counts below 100, years, and months as YYYYMM."""
    whole = number == F.floor(number)
    month = number.between(190001, 210012) & (number % 100).between(1, 12)
    return ~(whole & ((F.abs(number) < 100) | number.between(1900, 2100) | month))


def unsupported_numbers(claims: DataFrame, facts: DataFrame, key: str, text: str, value: str, tolerance: float = 0.02, least: float = 0.05) -> DataFrame:
    """Numbers claimed in a text that none of its facts bears out: an equi-join by key and one aggregate, so a claim
    meets its own facts only.

    Sizes are compared, since the words around a number carry its sign, to a part of the fact or to ``least``.
    """
    stated = claims.select(key, F.explode(F.array_distinct(numbers_in_prose(F.col(text)))).alias("number")).where(is_claim(F.col("number")))
    near = F.abs(F.abs("number") - F.abs(F.col(value))) <= F.greatest(tolerance * F.abs(F.col(value)), F.lit(least))
    rated = stated.join(facts.select(key, value), key, "left").groupBy(key, "number").agg(F.bool_or(F.coalesce(near, F.lit(False))).alias("borne_out"))
    return rated.where(~F.col("borne_out")).select(key, "number")
