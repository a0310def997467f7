"""Mixing sources to target weights by hierarchical budgeting.

The leaves of a domain-language-source tree have as much to give as their tokens times the epochs
allowed, and nothing where their source, language or domain has no weight; a family has what its
leaves have. A budget is split among siblings in proportion to their weights; whoever cannot take a
share gives the rest back to its siblings first, and only what a whole family cannot take goes to
the families beside it. Each leaf then contributes whole epochs and, of one more epoch in seeded
order, the documents of a token-prefix.

All steps are DataFrame operations: sums per leaf and hash range, windows over siblings, and one
cut-off per leaf. No window runs over the documents of a leaf, except those of the one hash range
(of 256) in which its prefix ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_few, materialize

LEVELS = ("domain", "lang", "source")
RANGE_DIGITS = 2


def token_count(text: Column) -> Column:
    """Words of a text, divided by white space; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column, seed: int, epoch: Column) -> Column:
    """The place of a document in a leaf's order of one epoch, as hexadecimal text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def share_out(nodes: DataFrame, family: list[str], node: str, capacity: str = "capacity", weight: str = "weight", budget: str = "budget") -> DataFrame:
    """Adds ``granted``: each family's budget split by weight, no node above its capacity.

    In order of capacity per weight, a node is full when the budget covers, at its own ratio, all
    that come after it. The rest is split among the others by weight.
    """
    takes = F.when(F.col(weight) > 0, F.col(capacity)).otherwise(0).cast("double")
    siblings = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    upto = siblings.orderBy("__ratio", node).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        nodes.withColumn("__takes", takes)
        .withColumn("__ratio", F.when(F.col(weight) > 0, F.col("__takes") / F.col(weight)).otherwise(F.lit(0.0)))
        .withColumn("__after", F.sum(weight).over(siblings) - F.sum(weight).over(upto))
        .withColumn("__full", F.sum("__takes").over(upto) + F.col("__ratio") * F.greatest(F.col("__after"), F.lit(0.0)) <= F.col(budget))
        .withColumn("__left", F.col(budget) - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__takes"))).over(siblings), F.lit(0.0)))
        .withColumn("__open", F.coalesce(F.sum(F.when(~F.col("__full"), F.col(weight))).over(siblings), F.lit(0.0)))
        .withColumn("granted", F.when(F.col("__full"), F.col("__takes")).otherwise(F.least(F.col("__takes"), F.col(weight) * F.col("__left") / F.nullif(F.col("__open"), F.lit(0.0)))))
        .withColumn("granted", F.coalesce(F.col("granted"), F.lit(0.0)))
        .drop("__takes", "__ratio", "__after", "__full", "__left", "__open")
    )


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], share: float, max_epochs: float) -> DataFrame:
    """Tokens granted to each leaf: (domain, lang, source, tokens) in, the same with ``granted`` out.

    ``share`` is the budget as a part of all tokens. ``weights`` has, by level, the weight of a name;
    names without one count 1 if the level has no weights at all, else 0.
    """
    weigh = lambda level: _lookup(weights.get(level) or {}, F.col(level))
    # What a leaf can take: nothing without a weight, be it its source's or its language's.
    able = (weigh("source") > 0) & (weigh("lang") > 0) & (weigh("domain") > 0)
    leaves = leaves.withColumn("capacity", F.when(able, F.col("tokens") * max_epochs).otherwise(F.lit(0)))
    domains = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("t"))
    domains = domains.withColumn("budget", F.sum("t").over(Window.partitionBy(F.lit(0))) * share).withColumn("weight", weigh("domain"))
    domains = share_out(domains, [], "domain").select(F.col("domain").alias("d1"), F.col("granted").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("weight", weigh("lang"))
    langs = langs.join(domains, F.col("domain").eqNullSafe(F.col("d1"))).drop("d1")
    langs = share_out(langs, ["domain"], "lang").select(F.col("domain").alias("d2"), F.col("lang").alias("l2"), F.col("granted").alias("budget"))
    sources = leaves.withColumn("weight", weigh("source"))
    sources = sources.join(langs, F.col("domain").eqNullSafe(F.col("d2")) & F.col("lang").eqNullSafe(F.col("l2"))).drop("d2", "l2")
    return share_out(sources, ["domain", "lang"], "source").select(*LEVELS, "tokens", "granted")


def _lookup(weights: dict[str, float], name: Column) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for k, w in sorted(weights.items()) for x in (k, float(w))])
    return F.coalesce(F.try_element_at(table, name), F.lit(0.0))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], share: float = 0.6, max_epochs: int = 4, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tokens: Column | None = None) -> DataFrame:
    """The documents with ``__epochs``, the number of times each is taken (0 for those left out).

    ``domain`` is computed from the documents' columns. Null languages and sources are leaves named
    "none". Documents without tokens cost nothing: they go with their leaf's whole epochs, and with
    the prefix where their place in the order is before its end. Rows that repeat an id share its
    place. A document that straddles the end of the prefix is taken whole. A null text has no tokens, a
    very long one is counted whole. ``tokens`` is a column that counts them, if the documents have one;
    else texts are counted once, and ids, leaves and counts are written to the shared folder.
    """
    leaf = [F.coalesce(domain, F.lit("none")).alias("domain"), F.coalesce(F.col(lang_col).cast("string"), F.lit("none")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("none")).alias("source")]
    narrow = docs.select(*leaf, F.col(id_col).alias("i"), (token_count(F.col(text_col)) if tokens is None else tokens).alias("n"))
    narrow = materialize(narrow) if tokens is None else narrow
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    granted = budgets(leaves, weights, share, max_epochs).select(
        *LEVELS,
        F.when(F.col("tokens") > 0, F.floor(F.col("granted") / F.col("tokens"))).otherwise(F.lit(max_epochs)).cast("int").alias("whole"),
        F.col("granted").alias("granted"),
        "tokens",
    )
    granted = granted.withColumn("quota", F.when(F.col("tokens") > 0, F.col("granted") - F.col("whole") * F.col("tokens")).otherwise(F.lit(0.0)))
    granted = broadcast_if_few(granted.select(*LEVELS, "whole", "quota"))
    keyed = narrow.join(granted, list(LEVELS)).withColumn("k", order_key(F.col("i"), seed, F.col("whole")))
    ranges = keyed.withColumn("r", F.substring("k", 1, RANGE_DIGITS)).groupBy(*LEVELS, "quota", "r").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(*LEVELS).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # The last range that starts before the quota is the one in which the prefix ends.
    last = broadcast_if_few(ranges.where("before < quota").groupBy(*LEVELS).agg(F.max(F.struct("r", "before")).alias("e")).select(*LEVELS, F.col("e.r").alias("r"), F.col("e.before").alias("before")))
    ending = keyed.withColumn("r", F.substring("k", 1, RANGE_DIGITS)).join(last, [*LEVELS, "r"])
    running = Window.partitionBy(*LEVELS).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    cuts = ending.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(running), F.lit(0))).where("start < quota").groupBy(*LEVELS).agg(F.max("k").alias("cut"))
    # A quota below every start of its range cannot be: the range's first document starts at ``before``.
    plan = broadcast_if_few(granted.join(cuts, list(LEVELS), "left").select(*(F.col(c).alias(f"__{c}") for c in LEVELS), F.col("whole").alias("__whole"), F.col("cut").alias("__cut")))
    marked = docs.select("*", *(c.alias(f"__leaf{i}") for i, c in enumerate(_unnamed(leaf, domain, lang_col, source_col))))
    joined = marked.join(plan, [F.col(f"__leaf{i}") == F.col(f"__{c}") for i, c in enumerate(LEVELS)])
    in_prefix = F.coalesce(order_key(F.col(id_col), seed, F.col("__whole")) <= F.col("__cut"), F.lit(False))
    return joined.withColumn("__epochs", F.col("__whole") + in_prefix.cast("int")).drop(*(f"__leaf{i}" for i in range(3)), *(f"__{c}" for c in LEVELS), "__whole", "__cut")


def _unnamed(leaf, domain, lang_col, source_col):
    return [F.coalesce(domain, F.lit("none")), F.coalesce(F.col(lang_col).cast("string"), F.lit("none")), F.coalesce(F.col(source_col).cast("string"), F.lit("none"))]
