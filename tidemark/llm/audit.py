"""Filter interaction audit: an incidence matrix product over the masks of failed filters.

Every document gets a mask, one bit for each filter that it fails. The counts of masks by part, of all
documents, of good ones and of toxic ones, are stacked as the rows of a matrix of as many columns as there are
masks (32 of five filters). What happens to a mask at a step of an order of filters is fixed, so one integer
matrix of masks by (order, step) pairs (32 by 600) stands for each outcome: kept, removed, redundant, unique.
The products of histograms and matrices are the numbers of all orders at once; no document is read again.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_few, materialize

#: Names of the filters, in the order of the mask's bits.
FILTERS = "ABCDE"
#: Parts whose products are held at a time; each has a row for every order and step.
PARTS = 64
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@lru_cache
def outcomes(filters: str = FILTERS) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The (order, step) pairs, and the matrices of masks by pairs.

    kept: no filter up to the step fails the mask; removed: the step's filter is the first that does;
    redundant: it fails, as an earlier one did; unique: it alone fails; shapley: removed, summed over the
    pairs with the same filter.
    """
    pairs = [("".join(order), step) for order in permutations(filters) for step in range(1, len(filters) + 1)]
    bits = {f: 1 << i for i, f in enumerate(filters)}
    here = np.array([bits[order[step - 1]] for order, step in pairs])
    before = np.array([sum(bits[f] for f in order[: step - 1]) for order, step in pairs])
    mask = np.arange(1 << len(filters))[:, None]
    fails, gone = mask & here > 0, mask & before > 0
    removed = (fails & ~gone).astype(np.int64)
    by_filter = (here[:, None] == here[None, :]).astype(np.int64)
    return pairs, {"kept": (~fails & ~gone).astype(np.int64), "removed": removed, "redundant": (fails & gone).astype(np.int64), "unique": (mask == here).astype(np.int64), "shapley": removed @ by_filter}


def failures(text: Column) -> list[Column]:
    """Whether a text, a null one taken as empty, fails A to D: under 200 words, words repeated too much, too many capitals, symbols."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return [
        F.size(words) < 200,
        F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * F.size(words),
        F.lit(100) * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > F.lit(2) * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """__id, __part and __mask of every row.

    Texts are read once, for their digests and the filters that look at a text alone; from there on only these
    few bytes a row are written, shuffled and joined. The last filter, E, fails a row if a smaller id has the
    same text: the smallest id of every digest that comes twice comes from partial aggregates and is joined
    back, so the rows of one text need not meet in one task. A row without an id does not fail it, and rows
    that repeat the smallest id do not fail it either. Null parts count as empty; null, empty and very long
    texts are judged like others; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures(F.col(text_col)))), F.lit(0))
    facts = materialize(docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("__part"), F.unhex(F.sha2(text, 256)).alias("__digest"), mask.alias("__alone")))
    first = facts.groupBy(F.col("__digest").alias("__same")).agg(F.count("*").alias("__rows"), F.min("__id").alias("__first")).where("__rows > 1").drop("__rows")
    first = broadcast_if_few(first)  # a written table, so that beyond it both sides meet as bare exchanges, which can be split
    later = F.coalesce(F.col("__id") > F.col("__first"), F.lit(False))
    return facts.join(first, F.col("__digest") == F.col("__same"), "left").select("__id", "__part", (F.col("__alone") + F.when(later, 16).otherwise(0)).alias("__mask"))


def histograms(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """__part, __mask, n, good and toxic: rows, those labelled good and those labelled toxic.

    An id is good, or toxic, if any of its label rows says 1; ids without labels are neither.
    """
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__label_id")).agg(*(F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(name) for c, name in ((good_col, "__good"), (toxic_col, "__toxic"))))
    joined = masked.join(said, F.col("__id") == F.col("__label_id"), "left")
    return joined.groupBy("__part", "__mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("__good"), F.lit(0)).alias("good"), F.coalesce(F.sum("__toxic"), F.lit(0)).alias("toxic"))


def products(parts: list[str], stacked: np.ndarray, filters: str = FILTERS) -> pa.RecordBatch:
    """The numbers of every part, order and step; ``stacked`` has the histograms, (3, parts, masks)."""
    pairs, m = outcomes(filters)
    rows, good, toxic = stacked
    counts = (rows @ m["kept"], rows @ m["removed"], rows @ m["redundant"], rows @ m["unique"], good @ m["removed"], toxic @ m["removed"], rows @ m["shapley"])
    names = [pa.array(np.repeat(np.array(parts, dtype=object), len(pairs)), pa.string()), pa.array([p for p, _ in pairs] * len(parts), pa.string()), pa.array([s for _, s in pairs] * len(parts), pa.int32())]
    return pa.RecordBatch.from_arrays([*names, *(pa.array(c.ravel(), pa.int64()) for c in counts)], ["part", "filter_order", "step", *COUNTS])


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for every part, order of the filters and step, from the histograms of `histograms`.

    A part's histograms are at most as many rows as there are masks; parts are spread over tasks and
    multiplied in blocks of PARTS.
    """
    wide = counted.groupBy("__part").agg(F.collect_list(F.struct("__mask", "n", "good", "toxic")).alias("__cells"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                some = batch.slice(at, PARTS)
                stacked = np.zeros((3, some.num_rows, 1 << len(filters)), np.int64)
                for i, cells in enumerate(some.column(1).to_pylist()):
                    for c in cells:
                        stacked[:, i, c["__mask"]] += c["n"], c["good"], c["toxic"]
                yield products(some.column(0).to_pylist(), stacked, filters)

    return wide.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """How the five filters interact, by part: every order of them, step by step. An empty table gives no rows."""
    return interactions(histograms(masks(docs, id_col, text_col, part_col), labels, id_col))
