"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import discard, materialize, shared_folder

__all__ = ["BoundedCache", "bounded_sample", "broadcast_if_few", "discard", "held_out", "materialize", "seeded", "shared_folder", "short_batches", "table"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for the rows of the held-out fold: crc32 of the id's text, modulo; null ids count as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


def seeded(doc_id: Column, seed: int) -> Column:
    """A 64-bit hash that orders rows at random but the same way on every run."""
    return F.xxhash64(F.lit(seed), doc_id)


class BoundedCache(dict):
    """A dict of strings that computes missing values and starts anew once it holds ``limit`` of them, or
    keys of ``most_chars`` characters in all; values are taken to be as long as their keys at most."""

    def __init__(self, make: Callable, limit: int, most_chars: int = 1 << 24):
        super().__init__()
        self.make, self.limit, self.most_chars, self.chars = make, limit, most_chars, 0

    def __missing__(self, key):
        self.chars += len(key)
        if len(self) >= self.limit or self.chars > self.most_chars:
            self.clear()
            self.chars = len(key)
        value = self[key] = self.make(key)
        return value


def bounded_sample(df: DataFrame, id_col: str, rows: int, seed: int, most_chars: int, text_col: str = "text") -> DataFrame:
    """At most ``rows`` rows of ``df``, those whose ids hash lowest, with texts of at most ``most_chars``.

    The ids are chosen first, from their column alone, so no text passes through the sort; the
    chosen ids, at most ``rows`` longs, are then broadcast. Of rows that repeat an id the least text is
    taken, so the bound holds for rows too.
    """
    key = "__sample_id"
    ids = df.select(F.col(id_col).alias(key)).where(F.col(key).isNotNull()).distinct().orderBy(seeded(F.col(key), seed), key).limit(rows)
    chosen = df.where(F.length(text_col) <= most_chars).join(F.broadcast(ids), F.col(id_col) == F.col(key), "left_semi")
    return chosen.groupBy(id_col).agg(F.min(text_col).alias(text_col))


#: Up to so many rows of a few numbers or digests each are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def broadcast_if_few(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table of short rows, written once and counted, with a broadcast hint if it has at most ``most``."""
    rows = materialize(rows)
    return F.broadcast(rows) if rows.count() <= most else rows


#: Rows a Python worker gets at a time. Texts may be long, so fewer than Spark's usual 10,000.
BATCH_ROWS = 512


def short_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of this session to BATCH_ROWS, so that workers hold little at a time.

    Called by every operator that sends texts to workers; a smaller setting of the caller's stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
