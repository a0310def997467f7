"""Structured Streaming over the external zone: the commit log is the stream, and each new entry maintains a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.zone import ENTRY, Zone


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """New entries of the commit log as they come: (source_id, number, kind) and the manifest of the version that is
    current from then on, null for a source removed. An entry is written last, so its source is complete."""
    entries = spark.readStream.schema(ENTRY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{root.rstrip('/')}/log")
    return entries.select("source_id", "number", "kind", "current")


def maintain(spark: SparkSession, root: str, target: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``target`` partitioned by source with the observations of every landed source.

    A batch overwrites the partitions of its own sources only, with what is current when it runs, and deletes those
    of sources removed; so a batch that runs again after a failure leaves the same table.
    """

    def update(batch: DataFrame, _: int) -> None:
        zone = Zone(spark, root)
        touched = batch.select("source_id").distinct()
        landed = zone.read("observations").join(touched, "source_id", "left_semi")
        landed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(target)
        # Those without rows have no partition to overwrite; what a batch removes is as little as what it was given.
        for r in touched.join(landed.select("source_id").distinct(), "source_id", "left_anti").toLocalIterator():
            zone.files.delete(f"{target.rstrip('/')}/source_id={r.source_id}")

    return manifests(spark, root).writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, ts: str, by: list[str], size: str = "1 hour", late: str = "2 hours", value: str = "value") -> DataFrame:
    """Counts and sums by tumbling window with a watermark; an extension for live feeds, on batch or stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")
