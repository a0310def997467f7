"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Paths that each application has written and not yet deleted.
_MADE: dict[str, set[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, without a slash at its end.

    Where it is unset a local session gets a temporary folder of its own; a cluster has no folder that
    could stand in, since what its executors write to their own disks nobody else can read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
        folder = _OWN[app]
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, which cuts the lineage.

    Unlike a cached or locally checkpointed frame this survives lost executors, and later
    readers still prune columns. `discard` removes it once nothing reads it any more, and `clear` all that
    a session has written: call it when the results of its queries are out.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _MADE.setdefault(spark.sparkContext.applicationId, set()).add(path)
    out = spark.read.schema(schema).parquet(path)
    out._materialized_at = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes the files of materialized frames. Plans that still read them fail afterwards."""
    for df in frames:
        path = getattr(df, "_materialized_at", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _MADE.get(spark.sparkContext.applicationId, set()).discard(path)


def clear(spark: SparkSession) -> int:
    """Deletes every intermediate table that this session has written; how many. Frames that read them fail afterwards."""
    paths = list(_MADE.get(spark.sparkContext.applicationId, ()))
    for path in paths:
        _delete(spark, path)
    return len(paths)
