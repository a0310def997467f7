"""The external zone: landed sources as Parquet folders, visible once an entry of the commit log names them.

A landing writes each table of its source below a token of its own and then commits: the log's next entry
for that source, created only if absent, says which token is current (see `commits`). Readers take the newest
entry of a source and join on its token, so a half-landed source is never seen, one that is landed again is
seen as it was until the new version is whole, and two writers cannot mix. Views are built inside each query,
because a DataFrame keeps the file listing it was made with.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.commits import CommitLog, Fenced, Files, Landing, Late, fence

__all__ = ["DATA", "EvidenceLog", "Fenced", "Late", "SCHEMAS", "Zone", "schema_card", "verify"]

SCHEMAS = {
    "series": "source_id STRING, series_key STRING, name STRING, unit STRING, temporal_semantics STRING, monthly_rule STRING, grain STRING",
    "observations": "source_id STRING, series_key STRING, period DATE, value DOUBLE",
    "observations_native": "source_id STRING, series_key STRING, date DATE, value DOUBLE, grain STRING",
    "quality": "source_id STRING, check_name STRING, passed BOOLEAN, detail STRING",
    "manifest": "source_id STRING, url STRING, content_sha256 STRING, fetched_at STRING, n_series BIGINT, n_observations BIGINT, version STRING",
}
#: An entry of the commit log; its current version is a manifest.
ENTRY = f"number BIGINT, source_id STRING, kind STRING, current STRUCT<{SCHEMAS['manifest'].replace(' STRING', ': STRING').replace(' BIGINT', ': BIGINT')}>"

DATA = ("series", "observations", "observations_native", "quality")


class Zone:
    """The zone at one folder of any file system Spark can write.

    ``retain`` is for how many seconds a replaced version stays for readers that have begun, ``lease`` after how
    many a landing without a commit may be swept.
    """

    def __init__(self, spark: SparkSession, root: str, retain: float = 3600.0, lease: float = 86400.0):
        self.spark, self.root, self.retain, self.lease = spark, root.rstrip("/"), retain, lease
        self.files, self.log = Files(spark), CommitLog(spark, f"{self.root}/log")

    def _stage(self, name: str, source_id: str, token: str, frame: DataFrame) -> None:
        """Writes a table of a landing; nothing reads it before the commit."""
        frame.withColumn("version", F.lit(token)).write.parquet(f"{self.root}/{name}/{source_id}/{token}")

    def write(self, source_id: str, url: str, content_sha256: str, frames: dict[str, DataFrame], fetched_at: str | None = None) -> str:
        """Lands a source: its tables, cast to their schemas, then the commit. Missing columns are null, others
        dropped. Returns the version. If it fails, the version landed before stays.

        Where another writer has landed the source meanwhile, the content that was fetched later stays: this raises
        `Late` if that is the other's. A landing that took longer than the lease and was swept raises `Fenced`.
        """
        landing, counts = Landing(self.log, source_id), {}
        fetched_at = fetched_at or time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime()) + f".{time.time_ns() % 10**9:09d}"
        for name in DATA:
            shaped = self.shaped(name, frames[name].withColumn("source_id", F.lit(source_id))) if name in frames else self.spark.createDataFrame([], SCHEMAS[name])
            self._stage(name, source_id, landing.token, shaped)
            counts[name] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/{source_id}/{landing.token}").count()
        current = {"source_id": source_id, "url": url, "content_sha256": content_sha256, "fetched_at": fetched_at, "n_series": counts["series"], "n_observations": counts["observations"], "version": landing.token}
        try:
            entry = landing.commit(current, retain=self.retain, newer=lambda theirs, ours: theirs["fetched_at"] > ours["fetched_at"])
        except (Late, Fenced):
            self._forget(source_id, [landing.token])
            raise
        self._forget(source_id, entry["expired"])
        return landing.token

    def _forget(self, source_id: str, tokens: list[str]) -> None:
        for name in DATA:
            for token in tokens:
                self.files.delete(f"{self.root}/{name}/{source_id}/{token}")

    def versions(self, name: str, source_id: str) -> list[str]:
        """The versions of a source whose files of a table are there, whatever their state."""
        return self.files.names(f"{self.root}/{name}/{source_id}")

    def sweep(self) -> list[str]:
        """Deletes what no reader and no writer can need: retired versions past ``retain``, and landings that began longer
        than ``lease`` ago and have not committed, which are fenced first. Landings under way stay. Returns what went."""
        gone = []
        for source_id in self.files.names(f"{self.root}/log") or []:
            entry = self.log.latest(source_id)
            if any(r["at"] <= time.time() - self.retain for r in entry["retired"]):
                kept = [r for r in entry["retired"] if r["at"] > time.time() - self.retain]
                if self.log.append(source_id, entry | {"number": entry["number"] + 1, "kind": "sweep", "retired": kept}):
                    expired = [r["token"] for r in entry["retired"] if r not in kept]
                    self._forget(source_id, expired)
                    gone += expired
        for source_id in sorted({s for name in DATA for s in self.files.names(f"{self.root}/{name}")}):
            entry = self.log.latest(source_id)
            used = {r["token"] for r in entry["retired"]} | ({entry["current"]["version"]} if entry["current"] else set())
            old = {t for name in DATA for t in self.versions(name, source_id) if t not in used and int(t.split("-")[0]) <= time.time_ns() - self.lease * 1e9}
            if old:
                dead = fence(self.log, source_id, sorted(old))
                self._forget(source_id, dead)
                gone += dead
        return gone

    def shaped(self, name: str, frame: DataFrame) -> DataFrame:
        """The frame with a table's columns and types; what cannot be cast is null."""
        fields = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return frame.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))

    def read(self, name: str) -> DataFrame:
        """A table of the newest version of every landed source, as of now; a removed source has no rows."""
        if name == "manifest":
            if not self.files.names(f"{self.root}/log"):
                return self.spark.createDataFrame([], SCHEMAS[name])
            entries = self.spark.read.schema(ENTRY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("ignoreMissingFiles", True).json(f"{self.root}/log")
            return entries.groupBy("source_id").agg(F.max_by("current", "number").alias("m")).where("m IS NOT NULL").select("m.*")
        if not self.files.names(f"{self.root}/{name}"):
            return self.spark.createDataFrame([], SCHEMAS[name])
        # The versions come first: a version committed after the files were listed would be named but not read.
        newest = self.read("manifest").select("source_id", "version")
        found = self.spark.read.schema(f"{SCHEMAS[name]}, version STRING").option("recursiveFileLookup", True).parquet(f"{self.root}/{name}")
        return found.join(newest, ["source_id", "version"], "left_semi").drop("version")

    def sources(self) -> DataFrame:
        """Manifests, the newest first."""
        return self.read("manifest").orderBy(F.desc("fetched_at"), "source_id")

    def is_current(self, source_id: str, content_sha256: str) -> bool:
        """Whether this content of a source has landed."""
        current = self.log.latest(source_id)["current"]
        return bool(current) and current["content_sha256"] == content_sha256

    def remove(self, source_id: str) -> bool:
        """Removes a source by an entry without a version; False if there was none. Its files go when their time is up."""
        if not self.log.latest(source_id)["current"]:
            return False
        entry = Landing(self.log, source_id).commit(None, retain=self.retain)
        self._forget(source_id, entry["expired"])
        return True


#: Distances at which two periods of a series may make a fingerprint: what regular grains have, and their multiples.
STEPS = ("1 day", "7 days", "1 month", "3 months", "12 months")


def fingerprints(rows: DataFrame, tolerance: float, spread: bool) -> DataFrame:
    """(series_key, print): for every two periods of a series at one of STEPS, the periods and where their values lie
    within a power of ten, in bins as wide as the tolerance. Series that are a power of ten apart share them. With
    ``spread`` the neighbouring bins count too, so that values within the tolerance share a print for certain."""
    bins = max(1, int(1 / -math.log10(1 - tolerance)))
    bare = rows.where("value <> 0").select("series_key", "period", F.pmod(F.floor((F.log10(F.abs("value")) - F.floor(F.log10(F.abs("value")))) * bins), F.lit(bins)).alias("bin"))
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.expr(f"CAST(period + INTERVAL {s} AS DATE)").alias("then")) for i, s in enumerate(STEPS))))
    first = bare.select("series_key", "period", "bin", steps.alias("s")).select("series_key", F.col("period").alias("at"), F.col("bin").alias("one"), "s.step", "s.then")
    both = first.join(bare.select("series_key", F.col("period").alias("then"), F.col("bin").alias("two")), ["series_key", "then"])
    if spread:
        for name in ("one", "two"):
            both = both.withColumn(name, F.explode(F.array_distinct(F.array(*(F.pmod(F.col(name) + d, F.lit(bins)) for d in (-1, 0, 1))))))
    return both.select("series_key", F.struct("step", "at", "one", "two").alias("print"))


def verify(landed: DataFrame, corpus: DataFrame, tolerance: float = 0.005, least: float = 0.9) -> DataFrame:
    """How landed series agree with the corpus on common periods: landed_key, corpus_key, agreement, ratio (the median),
    n_common and the verdict: match, or scale_mismatch where they agree a power of ten apart.

    Both are (series_key, period, value), one row a period. A pair agrees if ``least`` of its common periods do, to
    the tolerance. Candidates share a fingerprint, so they come from an equi-join and are few but for series that
    do agree; each is then compared on all its periods. Any pair that agrees shares one if its common periods, two
    or more, follow each other at one of STEPS, as those of regular series do. A landed series that agrees with none
    has one row of verdict none, without a corpus_key.
    """
    prints = fingerprints(landed, tolerance, True).withColumnRenamed("series_key", "landed_key")
    candidates = prints.join(fingerprints(corpus, tolerance, False).withColumnRenamed("series_key", "corpus_key"), "print").select("landed_key", "corpus_key").distinct()
    ours = landed.where("value <> 0").select(F.col("series_key").alias("landed_key"), "period", F.col("value").alias("a"))
    theirs = corpus.where("value <> 0").select(F.col("series_key").alias("corpus_key"), "period", F.col("value").alias("b"))
    both = candidates.join(ours, "landed_key").join(theirs, ["corpus_key", "period"])
    ratio = F.percentile(F.try_divide("a", "b"), 0.5)
    power = F.rint(F.log10(F.abs("ratio")))
    # The ratios are gathered by pair, one a common period, and compared with 1 and with the power of ten next to their median.
    rated = both.groupBy("landed_key", "corpus_key").agg(ratio.alias("ratio"), F.collect_list(F.col("a") / F.col("b")).alias("r"), F.count("*").alias("n_common")).withColumn("power", power)
    part = lambda near: F.size(F.filter("r", near)) / F.col("n_common")
    told = rated.select("landed_key", "corpus_key", part(lambda x: F.abs(x - 1) <= tolerance).alias("agreement"), "ratio", "n_common", "power", part(lambda x: F.abs(x / F.pow(F.lit(10.0), F.col("power")) - 1) <= tolerance).alias("scaled"))
    verdict = F.when(F.col("agreement") >= least, "match").when((F.col("power") != 0) & (F.col("scaled") >= least), "scale_mismatch")
    found = told.withColumn("verdict", verdict).where("verdict IS NOT NULL").drop("power", "scaled")
    alone = landed.select(F.col("series_key").alias("landed_key")).distinct().join(found.select("landed_key").distinct(), "landed_key", "left_anti")
    return found.unionByName(alone.withColumn("verdict", F.lit("none")), allowMissingColumns=True)


class EvidenceLog:
    """Runs and their tool results, appended as Parquet; payloads are JSON text.

    Every call appends a small file. Once a table has more than ``most`` of them they are merged: the merged files
    are written beside, and an entry of the commit log says which small ones they stand for. A reader takes
    the entry first and then the small files that it does not cover, so it sees every row once at any time. Covered
    files are deleted ``retain`` seconds later, by a later merge, for readers that have begun.
    """

    RECORDS = "run_id STRING, position INT, tool STRING, payload STRING, recorded_at STRING"
    RUNS = "run_id STRING, question STRING, started_at STRING"
    ENDS = "run_id STRING, answer STRING, verdict STRING, finished_at STRING"

    def __init__(self, spark: SparkSession, root: str, most: int = 64, retain: float = 3600.0):
        self.spark, self.root, self.most, self.retain = spark, root.rstrip("/"), most, retain
        self.files, self.log = Files(spark), CommitLog(spark, f"{self.root}/log")

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")
        if len(self._small(name, self._state(name))) > self.most:
            self.compact(name)

    def _state(self, name: str) -> dict:
        return self.log.latest(name)["current"] or {"version": None, "covered": []}

    def _small(self, name: str, state: dict) -> list[str]:
        """Names of the files that no merge covers."""
        covered = {c["file"] for c in state["covered"]}
        return [f for f in self.files.names(f"{self.root}/{name}") if f.endswith(".parquet") and f not in covered]

    def compact(self, name: str) -> bool:
        """Merges what small files a table has into its merged ones; False if another merge has come first."""
        entry, schema, now = self.log.latest(name), {"records": self.RECORDS, "runs": self.RUNS, "ends": self.ENDS}[name], time.time()
        state = entry["current"] or {"version": None, "covered": []}
        small = self._small(name, state)
        if not small:
            return False
        token = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        paths = [f"{self.root}/{name}/{f}" for f in small] + ([f"{self.root}/merged/{name}/{state['version']}"] if state["version"] else [])
        self.spark.read.schema(schema).parquet(*paths).repartitionByRange("run_id").sortWithinPartitions("run_id").write.parquet(f"{self.root}/merged/{name}/{token}")
        due = [c for c in state["covered"] if c["at"] <= now - self.retain]
        covered = [c for c in state["covered"] if c not in due] + [{"file": f, "at": now} for f in small]
        retired = [r for r in entry["retired"] if r["at"] > now - self.retain] + ([{"token": state["version"], "at": now}] if state["version"] else [])
        # A file stays covered until it is gone, so that no reader takes it for a new one.
        for c in due:
            self.files.delete(f"{self.root}/{name}/{c['file']}")
        if not self.log.append(name, {"number": entry["number"] + 1, "source_id": name, "current": {"version": token, "covered": covered}, "retired": retired, "fenced": []}):
            self.files.delete(f"{self.root}/merged/{name}/{token}")
            return False
        for r in entry["retired"]:
            if r not in retired:
                self.files.delete(f"{self.root}/merged/{name}/{r['token']}")
        return True

    def start(self, question: str) -> str:
        """A new run's id."""
        run = uuid.uuid4().hex[:12]
        self._append("runs", [(run, question, time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime()))], self.RUNS)
        return run

    def record(self, run_id: str, results: list[tuple[str, dict]]) -> None:
        """Appends the results of a run together, in order."""
        now = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime()) + f".{time.time_ns() % 10**9:09d}"
        self._append("records", [(run_id, i, tool, json.dumps(payload, default=str, ensure_ascii=False), now) for i, (tool, payload) in enumerate(results)], self.RECORDS)

    def finish(self, run_id: str, answer: str, verdict: str = "passed") -> None:
        """Appends what a run ended with; the last end of a run counts."""
        self._append("ends", [(run_id, answer, verdict, time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime()) + f".{time.time_ns() % 10**9:09d}")], self.ENDS)

    def _read(self, name: str, schema: str) -> DataFrame:
        state = self._state(name)
        paths = [f"{self.root}/{name}/{f}" for f in self._small(name, state)] + ([f"{self.root}/merged/{name}/{state['version']}"] if state["version"] else [])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        """Runs with the number of their results, and what they ended with; null for runs that have not ended."""
        counts = self._read("records", self.RECORDS).groupBy("run_id").agg(F.count("*").alias("n"))
        ends = self._read("ends", self.ENDS).groupBy("run_id").agg(F.max_by(F.struct("answer", "verdict", "finished_at"), "finished_at").alias("e")).select("run_id", "e.*")
        return self._read("runs", self.RUNS).join(counts, "run_id", "left").join(ends, "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def get(self, run_id: str) -> dict | None:
        """A run with its results, or None if there is no such run."""
        row = self.runs().where(F.col("run_id") == run_id).first()
        return None if row is None else row.asDict() | {"results": self.results(run_id)}

    def results(self, run_id: str) -> list[dict]:
        """The results of one run in order."""
        rows = self._read("records", self.RECORDS).where(F.col("run_id") == run_id).orderBy("recorded_at", "position").collect()
        return [{"tool": r.tool, "payload": json.loads(r.payload)} for r in rows]


def schema_card(spark: SparkSession, tables: dict[str, DataFrame], footnotes: DataFrame | None = None, few: int = 12) -> str:
    """A text that tells what can be queried: columns, the span of tables with a period, the values of text
    columns that have a ``few`` of them at most, and the newest notes of each dataset.

    Each table is aggregated once for its span and its number of values, and once for the values of the
    columns found to have few.
    """
    lines = []
    for name, df in sorted(tables.items()):
        lines.append(f"## {name}\n" + ", ".join(f"{c} {t}" for c, t in df.dtypes))
        texts = [c for c, t in df.dtypes if t == "string"]
        span = [F.min("period").alias("__a"), F.max("period").alias("__b")] if "period" in df.columns else []
        r = df.agg(F.count("*").alias("__n"), *span, *(F.approx_count_distinct(c).alias(c) for c in texts)).first()
        lines.append(f"{r['__n']} rows" + (f", {r['__a']} to {r['__b']}" if span else ""))
        small = [c for c in texts if 0 < r[c] <= few]
        if small:
            values = df.agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in small)).first()
            lines += [f"{c}: {', '.join(values[c])}" for c in small]
    if footnotes is not None:
        newest = footnotes.groupBy("dataset").agg(F.max_by(F.struct("footnote", "first_period", "last_period"), "last_period").alias("f")).orderBy("dataset").collect()
        lines += ["## notes", *(f"{r.dataset}, {r.f.first_period} to {r.f.last_period}: {r.f.footnote}" for r in newest)]
    return "\n".join(lines) + "\n"
