"""Building the monthly tables anew from what has changed in the archive.

A ledger has the digest of every file built from. A run lists the archive, reads only files that are new or have
changed, and replaces the partitions (a dataset and year) that they touch; all others stay the folders that they
are, named by the new version as by the old. Year-to-date flows begin anew each year, so they need no more than
the partition. Growth looks back over years: each partition carries the last rows of its series, so it is
recomputed from the first touched year on without reading what lies before. Checks read what has been written;
a version becomes current by one commit after they pass, and the outcome is that of building everything.
"""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import quality, series
from tidemark.plans import build
from tidemark.sources import published
from tidemark.sources.commits import CommitLog, Files, Late

#: Rows of a series that growth looks back over.
LAGS = 12
LEDGER = "dataset STRING, file STRING, path STRING, length BIGINT, modified TIMESTAMP, sha256 STRING"
#: Tables by what a partition of them is.
BY_YEAR, BY_DATASET = ("observations", "notes", "growth", "tails"), ("entities", "metrics", "footnotes")


@dataclass(frozen=True)
class Changes:
    """Files to read, files that are gone, and the new ledger's rows; (dataset, file) each."""

    read: list[tuple[str, str]]
    gone: list[tuple[str, str]]
    ledger: list[tuple]

    def touched(self) -> dict[str, set[int]]:
        """The years of each dataset that these files are about; 0 for names without a period."""
        out: dict[str, set[int]] = {}
        for dataset, file in (*self.read, *self.gone):
            found = re.search(r"(\d{4})_(\d{2})", file)
            out.setdefault(dataset, set()).add(int(found.group(1)) if found else 0)
        return out


class Incremental:
    """The curated tables below one folder, kept equal to a build of the whole archive.

    With ``trust_times`` a file of the size and time in the ledger counts as unchanged; without, every file's
    digest is taken. ``retain`` is for how many seconds replaced folders stay for readers that have begun.
    """

    def __init__(self, spark: SparkSession, out: str, datasets: list[build.Dataset], lifecycles: DataFrame | None = None, trust_times: bool = True, retain: float = 3600.0):
        self.spark, self.out, self.datasets, self.lifecycles = spark, out.rstrip("/"), {d.name: d for d in datasets}, lifecycles
        self.trust_times, self.retain = trust_times, retain
        self.files, self.log = Files(spark), CommitLog(spark, f"{self.out}/log")

    def state(self) -> dict:
        """The newest version: the folder of every partition, by table."""
        return self.log.latest("tables")["current"] or {"version": None, "parts": {t: {} for t in (*BY_YEAR, *BY_DATASET)}}

    def _folders(self, state: dict, table: str, wanted=lambda dataset, year: True) -> list[str]:
        return sorted(f"{self.out}/{folder}" for key, folder in state["parts"][table].items() if wanted(*self._key(key)))

    @staticmethod
    def _key(key: str) -> tuple[str, int]:
        dataset, _, year = key.rpartition("/")
        return (dataset, int(year)) if dataset else (year, 0)

    def changes(self, state: dict | None = None) -> Changes:
        """What differs between the archive and the ledger. Reads the content of new and touched files only."""
        state = state or self.state()
        listed = [self.spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(d.path).select(F.lit(d.name).alias("dataset"), F.element_at(F.split("path", "/"), -1).alias("file"), "path", "length", F.col("modificationTime").alias("modified")) for d in self.datasets.values()]
        now = reduce(DataFrame.unionByName, listed)
        known = self.spark.read.schema(LEDGER).parquet(f"{self.out}/ledger/{state['version']}") if state["version"] else self.spark.createDataFrame([], LEDGER)
        known = known.select("dataset", "file", *(F.col(c).alias(f"old_{c}") for c in ("length", "modified", "sha256")))
        same = F.col("length").eqNullSafe(F.col("old_length")) & F.col("modified").eqNullSafe(F.col("old_modified")) & F.lit(self.trust_times)
        rows = now.join(known, ["dataset", "file"], "full").withColumn("same", same).collect()
        suspect = [r.path for r in rows if r.path and not r.same]
        digests = {}
        if suspect:
            content = self.spark.read.format("binaryFile").load(suspect).select("path", F.sha2("content", 256).alias("sha256"))
            digests = {r.path: r.sha256 for r in content.collect()}
        there = [r for r in rows if r.path]
        ledger = [(r.dataset, r.file, r.path, r.length, r.modified, r.old_sha256 if r.same else digests[r.path]) for r in there]
        read = sorted((r.dataset, r.file) for r in there if not r.same and digests[r.path] != r.old_sha256)
        return Changes(read, sorted((r.dataset, r.file) for r in rows if not r.path), ledger)

    def _write(self, table: str, token: str, rows: DataFrame, by_year: bool) -> dict[str, str]:
        """Writes partitions of a table, each sorted by key and period; the folder of each."""
        by = ["p_dataset", "p_year"] if by_year else ["p_dataset"]
        rows = rows.withColumn("p_dataset", F.col("dataset"))
        if by_year:
            rows = rows.withColumn("p_year", F.col("year") if table == "tails" else F.year("period"))
        order = [c for c in ("entity_key", "metric", "currency", "period") if c in rows.columns]
        home = f"parts/{table}/{token}"
        rows.hint("rebalance", *by).sortWithinPartitions(*by, *order).write.partitionBy(*by).parquet(f"{self.out}/{home}")
        found = {}
        for d in self.files.names(f"{self.out}/{home}"):
            dataset = unquote(d.removeprefix("p_dataset="))
            if by_year:
                found |= {f"{dataset}/{y.removeprefix('p_year=')}": f"{home}/{d}/{y}" for y in self.files.names(f"{self.out}/{home}/{d}")}
            else:
                found[dataset] = f"{home}/{d}"
        return found

    def _read(self, folders: list[str], like: DataFrame | None = None) -> DataFrame | None:
        if folders:
            return self.spark.read.parquet(*folders)
        return None if like is None else self.spark.createDataFrame([], like.schema)

    def run(self) -> str | None:
        """Brings the tables up to date; the new version, or None if no file has changed.

        Raises ValidationError, and leaves the version before, if a check fails on what would change; raises Late if another
        run has committed meanwhile.
        """
        entry = self.log.latest("tables")
        state = self.state()
        found = self.changes(state)
        if not found.read and not found.gone:
            return None
        token = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        try:
            parts = self._parts(state, found, token)
            self.spark.createDataFrame(found.ledger, LEDGER).write.parquet(f"{self.out}/ledger/{token}")
        except BaseException:
            self._drop(token)
            raise
        finally:
            self.files.delete(f"{self.out}/staged/{token}")
        now = time.time()
        replaced = {f for t in parts for f in state["parts"][t].values()} - {f for t in parts for f in parts[t].values()} | ({f"ledger/{state['version']}"} if state["version"] else set())
        retired = entry["retired"] + [{"token": f, "at": now} for f in sorted(replaced)]
        kept = [r for r in retired if r["at"] > now - self.retain]
        if not self.log.append("tables", entry | {"number": entry["number"] + 1, "kind": "build", "current": {"version": token, "parts": parts}, "retired": kept}):
            self._drop(token)
            raise Late("another build has committed meanwhile")
        for r in retired:
            if r not in kept:
                self.files.delete(f"{self.out}/{r['token']}")
        return token

    def _drop(self, token: str) -> None:
        for folder in (f"ledger/{token}", *(f"parts/{t}/{token}" for t in (*BY_YEAR, *BY_DATASET))):
            self.files.delete(f"{self.out}/{folder}")

    def _parts(self, state: dict, found: Changes, token: str) -> dict[str, dict[str, str]]:
        """Writes what the changes touch, checks it, and gives the folders of the whole new version."""
        touched = found.touched()
        paths = {(d, f): p for d, f, p, *_ in found.ledger}
        staged = {}
        for d in sorted({d for d, _ in found.read}):
            at = f"{self.out}/staged/{token}/{d}"
            published.table_rows(self.spark, [paths[x] for x in found.read if x[0] == d]).write.parquet(at)
            staged[d] = self.spark.read.parquet(at)
        layout = [build.Check(f"layout of {d}", published.check_tables(self.spark, "", self.datasets[d].unit, rows)) for d, rows in staged.items()]
        self._enforce(layout)
        new = [published.read_tables(self.spark, "", d, s.unit, s.semantics, s.hierarchy, s.entity_type, staged[d], keep_file=True) for d, s in self.datasets.items() if d in staged]
        notes = [published.file_notes(rows, d) for d, rows in staged.items()]
        stale = F.broadcast(self.spark.createDataFrame([*found.read, *found.gone], "dataset string, file string"))
        in_touched = lambda dataset, year: year in touched.get(dataset, ())
        parts = {t: dict(state["parts"][t]) for t in (*BY_YEAR, *BY_DATASET)}

        def replace(table: str, fresh: list[DataFrame], finish) -> None:
            old = self._read(self._folders(state, table, in_touched))
            if old is not None:
                fresh = [old.drop("value_flow").join(stale, ["dataset", "file"], "left_anti"), *fresh]
            kept = {k: f for k, f in parts[table].items() if not in_touched(*self._key(k))}
            parts[table] = kept | (self._write(table, token, finish(reduce(lambda a, b: a.unionByName(b), fresh)), True) if fresh else {})

        replace("observations", new, build.with_flows)
        replace("notes", notes, lambda df: df)
        version = {"parts": parts}
        changed = self._read(self._folders(version, "observations", in_touched))
        whole = self._read(self._folders(version, "observations", lambda d, y: d in touched))
        if changed is not None:
            self._enforce([
                build.Check("monthly keys occur once", published.check_keys(changed, ["period", *build.KEYS])),
                build.Check("monthly labels state true sums", build.label_identities(changed)),
                build.Check("year-to-date values have flows", quality.missing_flows(changed.where("temporal_semantics = 'cumulative_ytd'"), build.KEYS, "value", "value_flow")),
            ])
        if whole is not None:
            self._enforce([build.Check("monthly entities are published throughout", build.absent_periods(whole, self.lifecycles))])
        self._carry(parts, touched, token)
        for table in BY_DATASET:
            parts[table] = {k: f for k, f in parts[table].items() if k not in touched}
        if whole is not None:
            parts["entities"] |= self._write("entities", token, build.entities(whole.drop("file")), False)
            parts["metrics"] |= self._write("metrics", token, build.metric_catalogue(whole, ["dataset", "metric", "currency", "unit"]), False)
        said = self._read(self._folders(version, "notes", lambda d, y: d in touched))
        if said is not None:
            parts["footnotes"] |= self._write("footnotes", token, published.note_spans(said), False)
        return parts

    def _carry(self, parts: dict, touched: dict[str, set[int]], token: str) -> None:
        """Growth and the carried rows of the touched datasets, from the first touched year of each on.

        What a series was before that year comes from the newest of its carried rows.
        """
        first = {d: min(years) for d, years in touched.items()}
        after = lambda d, y: d in first and y >= first[d]
        before = lambda d, y: d in first and y < first[d]
        version = {"parts": parts}
        rows = self._read(self._folders(version, "observations", after))
        carried = self._read(self._folders(version, "tails", before))
        for table in ("growth", "tails"):
            parts[table] = {k: f for k, f in parts[table].items() if not after(*self._key(k))}
        if rows is None:
            return
        rows = rows.select(*build.KEYS, "period", "value", F.lit(False).alias("old"))
        if carried is not None:
            latest = carried.groupBy(*build.KEYS).agg(F.max_by("last", "year").alias("last"))
            rows = rows.unionByName(latest.select(*build.KEYS, F.explode("last").alias("r"), F.lit(True).alias("old")).select(*build.KEYS, "r.period", "r.value", "old"))
        grown = series.growth_table(rows, build.KEYS).where("NOT old").drop("old")
        parts["growth"] |= self._write("growth", token, grown, True)
        order = Window.partitionBy(*build.KEYS).orderBy("period")
        ends = rows.withColumns({"year": F.year("period"), "last": F.collect_list(F.struct("period", "value")).over(order.rowsBetween(1 - LAGS, 0)), "next": F.lead("period").over(order)})
        ends = ends.where("NOT old AND (next IS NULL OR year(next) > year)").select(*build.KEYS, "year", "last")
        parts["tails"] |= self._write("tails", token, ends, True)

    @staticmethod
    def _enforce(checks: list[build.Check]) -> None:
        """Raises ValidationError with all checks that fail."""
        if checks:
            build.enforce(build.evidence(checks).collect())

    def tables(self, views: bool = False) -> dict[str, DataFrame]:
        """The tables of the newest version, as temporary views too if asked; those without rows are left out."""
        state = self.state()
        found = {}
        for table in ("observations", "growth", *BY_DATASET):
            df = self._read(self._folders(state, table))
            if df is not None:
                found[table] = df.drop("file")
                if views:
                    found[table].createOrReplaceTempView(table)
        return found
