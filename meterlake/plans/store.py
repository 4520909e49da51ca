"""A folder of Parquet tables with transactions over several of them.

What a transaction writes goes to new folders first; one manifest, which lists the folders of every table, is renamed into place last.  So readers
see all of it or nothing, a failed run leaves no trace in any table, and of two writers that began from the same manifest the second fails.
Tables are appended to (a new folder ``run=...`` beside the others) or replaced, whole or by buckets.  The folder may be in any file system that Spark writes to.

Tables that grow are partitioned by a hash (``BUCKETED``), so a run reads and replaces only the buckets of the sessions, keys and files that it touches.

``tool_calls`` and ``subagent_runs`` are logs of halves, merged when they are read, so a run writes what is new and not the whole
table; ``compact`` writes the merged rows back.  ``messages`` has the latency that a message had when it came; what a late one changed for its successor stands in ``latency_fixes``.
"""

from __future__ import annotations

import contextlib
import itertools
import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meterlake.operators import merge
from meterlake.operators.experiments import EXPERIMENTS
from meterlake.sources import transcripts as t

VERSION = "1"


def _ddl(columns: tuple[str, ...]) -> str:
    kind = lambda c: t._KIND.get(c, "bigint" if c in t._LONG else "string")
    return ", ".join(f"{c} {kind(c)}" for c in columns)


SCHEMAS = {
    "meta": "key string, value string",
    "messages": _ddl(t.MESSAGE) + ", derived_cost_usd double, cost_usd double, cost_source string, pricing_version string, ingested_at string, shipped_at string, latency_ms bigint",
    "message_keys": "dedup_key string",
    "latency_fixes": "agent string, session_id string, dedup_key string, latency_ms bigint, seq bigint",
    "tool_calls": _ddl(t.CALL) + ", duration_ms bigint, ingested_at string, shipped_at string, seq bigint, source_kind string, end_offset bigint",
    "subagent_runs": _ddl(t.RUN) + ", ingested_at string, shipped_at string, seq bigint, source_kind string, end_offset bigint",
    "sessions": "agent string, session_id string, cwd string, project_slug string, git_branch string, started_at string, ended_at string, started_at_ms bigint, ended_at_ms bigint, "
    "duration_ms bigint, message_count bigint, compaction_count bigint, subagent_message_count bigint, models_used string, model_switch_count bigint, input_tokens bigint, "
    "output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, total_tokens bigint, cost_usd double, has_unknown_pricing int, tool_call_count bigint, "
    "tool_error_count bigint, updated_at string, shipped_at string",
    "ingest_files": "path string, agent string, source_kind string, inode bigint, size_bytes bigint, mtime_ns bigint, byte_offset bigint, lines_ingested bigint, lines_skipped bigint, "
    f"first_ingested_at string, last_ingested_at string, last_error string, seed {t.SEED}",
    "experiments": EXPERIMENTS,
    "ingest_runs": "run_id string, started_at string, finished_at string, files_scanned bigint, files_read bigint, files_rotated bigint, bytes_read bigint, lines_read bigint, "
    "lines_skipped bigint, messages_upserted bigint, tool_calls_upserted bigint, subagent_runs_upserted bigint, unknown_models string, partial int, duration_ms bigint, query_id string, batch bigint",
}
#: What the buckets of a table are hashed of, and how many there are in a new store.
BUCKETED = {**dict.fromkeys(("messages", "latency_fixes", "tool_calls", "sessions"), ("agent", "session_id")), "message_keys": ("dedup_key",), "ingest_files": ("path",)}
BUCKETS = 32
#: Folders of a table above which a run compacts it, and seconds that superseded ones are kept for their readers.
MANY, KEPT_S = 64, 86_400
#: The folder of what a run lays down for itself.
WORK = "_work"
SHIPPED = ("messages", "sessions", "tool_calls", "subagent_runs", "experiments")
#: The order in which halves of one key were told.
TOLD = ("seq", "source_kind", "source_file", "end_offset")


class Conflict(RuntimeError):
    """Another writer was faster."""


class Store:
    def __init__(self, spark: SparkSession, root: str, create: bool = True, buckets: int = BUCKETS) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not self._manifests():
            if not create:
                raise FileNotFoundError(f"no store at {root}")
            with self.transaction() as w:
                w.replace("meta", spark.createDataFrame([("schema_version", VERSION), ("buckets", str(buckets))], SCHEMAS["meta"]))
        self.buckets = int(self.meta("buckets"))

    def _manifests(self) -> list[int]:
        top = self._path(f"{self.root}/_manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("_"))

    def _manifest(self) -> tuple[int, dict[str, list[str]]]:
        if not (known := self._manifests()):
            return 0, {}
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{known[-1]:012d}.json"))
        try:
            return known[-1], json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*BUCKETED[table]), F.lit(self.buckets)).cast("int")

    def buckets_of(self, table: str, rows: DataFrame) -> list[int]:
        """The buckets of ``table`` that hold the keys of ``rows``: at most as many as there are."""
        return rows.agg(F.array_sort(F.collect_set(self.bucket(table)))).first()[0]

    def raw(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The table as it lies there; of ``buckets`` only, if they are given."""
        folders = self._manifest()[1].get(table, [])
        if not folders:
            return self.none(SCHEMAS[table])
        df = self.spark.read.option("basePath", f"{self.root}/{table}").schema(SCHEMAS[table] + ", run string" + (", bucket int" if table in BUCKETED else "")).parquet(*[f"{self.root}/{f}" for f in folders])
        return (df if buckets is None else df.filter(F.col("bucket").isin(buckets))).drop("run", "bucket")

    def none(self, schema: str) -> DataFrame:
        """No rows, which Spark's optimizer knows, so nothing is shuffled to be joined with them."""
        return self.spark.range(0).filter("false").selectExpr(*[f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in StructType.fromDDL(schema)])

    def table(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        df = self.raw(table, buckets)
        if table == "tool_calls":
            return merge.merge_calls(df, TOLD)
        if table == "messages":
            # a fix may be null; numbers are aggregated in a hash table, where a struct would be sorted
            fixed = self.raw("latency_fixes", buckets).groupBy("dedup_key").agg(F.max_by("latency_ms", "seq").alias("fix"), F.max("seq").alias("fixed"))
            return df.join(fixed, "dedup_key", "left").withColumn("latency_ms", F.when(F.col("fixed").isNotNull(), F.col("fix")).otherwise(F.col("latency_ms"))).select(*df.columns)
        return merge.merge_runs(df, TOLD) if table == "subagent_runs" else df

    def took(self, query_id: str, batch: int) -> bool:
        """Whether a micro-batch's rows are in the tables."""
        return not self.raw("ingest_runs").filter((F.col("query_id") == query_id) & (F.col("batch") == batch)).isEmpty()

    def tables(self) -> list[str]:
        return sorted(SCHEMAS)

    @contextlib.contextmanager
    def transaction(self) -> Iterator[Writer]:
        w = Writer(self, *self._manifest())
        try:
            yield w
            w.commit()
        except BaseException:
            w.undo()
            raise

    @contextlib.contextmanager
    def laying(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """A function that writes rows beside the tables and gives them as they are read again; in the end they are deleted.

        The plan of what is laid ends there. Cached rows keep the plan that made them, and a plan over caches over caches holds each of these anew wherever it is named, so its text outgrows the driver.
        """
        at, n = f"{self.root}/{WORK}/{uuid.uuid4().hex}", itertools.count()

        def laid(df: DataFrame) -> DataFrame:
            path = f"{at}/{next(n)}"
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        try:
            yield laid
        finally:
            self._fs.delete(self._path(at), True)

    def meta(self, key: str) -> str | None:
        row = self.raw("meta").filter(F.col("key") == key).first()
        return row["value"] if row else None

    def set_meta(self, key: str, value: str) -> None:
        with self.transaction() as w:
            w.replace("meta", merge.replace_rows(self.raw("meta"), self.spark.createDataFrame([(key, value)], SCHEMAS["meta"]), ["key"]))

    def pending(self) -> DataFrame:
        """table, rows that were not shipped yet."""
        out = [self.table(n).agg(F.lit(n).alias("table"), F.count_if(F.col("shipped_at").isNull()).alias("pending")) for n in SHIPPED]
        first = out[0]
        for df in out[1:]:
            first = first.unionByName(df)
        return first

    def ship(self, url: str) -> None:
        """Shipping to a database is not built, here as in the reference."""
        raise NotImplementedError("shipping is not built; pending() tells what waits for it")

    def compact(self, least: int = 0) -> None:
        """The merged halves as the new logs, and one folder a table, for tables of at least ``least`` folders. Folders of older manifests stay for their readers, for a time."""
        made = self._manifest()[1]
        many = {n for n in ("messages", "message_keys", "latency_fixes", "tool_calls", "subagent_runs", "ingest_runs") if len(made.get(n, [])) >= max(least, 1)}
        if not many:
            return
        many |= {"messages", "latency_fixes"} if many & {"messages", "latency_fixes"} else set()  # one is folded into the other
        with self.transaction() as w:
            for name in sorted(many):
                w.replace(name, self.raw(name).limit(0) if name == "latency_fixes" else self.table(name))
        self._vacuum()

    def _vacuum(self) -> None:
        """Deletes folders that no manifest names any more and manifests before the last, once they are ``KEPT_S`` old."""
        now = int(time.time() * 1000)
        last, made = self._manifest()
        live = {f.split("/")[1] for folders in made.values() for f in folders}
        for table in SCHEMAS:
            top = self._path(f"{self.root}/{table}")
            for s in self._fs.listStatus(top) if self._fs.exists(top) else []:
                if s.getPath().getName() not in live and now - s.getModificationTime() > KEPT_S * 1000:
                    self._fs.delete(s.getPath(), True)
        work = self._path(f"{self.root}/{WORK}")
        for s in self._fs.listStatus(work) if self._fs.exists(work) else []:  # of runs that were killed
            if now - s.getModificationTime() > KEPT_S * 1000:
                self._fs.delete(s.getPath(), True)
        for s in self._fs.listStatus(self._path(f"{self.root}/_manifests")):
            if s.getPath().getName() != f"{last:012d}.json" and now - s.getModificationTime() > KEPT_S * 1000:
                self._fs.delete(s.getPath(), False)


class Writer:
    def __init__(self, store: Store, number: int, known: dict[str, list[str]]) -> None:
        self.store, self.number, self.made = store, number, {k: list(v) for k, v in known.items()}
        self.new: list[str] = []

    def _write(self, table: str, df: DataFrame) -> tuple[str, int]:
        """Folder and number of rows, which the job that writes them observes."""
        columns = StructType.fromDDL(SCHEMAS[table])
        folder = f"{table}/run={self.number + 1:012d}-{uuid.uuid4().hex[:8]}"
        self.new.append(folder)
        have, counted = set(df.columns), Observation()
        df = df.selectExpr(*[f"CAST({f.name if f.name in have else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}" for f in columns])
        path = f"{self.store.root}/{folder}"
        if table in BUCKETED:  # adaptive execution joins small buckets and splits large ones
            laid = df.withColumn("bucket", self.store.bucket(table)).hint("rebalance", "bucket")
            laid.observe(counted, F.count(F.lit(1)).alias("n")).write.partitionBy("bucket").parquet(path)
        else:
            df.coalesce(4).observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return folder, int(counted.get.get("n") or 0)

    def append(self, table: str, df: DataFrame) -> int:
        """Rows that were written; no folder is kept for none."""
        folder, n = self._write(table, df)
        if n:
            self.made.setdefault(table, []).append(folder)
        return n

    def replace(self, table: str, df: DataFrame) -> None:
        folder, n = self._write(table, df)
        self.made[table] = [folder] if n else []

    def replace_buckets(self, table: str, df: DataFrame, buckets: list[int]) -> None:
        """All rows of these buckets."""
        folder, _ = self._write(table, df)
        s = self.store
        there = {x.getPath().getName() for x in s._fs.listStatus(s._path(f"{s.root}/{folder}"))}
        gone = {f"bucket={b}" for b in buckets}
        self.made[table] = [f for f in self.made.get(table, []) if f.split("/")[-1] not in gone] + sorted(f"{folder}/{b}" for b in gone & there)

    def together(self, *writes: Callable[[], object]) -> list:
        """Writes of several tables, whose jobs run side by side."""
        with ThreadPoolExecutor(len(writes)) as pool:
            return [f.result() for f in [pool.submit(inheritable_thread_target(self.store.spark)(w)) for w in writes]]

    def commit(self) -> None:
        s = self.store
        top = f"{s.root}/_manifests"
        s._fs.mkdirs(s._path(top))
        part = s._path(f"{top}/_{uuid.uuid4().hex}.json")
        out = s._fs.create(part, False)
        out.write(bytearray(json.dumps(self.made, sort_keys=True).encode()))
        out.close()
        final = s._path(f"{top}/{self.number + 1:012d}.json")
        if s._fs.exists(final) or not s._fs.rename(part, final):
            s._fs.delete(part, False)
            raise Conflict(f"another writer has made manifest {self.number + 1}")

    def undo(self) -> None:
        for folder in self.new:
            self.store._fs.delete(self.store._path(f"{self.store.root}/{folder}"), True)
