"""Micro-batches over files that grow.

The stream's checkpoint holds a byte offset for each file (not an event time): no line is too late, and state that must
outlive a batch lies in the tables.  Each batch is one transaction, which also stores the checkpoint's id and the batch's number: a batch that is run again, after a
failure between its commit and the checkpoint's, finds itself there and does nothing.  A late line changes its session's rollup and its successor's latency in the batch that brings
it, whatever its age.  Spark lets one query run per checkpoint, which guards against overlap (T6).

``collect_available`` lists files and looks for their last newlines in tasks, and writes what is due as orders: Parquet files of paths and byte ranges, of at most ``max_files`` rows and, but for
the last file of one, ``max_bytes``.  Spark's file source takes one order a batch, so the checkpoint names orders, a batch that is run again reads the same ranges, and the driver sees no file.
``stream_lines`` is the source for other queries: it lists its roots on the driver.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.operators import watermarks
from meterlake.plans import ingest
from meterlake.plans.store import MANY, Store
from meterlake.sources import discovery, lines, rates

ORDER = "path string, start bigint, end bigint, inode bigint, size_bytes bigint, mtime_ns bigint"
#: Files of an order at most, where the caller names no bound.
MOST = 10_000


def stream_lines(spark: SparkSession, roots: list[str], state: str, max_files: int = 0, max_bytes: int = 0) -> DataFrame:
    """path, end_offset, raw, start of every complete line, as it comes; ``state``: the folder of the offsets' side files."""
    spark.dataSource.register(lines.TranscriptLines)
    options = {"roots": json.dumps(roots), "state": state, "max_files": str(max_files), "max_bytes": str(max_bytes)}
    return spark.readStream.format("transcript_lines").options(**options).load()


def take_batch(store: Store, roots: ingest.Roots, card: rates.RateCard, batch: DataFrame, number: int, query_id: str, held: bool = True) -> None:
    """One micro-batch (lines with ``start``, from where on their file is read) into the tables, once.

    Lines are ``held`` for the dialects, which each take theirs, unless those of one are all there is and paths cost little.
    """
    if store.took(query_id, number):
        return
    got = batch.persist() if held else batch
    try:
        with store.laying() as laid:
            span = laid(got.groupBy("path").agg(F.min("start").alias("start")))  # else every line would be classified, as filters on paths are pushed below
            files = laid(discovery.stats(discovery.classify(span, roots.projects_dir, roots.sessions_dir, roots.history_path)).withColumn("reset", F.col("start") == 0))
            n = files.count()
            if n:
                stats = ingest.RunStats(f"batch_{number}", ingest.now_iso(), files_scanned=n, files_read=n, query_id=query_id, batch=number)
                ingest.ingest(store, dict.fromkeys(ingest.DIALECTS, got.drop("start")), files, card, stats)
    finally:
        if held:
            got.unpersist()
    store.compact(MANY)


def query_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives its query, the same after every restart."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def admit(store: Store, roots: ingest.Roots, orders: str, max_files: int = 0, max_bytes: int = 0) -> int:
    """Writes what is due by the store's marks, and not in ``orders`` already, as orders in the order of kinds and paths; returns their number.

    Ranges of paths are dealt to tasks, each of which cuts its range into orders; the driver moves the finished files.
    """
    spark, most = store.spark, max_files or MOST
    listed = discovery.classify(discovery.listing(spark, *roots.all()), roots.projects_dir, roots.sessions_dir, roots.history_path)
    due = listed.join(watermarks.decide(listed, store.raw("ingest_files")).filter("decision != 'unchanged'"), "path")
    # a file that was read anew without a complete line is told once, by the mark that it gets
    due = lines.with_ends(due).filter("end > start OR decision IN ('rotated', 'truncated', 'rewritten')")
    made = due.join(spark.read.schema(ORDER).parquet(orders), ["path", "inode", "size_bytes", "mtime_ns"], "left_anti").persist()
    try:
        parts = -(-made.count() // most)
        if not parts:
            return 0
        dealt = made.repartitionByRange(parts, "kind", "path").withColumn("part", F.spark_partition_id())
        before = Window.partitionBy("part").orderBy("kind", "path")
        size = F.sum(F.col("end") - F.col("start")).over(before) - (F.col("end") - F.col("start"))
        cut = dealt.withColumns({"nth": F.floor((F.row_number().over(before) - 1) / most), "share": F.floor(size / max_bytes) if max_bytes else F.lit(0)})
        at = f"{orders}-new"
        names = [c.split()[0] for c in ORDER.split(", ")]
        cut.select("part", "nth", "share", *names).write.mode("overwrite").partitionBy("part", "nth", "share").parquet(at)
    finally:
        made.unpersist()
    found = store._fs.listFiles(store._path(at), True)
    files = []
    while found.hasNext():
        path = found.next().getPath()
        if path.getName().endswith(".parquet"):
            place = [int(x.split("=")[1]) for x in path.toString().split("/")[-4:-1]]
            files.append((place, path))
    now = int(time.time() * 1000)
    for i, (_, path) in enumerate(sorted(files, key=lambda f: f[0])):  # the file source goes by time
        store._fs.setTimes(path, now + i, -1)
        store._fs.rename(path, store._path(f"{orders}/{now}-{i:06d}.parquet"))
    return len(files)


def ordered_lines(order: DataFrame) -> DataFrame:
    """The lines of an order's ranges, as ``take_batch`` wants them."""
    size = order.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()[0]
    return lines.read_files(order.select("path", "start", F.col("end").alias("size_bytes")), max(1, min(-(-size // ingest.TASK_BYTES), 1 << 16)), with_start=True)


def collect_available(spark: SparkSession, store: Store, roots: ingest.Roots, card: rates.RateCard, checkpoint: str, max_files: int = 0, max_bytes: int = 0) -> int:
    """Takes what is there, in batches of bounded size, and ends (T1); returns the number of batches.

    Orders that an earlier call left are taken first, so a store that was changed by them is what new ones are made from; a file that can't be read is ordered once a call.
    """
    orders, taken, first = f"{checkpoint}/orders", 0, True
    store._fs.mkdirs(store._path(orders))
    while True:
        query = (spark.readStream.schema(ORDER).option("maxFilesPerTrigger", 1).parquet(orders).writeStream
                 .foreachBatch(lambda df, n: take_batch(store, roots, card, ordered_lines(df), n, query_of(df.sparkSession, checkpoint)))
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
        taken += sum(p["numInputRows"] > 0 for p in query.recentProgress)
        if first:  # all that lies there has been taken
            for s in store._fs.listStatus(store._path(orders)):
                store._fs.delete(s.getPath(), False)
            first = False
        if not admit(store, roots, orders, max_files, max_bytes):
            return taken
