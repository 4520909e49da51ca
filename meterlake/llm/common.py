"""What the operators of this folder share: tables, durable intermediates, word rules."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it (fixed value).
WORD = r"[^\x20\x09-\x0D]+"

#: A key with more than 1 / HEAVY_PARTS of all rows is hot.
HEAVY_PARTS = 2000

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a folder of our own only where that is unset and all runs in one process (tests)."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if _own_dir is None:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _own_dir = tempfile.mkdtemp(prefix="meterlake-", dir="/tmp/checkpoints")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context: their Python needs it to read our functions."""
    sc = spark.sparkContext
    if getattr(sc, "_meterlake_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    made = tempfile.mkdtemp(prefix="meterlake-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    with zipfile.ZipFile(out := f"{made}/meterlake_code.zip", "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(out)
    sc._meterlake_shipped = True


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: str = "16m") -> Iterator[None]:
    """Within it, Arrow batches hold at most ``rows`` rows and about ``size`` bytes; the session's own settings come back after."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def durable(df: DataFrame, name: str, batch_rows: int = 2048, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (a subfolder for each value of ``by``) and read it back.

    Cuts the lineage like ``checkpoint()``, but columnar and compressed; a lost executor
    costs no recomputation of what was written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meterlake/{name}-{uuid.uuid4().hex}"
    with arrow_batches(spark, batch_rows):
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._durable_path = path
    return made


def forget(*tables: DataFrame) -> None:
    """Delete what ``durable`` wrote, once nothing that is still to be computed reads it."""
    for t in tables:
        if path := t.__dict__.pop("_durable_path", None):
            remove(t.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def join_counted(rows: DataFrame, told: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Left join of ``rows`` with ``told``, which has one row a key and in ``count`` how many of ``rows`` hold it.

    Keys that hold 1/``HEAVY_PARTS`` of all rows (so ``HEAVY_PARTS`` of them at most) are broadcast; the rest is joined by key,
    none of which is then hot.
    """
    total = told.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    heavy = F.col(count) >= max(2, -(-int(total) // HEAVY_PARTS))
    few = F.broadcast(told.filter(heavy))
    if not few.isEmpty():
        known = F.broadcast(told.filter(heavy).select(*keys))
        return rows.join(few, keys).unionByName(rows.join(known, keys, "left_anti").join(told.filter(~heavy), keys, "left"))
    return rows.join(told, keys, "left")


def text_of(col: str | Column = "text") -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of text in the whole table: one column-pruned scan, one row to the driver."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0])
