"""What to do with each listed file, given its stored mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decide(listing: DataFrame, marks: DataFrame) -> DataFrame:
    """path, decision, start: tested in this order, so a rotated file is never taken for a grown one."""
    m = marks.select("path", *[F.col(c).alias(f"m_{c}") for c in ("inode", "size_bytes", "mtime_ns", "byte_offset")])
    j = listing.join(m, "path", "left")
    same = (F.col("size_bytes") == F.col("m_size_bytes")) & (F.col("mtime_ns") == F.col("m_mtime_ns"))
    at_end = F.col("m_byte_offset") >= F.col("size_bytes")
    d = (F.when(F.col("m_byte_offset").isNull(), "new").when(F.col("inode") != F.col("m_inode"), "rotated")
         .when(F.col("size_bytes") < F.col("m_byte_offset"), "truncated").when(same & at_end, "unchanged")
         .when(at_end, "rewritten").otherwise("appended"))
    start = F.when(F.col("decision").isin("appended", "unchanged"), F.col("m_byte_offset")).otherwise(F.lit(0).cast("long"))
    return j.withColumn("decision", d).select("path", "decision", start.alias("start"))


def summary(marks: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return marks.agg(F.count("*").alias("files"), F.coalesce(F.sum("byte_offset"), zero).alias("bytes"), F.coalesce(F.sum("lines_ingested"), zero).alias("lines"),
                     F.coalesce(F.sum("lines_skipped"), zero).alias("skipped"))
