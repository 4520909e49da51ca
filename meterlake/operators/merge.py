"""Upserts as pure functions of what is stored and what comes in (U1-U6): Parquet tables have no MERGE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a later non-null value replaces, and those where the first one stays. All others are as first inserted.
CALL_NEWEST, CALL_OLDEST = ("tool_name", "result_ts_epoch_ms", "is_error", "agent_run_id"), ("ts", "ts_epoch_ms")
RUN_NEWEST = ("agent_type", "tool_use_id", "spawn_depth", "task_sha256", "task_len", "ended_at", "duration_ms", "status", "exit_code", "model", "message_count", "total_tokens", "cost_usd")


def first_wins(existing: DataFrame, incoming: DataFrame, order: Sequence[str], key: str = "dedup_key") -> DataFrame:
    """Rows of ``incoming`` to append: the first of each key by ``order``, if the key isn't stored yet.

    A partially aggregated ``min_by``, so thousands of repeats of a key are one row per task.
    """
    return first_of(incoming, order, key).join(existing.select(key), key, "left_anti").select(*incoming.columns)


def first_of(incoming: DataFrame, order: Sequence[str], key: str = "dedup_key") -> DataFrame:
    rest = [c for c in incoming.columns if c != key]
    return incoming.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def coalesced(rows: DataFrame, order: Sequence[str], newest: Sequence[str], oldest: Sequence[str] = (), key: str = "dedup_key") -> DataFrame:
    """One row a key: the newest or oldest non-null value of some columns by ``order``, the others (nulls too) as in the first row."""
    at = F.struct(*order)
    first = [c for c in rows.columns if c not in (key, *newest, *oldest)]
    there = lambda c: F.when(F.col(c).isNotNull(), at)
    made = rows.groupBy(key).agg(*[F.max_by(c, there(c)).alias(c) for c in newest], *[F.min_by(c, there(c)).alias(c) for c in oldest], F.min_by(F.struct(*first), at).alias("__first"))
    return made.select(key, *newest, *oldest, "__first.*")


def merge_calls(halves: DataFrame, order: Sequence[str] = ("seq",), key: str = "dedup_key") -> DataFrame:
    """Calls and results, stored or new, to one row a key.

    The duration is from call to result where both are known, else the newest stored one.
    """
    newest = [c for c in (*CALL_NEWEST, "duration_ms") if c in halves.columns]
    m = coalesced(halves, order, newest, [c for c in CALL_OLDEST if c in halves.columns], key)
    took = F.col("result_ts_epoch_ms") - F.col("ts_epoch_ms")
    return m.withColumn("duration_ms", F.coalesce(took, "duration_ms") if "duration_ms" in m.columns else took)


def outcomes(halves: DataFrame, order: Sequence[str], key: str = "dedup_key") -> DataFrame:
    """Whose each call is and whether it failed, as ``merge_calls`` has it, for those who count calls: a row carries its place in ``order`` twice at most."""
    made = halves.groupBy(key).agg(F.min(F.struct(*order, "agent", "session_id")).alias("first"), F.max(F.when(F.col("is_error").isNotNull(), F.struct(*order, "is_error"))).alias("last"))
    return made.select(key, "first.agent", "first.session_id", F.col("last.is_error").alias("is_error"))


def merge_runs(rows: DataFrame, order: Sequence[str] = ("seq",), key: str = "dedup_key") -> DataFrame:
    """Runs of helpers told by several sources, to one row a key."""
    return coalesced(rows, order, [c for c in RUN_NEWEST if c in rows.columns], (), key)


def replace_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` in place of stored ones with the same keys; nothing is deleted."""
    return existing.join(incoming.select(*keys), [*keys], "left_anti").unionByName(incoming)


def merge_marks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Marks of ``incoming`` (with ``reset``) over stored ones (S11): counters add up unless the file was read anew; the first time stays."""
    old = existing.select("path", *[F.col(c).alias(f"o_{c}") for c in ("lines_ingested", "lines_skipped", "first_ingested_at")])
    j = incoming.join(old, "path", "left")

    def sum_of(c: str) -> Column:
        return F.when(F.col("reset"), F.col(c)).otherwise(F.col(c) + F.coalesce(f"o_{c}", F.lit(0)))

    new = j.withColumns({"lines_ingested": sum_of("lines_ingested"), "lines_skipped": sum_of("lines_skipped"), "first_ingested_at": F.coalesce("o_first_ingested_at", "first_ingested_at")})
    return replace_rows(existing, new.select(*existing.columns), ["path"])
