"""What is recomputed from messages: latency (W1, W2) and session rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Gaps above half an hour are no latency; how far back sessions count as recent.
LATENCY_CAP_MS, RECENT_MS = 1_800_000, 2 * 86_400_000


#: What ``latency`` and ``sessions`` read of a message.
TIMED = ("dedup_key", "agent", "session_id", "agent_run_id", "ts_epoch_ms")
SUMMED = ("agent", "session_id", "ts", "ts_epoch_ms", "kind", "is_sidechain", "cwd", "project_slug", "git_branch", "model", "cost_usd",
          "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens")


def latency(messages: DataFrame, only_null: bool = False) -> DataFrame:
    """``latency_ms``: time since the message before, per session and run; null when out of range."""
    w = Window.partitionBy("agent", "session_id", F.coalesce("agent_run_id", F.lit(""))).orderBy("ts_epoch_ms", "dedup_key")
    new = F.when(F.col("__gap").between(0, LATENCY_CAP_MS), F.col("__gap"))
    timed = messages.withColumn("__gap", F.col("ts_epoch_ms") - F.lag("ts_epoch_ms").over(w))  # once for all that is said of it
    return timed.withColumn("latency_ms", F.coalesce("latency_ms", new) if only_null and "latency_ms" in messages.columns else new).drop("__gap")


def recent(messages: DataFrame, since_ms: int) -> DataFrame:
    """All messages of the sessions that have one at ``since_ms`` or later (F6, T7); the keys are distinct, so the semi join shuffles few."""
    touched = messages.filter(F.col("ts_epoch_ms") >= since_ms).select("agent", "session_id").distinct()
    return messages.join(touched, ["agent", "session_id"], "left_semi")


def sessions(messages: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """One row a session; tool totals are aggregated before they are joined, on the grouping's own keys.

    Start and end are the texts of the earliest and latest time, as they were written.
    """
    tools = tool_calls.groupBy("agent", "session_id").agg(F.count("*").alias("tool_call_count"), F.count_if("is_error").alias("tool_error_count"))
    tokens = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens")
    m = messages.groupBy("agent", "session_id").agg(
        *[F.min(c).alias(c) for c in ("cwd", "project_slug", "git_branch")], F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
        F.min("ts_epoch_ms").alias("started_at_ms"), F.max("ts_epoch_ms").alias("ended_at_ms"),
        (F.max("ts_epoch_ms") - F.min("ts_epoch_ms")).alias("duration_ms"), F.count("*").alias("message_count"),
        F.count_if(F.col("kind") == "compaction").alias("compaction_count"), F.count_if("is_sidechain").alias("subagent_message_count"),
        F.collect_set("model").alias("models"),
        *[F.sum(c).alias(c) for c in tokens], F.sum("cost_usd").alias("cost_usd"),
        F.max(F.when(F.col("cost_usd").isNull(), 1).otherwise(0)).alias("has_unknown_pricing"))
    zero = F.lit(0).cast("long")
    m = m.withColumns({"models_used": F.to_json(F.array_sort("models")), "model_switch_count": (F.size("models") - 1).cast("long")}).drop("models")
    return m.join(tools, ["agent", "session_id"], "left").withColumns({
        "tool_call_count": F.coalesce("tool_call_count", zero), "tool_error_count": F.coalesce("tool_error_count", zero)})
