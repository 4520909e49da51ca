"""The fixed reports (A1-A5, A7-A9, O2), and the invariants (D1-D7) as one table of counts.

Sums skip unknown prices, so each report has ``unpriced`` beside ``cost_usd``.  Groups are by the raw model;
its label is put on afterwards, so a null model and one named like the label stay apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens")


def since(df: DataFrame, at_ms: int | None, col: str = "ts_epoch_ms") -> DataFrame:
    return df if at_ms is None else df.filter(F.col(col) >= at_ms)


def _cost() -> list[Column]:
    return [F.sum("cost_usd").alias("cost_usd"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced")]


def _share(part: str, *whole: str) -> Column:
    total = sum((F.sum(c) for c in whole[1:]), F.sum(whole[0]))
    return F.when(total > 0, F.lit(100.0) * F.sum(part) / total)


def _label(df: DataFrame, col: str, label: str) -> DataFrame:
    return df.withColumn(col, F.coalesce(col, F.lit(label)))


def daily(m: DataFrame, at_ms: int | None = None) -> DataFrame:
    g = since(m, at_ms).groupBy("day", "agent").agg(
        F.count("*").alias("messages"), F.count_distinct("session_id").alias("sessions"), *[F.sum(c).alias(c) for c in TOKENS], *_cost())
    return g.orderBy(F.desc("day"), "agent")


def models(m: DataFrame, at_ms: int | None = None) -> DataFrame:
    g = since(m, at_ms).groupBy("model", "agent").agg(
        F.count("*").alias("messages"), *[F.sum(c).alias(c) for c in TOKENS], *_cost(), F.avg("latency_ms").alias("avg_latency_ms"),
        F.sum("retry_count").alias("retries"), _share("reasoning_tokens", "output_tokens").alias("reasoning_pct"),
        _share("cache_read_tokens", "cache_read_tokens", "input_tokens", "cache_write_tokens").alias("cache_hit_pct"))
    return _label(g, "model", "(none)").orderBy(F.desc_nulls_last("cost_usd"), F.desc("total_tokens"), "model", "agent")


def recent_sessions(s: DataFrame, limit: int = 20, at_ms: int | None = None) -> DataFrame:
    """The last sessions by their start; a start time is compared in whole seconds with ``at_ms``, and in full in the order."""
    late = s if at_ms is None else s.filter(F.floor(F.col("started_at_ms") / 1000) * 1000 >= at_ms)
    return late.orderBy(F.desc("started_at_ms"), "agent", "session_id").limit(limit)


def tools(t: DataFrame, at_ms: int | None = None) -> DataFrame:
    g = since(t, at_ms).groupBy("tool_name", "agent").agg(
        F.count("*").alias("calls"), F.count_if("is_error").alias("errors"),
        (F.lit(100.0) * F.count_if("is_error") / F.count("*")).alias("error_pct"), F.avg("duration_ms").alias("avg_duration_ms"))
    return _label(g, "tool_name", "(unknown)").orderBy(F.desc("calls"), "tool_name", "agent")


def status(m: DataFrame, s: DataFrame, t: DataFrame, subagent_runs: DataFrame, marks: DataFrame, windows: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: how much there is of each table, what it cost, from when to when, and the last run."""
    out = m.agg(F.count("*").alias("messages"), F.sum("cost_usd").alias("total_cost_usd"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced_messages"),
                F.min("ts").alias("earliest"), F.max("ts").alias("latest"))
    counts = {"sessions": s, "tool_calls": t, "subagent_runs": subagent_runs, "watermarks": marks, "experiments": windows}
    one = [df.agg(F.count("*").alias(k)) for k, df in counts.items()] + [runs.agg(F.max("finished_at").alias("last_run"))]
    for df in one:
        out = out.join(F.broadcast(df), how="left")  # one row each, as aggregates without a group
    return out.select("messages", *counts, "total_cost_usd", "unpriced_messages", "earliest", "latest", "last_run")


def unknown_models(m: DataFrame) -> DataFrame:
    g = m.filter("cost_usd IS NULL").groupBy("model", "agent").agg(F.count("*").alias("messages"), F.sum("total_tokens").alias("total_tokens"))
    return _label(g, "model", "(none)").orderBy(F.desc("total_tokens"), "model", "agent")


def _in_window(m: DataFrame, e: DataFrame) -> Column:
    return (m["ts_epoch_ms"] >= e["start_ms"]) & (e["end_ms"].isNull() | (m["ts_epoch_ms"] <= e["end_ms"]))


#: Windows up to so many are broadcast to the messages; of more, sums up to their ends are taken.
MAX_WINDOWS, HOUR_MS = 10_000, 3_600_000
#: Costs add up without rounding errors, so that differences of large sums are right.
EXACT = "decimal(38, 15)"


def experiments(e: DataFrame, m: DataFrame) -> DataFrame:
    """Messages and cost of each window; a message counts in every window that covers it.

    Windows are made by hand, so there are few, which is checked: they are broadcast to the range join.  However many more there are and however they overlap, a window is a
    difference of two running sums (``_by_sums``).
    """
    if e.limit(MAX_WINDOWS + 1).count() <= MAX_WINDOWS:
        hit = m.join(F.broadcast(e), _in_window(m, e)).groupBy("name").agg(F.count("*").alias("messages"), F.sum("cost_usd").alias("cost_usd"))
        made = e.join(hit, "name", "left").withColumn("messages", F.coalesce("messages", F.lit(0).cast("long")))
    else:
        made = _by_sums(e, m)
    return made.orderBy(F.desc("start_ms"), "name")


def _by_sums(e: DataFrame, m: DataFrame) -> DataFrame:
    """What came before a window's start, taken off what came before its end.

    Messages are summed by millisecond, the places where windows begin and end stand among them, and running sums go over the milliseconds of an hour and over the hours:
    an hour has 3.6 million milliseconds at most, whatever the number of messages, and a century 876,600 hours.
    """
    sums = ("messages", "priced", "cost")
    told = m.groupBy(F.col("ts_epoch_ms").alias("at")).agg(F.count("*").alias("messages"), F.count("cost_usd").alias("priced"), F.coalesce(F.sum(F.col("cost_usd").cast(EXACT)), F.lit(0)).cast(EXACT).alias("cost"))
    zero = F.lit(0).cast("long")
    asked = e.select(F.explode(F.array("start_ms", F.col("end_ms") + 1)).alias("at")).filter("at IS NOT NULL").distinct()
    rows = told.withColumn("asked", F.lit(False)).unionByName(asked.select("at", zero.alias("messages"), zero.alias("priced"), F.lit(0).cast(EXACT).alias("cost"), F.lit(True).alias("asked")))
    rows = rows.withColumn("hour", F.floor(F.col("at") / HOUR_MS))
    so_far = lambda w: [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"before_{c}") for c in sums]
    hours = rows.groupBy("hour").agg(*[F.sum(c).alias(c) for c in sums])
    before = hours.select("hour", *so_far(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)))
    inside = rows.select("hour", "at", "asked", *so_far(Window.partitionBy("hour").orderBy("at", F.desc("asked")).rowsBetween(Window.unboundedPreceding, -1))).filter("asked")
    upto = inside.alias("i").join(before.alias("b"), "hour").select("at", *[(F.col(f"i.before_{c}") + F.col(f"b.before_{c}")).alias(c) for c in sums])
    whole = told.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{c}") for c in sums])
    of = lambda side: F.struct(*sums).alias(side)
    w = e.join(upto.select(F.col("at").alias("start_ms"), of("low")), "start_ms", "left").withColumn("until", F.col("end_ms") + 1).join(upto.select(F.col("at").alias("until"), of("high")), "until", "left")
    w = w.join(F.broadcast(whole), how="left")  # one row
    fine = F.col("end_ms").isNull() | (F.col("end_ms") >= F.col("start_ms"))
    took = lambda c: F.when(fine, F.when(F.col("end_ms").isNull(), F.col(f"all_{c}")).otherwise(F.col(f"high.{c}")) - F.col(f"low.{c}"))
    return w.select(*e.columns, F.coalesce(took("messages"), zero).alias("messages"), F.when(took("priced") > 0, took("cost").cast("double")).alias("cost_usd"))


def experiment_report(e: DataFrame, m: DataFrame, name: str) -> DataFrame:
    row = e.filter(F.col("name") == name).first()
    if row is None:
        raise ValueError(f"no experiment named {name!r}")
    inside = m.filter(F.col("ts_epoch_ms") >= row["start_ms"])
    inside = inside if row["end_ms"] is None else inside.filter(F.col("ts_epoch_ms") <= row["end_ms"])
    g = inside.groupBy("model", "agent").agg(
        F.count("*").alias("messages"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")],
        F.avg("latency_ms").alias("avg_latency_ms"), *_cost())
    return _label(g, "model", "(none)").orderBy(F.desc_nulls_last("cost_usd"), "model", "agent")


def duplicates(lines: DataFrame, key: str = "dedup_key") -> DataFrame:
    return lines.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


#: The checks (D1-D7) and what a violation means.
CHECKS = {
    "unique_messages": "one response is billed once: a message id that stands under two keys was counted twice",
    "unknown_is_null": "a price that is not known is no price, and never zero",
    "zero_rated_is_zero": "what is free of charge costs nothing",
    "derived_has_version": "a derived cost names the rates that it was derived from",
    "rollup_matches": "a session costs what its messages cost",
    "offset_in_file": "a mark behind the end of its file would skip what comes next",
    "has_session": "a message without a session is in no rollup",
}


def doctor(m: DataFrame, s: DataFrame, marks: DataFrame) -> DataFrame:
    """check, violations, passed, why: one row an invariant.

    Row-wise checks are one pass over the messages; duplicates and rollups are a grouping each.
    """
    of = {
        "unknown_is_null": "cost_source = 'unknown' AND cost_usd IS NOT NULL",
        "zero_rated_is_zero": "cost_source = 'zero-rated' AND cost_usd != 0",
        "derived_has_version": "cost_source = 'derived' AND pricing_version IS NULL",
        "has_session": "session_id IS NULL OR session_id = ''",
    }
    rows = m.agg(*[F.count_if(F.expr(c)).alias(k) for k, c in of.items()]).unpivot([], list(of), "check", "violations")
    twice = m.filter("agent = 'claude-code' AND provider_msg_id IS NOT NULL").groupBy("provider_msg_id").count().filter("count > 1")
    spent = m.groupBy("agent", "session_id").agg(F.sum("cost_usd").alias("spent"))
    off = s.join(spent, ["agent", "session_id"]).filter(F.abs(F.coalesce("cost_usd", F.lit(0.0)) - F.coalesce("spent", F.lit(0.0))) > 1e-9)
    parts = {"unique_messages": twice, "rollup_matches": off, "offset_in_file": marks.filter("byte_offset > size_bytes")}
    counts = reduce(DataFrame.unionByName, [df.agg(F.lit(k).alias("check"), F.count("*").alias("violations")) for k, df in parts.items()], rows)
    why = F.create_map(*[F.lit(x) for pair in CHECKS.items() for x in pair])
    return counts.select("check", "violations", (F.col("violations") == 0).alias("passed"), why[F.col("check")].alias("why"))


def leaks(df: DataFrame, canary: str) -> DataFrame:
    """Rows of which a text column holds ``canary`` (F10): none may, as what was said is not stored."""
    texts = [F.contains(F.col(f.name), F.lit(canary)) for f in df.schema if f.dataType.simpleString() == "string"]
    return df.filter(reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for c in texts], F.lit(False)))
