"""One collector run: from files to tables.

Files are listed and compared with their marks; those with something new are read from their mark on, up to the last newline that stands
there now.  Lines become rows, rows are priced and merged, and all tables, marks included, change in one transaction.  A second run over
the same files reads nothing; a run over rewritten files reads them anew and adds no row twice.

A file is a row from listing to mark, and never one of the driver's.  A mark holds what the file has named so far (session, model), so a grown file is read from where it ended.
A file that can't be read gets a mark with the error, and the rest is stored.

What is derived follows what came: the sessions that the new messages and calls belong to, whatever their age, are read again (their buckets only), and their rollups, latencies and
nothing else are written in the same transaction.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators import derive, merge, pricing, watermarks
from meterlake.plans.store import MANY, SCHEMAS, TOLD, Store
from meterlake.sources import discovery, lines, rates, transcripts

MISSING = "<missing>"
#: Bytes that a task reads at least, and files that are taken up at once under a time budget.
TASK_BYTES, WAVE = 8 << 20, 256
TODO = "path string, inode bigint, size_bytes bigint, mtime_ns bigint, agent string, kind string, session_id string, parent_session_id string, agent_run_id string, project_slug string, decision string, start bigint"


@dataclass
class RunStats:
    run_id: str
    started_at: str
    finished_at: str | None = None
    files_scanned: int = 0
    files_read: int = 0
    files_skipped: int = 0
    files_rotated: int = 0
    bytes_read: int = 0
    lines_read: int = 0
    lines_skipped: int = 0
    messages_upserted: int = 0
    tool_calls_upserted: int = 0
    subagent_runs_upserted: int = 0
    unknown_models: list[str] = field(default_factory=list)
    partial: bool = False
    duration_ms: int = 0
    query_id: str | None = None
    batch: int | None = None
    began: float = field(default_factory=time.monotonic)

    def row(self) -> dict:
        out = asdict(self) | {"unknown_models": json.dumps(self.unknown_models), "partial": int(self.partial)}
        out.pop("files_skipped")
        out.pop("began")
        return out

    def end(self) -> None:
        self.finished_at, self.duration_ms = now_iso(), max(1, int((time.monotonic() - self.began) * 1000))


def now_iso() -> str:
    return datetime.now(UTC).isoformat()


def priced(messages: DataFrame, card: rates.RateCard) -> DataFrame:
    """Adds cost_usd, cost_source, pricing_version and derived_cost_usd."""
    p = pricing.price(messages, card.rates, card.aliases, card.version)
    return p.withColumn("derived_cost_usd", F.when(F.col("cost_source").isin("derived", "zero-rated"), F.col("cost_usd")))


def unknown_models(messages: DataFrame) -> DataFrame:
    """Distinct models without a price (C4); a missing one has a name of its own."""
    return messages.filter("cost_source = 'unknown'").select(F.coalesce(F.nullif("model", F.lit("")), F.lit(MISSING)).alias("model")).distinct()


@dataclass(frozen=True)
class Roots:
    projects_dir: str
    sessions_dir: str
    history_path: str

    def all(self) -> list[str]:
        return [self.projects_dir, self.sessions_dir, self.history_path]


#: Which parser reads which kinds of files: typed lines, then messages and halves of calls of these, and helper runs of these and their messages.
DIALECTS = {"claude": ("claude_session", "claude_subagent"), "pi": ("pi_session", "pi_subagent_session"), "history": ("pi_run_history",)}
PARSERS = {"claude": (transcripts.claude_lines, transcripts.claude_messages, transcripts.claude_tool_calls, lambda typed, said: transcripts.runs_of_messages(said)),
           "pi": (transcripts.pi_lines, transcripts.pi_messages, transcripts.pi_tool_calls, None), "history": (transcripts.history_lines, None, None, lambda typed, said: transcripts.history_runs(typed))}


def ingest(store: Store, read: dict[str, DataFrame], files: DataFrame, card: rates.RateCard, stats: RunStats, max_skipped: int = 1000) -> None:
    """Lines (path, end_offset, raw) of each dialect's ``files`` into the tables, in one transaction.

    ``files``: path, agent, kind, session_id, parent_session_id, agent_run_id, project_slug, inode, size_bytes, mtime_ns, start (from where on the file was read), reset (it was read anew).
    """
    spark, now = store.spark, now_iso()
    seq = store._manifest()[0] + 1
    with store.laying() as laid:
        at = files.agg(F.collect_set(store.bucket("ingest_files")).alias("paths"), F.collect_set("kind").alias("kinds")).first()
        paths, kinds = at["paths"], {*at["kinds"]}
        marks = store.raw("ingest_files", paths)
        seeds = marks.select("path", F.col("seed").alias("before"))
        of = files.join(seeds, "path", "left").withColumn("seed", F.when(F.col("start") > 0, F.col("before"))).drop("before", "inode", "size_bytes", "mtime_ns", "reset", "start")
        typed = {k: laid(f(read[k].join(of.filter(F.col("kind").isin(*DIALECTS[k])), "path"))) for k, (f, *_) in PARSERS.items() if kinds & {*DIALECTS[k]}}
        bad = laid(reduce(DataFrame.unionByName, [t.filter("error IS NOT NULL").select("path", "error") for t in typed.values()]).groupBy("path").agg(F.min("error").alias("error")))
        failed = bad.count()
        if failed:  # nothing of a file that was read in part
            typed = {k: t.join(bad, "path", "left_anti") for k, t in typed.items()}
        ends = [t.groupBy("path").agg(F.max("end_offset").alias("byte_offset"), F.count_if("line").alias("lines_ingested"), F.count_if("skipped").alias("lines_skipped")) for t in typed.values()]

        # of the copies of a key the first in order is new, if none is stored; only buckets that may hold one of these keys are read
        rows = lambda i, schema, *more: reduce(DataFrame.unionByName, [PARSERS[k][i](t, *[m[k] for m in more]) for k, t in typed.items() if PARSERS[k][i]] or [store.none(schema)])
        said = laid(rows(1, transcripts.MESSAGE_ROW))
        messages = priced(said, card).withColumnsRenamed({"source_kind": "order_kind"})
        first = merge.first_of(messages.drop("path"), ["order_kind", "source_file", "end_offset"])
        stored = store.raw("message_keys", store.buckets_of("message_keys", said))
        new = laid(first.join(stored, "dedup_key", "left_anti").withColumn("ingested_at", F.lit(now)))
        told = {"seq": F.lit(seq), "ingested_at": F.lit(now)}
        calls = laid(rows(2, transcripts.CALL_ROW).withColumns(told))
        runs = rows(3, transcripts.RUN_ROW, {k: said.filter(F.col("source_kind").isin(*kinds)) for k, kinds in DIALECTS.items()}).withColumns(told)
        touched = laid(new.select("agent", "session_id").unionByName(calls.select("agent", "session_id")).distinct())
        made = derived(store, new, calls, touched, laid)
        zero = F.lit(0).cast("long")
        many = F.when(F.col("lines_skipped") > max_skipped, F.concat(F.col("lines_skipped").cast("string"), F.lit(" lines could not be parsed")))
        marked = files.join(reduce(DataFrame.unionByName, ends), "path", "left").join(transcripts.pi_state(typed["pi"]) if "pi" in typed else seeds.select("path", F.lit(None).cast(transcripts.SEED).alias("seed")), "path", "left").join(bad, "path", "left").join(seeds, "path", "left")
        marked = laid(marked.withColumns({
            "byte_offset": F.coalesce("byte_offset", "start"), "lines_ingested": F.coalesce("lines_ingested", zero), "lines_skipped": F.coalesce("lines_skipped", zero),
            "last_error": F.coalesce("error", many), "reset": F.col("reset") & F.col("error").isNull(), "source_kind": F.col("kind"),
            "seed": F.when(F.col("error").isNull(), F.coalesce("seed", F.when(F.col("start") > 0, F.col("before")))).otherwise(F.col("before")),
            "first_ingested_at": F.lit(now), "last_ingested_at": F.lit(now)}))
        with store.transaction() as w:
            messages_n, _, _, calls_n, runs_n, *_ = w.together(
                lambda: w.append("messages", made["messages"]), lambda: w.append("message_keys", new.select("dedup_key")), lambda: w.append("latency_fixes", made["fixes"].withColumn("seq", F.lit(seq))),
                lambda: w.append("tool_calls", calls), lambda: w.append("subagent_runs", runs), lambda: w.replace_buckets("ingest_files", merge.merge_marks(marks, marked), paths),
                *([lambda: w.replace_buckets("sessions", made["sessions"], made["buckets"])] if made["buckets"] else []))
            stats.messages_upserted, stats.tool_calls_upserted, stats.subagent_runs_upserted = stats.messages_upserted + messages_n, stats.tool_calls_upserted + calls_n, stats.subagent_runs_upserted + runs_n
            sums = marked.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("lines_ingested", "lines_skipped")], F.coalesce(F.sum(F.col("byte_offset") - F.col("start")), F.lit(0))).first()
            stats.lines_read, stats.lines_skipped, stats.bytes_read = stats.lines_read + sums[0], stats.lines_skipped + sums[1] + failed, stats.bytes_read + sums[2]
            stats.unknown_models = sorted({*stats.unknown_models, *[r["model"] for r in unknown_models(messages).collect()]})  # names of models, each once
            stats.end()
            w.append("ingest_runs", spark.createDataFrame([stats.row()], SCHEMAS["ingest_runs"]))


def derived(store: Store, new: DataFrame, calls: DataFrame, touched: DataFrame, laid: Callable[[DataFrame], DataFrame]) -> dict:
    """What ``new`` messages and halves of ``calls`` change: messages (``new`` with latency_ms), fixes (stored messages whose latency is another now), sessions (all rows of ``buckets``), buckets.

    Stored rows of the ``touched`` sessions (agent, session_id) are read from their buckets alone, in the columns that are timed or summed; ``laid`` holds what is timed.
    """
    keys = ["agent", "session_id"]
    buckets = store.buckets_of("sessions", touched)
    now = F.lit(now_iso())
    of = lambda df: df.join(touched, keys, "left_semi")
    if not buckets:
        return {"messages": new, "fixes": store.raw("latency_fixes").limit(0), "buckets": []}
    old = of(store.table("messages", buckets).select(*derive.TIMED, "latency_ms")).withColumns({"was": F.col("latency_ms"), "stored": F.lit(True)})
    every = old.unionByName(new.withColumn("stored", F.lit(False)), allowMissingColumns=True)
    timed = laid(derive.latency(every))
    told = ("dedup_key", *keys, "is_error", *TOLD)
    halves = of(store.raw("tool_calls", buckets).select(*told)).unionByName(calls.select(*told))
    summed = of(store.raw("messages", buckets).select(*derive.SUMMED)).unionByName(new.select(*derive.SUMMED))
    sessions = derive.sessions(summed, merge.outcomes(halves, TOLD)).withColumns({"updated_at": now, "shipped_at": F.lit(None).cast("string")})
    before = store.raw("sessions", buckets)
    return {"messages": timed.filter("NOT stored"), "fixes": timed.filter("stored AND NOT latency_ms <=> was").select(*keys, "dedup_key", "latency_ms"), "buckets": buckets,
            "sessions": merge.replace_rows(before, sessions.select(*before.columns), keys)}


def rebuild(store: Store) -> None:
    """All session rows and latencies anew, from all messages."""
    m, calls = store.table("messages"), store.table("tool_calls")
    made = derive.sessions(m, calls).withColumns({"updated_at": F.lit(now_iso()), "shipped_at": F.lit(None).cast("string")}).select(*store.raw("sessions").columns)
    timed = derive.latency(m.withColumn("was", F.col("latency_ms"))).filter("NOT latency_ms <=> was")
    with store.transaction() as w:
        w.replace_buckets("sessions", merge.replace_rows(store.raw("sessions"), made, ["agent", "session_id"]), list(range(store.buckets)))
        w.append("latency_fixes", timed.select("agent", "session_id", "dedup_key", "latency_ms").withColumn("seq", F.lit(store._manifest()[0] + 1)))


def collect(store: Store, roots: Roots, card: rates.RateCard, max_files: int = 0, max_seconds: int = 0, full_rebuild: bool = False, max_skipped: int = 1000) -> RunStats:
    """One run. With ``max_files`` it reads a prefix of the files in order; with ``max_seconds`` it stops taking up files, ``WAVE`` at a time."""
    spark = store.spark
    stats = RunStats(f"run_{uuid.uuid4().hex[:16]}", now_iso())
    listed = discovery.classify(discovery.listing(spark, *roots.all()), roots.projects_dir, roots.sessions_dir, roots.history_path)
    at = f"{store.root}/_todo/{stats.run_id}"
    listed.join(watermarks.decide(listed, store.raw("ingest_files")), "path").select(*[c.split()[0] for c in TODO.split(", ")]).coalesce(4).write.parquet(at)
    try:
        seen = spark.read.schema(TODO).parquet(at)  # one state of the file system for all that follows
        n = {r["decision"]: (r["n"], r["bytes"]) for r in seen.groupBy("decision").agg(F.count("*").alias("n"), F.sum(F.col("size_bytes") - F.col("start")).alias("bytes")).collect()}
        stats.files_scanned, stats.files_skipped = sum(x for x, _ in n.values()), n.pop("unchanged", (0, 0))[0]
        due, size = sum(x for x, _ in n.values()), sum(x for _, x in n.values())
        todo = seen.filter("decision != 'unchanged'")
        most = min(due, max_files or due)
        waves = range(0, most, WAVE) if max_seconds else [0] if due else []
        for a in waves:
            if max_seconds and time.monotonic() - stats.began >= max_seconds:
                break
            b = min(most, a + WAVE) if max_seconds else most
            files = todo if b - a == due else discovery.ordered(todo).offset(a).limit(b - a)
            files = files.withColumn("reset", ~F.col("decision").isin("appended", "new"))
            if b - a < due:
                files = files.persist()
            stats.files_read = b
            stats.files_rotated += files.filter("decision = 'rotated'").count() if n.get("rotated") else 0
            stats.partial = b < due
            tasks = max(1, min(-(-size // TASK_BYTES), 1 << 16))
            read = {k: lines.read_files(files.filter(F.col("kind").isin(*kinds)), tasks) for k, kinds in DIALECTS.items()}
            ingest(store, read, files.drop("decision"), card, stats, max_skipped)
        stats.partial = stats.files_read < due
        if not stats.files_read:
            stats.end()
            with store.transaction() as w:
                w.append("ingest_runs", spark.createDataFrame([stats.row()], SCHEMAS["ingest_runs"]))
    finally:
        store._fs.delete(store._path(at), True)
    if full_rebuild:
        rebuild(store)
    store.compact(MANY)
    return stats
