"""The parsers, keys and merges over the bridge's lines, and what they give in SQL.

The SQL doesn't parse: the lines are made of events by rules (``bridge``), so what must come out follows from the events by arithmetic.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import keys
from meterlake.operators import derive, merge, reports, watermarks
from meterlake.plans import bridge as b
from meterlake.plans import ingest
from meterlake.plans.store import Store
from meterlake.sources import discovery, rates
from meterlake.sources import transcripts as t
from meterlake.streaming import tail

MESSAGE = [c for c in t.MESSAGE if c not in ("spawn_depth", "parent_session_id", "git_branch")]


def claude(s: SparkSession, d: str) -> DataFrame:
    return t.claude_lines(b.view(s, d, b.CLAUDE_LINES))


def pi(s: SparkSession, d: str) -> DataFrame:
    return t.pi_lines(b.view(s, d, b.PI_LINES))


def history(s: SparkSession, d: str) -> DataFrame:
    return t.history_lines(b.view(s, d, b.HISTORY_LINES))


def stored_calls(s: SparkSession, d: str) -> DataFrame:
    """Halves of calls in three runs: what is stored, calls, and results, some of which say what is known already, or nothing."""
    c = b.view(s, d, b.TOOL_CALLS)
    none = lambda kind: F.lit(None).cast(kind)
    cols = ("dedup_key", "agent", "session_id", "agent_run_id", "tool_name", "ts_epoch_ms", "result_ts_epoch_ms", "is_error", "duration_ms", "seq")
    stored = c.filter("id % 10 = 1").select("dedup_key", "agent", none("string").alias("session_id"), none("string").alias("agent_run_id"), F.lit("old").alias("tool_name"), none("bigint").alias("ts_epoch_ms"),
                                            none("bigint").alias("result_ts_epoch_ms"), none("boolean").alias("is_error"), F.lit(7).cast("bigint").alias("duration_ms"), F.lit(1).alias("seq"))
    call = c.select("dedup_key", "agent", "session_id", none("string").alias("agent_run_id"), "tool_name", "ts_epoch_ms", none("bigint").alias("result_ts_epoch_ms"),
                    none("boolean").alias("is_error"), none("bigint").alias("duration_ms"), F.lit(2).alias("seq"))
    result = c.filter("duration_ms IS NOT NULL").select("dedup_key", F.lit("other").alias("agent"), F.lit("other").alias("session_id"), F.concat(F.lit("run"), F.col("id") % 3).alias("agent_run_id"),
                                                        none("string").alias("tool_name"), (F.col("ts_epoch_ms") + 1).alias("ts_epoch_ms"),
                                                        (F.col("ts_epoch_ms") + F.col("duration_ms")).alias("result_ts_epoch_ms"), "is_error", none("bigint").alias("duration_ms"), F.lit(3).alias("seq"))
    return stored.unionByName(call).unionByName(result).select(*cols)


def u2_merge_calls(s: SparkSession, d: str) -> DataFrame:
    return merge.merge_calls(stored_calls(s, d)).drop("seq")


def u3_merge_runs(s: SparkSession, d: str) -> DataFrame:
    """Each helper's runs in the order of their files; the second half says its status and model, and nothing of its type."""
    typed = claude(s, d)
    first = t.claude_subagent_runs(typed).withColumn("seq", F.lit(1))
    later = first.withColumns({"seq": F.lit(2), "status": F.lit("done"), "agent_type": F.lit(None).cast("string"), "model": F.when(F.col("end_offset") % 20 < 10, "model-z"), "started_at": F.lit("later")})
    m = merge.merge_runs(first.unionByName(later), ["seq", "path", "end_offset"])
    return m.select("dedup_key", "parent_session_id", "agent_run_id", "agent_type", "started_at", "status", "model", "source_file")


def u4_replace(s: SparkSession, d: str) -> DataFrame:
    stored = b.view(s, d, b.MESSAGES).filter("ts_epoch_ms % 3 <> 0").select("agent", "session_id", "total_tokens").groupBy("agent", "session_id").agg(F.sum("total_tokens").alias("total_tokens"))
    new = b.view(s, d, b.MESSAGES).filter("agent = 'pi'").groupBy("agent", "session_id").agg(F.sum("total_tokens").alias("total_tokens"))
    return merge.replace_rows(stored, new, ["agent", "session_id"])


def u5_marks(s: SparkSession, d: str) -> DataFrame:
    """Marks of a second run over files in all states; of those without an end of the last line there is no mark yet, and nothing is said of unchanged ones."""
    said = lambda df, at, lines, skipped: df.withColumns({
        "agent": F.lit("pi"), "source_kind": F.lit("pi_session"), "lines_ingested": lines, "lines_skipped": skipped, "first_ingested_at": F.lit(at), "last_ingested_at": F.lit(at), "last_error": F.lit(None).cast("string")})
    old = said(b.view(s, d, b.MARKS), "t0", F.col("lines_ingested"), F.col("lines_skipped"))
    listing = b.view(s, d, b.LISTING)
    new = said(listing.join(watermarks.decide(listing, old), "path").withColumns({"byte_offset": F.col("size_bytes"), "reset": F.col("decision").isin("rotated", "truncated", "rewritten")}), "t1",
               F.lit(5).cast("bigint"), F.lit(2).cast("bigint"))
    held = old.filter("byte_offset = size_bytes")
    return merge.merge_marks(held, new.filter("decision != 'unchanged'")).select("path", "inode", "byte_offset", "lines_ingested", "lines_skipped", "first_ingested_at", "last_ingested_at")


def u6_meta(s: SparkSession, d: str) -> DataFrame:
    """A key a user; those with an error have a later value."""
    m = b.view(s, d, b.MESSAGES).groupBy("session_id").agg(F.max("dedup_key").alias("last"), F.max(F.when(F.col("kind") == "compaction", F.col("dedup_key"))).alias("late"))
    kv = lambda c: m.filter(F.col(c).isNotNull()).select(F.concat(F.lit("k"), "session_id").alias("key"), F.concat(F.lit(c), F.col(c)).alias("value"))
    return merge.replace_rows(kv("last"), kv("late"), ["key"])


def keys_of(s: SparkSession, d: str) -> DataFrame:
    e = b.view(s, d, b.MESSAGES).select("dedup_key", "session_id", "agent_run_id", "model", "ts", "total_tokens")
    return e.select("dedup_key", keys.message_key("dedup_key", "agent_run_id").alias("message"), keys.pi_message_key("dedup_key", "ts", "model", "total_tokens").alias("pi_message"),
                    keys.pi_compaction_key("dedup_key", "ts", "model").alias("pi_compaction"), keys.tool_call_key(F.lit("pi"), "session_id", "agent_run_id").alias("tool_call"),
                    keys.run_history_key("agent_run_id", "ts", "total_tokens", "model").alias("run_history"), keys.subagent_key("session_id", "agent_run_id").alias("subagent"),
                    keys.pi_subagent_key("session_id", "agent_run_id").alias("pi_subagent"))


def p10_meta(s: SparkSession, d: str) -> DataFrame:
    raw = b.view(s, d, b.MESSAGES).select("dedup_key", F.when(F.col("agent") == "pi", F.lit("[1]")).otherwise(F.concat(
        F.lit('{"agentType":"'), F.col("kind"), F.lit('","description":"CANARY'), F.col("session_id"), F.lit('","toolUseId":"t1","spawnDepth":2}'))).alias("raw"))
    m = raw.select("dedup_key", t.meta(F.col("raw")).alias("m"))
    return m.select("dedup_key", "m.agent_type", "m.tool_use_id", "m.spawn_depth", "m.model", F.col("m.task.sha256").alias("task_sha256"), F.col("m.task.length").alias("task_len"))


def c4_unknown(s: SparkSession, d: str) -> DataFrame:
    from meterlake.plans.queries import priced

    return ingest.unknown_models(priced(s, d))


def f6_recent(s: SparkSession, d: str) -> DataFrame:
    return derive.recent(b.view(s, d, b.MESSAGES), 1706500000000).select("dedup_key", "agent", "session_id")


def f10_leaks(s: SparkSession, d: str) -> DataFrame:
    """Rows that hold what was said: none of the parsers', all lines that said it.

    Typed lines are written once and read by the three tables that come of them, which would each parse all lines again; they are deleted when the counts are there.
    """
    at = scratch(s)

    def laid(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return s.read.schema(df.schema).parquet(f"{at}/{name}")

    folder = s._jvm.org.apache.hadoop.fs.Path(f"{at}/typed")
    try:
        typed, p = laid(claude(s, d), "typed/claude"), laid(pi(s, d), "typed/pi")
        found = {"lines": b.view(s, d, b.CLAUDE_LINES), "messages": t.claude_messages(typed).unionByName(t.pi_messages(p)), "tool_calls": t.claude_tool_calls(typed).unionByName(t.pi_tool_calls(p)),
                 "runs": t.claude_subagent_runs(typed).unionByName(t.history_runs(history(s, d)))}
        out = [reports.leaks(df, "CANARY").agg(F.lit(k).alias("table"), F.count("*").alias("leaks")) for k, df in found.items()]
        return laid(out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]), "leaks")
    finally:
        folder.getFileSystem(s._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def scratch(s: SparkSession) -> str:
    """A folder that all executors share: where ``spark.checkpoint.dir`` says, or one of our own where all runs in one process (tests)."""
    if named := s.conf.get("spark.checkpoint.dir", None):
        return f"{named.rstrip('/')}/meterlake-{uuid.uuid4().hex}"
    if not s.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="meterlake-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def t3_replay(s: SparkSession, d: str) -> DataFrame:
    """Three micro-batches in an order that makes lines late, each given twice: messages, tokens and latencies of each session are those of its lines, once."""
    store = Store(s, scratch(s), buckets=8)
    said = b.view(s, d, b.CLAUDE_LINES).withColumn("of", F.expr("event_id div 2 % 3")).select(F.concat(F.lit("/c/slug/"), "path", F.lit(".jsonl")).alias("path"), "end_offset", "raw", "of")
    card = rates.RateCard(b.VERSION, b.constant(s, b.RATES), b.constant(s, b.ALIASES), 2, 3)
    for number, of in enumerate((2, 0, 1)):
        for _ in range(2):
            tail.take_batch(store, ingest.Roots("/c", "/s", "/h"), card, said.filter(F.col("of") == of).drop("of").withColumn("start", F.lit(number).cast("long")), number, "t3_replay", held=False)
    m = store.table("messages").groupBy("session_id").agg(F.count("*").alias("messages"), F.sum("total_tokens").alias("total_tokens"), F.sum("latency_ms").alias("latency_ms"), F.count("latency_ms").alias("timed"))
    return m.join(store.raw("sessions").select("session_id", "message_count", "subagent_message_count"), "session_id")


def paths(s: SparkSession, d: str) -> DataFrame:
    return discovery.classify(b.view(s, d, b.PATHS).select("path"), "/c", "/s", "/h/run-history.jsonl")


QUERIES = {
    "p3_claude_counters": lambda s, d: t.counters(claude(s, d)),
    "p6_claude_messages": lambda s, d: t.claude_messages(claude(s, d)).select(*MESSAGE),
    "p4_claude_calls": lambda s, d: t.claude_tool_calls(claude(s, d)).select("dedup_key", "session_id", "agent_run_id", "tool_use_id", "tool_name", "ts_epoch_ms", "result_ts_epoch_ms", "is_error", "end_offset"),
    "p9_claude_runs": lambda s, d: t.claude_subagent_runs(claude(s, d)).select("dedup_key", "parent_session_id", "agent_run_id", "agent_type", "started_at", "model", "source_file"),
    "p10_meta": p10_meta,
    "p13_pi_state": lambda s, d: pi(s, d).select("path", "end_offset", "session_id", "cwd", "model", "active_provider"),
    "p15_pi_counters": lambda s, d: t.counters(pi(s, d)),
    "p18_pi_messages": lambda s, d: t.pi_messages(pi(s, d)).select(*MESSAGE),
    "p17_pi_calls": lambda s, d: t.pi_tool_calls(pi(s, d)).select("dedup_key", "session_id", "agent_run_id", "tool_use_id", "tool_name", "ts_epoch_ms", "result_ts_epoch_ms", "is_error", "end_offset"),
    "p21_run_history": lambda s, d: t.history_runs(history(s, d)).select("dedup_key", "agent_type", "task_sha256", "task_len", "started_at", "ended_at", "duration_ms", "status", "exit_code"),
    "s5_discover": paths,
    "o3_budget": lambda s, d: discovery.prefix(paths(s, d), 50).select("kind", "path"),
    "t3_replay": t3_replay,
    "u2_merge_calls": u2_merge_calls,
    "u3_merge_runs": u3_merge_runs,
    "u4_replace": u4_replace,
    "u5_marks": u5_marks,
    "u6_meta": u6_meta,
    "k_dedup_keys": keys_of,
    "c4_unknown": c4_unknown,
    "f6_recent": f6_recent,
    "f10_leaks": f10_leaks,
    "w2_latency_only_null": lambda s, d: derive.latency(b.view(s, d, b.MESSAGES).withColumn("latency_ms", F.when(F.col("total_tokens") % 3 == 0, -1).cast("bigint")), only_null=True).select("dedup_key", "latency_ms"),
}


def _hash(*parts: str) -> str:
    return f"left(sha256(concat_ws(chr(31), {', '.join(f'coalesce(CAST({p} AS varchar), chr(0))' for p in parts)})), 32)"


def _oracles() -> dict[str, str]:
    f = lambda x: b.fill(x, b.DUCK)
    ms = "CAST(1704067200000 + ((event_id % 24) * 60 + event_id % 60) * 60000 + (k % 60) * 1000 + event_id % 1000 - CASE WHEN event_id % 7 = 0 THEN 7200000 ELSE 0 END AS bigint)"
    claude = f"""WITH cl AS (SELECT *, CAST({ms} AS bigint) AS t, {f(b._TIME)} AS ts FROM ({f(b.CLAUDE_LINES)}) x),
    cf AS (SELECT *, event_id % 17 = 0 AND n = 1 OR event_id % 29 = 0 AND n = 2 AS bad, event_id % 31 = 0 AND event_id % 29 <> 0 AND n = 2 AS other, event_id % 19 <> 0 AS sess, event_id % 23 <> 0 AS timed FROM cl),
    ok AS (SELECT * FROM cf WHERE NOT bad AND NOT other AND sess),
    cm AS (SELECT *, 'm' || (event_id - event_id % 2) AS mid, CASE WHEN event_type = 'view' THEN 'run' || (user_id % 5) END AS run, k % 11 AS w,
      CASE WHEN event_id % 5 >= 2 THEN k % 7 ELSE k % 11 END AS w5, CASE WHEN event_id % 5 >= 2 THEN k % 4 ELSE 0 END AS w1,
      row_number() OVER (PARTITION BY path, event_id - event_id % 2 ORDER BY end_offset) AS rn FROM ok WHERE n <> 3 AND timed),
    c1 AS (SELECT *, CASE WHEN w = 0 THEN w5 + w1 ELSE w END AS cw FROM cm WHERE rn = 1),
    runs AS (SELECT *, row_number() OVER (PARTITION BY path, run ORDER BY end_offset) AS rr FROM c1 WHERE run IS NOT NULL),
    sub AS (SELECT 'sa:s' || user_id || '|' || run AS dedup_key, 's' || user_id AS parent_session_id, run AS agent_run_id, 'Explore' AS agent_type, ts AS started_at, 'model-' || (k % 4) AS model, path AS source_file,
      end_offset FROM runs WHERE rr = 1)"""
    pi = f"""WITH pl AS (SELECT *, {ms} AS t, {f(b._TIME)} AS ts, event_id % 37 <> 0 AS good, event_id % 13 <> 0 AS has_id FROM ({f(b.PI_LINES)}) x),
    p1 AS (SELECT * REPLACE (last_value(CASE WHEN event_type = 'signup' AND good AND has_id THEN 'e' || event_id END IGNORE NULLS) OVER w AS session_id),
      last_value(CASE WHEN event_type = 'signup' AND good THEN '/w' || (k % 3) END IGNORE NULLS) OVER w AS cwd FROM pl WINDOW w AS (PARTITION BY path ORDER BY end_offset ROWS UNBOUNDED PRECEDING)),
    p2 AS (SELECT *, good AND event_type IN ('error', 'click', 'view') AS entry, session_id IS NOT NULL AND has_id AS whole FROM p1),
    p3 AS (SELECT *, entry AND whole AND event_type = 'view' AND event_id % 5 <> 0 AS billed FROM p2),
    ps AS (SELECT *, last_value(CASE WHEN good AND event_type = 'purchase' AND event_id % 4 <> 0 THEN 'pm' || (k % 5) WHEN billed AND event_id % 3 <> 0 THEN 'pm' || (k % 6) END IGNORE NULLS) OVER w AS model,
      last_value(CASE WHEN good AND event_type = 'purchase' THEN 'pr' || (k % 2) END IGNORE NULLS) OVER w AS active_provider
      FROM p3 WINDOW w AS (PARTITION BY path ORDER BY end_offset ROWS UNBOUNDED PRECEDING)),
    pm AS (SELECT *, event_type = 'error' AS comp, CASE WHEN event_type = 'view' THEN k % 9 ELSE 0 END AS w, CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN k % 3 ELSE 0 END AS w1,
      CASE WHEN event_type = 'view' THEN k * 9 WHEN event_id % 2 = 0 THEN k ELSE 0 END AS i, CASE WHEN event_type = 'view' THEN k WHEN event_id % 2 = 0 THEN 5 ELSE 0 END AS o,
      CASE WHEN event_type = 'view' THEN k % 8 ELSE 0 END AS r, CASE WHEN event_type = 'view' AND event_id % 7 <> 1 THEN k * 11 ELSE 0 END AS tt FROM ps WHERE billed OR (entry AND whole AND event_type = 'error')),
    pn AS (SELECT *, CASE WHEN w1 <> 0 THEN greatest(w - w1, 0) ELSE w END AS w5 FROM pm),
    po AS (SELECT *, CASE WHEN w = 0 THEN w5 + w1 ELSE w END AS cw FROM pn), pp AS (SELECT *, CASE WHEN tt = 0 THEN i + o + r + cw ELSE tt END AS total FROM po)"""
    found = f"""WITH ps AS ({f(b.PATHS)}), found AS (SELECT path, CASE WHEN st < 7 THEN 'claude-code' ELSE 'pi' END AS agent,
      CASE st WHEN 0 THEN 'claude_session' WHEN 7 THEN 'pi_session' WHEN 9 THEN 'pi_subagent_session' WHEN 11 THEN 'pi_subagent_session' ELSE 'claude_subagent' END AS kind,
      CASE WHEN st < 7 THEN 's' || event_id WHEN st = 7 THEN '019f-' || event_id END AS session_id, CASE WHEN st IN (1, 2, 6) THEN 's' || event_id WHEN st = 9 THEN '019f-' || event_id END AS parent_session_id,
      CASE st WHEN 1 THEN '' || k WHEN 2 THEN 'x-' || k WHEN 6 THEN 'Agent-' || k WHEN 9 THEN 'call_' || k WHEN 11 THEN 'call_' || event_id END AS agent_run_id, 'slug' || (user_id % 3) AS project_slug
      FROM (SELECT *, event_id % 13 AS st FROM ps) x WHERE st IN (0, 1, 2, 6, 7, 9, 11))"""
    msg, call = f"WITH msg AS ({f(b.MESSAGES)})", f"WITH tc AS ({f(b.TOOL_CALLS)})"
    out = {
        "p3_claude_counters": claude + " SELECT path, count(*) AS lines_read, count(*) FILTER (WHERE bad OR (NOT other AND (NOT sess OR (n <> 3 AND NOT timed)))) AS lines_skipped FROM cf GROUP BY path",
        "p6_claude_messages": claude + """ SELECT 'cc:' || mid || '|r' || (event_id % 3) AS dedup_key, 'claude-code' AS agent, 'assistant' AS kind, 's' || user_id AS session_id, run AS agent_run_id,
          CASE WHEN run IS NOT NULL THEN 'Explore' END AS subagent_type, run IS NOT NULL AS is_sidechain, path AS source_file, 'u' || event_id || '-' || n AS source_entry_id, mid AS provider_msg_id,
          'r' || (event_id % 3) AS request_id, CAST(NULL AS varchar) AS parent_entry_id, '/home' AS cwd, 'slug' AS project_slug, '1.' || (k % 3) AS agent_version, ts, t AS ts_epoch_ms, 'model-' || (k % 4) AS model,
          CAST(NULL AS varchar) AS response_model, 'anthropic' AS provider, CAST(NULL AS varchar) AS api, 'end' AS stop_reason, k * 10 AS input_tokens, k * 3 AS output_tokens, CAST(0 AS bigint) AS reasoning_tokens,
          k % 50 AS cache_read_tokens, w5 AS cache_write_5m_tokens, w1 AS cache_write_1h_tokens, cw AS cache_write_tokens, k * 13 + k % 50 + cw AS total_tokens, k * 10 + k % 50 + cw AS context_tokens,
          CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS bigint) AS retry_count, CASE WHEN event_type = 'error' THEN 'ttl' END AS cache_miss_reason, CAST(NULL AS double) AS reported_cost_usd FROM c1""",
        "p4_claude_calls": claude + """ SELECT 'tc:claude-code|s' || user_id || '|t' || event_id AS dedup_key, 's' || user_id AS session_id, CASE WHEN n = 2 AND event_type = 'view' THEN 'run' || (user_id % 5) END AS agent_run_id,
          't' || event_id AS tool_use_id, CASE WHEN n = 2 THEN event_type END AS tool_name, CASE WHEN n = 2 AND timed THEN t END AS ts_epoch_ms, CASE WHEN n = 3 AND timed THEN t END AS result_ts_epoch_ms,
          CASE WHEN n = 3 THEN event_id % 3 <> 0 AND event_type = 'error' END AS is_error, end_offset FROM ok WHERE n > 1""",
        "p9_claude_runs": claude + " SELECT * EXCLUDE (end_offset) FROM sub",
        "u3_merge_runs": claude + """ SELECT dedup_key, min_by(parent_session_id, (path_, end_offset)) AS parent_session_id, min_by(agent_run_id, (path_, end_offset)) AS agent_run_id, 'Explore' AS agent_type,
          min_by(started_at, (path_, end_offset)) AS started_at, 'done' AS status,
          coalesce(max_by(CASE WHEN end_offset % 20 < 10 THEN 'model-z' END, (path_, end_offset)) FILTER (WHERE end_offset % 20 < 10), max_by(model, (path_, end_offset))) AS model,
          min_by(source_file, (path_, end_offset)) AS source_file FROM (SELECT *, source_file AS path_ FROM sub) z GROUP BY dedup_key""",
        "p13_pi_state": pi + " SELECT path, end_offset, session_id, cwd, model, active_provider FROM ps",
        "p15_pi_counters": pi + " SELECT path, count(*) AS lines_read, count(*) FILTER (WHERE NOT good OR (entry AND NOT whole)) AS lines_skipped FROM p2 GROUP BY path",
        "p18_pi_messages": pi + f""" SELECT CASE WHEN comp THEN 'pic:' || {_hash("'e' || event_id", 'ts', 'k * 100')} ELSE 'pi:' || {_hash("'e' || event_id", 'ts', 'model', 'total')} END AS dedup_key, 'pi' AS agent,
          CASE WHEN comp THEN 'compaction' ELSE 'assistant' END AS kind, session_id, agent_run_id, CAST(NULL AS varchar) AS subagent_type, agent_run_id IS NOT NULL AS is_sidechain, path AS source_file,
          'e' || event_id AS source_entry_id, CAST(NULL AS varchar) AS provider_msg_id, CAST(NULL AS varchar) AS request_id, 'e' || (event_id - 1) AS parent_entry_id, cwd, 'slug' AS project_slug,
          CAST(NULL AS varchar) AS agent_version, ts, t AS ts_epoch_ms, model, CAST(NULL AS varchar) AS response_model, CASE WHEN comp THEN active_provider ELSE 'pq' END AS provider, CAST(NULL AS varchar) AS api,
          CASE WHEN comp THEN 'compaction:read=2,modified=' || CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END END AS stop_reason, i AS input_tokens, o AS output_tokens, CASE WHEN comp THEN 0 ELSE k % 5 END AS reasoning_tokens,
          r AS cache_read_tokens, w5 AS cache_write_5m_tokens, w1 AS cache_write_1h_tokens, cw AS cache_write_tokens, total AS total_tokens, CASE WHEN comp THEN k * 100 ELSE i + r + cw END AS context_tokens,
          CAST(0 AS bigint) AS retry_count, CAST(NULL AS varchar) AS cache_miss_reason, CAST(CASE WHEN comp AND event_id % 2 = 0 THEN 0.25 WHEN NOT comp AND event_id % 4 = 1 THEN 0.5 END AS double) AS reported_cost_usd FROM pp""",
        "p17_pi_calls": pi + """ SELECT 'tc:pi|' || session_id || '|c' || c AS dedup_key, session_id, agent_run_id, 'c' || c AS tool_use_id, 'bash' AS tool_name, CASE WHEN event_type = 'view' THEN t END AS ts_epoch_ms,
          CASE WHEN event_type = 'click' THEN t END AS result_ts_epoch_ms, CASE WHEN event_type = 'click' THEN k % 2 = 0 END AS is_error, end_offset
          FROM (SELECT *, CASE WHEN event_type = 'click' THEN event_id - 1 ELSE event_id END AS c FROM p2 WHERE entry AND whole AND event_type <> 'error') z""",
        "p21_run_history": f"""WITH h AS ({f(b.HISTORY_LINES)}), g AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'ok' ELSE 'failed' END AS st, CASE WHEN event_id % 6 <> 0 THEN k * 1000 END AS du FROM h WHERE event_id % 41 <> 0 AND event_id % 11 <> 0)
          SELECT 'rh:' || {_hash('event_type', '1704067200 + event_id', 'du', 'st')} AS dedup_key, event_type AS agent_type, left(sha256('CANARY ' || k), 16) AS task_sha256, CAST(length('CANARY ' || k) AS bigint) AS task_len,
          strftime(make_timestamp((1704067200 + event_id) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS started_at,
          CASE WHEN du IS NOT NULL THEN strftime(make_timestamp((1704067200 + event_id + k) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') END AS ended_at, du AS duration_ms, st AS status,
          CAST(CASE WHEN event_id % 5 = 0 THEN k % 3 END AS integer) AS exit_code FROM g""",
        "p10_meta": msg + """ SELECT dedup_key, CASE WHEN agent <> 'pi' THEN kind END AS agent_type, CASE WHEN agent <> 'pi' THEN 't1' END AS tool_use_id, CAST(CASE WHEN agent <> 'pi' THEN 2 END AS bigint) AS spawn_depth,
          CAST(NULL AS varchar) AS model, CASE WHEN agent <> 'pi' THEN left(sha256('CANARY' || session_id), 16) END AS task_sha256, CAST(CASE WHEN agent <> 'pi' THEN 6 + length(session_id) END AS bigint) AS task_len FROM msg""",
        "t3_replay": claude + """, lat AS (SELECT * REPLACE ('s' || user_id AS session_id), k * 13 + k % 50 + cw AS total,
            t - lag(t) OVER (PARTITION BY user_id, coalesce(run, '') ORDER BY t, 'cc:' || mid || '|r' || (event_id % 3)) AS gap FROM c1)
          SELECT session_id, count(*) AS messages, CAST(sum(total) AS bigint) AS total_tokens, CAST(sum(gap) FILTER (WHERE gap BETWEEN 0 AND 1800000) AS bigint) AS latency_ms,
            count(*) FILTER (WHERE gap BETWEEN 0 AND 1800000) AS timed, count(*) AS message_count, count(*) FILTER (WHERE run IS NOT NULL) AS subagent_message_count FROM lat GROUP BY session_id""",
        "s5_discover": found + " SELECT path, agent, kind, session_id, parent_session_id, agent_run_id, project_slug FROM found",
        "o3_budget": found + " SELECT kind, path FROM found ORDER BY kind, path LIMIT 50",
        "u2_merge_calls": call + """ SELECT dedup_key, agent, CASE WHEN id % 10 <> 1 THEN session_id END AS session_id, CASE WHEN duration_ms IS NOT NULL THEN 'run' || (id % 3) END AS agent_run_id,
          coalesce(tool_name, CASE WHEN id % 10 = 1 THEN 'old' END) AS tool_name, ts_epoch_ms, ts_epoch_ms + duration_ms AS result_ts_epoch_ms, CASE WHEN duration_ms IS NOT NULL THEN is_error END AS is_error,
          coalesce(duration_ms, CASE WHEN id % 10 = 1 THEN 7 END) AS duration_ms FROM tc""",
        "u4_replace": msg + """ SELECT agent, session_id, CAST(sum(total_tokens) AS bigint) AS total_tokens FROM msg WHERE agent = 'pi' OR ts_epoch_ms % 3 <> 0 GROUP BY agent, session_id""",
        "u5_marks": f"""WITH f AS ({f(b._BASE)}), g AS (SELECT *, event_id % 8 AS st, 'f' || event_id AS path, CAST(100 + k AS bigint) AS size FROM f)
          SELECT path, CASE WHEN st = 1 THEN event_id + 1000000000 ELSE event_id END AS inode, CASE st WHEN 1 THEN size + 20 WHEN 2 THEN size - 50 WHEN 5 THEN size + 40 ELSE size END AS byte_offset,
            CAST(CASE WHEN st IN (3, 7) THEN k + 9 WHEN st = 5 THEN k + 14 ELSE 5 END AS bigint) AS lines_ingested, CAST(CASE WHEN st IN (3, 7) THEN k % 3 WHEN st = 5 THEN 2 + k % 3 ELSE 2 END AS bigint) AS lines_skipped,
            CASE WHEN st IN (0, 6) THEN 't1' ELSE 't0' END AS first_ingested_at, CASE WHEN st IN (3, 7) THEN 't0' ELSE 't1' END AS last_ingested_at FROM g""",
        "u6_meta": msg + """ SELECT 'k' || session_id AS key, coalesce('late' || max(CASE WHEN kind = 'compaction' THEN dedup_key END), 'last' || max(dedup_key)) AS value FROM msg GROUP BY session_id""",
        "k_dedup_keys": msg + f""" SELECT dedup_key, 'cc:' || dedup_key || '|' || coalesce(agent_run_id, '') AS message, 'pi:' || {_hash('dedup_key', 'ts', 'model', 'total_tokens')} AS pi_message,
          'pic:' || {_hash('dedup_key', 'ts', 'model')} AS pi_compaction, CASE WHEN agent_run_id IS NOT NULL THEN 'tc:pi|' || session_id || '|' || agent_run_id END AS tool_call,
          'rh:' || {_hash('agent_run_id', 'ts', 'total_tokens', 'model')} AS run_history, CASE WHEN agent_run_id IS NOT NULL THEN 'sa:' || session_id || '|' || agent_run_id END AS subagent,
          CASE WHEN agent_run_id IS NOT NULL THEN 'psa:' || session_id || '|' || agent_run_id END AS pi_subagent FROM msg""",
        "c4_unknown": msg + """ SELECT DISTINCT coalesce(model, '<missing>') AS model FROM msg WHERE reported_cost_usd IS NULL AND (agent = 'pi' OR model = 'mystery' OR model IS NULL)""",
        "f6_recent": msg + " SELECT dedup_key, agent, session_id FROM msg a WHERE EXISTS (SELECT 1 FROM msg b WHERE b.agent = a.agent AND b.session_id = a.session_id AND b.ts_epoch_ms >= 1706500000000)",
        "f10_leaks": f"""SELECT 'lines' AS "table", count(*) AS leaks FROM ({f(b.CLAUDE_LINES)}) x WHERE raw LIKE '%CANARY%' UNION ALL SELECT * FROM (VALUES ('messages', CAST(0 AS bigint)), ('tool_calls', 0), ('runs', 0)) AS v(a, c)""",
        "w2_latency_only_null": msg + """, g AS (SELECT *, ts_epoch_ms - lag(ts_epoch_ms) OVER (PARTITION BY agent, session_id, coalesce(agent_run_id, '') ORDER BY ts_epoch_ms, dedup_key) AS gap FROM msg)
          SELECT dedup_key, CASE WHEN total_tokens % 3 = 0 THEN -1 WHEN gap BETWEEN 0 AND 1800000 THEN gap END AS latency_ms FROM g""",
    }
    return out


ORACLES = _oracles()
