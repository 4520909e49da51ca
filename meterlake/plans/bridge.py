"""Message-shaped views over the star-schema tables, as one SQL text for both engines."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the dialects differ.
SPARK = {"ms": "unix_millis(cast(ts AS timestamp))", "text": "string", "iso": "date_format(timestamp_millis(ts_epoch_ms), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"}
DUCK = {"ms": "epoch_us(ts) // 1000", "text": "varchar", "iso": "strftime(make_timestamp(ts_epoch_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"}

_BASE = """SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k,
  {ms} AS ts_epoch_ms, CAST(ts AS date) AS day FROM events"""

MESSAGES = f"""SELECT 'cc:' || event_id AS dedup_key, CASE WHEN event_id % 2 = 0 THEN 'claude-code' ELSE 'pi' END AS agent,
  CASE WHEN event_type = 'signup' THEN 'compaction' ELSE 'message' END AS kind, CAST(user_id AS {{text}}) AS session_id,
  CASE WHEN event_type = 'view' THEN 'run' || (user_id % 5) END AS agent_run_id, event_type = 'view' AND event_id % 3 <> 0 AS is_sidechain, ts_epoch_ms, day,
  {{iso}} AS ts, CASE WHEN event_id % 9 <> 0 THEN 'm' || event_id END AS provider_msg_id, CASE WHEN event_id % 4 <> 0 THEN '/w' || (user_id % 7) || (event_id % 2) END AS cwd,
  'slug' || (user_id % 3) AS project_slug, CASE WHEN event_type <> 'click' THEN 'b' || (event_id % 5) END AS git_branch,
  CASE event_id % 7 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b-20251001' WHEN 2 THEN '<synthetic>' WHEN 3 THEN 'mystery'
    WHEN 5 THEN 'model-b' WHEN 6 THEN 'alias-a' END AS model,
  k * 10 AS input_tokens, k * 3 AS output_tokens, k * 7 % 50 AS cache_read_tokens, k % 11 AS cache_write_5m_tokens, k % 3 AS cache_write_1h_tokens,
  k % 11 + k % 3 AS cache_write_tokens, k % 5 AS reasoning_tokens, k * 13 + k * 7 % 50 + k % 11 + k % 3 AS total_tokens,
  CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS retry_count,
  CASE WHEN event_id % 2 = 1 AND event_id % 5 <> 0 THEN value / 1000 END AS reported_cost_usd FROM ({_BASE}) base"""

TOOL_CALLS = f"""SELECT 'tc:' || event_id AS dedup_key, event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'claude-code' ELSE 'pi' END AS agent,
  CAST(user_id AS {{text}}) AS session_id, CASE WHEN event_id % 13 <> 0 THEN event_type END AS tool_name, event_type = 'error' AS is_error,
  CASE WHEN event_id % 4 <> 0 THEN k * 17 END AS duration_ms, ts_epoch_ms FROM ({_BASE}) base"""

RATES = """SELECT * FROM (VALUES ('model-a', 1e-6, 1e-5, 1e-7, 2e-6, 4e-6), ('model-b', 2e-6, 2e-5, CAST(NULL AS double), 3e-6, 5e-6))
  AS r(model, input, output, cache_read, cache_write_5m, cache_write_1h)"""
ALIASES = "SELECT * FROM (VALUES ('alias-a', 'model-a'), ('<synthetic>', NULL), ('_note', 'model-a')) AS a(alias, target)"
VERSION = "v1"
#: Closed, overlapping, open and empty windows (milliseconds).
EXPERIMENTS = """SELECT name, CAST(start_ms AS bigint) AS start_ms, CAST(end_ms AS bigint) AS end_ms FROM (VALUES
  ('closed', 1704067200000, 1704672000000), ('overlap', 1704400000000, 1705400000000), ('open', 1705500000000, NULL),
  ('empty', 946684800000, 946684900000)) AS e(name, start_ms, end_ms)"""
#: A file for each event, in one of eight states: new, rotated, truncated, unchanged, rewritten, grown, without an end of its last line, gone.
MARKS = f"""SELECT path, inode, size_bytes, mtime_ns, CASE WHEN event_id % 8 = 6 THEN size_bytes - 10 ELSE size_bytes END AS byte_offset, k + 9 AS lines_ingested, k % 3 AS lines_skipped FROM
  (SELECT 'f' || event_id AS path, event_id, k, CAST(event_id AS bigint) AS inode, 100 + k AS size_bytes, ts_epoch_ms AS mtime_ns FROM ({_BASE}) base) files WHERE event_id % 8 <> 0"""
RUNS = "SELECT run_id, finished_at FROM (VALUES ('r1', '2024-01-01T00:00:00Z'), ('r3', '2024-02-01T00:00:00Z'), ('r2', '2024-01-15T00:00:00Z')) AS r(run_id, finished_at)"
LISTING = f"""SELECT path, CASE WHEN event_id % 8 = 1 THEN inode + 1000000000 ELSE inode END AS inode,
  CASE event_id % 8 WHEN 1 THEN size_bytes + 20 WHEN 2 THEN size_bytes - 50 WHEN 5 THEN size_bytes + 40 ELSE size_bytes END AS size_bytes, CASE WHEN event_id % 8 IN (3, 6) THEN mtime_ns ELSE mtime_ns + 1 END AS mtime_ns FROM
  (SELECT 'f' || event_id AS path, event_id, k, CAST(event_id AS bigint) AS inode, 100 + k AS size_bytes, ts_epoch_ms AS mtime_ns FROM ({_BASE}) base) files WHERE event_id % 8 <> 7"""


#: Transcript lines as texts, made of events: whole, broken, without what they need, copied, and split into blocks. Times are of one day, by arithmetic.
_TIME = """'2024-01-01T' || lpad(CAST(event_id % 24 AS {text}), 2, '0') || ':' || lpad(CAST(event_id % 60 AS {text}), 2, '0') || ':' || lpad(CAST(k % 60 AS {text}), 2, '0') || '.'
  || lpad(CAST(event_id % 1000 AS {text}), 3, '0') || CASE WHEN event_id % 7 = 0 THEN '+02:00' ELSE 'Z' END"""
CLAUDE_LINES = f"""SELECT path, end_offset, 'claude_session' AS kind, 'claude-code' AS agent, 'slug' AS project_slug, CAST(NULL AS {{text}}) AS session_id, CAST(NULL AS {{text}}) AS parent_session_id,
  CAST(NULL AS {{text}}) AS agent_run_id, event_id, user_id, event_type, k, n,
  CASE WHEN event_id % 17 = 0 AND n = 1 THEN '{{"type":"assistant","sess' WHEN event_id % 29 = 0 AND n = 2 THEN '[1,2]' WHEN event_id % 31 = 0 AND n = 2 THEN '{{"type":"file-history-delta"}}'
  ELSE '{{"type":"' || CASE WHEN n = 3 THEN 'user' ELSE 'assistant' END || '"' || CASE WHEN event_id % 19 = 0 THEN '' ELSE ',"sessionId":"s' || user_id || '"' END
    || CASE WHEN event_id % 23 = 0 THEN '' ELSE ',"timestamp":"' || {_TIME} || '"' END || ',"uuid":"u' || event_id || '-' || n || '","requestId":"r' || (event_id % 3) || '"'
    || CASE WHEN event_type = 'view' THEN ',"isSidechain":true,"agentId":"run' || (user_id % 5) || '","attributionAgent":"Explore"' ELSE '' END || ',"cwd":"/home","version":"1.' || (k % 3) || '"'
    || CASE WHEN event_type = 'error' THEN ',"diagnostics":{{"cache_miss_reason":"ttl"}}' ELSE '' END
    || CASE WHEN n = 3 THEN ',"message":{{"role":"user","content":[{{"type":"tool_result","tool_use_id":"t' || event_id || '","content":"CANARY"'
        || CASE WHEN event_id % 3 = 0 THEN '' WHEN event_type = 'error' THEN ',"is_error":true' ELSE ',"is_error":false' END || '}}]}}}}'
      ELSE ',"message":{{"id":"m' || (event_id - event_id % 2) || '","model":"model-' || (k % 4) || '","stop_reason":"end","content":'
        || CASE WHEN n = 1 THEN '"CANARY text"' ELSE '[{{"type":"text","text":"CANARY"}},{{"type":"tool_use","id":"t' || event_id || '","name":"' || event_type || '","input":{{}}}}]' END
        || ',"usage":{{"input_tokens":' || (k * 10) || ',"output_tokens":' || (k * 3) || ',"cache_read_input_tokens":' || (k % 50) || ',"cache_creation_input_tokens":' || (k % 11)
        || CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN ',"cache_creation":{{}}'
             ELSE ',"cache_creation":{{"ephemeral_5m_input_tokens":' || (k % 7) || ',"ephemeral_1h_input_tokens":' || (k % 4) || '}}' END
        || CASE WHEN event_id % 3 = 0 THEN ',"iterations":[{{}},{{}},{{}}]' ELSE '' END || '}}}}}}' END END AS raw
  FROM (SELECT *, 'p' || (user_id % 20) AS path, event_id * 10 + n AS end_offset FROM ({_BASE}) base JOIN (VALUES (1), (2), (3)) AS b(n) ON true) lines"""
PI_LINES = f"""SELECT path, end_offset, 'pi_session' AS kind, 'pi' AS agent, 'slug' AS project_slug, CAST(NULL AS {{text}}) AS session_id, CAST(NULL AS {{text}}) AS parent_session_id,
  CASE WHEN user_id % 4 = 0 THEN 'call' || user_id END AS agent_run_id, event_id, user_id, event_type, k,
  CASE WHEN event_id % 37 = 0 THEN '{{"type":' ELSE '{{"type":"' || CASE event_type WHEN 'signup' THEN 'session' WHEN 'purchase' THEN 'model_change' WHEN 'error' THEN 'compaction' ELSE 'message' END || '"'
    || CASE WHEN event_id % 13 = 0 THEN '' ELSE ',"id":"e' || event_id || '"' END || ',"parentId":"e' || (event_id - 1) || '","timestamp":"' || {_TIME} || '"'
    || CASE event_type WHEN 'signup' THEN ',"cwd":"/w' || (k % 3) || '"}}'
      WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN '' ELSE ',"modelId":"pm' || (k % 5) || '"' END || ',"provider":"pr' || (k % 2) || '"}}'
      WHEN 'error' THEN ',"summary":"CANARY","tokensBefore":' || (k * 100) || ',"details":{{"readFiles":["CANARY","b"],"modifiedFiles":[' || CASE WHEN k % 2 = 0 THEN '"c"' ELSE '' END || ']}}'
        || CASE WHEN event_id % 2 = 0 THEN ',"usage":{{"input":' || k || ',"output":5,"cost":{{"total":0.25}}}}' ELSE '' END || '}}'
      WHEN 'click' THEN ',"message":{{"role":"toolResult","toolCallId":"c' || (event_id - 1) || '","toolName":"bash","content":"CANARY","isError":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || '}}}}'
      ELSE ',"message":{{"role":"assistant","provider":"pq"' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"model":"pm' || (k % 6) || '"' END || ',"content":[{{"type":"toolCall","id":"c' || event_id || '","name":"bash"}}]'
        || CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"usage":{{"input":' || (k * 9) || ',"output":' || k || ',"reasoning":' || (k % 5) || ',"cacheRead":' || (k % 8) || ',"cacheWrite":' || (k % 9)
          || CASE WHEN event_id % 2 = 0 THEN ',"cacheWrite1h":' || (k % 3) ELSE '' END || ',"totalTokens":' || CASE WHEN event_id % 7 = 1 THEN 0 ELSE k * 11 END
          || CASE WHEN event_id % 4 = 1 THEN ',"cost":{{"total":0.5}}' WHEN event_id % 4 = 2 THEN ',"cost":{{"total":"much"}}' ELSE '' END || '}}' END || '}}}}' END END AS raw
  FROM (SELECT *, 'q' || (user_id % 15) AS path, event_id AS end_offset FROM ({_BASE}) base) lines"""
HISTORY_LINES = f"""SELECT 'run-history.jsonl' AS path, event_id AS end_offset, 'pi_run_history' AS kind, 'pi' AS agent, CAST(NULL AS {{text}}) AS project_slug, event_id, event_type, k,
  CASE WHEN event_id % 41 = 0 THEN 'nothing' ELSE '{{"agent":"' || event_type || '","task":"CANARY ' || k || '","ts":' || CASE WHEN event_id % 11 = 0 THEN '"late"' ELSE CAST(1704067200 + event_id AS {{text}}) END
    || ',"status":"' || CASE WHEN k % 2 = 0 THEN 'ok' ELSE 'failed' END || '"' || CASE WHEN event_id % 6 = 0 THEN '' ELSE ',"duration":' || (k * 1000) END
    || CASE WHEN event_id % 5 = 0 THEN ',"exit":' || (k % 3) ELSE ',"exit":"none"' END || '}}' END AS raw FROM ({_BASE}) lines"""
#: A path for each event, in one of thirteen shapes.
PATHS = f"""SELECT CASE event_id % 13 WHEN 0 THEN '/c/slug' || (user_id % 3) || '/s' || event_id || '.jsonl' WHEN 1 THEN '/c/slug' || (user_id % 3) || '/s' || event_id || '/subagents/agent-' || k || '.jsonl'
  WHEN 2 THEN '/c/slug' || (user_id % 3) || '/s' || event_id || '/subagents/workflows/wf_1/agent-x-' || k || '.jsonl' WHEN 3 THEN '/c/slug' || (user_id % 3) || '/s' || event_id || '/subagents/journal.jsonl'
  WHEN 4 THEN '/c/slug' || (user_id % 3) || '/s' || event_id || '/notes/agent-7.jsonl' WHEN 5 THEN '/c/top' || event_id || '.jsonl' WHEN 6 THEN '/c/slug' || (user_id % 3) || '/s' || event_id || '/subagents/Agent-' || k || '.jsonl'
  WHEN 7 THEN '/s/slug' || (user_id % 3) || '/2026-07-01T10-00-00-000Z_019f-' || event_id || '.jsonl' WHEN 8 THEN '/s/slug' || (user_id % 3) || '/other' || event_id || '.jsonl'
  WHEN 9 THEN '/s/slug' || (user_id % 3) || '/2026-07-01T10-00-00-000Z_019f-' || event_id || '/call_' || k || '/run-0/session.jsonl' WHEN 10 THEN '/s/slug' || (user_id % 3) || '/claude-code-artifacts/call_' || event_id || '/run-0/session.jsonl'
  WHEN 11 THEN '/s/slug' || (user_id % 3) || '/plain/call_' || event_id || '/run-2/session.jsonl' ELSE '/h/other' || event_id || '.jsonl' END AS path, event_id, user_id, k FROM ({_BASE}) base"""


def fill(sql: str, dialect: dict[str, str]) -> str:
    for name in ("iso", "ms", "text"):
        sql = sql.replace("{" + name + "}", dialect[name])
    return sql


#: Lines cost far more than the events that they are made of (a megabyte of events makes some 70 of lines): tasks for each core and each part of the file, and neighbours that stay together.
TASKS_A_CORE, TASKS_A_PART, NEIGHBOURS = 4, 8, 64


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the views above, read from the events of ``sf_dir`` and from no other table."""
    name = f"meterlake_events_{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if sql in (CLAUDE_LINES, PI_LINES, HISTORY_LINES):
        name += "_dealt"
        tasks = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, TASKS_A_PART * events.rdd.getNumPartitions())
        events = events.repartition(tasks, F.floor(F.col("event_id") / NEIGHBOURS))
    events.createOrReplaceTempView(name)
    return spark.sql(fill(sql, SPARK).replace("FROM events", f"FROM {name}"))


def constant(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)
