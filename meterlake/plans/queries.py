"""The reports and operators over the bridge views, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators import derive, merge, pricing, reports, watermarks
from meterlake.plans import bridge as b
from meterlake.plans import ingestion

SINCE = 1704400000000


def messages(spark: SparkSession, d: str) -> DataFrame:
    m = pricing.price(b.view(spark, d, b.MESSAGES), b.constant(spark, b.RATES), b.constant(spark, b.ALIASES), b.VERSION)
    return derive.latency(m)


def priced(spark: SparkSession, d: str) -> DataFrame:
    return pricing.price(b.view(spark, d, b.MESSAGES), b.constant(spark, b.RATES), b.constant(spark, b.ALIASES), b.VERSION)


def calls(spark: SparkSession, d: str) -> DataFrame:
    return b.view(spark, d, b.TOOL_CALLS)


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return derive.sessions(priced(spark, d), calls(spark, d))


def marks(spark: SparkSession, d: str) -> DataFrame:
    return b.view(spark, d, b.MARKS)


def fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Three lines a message, as one response is several lines."""
    return b.view(spark, d, b.MESSAGES).select("dedup_key", "session_id", "total_tokens", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("line_no"))


def u1_first_wins(spark: SparkSession, d: str) -> DataFrame:
    lines = fan_out(spark, d).withColumn("total_tokens", F.col("total_tokens") * F.col("line_no"))
    stored = b.view(spark, d, b.MESSAGES).filter("ts_epoch_ms % 4 = 0").select("dedup_key")
    return merge.first_wins(stored, lines, ["line_no"])


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; the comparison doesn't."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


def runs(spark: SparkSession) -> DataFrame:
    return b.constant(spark, b.RUNS)


def status(spark: SparkSession, d: str) -> DataFrame:
    return reports.status(priced(spark, d), sessions(spark, d), calls(spark, d), ingestion.u3_merge_runs(spark, d), marks(spark, d), b.constant(spark, b.EXPERIMENTS), runs(spark))


def broken(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, sessions and marks with violations of each invariant."""
    m = priced(spark, d).withColumn("id", F.expr("CAST(substr(dedup_key, 4) AS bigint)"))
    bad = m.withColumns({
        "provider_msg_id": F.expr("CASE WHEN id % 50 = 0 THEN 'm-twice' || id % 4 ELSE provider_msg_id END"),
        "cost_usd": F.expr("CASE WHEN cost_source = 'unknown' AND id % 10 = 3 THEN 1.0D WHEN cost_source = 'zero-rated' AND id % 3 = 0 THEN CAST(NULL AS double) WHEN cost_source = 'zero-rated' AND id % 4 = 0 THEN 0.125D ELSE cost_usd END"),
        "pricing_version": F.expr("CASE WHEN id % 3 = 1 THEN NULL ELSE pricing_version END"), "session_id": F.expr("CASE WHEN id % 101 = 0 THEN '' WHEN id % 101 = 1 THEN NULL ELSE session_id END")})
    return bad, sessions(spark, d), marks(spark, d).withColumn("size_bytes", F.expr("CASE WHEN CAST(substr(path, 2) AS bigint) % 8 = 3 THEN 9 ELSE size_bytes END"))


QUERIES = {
    "c3_price": lambda s, d: priced(s, d).select("dedup_key", "cost_source", "pricing_version", F.round("cost_usd", 9).alias("cost_usd")),
    "w1_latency": lambda s, d: derive.latency(b.view(s, d, b.MESSAGES)).select("dedup_key", "latency_ms"),
    "a1_daily": lambda s, d: rounded(reports.daily(priced(s, d))),
    "a1_daily_since": lambda s, d: rounded(reports.daily(priced(s, d), SINCE)),
    "a2_models": lambda s, d: rounded(reports.models(messages(s, d))),
    "a3_tools": lambda s, d: rounded(reports.tools(calls(s, d))),
    "a4_status": lambda s, d: rounded(status(s, d)),
    "a5_unknown_models": lambda s, d: reports.unknown_models(priced(s, d)),
    "a6_sessions": lambda s, d: rounded(sessions(s, d)),
    "o2_recent_sessions": lambda s, d: rounded(reports.recent_sessions(sessions(s, d))),
    "o2_recent_sessions_since": lambda s, d: rounded(reports.recent_sessions(sessions(s, d), 50, 1704067200000 + 3_600_500)),
    "a7_experiments": lambda s, d: rounded(reports.experiments(b.constant(s, b.EXPERIMENTS), priced(s, d))),
    "a8_experiment_report": lambda s, d: rounded(reports.experiment_report(b.constant(s, b.EXPERIMENTS), messages(s, d), "overlap")),
    "a9_duplicates": lambda s, d: reports.duplicates(fan_out(s, d)),
    "u1_first_wins": u1_first_wins,
    "s9_decide": lambda s, d: watermarks.decide(b.view(s, d, b.LISTING), marks(s, d)),
    "s12_summary": lambda s, d: watermarks.summary(marks(s, d)),
    "d8_doctor": lambda s, d: reports.doctor(priced(s, d), sessions(s, d), marks(s, d)),
    "d8_doctor_violations": lambda s, d: reports.doctor(*broken(s, d)),
    **ingestion.QUERIES,
}


def _oracles() -> dict[str, str]:
    m, t = b.fill(b.MESSAGES, b.DUCK), b.fill(b.TOOL_CALLS, b.DUCK)
    base = f"""WITH raw AS ({m}), tc AS ({t}), rates AS ({b.RATES}), aliases AS ({b.ALIASES}), exps AS ({b.EXPERIMENTS}), past AS ({b.RUNS}), marks AS ({b.fill(b.MARKS, b.DUCK)}), files AS ({b.fill(b._BASE, b.DUCK)}),
    src AS (SELECT raw.*, ts_epoch_ms - lag(ts_epoch_ms) OVER (PARTITION BY agent, session_id, coalesce(agent_run_id, '') ORDER BY ts_epoch_ms, dedup_key) AS gap,
      CASE WHEN reported_cost_usd IS NOT NULL THEN 'reported' WHEN agent = 'pi' THEN 'unknown' WHEN raw.model = '<synthetic>' THEN 'zero-rated'
        WHEN r.model IS NOT NULL THEN 'derived' ELSE 'unknown' END AS cost_source,
      input_tokens * r.input + output_tokens * r.output + cache_read_tokens * coalesce(r.cache_read, 0) + cache_write_5m_tokens * r.cache_write_5m + cache_write_1h_tokens * r.cache_write_1h AS dc
      FROM raw LEFT JOIN rates r ON r.model = CASE raw.model WHEN 'alias-a' THEN 'model-a' ELSE regexp_replace(raw.model, '-[0-9]{{8}}$', '') END),
    msg AS (SELECT *, CASE WHEN gap BETWEEN 0 AND 1800000 THEN gap END AS latency_ms, CASE WHEN cost_source IN ('derived', 'zero-rated') THEN 'v1' END AS pricing_version,
      CASE cost_source WHEN 'reported' THEN reported_cost_usd WHEN 'zero-rated' THEN 0.0 WHEN 'derived' THEN dc END AS cost_usd FROM src),
    ses AS (SELECT agent, session_id, min(cwd) AS cwd, min(project_slug) AS project_slug, min(git_branch) AS git_branch, min(ts) AS started_at, max(ts) AS ended_at, min(ts_epoch_ms) AS started_at_ms, max(ts_epoch_ms) AS ended_at_ms, max(ts_epoch_ms) - min(ts_epoch_ms) AS duration_ms, count(*) AS message_count,
      count(*) FILTER (WHERE kind = 'compaction') AS compaction_count, count(*) FILTER (WHERE is_sidechain) AS subagent_message_count,
      CAST(to_json(coalesce(list_sort(list(DISTINCT model) FILTER (WHERE model IS NOT NULL)), [])) AS varchar) AS models_used, count(DISTINCT model) - 1 AS model_switch_count,
      CAST(sum(input_tokens) AS bigint) AS input_tokens, CAST(sum(output_tokens) AS bigint) AS output_tokens, CAST(sum(cache_read_tokens) AS bigint) AS cache_read_tokens,
      CAST(sum(cache_write_tokens) AS bigint) AS cache_write_tokens, CAST(sum(total_tokens) AS bigint) AS total_tokens, round(sum(cost_usd), 9) AS cost_usd,
      max(CASE WHEN cost_usd IS NULL THEN 1 ELSE 0 END) AS has_unknown_pricing,
      coalesce(any_value(tn), 0) AS tool_call_count, coalesce(any_value(te), 0) AS tool_error_count
      FROM msg LEFT JOIN (SELECT agent, session_id, count(*) AS tn, count(*) FILTER (WHERE is_error) AS te FROM tc GROUP BY ALL) q USING (agent, session_id) GROUP BY agent, session_id)
    """
    bad = """, b0 AS (SELECT *, CAST(substr(dedup_key, 4) AS bigint) AS id FROM msg),
      bad AS (SELECT * REPLACE (CASE WHEN id % 50 = 0 THEN 'm-twice' || id % 4 ELSE provider_msg_id END AS provider_msg_id,
        CASE WHEN cost_source = 'unknown' AND id % 10 = 3 THEN 1.0 WHEN cost_source = 'zero-rated' AND id % 3 = 0 THEN NULL WHEN cost_source = 'zero-rated' AND id % 4 = 0 THEN 0.125 ELSE cost_usd END AS cost_usd,
        CASE WHEN id % 3 = 1 THEN NULL ELSE pricing_version END AS pricing_version, CASE WHEN id % 101 = 0 THEN '' WHEN id % 101 = 1 THEN NULL ELSE session_id END AS session_id) FROM b0),
      worse AS (SELECT * REPLACE (CASE WHEN CAST(substr(path, 2) AS bigint) % 8 = 3 THEN 9 ELSE size_bytes END AS size_bytes) FROM marks) """
    five = ", ".join(f"CAST(sum({c}) AS bigint) AS {c}" for c in reports.TOKENS)
    cost = "round(sum(cost_usd), 9) AS cost_usd, count(*) FILTER (WHERE cost_usd IS NULL) AS unpriced"
    none = "coalesce(model, '(none)') AS model, agent"
    day = f"SELECT day, agent, count(*) AS messages, count(DISTINCT session_id) AS sessions, {five}, {cost} FROM msg"
    calls3 = "SELECT dedup_key, session_id, total_tokens * line_no AS total_tokens, line_no FROM raw, (SELECT unnest([1, 2, 3]) AS line_no) l"
    return {k: base + v for k, v in {
        "c3_price": "SELECT dedup_key, cost_source, pricing_version, round(cost_usd, 9) AS cost_usd FROM msg",
        "w1_latency": "SELECT dedup_key, latency_ms FROM msg",
        "a1_daily": f"{day} GROUP BY day, agent",
        "a1_daily_since": f"{day} WHERE ts_epoch_ms >= {SINCE} GROUP BY day, agent",
        "a2_models": f"""SELECT {none}, count(*) AS messages, {five}, {cost}, round(avg(latency_ms), 9) AS avg_latency_ms, CAST(sum(retry_count) AS bigint) AS retries,
          CASE WHEN sum(output_tokens) > 0 THEN round(100.0 * CAST(sum(reasoning_tokens) AS double) / sum(output_tokens), 9) END AS reasoning_pct,
          CASE WHEN sum(cache_read_tokens + input_tokens + cache_write_tokens) > 0 THEN round(100.0 * CAST(sum(cache_read_tokens) AS double)
            / sum(cache_read_tokens + input_tokens + cache_write_tokens), 9) END AS cache_hit_pct FROM msg GROUP BY msg.model, agent""",
        "a3_tools": """SELECT coalesce(tool_name, '(unknown)') AS tool_name, agent, count(*) AS calls, count(*) FILTER (WHERE is_error) AS errors,
          round(100.0::double * count(*) FILTER (WHERE is_error) / count(*), 9) AS error_pct, round(avg(duration_ms), 9) AS avg_duration_ms FROM tc GROUP BY tc.tool_name, agent""",
        "a4_status": f"""SELECT count(*) AS messages, (SELECT count(*) FROM ses) AS sessions, (SELECT count(*) FROM tc) AS tool_calls,
          (SELECT count(*) FROM ({ingestion.ORACLES["u3_merge_runs"]}) z) AS subagent_runs, (SELECT count(*) FROM marks) AS watermarks, (SELECT count(*) FROM exps) AS experiments,
          round(sum(cost_usd), 9) AS total_cost_usd, count(*) FILTER (WHERE cost_usd IS NULL) AS unpriced_messages, min(ts) AS earliest, max(ts) AS latest, (SELECT max(finished_at) FROM past) AS last_run FROM msg""",
        "a5_unknown_models": f"SELECT {none}, count(*) AS messages, CAST(sum(total_tokens) AS bigint) AS total_tokens FROM msg WHERE cost_usd IS NULL GROUP BY msg.model, agent",
        "a6_sessions": "SELECT * FROM ses",
        "o2_recent_sessions": "SELECT * FROM ses ORDER BY started_at_ms DESC, agent, session_id LIMIT 20",
        "o2_recent_sessions_since": "SELECT * FROM ses WHERE started_at_ms // 1000 * 1000 >= 1704070800500 ORDER BY started_at_ms DESC, agent, session_id LIMIT 50",
        "a7_experiments": """SELECT name, start_ms, end_ms, count(dedup_key) AS messages, round(sum(cost_usd), 9) AS cost_usd FROM exps
          LEFT JOIN msg ON ts_epoch_ms >= start_ms AND (end_ms IS NULL OR ts_epoch_ms <= end_ms) GROUP BY ALL""",
        "a8_experiment_report": f"""SELECT {none}, count(*) AS messages, CAST(sum(input_tokens) AS bigint) AS input_tokens, CAST(sum(output_tokens) AS bigint) AS output_tokens,
          CAST(sum(total_tokens) AS bigint) AS total_tokens, round(avg(latency_ms), 9) AS avg_latency_ms, {cost} FROM msg
          WHERE ts_epoch_ms BETWEEN 1704400000000 AND 1705400000000 GROUP BY msg.model, agent""",
        "a9_duplicates": f"SELECT dedup_key, count(*) AS n FROM ({calls3}) q GROUP BY dedup_key HAVING count(*) > 1",
        "u1_first_wins": f"SELECT * FROM ({calls3}) q WHERE line_no = 1 AND dedup_key NOT IN (SELECT dedup_key FROM raw WHERE ts_epoch_ms % 4 = 0)",
        "s9_decide": """SELECT 'f' || event_id AS path, CASE event_id % 8 WHEN 0 THEN 'new' WHEN 1 THEN 'rotated' WHEN 2 THEN 'truncated' WHEN 3 THEN 'unchanged' WHEN 4 THEN 'rewritten' ELSE 'appended' END AS decision,
          CAST(CASE event_id % 8 WHEN 3 THEN 100 + k WHEN 5 THEN 100 + k WHEN 6 THEN 90 + k ELSE 0 END AS bigint) AS start FROM files WHERE event_id % 8 <> 7""",
        "s12_summary": "SELECT count(*) AS files, CAST(sum(byte_offset) AS bigint) AS bytes, CAST(sum(lines_ingested) AS bigint) AS lines, CAST(sum(lines_skipped) AS bigint) AS skipped FROM marks",
        "d8_doctor": _doctor("msg", "marks"),
        "d8_doctor_violations": bad + _doctor("bad", "worse"),
    }.items()} | ingestion.ORACLES


def _doctor(m: str, marks: str) -> str:
    """The seven counts, each by its own rule; what a violation means is taken over as text."""
    rules = {
        "unique_messages": f"SELECT provider_msg_id FROM {m} WHERE agent = 'claude-code' AND provider_msg_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
        "unknown_is_null": f"SELECT 1 FROM {m} WHERE cost_source = 'unknown' AND cost_usd IS NOT NULL",
        "zero_rated_is_zero": f"SELECT 1 FROM {m} WHERE cost_source = 'zero-rated' AND cost_usd <> 0",
        "derived_has_version": f"SELECT 1 FROM {m} WHERE cost_source = 'derived' AND pricing_version IS NULL",
        "rollup_matches": f"""SELECT s.agent, s.session_id FROM (SELECT agent, session_id, sum(cost_usd) AS cost_usd FROM msg GROUP BY ALL) s JOIN {m} b ON b.agent = s.agent AND b.session_id = s.session_id GROUP BY s.agent, s.session_id, s.cost_usd
          HAVING abs(coalesce(s.cost_usd, 0) - coalesce(sum(b.cost_usd), 0)) > 1e-9""",
        "offset_in_file": f"SELECT path FROM {marks} WHERE byte_offset > size_bytes",
        "has_session": f"SELECT 1 FROM {m} WHERE session_id IS NULL OR session_id = ''",
    }
    quoted = {k: v.replace("'", "''") for k, v in reports.CHECKS.items()}
    return " UNION ALL ".join(f"""SELECT '{k}' AS "check", count(*) AS violations, count(*) = 0 AS passed, '{quoted[k]}' AS why FROM ({rule}) q_{k}""" for k, rule in rules.items())


ORACLES = _oracles()
