"""Lines of the two transcript dialects and of the run history to normalized rows.

A line is parsed once, into a struct that names only the fields below: what people and models said is never carried on (P26).
The struct comes out of a generator, as filters above one aren't pushed below it, where each would parse the line again.  A field that is now a text and now a list
(content) is a text in it, since where a field isn't of its type, Spark raises and catches, which costs several times what the line does; the blocks of lists that hold calls or results are parsed on these lines alone.
So are, as a VARIANT, lists of mixed kinds and lines without a type.
What one line needs from the lines before it (a response's first line, the running session and model) are windows over
the file's lines, so a file is the unit of work and files run side by side.

``lines`` holds path, end_offset (the order within a file), raw, and what ``discovery.classify`` says of the path.  A row without raw says only how far its
file was read, and one without end_offset holds in raw why its file couldn't be read.  Where a file of the second dialect is read on, ``seed`` (session_id, cwd, model, provider)
is what was named before.
Each dialect gives typed lines first; ``messages``, ``tool_calls``, ``subagent_runs`` and ``counters`` are projections of these.

Tokens that aren't numbers count as 0; a line that isn't a JSON object counts as skipped, and never stops a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterlake.functions import keys

ORDER = ("kind", "path", "end_offset")
FILE = ("path", "end_offset", "kind", "agent", "project_slug")
TOKENS = ("input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens", "cache_write_tokens", "total_tokens")
#: The columns of the three tables, in order.
MESSAGE = ("dedup_key", "agent", "kind", "session_id", "agent_run_id", "subagent_type", "is_sidechain", "parent_session_id", "spawn_depth", "source_file",
           "source_entry_id", "provider_msg_id", "request_id", "parent_entry_id", "cwd", "project_slug", "git_branch", "agent_version", "ts", "ts_epoch_ms", "model",
           "response_model", "provider", "api", "stop_reason", *TOKENS, "context_tokens", "retry_count", "cache_miss_reason", "reported_cost_usd")
CALL = ("dedup_key", "agent", "session_id", "agent_run_id", "tool_use_id", "tool_name", "project_slug", "ts", "ts_epoch_ms", "result_ts_epoch_ms", "is_error", "source_file")
RUN = ("dedup_key", "agent", "source", "parent_session_id", "agent_run_id", "agent_type", "tool_use_id", "spawn_depth", "task_sha256", "task_len", "started_at", "ended_at",
       "duration_ms", "status", "exit_code", "model", "message_count", "total_tokens", "cost_usd", "source_file")
_LONG = {"ts_epoch_ms", "result_ts_epoch_ms", "context_tokens", "spawn_depth", "task_len", "duration_ms", "message_count", "retry_count", *TOKENS}
_KIND = {"is_error": "boolean", "is_sidechain": "boolean", "exit_code": "int", "cost_usd": "double", "reported_cost_usd": "double"}


def _row(columns: tuple[str, ...]) -> str:
    """What a parser gives, as a schema."""
    return ", ".join(f"{c} {_KIND.get(c, 'bigint' if c in _LONG else 'string')}" for c in columns) + ", source_kind string, path string, end_offset bigint"


MESSAGE_ROW, CALL_ROW, RUN_ROW = _row(MESSAGE), _row(CALL), _row(RUN)


def _shaped(df: DataFrame, columns: tuple[str, ...], *more: str) -> DataFrame:
    kind = lambda c: _KIND.get(c, "bigint" if c in _LONG else "string")
    have = set(df.columns)
    return df.selectExpr(*[f"CAST({c if c in have else 'NULL'} AS {kind(c)}) AS {c}" for c in columns], *more)


def _get(path: str, kind: str = "string", of: str = "v") -> Column:
    return F.try_variant_get(of, f"$.{path}", kind)


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def _tokens(c: str) -> Column:
    """A count that stands there as a number, or as a string of one; else 0."""
    return F.coalesce(F.col(c).try_cast("bigint"), F.col(c).try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of an ISO time with any offset; null for what isn't one."""
    return F.unix_millis(F.try_to_timestamp(ts))


def _is_object(raw: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(raw)), F.lit("OBJECT<")), F.lit(False))


#: JSON as the agents write it.
STRICT = {"allowSingleQuotes": "false"}


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Adds the fields of ``schema`` as columns, and object (whether the line is a JSON object)."""
    named = lines.select("raw", *[F.col(c).alias(f"of_{c}") for c in lines.columns if c != "raw"])  # fields and files share names
    ended = F.endswith(F.expr(r"TRIM(TRAILING ' \t\r\n' FROM raw)"), F.lit("}"))  # no other line can be an object
    made = named.select("*", F.inline(F.array(F.from_json(F.when(ended, F.col("raw")).otherwise(""), schema, STRICT))))
    typed = F.col("type").isNotNull() & F.endswith(F.rtrim("raw"), F.lit("}"))
    return made.withColumn("object", F.when(typed, True).when(ended, _is_object("raw")).otherwise(False))


#: The fields of a content block that are read.
BLOCKS = "array<struct<type: string, id: string, name: string, tool_use_id: string, is_error: string>>"


def _blocks(content: str, mark: str, **fields: str) -> Column:
    """The blocks of kind ``mark`` in a content list, as structs; none where it is no list, also where it is a text that looks like one."""
    flag = lambda c, n: c.try_cast("boolean") if n == "is_error" else c
    parent, name = content.split(".")
    plain = F.from_json("raw", f"{parent} struct<{name}: {BLOCKS}>", STRICT)[parent][name]
    mixed = F.try_variant_get(F.try_parse_json("raw"), f"$.{content}", BLOCKS)  # a list that holds other things than objects
    # the content is a text that Spark has written anew, so a mark stands in it as it is here
    may = F.startswith(F.col(content), F.lit("[")) & F.contains(F.col(content), F.lit(f'"{mark}"'))
    return F.when(may, F.transform(F.filter(F.coalesce(plain, mixed), lambda b: b["type"] == mark), lambda b: F.struct(*[flag(b[p], n).alias(n) for n, p in fields.items()])))


# The first dialect: a response is several lines, one content block each, that all repeat its usage.


#: The fields of a line that are read. Counts are text first, as any JSON value may stand there.
CLAUDE = """type string, sessionId string, timestamp string, requestId string, agentId string, attributionAgent string, isSidechain string, uuid string, parentUuid string, cwd string,
  gitBranch string, version string, diagnostics struct<cache_miss_reason string>, message struct<id string, model string, stop_reason string,
  content string, usage struct<input_tokens string, output_tokens string,
  cache_read_input_tokens string, cache_creation_input_tokens string, iterations array<string>, cache_creation map<string, string>>>"""
SEED = "struct<session_id: string, cwd: string, model: string, provider: string>"
PI_USAGE = "struct<input string, output string, reasoning string, cacheRead string, cacheWrite string, cacheWrite1h string, totalTokens string, cost struct<total double>>"
PI = f"""type string, id string, timestamp string, cwd string, modelId string, provider string, parentId string, tokensBefore string, usage {PI_USAGE},
  details struct<readFiles array<string>, modifiedFiles array<string>>, message struct<role string, model string, provider string, responseModel string, api string, stopReason string,
  toolCallId string, toolName string, isError string, usage {PI_USAGE}, content string>"""


def _of(*names: str) -> list[Column]:
    """Columns of the line's file, and whether there is a line."""
    end = F.col("of_end_offset")
    return [*[F.col(f"of_{n}").alias(n) for n in names], (F.col("raw").isNotNull() & end.isNotNull()).alias("line"), F.when(end.isNull(), F.col("raw")).alias("error")]


def claude_lines(lines: DataFrame) -> DataFrame:
    u = "message.usage."
    held = F.col(u + "cache_creation")
    typed = parsed(lines, CLAUDE).withColumns({"written_5m_text": held["ephemeral_5m_input_tokens"], "written_1h_text": held["ephemeral_1h_input_tokens"]}).select(
        *_of(*FILE), "object", F.when(F.col("object"), F.col("type")).alias("type"), _some(F.col("sessionId")).alias("session_id"), F.col("timestamp").alias("ts"),
        _some(F.col("message.id")).alias("provider_msg_id"), F.col("requestId").alias("request_id"), "message.model", "message.stop_reason", F.col("agentId").alias("agent_run_id"),
        F.col("attributionAgent").alias("subagent_type"), F.coalesce(F.col("isSidechain").try_cast("boolean"), F.lit(False)).alias("is_sidechain"), F.col("uuid").alias("source_entry_id"),
        F.col("parentUuid").alias("parent_entry_id"), "cwd", F.col("gitBranch").alias("git_branch"), F.col("version").alias("agent_version"), "diagnostics.cache_miss_reason",
        F.greatest(F.coalesce(F.size(u + "iterations"), F.lit(0)) - 1, F.lit(0)).alias("retry_count"),
        _tokens(u + "input_tokens").alias("input_tokens"), _tokens(u + "output_tokens").alias("output_tokens"), _tokens(u + "cache_read_input_tokens").alias("cache_read_tokens"),
        _tokens(u + "cache_creation_input_tokens").alias("written"), F.coalesce(F.size(held) > 0, F.lit(False)).alias("split"),
        _tokens("written_5m_text").alias("written_5m"), _tokens("written_1h_text").alias("written_1h"),
        _blocks("message.content", "tool_use", id="id", name="name").alias("uses"), _blocks("message.content", "tool_result", id="tool_use_id", is_error="is_error").alias("results"))
    return typed.withColumn("ts_epoch_ms", epoch_ms(F.col("ts"))).withColumns({
        "mine": F.coalesce(F.col("type").isin("assistant", "user"), F.lit(False)) & F.col("session_id").isNotNull(),
        # other types are no errors, whatever they lack
        "skipped": F.col("line") & (~F.col("object") | (F.coalesce(F.col("type").isin("assistant", "user"), F.lit(False)) & F.col("session_id").isNull())
        | F.coalesce((F.col("type") == "assistant") & F.col("session_id").isNotNull() & (F.col("provider_msg_id").isNull() | F.col("ts_epoch_ms").isNull()), F.lit(False)))})


def claude_messages(typed: DataFrame) -> DataFrame:
    """The first valid line of each response in its file carries the usage; later ones repeat it."""
    rank = F.row_number().over(Window.partitionBy("path", "provider_msg_id").orderBy("end_offset"))
    first = typed.filter("mine AND type = 'assistant' AND NOT skipped").withColumn("rank", rank).filter("rank = 1")
    five = F.when(F.col("split"), F.col("written_5m")).otherwise(F.col("written"))
    hour = F.when(F.col("split"), F.col("written_1h")).otherwise(0)
    m = first.withColumns({"cache_write_5m_tokens": five, "cache_write_1h_tokens": hour}).withColumn("cache_write_tokens", F.col("written"))
    m = m.withColumns({
        "dedup_key": keys.message_key("provider_msg_id", "request_id"), "source_kind": F.col("kind"), "kind": F.lit("assistant"), "provider": F.lit("anthropic"),
        "source_file": F.col("path"), "reasoning_tokens": F.lit(0), "total_tokens": F.lit(0)})
    return _shaped(with_defaults(m), MESSAGE, "source_kind", "path", "end_offset")


def with_defaults(m: DataFrame) -> DataFrame:
    """Totals that a dialect leaves out (P22) and the size of the context."""
    write = F.when(F.col("cache_write_tokens") == 0, F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens")).otherwise(F.col("cache_write_tokens"))
    m = m.withColumn("cache_write_tokens", write)
    total = F.when(F.col("total_tokens") == 0, F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")).otherwise(F.col("total_tokens"))
    context = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    return m.withColumns({"total_tokens": total, "context_tokens": F.coalesce("context_tokens", context) if "context_tokens" in m.columns else context})


def claude_tool_calls(typed: DataFrame) -> DataFrame:
    """A call from every assistant line, valid or not, and a result from every user line."""
    use = F.transform("uses", lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"), F.lit(None).cast("boolean").alias("is_error")))
    result = F.transform("results", lambda b: F.struct(b["id"].alias("id"), F.lit(None).cast("string").alias("name"), F.coalesce(b["is_error"], F.lit(False)).alias("is_error")))
    return _calls(typed.filter("mine").withColumns({"call": F.col("type") == "assistant", "b": F.explode(F.when(F.col("type") == "assistant", use).otherwise(result))}), "agent_run_id")


def _calls(halves: DataFrame, *of_calls: str) -> DataFrame:
    """Halves of calls with their keys (``call``: the first half; b: id, name, is_error); those without an id go. Columns ``of_calls`` are known of first halves only."""
    call = F.col("call")
    key = halves.withColumns({
        "tool_use_id": F.col("b.id"), "tool_name": F.col("b.name"), "is_error": F.col("b.is_error"), "source_file": F.col("path"), "source_kind": F.col("kind"),
        "result_ts_epoch_ms": F.when(~call, F.col("ts_epoch_ms")), **{c: F.when(call, F.col(c)) for c in ("ts", "ts_epoch_ms", "project_slug", *of_calls)}})
    key = key.withColumn("dedup_key", keys.tool_call_key("agent", "session_id", "tool_use_id")).filter("dedup_key IS NOT NULL")
    return _shaped(key, CALL, "source_kind", "path", "end_offset")


def claude_subagent_runs(typed: DataFrame) -> DataFrame:
    """One row for each run that a message of the file names, from its first message."""
    return runs_of_messages(claude_messages(typed))


def runs_of_messages(messages: DataFrame) -> DataFrame:
    m = messages.filter("agent_run_id IS NOT NULL AND agent_run_id != ''")
    rank = F.row_number().over(Window.partitionBy("path", "agent_run_id").orderBy("end_offset"))
    first = m.withColumn("rank", rank).filter("rank = 1")
    first = first.withColumns({"dedup_key": keys.subagent_key("session_id", "agent_run_id"), "source": F.lit("claude-subagent-transcript"), "parent_session_id": F.col("session_id"),
                               "agent_type": F.col("subagent_type"), "started_at": F.col("ts")}).drop("total_tokens", "spawn_depth")
    return _shaped(first, RUN, "source_kind", "path", "end_offset")


# The second dialect: a header names the session, entries change the model, and what follows inherits both.


def pi_lines(lines: DataFrame) -> DataFrame:
    u = "message.usage."
    lines = lines if "seed" in lines.columns else lines.withColumn("seed", F.lit(None).cast(SEED))
    p = parsed(lines, PI).withColumn("type", F.when(F.col("object"), F.col("type")))
    compaction = F.col("type") == "compaction"
    at = lambda name: F.when(compaction, _tokens(f"usage.{name}")).otherwise(_tokens(u + name))
    many = lambda path: F.coalesce(F.size(path), F.lit(0))
    typed = p.select(
        *_of("path", "end_offset", "kind", "agent", "project_slug", "parent_session_id", "agent_run_id", "seed"), F.col("of_session_id").alias("fallback"), "object", "type",
        F.col("id").alias("source_entry_id"), F.col("timestamp").alias("ts"), F.col("cwd").alias("header_cwd"), _some(F.col("modelId")).alias("new_model"),
        F.when(F.col("type") == "model_change", _some(F.col("provider"))).alias("new_provider"), F.col("parentId").alias("parent_entry_id"), F.col("message").isNotNull().alias("has_message"),
        F.when(F.col("type") == "message", F.col("message.role")).alias("role"), _some(F.col("message.model")).alias("own_model"), _some(F.col("message.provider")).alias("own_provider"),
        F.col("message.responseModel").alias("response_model"), "message.api", F.col("message.stopReason").alias("stop_reason"), F.col("message.usage").isNotNull().alias("has_usage"),
        at("input").alias("input_tokens"), at("output").alias("output_tokens"), at("reasoning").alias("reasoning_tokens"), at("cacheRead").alias("cache_read_tokens"),
        at("cacheWrite").alias("written"), at("cacheWrite1h").alias("cache_write_1h_tokens"), at("totalTokens").alias("total_tokens"),
        F.when(compaction, F.col("usage.cost.total")).otherwise(F.col(u + "cost.total")).alias("reported_cost_usd"),
        F.col("tokensBefore").alias("tokens_before"), many("details.readFiles").alias("n_read"), many("details.modifiedFiles").alias("n_modified"),
        _some(F.col("message.toolCallId")).alias("result_id"), F.col("message.toolName").alias("result_name"),
        F.coalesce(F.col("message.isError").try_cast("boolean"), F.lit(False)).alias("is_error"), _blocks("message.content", "toolCall", id="id", name="name").alias("uses"))
    so_far = Window.partitionBy("path").orderBy("end_offset").rowsBetween(Window.unboundedPreceding, 0)
    header = F.col("type") == "session"
    running = lambda c, when, before: F.coalesce(F.last(F.when(when, c), ignorenulls=True).over(so_far), F.col(f"seed.{before}"))
    typed = typed.withColumns({"session_id": F.coalesce(running(_some(F.col("source_entry_id")), header, "session_id"), _some(F.col("fallback"))), "cwd": running(_some(F.col("header_cwd")), header, "cwd"),
                               "ts_epoch_ms": epoch_ms(F.col("ts"))})
    whole = F.col("session_id").isNotNull() & (F.coalesce("source_entry_id", F.lit("")) != "") & F.col("ts_epoch_ms").isNotNull()
    entry = F.coalesce(F.col("type").isin("message", "compaction"), F.lit(False))
    typed = typed.withColumns({
        "mine": entry & whole & (compaction | F.col("has_message")),
        "skipped": F.col("line") & (~F.col("object") | (entry & ~whole) | F.coalesce((F.col("type") == "message") & whole & ~F.col("has_message"), F.lit(False)))})
    billed = F.col("mine") & F.coalesce(F.col("role") == "assistant", F.lit(False)) & F.col("has_usage")
    change = F.coalesce(F.col("type") == "model_change", F.lit(False))
    return typed.withColumns({"model": running(F.when(change, F.col("new_model")).otherwise(F.col("own_model")), change | billed, "model"),
                              "active_provider": running(F.col("new_provider"), change, "provider"), "billed": billed})


def pi_state(typed: DataFrame) -> DataFrame:
    """What each file has named so far, as the seed of its next lines."""
    said = F.struct("session_id", "cwd", "model", F.col("active_provider").alias("provider"))
    return typed.filter("end_offset IS NOT NULL").groupBy("path").agg(F.max_by(said, "end_offset").alias("seed"))


def pi_messages(typed: DataFrame) -> DataFrame:
    """Billed answers and compactions; both may carry a cost of their own."""
    compaction = F.col("type") == "compaction"
    total = F.col("written")
    five = F.when(F.col("cache_write_1h_tokens") != 0, F.greatest(total - F.col("cache_write_1h_tokens"), F.lit(0))).otherwise(total)
    m = typed.filter("billed OR (mine AND type = 'compaction')").withColumns({"cache_write_5m_tokens": five, "cache_write_tokens": total})
    raw_total = F.when(F.col("total_tokens") == 0, F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens")
                       + F.when(total == 0, F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens")).otherwise(total)).otherwise(F.col("total_tokens"))
    m = m.withColumns({
        "dedup_key": F.when(compaction, keys.pi_compaction_key("source_entry_id", "ts", "tokens_before")).otherwise(keys.pi_message_key("source_entry_id", "ts", "model", raw_total)),
        "source_kind": F.col("kind"), "kind": F.when(compaction, "compaction").otherwise("assistant"),
        "provider": F.when(compaction, F.col("active_provider")).otherwise(F.coalesce("own_provider", "active_provider")),
        "stop_reason": F.when(compaction, F.format_string("compaction:read=%d,modified=%d", "n_read", "n_modified")).otherwise(F.col("stop_reason")),
        "context_tokens": F.when(compaction, F.col("tokens_before").try_cast("bigint")), "is_sidechain": F.col("agent_run_id").isNotNull(), "source_file": F.col("path"), "retry_count": F.lit(0)})
    return _shaped(with_defaults(m), MESSAGE, "source_kind", "path", "end_offset")


def pi_tool_calls(typed: DataFrame) -> DataFrame:
    use = F.transform("uses", lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"), F.lit(None).cast("boolean").alias("is_error")))
    result = F.array(F.struct(F.col("result_id").alias("id"), F.col("result_name").alias("name"), F.col("is_error").alias("is_error")))
    of = F.when(F.col("role") == "assistant", use).when(F.col("role") == "toolResult", result)
    return _calls(typed.filter("mine AND role IN ('assistant', 'toolResult')").withColumns({"call": F.col("role") == "assistant", "b": F.explode(of)}))


# The run history: one line a run of a helper, with its task, which is told by a digest only.


def history_lines(lines: DataFrame) -> DataFrame:
    numeric = lambda c: F.schema_of_variant(c).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    ts, duration, code = (F.try_variant_get("v", f"$.{k}", "variant") for k in ("ts", "duration", "exit"))
    fields = F.struct(
        F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT<")), F.lit(False)).alias("object"), _get("agent").alias("agent_type"),
        F.when(numeric(ts), F.try_variant_get("v", "$.ts", "double")).alias("at"), F.to_json(ts).alias("raw_ts"),
        F.when(numeric(duration), F.try_variant_get("v", "$.duration", "double")).alias("took"), F.to_json(duration).alias("raw_duration"), _get("status").alias("status"),
        F.when(F.startswith(F.schema_of_variant(code), F.lit("BIGINT")), F.try_variant_get("v", "$.exit", "int")).alias("exit_code"), keys.digest(_get("task")).alias("task"))
    known = (F.col("raw").isNotNull() & F.col("end_offset").isNotNull()).alias("line"), F.when(F.col("end_offset").isNull(), F.col("raw")).alias("error")
    typed = lines.withColumn("v", F.try_parse_json("raw")).select("path", "end_offset", "kind", "agent", *known, F.inline(F.array(fields)))
    return typed.withColumn("skipped", F.col("line") & (~F.col("object") | F.col("at").isNull()))


def _iso(seconds: Column) -> Column:
    """As the reference writes it: microseconds only where there are some."""
    t = F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint"))
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.pmod(F.unix_micros(t), F.lit(1_000_000)) != 0, F.date_format(t, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def history_runs(typed: DataFrame) -> DataFrame:
    took = F.col("took").cast("bigint")
    plain = lambda c: F.regexp_replace(c, r'^"|"$', "")
    r = typed.filter("line AND NOT skipped").withColumns({
        "dedup_key": keys.run_history_key("agent_type", plain(F.col("raw_ts")), plain(F.col("raw_duration")), "status"), "source": F.lit("pi-run-history"), "source_file": F.col("path"),
        "source_kind": F.col("kind"), "task_sha256": F.col("task.sha256"), "task_len": F.col("task.length"), "started_at": _iso(F.col("at")), "duration_ms": took,
        "ended_at": F.when(took.isNotNull(), _iso(F.col("at") + took / 1000))})
    return _shaped(r, RUN, "source_kind", "path", "end_offset")


def counters(typed: DataFrame) -> DataFrame:
    """Lines read and skipped of each file."""
    return typed.groupBy("path").agg(F.count_if("line").alias("lines_read"), F.count_if("skipped").alias("lines_skipped"))


def meta(raw: Column) -> Column:
    """What a run's side file says of it: agent_type, tool_use_id, spawn_depth, model, description by digest; null where it is no object (P10)."""
    v = F.try_parse_json(raw)
    get = lambda p, kind="string": F.try_variant_get(v, f"$.{p}", kind)
    said = F.struct(get("agentType").alias("agent_type"), get("toolUseId").alias("tool_use_id"), get("spawnDepth", "bigint").alias("spawn_depth"), get("model").alias("model"),
                    keys.digest(get("description")).alias("task"))
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")), said)


def parse(lines: DataFrame) -> dict[str, DataFrame]:
    """Each line by the dialect of its file's kind: messages, tool_calls, subagent_runs, counters."""
    cc, pi, rh = (claude_lines(lines.filter(F.col("kind").isin("claude_session", "claude_subagent"))),
                  pi_lines(lines.filter(F.col("kind").isin("pi_session", "pi_subagent_session"))), history_lines(lines.filter("kind = 'pi_run_history'")))
    return {"messages": claude_messages(cc).unionByName(pi_messages(pi)), "tool_calls": claude_tool_calls(cc).unionByName(pi_tool_calls(pi)),
            "subagent_runs": claude_subagent_runs(cc).unionByName(history_runs(rh)), "counters": counters(cc).unionByName(counters(pi)).unionByName(counters(rh))}
