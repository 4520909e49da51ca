"""Identities of rows as column expressions: the same input gives the same key in every run and on every machine.

A key is null where an id that it needs is null or empty; parsers drop such rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What joins the parts of a hashed key, what stands for a null part, and how much of a digest is kept.
SEPARATOR, NULL_PART, KEY_HEX, TASK_HEX = "\x1f", "\x00", 32, 16


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hashed(*parts: Column | str) -> Column:
    """A null part and an empty one differ."""
    return F.left(F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(_c(p).cast("string"), F.lit(NULL_PART)) for p in parts]).cast("binary"), 256), F.lit(KEY_HEX))


def _given(key: Column, *ids: Column | str) -> Column:
    there = F.lit(True)
    for i in ids:
        there = there & (F.coalesce(_c(i).cast("string"), F.lit("")) != "")
    return F.when(there, key)


def message_key(message_id: Column | str, request_id: Column | str) -> Column:
    """One response of the first agent, whichever session holds a copy of it."""
    return _given(F.concat(F.lit("cc:"), _c(message_id), F.lit("|"), F.coalesce(_c(request_id), F.lit(""))), message_id)


def pi_message_key(entry_id: Column | str, ts: Column | str, model: Column | str, total: Column | str) -> Column:
    return _given(F.concat(F.lit("pi:"), hashed(entry_id, ts, model, total)), entry_id)


def pi_compaction_key(entry_id: Column | str, ts: Column | str, tokens_before: Column | str) -> Column:
    return _given(F.concat(F.lit("pic:"), hashed(entry_id, ts, tokens_before)), entry_id)


def tool_call_key(agent: Column | str, session: Column | str, call_id: Column | str) -> Column:
    return _given(F.concat(F.lit("tc:"), _c(agent), F.lit("|"), _c(session), F.lit("|"), _c(call_id)), session, call_id)


def run_history_key(name: Column | str, raw_ts: Column | str, raw_duration: Column | str, status: Column | str) -> Column:
    return F.concat(F.lit("rh:"), hashed(name, raw_ts, raw_duration, status))


def subagent_key(session: Column | str, run_id: Column | str) -> Column:
    return _given(F.concat(F.lit("sa:"), _c(session), F.lit("|"), _c(run_id)), session, run_id)


def pi_subagent_key(parent: Column | str, call_id: Column | str) -> Column:
    return _given(F.concat(F.lit("psa:"), _c(parent), F.lit("|"), _c(call_id)), parent, call_id)


def digest(text: Column | str) -> Column:
    """(sha256, length) struct in place of a text that is not to be stored; null for null."""
    t = _c(text)
    return F.when(t.isNotNull(), F.struct(F.left(F.sha2(t.cast("binary"), 256), F.lit(TASK_HEX)).alias("sha256"), F.length(t).cast("long").alias("length")))
