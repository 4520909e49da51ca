"""Column expressions and formatters that reports, parsers and merges share."""

from meterlake.functions.keys import digest, message_key, subagent_key, tool_call_key
from meterlake.functions.text import milliseconds, number, percent, since_ms, usd

__all__ = ["digest", "message_key", "milliseconds", "number", "percent", "since_ms", "subagent_key", "tool_call_key", "usd"]
