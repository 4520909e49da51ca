"""Rate files: the active version and its aliases as tables (S13, C5, C8), conversion of an upstream list (C6), and new versions.

A folder of rates holds ``ACTIVE`` (the version's name), ``pricing-<version>.json`` and ``model_aliases.json``; a rate card is some
hundred rows, which the driver reads.  Fetching from the network is left to the caller, who hands over the parsed list and its digest.
"""

from __future__ import annotations

import difflib
import json
import os
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: The models that are taken over, what upstream calls the rates, the factor for the one-hour rate where it has none.
PREFIXES = ("claude-", "anthropic/", "anthropic.", "deepseek/", "moonshotai/", "z-ai/", "google/", "microsoft/", "openrouter/")
UPSTREAM = {"input": "input_cost_per_token", "output": "output_cost_per_token", "cache_read": "cache_read_input_token_cost", "cache_write_5m": "cache_creation_input_token_cost"}
UPSTREAM_1H = ("cache_creation_input_token_cost_above_1hr", "cache_creation_input_token_cost_1h")
HOUR_FACTOR = 2
NAMES = ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h")


@dataclass(frozen=True)
class RateCard:
    version: str
    rates: DataFrame
    aliases: DataFrame
    n_models: int
    n_aliases: int


def load(spark: SparkSession, folder: str) -> RateCard:
    """rates (model, the five rates in USD a token) and aliases (alias, target; a null target is free)."""
    top = Path(folder)
    active = (top / "ACTIVE").read_text("utf-8").strip()
    said = json.loads((top / f"pricing-{active}.json").read_text("utf-8"))
    models = {k: v for k, v in (said.get("models") or {}).items() if isinstance(v, dict)}
    number = lambda x: None if x is None else float(x)
    rows = [(k, *[number(v.get(f"{n}_usd_per_token")) for n in NAMES]) for k, v in sorted(models.items())]
    path = top / "model_aliases.json"
    pairs = json.loads(path.read_text("utf-8")) if path.exists() else {}
    pairs = {k: v for k, v in pairs.items() if not k.startswith("_") and (v is None or isinstance(v, str))}
    return RateCard(said.get("version", active), spark.createDataFrame(rows, "model string, " + ", ".join(f"{n} double" for n in NAMES)),
                    spark.createDataFrame(sorted(pairs.items()), "alias string, target string"), len(rows), len(pairs))


def convert(upstream: dict[str, Any]) -> tuple[dict[str, dict[str, Any]], list[str]]:
    """(models by name, those without an input rate)."""
    out: dict[str, dict[str, Any]] = {}
    for name in sorted(k for k, v in upstream.items() if isinstance(v, dict) and k.startswith(PREFIXES)):
        entry = upstream[name]
        row = {"upstream_key": name} | {f"{ours}_usd_per_token": entry.get(theirs) for ours, theirs in UPSTREAM.items()}
        hour, base = next((entry[k] for k in UPSTREAM_1H if entry.get(k) is not None), None), row["input_usd_per_token"]
        source = "upstream" if hour is not None else "derived-2x-input" if base is not None else None
        out[name] = row | {"cache_write_1h_usd_per_token": HOUR_FACTOR * base if source == "derived-2x-input" else hour, "cache_write_1h_source": source}
    return out, [k for k, v in out.items() if v["input_usd_per_token"] is None]


@dataclass(frozen=True)
class Update:
    changed: bool
    version: str
    n_models: int = 0
    path: str | None = None
    diff: str = ""
    missing: list[str] = field(default_factory=list)


def update(folder: str, upstream: dict[str, Any], sha256: str | None, source_url: str = "", version: str | None = None, dry_run: bool = False) -> Update:
    """Write a new version and make it the active one; an unchanged upstream, or a dry run, writes nothing. The aliases stay as they are."""
    top = Path(folder)
    active = (top / "ACTIVE").read_text("utf-8").strip() if (top / "ACTIVE").exists() else None
    before = top / f"pricing-{active}.json"
    old = json.loads(before.read_text("utf-8")) if active and before.exists() else {}
    if sha256 is not None and old.get("upstream_sha256") == sha256:
        return Update(False, active or "")
    models, missing = convert(upstream)
    now = datetime.now(UTC)
    name = version or f"{now:%Y-%m-%d}"
    text = lambda m: json.dumps(m, indent=2, sort_keys=True).splitlines(keepends=True)
    diff = "".join(difflib.unified_diff(text(old.get("models", {})), text(models), f"pricing-{active}.json" if active else "(none)", f"pricing-{name}.json", n=2))
    said = {"version": name, "fetched_at": now.isoformat(), "source_url": source_url, "upstream_sha256": sha256, "models": models}
    target = top / f"pricing-{name}.json"
    if dry_run:
        return Update(True, name, len(models), None, diff, missing)
    for path, content in ((target, json.dumps(said, indent=2) + "\n"), (top / "ACTIVE", name + "\n")):  # the pointer comes last
        part = path.with_name(path.name + ".part")
        part.write_text(content, "utf-8")
        os.replace(part, path)
    return Update(True, name, len(models), str(target), diff, missing)
