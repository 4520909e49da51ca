"""Where things lie and how much a run may take (K4). Every field can be set by an environment variable METERLAKE_<FIELD>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    claude_projects_dir: str = "~/.claude/projects"
    pi_sessions_dir: str = "~/.pi/agent/sessions"
    pi_run_history_path: str = "~/.pi/agent/run-history.jsonl"
    data_dir: str = "~/.local/share/meterlake"
    store_path: str = ""
    rates_dir: str = ""
    max_seconds: int = 240
    max_files: int = 0
    max_skipped_lines_per_file: int = 1000

    @classmethod
    def load(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        said = {f.name: env[k] for f in fields(cls) if (k := f"METERLAKE_{f.name.upper()}") in env}
        made = cls(**{k: int(v) if isinstance(getattr(cls, k), int) else v for k, v in said.items()})
        home = lambda p: os.path.expanduser(p) if "://" not in p else p
        paths = {k: home(getattr(made, k)) for k in ("claude_projects_dir", "pi_sessions_dir", "pi_run_history_path", "data_dir", "store_path", "rates_dir")}
        paths["store_path"] = paths["store_path"] or str(Path(paths["data_dir"]) / "store")
        paths["rates_dir"] = paths["rates_dir"] or str(Path(paths["data_dir"]) / "rates")
        return cls(**{f.name: paths.get(f.name, getattr(made, f.name)) for f in fields(cls)})
