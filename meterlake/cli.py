"""The command line (K1-K3): ``python -m meterlake <command>``. Exit codes: 0 done, 1 a failure that was handled, 2 misuse."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from meterlake.functions import milliseconds, number, percent, since_ms, usd
from meterlake.operators import experiments, reports, watermarks
from meterlake.plans import ingest
from meterlake.plans.store import Store
from meterlake.settings import Settings
from meterlake.sources import rates

Rows = list[dict]
#: What each column of a table is shown as; others as they are.
SHOWN: dict[str, Callable] = {"cost_usd": usd, "total_cost_usd": usd, "avg_latency_ms": milliseconds, "avg_duration_ms": milliseconds, "duration_ms": milliseconds, "reasoning_pct": percent,
                              "cache_hit_pct": percent, "error_pct": percent, **{c: number for c in (*reports.TOKENS, "messages", "sessions", "calls", "errors", "unpriced", "message_count")}}


def session() -> SparkSession:
    s = SparkSession.builder.appName("meterlake").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def table(rows: Rows) -> str:
    """A plain table of a report's rows (S22); reports are small by what they group by."""
    if not rows:
        return "(nothing)"
    cells = [[*rows[0]], *[[str(SHOWN[k](v)) if k in SHOWN else "" if v is None else str(v) for k, v in r.items()] for r in rows]]
    wide = [max(len(r[i]) for r in cells) for i in range(len(cells[0]))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in cells)


def as_json(said: object) -> str:
    return json.dumps(said, indent=2, default=str)


def _rows(df: DataFrame) -> Rows:
    return [r.asDict() for r in df.collect()]


def messages(store: Store) -> DataFrame:
    from pyspark.sql import functions as F

    m = store.table("messages")
    return m.withColumn("day", F.to_date(F.timestamp_millis("ts_epoch_ms")))


def report(store: Store, wanted: Sequence[str], since: int | None = None, limit: int = 20) -> dict[str, Rows]:
    m = messages(store)
    make = {"daily": lambda: reports.daily(m, since), "models": lambda: reports.models(m, since), "sessions": lambda: reports.recent_sessions(store.raw("sessions"), limit, since),
            "tools": lambda: reports.tools(store.table("tool_calls"), since)}
    return {k: _rows(make[k]()) for k in make if k in wanted}


def _open(args: argparse.Namespace, create: bool = False) -> Store:
    return Store(session(), Settings.load().store_path, create)


def _config(args: argparse.Namespace) -> int:
    print(as_json(asdict(Settings.load())))
    return 0


def _init(args: argparse.Namespace) -> int:
    _open(args, create=True)
    return 0


def _collect(args: argparse.Namespace) -> int:
    s = Settings.load()
    store = _open(args, create=True)
    stats = ingest.collect(store, ingest.Roots(s.claude_projects_dir, s.pi_sessions_dir, s.pi_run_history_path), rates.load(store.spark, s.rates_dir),
                           s.max_files if args.max_files is None else args.max_files, s.max_seconds if args.max_seconds is None else args.max_seconds, args.full_rebuild, s.max_skipped_lines_per_file)
    if not args.quiet:
        print(f"{stats.files_read} of {stats.files_scanned} files, {stats.lines_read} lines, {stats.messages_upserted} messages" + " (not all files: out of budget)" * stats.partial)
        if stats.unknown_models:
            print(f"without a price: {', '.join(stats.unknown_models)}")
    return 0


def _report(args: argparse.Namespace) -> int:
    wanted = [k for k in ("daily", "models", "sessions", "tools") if getattr(args, k)] or ["daily", "models"]
    since = since_ms(args.since)
    store = _open(args)
    said = report(store, wanted, since, args.limit)
    if args.json:
        print(as_json(said))
        return 0
    for rows in said.values():
        print(table(rows) + "\n")
    unknown = _rows(reports.unknown_models(store.raw("messages")))
    if unknown:
        print(f"{sum(r['messages'] for r in unknown)} messages have no price, so totals are incomplete: {', '.join(r['model'] for r in unknown[:5])}")
    return 0


def _status(args: argparse.Namespace) -> int:
    s = _open(args)
    got = reports.status(s.raw("messages"), s.raw("sessions"), s.table("tool_calls"), s.table("subagent_runs"), s.raw("ingest_files"), s.raw("experiments"), s.raw("ingest_runs"))
    marks = _rows(watermarks.summary(s.raw("ingest_files")))[0]
    print(as_json(_rows(got)[0] | {"bytes_ingested": marks["bytes"], "lines_ingested": marks["lines"], "unparseable_lines": marks["skipped"]}))
    return 0


def _doctor(args: argparse.Namespace) -> int:
    s = _open(args)
    rows = _rows(reports.doctor(s.raw("messages"), s.raw("sessions"), s.raw("ingest_files")))
    print(table(rows))
    return 0 if all(r["passed"] for r in rows) else 1


def _experiment(args: argparse.Namespace) -> int:
    s = _open(args, create=True)
    windows = s.raw("experiments")
    if args.action in ("start", "stop"):
        made = experiments.start(windows, args.name, ingest.now_iso(), args.note) if args.action == "start" else experiments.stop(windows, ingest.now_iso(), args.name)
        with s.transaction() as w:
            w.replace("experiments", made)
        return 0
    ms = experiments.in_ms(windows)
    print(table(_rows(reports.experiments(ms, messages(s)) if args.action == "list" else reports.experiment_report(ms, messages(s), args.name))))
    return 0


def _pricing(args: argparse.Namespace) -> int:
    folder = Settings.load().rates_dir
    if args.action == "update":
        with open(args.upstream, "rb") as f:
            raw = f.read()
        import hashlib

        made = rates.update(folder, json.loads(raw), hashlib.sha256(raw).hexdigest(), args.upstream, dry_run=args.dry_run)
        print(made.diff + "(a dry run: nothing is written)\n" * args.dry_run if made.changed else "nothing has changed")
        return 0
    card = rates.load(session(), folder)
    rows = _rows(card.rates.orderBy("model"))
    print(f"{card.version}: {card.n_models} models, {card.n_aliases} aliases\n" + table([r for r in rows if args.model in (None, r["model"])]))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="meterlake", description="What coding agents cost, and how they perform.")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, to: argparse._SubParsersAction = sub) -> argparse.ArgumentParser:
        p = to.add_parser(name)
        p.set_defaults(run=run)
        return p

    command("config", _config)
    command("init", _init, sub.add_parser("db").add_subparsers(required=True))
    c = command("collect", _collect)
    c.add_argument("--max-seconds", type=int)
    c.add_argument("--max-files", type=int)
    c.add_argument("--quiet", action="store_true")
    c.add_argument("--full-rebuild", action=argparse.BooleanOptionalAction, default=False)
    r = command("report", _report)
    for k in ("daily", "models", "sessions", "tools", "json"):
        r.add_argument(f"--{k}", action="store_true")
    r.add_argument("--since")
    r.add_argument("--limit", type=int, default=20)
    command("status", _status)
    command("doctor", _doctor)
    e = sub.add_parser("experiment").add_subparsers(dest="action", required=True)
    command("start", _experiment, e).add_argument("name")
    e.choices["start"].add_argument("--note")
    command("stop", _experiment, e).add_argument("name", nargs="?")
    command("list", _experiment, e)
    command("report", _experiment, e).add_argument("name")
    p = sub.add_parser("pricing").add_subparsers(dest="action", required=True)
    command("show", _pricing, p).add_argument("--model")
    u = command("update", _pricing, p)
    u.add_argument("upstream", help="a file with the upstream list, as JSON")
    u.add_argument("--dry-run", action="store_true")
    return top


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)  # misuse exits with 2
    try:
        return args.run(args)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1

