"""Which files hold transcripts, of what kind, and in which order.

``listing`` has tasks walk the folders and gives a path with what the file system says of it; ``classify`` is column expressions over the path
alone, so it does the same for a listing that comes from anywhere else.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, inode bigint, size_bytes bigint, mtime_ns bigint"
#: Fixed value: what lies here was written by another tool and is counted elsewhere.
EXCLUDED = "claude-code-artifacts"
#: The shapes of paths below their root.
SESSION = r"^([^/]+)/([^/]+)\.jsonl$"
SUBAGENT = r"^([^/]+)/([^/]+)/subagents/(?:.+/)?((?i:agent-)[^/]+)\.jsonl$"
PI_SESSION = r"^([^/]+)/((?i:\d{4}-\d{2}-\d{2}T[\d-]+Z_[0-9a-f-]+))\.jsonl$"
PI_NESTED = r"^([^/]+)/([^/]+)/([^/]+)/run-[^/]*/session\.jsonl$"


def _entries(folder: str) -> Iterator[tuple[str, bool]]:
    """(path, is a folder) of what lies in ``folder``; nothing where it is missing or went away."""
    try:
        with os.scandir(folder) as found:
            for e in found:
                yield e.path, e.is_dir(follow_symlinks=False)
    except OSError:
        return


def _stat(path: str) -> tuple[int, int, int] | None:
    try:
        s = os.stat(path)
    except OSError:
        return None
    return s.st_ino, s.st_size, s.st_mtime_ns


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One level down: folders become what lies in them."""
    for b in batches:
        out = [x for path, folder in zip(b.column("path").to_pylist(), b.column("folder").to_pylist()) for x in (_entries(path) if folder else [(path, False)])]
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in out], pa.string()), "folder": pa.array([d for _, d in out], pa.bool_())})


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All JSONL files at or below each path, with what the file system says of them."""
    for b in batches:
        found: list[tuple[str, int, int, int]] = []
        for path, folder in zip(b.column("path").to_pylist(), b.column("folder").to_pylist()):
            files = (os.path.join(top, n) for top, _, names in os.walk(path) for n in names) if folder else [path]
            found += [(f, *s) for f in files if f.endswith(".jsonl") and (s := _stat(f))]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["path", "inode", "size_bytes", "mtime_ns"])


def listing(spark: SparkSession, *roots: str) -> DataFrame:
    """path, inode, size_bytes, mtime_ns of every JSONL file below (or at) ``roots``; a root that is missing has none.

    Tasks list the folders: two levels are spread over all tasks, which walk what lies below, so a project with most sessions is many tasks.  No file is a row of the driver.
    """
    tops = sorted({os.path.abspath(r) for r in roots})
    rows = spark.createDataFrame([(r, not r.endswith(".jsonl")) for r in tops], "path string, folder boolean").coalesce(1)
    n = spark.sparkContext.defaultParallelism
    for _ in range(2):
        rows = rows.mapInArrow(_spread, "path string, folder boolean").repartition(n)
    return rows.mapInArrow(_below, FILES).dropDuplicates(["path"])


def stats(files: DataFrame) -> DataFrame:
    """Adds inode, size_bytes and mtime_ns, as they are now, to ``files`` (path); null for a file that went away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_stat(p) or (None, None, None) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), *[pa.array([f[i] for f in found], pa.int64()) for i in range(3)]], names=["path", "inode", "size_bytes", "mtime_ns"])

    return files.join(files.select("path").mapInArrow(run, FILES), "path")


def pi_session_id(name: Column) -> Column:
    """What stands after the first underscore; null without one."""
    return F.when(F.contains(name, F.lit("_")), F.regexp_extract(name, r"^[^_]*_(.*)$", 1))


def classify(files: DataFrame, projects_dir: str, sessions_dir: str, history_path: str) -> DataFrame:
    """Adds agent, kind, session_id, parent_session_id, agent_run_id, project_slug; paths of no known kind go.

    ``kind`` and ``path`` are the order in which files are read, and so which copy of a message is the first.
    """
    none = F.lit(None).cast("string")

    def below(root: str) -> Column:
        r = root.rstrip("/") + "/"
        return F.when(F.startswith("path", F.lit(r)), F.substring("path", len(r) + 1, 1 << 30))

    def part(rel: Column, pattern: str, i: int) -> Column:
        return F.regexp_extract(rel, pattern, i)

    a, b = below(projects_dir), below(sessions_dir)
    run = part(a, SUBAGENT, 3)
    nested = b.rlike(PI_NESTED) & (part(b, PI_NESTED, 2) != EXCLUDED)
    row = lambda agent, kind, session, parent, run_id, slug: F.struct(
        F.lit(agent).alias("agent"), F.lit(kind).alias("kind"), session.alias("session_id"), parent.alias("parent_session_id"), run_id.alias("agent_run_id"), slug.alias("project_slug"))
    of = (F.when(a.rlike(SESSION), row("claude-code", "claude_session", part(a, SESSION, 2), none, none, part(a, SESSION, 1)))
          .when(a.rlike(SUBAGENT), row("claude-code", "claude_subagent", part(a, SUBAGENT, 2), part(a, SUBAGENT, 2), F.regexp_replace(run, "^agent-", ""), part(a, SUBAGENT, 1)))
          .when(b.rlike(PI_SESSION), row("pi", "pi_session", pi_session_id(part(b, PI_SESSION, 2)), none, none, part(b, PI_SESSION, 1)))
          .when(nested, row("pi", "pi_subagent_session", none, pi_session_id(part(b, PI_NESTED, 2)), part(b, PI_NESTED, 3), part(b, PI_NESTED, 1)))
          .when(F.col("path") == history_path, row("pi", "pi_run_history", none, none, none, none)))
    return files.withColumn("of", of).filter("of IS NOT NULL").select(*files.columns, "of.*")


def ordered(files: DataFrame) -> DataFrame:
    return files.orderBy("kind", "path")


def prefix(files: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` files in order (O3); all without a budget."""
    return ordered(files).limit(most) if most else files
