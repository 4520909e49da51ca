"""Complete lines of files that are still being written (S6, S7), as batches and as a stream.

A Python data source, since neither the text reader nor the file stream knows where in a file it stopped: a
line counts once its newline is there, so what stands after the last newline stays for the next run.  A partition is a byte range of a
large file (which begins after its first newline), or several small files; it is read in blocks and sent as Arrow batches, so no task holds a file.

The stream's offset names a map from path to inode, size, time of change and the place after the last complete line.  It
is also what tells an appended file (read on) from one that was rotated, truncated or rewritten (read anew).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, end_offset bigint, raw string"
BLOCK, BATCH_BYTES, SPLIT_BYTES, PACK_BYTES = 1 << 20, 1 << 22, 128 << 20, 16 << 20


class Range(NamedTuple):
    """Lines of ``path`` that begin in [start, stop) and end before ``limit``; ``first``: start is the beginning of a line."""

    path: str
    start: int
    stop: int
    limit: int
    first: bool
    begin: int = 0


class Pack(InputPartition):
    """Ranges that one task reads."""

    def __init__(self, ranges: list[Range]) -> None:
        self.ranges = ranges


def packed(ranges: list[Range], most: int = PACK_BYTES) -> list[InputPartition]:
    """Small ranges together, in order, so that thousands of small files aren't as many tasks."""
    out: list[list[Range]] = [[]]
    held = 0
    for r in ranges:
        if out[-1] and held + r.stop - r.start > most:
            out.append([])
            held = 0
        out[-1].append(r)
        held += r.stop - r.start
    return [Pack(p) for p in out]


def last_newline(path: str, start: int, size: int) -> int:
    """The place after the last newline of bytes [start, size); ``start`` where there is none."""
    with open(path, "rb") as f:
        at = size
        while at > start:
            lo = max(start, at - BLOCK)
            f.seek(lo)
            if (i := f.read(at - lo).rfind(b"\n")) >= 0:
                return lo + i + 1
            at = lo
    return start


def ranges(path: str, start: int, limit: int, split: int = SPLIT_BYTES) -> list[Range]:
    cuts = [*range(start, limit, split), limit]
    return [Range(path, a, b, limit, a == start, start) for a, b in zip(cuts[:-1], cuts[1:])]


def complete_lines(path: str, start: int, stop: int, limit: int, first: bool = True, blank: bool = False) -> Iterator[tuple[bytes, int]]:
    """(line without its end, place after it); blank lines are left out, or given empty with ``blank``."""
    with open(path, "rb", buffering=BLOCK) as f:
        at = start
        if not first:  # the line that spans the cut belongs to the range before
            f.seek(start - 1)
            at = start - 1 + len(f.readline())
        f.seek(at)
        while at < stop and at < limit:
            line = f.readline()
            if not line.endswith(b"\n") or at + len(line) > limit:
                return
            at += len(line)
            text = line.rstrip(b"\r\n")
            if text.strip():
                yield text, at
            elif blank:
                yield b"", at


class _Rows:
    """Rows that become a batch."""

    def __init__(self) -> None:
        self.path: list[str] = []
        self.end: list[int | None] = []
        self.raw: list[str | None] = []
        self.start: list[int] = []
        self.held = 0

    def add(self, path: str, end: int | None, raw: str | None, start: int) -> None:
        self.path.append(path)
        self.end.append(end)
        self.raw.append(raw)
        self.start.append(start)
        self.held += len(raw or "")

    def batch(self, start: bool = False) -> pa.RecordBatch:
        columns = {"path": pa.array(self.path, pa.string()), "end_offset": pa.array(self.end, pa.int64()), "raw": pa.array(self.raw, pa.string())}
        return pa.RecordBatch.from_pydict(columns | ({"start": pa.array(self.start, pa.int64())} if start else {}))


def _batches(pack: Pack, start: bool = False) -> Iterator[pa.RecordBatch]:
    """Lines of a pack; with ``start`` also from where on their file is read, and a row in place of a file that went away."""
    rows = _Rows()
    for part in pack.ranges:
        try:
            for line, end in complete_lines(*part[:5]):
                rows.add(part.path, end, line.decode("utf-8", "replace"), part.begin)
                if rows.held >= BATCH_BYTES:
                    yield rows.batch(start)
                    rows = _Rows()
        except FileNotFoundError as e:
            if not start:
                raise
            rows.add(part.path, None, f"{type(e).__name__}: {e}", part.begin)
    if rows.path:
        yield rows.batch(start)


def with_ends(files: DataFrame) -> DataFrame:
    """Adds ``end``, the place after the last newline of bytes [start, size_bytes), which tasks look for; for a file that can't be opened size_bytes, so that reading it says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = []
            for path, start, size in zip(*(b.column(c).to_pylist() for c in ("path", "start", "size_bytes"))):
                try:
                    ends.append(last_newline(path, start, size))
                except OSError:
                    ends.append(size)
            yield pa.RecordBatch.from_pydict({"path": b.column("path"), "end": pa.array(ends, pa.int64())})

    return files.join(files.select("path", "start", "size_bytes").mapInArrow(run, "path string, end bigint"), "path")


def read_files(files: DataFrame, tasks: int, split: int = SPLIT_BYTES, with_start: bool = False) -> DataFrame:
    """Complete lines of ``files`` (path, start, size_bytes): path, end_offset, raw; with them a row for every piece of a file that says how far it was read (no raw), and one for a file that
    can't be read (no end_offset; raw says why).  ``with_start`` adds the file's start to each.

    Files are rows, cut into pieces of ``split`` bytes and dealt out to ``tasks`` tasks, which open them: the driver sees none of them, and one that fails is a row and no failed run.
    """
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for b in batches:
            for path, start, size, at in zip(*(b.column(c).to_pylist() for c in ("path", "start", "size_bytes", "at"))):
                end = start if at == start else None
                try:
                    for line, end in complete_lines(path, at, min(at + split, size), size, at == start, blank=True):
                        if line:
                            rows.add(path, end, line.decode("utf-8", "replace"), start)
                        if rows.held >= BATCH_BYTES:
                            yield rows.batch(with_start)
                            rows = _Rows()
                    if end is not None:
                        rows.add(path, end, None, start)
                except OSError as e:
                    rows.add(path, None, f"{type(e).__name__}: {e}", start)
        yield rows.batch(with_start)

    last = F.greatest(F.col("start"), F.col("size_bytes") - 1)
    pieces = files.select("path", "start", "size_bytes", F.explode(F.sequence("start", last, F.lit(split).cast("long"))).alias("at"))
    return pieces.repartition(tasks).mapInArrow(run, SCHEMA + (", start bigint" if with_start else ""))


class LineReader(DataSourceReader):
    def __init__(self, files: Sequence[tuple[str, int, int]]) -> None:
        self.files = files

    def partitions(self) -> list[InputPartition]:
        return packed([r for path, start, limit in self.files for r in ranges(path, start, limit)])

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        return _batches(partition)


def stat_of(path: str) -> dict[str, int]:
    s = os.stat(path)
    return {"inode": s.st_ino, "size": s.st_size, "mtime_ns": s.st_mtime_ns}


def read_from(mark: dict[str, int] | None, now: dict[str, int]) -> int | None:
    """Where to read on, None where there is nothing to read."""
    if mark is None or now["inode"] != mark["inode"] or now["size"] < mark["offset"]:
        return 0
    if mark["offset"] >= now["size"]:
        return None if (now["size"], now["mtime_ns"]) == (mark["size"], mark["mtime_ns"]) else 0
    return mark["offset"]


class LineStream(DataSourceStreamReader):
    """Micro-batches of new complete lines; a run without any has no batch.

    An offset is the number of a side file in ``state``, which holds the map of all files, so an offset is a few bytes however many files there are.  A batch takes up files
    in order of their paths until one of the budgets is spent (one file at least); the others wait for the next batch.
    """

    KEEP = 100

    def __init__(self, roots: Sequence[str], state: str, max_files: int = 0, max_bytes: int = 0) -> None:
        self.roots, self.state, self.max_files, self.max_bytes = roots, state, max_files, max_bytes
        os.makedirs(state, exist_ok=True)
        self.number = max(self._numbers(), default=0)

    def _numbers(self) -> list[int]:
        return [int(n[7:-5]) for n in os.listdir(self.state) if n.startswith("offset-") and n.endswith(".json")]

    def _at(self, number: int) -> str:
        return os.path.join(self.state, f"offset-{number:012d}.json")

    def _map(self, number: int) -> dict[str, dict[str, int]]:
        if not number:
            return {}
        with open(self._at(number)) as f:
            return json.load(f)

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _files(self) -> Iterator[str]:
        for root in self.roots:
            if os.path.isfile(root):
                yield root
            for top, _, names in os.walk(root):
                yield from (os.path.join(top, n) for n in names if n.endswith(".jsonl"))

    def latestOffset(self) -> dict:
        known = self._map(self.number)
        out, files, size = dict(known), 0, 0
        for path in sorted(self._files()):
            before = known.get(path)
            try:
                now = stat_of(path)
                begin = read_from(before, now)
                if begin is None:
                    continue
                end = last_newline(path, begin, now["size"])
            except OSError:
                continue
            if end > begin or (begin == 0 and before is not None and before["inode"] != now["inode"] and before["offset"]):
                if files and ((self.max_files and files >= self.max_files) or (self.max_bytes and size + end - begin > self.max_bytes)):
                    break
                files, size = files + 1, size + end - begin
                # a generation tells a file that was read anew from one that was read on
                out[path] = now | {"offset": end, "generation": (before or {"generation": 0})["generation"] + (begin == 0)}
        if out != known:
            self.number += 1
            part = self._at(self.number) + ".part"
            with open(part, "w") as f:
                json.dump(out, f, sort_keys=True)
            os.replace(part, self._at(self.number))
        return {"n": self.number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = self._map(start["n"]), self._map(end["n"])
        out: list[Range] = []
        for path, mark in b.items():
            old = a.get(path)
            begin = old["offset"] if old and old["generation"] == mark["generation"] else 0
            if mark["offset"] > begin:
                out += ranges(path, begin, mark["offset"])
        return packed(out)

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        return _batches(partition, start=True)

    def commit(self, end: dict) -> None:
        for n in self._numbers():
            if n < end["n"] - self.KEEP:
                os.remove(self._at(n))


class TranscriptLines(DataSource):
    """``spark.read.format("transcript_lines").option("files", json)`` or ``spark.readStream...option("roots", json).option("state", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "transcript_lines"

    def schema(self) -> str:
        return SCHEMA + ", start bigint" if "roots" in self.options else SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return LineReader([tuple(x) for x in json.loads(self.options.get("files", "[]"))])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001
        budget = [int(self.options.get(k, "0")) for k in ("max_files", "max_bytes")]
        return LineStream(json.loads(self.options["roots"]), self.options["state"], *budget)


def read_lines(spark: SparkSession, files: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Complete lines of (path, start, size) files: path, end_offset, raw."""
    spark.dataSource.register(TranscriptLines)
    return spark.read.format("transcript_lines").option("files", json.dumps([list(f) for f in files])).load()


def summary(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Per file of ``files`` (path, start, size_bytes): lines, end_offset, bytes, had_partial_tail."""
    from pyspark.sql import functions as F

    got = lines.groupBy("path").agg(F.count("*").alias("lines"), F.max("end_offset").alias("end_offset"))
    at = F.coalesce("end_offset", "start")
    return files.join(got, "path", "left").select("path", F.coalesce("lines", F.lit(0)).alias("lines"), at.alias("end_offset"), (at - F.col("start")).alias("bytes"),
                                                  (at < F.col("size_bytes")).alias("had_partial_tail"))
