"""Named windows of time: starting and stopping them (X1, X2). Windows may overlap (X3); a message counts in each that covers it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPERIMENTS = "name string, started_at string, ended_at string, note string, created_at string, shipped_at string"


class ExperimentError(ValueError):
    """What was asked for can't be done to these windows."""


def start(windows: DataFrame, name: str, now: str, note: str | None = None) -> DataFrame:
    """``windows`` with a new open one."""
    if not name.strip():
        raise ExperimentError("an experiment needs a name")
    if row := windows.filter(F.col("name") == name).first():
        said = f"is open since {row['started_at']}" if row["ended_at"] is None else f"ran from {row['started_at']} to {row['ended_at']}; names are not used twice"
        raise ExperimentError(f"experiment {name!r} {said}")
    return windows.unionByName(windows.sparkSession.createDataFrame([(name, now, None, note, now, None)], EXPERIMENTS))


def stop(windows: DataFrame, now: str, name: str | None = None) -> DataFrame:
    """``windows`` with one closed: that of ``name``, or the only open one."""
    if name is None:
        # a few names are enough to tell
        open_ = [r["name"] for r in windows.filter("ended_at IS NULL").orderBy("started_at", "name").limit(10).collect()]
        if len(open_) != 1:
            raise ExperimentError("no experiment is open" if not open_ else f"several experiments are open ({', '.join(open_)}): name one")
        name = open_[0]
    row = windows.filter(F.col("name") == name).first()
    if row is None:
        raise ExperimentError(f"no experiment named {name!r}")
    if row["ended_at"] is not None:
        raise ExperimentError(f"experiment {name!r} ended at {row['ended_at']}")
    return windows.withColumn("ended_at", F.when(F.col("name") == name, F.lit(now)).otherwise(F.col("ended_at")))


def in_ms(windows: DataFrame) -> DataFrame:
    """name, start_ms, end_ms, for the range joins of the reports."""
    ms = lambda c: F.unix_millis(F.try_to_timestamp(F.col(c)))
    return windows.select("name", ms("started_at").alias("start_ms"), ms("ended_at").alias("end_ms"))
