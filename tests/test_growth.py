"""What the large tables showed: lines are dealt to all cores, contents that are now texts and now lists are read without errors raised."""

import json

from meterlake.plans import bridge
from meterlake.sources import transcripts as t

SF = "/root/testdata/sf0.001"


def typed_claude(spark, contents, kind="assistant"):
    raws = ['{"type":"%s","sessionId":"s","timestamp":"2024-01-01T00:00:00Z","message":{"id":"m%d","content":%s,"usage":{"input_tokens":%d}}}' % (kind, i, c, i) for i, c in enumerate(contents)]
    return t.claude_lines(spark.createDataFrame([("p", i, r, "claude_session", "claude-code", "slug") for i, r in enumerate(raws)], "path string, end_offset bigint, raw string, kind string, agent string, project_slug string"))


def calls(typed):
    return [(r["end_offset"], r["tool_use_id"], r["tool_name"], r["is_error"]) for r in t.claude_tool_calls(typed).orderBy("end_offset", "tool_use_id").collect()]


def test_lines_are_dealt_to_all_cores(spark):
    """A file of events in one part is no single task; neighbours, which make one response, stay together."""
    for sql in (bridge.CLAUDE_LINES, bridge.PI_LINES, bridge.HISTORY_LINES):
        assert bridge.view(spark, SF, sql).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    from pyspark.sql import functions as F

    at = bridge.view(spark, SF, bridge.CLAUDE_LINES).select(F.floor(F.col("event_id") / 2).alias("pair"), F.spark_partition_id().alias("task"))
    assert at.groupBy("pair").agg(F.count_distinct("task").alias("n")).filter("n > 1").isEmpty()


def test_contents_of_every_shape(spark):
    """Texts (also such as look like lists), mixed lists, names twice in an input, letters by their codes: calls of lists only, and whatever stands beside is read."""
    use = '{"type":"tool_use","id":"%s","name":"n"}'
    shapes = ['"text"', json.dumps("[" + use % "text" + "]"), f'[3, "x", null, {use % "mixed"}]', '[{"type":"tool_use","id":"twice","name":"n","input":{"a":1,"a":2}}]', use % "object", "null", "7",
              r'[3, {"type":"tool_use","id":"coded","name":"n"}]', '[{"type":"text","text":"tool_use"}]']
    typed = typed_claude(spark, shapes)
    assert calls(typed) == [(2, "mixed", "n", None), (3, "twice", "n", None), (7, "coded", "n", None)]
    assert [r["input_tokens"] for r in t.claude_messages(typed).orderBy("end_offset").collect()] == list(range(len(shapes)))
    said = ["true", "false", "null", '"true"', "1", "2", "{}"]
    results = typed_claude(spark, ['[{"type":"tool_result","tool_use_id":"r","is_error":%s,"content":"x"}]' % e for e in said], "user")
    assert [c[3] for c in calls(results)] == [True, False, False, True, True, False, False]


def test_fields_of_two_kinds_have_no_fixed_type():
    """A field that isn't of its type makes Spark raise for each such line."""
    assert "content string" in t.CLAUDE and "content string" in t.PI


def test_leaks_are_counted_over_lines_parsed_once(spark, monkeypatch, tmp_path):
    """The three tables of a dialect read its written lines; nothing that was written stays but the counts."""
    from meterlake.plans import ingestion

    monkeypatch.setattr(ingestion, "scratch", lambda s: f"file://{tmp_path}/at")
    made = ingestion.f10_leaks(spark, SF)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan
    assert [p.name for p in (tmp_path / "at").iterdir()] == ["leaks"]
    assert {r["table"]: r["leaks"] for r in made.collect()}.keys() == {"lines", "messages", "tool_calls", "runs"}


def test_batches_write_what_they_hold(spark, monkeypatch, tmp_path):
    """plans of t3_replay hold no caches, which hold the plans of further ones, so none outgrows the driver; what a batch laid down for itself is gone."""
    from meterlake.plans import ingestion, store

    monkeypatch.setattr(ingestion, "scratch", lambda s: f"file://{tmp_path}/at")
    plans, write = [], store.Writer._write

    def told(self, table, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, table, df)

    monkeypatch.setattr(store.Writer, "_write", told)
    assert ingestion.t3_replay(spark, SF).count() > 0
    assert len(plans) >= 20 and max(map(len, plans)) < 100_000
    assert not any("InMemoryTableScan" in p for p in plans)
    assert not list((tmp_path / "at" / "_work").iterdir())


def test_lines_are_not_classified_one_by_one(spark, monkeypatch, tmp_path):
    """the files of a batch are told by their paths, each once."""
    from meterlake.plans import store
    from meterlake.streaming import tail

    seen, laying = [], store.Store.laying

    def told(self):
        import contextlib

        @contextlib.contextmanager
        def of():
            with laying(self) as laid:
                yield lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or laid(df)
        return of()

    monkeypatch.setattr(store.Store, "laying", told)
    s = store.Store(spark, f"file://{tmp_path}/at", buckets=2)
    batch = spark.createDataFrame([("/other/a", 1, "{}", 0)], "path string, end_offset bigint, raw string, start bigint")
    tail.take_batch(s, tail.ingest.Roots("/c", "/s", "/h"), None, batch, 0, "q", held=False)
    assert len(seen) == 2 and "RLIKE" not in seen[0] and "RLIKE" in seen[1]
    assert not s.took("q", 0)


def test_outcomes_are_those_of_merged_calls(spark):
    """sessions count calls by what they need of the halves alone."""
    import random

    from meterlake.operators import merge

    r = random.Random(3)
    rows = [(f"k{r.randrange(60)}", f"a{r.randrange(2)}", f"s{r.randrange(3)}", r.choice([None, True, False]), r.randrange(4), f"f{r.randrange(2)}", i, r.choice([None, i])) for i in range(300)]
    halves = spark.createDataFrame(rows, "dedup_key string, agent string, session_id string, is_error boolean, seq int, source_file string, end_offset int, ts_epoch_ms int").selectExpr("*", "ts_epoch_ms + 1 AS result_ts_epoch_ms")
    order = ("seq", "source_file", "end_offset")
    columns = ("dedup_key", "agent", "session_id", "is_error")
    assert sorted(map(str, merge.outcomes(halves, order).select(*columns).collect())) == sorted(map(str, merge.merge_calls(halves, order).select(*columns).collect()))


def test_a_fix_may_be_null(spark, tmp_path):
    """the last of the fixes of a latency is read, also where there is none any more."""
    from meterlake.plans.store import Store

    s = Store(spark, f"file://{tmp_path}/at", buckets=2)
    with s.transaction() as w:
        w.append("messages", spark.createDataFrame([(k, "a", "s", 1) for k in "xyz"], "dedup_key string, agent string, session_id string, latency_ms bigint"))
        w.append("latency_fixes", spark.createDataFrame([("x", "a", "s", 2, 1), ("x", "a", "s", None, 2), ("y", "a", "s", None, 1), ("y", "a", "s", 5, 2)], "dedup_key string, agent string, session_id string, latency_ms bigint, seq bigint"))
    assert {r["dedup_key"]: r["latency_ms"] for r in s.table("messages").collect()} == {"x": None, "y": 5, "z": 1}
