"""Collector runs and the stream over synthetic transcripts: nothing twice, nothing lost, nothing that was said is stored."""

import json
import os

import pytest

from meterlake.operators import reports
from meterlake.plans import ingest
from meterlake.plans.store import Conflict, Store
from meterlake.sources import lines, rates

CANARY = "CANARY-SECRET-STRING"
TS = "2026-07-01T10:00:{:02d}.000Z"


def answer(msg, session="s1", second=0, blocks=("text", "tool_use"), model="m-a", **more):
    """The lines of one response: a block each, all with the same usage."""
    out = []
    for i, kind in enumerate(blocks):
        block = {"type": kind, "text": CANARY} if kind == "text" else {"type": kind, "id": f"t_{msg}_{i}", "name": "Bash", "input": {"x": CANARY}}
        out.append({"type": "assistant", "uuid": f"{msg}-{i}", "sessionId": session, "requestId": f"r_{msg}", "timestamp": TS.format(second), "cwd": "/home/x",
                    "message": {"id": msg, "role": "assistant", "model": model, "content": [block],
                                "usage": {"input_tokens": 100, "output_tokens": 10, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 7}}, **more})
    return out


def result(msg, second, session="s1", i=1, **more):
    return {"type": "user", "uuid": f"u{msg}", "sessionId": session, "timestamp": TS.format(second),
            "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": f"t_{msg}_{i}", "content": CANARY, **more}]}}


def pi_answer(entry, second, usage=True, **more):
    message = {"role": "assistant", "provider": "x", "content": [{"type": "toolCall", "id": f"c{entry}", "name": "bash", "arguments": {"a": CANARY}}], **more}
    if usage:
        message["usage"] = {"input": 9, "output": 3, "reasoning": 1, "cacheRead": 2, "cacheWrite": 4, "totalTokens": 18, "cost": {"total": 0.25}}
    return {"type": "message", "id": entry, "timestamp": TS.format(second), "message": message}


def write(path, rows, mode="w", end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open(mode) as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + end)


@pytest.fixture
def world(tmp_path, spark):
    """(roots, store, card, files) over one session, a helper of it, a session of the second dialect, a helper of that, the run history, and files that are none."""
    c, p, h = tmp_path / "c", tmp_path / "p", tmp_path / "run-history.jsonl"
    one = c / "slug" / "s1.jsonl"
    write(one, [*answer("a1"), result("a1", 3), "not json", "[1]", '{"type":"file-history-delta"}', {"type": "assistant", "message": {"id": "zz"}}])
    write(c / "slug" / "s1" / "subagents" / "agent-7.jsonl", answer("b1", second=5, agentId="7", isSidechain=True, attributionAgent="Explore"))
    write(c / "slug" / "s1" / "subagents" / "journal.jsonl", answer("never"))
    pi = p / "slug" / "2026-07-01T10-00-00-000Z_019f-ab.jsonl"
    write(pi, [{"type": "session", "id": "019f-ab", "cwd": "/w"}, {"type": "model_change", "id": "e0", "modelId": "m-p", "provider": "pr"}, pi_answer("e1", 1),
               {"type": "message", "id": "e2", "timestamp": TS.format(2), "message": {"role": "toolResult", "toolCallId": "ce1", "toolName": "bash", "isError": True, "content": CANARY}}])
    write(p / "slug" / "2026-07-01T10-00-00-000Z_019f-ab" / "call1" / "run-0" / "session.jsonl", [{"type": "session", "id": "sub"}, pi_answer("e9", 4, model="m-q")])
    write(p / "slug" / "claude-code-artifacts" / "x" / "run-0" / "session.jsonl", [{"type": "session", "id": "no"}, pi_answer("no", 4)])
    write(h, [{"agent": "scout", "task": CANARY, "ts": 1782900000, "status": "ok", "duration": 1500, "exit": 0}, {"agent": "x", "ts": "soon"}])
    r = tmp_path / "rates"
    r.mkdir()
    (r / "ACTIVE").write_text("v1\n")
    (r / "pricing-v1.json").write_text(json.dumps({"version": "v1", "models": {"m-a": {f"{n}_usd_per_token": x for n, x in zip(rates.NAMES, (1e-6, 1e-5, 1e-7, 2e-6, 4e-6))}}}))
    (r / "model_aliases.json").write_text(json.dumps({"_note": "m-a", "<synthetic>": None, "odd": 3}))
    return ingest.Roots(str(c), str(p), str(h)), Store(spark, str(tmp_path / "store")), rates.load(spark, str(r)), {"one": one, "pi": pi, "tmp": tmp_path}


def cost(store):
    return store.raw("messages").selectExpr("round(sum(cost_usd), 9) AS c", "count(*) AS n").first()


def test_a_run_and_again(world):
    roots, store, card, files = world
    first = ingest.collect(store, roots, card)
    assert (first.files_scanned, first.files_read, first.messages_upserted, first.lines_skipped) == (5, 5, 4, 4)
    assert first.unknown_models == [] and not first.partial
    m = {r["provider_msg_id"] or r["source_entry_id"]: r for r in store.raw("messages").collect()}
    assert round(m["a1"]["cost_usd"], 9) == round(100e-6 + 10e-5 + 5e-7 + 7 * 2e-6, 9) and m["a1"]["cost_source"] == "derived" and m["a1"]["total_tokens"] == 122
    assert m["b1"]["is_sidechain"] and m["b1"]["session_id"] == "s1" and m["e1"]["model"] == "m-p" and m["e1"]["cost_source"] == "reported"
    assert m["e9"]["parent_session_id"] == "019f-ab" and m["e9"]["agent_run_id"] == "call1"
    calls = {r["tool_use_id"]: r for r in store.table("tool_calls").collect()}
    assert calls["t_a1_1"]["duration_ms"] == 3000 and calls["t_a1_1"]["is_error"] is False and calls["ce1"]["is_error"] is True and calls["ce1"]["duration_ms"] == 1000
    runs = {r["source"]: r for r in store.table("subagent_runs").collect()}
    assert runs["pi-run-history"]["task_len"] == len(CANARY) and runs["pi-run-history"]["ended_at"] == "2026-07-01T10:00:01.500000+00:00" and runs["claude-subagent-transcript"]["agent_type"] == "Explore"
    before = cost(store)
    second = ingest.collect(store, roots, card)
    assert (second.files_read, second.files_skipped, second.messages_upserted, second.bytes_read) == (0, 5, 0, 0) and cost(store) == before
    assert all(r["passed"] for r in reports.doctor(store.raw("messages"), store.raw("sessions"), store.raw("ingest_files")).collect())
    for table in store.tables():
        assert reports.leaks(store.raw(table), CANARY).isEmpty(), table
    s = {r["session_id"]: r for r in store.raw("sessions").collect()}
    assert s["s1"]["message_count"] == 2 and s["s1"]["subagent_message_count"] == 1 and s["s1"]["tool_call_count"] == 2 and s["019f-ab"]["tool_error_count"] == 1
    assert {r["table"]: r["pending"] for r in store.pending().collect()} == {"messages": 4, "sessions": 3, "tool_calls": 4, "subagent_runs": 2, "experiments": 0}
    with pytest.raises(NotImplementedError):
        store.ship("postgres://x")
    store.compact()
    assert cost(store) == before and {r["tool_use_id"]: r["duration_ms"] for r in store.table("tool_calls").collect()} == {k: r["duration_ms"] for k, r in calls.items()}


def test_files_that_change(world):
    roots, store, card, files = world
    one = files["one"]
    ingest.collect(store, roots, card)
    write(one, [*answer("a2", second=8), json.dumps(answer("a3")[0])], "a", end="")  # the last line has no end yet
    got = ingest.collect(store, roots, card)
    assert (got.files_read, got.messages_upserted, got.lines_read) == (1, 1, 2)
    with one.open("a") as f:
        f.write("\r\n\n")
    assert ingest.collect(store, roots, card).messages_upserted == 1
    assert ingest.collect(store, roots, card).files_read == 0
    text = one.read_text()
    copy = one.with_name("new")
    copy.write_text(text)
    os.replace(copy, one)  # another inode
    got = ingest.collect(store, roots, card)
    assert (got.files_rotated, got.messages_upserted) == (1, 0) and got.lines_read > 3
    one.write_text("\n".join(map(json.dumps, answer("a4", second=9))) + "\n")  # shorter
    assert ingest.collect(store, roots, card).messages_upserted == 1
    mark = {r["path"]: r for r in store.raw("ingest_files").collect()}[str(one)]
    assert mark["byte_offset"] == one.stat().st_size and mark["lines_ingested"] == 2
    # a resumed session copies history, and counts once
    write(one.with_name("s9.jsonl"), answer("a4", session="s9", second=9))
    assert ingest.collect(store, roots, card).messages_upserted == 0
    # what is appended to the second dialect has the model that was named before
    write(files["pi"], [{"type": "compaction", "id": "e5", "timestamp": TS.format(30), "tokensBefore": 77, "summary": CANARY, "details": {"readFiles": ["a"], "modifiedFiles": []}}], "a")
    assert ingest.collect(store, roots, card).messages_upserted == 1
    c = store.raw("messages").filter("kind = 'compaction'").first()
    assert (c["model"], c["provider"], c["cwd"], c["context_tokens"], c["stop_reason"], c["cost_usd"], c["cost_source"]) == ("m-p", "pr", "/w", 77, "compaction:read=1,modified=0", None, "unknown")


def test_budgets_and_tolerance(world):
    roots, store, card, files = world
    got = ingest.collect(store, roots, card, max_files=2)
    assert got.partial and got.files_read == 2
    got = ingest.collect(store, roots, card, max_skipped=0)
    assert not got.partial and got.files_read == 3
    errors = {os.path.basename(r["path"]): r["last_error"] for r in store.raw("ingest_files").collect()}
    assert errors["run-history.jsonl"].startswith("1 lines") and errors["agent-7.jsonl"] is None
    write(files["one"].with_name("u.jsonl"), answer("u1", session="u", model="mystery") + answer("u2", session="u", model="<synthetic>"))
    got = ingest.collect(store, roots, card)
    assert got.unknown_models == ["mystery"]
    assert {r["model"]: r["cost_source"] for r in store.raw("messages").filter("session_id = 'u'").collect()} == {"mystery": "unknown", "<synthetic>": "zero-rated"}


def test_the_stream_gives_the_same(world, spark):
    from meterlake.streaming import collect_available

    roots, store, card, files = world
    other = Store(spark, str(files["tmp"] / "streamed"))
    at = str(files["tmp"] / "checkpoint")
    assert collect_available(spark, other, roots, card, at) == 1
    ingest.collect(store, roots, card)
    columns = ["dedup_key", "session_id", "model", "total_tokens", "cost_usd"]
    rows = lambda s: sorted(map(repr, s.raw("messages").select(columns).collect()))
    assert rows(other) == rows(store)
    assert collect_available(spark, other, roots, card, at) == 0
    write(files["one"], [*answer("a2", second=8), '{"type":"assist'], "a", end="")
    write(files["pi"], [pi_answer("e7", 40)], "a")
    assert collect_available(spark, other, roots, card, at) == 1
    os.replace(write_copy(files["one"]), files["one"])  # rotated: read anew, and nothing counts twice
    collect_available(spark, other, roots, card, at)
    ingest.collect(store, roots, card)
    assert rows(other) == rows(store) and other.raw("messages").filter("source_entry_id = 'e7'").first()["model"] == "m-p"
    assert {r["path"]: r["byte_offset"] for r in other.raw("ingest_files").collect()} == {r["path"]: r["byte_offset"] for r in store.raw("ingest_files").collect()}


def write_copy(path):
    copy = path.with_name("copy.part")
    copy.write_text(path.read_text())
    return copy


def test_lines_of_cut_files(tmp_path, monkeypatch, spark):
    path = tmp_path / "x.jsonl"
    path.write_bytes(b"".join(b"%d%s\n" % (i, b"x" * (i % 7)) for i in range(1000)) + b"\r\n\n  \npartial")
    size = path.stat().st_size
    end = lines.last_newline(str(path), 0, size)
    assert end == size - len("partial")
    for split in (1, 3, 50, 10_000):
        got = [x for r in lines.ranges(str(path), 0, end, split) for x in lines.complete_lines(r.path, r.start, r.stop, r.limit, r.first)]
        assert [int(t.rstrip(b"x")) for t, _ in got] == list(range(1000))
    df = lines.read_lines(spark, [(str(path), 0, end)])
    s = lines.summary(df, spark.createDataFrame([(str(path), 0, size)], "path string, start bigint, size_bytes bigint")).first()
    assert (s["lines"], s["had_partial_tail"]) == (1000, True)


def test_transactions(tmp_path, spark):
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "none"), create=False)
    s = Store(spark, str(tmp_path / "s"))
    assert s.meta("schema_version") == "1"
    with pytest.raises(ZeroDivisionError), s.transaction() as w:
        w.replace("meta", spark.createDataFrame([("a", "b")], "key string, value string"))
        1 / 0
    assert s.meta("a") is None and s.meta("schema_version") == "1"
    with pytest.raises(Conflict), s.transaction() as slow:
        s.set_meta("k", "v")
        slow.append("meta", spark.createDataFrame([("a", "b")], "key string, value string"))
    assert s.meta("k") == "v" and s.meta("a") is None


def test_a_batch_that_comes_twice_and_a_crash_before_the_checkpoint(world, spark, monkeypatch):
    from meterlake.streaming import collect_available, tail

    roots, store, card, files = world
    other, at = Store(spark, str(files["tmp"] / "streamed")), str(files["tmp"] / "checkpoint")
    take, calls = tail.take_batch, []

    def twice(*args):
        take(*args)
        take(*args)

    def crash(*args):
        take(*args)
        calls.append(args[4])
        if len(calls) == 1:
            raise RuntimeError("the driver is gone")

    monkeypatch.setattr(tail, "take_batch", twice)
    assert collect_available(spark, other, roots, card, at) == 1
    write(files["pi"], [pi_answer("e3", 10), pi_answer("e4", 11)], "a")
    write(files["one"], [*answer("a2", second=8), result("a2", 9)], "a")
    monkeypatch.setattr(tail, "take_batch", crash)
    with pytest.raises(Exception, match="driver is gone"):
        collect_available(spark, other, roots, card, at)
    collect_available(spark, other, roots, card, at)
    assert calls == [1, 1]  # the same batch once more
    ingest.collect(store, roots, card)
    columns = ["dedup_key", "session_id", "model", "cost_usd", "latency_ms"]
    assert sorted(map(repr, other.table("messages").select(columns).collect())) == sorted(map(repr, store.table("messages").select(columns).collect()))
    count = lambda s, t: s.raw(t).count()
    assert [count(other, t) for t in ("tool_calls", "subagent_runs", "sessions", "ingest_files")] == [count(store, t) for t in ("tool_calls", "subagent_runs", "sessions", "ingest_files")]
    assert count(other, "ingest_runs") == 2 and all(r["duration_ms"] > 0 for r in other.raw("ingest_runs").collect())
    marks = {r["path"]: (r["lines_ingested"], r["byte_offset"]) for r in other.raw("ingest_files").collect()}
    assert marks == {r["path"]: (r["lines_ingested"], r["byte_offset"]) for r in store.raw("ingest_files").collect()} and marks[str(files["pi"])][0] == 6
    m = {r["source_entry_id"]: r for r in other.raw("messages").collect()}
    assert m["e4"]["session_id"] == "019f-ab" and m["e4"]["model"] == "m-p"
    assert all(r["passed"] for r in reports.doctor(other.table("messages"), other.raw("sessions"), other.raw("ingest_files")).collect())


def test_random_cuts_and_late_lines_give_what_one_run_gives(tmp_path, spark):
    """Files grow at random places, and late lines come after later ones: sessions, latencies and the running session and model are those of one run over whole files."""
    import random

    rng = random.Random(5)
    card = rates.RateCard("v", spark.createDataFrame([("m-a", 1e-6, 1e-5, 1e-7, 2e-6, 4e-6)], "model string, input double, output double, cache_read double, cache_write_5m double, cache_write_1h double"),
                          spark.createDataFrame([], "alias string, target string"), 1, 0)
    whole, grown = (ingest.Roots(str(tmp_path / x / "c"), str(tmp_path / x / "p"), str(tmp_path / x / "h.jsonl")) for x in "ab")
    texts = {}
    for f in range(4):
        seconds = rng.sample(range(60), 12)  # in no order
        texts["c", f"slug/s{f}.jsonl"] = "".join(json.dumps(x) + "\n" for i, s in enumerate(seconds) for x in answer(f"a{f}-{i}", session=f"s{f % 3}", second=s))
        rows = [{"type": "session", "id": f"019f-{f}", "cwd": "/w"}]
        for i, s in enumerate(seconds):
            rows += [{"type": "model_change", "id": f"c{i}", "modelId": f"m{i}", "provider": f"pr{i}"}] if rng.random() < 0.4 else []
            rows += [pi_answer(f"p{f}-{i}", s, **({"model": f"own{i}"} if rng.random() < 0.2 else {})), {"type": "compaction", "id": f"z{f}-{i}", "timestamp": TS.format(s), "tokensBefore": i}][: rng.randint(1, 2)]
        texts["p", f"slug/2026-07-01T10-00-00-000Z_019f-{f}.jsonl"] = "".join(json.dumps(x) + "\n" for x in rows)
    path = lambda x, k: tmp_path / x / k[0] / k[1]
    for k, t in texts.items():
        for x in "ab":
            path(x, k).parent.mkdir(parents=True, exist_ok=True)
        path("a", k).write_text(t)
    one, many = Store(spark, str(tmp_path / "one")), Store(spark, str(tmp_path / "many"), buckets=5)
    ingest.collect(one, whole, card)
    cuts = {k: [0, *sorted(rng.sample(range(len(t)), 2)), len(t)] for k, t in texts.items()}
    for i in range(3):
        before = {r["path"]: r["byte_offset"] for r in many.raw("ingest_files").collect()}
        for k, t in texts.items():
            with path("b", k).open("a") as out:
                out.write(t[cuts[k][i] : cuts[k][i + 1]])
        got = ingest.collect(many, grown, card)
        after = {r["path"]: r["byte_offset"] for r in many.raw("ingest_files").collect()}
        assert got.bytes_read == sum(after.values()) - sum(before.values()) and got.duration_ms > 0  # nothing is read twice
        assert all(r["passed"] for r in reports.doctor(many.table("messages"), many.raw("sessions"), many.raw("ingest_files")).collect())
    rows = lambda s, t, *c: sorted(map(repr, s.table(t).select(*c).collect()))
    for t, c in {"messages": ("dedup_key", "session_id", "cwd", "model", "provider", "latency_ms", "cost_usd"), "sessions": ("session_id", "message_count", "started_at_ms", "total_tokens", "tool_call_count", "models_used"),
                 "tool_calls": ("dedup_key", "session_id", "tool_name", "ts_epoch_ms")}.items():
        assert rows(many, t, *c) == rows(one, t, *c), t
    assert many.raw("latency_fixes").count() > 0  # a late line has changed its successor's
    many.compact()
    assert rows(many, "messages", "dedup_key", "latency_ms") == rows(one, "messages", "dedup_key", "latency_ms") and many.raw("latency_fixes").count() == 0


def test_files_that_fail_models_without_end_and_what_a_run_touches(world, spark, monkeypatch):
    roots, store, card, files = world
    many = [x for i in range(1500) for x in answer(f"q{i}", session="many", second=i % 60, blocks=("text",), model=f"nobody-{i}")]
    write(files["one"].with_name("many.jsonl"), many)
    gone, real = files["one"].with_name("gone.jsonl"), lines.read_files
    write(gone, answer("g1", session="g"))

    def read(df, *args):
        out = real(df, *args)
        gone.unlink(missing_ok=True)  # after it was listed, before a task opens it
        return out

    monkeypatch.setattr(lines, "read_files", read)
    got = ingest.collect(store, roots, card)
    assert len(got.unknown_models) == 1500 and got.messages_upserted == 1504 and got.files_read == 7
    assert json.loads(store.raw("ingest_runs").first()["unknown_models"]) == got.unknown_models
    mark = {r["path"]: r for r in store.raw("ingest_files").collect()}[str(gone)]
    assert mark["last_error"].startswith("FileNotFoundError") and mark["byte_offset"] == 0
    monkeypatch.undo()
    write(gone, answer("g1", session="g"))
    assert ingest.collect(store, roots, card).messages_upserted == 1
    # one more message: one bucket of sessions is written anew, and keys are looked up in one bucket
    before = {t: set(store._manifest()[1][t]) for t in ("sessions", "messages")}
    asked, raw = [], Store.raw
    monkeypatch.setattr(Store, "raw", lambda self, t, b=None: asked.append((t, b)) or raw(self, t, b))
    write(files["one"], answer("a9", second=50), "a")
    assert ingest.collect(store, roots, card).messages_upserted == 1
    after = {t: set(store._manifest()[1][t]) for t in ("sessions", "messages")}
    assert len(after["sessions"] - before["sessions"]) == 1 and before["messages"] < after["messages"]
    assert [len(b) for t, b in asked if t == "message_keys"] == [1] and all(len(b) == 1 for t, b in asked if t == "messages")


def test_a_backlog_in_bounded_batches(tmp_path, spark):
    """The source alone: 1,000 files, 300 at a time; an offset is a few bytes; a restart goes on."""
    for i in range(1000):
        write(tmp_path / "c" / f"slug{i % 7}" / f"s{i:04}.jsonl", [f'{{"n": {i}}}'])
    source = lines.LineStream([str(tmp_path / "c")], str(tmp_path / "state"), max_files=300)
    at, seen, sizes = source.initialOffset(), set(), []
    while (to := source.latestOffset()) != at:
        assert len(json.dumps(to)) < 1024
        got = [r for p in source.partitions(at, to) for b in source.read(p) for r in b.to_pylist()]
        sizes.append(len(got))
        seen |= {r["path"] for r in got}
        source.commit(to)
        at = to
        source = lines.LineStream([str(tmp_path / "c")], str(tmp_path / "state"), max_files=300)
    assert sizes == [300, 300, 300, 100] and len(seen) == 1000
    one = tmp_path / "c" / "slug0" / "s0000.jsonl"
    other = one.with_suffix(".part")
    other.write_text("no end yet")
    os.replace(other, one)  # rotated, without a complete line: told once
    to = source.latestOffset()
    assert to != at and source.latestOffset() == to and source.partitions(at, to)[0].ranges == []
    small = lines.LineStream([str(tmp_path / "c")], str(tmp_path / "bytes"), max_bytes=100)
    with open(small._at(small.latestOffset()["n"])) as f:
        assert 90 < sum(x["offset"] for x in json.load(f).values()) <= 100


def test_orders_are_bounded_and_taken_once(world, spark, monkeypatch):
    from meterlake.streaming import collect_available, tail

    roots, store, card, files = world
    for i in range(7):
        write(files["one"].with_name(f"n{i:02}.jsonl"), answer(f"n{i}", session=f"n{i}", blocks=("text",)))
    bad = files["one"].with_name("bad.jsonl")
    write(bad, answer("bad", session="bad"))
    write(files["one"].with_name("tail.jsonl"), ['{"type":"assist'], end="")  # no complete line
    other, at = Store(spark, str(files["tmp"] / "streamed")), str(files["tmp"] / "checkpoint")
    asked, take = [], tail.take_batch

    def taking(s, r, c, df, n, q):
        bad.unlink(missing_ok=True)  # after it was listed, before a task opens it
        asked.append((n, sorted(x["path"] for x in df.select("path").distinct().collect())))
        take(s, r, c, df, n, q)

    monkeypatch.setattr(tail, "take_batch", taking)
    assert collect_available(spark, other, roots, card, at, max_files=6) == len(asked) >= 3
    assert [n for n, _ in asked] == list(range(len(asked))) and all(len(p) <= 6 for _, p in asked)
    paths = [p for _, ps in asked for p in ps]
    assert len(paths) == len(set(paths)) == 13 and str(files["one"].with_name("tail.jsonl")) not in paths
    one = [p for p in paths if "/slug/n" in p]
    assert one == sorted(one)  # batches follow the order of paths
    marks = {r["path"]: r for r in other.raw("ingest_files").collect()}
    assert str(bad) not in marks or marks[str(bad)]["last_error"].startswith("FileNotFoundError")
    ingest.collect(store, roots, card)
    rows = lambda s, t, *c: sorted(map(repr, s.table(t).select(*c).collect()))
    assert rows(other, "messages", "dedup_key", "session_id", "cost_usd", "latency_ms") == rows(store, "messages", "dedup_key", "session_id", "cost_usd", "latency_ms")
    assert rows(other, "sessions", "session_id", "total_tokens") == rows(store, "sessions", "session_id", "total_tokens")
    # by bytes: each order but its last file keeps within the bound
    for i in range(4):
        write(files["one"].with_name(f"n{i:02}.jsonl"), answer(f"x{i}", session=f"n{i}", second=9, blocks=("text",)), "a")
    size = len(json.dumps(answer("x0", session="n0", second=9, blocks=("text",))[0])) + 1
    asked.clear()
    assert collect_available(spark, other, roots, card, at, max_bytes=2 * size) == 2
    assert [len(p) for _, p in asked] == [2, 2]
    assert other.raw("messages").count() == store.raw("messages").count() + 4


def test_listing_by_tasks(tmp_path, spark):
    from meterlake.sources import discovery

    want = set()
    for i in range(30):
        p = tmp_path / "r" / f"slug{i % 4}" / f"s{i}" / "subagents" / "deep" / f"agent-{i}.jsonl"
        write(p, ["{}"])
        want.add(str(p))
    write(tmp_path / "r" / "top.jsonl", ["{}"])
    write(tmp_path / "r" / "other.txt", ["{}"])
    (tmp_path / "r" / "empty").mkdir()
    got = discovery.listing(spark, str(tmp_path / "r"), str(tmp_path / "none"), str(tmp_path / "r" / "top.jsonl")).collect()
    assert {r["path"] for r in got} == want | {str(tmp_path / "r" / "top.jsonl")} and len(got) == 31 and all(r["size_bytes"] == 3 and r["inode"] for r in got)
