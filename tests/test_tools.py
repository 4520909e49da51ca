"""Experiments, rates, settings, formatters, the command line, and windows beyond what is broadcast."""

import json
from datetime import UTC, datetime

import pytest

from meterlake import cli
from meterlake.functions import milliseconds, number, percent, since_ms, usd
from meterlake.operators import experiments, reports
from meterlake.settings import Settings
from meterlake.sources import rates


def test_experiments(spark):
    w = experiments.start(spark.createDataFrame([], experiments.EXPERIMENTS), "one", "2026-07-01T00:00:00+00:00", "why")
    for wrong in (" ", "one"):
        with pytest.raises(experiments.ExperimentError):
            experiments.start(w, wrong, "t")
    two = experiments.start(w, "two", "2026-07-02T00:00:00+00:00")
    with pytest.raises(experiments.ExperimentError, match="several"):
        experiments.stop(two, "t")
    done = experiments.stop(two, "2026-07-03T00:00:00+00:00", "one")
    for wrong in ("one", "none"):
        with pytest.raises(experiments.ExperimentError):
            experiments.stop(done, "t", wrong)
    with pytest.raises(experiments.ExperimentError, match="ran from"):
        experiments.start(done, "one", "t")
    assert [tuple(r) for r in experiments.in_ms(experiments.stop(done, "2026-07-04T00:00:00Z")).orderBy("name").collect()] == [
        ("one", 1782864000000, 1783036800000), ("two", 1782950400000, 1783123200000)]
    with pytest.raises(experiments.ExperimentError, match="no experiment is open"):
        experiments.stop(spark.createDataFrame([], experiments.EXPERIMENTS), "t")


def test_many_windows_by_sums(spark, monkeypatch):
    day = 86_400_000
    m = spark.createDataFrame([(i * day // 3, float(i)) for i in range(30)], "ts_epoch_ms bigint, cost_usd double")
    e = spark.createDataFrame([("a", 0, 3 * day), ("open", 5 * day + 1, None), ("never", 400 * day, None), ("back", 9 * day, 8 * day), ("point", day, day)], "name string, start_ms bigint, end_ms bigint")
    few = reports.experiments(e, m).collect()
    monkeypatch.setattr(reports, "MAX_WINDOWS", 1)
    assert reports.experiments(e, m).select(few[0].__fields__).collect() == few and {r["name"]: r["messages"] for r in few} == {"a": 10, "open": 14, "never": 0, "back": 0, "point": 1}


def test_rates(tmp_path, spark):
    up = {"claude-x": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6}, "claude-y": {"cache_creation_input_token_cost_1h": 3e-6}, "other": {"input_cost_per_token": 1}, "sample_spec": {}, "google/z": 3}
    models, missing = rates.convert(up)
    assert list(models) == ["claude-x", "claude-y"] and missing == ["claude-y"]
    assert models["claude-x"]["cache_write_1h_usd_per_token"] == 2e-6 and models["claude-x"]["cache_write_1h_source"] == "derived-2x-input" and models["claude-y"]["cache_write_1h_source"] == "upstream"
    first = rates.update(str(tmp_path), up, "sha", version="v1")
    assert first.changed and first.n_models == 2 and "+" in first.diff and not rates.update(str(tmp_path), up, "sha", version="v2").changed
    assert rates.update(str(tmp_path), up, "sha2", version="v2").changed and (tmp_path / "ACTIVE").read_text() == "v2\n" and (tmp_path / "pricing-v1.json").exists()
    card = rates.load(spark, str(tmp_path))
    assert (card.version, card.n_models, card.n_aliases) == ("v2", 2, 0) and card.rates.filter("model = 'claude-x'").first()["cache_write_1h"] == 2e-6


def test_words_for_people():
    assert [usd(x) for x in (None, 0.12345, 1234.5)] == ["—", "$0.1235", "$1,234.50"]
    assert (number(12345.0), percent(12.34), milliseconds(1500), number(None)) == ("12,345", "12.3%", "1.5s", "—")
    now = datetime(2026, 7, 2, tzinfo=UTC)
    assert since_ms("1d", now) == 1782864000000 and since_ms("90m", now) == 1782950400000 - 5_400_000 and since_ms(None) is None
    assert since_ms("2026-07-01") == since_ms("2026-07-01T02:00:00+02:00") == 1782864000000
    with pytest.raises(ValueError):
        since_ms("soon")


def test_settings():
    s = Settings.load({"METERLAKE_MAX_FILES": "3", "METERLAKE_DATA_DIR": "/d", "OTHER": "x"})
    assert (s.max_files, s.max_seconds, s.store_path, s.rates_dir) == (3, 240, "/d/store", "/d/rates") and "~" not in s.pi_sessions_dir


def test_command_line(tmp_path, spark, monkeypatch, capsys):
    for k in ("CLAUDE_PROJECTS_DIR", "PI_SESSIONS_DIR", "PI_RUN_HISTORY_PATH", "DATA_DIR"):
        monkeypatch.setenv(f"METERLAKE_{k}", str(tmp_path / k))
    assert cli.main(["status"]) == 1
    up = tmp_path / "up.json"
    up.write_text(json.dumps({"claude-x": {"input_cost_per_token": 1e-6}}))
    (tmp_path / "DATA_DIR" / "rates").mkdir(parents=True)
    assert cli.main(["pricing", "update", str(up), "--dry-run"]) == 0 and "claude-x" in capsys.readouterr().out and not (tmp_path / "DATA_DIR" / "rates" / "ACTIVE").exists()
    assert cli.main(["pricing", "update", str(up)]) == 0 and cli.main(["pricing", "show"]) == 0
    from tests.test_ingest import answer, write

    write(tmp_path / "CLAUDE_PROJECTS_DIR" / "slug" / "s.jsonl", answer("m1", model="claude-x-20260101") + answer("m2", model="mystery", second=4))
    assert cli.main(["db", "init"]) == 0 and cli.main(["collect"]) == 0
    assert cli.main(["experiment", "start", "one", "--note", "n"]) == 0 and cli.main(["experiment", "start", "one"]) == 1
    capsys.readouterr()
    assert cli.main(["report", "--models", "--sessions", "--tools", "--daily", "--json"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert [r["model"] for r in said["models"]] == ["claude-x-20260101", "mystery"] and said["daily"][0]["messages"] == 2 and said["tools"][0]["calls"] == 2 and said["sessions"][0]["session_id"] == "s1"
    assert cli.main(["report"]) == 0 and "1 messages have no price" in capsys.readouterr().out
    assert cli.main(["doctor"]) == 0 and cli.main(["experiment", "list"]) == 0 and cli.main(["experiment", "stop"]) == 0 and cli.main(["experiment", "report", "none"]) == 1
    assert cli.main(["status"]) == 0 and cli.main(["report", "--since", "soon"]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["nothing"])
    assert e.value.code == 2


def test_very_many_overlapping_windows(spark):
    """100,000 windows over 20,000 messages: 10^9 pairs, and as many rows as there are windows and messages."""
    import numpy as np

    rng = np.random.default_rng(2)
    at, cost = rng.integers(0, 5_000_000, 20_000), np.where(rng.random(20_000) < 0.2, np.nan, rng.integers(1, 10**6, 20_000) * 1e-7)
    low, long = rng.integers(0, 5_000_000, 100_000), rng.integers(0, 4_000_000, 100_000)
    m = spark.createDataFrame([(int(a), None if np.isnan(c) else float(c)) for a, c in zip(at, cost)], "ts_epoch_ms bigint, cost_usd double")
    e = spark.createDataFrame([(f"w{i}", int(a), None if i % 9 == 0 else int(a + b)) for i, (a, b) in enumerate(zip(low, long))], "name string, start_ms bigint, end_ms bigint")
    got = {r["name"]: (r["messages"], r["cost_usd"]) for r in reports.experiments(e, m).collect()}
    assert len(got) == 100_000
    order = np.argsort(at, kind="stable")
    t, known = at[order], np.nan_to_num(cost[order])
    for i in range(0, 100_000, 271):
        a, b = np.searchsorted(t, low[i]), len(t) if i % 9 == 0 else np.searchsorted(t, low[i] + long[i], side="right")
        n, c = got[f"w{i}"]
        assert n == b - a and (c is None or abs(c - known[a:b].sum()) < 1e-9) and (c is None) == (not (known[a:b] > 0).any())
