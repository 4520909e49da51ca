"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from meterlake.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(cols, values):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(v[i] for i in order)) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(ORACLES[name])
    cols = [c[0] for c in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(cols)
    assert rows(got.columns, got.collect()) == rows(cols, want.fetchall())


def test_alias_without_target_rates_is_unknown(spark):
    from meterlake.operators.pricing import price

    m = spark.createDataFrame([("x", "claude-code", 1, 1, 1, 1, 1, None), (None, "claude-code", 1, 1, 1, 1, 1, None), ("m-20250101", "claude-code", 2, 0, 0, 0, 0, None)],
                              "model string, agent string, input_tokens int, output_tokens int, cache_read_tokens int, cache_write_5m_tokens int, cache_write_1h_tokens int, reported_cost_usd double")
    rates = spark.createDataFrame([("m", 1.0, 1.0, 1.0, 1.0, 1.0)], "model string, input double, output double, cache_read double, cache_write_5m double, cache_write_1h double")
    aliases = spark.createDataFrame([("x", "gone")], "alias string, target string")
    got = {r["model"]: (r["cost_source"], r["cost_usd"]) for r in price(m, rates, aliases, "v").collect()}
    assert got == {"x": ("unknown", None), None: ("unknown", None), "m-20250101": ("derived", 2.0)}
