"""Every query with SQL gives the same rows as duckdb; names, columns and types of all are stable."""

import math

import duckdb
import pytest

from strophe import registry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


#: Queries whose work SQL can express but not in the time there is; tests/test_spectral.py holds them against plain versions.
WITHOUT_SQL = {"long_frame_spectra", "long_frame_resonances"}
SCALE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SCALE}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SCALE)
    cur = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect())
    assert got == sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in cur.fetchall())


def assert_same(spark, con, folder, name):
    df = registry.QUERIES[name](spark, str(folder))
    cur = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cur.description]
    want = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect()) == want and want


@pytest.mark.parametrize("name", ["frame_features", "frame_features_hopping", "timeline_with_events"])
def test_silent_frames_as_in_sql(spark, tmp_path, name):
    """Frames of zeros alone, and of nulls alone."""
    c = duckdb.connect()
    c.sql("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-03 10:00:00' + to_days(CAST(i // 2 AS INTEGER)) AS ts, 7::BIGINT AS user_id, 'view' AS event_type, CASE i // 2 WHEN 0 THEN 0.0 WHEN 3 THEN NULL ELSE i * 10.5 END::DOUBLE AS value, '{}' AS props FROM range(10) t(i)")
    c.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    assert_same(spark, c, tmp_path, name)


def test_balances_that_round_to_nothing_as_in_sql(spark, tmp_path):
    c = duckdb.connect()
    c.sql("CREATE TABLE customer AS SELECT 2 * i AS c_custkey, 'c' AS c_name, 1 AS c_nationkey, x AS c_acctbal, 'BUILDING' AS c_mktsegment FROM (VALUES (1::BIGINT, -0.04::DOUBLE), (2, 0.04), (3, -0.05), (4, -0.06), (5, '-0.0'::DOUBLE), (6, 0.0), (7, -12.25)) t(i, x)")
    c.sql(f"COPY customer TO '{tmp_path}/customer.parquet'")
    assert_same(spark, c, tmp_path, "prompt_briefs")


def test_onsets_of_equal_blocks_as_in_sql(spark, tmp_path):
    """Tracks with blocks that are equal but for the last bit, their lines out of order; one thread, as the SQL leaves the order of its sums open."""
    c = duckdb.connect()
    c.sql("SET threads = 1")
    c.sql("CREATE TABLE lineitem AS SELECT * FROM '/root/testdata/sf0.1/lineitem.parquet' WHERE l_suppkey IN (104, 182, 255, 278, 884) ORDER BY hash(l_orderkey, l_linenumber)")
    c.sql(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (ROW_GROUP_SIZE 2048)")
    assert_same(spark, c, tmp_path, "onset_envelope")


@pytest.mark.parametrize("name", ["admission_by_evidence", "compiled_graphs", "admission_fold", "budget_totals", "graph_compile", "plan_fingerprint"])
def test_tasks_of_plans_hold_so_many_lines(spark, small, monkeypatch, name):
    """Tasks grow in number with the lines, and what is shuffled are columns of the table, no made-up maps."""
    from strophe.operators import chunks

    monkeypatch.setattr(chunks, "SPREAD", 500)
    df = registry.QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    below = [plan[at:].splitlines()[1] for at in range(len(plan)) if plan.startswith("Exchange hashpartitioning", at)]
    assert below and all("FileScan" in x or "Filter" in x or ("Project" in x and "map" not in x) for x in below)
    assert df.rdd.getNumPartitions() == 12


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES) | WITHOUT_SQL
