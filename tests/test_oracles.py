"""Each registered query of the library against its DuckDB form, on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from orbitgrid.plans.registry import ORACLE_SQL, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same(a, b):
    """Equal but for rounding in the last digit."""
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    answer = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()]
    left, right = Counter(got), Counter(want)
    rest, other = sorted((left - right).elements(), key=repr), sorted((right - left).elements(), key=repr)
    assert len(rest) == len(other)
    assert all(same(x, y) for a, b in zip(rest, other, strict=True) for x, y in zip(a, b, strict=True)), (rest[:2], other[:2])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(FOLDER)).count() > 0


def test_mask_support_of_many_points_equals_its_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (vec_id + 1000000 * i AS vec_id, 1 AS label) FROM '{FOLDER}/embeddings.parquet', range(20) r(i)) TO '{tmp_path}/embeddings.parquet'")
    for p in FOLDER.glob("*.parquet"):
        if p.stem != "embeddings":
            (tmp_path / p.name).symlink_to(p)
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert con.execute("SELECT min(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY vec_id % 3)").fetchone()[0] > 500
    df = QUERIES["view_mask_support"](spark, str(tmp_path))
    answer = con.execute(ORACLE_SQL["view_mask_support"])
    names = [d[0] for d in answer.description]
    want = sorted(tuple(plain(v) for v in r) for r in answer.fetchall())
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert len(got) == len(want) and all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", ["balanced_selection", "blur_bursts", "blur_stats", "capture_gate", "extraction_summary", "frame_recapture_gate", "rejection_counts", "texture_budget"])
def test_frames_of_value_zero_equal_their_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    user = "CASE WHEN event_id % 3 = 0 THEN 100 + event_id // 45 ELSE user_id % 6 END"  # short sessions that begin with three zeros, and long ones
    value = "CASE WHEN event_id % 97 = 0 OR event_id % 45 IN (0, 3, 6) THEN 0 WHEN event_id % 101 = 0 THEN NULL WHEN user_id % 5 = 0 AND event_id % 7 < 3 THEN value / 1e3 ELSE value END"
    con.execute(f"COPY (SELECT * REPLACE ({user} AS user_id, {value} AS value) FROM '{FOLDER}/events.parquet') TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    answer = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    want = sorted((tuple(plain(v) for v in r) for r in answer.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert len(got) == len(want) and all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_sessions_without_any_sharpness_equal_their_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN user_id % 2 = 0 THEN NULL WHEN user_id % 5 = 0 THEN -value ELSE value END AS value) FROM '{FOLDER}/events.parquet') TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    answer = con.execute(ORACLE_SQL["frame_recapture_gate"])
    names = [d[0] for d in answer.description]
    want = sorted(answer.fetchall(), key=repr)
    assert any(None in r[1:2] for r in want)
    assert sorted((tuple(r[n] for n in names) for r in QUERIES["frame_recapture_gate"](spark, str(tmp_path)).collect()), key=repr) == want


@pytest.mark.parametrize("name", ["stream_adaptive_sampling", "stream_redundancy"])
def test_a_stream_of_what_is_there_judges_every_frame(spark, name):
    ids = QUERIES[name](spark, str(FOLDER)).select("event_id")
    events = spark.read.parquet(str(FOLDER / "events.parquet")).select("event_id")
    assert ids.exceptAll(events).isEmpty() and events.exceptAll(ids).isEmpty()


def test_coverage_report_folds_its_frames_once(spark):
    df = QUERIES["coverage_report"](spark, str(FOLDER))
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
