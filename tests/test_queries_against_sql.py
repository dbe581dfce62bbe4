"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from cuelake.plans import files  # noqa: F401
from cuelake.plans import queries as plans


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, small, duck, name):
    df = plans.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    cursor = duck.execute(plans.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
    assert ours == theirs


def test_entry(spark, small):
    import __spark_entry__

    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["cue_id", "author", "state", "append_seq"]


def test_plans_stay_in_the_jvm(spark, small):
    """Evidence and export need no Python, and the newest row per key is limited before the exchange."""
    plan = plans.QUERIES["effective_revision"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    for name in ("cue_state", "srt_cues", "export_warnings", "effective_revision"):
        assert "Python" not in plans.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
