"""Registered queries on the smallest driver table, against their SQL."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from framelight.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(names, values, columns):
    at = [names.index(c) for c in columns]
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted(tuple(str(clean(v[i])) for i in at) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert rows(got.columns, got.collect(), columns) == rows(want.columns, want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_peer_audit_ends_in_its_pages_summaries(spark):
    rows = QUERIES["peer_baseline_audit"](spark, SF).collect()
    flagged = {}
    for r in rows:
        assert (r.status == "review") == (r.issues != "") and ("zoomed" in r.issues) == (r.zoom != "") and (not r.off_line or "comparable products" in r.issues)
        flagged.setdefault(r.page_id, []).append(r.status == "review")
    assert all((r.analyzed_count, r.flagged_count) == (len(flagged[r.page_id]), sum(flagged[r.page_id])) and r.page_score == 100.0 * (r.analyzed_count - r.flagged_count) / r.analyzed_count for r in rows)
    assert any("unreliable" in r.issues for r in rows) and 0 < sum(map(sum, flagged.values())) < len(rows)
