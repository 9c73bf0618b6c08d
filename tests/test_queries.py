"""Every catalog query against its SQL on the smallest tables."""

import pathlib

import pytest

import compare
from memloom.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).is_dir(), reason="tables not there")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    columns, rows = compare.sparked(QUERIES[name](spark, SF))
    if name not in ORACLE:
        assert rows
        return
    want_columns, want = compare.duck(con, ORACLE[name])
    assert columns == want_columns
    assert rows == want


@pytest.mark.parametrize("name", ["record_scan", "snapshot_update", "purge_records"])
def test_large_sides_are_not_broadcast_by_file_size(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
