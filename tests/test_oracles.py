"""Registered queries against their SQL in another engine, on the smallest data.

By default a selection; SCOURFRAME_ALL=1 compares every query.
"""

import glob
import os

import pytest

import __spark_entry__ as entry
from suite import check

SF = "/root/testdata/sf0.001"
SELECTION = (
    "profile_orders_dirty", "validate_rules", "date_forms", "inject_counts", "standardize_all", "set_values_report", "dedup_near",
    "grade_cells_positional", "grade_outliers_typos", "resolve_positions", "apply_actions_report", "episode_summary",
    "versions_read", "grade_cells_ranges", "grade_dispatch", "fill_mode_hot", "fill_live",
)
NAMES = list(entry.oracle_sql()) if os.environ.get("SCOURFRAME_ALL") else SELECTION


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_every_query_has_sql():
    from suite import queries

    assert set(queries.REGISTRY) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert check.compare(got, con.execute(entry.oracle_sql()[name]).df()) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_entry(spark):
    assert entry.entry(spark).count() == 5
