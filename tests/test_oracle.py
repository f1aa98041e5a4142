"""Every queries() entry with an oracle_sql() twin, against DuckDB on the same parquet tables.

Runs at sf0.001 by default (QUARRY_ORACLE_SF to change); the driver checks sf0.01.
"""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

SF = os.environ.get("QUARRY_ORACLE_SF", "/root/testdata/sf0.001")
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    msg, ok = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert ok, msg
