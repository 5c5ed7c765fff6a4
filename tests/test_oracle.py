"""Every registered query against its SQL in DuckDB."""

import importlib.util
from pathlib import Path

import compare
import pytest

_spec = importlib.util.spec_from_file_location("entry", Path(__file__).resolve().parent.parent / "__spark_entry__.py")
entry = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(entry)

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    if name not in ORACLES:
        assert df.count() >= 0
        return
    assert compare.differences(df, con, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]
    assert 0 < df.count() <= 150
