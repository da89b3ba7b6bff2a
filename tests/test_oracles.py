"""Every registered query against its DuckDB oracle on the smallest fixture."""

import pytest

import __spark_entry__ as entry
from arrlens.plans import registry
from oracle_harness import compare, duck

KEYS = sorted(registry.queries())
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_key_has_an_oracle_or_is_declared_rows_only():
    rows_only = {"lr_fit", "lr_coefficients", "lr_scored_accounts"}
    assert set(KEYS) - set(SQL) == rows_only


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "expansion_readiness_score" in df.columns


@pytest.mark.parametrize("key", [k for k in KEYS if k in SQL])
def test_matches_oracle(spark, sf_dir, con, key):
    ok, msg = compare(entry.queries()[key](spark, sf_dir), con, SQL[key])
    assert ok, msg
