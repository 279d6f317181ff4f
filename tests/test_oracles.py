"""Every registered query against its oracle SQL on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from catalog import registry

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    if name not in ORACLES:
        assert df.count() > 0
        return
    found = [f for f in differences(df, con, ORACLES[name]) if f != "no rows to compare"]
    assert not [f for f in found if not f.startswith("equal only")], found


def test_only_the_run_summary_has_no_oracle():
    assert set(QUERIES) - set(ORACLES) == {"n11_run_metrics"}


def test_entry(spark):
    got = {r.client_type: r for r in entry.entry(spark).collect()}
    assert got["direct"].request_share is None
    assert got["direct"].suppression_reason.startswith("client_type: top user ")
    assert got["codex"].request_share > 0
