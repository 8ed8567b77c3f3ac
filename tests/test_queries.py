"""Every registered query against its SQL on the smallest driver tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
ORACLE = contract.oracle_sql()
LARGER = "/root/testdata/sf0.01"
# No holdout well of the smallest tables has an anomaly interval.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def connections():
    return {d: connect(d) for d in (SF_DIR, LARGER)}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, connections, name):
    # The SQL of the residual model is that of all three metrics; the smallest tables have a baseline for fewer.
    sf_dir = LARGER if "mcd_start AS" in ORACLE[name] else SF_DIR
    problem = compare(contract.queries()[name](spark, sf_dir), connections[sf_dir], ORACLE[name])
    assert problem == "" or problem == "no rows" and name in EMPTY


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(ORACLE)))
def test_runs(spark, name):
    df = contract.queries()[name](spark, SF_DIR)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(contract.queries())
