"""Every registered query of the library against its oracle, or at least run, on the smallest tables."""

import pytest

from corvane.plans import ORACLES, QUERIES
from tests.oracle import SF, assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 16
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
