"""Every registered query against its SQL twin, over the whole given tables."""

import check
import pytest

import __spark_entry__ as contract
from conftest import SMALL
from strata.plans import suite


@pytest.fixture(scope="module")
def twin():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query_equals_its_twin(spark, twin, name):
    assert check.compare(spark, twin, name, SMALL) is None


def test_every_query_has_a_twin():
    assert set(suite.QUERIES) == set(suite.ORACLES)
    assert set(suite.QUERIES) <= set(contract.queries()) and set(suite.ORACLES) <= set(contract.oracle_sql())


def test_entry_has_alerts(spark):
    rows = contract.entry(spark).collect()
    assert {row.rule_id for row in rows} == {1, 2, 3}
