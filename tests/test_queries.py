"""Every registered query against its SQL, at the smallest scale."""

import pytest
from oracle_check import connect, difference

from __spark_entry__ import entry, oracle_sql, queries
from tallyloom.plans.oracles import ORACLES
from tallyloom.plans.registry import REGISTRY

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


LEDGER = sorted(REGISTRY)


def test_every_query_has_sql():
    assert set(LEDGER) == set(ORACLES) <= set(queries())


@pytest.mark.parametrize("name", LEDGER)
def test_query_equals_sql(spark, con, name):
    assert difference(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry(spark).columns == ["row_index", "amount", "anomaly_reasons_rule", "is_anomaly_rule"]
    assert entry(spark).count() > 0
