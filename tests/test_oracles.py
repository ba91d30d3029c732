"""Every registered query against its SQL on the smallest test tables."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as contract
from touchstone.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, folder, duck, name):
    assert difference(QUERIES[name](spark, folder), duck, ORACLES[name]) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert contract.entry(spark).count() == 140
