"""Every registered query with an SQL twin, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twin(spark, con, name):
    assert difference(spark, con, FOLDER, name) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_rows(spark, name):
    assert len(entry.queries()[name](spark, FOLDER).collect()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
