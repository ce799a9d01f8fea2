"""Every named query that has an oracle must agree with it (TEST_SF picks the scale)."""

import os

import pytest

import __spark_entry__ as entry
from tests import oracle

SCALE = os.environ.get("TEST_SF", "0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(oracle.folder(SCALE))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_oracle(spark, duck, name):
    frame = entry.queries()[name](spark, oracle.folder(SCALE))
    assert oracle.compare(frame, duck, entry.oracle_sql()[name]) == []


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
