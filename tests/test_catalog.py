"""Every query with SQL must agree with it value by value on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from verification.check import compare, connect

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
EMPTY_HERE = {"view_respiratory_specimen_stays", "specimen_slice", "view_sepsis_ali_20230824", "view_icd_code_5x",
              "view_icd_code_5x_counts", "final_slice", "view_bedside_item", "view_specimen_count"}


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, folder, name):
    ok, note = compare(spark, con, folder, name, QUERIES, ORACLES)
    assert ok or (name in EMPTY_HERE and note == "rows=0"), note


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    assert contract.entry(spark).count() > 0
