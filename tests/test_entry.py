import os

import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"


def test_names_agree():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_entry(spark):
    assert e.entry(spark).count() > 0
