from pathlib import Path

import pytest

import __spark_entry__ as e

SMALL = "/root/testdata/sf0.001"


def test_names_match():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not Path(SMALL).exists(), reason="the tables are not here")
def test_entry_runs(spark):
    assert e.entry(spark).count() > 0
