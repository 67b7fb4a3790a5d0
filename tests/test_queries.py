"""Every registered query against its SQL on the same tables."""

import pytest

import __spark_entry__ as driver
from tests.compare import same_rows

ORACLES = driver.oracle_sql()


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, sf, name):
    query = driver.queries()[name]
    if name in ORACLES:
        same_rows(spark, sf, query, ORACLES[name])
    else:
        assert query(spark, sf).count() > 0


def test_entry_has_a_best_model(spark):
    rows = driver.entry(spark).orderBy("rank").collect()
    assert len(rows) == 4 and all(r["status"] == "fitted" for r in rows)
    assert rows[0]["accuracy"] >= rows[-1]["accuracy"] > 0.5


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(driver.queries())
