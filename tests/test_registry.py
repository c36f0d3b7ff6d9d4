"""Every registered query against its SQL twin on the smallest data folder."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from registry.base import TABLES
from tools.check import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    if name in oracle_sql():
        message = compare(df, con, oracle_sql()[name])
        assert message is None or message.startswith("ok"), message
    else:
        df.collect()


def test_entry(spark):
    assert entry(spark).count() == 1
