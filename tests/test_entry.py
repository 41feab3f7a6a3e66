import os

import pytest

import __spark_entry__


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 34


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) > 100 and rows[0].asDict().keys() == {"id", "depth"}
