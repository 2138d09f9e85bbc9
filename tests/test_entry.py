"""The driver contract."""

import __spark_entry__ as entry


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    df = entry.entry(spark)
    assert {"entity", "range_id", "ratio", "z"} <= set(df.columns)
    assert df.count() > 0
