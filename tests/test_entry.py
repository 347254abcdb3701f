"""Driver contract: entry runs, every oracle key is a registered query."""

import __spark_entry__ as E


def test_contract(spark):
    qs = E.queries()
    sql = E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 60
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and 0 <= rows[0]["health_score"] <= 100
