"""Every query on the smallest tables: against DuckDB where there is SQL, else that it gives rows of its columns."""

import pytest
from oracle import same_rows

from pitchframe.plans.catalog import FLAGSHIP, ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, matches_dir, name):
    df = QUERIES[name](spark, matches_dir)
    if name in ORACLE_SQL:
        same_rows(df, ORACLE_SQL[name], matches_dir)
    else:
        assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert FLAGSHIP in QUERIES
