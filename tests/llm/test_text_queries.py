"""Every query of the subpackage on the smallest tables; those with SQL against DuckDB."""

import pytest
from oracle import same_rows

from pitchframe.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_those_of_sql(spark, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)
