"""Every outcome of the rules on rows made by hand."""

import duckdb
import pytest

from tests import literal_rules
from tests.test_queries import rows_of


@pytest.mark.parametrize("name", sorted(literal_rules.QUERIES))
def test_rule(spark, sf, name):
    df = literal_rules.QUERIES[name](spark, sf)
    result = duckdb.connect().execute(literal_rules.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in result.description], result.fetchall())
