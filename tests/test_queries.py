import pytest

import __spark_entry__ as entry
from keyloom.plans.queries import ALL
from tests.compare import same


@pytest.mark.parametrize("name", list(ALL))
def test_query_equals_its_sql(spark, sf_dir, name):
    query, sql = ALL[name]
    same(query(spark, sf_dir), sql, sf_dir)


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"page_id", "url", "domain"}
    assert set(ALL) <= set(entry.queries()) and set(ALL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
