from __future__ import annotations

import pytest

from prismspark.jobs import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(name, same):
    same(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(name, spark):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0


def test_every_sql_has_its_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
