"""Every registered query of the evidence engine, against its SQL where it has one."""

import pytest

from evispark.plans.catalogue import ORACLE_SQL, QUERIES
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    assert differences(spark, con, SF, QUERIES[name], ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs(spark, name):
    found = QUERIES[name](spark, SF)
    if name == "directory_crawl":  # no page of the tables links to another: see crawl_atlas
        assert found.count() == 0 and found.columns == ["host", "target", "score", "rank", "page_id"]
    else:
        assert found.count() > 0
