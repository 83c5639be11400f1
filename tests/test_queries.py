import pytest

import __spark_entry__ as entry
from gapline.plans import catalogue
from tests.oracle import by_sql, same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_sql(spark, name):
    same(catalogue.QUERIES[name](spark, FOLDER).toPandas(), by_sql(catalogue.ORACLE[name], FOLDER))


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_scans_read_only_what_they_need(spark):
    plan = catalogue.QUERIES["asof_snapshot"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema:")[1].splitlines()[0]
    assert "o_orderdate" in schema and "o_totalprice" not in schema
