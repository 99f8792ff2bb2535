import importlib

import pytest

from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
for name in ("evidence_queries", "job_queries", "project_queries", "review_queries", "stream_queries", "text_queries"):
    importlib.import_module(f"ledgerloom.plans.{name}")
registry = importlib.import_module("ledgerloom.plans.registry")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    compare(spark, FOLDER, registry.QUERIES[name], registry.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0
