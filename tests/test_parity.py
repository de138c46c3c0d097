"""Every registered query against its SQL, on whole tables of the smallest folder."""

import re

import pytest

import __spark_entry__ as registry
from tests.parity import compare, connect

FOLDER = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()
# The optional subpackage tests its own queries, some of which SQL cannot express.
OPTIONAL = re.compile(r"op\d+_|pipeline$")
QUERIES = {n: q for n, q in registry.queries().items() if not OPTIONAL.match(n)}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == {n for n in ORACLES if not OPTIONAL.match(n)}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == []


def test_entry(spark):
    assert 0 < registry.entry(spark).count() <= 10
