"""Every registered query against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from queries.registry import QUERIES
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
# One query per kind; `python tests/compare.py` runs all of them.
FAST = [n for n in QUERIES if not n.startswith(("cluster", "similar_pairs", "rare", "top", "merge", "json", "assign"))]
SLOW = ["similar_pairs_60", "cluster_best_75", "cluster_by_namespace", "cluster_report"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", FAST + SLOW)
def test_query(spark, name):
    con, sql = duck(SF), entry.oracle_sql()[name]
    assert con.sql(f"select count(*) from ({sql})").fetchall()[0][0] > 0  # nothing against nothing would tell nothing
    assert compare(entry.queries()[name](spark, SF), con, sql) is None


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
