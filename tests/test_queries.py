"""Every registered query against its SQL check on the smallest tables, and the shape of key plans."""

from __future__ import annotations

import os
import re

import pytest
from compare import connect, mismatch

import __spark_entry__ as entry
from stairwell.plans.registry import all_oracles, all_queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
QUERIES, CHECKS = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    types = {r[0]: r[1] for r in con.execute("DESCRIBE " + CHECKS[name]).fetchall()}
    assert types == {c: SQL_TYPES[t] for c, t in df.dtypes}
    assert mismatch(spark, FOLDER, con, lambda *_: df, CHECKS[name]) is None


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


def test_the_entry_point_has_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())


def test_entry(spark):
    assert {r.part for r in entry.entry(spark).collect()} == {"overall", "HasAns", "NoAns"}


def plan_of(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark):
    schemas = set(re.findall(r"ReadSchema: (\S+)", plan_of(spark, "difficulty_levels")))
    assert schemas == {"struct<n_chars:bigint>", "struct<doc_id:bigint,n_chars:bigint>"}
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)" in plan_of(spark, "squad_exact")


@pytest.mark.parametrize("name", ["distill_gated", "random_stages", "cumulative_stages"])
def test_samples_shuffle_only_counts_and_cut_buckets(spark, name):
    """No sort or shuffle of whole levels: the rows kept outright meet no exchange but the count table's."""
    plan = plan_of(spark, name)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange rangepartitioning" not in plan

