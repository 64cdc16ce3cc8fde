"""Every query with SQL agrees with it, on the smallest driver tables."""

from __future__ import annotations

import os

import pytest

import marketloom.plans.article_queries
import marketloom.plans.news_queries
import marketloom.plans.score_queries
import marketloom.plans.series_queries
import marketloom.plans.story_queries
import marketloom.plans.stream_queries
import marketloom.plans.table_queries  # noqa: F401
from marketloom.plans.registry import ORACLES, QUERIES
from tests import oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
