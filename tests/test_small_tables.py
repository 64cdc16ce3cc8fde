"""Queries on small tables of their own, where the driver's smallest ones show no difference."""

from __future__ import annotations

from marketloom.plans import score_queries, stream_queries  # noqa: F401
from marketloom.plans.registry import ORACLES, QUERIES
from tests import oracle


def agrees(spark, folder, name: str, **tables) -> str | None:
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    return oracle.compare(QUERIES[name](spark, str(folder)), oracle.connect(str(folder)), ORACLES[name])


def test_actions_at_their_limits(spark, tmp_path):
    """Weights times whole numbers are exact, so that a score of just 1 or 2 is no 0.9999."""
    events = spark.range(77 * 101).selectExpr("id % 77 AS event_id", "id % 77 AS user_id", "(id DIV 77) / 2.0D AS value")
    assert agrees(spark, tmp_path, "fusion_actions", events=events) is None


def test_titles_cut_inside_an_entity(spark, tmp_path):
    pages = ["<title>a &amp;&amp</title>", "<title> b\n &lt;c&gt; &quot;</title><title>d</title>", "<title>e\x0bf&amp;lt;</title>", "<p>no title</p>", "", None]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    assert agrees(spark, tmp_path, "html_titles", pages=rows) is None
