"""Article rules on made-up titles, and streams that go on where they stopped."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

from marketloom.functions import text as tx
from marketloom.operators import articles as ar
from marketloom.operators import scoring
from marketloom.plans import article_queries


@pytest.mark.parametrize(
    ("title", "text", "primary", "types"),
    [
        ("Acme earnings beat; analyst raises price target", "", "analyst_rating_or_price_target", ["earnings_or_results", "analyst_rating_or_price_target"]),
        ("Court opens  PROBE", "customers wait for chips", "regulatory_or_legal", ["product_or_ai_or_chip_news", "regulatory_or_legal"]),
        ("Where Acme stock will be in a year", "lawsuit", "prediction_or_price_target_clickbait", ["regulatory_or_legal", "prediction_or_price_target_clickbait"]),
        ("Nothing", "partners with Bolt", "partnership_or_contract", ["partnership_or_contract"]),
        ("Paid éai orders-of-magnitude", None, "customer_or_demand_signal", ["customer_or_demand_signal"]),
        (None, None, "unknown", ["unknown"]),
    ],
)
def test_article_types(spark, title, text, primary, types):
    r = ar.classified(spark.createDataFrame([(title, text)], "title string, text string")).head()
    assert (r.primary_type, r.event_types, r.seriousness) == (primary, types, ar.SERIOUSNESS[primary])


def test_source_tiers(spark):
    rows = [
        ("Reuters", "reuters.com", "https://reuters.com/a", "Acme rises", 1, "trusted_publisher"), ("Blog", "zacks.com", "u", "t", 2, "usable_financial_source"), ("PR Newswire", "x.com", "u", "t", 2, "press_release_wire"),
        ("x", "trefis.com", "u", "t", 3, "low_priority_source"), ("Reuters", "reuters.com", "u", "NBA finals", 4, "unrelated_sports_or_celebrity_terms"), ("x", "y.com", "u", "You won't believe this", 4, "obvious_spam_pattern"),
        ("x", "y.com", "https://y.com/investors/1", "t", 1, "company_investor_relations"), (None, None, None, None, 2, "unclassified_source"), ("x", "y.com", "u", "AB CD EF movie", 4, "multiple_unrelated_entities_random_event_words"), ("Mshale", "y.com", "u", "t", 4, "excluded_source"),
    ]
    df = spark.createDataFrame(rows, "publisher string, domain string, url string, title string, tier int, reason string")
    tier, reason = ar.source_tier("publisher", "domain", "url", "title")
    for r in df.select("tier", "reason", tier.alias("t"), reason.alias("r")).collect():
        assert (r.t, r.r) == (r.tier, r.reason)


def test_titles_windows_and_secrets(spark):
    df = spark.createDataFrame([("Breaking News: Acme Inc. unveils the X1 chip today", "ACME", "Acme Corp", "one two three (ACME), four five", "key sk-" + "a" * 40 + " and ghp_" + "b" * 36)], "title string, ticker string, company string, text string, secret string")
    r = df.select(ar.event_title("title", "ticker", "company").alias("t"), ar.word_window("text", "ticker", 1).alias("w"), ar.word_window("text", F.lit("none")).alias("n"), tx.redacted_secrets("secret").alias("s")).head()
    assert (r.t, r.w, r.n) == ("launch x1 chip", "three (ACME), four", None)
    assert "sk-a" not in r.s and "ghp_" not in r.s


def test_content_and_phrases(spark):
    df = spark.createDataFrame([('Free cash flow up 12% in May. "A quote of more than twenty characters" Mail a@b.c https://x.y/z?q All rights  reserved',)], "t string")
    r = df.select(ar.normalized_content("t").alias("n"), ar.key_phrases("t").alias("k")).head()
    assert "a@b.c" not in r.n and "https" not in r.n and "rights reserved" not in r.n
    assert r.k[:2] == ["free cash flow", "a quote of more than twenty characters"] and any("12" in x for x in r.k[2:])


def test_quarantine_and_ties(spark):
    df = spark.createDataFrame([(1, "x", 0.5), (2, "", 0.5), (3, "x", None)], "id int, t string, p double")
    good, bad = ar.quarantined(df, {"text": F.col("t") != "", "probability": F.col("p").between(0, 1)})
    assert [r.id for r in good.collect()] == [1] and {r.id: r.failures for r in bad.collect()} == {2: ["text"], 3: ["probability"]}
    days = spark.createDataFrame([("a", "2024-01-16", 2), ("a", "2024-01-16", 1), ("a", "2024-02-16", 0)], "symbol string, event_date string, event_id int")
    got = {r.event_id: r.next for r in scoring.upcoming(days, "2024-01-15", tie="event_id").collect()}
    assert got == {1: True, 2: False}


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    from marketloom.streaming.events import run_to_table

    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(3).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").parquet(source)
    assert run_to_table(stream(), "ids", path=sink).count() == 3
    spark.range(10, 12).write.mode("append").parquet(source)
    assert sorted(r.id for r in run_to_table(stream(), "ids", path=sink).collect()) == [0, 1, 2, 10, 11]


def test_state_goes_on_where_it_stopped(spark, tmp_path):
    from marketloom.streaming.events import upsert_state

    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1), (2, 1)], "k long, n long").write.parquet(source)
    stream = lambda: spark.readStream.schema("k long, n long").parquet(source)
    merge = lambda state, batch: state.union(batch).groupBy("k").agg(F.sum("n").alias("n"))
    assert upsert_state(stream(), "sums", merge, "k long, n long", sink).count() == 2
    spark.createDataFrame([(2, 5), (3, 1)], "k long, n long").write.mode("append").parquet(source)
    assert {r.k: r.n for r in upsert_state(stream(), "sums", merge, "k long, n long", sink).collect()} == {1: 1, 2: 6, 3: 1}


def test_forms_urls_flags_and_bands(spark):
    forms = [("8-k/a", "material_event"), (" sc13g ", "ownership_event"), ("424B5", "offering_or_prospectus"), ("def  14a", "proxy_event"), ("10-K405", None), (None, None)]
    df = spark.createDataFrame(forms, "form string, kind string")
    assert all(r.kind == (r.f.event_type if r.f else None) for r in df.select("kind", ar.filing_form("form").alias("f")).collect())
    urls = [
        ("HTTPS://WWW.Reuters.com:443/A/?b=2&utm_source=x&a=1#f", "https://www.reuters.com/A/?a=1&b=2", "reuters", "direct_publisher"), ("http://News.google.com/rss/articles/1?oc=5", "http://news.google.com/rss/articles/1?oc=5", "google", "wrapper"),
        ("http://news.google.com:80/topics", "http://news.google.com/topics", "news", "direct_publisher"), ("ftp://a.b/c", "ftp://a.b/c", "a", "unsupported"), ("No URL", "no url", "unknown", "unsupported"), (None, "", "unknown", "unsupported"),
    ]
    got = spark.createDataFrame(urls, "url string, key string, name string, kind string").select("*", tx.plain_url_key("url").alias("k"), tx.source_name("url").alias("n"), tx.url_class("url").alias("c")).collect()
    assert [(r.k, r.n, r.c) for r in got] == [(r.key, r.name, r.kind) for r in got]
    bands = spark.createDataFrame([(-1.0, 0.0), (100.0, 1.0), (65.0, 1.0), (45.0, 0.8), (85.0, 0.6), (95.0, 0.4), (10.0, 0.4)], "ease double, band double")
    assert all(r.band == r.b for r in bands.select("band", tx.readability_band(F.col("ease")).alias("b")).collect())
    assert spark.range(1).select(tx.quote_count(F.lit('"a" and "b')).alias("n")).head().n == 1


def test_types_of_whole_texts_take_seconds(spark):
    """A thousand whole texts; it took minutes when patterns ran again for each type."""
    began = time.monotonic()
    assert article_queries.article_type_counts(spark, "/root/testdata/sf0.01").collect()
    assert time.monotonic() - began < 40


def test_needed_runs_are_in_what_matches():
    said = "raises its revenue view. why the big stock popped. q3 quarter. could soar 20%. orders bookings chips data centre form 8-k ai upgraded 13f. partners with"
    for pattern in sum(ar.PATTERNS.values(), []):
        assert len(ar.needed(pattern)) > 1
        assert all(ar.needed(pattern) in m.group() for m in re.finditer(pattern, said))
