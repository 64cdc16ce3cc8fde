"""Page trees, the chain of readings, and grades of texts."""

from __future__ import annotations

import datetime as dt
import html as entities
import re

import pytest
from pyspark.sql import functions as F

from marketloom.operators import quality as qu
from marketloom.plans import story_queries
from marketloom.sources import pages as pg

SF = "/root/testdata/sf0.001"
PROSE = " ".join(f"The company said that revenue of its {w} business rose by {i} percent in the quarter." for i, w in enumerate(["cloud", "chip", "phone", "car", "bank", "food", "paper", "steel"]))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-03-05T10:20:30+02:00", (2024, 3, 5, 8, 20, 30)), ("2024-03-05T10:20:30Z", (2024, 3, 5, 10, 20, 30)), ("2024-03-05T10:20:30", (2024, 3, 5, 10, 20, 30)), ("2024-03-05 10:20:30", (2024, 3, 5, 10, 20, 30)),
        (" 2024-03-05 ", (2024, 3, 5)), ("March 5, 2024", (2024, 3, 5)), ("Mar 5, 2024", (2024, 3, 5)), ("5 March 2024", (2024, 3, 5)), ("5 Mar 2024", (2024, 3, 5)), ("yesterday", None), ("", None),
    ],
)
def test_dates(text, want):
    assert pg.parse_date(text) == (dt.datetime(*want) if want else None)


def test_selectors():
    root = pg.tree_of('<div class="a story-lead" data-x="1"><p>one<p>two <b>bold</b></div><h1 class="big headline">T</h1><img src=x><meta property="og:title" content="M">')
    texts = lambda s: [n.text("") for n in pg.select(root, s)]
    assert texts("p") == ["one", "twobold"] and texts(".a") == texts('[class*="story"]') == ["onetwobold"] and texts('h1[class*="headline"]') == ["T"] and texts(".story") == []
    assert [pg.said(n) for n in pg.select(root, '[property="og:title"]')] == ["M"] and texts("div[data]") == []


def test_parts_of_a_page():
    page = f"""<html><head><title>Short</title><meta property="og:site_name" content="The Paper"><meta property="article:published_time" content="2024-01-02"></head><body>
      <nav>Menu menu</nav><h1 class="main-title">A headline of the day</h1><span class="byline">By Ann Lee</span><span class="author">Bob Ray</span><a rel="author">Ann Lee</a><time datetime="2024-01-03T00:00:00Z">now</time>
      <span class="updated">4 Jan 2024</span><article><p>{PROSE}</p><div class="ad">Buy now</div><p>Follow us on every site. All rights reserved</p></article><aside>{PROSE * 3}</aside></body></html>"""
    title, authors, published, updated, source, readings = pg.read_page(page, "https://www.site.org/x")
    assert (title, source) == ("A headline of the day", "The Paper") and authors == ["Ann Lee", "Bob Ray", "Ann Lee"]
    assert (published, updated) == (dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 4))
    by = {m: t for m, t, _ in readings}
    assert list(by)[0] == "article" and by["article"].startswith("The company") and "Buy" not in by["article"] and "Follow" not in by["article"] and "Menu" not in by["whole_page"]


def test_density_prefers_prose_to_links():
    links = "".join(f'<p><a href="/{i}">A long line of text that is nothing but one more link to elsewhere {i}</a></p>' for i in range(40))
    page = f"<body><div id=1>{links}</div><div id=2><div>{''.join(f'<p>{s}.</p>' for s in PROSE.split('.'))}</div></div></body>"
    assert pg.dense_block(pg.without_noise(pg.tree_of(page))).text().startswith("The company said")
    assert pg.readings(pg.tree_of("")) == [] and pg.dense_block(pg.tree_of("<p>x")) is None


def test_chain_and_fallbacks(spark):
    rows = [
        (1, "https://a.org/1", f"<h1>Company revenue rose</h1><article><p>{PROSE}</p><p>{PROSE}</p></article>", "snip"), (2, "https://a.org/2", f"<h1>Company revenue</h1><div>{''.join(f'<p>{s}.</p>' for s in PROSE.split('.'))}</div>", None),
        (3, "https://a.org/3", "<title>Only a title</title><p>Too little.</p>", "a snippet"), (4, "https://a.org/4", "<title>Please wait</title>" + "<p>Please enable JavaScript and sign in to continue.</p>", None),
        (5, "https://news.google.com/5", f"<article>{PROSE}</article>", None), (6, None, None, None), (7, "not a url", "<p <b </", "  "),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, snippet string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in qu.best_reading(pg.read_pages(pages.drop("text")), "snippet").collect()}
    assert got[1].method == "article" and got[1].basis == "full_text" and got[1].grade in ("strong_full_text", "usable_full_text") and [t.method for t in got[1].tried][0] == "article"
    assert got[2].method == "text_density" and got[2].basis == "full_text"
    assert (got[3].method, got[3].basis, got[3].grade, got[3].text) == ("fallback", "snippet", "weak_text", "a snippet")
    assert (got[4].basis, got[4].grade, got[4].text) == ("title", "blocked_or_shell", "Please wait") and got[5].grade == "blocked_or_shell" and got[5].score == 0
    assert got[6].grade == "title_only" and got[6].text == "Untitled Article" and got[7].basis in ("title", "full_text")


def test_pages_of_the_table_column_by_column(spark):
    """Against regular expressions that know how the table's pages are made."""
    got = {r.page_id: r for r in story_queries.page_articles(spark, SF).collect()}
    read = {r.page_id: r for r in pg.read_pages(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert set(got) == {r.page_id for r in rows}
    for r in rows:
        page = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", "", r.html or "")
        heads = [re.sub(r"<[^>]+>", "", x) for x in re.findall(r"(?s)<h1>(.*?)</h1>", page)] or re.findall(r"(?s)<title>(.*?)</title>", page)
        want = entities.unescape(heads[0]).strip() if heads else ""
        assert got[r.page_id].title == (want if len(want) > 5 else "Untitled Article")
        body = re.search(r"(?s)<article>(.*?)</article>", page)
        text = " ".join(entities.unescape(re.sub(r"<[^>]+>", " ", body.group(1))).split()) if body else ""
        article = next((x.text for x in read[r.page_id].readings if x.method == "article"), None)
        if article is not None and not any(re.search(p, text, re.IGNORECASE) for p in pg.BOILERPLATE):
            assert article.replace(" ", "") == text.replace(" ", "")
        assert got[r.page_id].n_authors == 0 and got[r.page_id].published is None


def test_grades(spark):
    one = lambda text, **k: spark.range(1).select(qu.extraction_quality(F.lit(text).cast("string"), **k).alias("q")).head().q
    shell = one("Access denied. Verify you are human.")
    assert (shell.score, shell.grade, shell.reasons, shell.accepted) == (0.0, "blocked_or_shell", ["blocked_or_shell", "verify you are human", "access denied"], False)
    assert one("Subscription required").reasons[1] == "paywall_or_login" and one(PROSE, url=F.lit("http://news.google.com/x")).reasons == ["blocked_or_shell", "google_wrapper_unresolved"]
    # 10 + 16 length + 14 sentences + 0 one paragraph + 12 prose + 12 term + 12 title
    text = ". ".join(PROSE.split(". ")[:6]) + "."
    assert one(text, title=F.lit("Company revenue"), terms=["revenue"]).score == 76.0 and one(text, terms=["zzz"]).score == 44.0
    assert one(None).score == 0.0 and one("newsletter " * 60).reasons[-1] == "boilerplate_heavy"
    assert "high_duplicate_line_ratio" in one("\n".join(["The same line of the same text."] * 9)).reasons


def test_reading_ease(spark):
    ease = lambda text: spark.range(1).select(qu.reading_ease(F.lit(text).cast("string")).alias("e")).head().e
    assert ease(None) is None and ease(" .") is None
    assert ease("The cat sat on the mat.") == pytest.approx(206.835 - 1.015 * 6 - 84.6) and ease("table made") == pytest.approx(206.835 - 2.03 - 84.6)


def test_overall_quality(spark):
    rows = [("Profit " + PROSE * 2, 3.0, "site.org", "Ann Leeson"), (None, None, None, None), ("Stay tuned for updates", 4000.0, "other.org", None)]
    out = qu.assessed(spark.createDataFrame(rows, "text string, age double, host string, author string"), "text", "age", "host", "author", {"site.org": 0.9})
    none, good, old = sorted(out.collect(), key=lambda r: r.text or "")
    assert good.overall > max(none.overall, old.overall)
    assert good.credibility == pytest.approx(0.95) and "recent" in good.strengths and "low_credibility" not in good.issues
    assert none.credibility == 0.5 and none.timeliness == 0.5 and old.timeliness == 0.1 and old.originality == pytest.approx(0.7) and "outdated" in old.issues


def test_paywalls(spark):
    rows = [(1, "<div class=paywall>Become a member</div>"), (2, "<p>Premium content</p>"), (3, "<div class='fade-out'>" + "word " * 200), (4, "Subscribe now"), (5, "Subscribe now " + "word " * 200), (6, None), (7, "<p>Nothing special</p>")]
    got = {r.k: r.status for r in spark.createDataFrame(rows, "k int, html string").select("k", pg.paywall_status("html").alias("status")).collect()}
    assert got == {1: "paywalled", 2: "preview", 3: "preview", 4: "preview", 5: "free", 6: "free", 7: "free"}
