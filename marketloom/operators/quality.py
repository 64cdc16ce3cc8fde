"""Grades of extracted texts, and reading ease, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.text import col, let
from marketloom.operators.articles import listed

# What empty pages and boilerplate say, verbs and words of articles, and hosts that only wrap.
SHELL_PHRASES = ["accept all cookies", "cookie preferences", "enable javascript", "sign in to continue", "subscribe to continue", "subscription required", "verify you are human", "access denied", "captcha"]
LOGIN_TERMS = ["sign in", "subscribe", "subscription"]
BOILERPLATE_PHRASES = ["all rights reserved", "cookie policy", "privacy policy", "terms of use", "skip to content", "newsletter", "advertisement", "related articles", "follow us"]
ARTICLE_VERBS = ["said", "reported", "announced", "expects", "forecast", "rose", "fell", "increased", "declined", "launched", "filed", "agreed"]
ARTICLE_WORDS = r"\b(?:company|stock|shares|revenue|market|business|investors?)\b"
WRAPPERS = ["news.google.com", "www.news.google.com"]
# Fixed values: (least, points, reason) of length, sentences and paragraphs, the last without a least.
LENGTHS = [(1600, 30, "substantial_text_length"), (800, 24, "good_text_length"), (400, 16, "moderate_text_length"), (220, 8, "short_article_text"), (None, -12, "too_short")]
SENTENCES = [(10, 20, "many_article_sentences"), (5, 14, "several_article_sentences"), (3, 8, "limited_sentence_count"), (None, -8, "too_few_sentences")]
PARAGRAPHS = [(5, 10, "multiple_paragraphs"), (2, 6, "more_than_one_paragraph"), (None, 0, "single_paragraph")]
STRONG, USABLE = 75, 52
# Weights of financial terms, of the parts of an article's quality, its limits, and the patterns of numbers, events, months and unripe news.
TERM_WEIGHTS = {
    "earnings": 3.0, "revenue": 3.0, "profit": 3.0, "loss": 3.0, "eps": 2.5, "ebitda": 2.5, "cash flow": 2.5, "dividend": 2.5, "merger": 3.0, "acquisition": 3.0, "ipo": 3.0, "buyback": 2.5,
    "stock": 2.0, "shares": 2.0, "market": 2.0, "trading": 2.0, "price": 2.0, "volume": 1.5, "volatility": 2.0, "index": 1.5, "analyst": 1.5, "forecast": 2.0, "guidance": 2.5, "outlook": 2.0,
    "growth": 1.5, "expansion": 1.5, "partnership": 1.5, "deal": 1.5, "investment": 1.8, "funding": 1.8, "valuation": 2.0, "startup": 1.2, "innovation": 1.0, "technology": 1.0, "product": 1.0, "service": 1.0,
}
PART_WEIGHTS = {"relevance": 0.25, "content": 0.20, "credibility": 0.15, "timeliness": 0.10, "structure": 0.10, "originality": 0.10, "readability": 0.05, "factual": 0.05}
MIN_WORDS, MAX_WORDS, MIN_SENTENCES, MIN_PARAGRAPHS, MAX_SENTENCE_WORDS, MIN_TERMS, FRESH_HOURS, DECAY_DAYS = 150, 5000, 5, 2, 35, 3, 24, 7
NUMBERS = r"\$[\d,]+(?:\.\d{2})?|\d+(?:\.\d+)?%|\d+(?:,\d{3})*(?:\.\d+)?"
FINANCIAL_NUMBERS = [r"\$[\d,]+(?:\.\d{2})?", r"\d+(?:\.\d+)?%", r"\d+(?:\.\d+)?[BMK]?", r"Q[1-4]\s+\d{4}", r"FY\s*\d{4}"]
FINANCIAL_EVENTS = [r"earnings\s+(?:report|call|release)", r"(?:beats?|misses?)\s+(?:estimates?|expectations?)", r"(?:quarterly|annual)\s+results?", r"(?:dividend|stock)\s+(?:increase|cut|split)", r"merger|acquisition|buyout|takeover", r"IPO|initial\s+public\s+offering"]
MONTHS = r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b"
UNRIPE = [r"this\s+is\s+a\s+breaking\s+news", r"developing\s+story", r"more\s+details\s+to\s+follow", r"stay\s+tuned\s+for\s+updates"]


def has_one(text: Column, terms: Iterable[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(t)) for t in terms))


def times(text: Column, phrase: str) -> Column:
    """How often a phrase occurs, without overlap."""
    return (F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / F.lit(len(phrase))


def graded(value: Column, steps) -> Column:
    """``struct<points, reason>`` of the first step that the value reaches."""
    out = None
    for least, points, reason in steps:
        step = F.struct(F.lit(float(points)).alias("points"), F.lit(reason).alias("reason"))
        out = (F.when(value >= least, step) if out is None else out.when(value >= least, step)) if least is not None else out.otherwise(step)
    return out


def step(points, reason) -> Column:
    return F.struct(F.lit(points).cast("double").alias("points"), F.lit(reason).cast("string").alias("reason"))


def sentences(text: Column) -> Column:
    """Parts between sentence ends, of twenty characters or more."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), F.trim), lambda s: F.length(s) >= 20)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def prose_share(parts: Column) -> Column:
    """The share of sentences of seven words or more that read like an article's."""
    like = lambda s: (F.size(F.split(s, r"\s+")) >= 7) & (has_one(F.lower(s), ARTICLE_VERBS) | F.lower(s).rlike(ARTICLE_WORDS))
    return F.size(F.filter(parts, like)) / F.greatest(F.size(parts), F.lit(1))


def repeated_share(lines: Column) -> Column:
    """The share of lines of twenty characters or more that repeat another."""
    long = F.transform(F.filter(lines, lambda x: F.length(x) >= 20), F.lower)
    return let(long, lambda x: F.when(F.size(x) < 2, 0.0).otherwise(1 - F.size(F.array_distinct(x)) / F.size(x)))


def extraction_quality(text, title=None, url=None, terms: Iterable[str] = (), paragraphs=None) -> Column:
    """``struct<score, grade, reasons, accepted>`` of a text: 0 to 100, and what added to it or took from it.

    Pages of a wrapper, and texts that mostly ask for a login or a cookie, are
    shells of score 0. A null text is an empty one; without a count of
    paragraphs the lines count.
    """
    raw = F.coalesce(col(text), F.lit(""))
    lines = F.filter(F.transform(F.split(raw, r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    title = F.lit(None).cast("string") if title is None else col(title)
    url = F.lit("") if url is None else F.coalesce(col(url), F.lit(""))
    line = F.trim(F.regexp_replace(raw, r"\s+", " "))
    paragraphs = F.size(lines) if paragraphs is None else col(paragraphs)
    given = F.struct(line.alias("line"), F.lower(line).alias("low"), sentences(line).alias("parts"), F.coalesce(paragraphs, F.lit(0)).alias("paragraphs"), repeated_share(lines).alias("again"), tokens(F.coalesce(title, F.lit(""))).alias("title"), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"))
    return let(given, lambda x: _quality(x, [t.lower().strip() for t in terms if t and t.strip()]))


def _quality(x: Column, terms: list[str]) -> Column:
    low, parts = x["low"], x["parts"]
    shells = F.filter(listed(SHELL_PHRASES), lambda p: F.contains(low, p))
    shell_share = reduce(add, (times(low, p) * len(p) for p in SHELL_PHRASES)) / F.greatest(F.length(x["line"]), F.lit(1))
    is_shell = (F.size(shells) > 0) & ((F.length(x["line"]) < 500) | (shell_share >= 0.15))
    reason = F.when(has_one(low, LOGIN_TERMS), "paywall_or_login").otherwise("blocked_or_shell")
    shell = lambda reasons: F.struct(F.lit(0.0).alias("score"), F.lit("blocked_or_shell").alias("grade"), F.array_distinct(reasons).alias("reasons"), F.lit(False).alias("accepted"))
    prose, nothing = prose_share(parts), step(0, None)
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect(x["title"], tokens(x["line"]))), F.size(x["title"])), F.lit(0.0))
    clutter = reduce(add, (times(low, p) for p in BOILERPLATE_PHRASES))
    steps = [graded(F.length(x["line"]), LENGTHS), graded(F.size(parts), SENTENCES), graded(x["paragraphs"], PARAGRAPHS)]
    steps.append(F.when(prose >= 0.6, step(12, "article_like_prose")).when(prose < 0.3, step(-10, "limited_article_like_prose")).otherwise(nothing))
    if terms:
        said = reduce(or_, (low.rlike(f"(?<![a-z0-9])\\Q{t}\\E(?![a-z0-9])") for t in terms))
        steps.append(F.when(said, step(12, "ticker_or_company_mentioned")).otherwise(step(-8, "missing_ticker_context")))
    steps.append(F.when(overlap >= 0.45, step(12, "strong_title_overlap")).when(overlap >= 0.2, step(7, "some_title_overlap")).otherwise(nothing))
    few = F.struct((-F.least(F.lit(10.0), clutter * 3)).alias("points"), F.lit("boilerplate_detected").alias("reason"))
    steps.append(F.when(clutter / F.greatest(F.size(parts), F.lit(1)) >= 0.5, step(-25, "boilerplate_heavy")).when(clutter > 0, few).otherwise(nothing))
    steps.append(F.when(x["again"] >= 0.35, step(-20, "high_duplicate_line_ratio")).when(x["again"] >= 0.15, step(-8, "duplicate_lines_detected")).otherwise(nothing))
    scored = let(F.array(*steps), lambda s: F.struct(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.aggregate(s, F.lit(10.0), lambda a, y: a + y["points"]))), 2).alias("score"), F.array_distinct(F.filter(F.transform(s, lambda y: y["reason"]), lambda r: r.isNotNull())).alias("reasons")))
    grade = lambda s: F.when(s >= STRONG, "strong_full_text").when(s >= USABLE, "usable_full_text").otherwise("weak_text")
    full = let(scored, lambda y: F.struct(y["score"].alias("score"), grade(y["score"]).alias("grade"), y["reasons"].alias("reasons"), (y["score"] >= USABLE).alias("accepted")))
    first = F.concat(F.array(F.lit("blocked_or_shell"), reason), F.slice(shells, 1, 3))
    return F.when(x["host"].isin(WRAPPERS), shell(listed(["blocked_or_shell", "google_wrapper_unresolved"]))).when(is_shell, shell(first)).otherwise(full)


def best_reading(pages: DataFrame, snippet: str | None = None, terms: Iterable[str] = ()) -> DataFrame:
    """``pages`` (``title, url, readings``) with the text that won: the first reading that is accepted, else the snippet, else the title.

    ``tried`` lists the methods with their scores, ``method`` is the one that
    won or ``fallback``, ``basis`` full_text, snippet, title or failed.
    """
    read = F.transform("readings", lambda r: F.struct(r["method"].alias("method"), r["text"].alias("text"), extraction_quality(r["text"], "title", "url", terms, r["paragraphs"]).alias("q")))
    rows = pages.withColumn("_read", read)
    won = F.get(F.filter("_read", lambda r: r["q"]["accepted"]), F.lit(0))
    best = F.array_max(F.transform("_read", lambda r, i: F.struct(r["q"]["score"].alias("score"), (-i).alias("at"), r["q"].alias("q"))))["q"]
    bare = F.nullif(F.trim(F.coalesce(F.col(snippet), F.lit(""))), F.lit("")) if snippet else F.lit(None).cast("string")
    rows = rows.withColumns({"_won": won, "_best": best, "_snippet": bare, "_title": F.nullif(F.trim(F.coalesce("title", F.lit(""))), F.lit(""))})
    full = F.col("_won").isNotNull()
    wrapped = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).isin(WRAPPERS)
    blocked = wrapped | F.coalesce(F.col("_best.grade") == "blocked_or_shell", F.lit(False))
    grade = F.when(full, F.col("_won.q.grade")).when(blocked, "blocked_or_shell").when(F.col("_best").isNotNull(), "weak_text").when(F.col("_snippet").isNotNull(), "snippet_only").otherwise("title_only")
    basis = F.when(full, "full_text").when(F.col("_snippet").isNotNull(), "snippet").when(F.col("_title").isNotNull(), "title").otherwise("failed")
    tried = F.transform("_read", lambda r: F.struct(r["method"].alias("method"), r["q"]["score"].alias("score")))
    out = {"text": F.coalesce("_won.text", "_snippet", "_title", F.lit("")), "method": F.when(full, F.col("_won.method")).otherwise("fallback"), "basis": basis, "grade": grade, "score": F.coalesce("_won.q.score", "_best.score", F.lit(0.0)), "tried": tried}
    return rows.withColumns(out).drop("_read", "_won", "_best", "_snippet", "_title", "readings")


def syllables(word: Column) -> Column:
    """Groups of vowels of a word, one at least; a last silent e is none."""
    groups = F.regexp_count(F.lower(word), F.lit("[aeiouy]+"))
    return F.greatest(groups - (F.lower(word).rlike("[^aeiouy]e$") & (groups > 1)).cast("int"), F.lit(1))


def reading_ease(text) -> Column:
    """Flesch's reading ease of a text, null without a word."""
    words = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"[\p{L}\p{N}']+"), F.lit(0))
    ends = F.regexp_count(F.coalesce(col(text), F.lit("")), F.lit(r"[.!?]+"))
    return let(F.struct(words.alias("w"), F.greatest(ends, F.lit(1)).alias("s")), lambda x: F.when(F.size(x["w"]) > 0, 206.835 - 1.015 * F.size(x["w"]) / x["s"] - 84.6 * F.aggregate(x["w"], F.lit(0), lambda a, w: a + syllables(w)) / F.size(x["w"])))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def text_measures(text) -> Column:
    """``struct`` of what the parts of an article's quality count: words, sentences, paragraphs, numbers, quotes, weighted financial terms, years and months."""
    text = F.coalesce(col(text), F.lit(""))
    low = F.lower(text)
    return F.struct(
        F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("words"), F.size(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")).alias("sentences"), F.size(F.filter(F.split(text, "\n\n"), lambda p: F.trim(F.replace(p, F.lit("\n"), F.lit(" "))) != "")).alias("paragraphs"),
        count_of(text, NUMBERS).alias("numbers"), count_of(text, '"[^"]*"').alias("quotes"), F.floor(F.round(reduce(add, (times(low, t) * w for t, w in TERM_WEIGHTS.items())), 6)).alias("terms"),
        count_of(text, r"\b\d{4}\b").alias("years"), count_of(text, "(?i)" + MONTHS).alias("months"))


def content_part(m: Column) -> Column:
    """Length, sentences, paragraphs, their size, numbers, quotes and terms: 0 to 1."""
    length = F.when(m["words"] < MIN_WORDS, 0.1).when(m["words"] <= MAX_WORDS, 0.3).otherwise(0.2)
    has = lambda test, points: F.when(test, points).otherwise(0.0)
    return length + has(m["sentences"] >= MIN_SENTENCES, 0.2) + has(m["paragraphs"] >= MIN_PARAGRAPHS, 0.15) + has(m["words"] / F.greatest(m["sentences"], F.lit(1)) <= MAX_SENTENCE_WORDS, 0.1) + has(m["numbers"] >= 3, 0.1) + has(m["quotes"] >= 1, 0.05) + has(m["terms"] >= MIN_TERMS, 0.1)


def structure_part(m: Column) -> Column:
    """Number of paragraphs, words a sentence, sentences a paragraph, numbers and quotes: 0 to 1."""
    mean, per = m["words"] / F.greatest(m["sentences"], F.lit(1)), m["sentences"] / F.greatest(m["paragraphs"], F.lit(1))
    out = F.when(m["paragraphs"].between(2, 15), 0.3).when(m["paragraphs"] > 15, 0.2).otherwise(0.1) + F.when(mean.between(15, 25), 0.3).when(mean.between(10, 30), 0.2).otherwise(0.1)
    return out + F.when(per.between(3, 6), 0.2).otherwise(0.1) + F.when(m["numbers"] > 0, 0.1).otherwise(0.0) + F.when(m["quotes"] > 0, 0.1).otherwise(0.0)


def timeliness_part(age_hours) -> Column:
    """1 for a day, then less by the week, a tenth at least; a half without an age."""
    age = col(age_hours)
    return F.when(age.isNull(), 0.5).when(age <= FRESH_HOURS, 1.0).otherwise(F.greatest(F.lit(0.1), F.exp(-age / 24 / DECAY_DAYS)))


def originality_part(text) -> Column:
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.greatest(F.lit(0.3), reduce(lambda a, p: a - F.when(low.rlike(p), 0.1).otherwise(0.0), UNRIPE, F.lit(0.8)))


def factual_part(m: Column) -> Column:
    """Numbers, quotes, years, months and a third of the terms in a hundred words, by five."""
    facts = m["numbers"] + m["quotes"] + m["years"] + m["months"] + m["terms"] / 3
    return F.when(m["words"] == 0, 0.0).otherwise(F.least(F.lit(1.0), facts / m["words"] * 100 / 5))


def relevance_part(text, model=None) -> Column:
    """A model's certainty by a half (none: 0), the density of terms by three tenths and the number of patterns by two."""
    text = F.coalesce(col(text), F.lit(""))
    low, n_words = F.lower(text), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    density = reduce(add, (times(low, t) * w for t, w in TERM_WEIGHTS.items())) / n_words
    terms = F.when(n_words == 0, 0.0).otherwise(1 / (1 + F.exp(-5 * (density - 0.02))))
    found = reduce(add, [count_of(text, "(?i)" + p) * 0.1 for p in FINANCIAL_NUMBERS] + [count_of(text, f"(?i){p}") * 0.2 for p in FINANCIAL_EVENTS])
    certain = F.lit(0.0) if model is None else F.coalesce(col(model), F.lit(0.0))
    return F.least(F.lit(1.0), certain * 0.5 + terms * 0.3 + F.least(F.lit(1.0), found / 10) * 0.2)


def readability_part(ease: Column) -> Column:
    """Best from 60 to 70, less the farther from there; a text without a word is not readable."""
    ease = F.coalesce(ease, F.lit(0.0))
    return F.when(ease <= 0, 0.0).when((ease >= 100) | ease.between(60, 70), 1.0).when(ease.between(40, 80), 0.8).when(ease.between(20, 90), 0.6).otherwise(0.4)


def credibility_part(host, author, known: dict[str, float]) -> Column:
    """A known host's credibility, a little more with a named author; a half for others."""
    base = F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), F.regexp_replace(F.lower(F.coalesce(col(host), F.lit(""))), r"www\.", "")) if known else F.lit(None).cast("double")
    named = F.when(F.length(F.coalesce(col(author), F.lit(""))) > 5, 0.05).otherwise(0.0)
    return F.when(base.isNotNull(), F.least(F.lit(1.0), base + named)).otherwise(0.5)


def assessed(articles: DataFrame, text: str, age_hours: str, host: str, author: str, known: dict[str, float], model: str | None = None) -> DataFrame:
    """``articles`` with the eight parts, their weighted sum ``overall``, ``issues`` and ``strengths``."""
    rows = articles.withColumns({"_m": text_measures(text), "relevance": relevance_part(text, model), "credibility": credibility_part(host, author, known), "timeliness": timeliness_part(age_hours), "originality": originality_part(text), "readability": readability_part(reading_ease(text))})
    m = F.col("_m")
    rows = rows.withColumns({"content": content_part(m), "structure": structure_part(m), "factual": factual_part(m)})
    overall = reduce(add, (F.col(part) * weight for part, weight in PART_WEIGHTS.items()))
    named = lambda tests: F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())
    issues = named({"too_short": m["words"] < MIN_WORDS, "too_long": m["words"] > MAX_WORDS, "too_few_sentences": m["sentences"] < MIN_SENTENCES, "poor_paragraphs": m["paragraphs"] < MIN_PARAGRAPHS, "low_relevance": F.col("relevance") < 0.3, "low_credibility": F.col("credibility") < 0.6, "outdated": F.col("timeliness") < 0.3, "few_terms": m["terms"] < MIN_TERMS})
    strengths = named({"high_relevance": F.col("relevance") >= 0.8, "high_credibility": F.col("credibility") >= 0.85, "recent": F.col("timeliness") >= 0.9, "rich_in_numbers": m["numbers"] >= 5, "several_quotes": m["quotes"] >= 2, "well_structured": F.col("structure") >= 0.8})
    return rows.withColumns({"overall": F.least(F.lit(1.0), overall), "issues": issues, "strengths": strengths}).drop("_m")
