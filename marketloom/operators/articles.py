"""Articles: types, source tiers, titles, key phrases, mentions, packets and histories."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.text import col, let
from marketloom.operators import timeseries as ts

# Article types in the order they are listed in, their seriousness, their patterns in the order they are tried, and which of several types is the primary one.
ARTICLE_TYPES = [
    "earnings_or_results", "guidance_or_forecast", "analyst_rating_or_price_target", "stock_price_move", "product_or_ai_or_chip_news", "partnership_or_contract", "customer_or_demand_signal",
    "regulatory_or_legal", "insider_or_institutional_trading", "filing_or_sec_event", "macro_or_sector_roundup", "generic_buy_sell_hold_opinion", "prediction_or_price_target_clickbait", "background_profile",
]
SERIOUSNESS = {
    "regulatory_or_legal": 14, "earnings_or_results": 13, "guidance_or_forecast": 13, "filing_or_sec_event": 11, "partnership_or_contract": 10, "customer_or_demand_signal": 9, "product_or_ai_or_chip_news": 8,
    "stock_price_move": 7, "insider_or_institutional_trading": 6, "analyst_rating_or_price_target": 3, "macro_or_sector_roundup": 1, "background_profile": 0, "generic_buy_sell_hold_opinion": -3,
    "prediction_or_price_target_clickbait": -6, "unknown": 0,
}
PATTERNS = {
    "prediction_or_price_target_clickbait": [r"\bprediction\b", r"\bwill (?:trade|be worth|reach)\b", r"\bcould (?:soar|rise|fall) \d+%", r"\bwhere .* stock will be\b"],
    "earnings_or_results": [r"\bearnings\b", r"\bquarterly results\b", r"\b(?:q[1-4]|first|second|third|fourth) quarter\b", r"\beps\b", r"\bprofit\b", r"\brevenue (?:beats|misses|rises|falls)\b"],
    "guidance_or_forecast": [r"\bguidance\b", r"\boutlook\b", r"\bforecast\b", r"\braises? (?:its )?(?:revenue|profit|sales) view\b", r"\bcuts? (?:its )?(?:revenue|profit|sales) view\b"],
    "analyst_rating_or_price_target": [r"\banalyst\b", r"\bupgrade[sd]?\b", r"\bdowngrade[sd]?\b", r"\bprice target\b", r"\binitiates? coverage\b", r"\brating\b"],
    "regulatory_or_legal": [r"\bantitrust\b", r"\bbackdoor\b", r"\bcourt\b", r"\bexport (?:ban|control|restriction)\b", r"\binvestigation\b", r"\blawsuit\b", r"\blegal\b", r"\bprobe\b", r"\bregulat(?:or|ory)\b", r"\bscrutiny\b"],
    "filing_or_sec_event": [r"\bsec filing\b", r"\bform (?:8-k|10-k|10-q|13d|13g|4)\b", r"\bfiles? with the sec\b"],
    "insider_or_institutional_trading": [r"\binsider (?:buying|selling|sale|purchase)\b", r"\binstitutional (?:stake|holding|ownership)\b", r"\bhedge fund\b", r"\b13f\b"],
    "partnership_or_contract": [r"\bpartnership\b", r"\bpartners? with\b", r"\bcontract\b", r"\bcollaboration\b", r"\bdeal with\b"],
    "customer_or_demand_signal": [r"\bcustomer\b", r"\bdemand\b", r"\borders?\b", r"\bbookings?\b", r"\bbacklog\b"],
    "product_or_ai_or_chip_news": [r"\bartificial intelligence\b", r"\bai\b", r"\bchips?\b", r"\bdata cent(?:er|re)\b", r"\blaunch(?:es|ed)?\b", r"\bplatform\b", r"\bproduct\b", r"\bunveil(?:s|ed)?\b"],
    "stock_price_move": [r"\bstock (?:falls|fell|jumps|jumped|rallies|rises|rose|sinks|soars|surges|tumbles)\b", r"\bshares? (?:fall|fell|jump|rally|rise|rose|sink|soar|surge|tumble)\b", r"\bwhy .* stock (?:popped|dropped|crashed|rose|fell)\b", r"\bbiggest moves?\b"],
    "macro_or_sector_roundup": [r"\bstocks? to watch\b", r"\bmarket roundup\b", r"\bsector roundup\b", r"\bbiggest moves? (?:premarket|midday)\b", r"\btop stocks?\b"],
    "generic_buy_sell_hold_opinion": [r"\bshould you buy\b", r"\bis .* (?:a )?good stock to buy\b", r"\bbuy, sell, or hold\b", r"\bstock to buy now\b", r"\bbetter buy\b", r"\bundervalued\b", r"\bovervalued\b"],
    "background_profile": [r"\bwhat does .* do\b", r"\bcompany profile\b", r"\beverything you need to know\b", r"\ba look at\b"],
}
PRECEDENCE = [
    "prediction_or_price_target_clickbait", "generic_buy_sell_hold_opinion", "macro_or_sector_roundup", "analyst_rating_or_price_target", "earnings_or_results", "guidance_or_forecast", "regulatory_or_legal",
    "filing_or_sec_event", "stock_price_move", "partnership_or_contract", "customer_or_demand_signal", "product_or_ai_or_chip_news", "insider_or_institutional_trading", "background_profile",
]
# Publishers and domains of each tier, marks of investor relations, and titles that are left out.
TIER_NAMES = {
    1: ["associated press", "ap", "barron's", "barrons", "bloomberg", "cnbc", "financial times", "investor's business daily", "investors business daily", "marketwatch", "new york times", "reuters", "sec", "wall street journal", "wsj"],
    2: ["barchart", "gurufocus", "investing.com", "marketbeat", "morningstar", "seeking alpha", "simply wall st", "stock titan", "stockstory", "the motley fool", "tipranks", "tradingview", "yahoo finance", "zacks", "pr newswire", "globenewswire", "business wire"],
    3: ["chartmill", "gotrade", "marketscreener", "moomoo", "quiver quantitative", "stocktwits", "trefis"],
    4: ["mshale"],
}
TIER_DOMAINS = {
    1: ["apnews.com", "barrons.com", "bloomberg.com", "cnbc.com", "ft.com", "investors.com", "marketwatch.com", "nytimes.com", "reuters.com", "sec.gov", "wsj.com"],
    2: ["barchart.com", "finance.yahoo.com", "fool.com", "gurufocus.com", "investing.com", "marketbeat.com", "morningstar.com", "seekingalpha.com", "simplywall.st", "stocktitan.net", "stockstory.org", "tipranks.com", "tradingview.com", "zacks.com", "prnewswire.com", "globenewswire.com", "businesswire.com"],
    3: ["chartmill.com", "gotrade.com", "marketscreener.com", "moomoo.com", "quiverquant.com", "stocktwits.com", "trefis.com"],
    4: ["foreignpolicyjournal.com", "mshale.com"],
}
WIRE_NAMES, WIRE_DOMAINS = ["pr newswire", "globenewswire", "business wire"], ["prnewswire.com", "globenewswire.com", "businesswire.com"]
INVESTOR_RELATIONS = ["investor relations", "ir.", "/ir/", "/investors", "/investor-relations"]
UNRELATED_TERMS = ["baseball", "basketball", "celebrity", "cricket", "football", "hollywood", "nfl", "nba", "soccer", "tennis"]
SPAM = [r"\bwatch\s+now\b", r"\bfree\s+crypto\b", r"\bshocking\b", r"\bmust\s+see\b", r"\byou\s+won'?t\s+believe\b", r"\bai[- ]generated\s+video\b"]
RANDOM_EVENT_TERMS = ["award", "concert", "festival", "game", "match", "movie", "parade", "wedding"]
# What event titles lose, and words that stand for others.
EVENT_PHRASES = ["breaking news", "here is why", "heres why", "investors need to know", "stock market today", "stock update", "what happened", "what to know", "why it matters"]
EVENT_STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with"]
EVENT_FILLERS = ["company", "inc", "incorporated", "corp", "corporation", "co", "limited", "ltd", "plc", "nv", "news", "shares", "stock", "today", "update"]
EVENT_ALIASES = {
    "announced": "announce", "announces": "announce", "announcement": "announce", "introduced": "launch", "introduces": "launch", "launched": "launch", "launches": "launch", "unveiled": "launch", "unveils": "launch",
    "expanded": "expand", "expands": "expand", "reported": "report", "reports": "report", "raised": "raise", "raises": "raise", "cutting": "cut", "cuts": "cut",
}
# Boilerplate that content loses, and terms that are key phrases.
BOILERPLATE = ["subscribe.*newsletter", r"follow\s+us\s+on", r"share\s+this\s+article", r"©\s*\d{4}.*", r"all\s+rights\s+reserved", r"terms\s+of\s+service", r"privacy\s+policy", r"https?://[a-zA-Z0-9$-_@.&+!*\\(),%]+", r"\S+@\S+"]
KEY_TERMS = ["earnings per share", "revenue growth", "market cap", "price target", "quarterly results", "profit margin", "dividend yield", "book value", "return on equity", "debt to equity", "free cash flow", "operating income"]
NUMBER_IN_CONTEXT = r"(\w+\s+)?\$?(\d+(?:\.\d+)?)\s*(?:%|billion|million|thousand)?(\s+\w+)?"
# Event type, weight and label of each filing form, and other names of forms.
SEC_FORMS = {
    "8-K": ("material_event", 100, "material current report"), "10-Q": ("quarterly_report", 92, "quarterly financial report"), "10-K": ("annual_report", 96, "annual financial report"),
    "6-K": ("foreign_issuer_report", 90, "foreign issuer report"), "SC 13D": ("ownership_event", 88, "beneficial ownership event"), "SC 13G": ("ownership_event", 84, "beneficial ownership disclosure"),
    "DEF 14A": ("proxy_event", 78, "definitive proxy statement"), "S-1": ("registration_event", 90, "securities registration statement"), "424B": ("offering_or_prospectus", 94, "offering or prospectus update"),
}
SEC_ALIASES = {"13D": "SC 13D", "13G": "SC 13G", "SC13D": "SC 13D", "SC13G": "SC 13G", "DEF14A": "DEF 14A"}
# Factors of article types and source families.
TYPE_FACTOR = {"prediction_or_price_target_clickbait": 0.2, "generic_buy_sell_hold_opinion": 0.35, "macro_or_sector_roundup": 0.45, "analyst_rating_or_price_target": 0.65}
FAMILY_FACTOR = {"press_release_wire": 0.65, "google_news_backstop": 0.75, "context_news_api": 0.85, "external_general_news_api": 0.75, "external_market_news_api": 0.95, "regulatory_official": 1.15, "company_ir": 1.15}

BEFORE, AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def bounded(pattern: str) -> str:
    """A pattern whose word boundaries at both ends hold for letters of any script."""
    pattern = BEFORE + pattern[2:] if pattern.startswith(r"\b") else pattern
    return pattern[:-2] + AFTER if pattern.endswith(r"\b") else pattern


def any_of(patterns: Iterable[str]) -> str:
    return "|".join(map(bounded, patterns))


def one_line(text) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"\s+", " "))


def listed(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values))


def needed(pattern: str) -> str:
    """The longest plain run of characters that whatever matches the pattern has."""
    plain = re.sub(r"\\[bd]|\(\?:[^)]*\)\??|\[[^]]*\]\??|.[?*+]", "\n", pattern)
    return max(plain.split("\n"), key=len)


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    """Whether one of the patterns occurs; a pattern is tried only where the plain run that it needs is there."""
    return reduce(or_, (text.contains(needed(p)) & text.rlike(bounded(p)) for p in patterns))


def event_types(text) -> Column:
    """All article types whose patterns a text has, in their order; ``unknown`` if none."""
    of = lambda t: F.filter(F.array(*(F.when(matches_any(t, PATTERNS[x]), F.lit(x)) for x in ARTICLE_TYPES)), lambda x: x.isNotNull())
    return let(let(one_line(text), of), lambda found: F.when(F.size(found) == 0, listed(["unknown"])).otherwise(found))


def primary_type(types) -> Column:
    """The type that takes precedence among ``types``."""
    return F.coalesce(*(F.when(F.array_contains(types, t), F.lit(t)) for t in PRECEDENCE), F.lit("unknown"))


def _of_both(title: Column, whole: Column) -> Column:
    known = F.array_intersect(listed(ARTICLE_TYPES), F.array_union(title, whole))
    first = primary_type(title)
    types = F.when(F.size(known) == 0, listed(["unknown"])).otherwise(known)
    return F.struct(types.alias("event_types"), F.when(first != "unknown", first).otherwise(primary_type(whole)).alias("primary_type"))


def classified(articles: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """``articles`` with ``event_types``, ``primary_type`` and ``seriousness``; what the title says goes first."""
    found = F.struct(event_types(title).alias("title"), event_types(F.concat_ws(" ", title, text)).alias("whole"))
    rows = articles.withColumn("_types", let(found, lambda x: _of_both(x["title"], x["whole"]))).select("*", "_types.*").drop("_types")
    return rows.withColumn("seriousness", mapped("primary_type", SERIOUSNESS))


def mapped(column, values: dict, default=None) -> Column:
    found = F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), col(column))
    return found if default is None else F.coalesce(found, F.lit(default))


def has_any(text: Column, terms: Iterable[str]) -> Column:
    """Whether a text has one of the terms anywhere."""
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def source_tier(publisher, domain, url, title) -> tuple[Column, Column]:
    """(tier, reason): by title, publisher and domain; tier 2 if no rule fits."""
    publisher, domain, title = (F.lower(F.coalesce(col(x), F.lit(""))) for x in (publisher, domain, title))
    everything = F.concat_ws(" ", F.lower(F.coalesce(col(url), F.lit(""))), publisher, title)
    spread = F.size(F.filter(F.split(F.upper(title), r"[^\p{L}\p{N}_]+"), lambda t: t.rlike("^[A-Z]{2,5}$"))) >= 3
    of = lambda tier: has_any(publisher, TIER_NAMES[tier]) | domain.isin(TIER_DOMAINS[tier])
    rules = [
        (has_any(title, UNRELATED_TERMS), 4, "unrelated_sports_or_celebrity_terms"), (title.rlike(any_of(SPAM)), 4, "obvious_spam_pattern"), (spread & has_any(title, RANDOM_EVENT_TERMS), 4, "multiple_unrelated_entities_random_event_words"),
        (of(4), 4, "excluded_source"), (has_any(everything, INVESTOR_RELATIONS), 1, "company_investor_relations"), (of(1), 1, "trusted_publisher"), (has_any(publisher, WIRE_NAMES) | domain.isin(WIRE_DOMAINS), 2, "press_release_wire"),
        (of(2), 2, "usable_financial_source"), (of(3), 3, "low_priority_source"),
    ]
    tier, reason = F, F
    for test, number, name in rules:
        tier, reason = tier.when(test, number), reason.when(test, name)
    return tier.otherwise(2), reason.otherwise("unclassified_source")


def event_title(title, ticker, company) -> Column:
    """A title without filler phrases and words, stop words, its ticker and company; aliases replaced."""
    spaced = lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))
    text = F.lower(F.coalesce(col(title), F.lit("")))
    for phrase in EVENT_PHRASES:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    noise = F.split(spaced(F.lower(F.concat_ws(" ", col(ticker), col(company)))), " ")
    kept = F.filter(F.split(spaced(text), " "), lambda t: (t != "") & ~t.isin(*EVENT_STOPWORDS, *EVENT_FILLERS) & ~F.array_contains(noise, t))
    return F.array_join(F.transform(kept, lambda t: F.coalesce(mapped(t, EVENT_ALIASES), t)), " ")


def normalized_content(text) -> Column:
    """Lower case on one line, without boilerplate, URLs and addresses."""
    text = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"\s+", " ")
    for pattern in BOILERPLATE:
        text = F.regexp_replace(text, pattern, "")
    return F.trim(text)


def key_phrases(text, most: int = 20) -> Column:
    """Financial terms, quotes of more than 20 characters and numbers with their neighbours, the first so many."""
    text = F.coalesce(col(text), F.lit(""))
    terms = F.filter(listed(KEY_TERMS), lambda t: F.contains(F.lower(text), t))
    quotes = F.transform(F.filter(F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1)), lambda q: F.length(q) > 20), F.lower)
    # the text is searched once; the parts are those of each short find
    found = F.regexp_extract_all(text, F.lit(NUMBER_IN_CONTEXT), F.lit(0))
    numbers = F.transform(found, lambda x: F.lower(F.trim(F.concat(*(F.regexp_extract(x, NUMBER_IN_CONTEXT, k) for k in (1, 2, 3))))))
    return F.slice(F.concat(terms, quotes, numbers), 1, most)


def word_window(text, word, radius: int = 8) -> Column:
    """The words around the first place of ``word``; null if it does not occur."""
    tokens = F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda w: w != "")
    bare = F.transform(tokens, lambda w: F.lower(F.regexp_replace(w, r"^[.,:;!?()\[\]]+|[.,:;!?()\[\]]+$", "")))
    at = F.array_position(bare, F.lower(col(word))).cast("int")
    low = F.greatest(F.lit(1), at - radius)
    return F.when(at > 0, F.array_join(F.slice(tokens, low, at + radius - low + 1), " "))


def weight_factors(rows: DataFrame) -> dict[str, Column]:
    """The 14 factors of an article's sentiment weight, by name.

    ``rows`` has ``tier, match, primary_type, recency_weight, basis, primary, group, source_family, context_only`` and the
    provider's own ``dominant_provider_downweight, dominant_ticker_downweight, source_diversity_bonus, direct_api_bonus,
    official_source_bonus, google_backstop_downweight`` (null or 0: 1).
    """
    own = lambda c: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(1.0))
    serious = F.least(F.lit(1.25), 0.85 + F.greatest(F.lit(0), mapped("primary_type", SERIOUSNESS, 0)) / 35.0)
    names = ["dominant_provider_downweight", "dominant_ticker_downweight", "source_diversity_bonus", "direct_api_bonus", "official_source_bonus", "google_backstop_downweight"]
    return {
        "source_quality": mapped("tier", {1: 1.3, 2: 1.0, 3: 0.55, 4: 0.0}, 0.8), "ticker_match": mapped("match", {"high": 1.0, "medium": 0.65, "low": 0.2}), "article_type": F.coalesce(mapped("primary_type", TYPE_FACTOR), serious),
        "recency": F.col("recency_weight"), "extraction_basis": mapped("basis", {"full_text": 1.25, "snippet": 0.75, "title": 0.4}), "dedupe_uniqueness": F.when(F.col("primary"), 1.0).otherwise(0.35),
        "tracked_relevance": F.when(F.col("group") == "portfolio", 1.1).otherwise(1.0),
        "source_family": F.when((F.col("source_family") == "context_news_api") & F.col("context_only"), 0.55).otherwise(mapped("source_family", FAMILY_FACTOR, 1.0)), **{c: own(c) for c in names},
    }


def cluster_context(members: DataFrame) -> DataFrame:
    """``url, publisher_count, source_count, tickers`` over all clusters of a url; ``members``: ``cluster, url, publisher, source, ticker``."""
    # sets, as two distinct counts would shuffle every member three times
    n_of = lambda c: F.size(F.collect_set(c)).cast("long")
    clusters = members.groupBy("cluster").agg(n_of("publisher").alias("publishers"), n_of("source").alias("sources"), F.collect_set("ticker").alias("found"))
    rows = members.select("cluster", "url").distinct().join(clusters, "cluster")
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_set("found"))))
    return rows.groupBy("url").agg(F.greatest(F.lit(1), F.max("publishers")).alias("publisher_count"), F.greatest(F.lit(1), F.max("sources")).alias("source_count"), merged.alias("tickers"))


def daily_summary(reads: DataFrame, key: str = "ticker") -> DataFrame:
    """A row for each ticker: its strongest stories and the first of each reading label; ``reads``: ``ticker, at, title, priority, ticker_specific, score``."""
    title = F.col("title")
    story = lambda test, by: F.max_by(F.when(test, title), F.when(test, by))
    specific = F.col("ticker_specific")
    first = {f"{p}_story": story(F.col("priority") == p, -F.col("at")) for p in ("read_first", "read_next", "background")}
    out = reads.groupBy(key).agg(
        story(specific & (F.col("score") > 0), F.struct("score", (-F.col("at")).alias("at"))).alias("top_positive_story"),
        story(specific & (F.col("score") < 0), F.struct((-F.col("score")).alias("score"), (-F.col("at")).alias("at"))).alias("top_negative_story"),
        *(c.alias(n) for n, c in first.items()),
    )
    return out.withColumn("summary", F.concat(key, F.coalesce(F.concat(F.lit(": Read first: "), "read_first_story", F.lit(".")), F.lit(": No matched story was available in the current report window."))))


def ticker_packets(packets: DataFrame) -> DataFrame:
    """Events by ticker: counts by status, mean sentiment, greatest attention; ``packets``: ``ticker, at, company, status, sentiment, attention``."""
    return packets.where("ticker <> ''").groupBy(F.upper("ticker").alias("ticker")).agg(
        F.min_by("company", "at").alias("company"), F.count("*").alias("event_count"), F.count_if(F.col("status") == "likely_new_event").alias("new_event_count"),
        F.count_if(F.col("status").isin("exact_url_repeat", "fuzzy_event_repeat")).alias("repeated_event_count"), F.round(F.avg(F.coalesce("sentiment", F.lit(0.0))) + 1e-9, 4).alias("average_sentiment"), F.max(F.coalesce("attention", F.lit(0.0))).alias("max_attention"),
    )


def monitor_candidates(packets: DataFrame, top: int = 5) -> DataFrame:
    """The packets with most attention, then most events, then by name."""
    return packets.orderBy(F.desc("max_attention"), F.desc("event_count"), "ticker").limit(top)


def coverage_history(records: DataFrame, minimum: int) -> DataFrame:
    """``ticker, benchmark, google, direct, google_dominated, weak``; ``records``: ``ticker, provider, family``."""
    google = F.coalesce(F.col("family") == "google_news_backstop", F.lit(False))
    rows = records.where("ticker <> ''").groupBy(F.upper("ticker").alias("ticker")).agg(F.count_if(F.col("provider") == "benchmark_news").alias("benchmark"), F.count_if(google).alias("google"), F.count_if(~google).alias("direct"))
    return rows.withColumns({"google_dominated": F.col("google") > F.col("direct"), "weak": F.col("google") + F.col("direct") < max(1, minimum)})


def compliance(inventory: DataFrame, days: dict[str, int], as_of: str, category: str = "category") -> DataFrame:
    """Total, overdue and compliant files by category; ``inventory``: ``category, created, archived``."""
    due = F.col("created") < F.date_sub(F.lit(as_of).cast("date"), mapped(category, days))
    rows = inventory.groupBy(category).agg(F.count("*").alias("total"), F.count_if(due & F.col("archived").isNull()).alias("violations"))
    return rows.withColumns({"compliant": F.col("total") - F.col("violations"), "compliance_rate": F.round((F.col("total") - F.col("violations")) / F.col("total") * 100, 6)})


def forecast_comparison(forecasts: DataFrame) -> DataFrame:
    """Each model's forecasts, success rate and mean errors, with the number of symbols; ``forecasts``: ``model, symbol, prediction, mae, rmse``."""
    there = F.col("prediction").isNotNull()
    mean = lambda c: F.round(F.avg(F.when(there, F.col(c))) + 1e-9, 6).alias(f"avg_{c}")
    rows = forecasts.groupBy("model").agg(F.count("*").alias("total"), F.count_if(there).alias("successful"), F.count_distinct("symbol").alias("symbols"), mean("mae"), mean("rmse"))
    return rows.withColumn("success_rate", F.round(F.col("successful") / F.col("total"), 6))


def optional(rows: DataFrame, **wanted) -> DataFrame:
    """The rows whose columns have the values that are given; None asks for nothing."""
    for name, value in wanted.items():
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def recent(rows: DataFrame, time: str, as_of, hours: int) -> DataFrame:
    """Rows of the last so many hours before ``as_of``."""
    return rows.where(F.col(time) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours)))


def in_zone(rows: DataFrame, time: str, zone: str, first: str, last: str) -> DataFrame:
    """Rows whose day in a named time zone lies between two dates, both included."""
    return rows.where(F.to_date(F.from_utc_timestamp(time, zone)).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def quarantined(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with their ``failures``): a null check fails."""
    failures = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(None)).otherwise(F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    marked = rows.withColumn("failures", failures)
    return marked.where(F.size("failures") == 0).drop("failures"), marked.where(F.size("failures") > 0)


def entry_for(entries, name: str, value, field: str) -> Column:
    """``field`` of the first entry of an array of structs whose ``name`` is ``value``."""
    return F.get(F.filter(entries, lambda e: F.upper(e[name]) == F.upper(col(value))), F.lit(0))[field]



def filing_form(form) -> Column:
    """``struct(event_type, weight, label)`` of a filing's form, amendments as what they amend; null for other forms."""
    name = F.regexp_replace(F.trim(F.regexp_replace(F.upper(F.coalesce(col(form), F.lit(""))), r"\s+", " ")), "/A$", "")
    name = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in SEC_ALIASES.items() for x in pair)), name), name)
    name = F.when(name.startswith("424B"), "424B").otherwise(name)
    found = None
    for known, (kind, weight, label) in SEC_FORMS.items():
        value = F.struct(F.lit(kind).alias("event_type"), F.lit(weight).alias("weight"), F.lit(label).alias("label"))
        found = F.when(name == known, value) if found is None else found.when(name == known, value)
    return found


def days_held(purchased, as_of) -> Column:
    """Whole days since a purchase; 0 without a date."""
    return F.coalesce(F.datediff(F.to_date(as_of), F.to_date(purchased)), F.lit(0))


def hours_until(moment, now) -> Column:
    """Hours until a moment that has not passed, else null."""
    hours = (F.unix_micros(moment.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 3_600_000_000
    return F.when(hours >= 0, hours)


def sentiment_row(scores: DataFrame, confident: float = 0.7, halflife: float = 7) -> DataFrame:
    """One row per symbol of all its sentiment: span, smoothed, weighted by confidence, trend, spread and conviction (0 to 10).

    ``scores``: ``symbol, date, value`` (-1 to 1) and ``confidence``, one row a date.
    """
    smooth = ts.ewma(scores.select("symbol", "date", F.col("value").cast("double").alias("value")), {"ewma": ("value", ts.alpha_of(halflife=halflife))})
    last = smooth.groupBy("symbol").agg(F.max_by("ewma", "date").alias("ewma"))
    weighted = F.coalesce(F.try_divide(F.sum(F.col("value") * F.col("confidence")), F.sum("confidence")), F.lit(0.0))
    whole = scores.groupBy("symbol").agg(F.min("date").alias("period_start"), F.max("date").alias("period_end"), weighted.alias("confidence_weighted"), F.stddev_samp("value").alias("spread"), F.count("*").alias("n"), F.avg((F.col("confidence") >= confident).cast("double")).alias("confident_share"))
    rows = whole.join(last, "symbol").join(ts.half_trend(scores, "value"), "symbol")
    conviction = F.abs("ewma") * 5 + F.abs("confidence_weighted") * 2 + F.abs(F.coalesce("trend", F.lit(0.0))) * 3
    return rows.withColumn("conviction", F.least(F.lit(10.0), conviction))


def processed(articles: DataFrame, duplicate: Column, steps: dict[str, Column]) -> DataFrame:
    """``articles`` with ``status`` and the columns of ``steps``, which duplicates skip and leave null."""
    skip = F.coalesce(duplicate, F.lit(False))
    return articles.withColumns({"status": F.when(skip, "skipped").otherwise("completed"), **{name: F.when(~skip, value) for name, value in steps.items()}})
