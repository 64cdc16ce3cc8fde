"""News, deduplication, event-memory and decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import text as tx
from marketloom.operators import decision as dc
from marketloom.operators import articles as ar
from marketloom.operators import dedup as dd
from marketloom.operators import events as ev
from marketloom.plans.registry import query, table
from marketloom.plans.series_queries import EVENTS, PRICES, daily_events, prices

# Words that do occur in the documents stand for the sentiment lexicon: fixed values.
POSITIVE = ["the", "hand", "thing", "one"]
NEGATIVE = ["of", "des", "und", "del"]


def r(column, digits: int = 6):
    return F.round(column, digits)


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_URL = rf"""
WITH a AS (SELECT page_id, trim(coalesce(url, '')) AS u FROM pages),
b AS (SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
  regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '') AS params FROM a),
c AS (SELECT page_id, u, scheme, regexp_replace(regexp_replace(host, '^www\.', ''), '^m\.', '') AS host, regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '/+$', ''), '/amp/?$', ''), '\.amp$', ''), '\.amp\.html$', '.html') AS path,
  array_to_string(list_sort(list_filter(params, lambda p: NOT list_contains({sql_list(tx.TRACKING_PARAMS)}, lower(split_part(p, '=', 1))))), '&') AS q FROM b)
SELECT page_id, CASE WHEN u = '' THEN '' ELSE scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') ELSE regexp_replace(host, ':443$', '') END || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical FROM c
"""


@query(_URL)
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.canonical_url("url").alias("canonical"))


@query(f"WITH k AS ({_URL}) SELECT page_id, min(page_id) OVER (PARTITION BY canonical) AS keeper, page_id <> min(page_id) OVER (PARTITION BY canonical) AS is_duplicate, 'art_' || substr(sha256(canonical), 1, 16) AS article_id FROM k")
def url_key_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", tx.canonical_url("url").alias("canonical"))
    return dd.first_per_key(rows, "canonical", "page_id").select("page_id", "keeper", "is_duplicate", tx.article_id("canonical").alias("article_id"))


_TITLE = r"trim(regexp_replace(lower(substr(coalesce(text, ''), 1, 60)), '[^\p{L}\p{N}]+', ' ', 'g'))"


@query(f"SELECT doc_id, {_TITLE} AS title_key, min(doc_id) OVER (PARTITION BY {_TITLE}) AS keeper FROM documents")
def title_key_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.normalized_title(F.substring("text", 1, 60)).alias("title_key"))
    return dd.first_per_key(rows, "title_key", "doc_id").select("doc_id", "title_key", "keeper")


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, count(*) OVER (PARTITION BY md5(coalesce(text, ''))) AS group_size FROM documents")
def content_hash_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    return dd.first_per_key(rows, F.col("digest"), "doc_id").select("doc_id", "digest", "group_size")


@query(rf"""WITH w AS (SELECT doc_id, list_distinct(list_transform(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^[.,:;!?]+|[.,:;!?]+$', '', 'g'))) AS t FROM documents),
  s AS (SELECT doc_id, greatest(-1, least(1, (len(list_intersect(t, {sql_list(POSITIVE)})) - len(list_intersect(t, {sql_list(NEGATIVE)}))) / 3.0)) AS s FROM w) SELECT doc_id, round(CAST(s AS DOUBLE), 6) AS score, round(CAST(least(1, 0.5 + abs(s) / 2) AS DOUBLE), 6) AS confidence FROM s""")
def lexicon_sentiment(spark, sf_dir):
    score, confidence = tx.lexicon_sentiment("text", POSITIVE, NEGATIVE)
    return table(spark, sf_dir, "documents").select("doc_id", r(score).alias("score"), r(confidence).alias("confidence"))


@query(r"""WITH s AS (SELECT doc_id, length(coalesce(text, '')) AS n, length(regexp_replace(coalesce(text, ''), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '', 'g')) AS m FROM documents) SELECT doc_id, n <> m AS has_email FROM s""")
def email_detection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).rlike(tx.EMAIL).alias("has_email"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[REDACTED]', 'g'), '(?i)(Bearer\s+[A-Za-z0-9\-_]{10,}|Basic\s+[A-Za-z0-9+/=]{10,})', '[REDACTED]', 'g'),
  '(?i)(password|passwd|pwd|secret|token|key|auth)[''"\s]*[:=][''"\s]*([^\s''"&<>]+)', '\1=[REDACTED]', 'g')) AS digest FROM documents""")
def redact_pii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.redacted("text")).alias("digest"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[REDACTED]', 'g'), '(?i)(Bearer\s+[A-Za-z0-9\-_]{10,}|Basic\s+[A-Za-z0-9+/=]{10,})', '[REDACTED]', 'g'),
  '(?i)(password|passwd|pwd|secret|token|key|auth)[''"\s]*[:=][''"\s]*([^\s''"&<>]+)', '\1=[REDACTED]', 'g'), 'sk-[A-Za-z0-9]{40,}|ghp_[A-Za-z0-9]{36}|gho_[A-Za-z0-9]{36}', '[REDACTED]', 'g')) AS digest FROM documents""")
def redact_secrets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.redacted_secrets("text")).alias("digest"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n_words, len(regexp_extract_all(coalesce(text, ''), '[.!?]+')) AS n_sentences, len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS n_numbers FROM documents")
def text_counts(spark, sf_dir):
    c = tx.text_counts("text")
    return table(spark, sf_dir, "documents").select("doc_id", *(c[k].cast("long").alias(k) for k in ("n_words", "n_sentences", "n_numbers")))


_TERMS = {"HAND": r"(?i)\bhand\b", "ONE": r"(?i)\bone\b", "DER": r"(?i)\bder\b"}


@query("WITH t(name, word) AS (VALUES ('HAND', 'hand'), ('ONE', 'one'), ('DER', 'der')) SELECT doc_id, name AS ticker FROM documents, t WHERE regexp_matches(coalesce(text, ''), '(?i)\\b' || word || '\\b')".replace("\\\\", "\\"))
def ticker_mentions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.term_hits("text", _TERMS)).alias("ticker"))


@query("""SELECT event_id, sha256(upper(trim(event_type)) || '|' || CAST(user_id AS VARCHAR) || '|' || trim(regexp_replace(lower(event_type), '[^a-z0-9]+', ' ', 'g')) || '|' || 'news' || '|' || '' || '|' || '' || '|' || CAST(CAST(ts AS DATE) AS VARCHAR)) AS fingerprint FROM events""")
def event_fingerprints(spark, sf_dir):
    out = ev.identity_fingerprint(F.col("event_type"), F.col("user_id").cast("string"), F.col("event_type"), F.lit("news"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.to_date("ts"))
    return table(spark, sf_dir, "events").select("event_id", out.alias("fingerprint"))


@query("""WITH e AS (SELECT event_type AS ticker, value AS sentiment, CAST(ts AS DATE) >= DATE '2024-01-16' AS cur FROM events), a AS (SELECT ticker, avg(sentiment) FILTER (cur) AS now, avg(sentiment) FILTER (NOT cur) AS before FROM e GROUP BY ticker)
  SELECT ticker, round(before + 1e-9, 5) AS before, round(now + 1e-9, 5) AS now, round(now - before + 1e-9, 5) AS change FROM a WHERE abs(now - before) >= 0.0001""")
def sentiment_change(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.col("value").alias("sentiment"), F.to_date("ts").alias("day"))
    out = ev.sentiment_change(rows.where("day >= '2024-01-16'"), rows.where("day < '2024-01-16'"))
    return out.select("ticker", *(r(F.col(c) + 1e-9, 5).alias(c) for c in ("before", "now", "change")))


@query(PRICES + """, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM prices), m AS (SELECT symbol, (max(close) FILTER (r = 1) / coalesce(max(close) FILTER (r = 2), arg_min(close, date)) - 1) * 100 AS p FROM k GROUP BY symbol)
  SELECT symbol, round(p, 5) AS percent, CASE WHEN p > 0 THEN 'up' ELSE 'down' END AS direction, CASE WHEN abs(p) >= 15 THEN 'CRITICAL' WHEN abs(p) >= 10 THEN 'HIGH' WHEN abs(p) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM m WHERE abs(p) >= 5""")
def price_alerts(spark, sf_dir):
    return dc.price_alerts(prices(spark, sf_dir)).select("symbol", r("percent", 5).alias("percent"), "direction", "severity")


@query(EVENTS + """, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM daily), s AS (SELECT symbol, max(value) FILTER (r = 1) AS now, avg(value) FILTER (r > 1 AND r <= 8) AS before, count(*) AS n FROM k GROUP BY symbol)
  SELECT symbol, round(now + 1e-9, 5) AS now, round(before + 1e-9, 5) AS before, round(now - before + 1e-9, 5) AS change, CASE WHEN abs(now - before) >= 0.7 THEN 'CRITICAL' WHEN abs(now - before) >= 0.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM s WHERE n >= 7 AND abs(now - before) >= 0.3""")
def sentiment_swings(spark, sf_dir):
    out = dc.sentiment_swings(daily_events(spark, sf_dir))
    return out.select("symbol", *(r(F.col(c) + 1e-9, 5).alias(c) for c in ("now", "before", "change")), "severity")


_CARD = ", k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM prices), m AS (SELECT symbol, max(close) FILTER (r = 1) / max(close) FILTER (r = 22) - 1 AS m1, max(close) FILTER (r = 1) / max(close) FILTER (r = 67) - 1 AS m3 FROM k GROUP BY symbol)"


@query(PRICES + _CARD + """ SELECT symbol, CASE WHEN m1 > 0.5 AND m3 > 0 THEN 'momentum_up' WHEN m1 < -0.3 THEN 'momentum_down' WHEN m3 > 0.2 THEN 'trend_up' ELSE 'default' END AS rule,
  CASE WHEN m1 > 0.5 AND m3 > 0 THEN 'buy' WHEN m1 < -0.3 THEN 'sell' WHEN m3 > 0.2 THEN 'buy' ELSE 'hold' END AS action FROM m""")
def rule_recommendations(spark, sf_dir):
    from marketloom.operators import timeseries as ts

    card = ts.period_returns(prices(spark, sf_dir), {"m1": 22, "m3": 67})
    rules = [("momentum_up", (F.col("m1") > 0.5) & (F.col("m3") > 0), "buy", 0.8), ("momentum_down", F.col("m1") < -0.3, "sell", 0.7), ("trend_up", F.col("m3") > 0.2, "buy", 0.6)]
    return dc.rule_engine(card, rules).select("symbol", "rule", "action")


@query("""WITH a AS (SELECT doc_id AS id, CAST(doc_id % 4 + 1 AS INTEGER) AS tier, 't' || CAST(doc_id % 7 AS VARCHAR) AS t, doc_id % 5 = 0 AS bare FROM documents), b AS (SELECT t FROM a WHERE tier <= 2 AND NOT bare GROUP BY t HAVING count(*) >= 3)
  SELECT id, CASE WHEN tier > 3 THEN 'below_min_source_quality_tier' WHEN tier = 3 AND bare THEN 'tier_3_without_ticker' WHEN tier = 3 AND t IN (SELECT t FROM b) THEN 'tier_3_deprioritized_by_better_sources' ELSE 'visible' END AS reason FROM a""")
def source_visibility(spark, sf_dir):
    tickers = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string"))))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4 + 1).cast("int").alias("tier"), tickers.alias("tickers"))
    return dc.source_visibility(rows).select("id", "reason")


@query("""WITH a AS (SELECT event_id, CAST(event_id % 4 + 1 AS INTEGER) AS tier, value, user_id FROM events)
  SELECT event_id, round(CASE tier WHEN 1 THEN 30 WHEN 2 THEN 22 WHEN 3 THEN 8 ELSE -100 END + CASE WHEN value > 20 THEN 20 ELSE 9 END + CASE WHEN value > 10 THEN 18 ELSE 4 END + 12 + CASE WHEN user_id % 2 = 0 THEN 10 ELSE 0 END
  + least(8, greatest(0, user_id % 4 - 1) * 3 + greatest(0, user_id % 3 - 1) * 2) + 7 + least(8.0, abs(value / 50) * 8) + least(12.0, value * 0.12), 2) AS score FROM a""")
def article_ranking_scores(spark, sf_dir):
    u, v = F.col("user_id"), F.col("value")
    bucket, basis = F.when(v > 20, "today_signal").otherwise("weekly_trend"), F.when(v > 10, "full_text").otherwise("title")
    score = dc.ranking_score((F.col("event_id") % 4 + 1).cast("int"), bucket, basis, F.lit(1), u % 2 == 0, u % 4, u % 3, F.lit(7), v / 50, v)
    return table(spark, sf_dir, "events").select("event_id", score.alias("score"))


@query("""SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN 1.3 WHEN 1 THEN 1.0 WHEN 2 THEN 0.55 ELSE 0.0 END * CASE user_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.65 ELSE 0.2 END * CASE event_type WHEN 'click' THEN 1.25 WHEN 'view' THEN 0.75 ELSE 0.4 END, 6) AS weight FROM events""")
def sentiment_weights(spark, sf_dir):
    basis = F.when(F.col("event_type") == "click", "full_text").when(F.col("event_type") == "view", "snippet").otherwise("title")
    match = F.when(F.col("user_id") % 3 == 0, "high").when(F.col("user_id") % 3 == 1, "medium").otherwise("low")
    weight, _ = dc.sentiment_weight({"source_quality": dc.lookup((F.col("event_id") % 4 + 1).cast("int"), dc.TIER_FACTOR, 0.8), "ticker_match": dc.lookup(match, dc.MATCH_FACTOR, 0.2), "extraction_basis": dc.lookup(basis, dc.BASIS_FACTOR, 0.4)})
    return table(spark, sf_dir, "events").select("event_id", weight.alias("weight"))


@query("""SELECT event_id, list_filter([CASE WHEN value < 5 THEN 'too_short' END, CASE WHEN event_type = 'error' THEN 'low_credibility' END, CASE WHEN user_id % 5 = 0 THEN 'paywall' END], lambda x: x IS NOT NULL) AS reasons FROM events""")
def content_gate(spark, sf_dir):
    reasons = dc.content_reasons({"too_short": F.col("value") < 5, "low_credibility": F.col("event_type") == "error", "paywall": F.col("user_id") % 5 == 0})
    return table(spark, sf_dir, "events").select("event_id", reasons.alias("reasons"))


@query("""WITH a AS (SELECT event_id, ts, date_diff('microsecond', ts, TIMESTAMP '2024-01-31 00:00:00') / 6e7 AS age, extract('hour' FROM ts) * 60 + extract('minute' FROM ts) AS m, extract('isodow' FROM ts) AS d FROM events), l AS (SELECT event_id, age, CASE WHEN d >= 6 THEN 14400 WHEN m >= 870 AND m < 1260 THEN 1440 ELSE 7200 END AS lim FROM a)
  SELECT event_id, CASE WHEN age <= lim THEN 'fresh' WHEN age <= 2 * lim THEN 'stale' ELSE 'critical' END AS state FROM l""")
def data_freshness(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    age = (F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_micros(at)) / 6e7
    return table(spark, sf_dir, "events").select("event_id", dc.staleness(age, at, 1440, 7200, 14400).alias("state"))


@query("""WITH d AS (SELECT date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS age, o_totalprice FROM orders), t AS (SELECT CASE WHEN age <= 180 THEN 'hot' WHEN age <= 730 THEN 'warm' WHEN age <= 2555 THEN 'cold' ELSE 'archive' END AS tier, o_totalprice FROM d) SELECT tier, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM t GROUP BY tier""")
def storage_tiers(spark, sf_dir):
    age = F.datediff(F.lit("2001-08-02").cast("date"), F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").groupBy(dc.storage_tier(age).alias("tier")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


@query("""WITH u AS (SELECT DISTINCT user_id, md5(CAST(user_id AS VARCHAR)) AS h FROM events), b AS (SELECT user_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(0, 32), lambda i: CAST(strpos('0123456789abcdef', substr(h, CAST(i + 1 AS INTEGER), 1)) - 1 AS BIGINT))), lambda a, x: (a * 16 + x) % 100) AS bucket FROM u)
  SELECT user_id, CAST(bucket AS INTEGER) AS bucket, bucket < 30 AS enabled, CASE WHEN bucket < 50 THEN 'a' WHEN bucket < 80 THEN 'b' ELSE 'c' END AS variation FROM b""")
def feature_flags(spark, sf_dir):
    bucket = tx.md5_bucket(F.col("user_id").cast("string"))
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", bucket.alias("bucket"), dc.flag_enabled(F.col("user_id"), 30).alias("enabled"), dc.weighted_variation(bucket, {"a": 50, "b": 30, "c": 20}).alias("variation"))


@query("""WITH s AS (SELECT user_id AS source, ts, event_id, event_type = 'error' AS bad, lag(event_type = 'error', 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), e AS (SELECT *, sum(CAST(bad AND NOT before AS INTEGER)) OVER (PARTITION BY source ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ep FROM s)
  SELECT source, min(ts) AS opened, max(ts) AS last_seen, count(*) AS n FROM e WHERE bad GROUP BY source, ep""")
def alert_episodes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), "ts", F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("bad"))
    return dc.alert_lifecycle(rows)


@query()
def ohlcv_quality(spark, sf_dir):
    return dc.ohlcv_quality(prices(spark, sf_dir), "2001-08-02")


@query()
def alert_cooldown(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("symbol"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return dc.with_cooldown(rows)


@query()
def minhash_links(spark, sf_dir):
    """A row for each document: its class, and its links to other texts."""
    return dd.minhash_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def leader_clusters(spark, sf_dir):
    """Pages of each host in the order of ids; the language in a page's path stands for its tickers."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "(?is)<title[^>]*>(.*?)</title>", 1)
    path = F.split(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://[^/?#]*/([^?#]*)", 1), "/")[0]
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), tx.url_host(F.coalesce("url", F.lit(""))).alias("host"), tx.canonical_url("url").alias("url_key"), tx.normalized_title(title).alias("title_key"), F.when(path == "", F.array().cast("array<string>")).otherwise(F.array(path)).alias("tickers"), F.lit(None).cast("date").alias("day"), ar.event_types(title).alias("types"))
    return dd.leader_clusters(rows, ["host"], stories=True)


@query()
def headline_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("-"), F.to_date("ts").cast("string")).alias("ticker"), F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string"), "props").alias("title"), F.col("ts").cast("timestamp").alias("ts"))
    return dd.headline_clusters(rows)


@query()
def fuzzy_greedy_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select(F.col("doc_id").alias("id"), F.concat_ws(":", "lang", F.split("text", " ")[0]).alias("ticker"), tx.normalized_title(F.substring("text", 1, 60)).alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).alias("day"), F.array(F.coalesce("lang", F.lit(""))).alias("meta"))
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct()
    return ev.fuzzy_greedy_match(rows.join(labelled, "id", "left_semi"), rows.join(labelled, "id", "left_anti"), lookback_days=14)
