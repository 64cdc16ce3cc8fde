"""Queries of article rules, filters, joins and packets. A document's title is its first line, a page's its <title>."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import text as tx
from marketloom.operators import articles as ar
from marketloom.operators import decision as dc
from marketloom.operators import dedup as dd
from marketloom.operators import scoring as sc
from marketloom.plans import score_queries
from marketloom.plans.registry import ORACLES, query, table
from marketloom.plans.series_queries import EVENTS, daily_events

TITLE = r"^[^\n]*"
PAGE_TITLE = "(?is)<title[^>]*>(.*?)</title>"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def ql(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def case(column: str, values: dict, other="NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(k) if isinstance(k, str) else k} THEN {q(v) if isinstance(v, str) else v}" for k, v in values.items()) + f" ELSE {other} END"


def types(x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, {q(ar.any_of(ar.PATTERNS[t]))}) THEN {q(t)} END" for t in ar.ARTICLE_TYPES) + "], lambda t: t IS NOT NULL)"


def primary(x: str) -> str:
    return "CASE " + " ".join(f"WHEN list_contains({x}, {q(t)}) THEN {q(t)}" for t in ar.PRECEDENCE) + " ELSE 'unknown' END"


def line(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g'))"


ARTICLES = rf"""
WITH a AS (SELECT doc_id, lang, source, text, regexp_extract(coalesce(text, ''), '{TITLE}') AS title FROM documents),
m AS MATERIALIZED (SELECT doc_id, lang, source, text, title, {types(line("title"))} AS head, {types(line("concat_ws(' ', title, text)"))} AS whole FROM a),
kinds AS MATERIALIZED (SELECT doc_id, lang, source, text, title, CASE WHEN len(head) + len(whole) = 0 THEN ['unknown'] ELSE list_filter({ql(ar.ARTICLE_TYPES)}, lambda t: list_contains(head, t) OR list_contains(whole, t)) END AS types,
  CASE WHEN len(head) > 0 THEN {primary("head")} ELSE {primary("whole")} END AS primary_type FROM m)"""


def articles(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("title", F.regexp_extract(F.coalesce("text", F.lit("")), TITLE, 0))
    return ar.classified(rows)


@query(f"{ARTICLES} SELECT doc_id, primary_type, array_to_string(types, ',') AS event_types, {case('primary_type', ar.SERIOUSNESS)} AS seriousness FROM kinds")
def article_types(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", "primary_type", F.array_join("event_types", ",").alias("event_types"), "seriousness")


@query(f"{ARTICLES} SELECT t AS article_type, count(*) AS n, count(*) FILTER (primary_type = t) AS n_primary FROM (SELECT primary_type, unnest(types) AS t FROM kinds) GROUP BY 1")
def article_type_counts(spark, sf_dir):
    rows = articles(spark, sf_dir).select("primary_type", F.explode("event_types").alias("article_type"))
    return rows.groupBy("article_type").agg(F.count("*").alias("n"), F.count_if(F.col("primary_type") == F.col("article_type")).alias("n_primary"))


def _has(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', ''), '^m\.', '')"
_TIER = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, {_HOST} AS domain, lower(regexp_extract(coalesce(html, ''), '{PAGE_TITLE}', 1)) AS title FROM pages),
e AS (SELECT *, lower(url) || ' ' || domain || ' ' || title AS everything, len(list_filter(string_split_regex(upper(title), '[^\p{{L}}\p{{N}}_]+'), lambda t: regexp_matches(t, '^[A-Z]{{2,5}}$'))) AS caps FROM p),
k AS (SELECT *, CASE WHEN {_has('title', ar.UNRELATED_TERMS)} THEN 'unrelated_sports_or_celebrity_terms' WHEN regexp_matches(title, {q(ar.any_of(ar.SPAM))}) THEN 'obvious_spam_pattern'
  WHEN caps >= 3 AND {_has('title', ar.RANDOM_EVENT_TERMS)} THEN 'multiple_unrelated_entities_random_event_words' WHEN {_has('domain', ar.TIER_NAMES[4])} OR domain IN {tuple(ar.TIER_DOMAINS[4])} THEN 'excluded_source'
  WHEN {_has('everything', ar.INVESTOR_RELATIONS)} THEN 'company_investor_relations' WHEN {_has('domain', ar.TIER_NAMES[1])} OR domain IN {tuple(ar.TIER_DOMAINS[1])} THEN 'trusted_publisher'
  WHEN {_has('domain', ar.WIRE_NAMES)} OR domain IN {tuple(ar.WIRE_DOMAINS)} THEN 'press_release_wire' WHEN {_has('domain', ar.TIER_NAMES[2])} OR domain IN {tuple(ar.TIER_DOMAINS[2])} THEN 'usable_financial_source'
  WHEN {_has('domain', ar.TIER_NAMES[3])} OR domain IN {tuple(ar.TIER_DOMAINS[3])} THEN 'low_priority_source' ELSE 'unclassified_source' END AS reason FROM e)
SELECT page_id, reason, CASE WHEN reason IN ('company_investor_relations', 'trusted_publisher') THEN 1 WHEN reason IN ('press_release_wire', 'usable_financial_source', 'unclassified_source') THEN 2 WHEN reason = 'low_priority_source' THEN 3 ELSE 4 END AS tier FROM k"""


@query(_TIER)
def source_tiers(spark, sf_dir):
    """The host is both the publisher's name and its domain."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.regexp_extract(F.coalesce("html", F.lit("")), PAGE_TITLE, 1).alias("title"))
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", ""), r"^m\.", "")
    tier, reason = ar.source_tier("domain", "domain", "url", "title")
    return rows.withColumn("domain", host).select("page_id", tier.alias("tier"), reason.alias("reason"))


_EVENT_TITLE = "lower(regexp_extract(coalesce(text, ''), '" + TITLE + "'))"
for _p in ar.EVENT_PHRASES:
    _EVENT_TITLE = f"replace({_EVENT_TITLE}, {q(_p)}, ' ')"


@query(f"""WITH a AS (SELECT doc_id, string_split(trim(regexp_replace({_EVENT_TITLE}, '[^a-z0-9]+', ' ', 'g')), ' ') AS words, string_split(trim(regexp_replace(lower(concat_ws(' ', lang, source)), '[^a-z0-9]+', ' ', 'g')), ' ') AS noise FROM documents)
  SELECT doc_id, array_to_string(list_transform(list_filter(words, lambda t: t <> '' AND NOT list_contains({ql([*ar.EVENT_STOPWORDS, *ar.EVENT_FILLERS])}, t) AND NOT list_contains(noise, t)), lambda t: {case('t', ar.EVENT_ALIASES, 't')}), ' ') AS event_title FROM a""")
def event_titles(spark, sf_dir):
    """Titles as event memory compares them; language and source stand for ticker and company."""
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", ar.event_title(F.regexp_extract(F.coalesce("text", F.lit("")), TITLE, 0), "lang", "source").alias("event_title"))


_CONTENT = r"regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')"
for _p in ar.BOILERPLATE:
    _CONTENT = f"regexp_replace({_CONTENT}, {q(_p)}, '', 'g')"


@query(f"SELECT doc_id, md5(trim({_CONTENT})) AS digest, length(trim({_CONTENT})) AS n_chars FROM documents")
def content_normal(spark, sf_dir):
    text = ar.normalized_content("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n_chars"))


_NUMBER = q(ar.NUMBER_IN_CONTEXT)


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  e AS (SELECT doc_id, list_filter({ql(ar.KEY_TERMS)}, lambda k: contains(lower(t), k)) AS terms, list_transform(list_filter(regexp_extract_all(t, '"([^"]*)"', 1), lambda x: length(x) > 20), lambda x: lower(x)) AS quotes,
  regexp_extract_all(t, {_NUMBER}, 1) AS a, regexp_extract_all(t, {_NUMBER}, 2) AS b, regexp_extract_all(t, {_NUMBER}, 3) AS c FROM d)
  SELECT doc_id, array_to_string((terms || quotes || list_transform(range(1, len(b) + 1), lambda i: lower(trim(coalesce(a[i], '') || b[i] || coalesce(c[i], '')))))[1:20], '|') AS phrases FROM e""")
def key_phrases(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(ar.key_phrases("text"), "|").alias("phrases"))


MENTIONED = ["the", "des", "del", "und"]
_BARE = r"list_transform(words, lambda w: lower(regexp_replace(w, '^[.,:;!?()\[\]]+|[.,:;!?()\[\]]+$', '', 'g')))"


@query(rf"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') AS words FROM documents),
  b AS (SELECT doc_id, words, {_BARE} AS bare FROM d), m AS (SELECT doc_id, words, ticker, list_position(bare, ticker) AS pos FROM b, (SELECT unnest({ql(MENTIONED)}) AS ticker) AS t WHERE list_contains(bare, ticker)),
  w AS (SELECT doc_id, ticker, array_to_string(words[greatest(1, pos - 8):pos + 8], ' ') AS evidence FROM m),
  s AS (SELECT *, list_transform(string_split_regex(lower(evidence), '\s+'), lambda x: regexp_replace(x, '^[.,:;!?]+|[.,:;!?]+$', '', 'g')) AS tokens FROM w)
  SELECT doc_id, ticker, md5(evidence) AS evidence, round(greatest(-1.0, least(1.0, (len(list_intersect(tokens, ['the', 'hand', 'thing', 'one'])) - len(list_intersect(tokens, ['of', 'des', 'und', 'del']))) / 3.0)), 6) AS score FROM s""")
def mention_sentiment(spark, sf_dir):
    """Each mention's window of words and its sentiment; frequent words stand for tickers."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(ar.listed(MENTIONED)).alias("ticker"))
    rows = rows.withColumn("window", ar.word_window("text", "ticker")).where("window is not null")
    score, _ = tx.lexicon_sentiment("window", ["the", "hand", "thing", "one"], ["of", "des", "und", "del"])
    return rows.select("doc_id", "ticker", F.md5("window").alias("evidence"), F.round(score, 6).alias("score"))


@query("""SELECT o_orderpriority AS category, count(*) AS total, count(*) FILTER (CAST(o_orderdate AS DATE) < DATE '2001-01-01' - CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 365 ELSE 1000 END AS INTEGER) AND o_orderstatus <> 'F') AS violations,
  count(*) - violations AS compliant, round((count(*) - violations) / count(*) * 100, 6) AS compliance_rate FROM orders GROUP BY 1""")
def compliance_by_category(spark, sf_dir):
    """Orders as files: those finished (F) are archived."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.to_date("o_orderdate").alias("created"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("archived"))
    days = {"1-URGENT": 30, "2-HIGH": 365, "3-MEDIUM": 1000, "4-NOT SPECIFIED": 1000, "5-LOW": 1000}
    return ar.compliance(rows, days, "2001-01-01")


_PACKETS = """WITH p AS (SELECT upper(event_type) AS ticker, event_id AS pos, 'user ' || user_id AS company, CASE event_id % 4 WHEN 0 THEN 'likely_new_event' WHEN 1 THEN 'exact_url_repeat' WHEN 2 THEN 'fuzzy_event_repeat' ELSE 'other' END AS status, value / 100 AS sentiment, value AS attention FROM events),
  t AS (SELECT ticker, arg_min(company, pos) AS company, count(*) AS event_count, count(*) FILTER (status = 'likely_new_event') AS new_event_count, count(*) FILTER (status IN ('exact_url_repeat', 'fuzzy_event_repeat')) AS repeated_event_count,
  round(avg(coalesce(sentiment, 0)) + 1e-9, 4) AS average_sentiment, max(coalesce(attention, 0)) AS max_attention FROM p GROUP BY 1)"""


def packets(spark, sf_dir):
    status = F.when(F.col("event_id") % 4 == 0, "likely_new_event").when(F.col("event_id") % 4 == 1, "exact_url_repeat").when(F.col("event_id") % 4 == 2, "fuzzy_event_repeat").otherwise("other")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.col("event_id").alias("at"), F.concat(F.lit("user "), "user_id").alias("company"), status.alias("status"), (F.col("value") / 100).alias("sentiment"), F.col("value").alias("attention"))
    return ar.ticker_packets(rows)


@query(f"{_PACKETS} SELECT * FROM t")
def ticker_packets(spark, sf_dir):
    return packets(spark, sf_dir)


@query(f"{_PACKETS} SELECT ticker, max_attention, event_count FROM t ORDER BY max_attention DESC, event_count DESC, ticker LIMIT 3")
def monitor_candidates(spark, sf_dir):
    return ar.monitor_candidates(packets(spark, sf_dir), 3).select("ticker", "max_attention", "event_count")


@query("""SELECT upper(source) AS ticker, count(*) FILTER (lang = 'fr') AS benchmark, count(*) FILTER (lang = 'en') AS google, count(*) FILTER (lang = 'en' IS NOT TRUE) AS direct,
  count(*) FILTER (lang = 'en') > count(*) FILTER (lang = 'en' IS NOT TRUE) AS google_dominated, count(*) < 60 AS weak FROM documents WHERE source <> '' GROUP BY 1""")
def coverage_history(spark, sf_dir):
    """Documents as records: French ones come from the benchmark provider, English ones from the backstop."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("ticker"), F.when(F.col("lang") == "fr", "benchmark_news").alias("provider"), F.when(F.col("lang") == "en", "google_news_backstop").alias("family"))
    return ar.coverage_history(rows, 60)


@query("""SELECT l_returnflag AS model, count(*) AS total, count(*) FILTER (l_tax > 0) AS successful, count(DISTINCT l_linestatus) AS symbols, round(avg(l_discount) FILTER (l_tax > 0) + 1e-9, 6) AS avg_mae,
  round(avg(l_tax) FILTER (l_tax > 0) + 1e-9, 6) AS avg_rmse, round(count(*) FILTER (l_tax > 0) / count(*), 6) AS success_rate FROM lineitem GROUP BY 1""")
def forecast_comparison(spark, sf_dir):
    """Lines as forecasts of three models; those without tax failed."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("symbol"), F.when(F.col("l_tax") > 0, F.col("l_extendedprice")).alias("prediction"), F.col("l_discount").alias("mae"), F.col("l_tax").alias("rmse"))
    return ar.forecast_comparison(rows)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' ORDER BY o_orderdate, o_orderkey")
def symbol_range(spark, sf_dir):
    rows = ar.optional(table(spark, sf_dir, "orders"), o_orderpriority="1-URGENT")
    return rows.where(F.to_date("o_orderdate").between("1998-01-01", "1998-12-31")).orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("SELECT event_id, ts FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id")
def optional_type(spark, sf_dir):
    """One type is asked for, no user."""
    return ar.optional(table(spark, sf_dir, "events"), event_type="signup", user_id=None).orderBy(F.desc("ts"), "event_id").select("event_id", "ts")


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR ORDER BY ts DESC, event_id LIMIT 100")
def recent_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    newest = rows.agg(F.max("ts")).head()[0]
    return ar.recent(rows, "ts", newest, 6).orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "ts")


@query("SELECT event_id FROM events WHERE CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-03'")
def zone_window(spark, sf_dir):
    return ar.in_zone(table(spark, sf_dir, "events"), "ts", "America/New_York", "2024-01-02", "2024-01-03").select("event_id")


@query("""SELECT event_id FROM events WHERE event_type = 'error' AND value > 5 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 168 HOUR""")
def audit_filter(spark, sf_dir):
    """Operation, status and hours, each of them optional."""
    rows = table(spark, sf_dir, "events").withColumn("failed", F.col("value") > 5)
    newest = rows.agg(F.max("ts")).head()[0]
    return ar.recent(ar.optional(rows, event_type="error", failed=True, user_id=None), "ts", newest, 168).select("event_id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') <> '69' OR json_extract_string(props, '$.k') IS NULL")
def run_reset(spark, sf_dir):
    """What is left when the rows of one run, named inside their JSON, are reset."""
    return table(spark, sf_dir, "events").where(~F.coalesce(F.get_json_object("props", "$.k") == "69", F.lit(False))).select("event_id")


def article_checks():
    return {"text": F.trim("text") != "", "size": F.col("n_chars").between(1, 4000), "lang": F.col("lang").isin("en", "de", "fr")}


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT coalesce(trim(text) <> '', false) THEN 'text' END, CASE WHEN NOT coalesce(n_chars BETWEEN 1 AND 4000, false) THEN 'size' END, CASE WHEN NOT coalesce(lang IN ('en', 'de', 'fr'), false) THEN 'lang' END], lambda x: x IS NOT NULL), ',') AS failures FROM documents
  WHERE NOT coalesce(trim(text) <> '', false) OR NOT coalesce(n_chars BETWEEN 1 AND 4000, false) OR NOT coalesce(lang IN ('en', 'de', 'fr'), false)""")
def article_quarantine(spark, sf_dir):
    return ar.quarantined(table(spark, sf_dir, "documents"), article_checks())[1].select("doc_id", F.array_join("failures", ",").alias("failures"))


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def run_with_store(spark, sf_dir):
    """All documents of a run, with what the store knows about them."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@query(f"""SELECT l.doc_id, coalesce(nullif(trim(regexp_extract(coalesce(d.text, ''), '{TITLE}')), ''), d.source, 'document ' || l.doc_id) AS comparison_title FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.lang = 'en'""")
def comparison_titles(spark, sf_dir):
    """Labelled documents by their title, else their source, else their id; only English ones have a title here."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.nullif(F.trim(F.regexp_extract(F.coalesce("text", F.lit("")), TITLE, 0)), F.lit("")).alias("title"), "source")
    return table(spark, sf_dir, "labels").join(docs, "doc_id", "left").select("doc_id", F.coalesce("title", "source", F.concat(F.lit("document "), "doc_id")).alias("comparison_title"))


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, r.n FROM lineitem l JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) r ON l.l_partkey = r.l_partkey AND l.l_suppkey = r.l_suppkey WHERE r.n > 1")
def two_key_join(spark, sf_dir):
    """Lines with the number of lines of the same part and supplier, where there are more."""
    rows = table(spark, sf_dir, "lineitem")
    known = rows.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(known, ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "n")


@query("""WITH f AS (SELECT user_id, arg_min(event_type, event_id) AS first_source, arg_max(value, event_id) AS last_sentiment FROM events GROUP BY 1)
  SELECT e.event_id, f.first_source, f.last_sentiment FROM events e JOIN f USING (user_id)""")
def first_and_last(spark, sf_dir):
    """Events with their user's first source (first wins) and last sentiment (last wins)."""
    rows = table(spark, sf_dir, "events")
    known = rows.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_source"), F.max_by("value", "event_id").alias("last_sentiment"))
    return rows.join(known, "user_id").select("event_id", "first_source", "last_sentiment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def selected_customers(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("""WITH c AS (SELECT o.o_custkey AS cluster, l_partkey AS url, l_suppkey AS publisher, l_linestatus AS source, l_returnflag AS ticker FROM lineitem JOIN orders o ON l_orderkey = o_orderkey),
  g AS (SELECT cluster, count(DISTINCT publisher) AS p, count(DISTINCT source) AS s, list(DISTINCT ticker) AS t FROM c GROUP BY 1), r AS (SELECT DISTINCT cluster, url FROM c)
  SELECT url, greatest(1, max(p)) AS publisher_count, greatest(1, max(s)) AS source_count, array_to_string(list_sort(list_distinct(flatten(list(t)))), ',') AS tickers FROM r JOIN g USING (cluster) GROUP BY 1""")
def cluster_contexts(spark, sf_dir):
    """Customers as clusters of the parts they order."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cluster")), "l_orderkey")
    rows = rows.select("cluster", F.col("l_partkey").alias("url"), F.col("l_suppkey").alias("publisher"), F.col("l_linestatus").alias("source"), F.col("l_returnflag").alias("ticker"))
    return ar.cluster_context(rows).withColumn("tickers", F.array_join("tickers", ","))


_READS = """WITH r AS (SELECT event_type AS ticker, event_id AS pos, 'story ' || event_id AS title, CASE WHEN value > 90 THEN 'read_first' WHEN value > 50 THEN 'read_next' ELSE 'background' END AS priority, user_id % 2 = 0 AS spec, value - 50 AS score FROM events)"""


@query(f"""{_READS}, s AS (SELECT ticker, arg_min(title, pos) FILTER (priority = 'read_first') AS read_first_story, arg_min(title, pos) FILTER (priority = 'read_next') AS read_next_story, arg_min(title, pos) FILTER (priority = 'background') AS background_story FROM r GROUP BY 1),
  p AS (SELECT ticker, title AS top_positive_story FROM r WHERE spec AND score > 0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY score DESC, pos) = 1), n AS (SELECT ticker, title AS top_negative_story FROM r WHERE spec AND score < 0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY score, pos) = 1)
  SELECT s.*, top_positive_story, top_negative_story, ticker || coalesce(': Read first: ' || read_first_story || '.', ': No matched story was available in the current report window.') AS summary FROM s LEFT JOIN p USING (ticker) LEFT JOIN n USING (ticker)""")
def daily_summaries(spark, sf_dir):
    priority = F.when(F.col("value") > 90, "read_first").when(F.col("value") > 50, "read_next").otherwise("background")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), F.col("event_id").alias("at"), F.concat(F.lit("story "), "event_id").alias("title"), priority.alias("priority"), (F.col("user_id") % 2 == 0).alias("ticker_specific"), (F.col("value") - 50).alias("score"))
    return ar.daily_summary(rows)


@query("""SELECT l_orderkey, l_linenumber, o_custkey, c_mktsegment, p_brand, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def event_records(spark, sf_dir):
    """A record for each line: its order and part must exist, customer and supplier may."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey")).join(t("part"), F.expr("l_partkey = p_partkey")).join(t("customer"), F.expr("o_custkey = c_custkey"), "left").join(t("supplier"), F.expr("l_suppkey = s_suppkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "o_custkey", "c_mktsegment", "p_brand", "s_name")


@query("""WITH n AS (SELECT o_orderkey, list({'ticker': l_returnflag, 'score': l_discount} ORDER BY l_linenumber, l_discount, l_partkey) AS entries FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
  SELECT o_orderkey, list_filter(entries, lambda e: e.ticker = 'R')[1].score AS sentiment FROM n""")
def nested_sentiment(spark, sf_dir):
    """The first entry for one ticker in each order's nested list."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount", "l_partkey", F.col("l_returnflag").alias("ticker")))), lambda e: F.struct(e["ticker"].alias("ticker"), e["l_discount"].alias("score")))
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").groupBy("l_orderkey").agg(entries.alias("entries"))
    return rows.select(F.col("l_orderkey").alias("o_orderkey"), ar.entry_for(F.col("entries"), "ticker", F.lit("r"), "score").alias("sentiment"))


@query("""SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, source LIMIT 10""")
def top_publishers(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


_FACTOR = case("primary_type", ar.TYPE_FACTOR, f"least(1.25, 0.85 + greatest(0, {case('primary_type', ar.SERIOUSNESS)}) / 35.0)")


@query(f"""{ARTICLES}, f AS (SELECT k.doc_id, [CASE source WHEN 'src0' THEN 1.3 WHEN 'src1' THEN 0.55 ELSE 1.0 END, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.65 END, {_FACTOR}, CASE WHEN coalesce(text, '') = '' THEN 0.4 ELSE 1.25 END, CASE WHEN l.doc_id IS NULL THEN 0.35 ELSE 1.0 END,
  CASE WHEN quality = 1 THEN 1.1 ELSE 1.0 END, CASE source WHEN 'src2' THEN 0.65 WHEN 'src3' THEN 0.55 WHEN 'src4' THEN 0.85 ELSE 1.0 END, CASE WHEN toxic = 1 THEN 0.5 ELSE 1.0 END] AS factors FROM kinds k LEFT JOIN labels l ON k.doc_id = l.doc_id)
  SELECT doc_id, round(list_product(factors) + 1e-9, 6) AS weight FROM f""")
def article_weights(spark, sf_dir):
    """All 14 factors: type from the text, basis from what text there is, the rest from source and labels."""
    rows = articles(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True)), "doc_id", "left")
    rows = rows.withColumns({
        "tier": ar.mapped("source", {"src0": 1, "src1": 3}, 2), "match": F.when(F.col("lang") == "en", "high").otherwise("medium"), "recency_weight": F.lit(1.0), "basis": F.when(F.coalesce("text", F.lit("")) == "", "title").otherwise("full_text"),
        "primary": F.col("labelled").isNotNull(), "group": F.when(F.col("quality") == 1, "portfolio").otherwise("watchlist"), "source_family": ar.mapped("source", {"src2": "press_release_wire", "src3": "context_news_api", "src4": "context_news_api"}), "context_only": F.col("source") == "src3",
        "dominant_provider_downweight": F.when(F.col("toxic") == 1, 0.5), "dominant_ticker_downweight": F.lit(0.0), **{c: F.lit(None).cast("double") for c in ("source_diversity_bonus", "direct_api_bonus", "official_source_bonus", "google_backstop_downweight")},
    })
    weight = F.lit(1.0)
    for factor in ar.weight_factors(rows).values():
        weight = weight * factor
    return rows.select("doc_id", F.round(weight + 1e-9, 6).alias("weight"))


@query()
def near_articles(spark, sf_dir):
    """Documents by title and key phrases: which stay in the order of ids, and how many others each is linked to."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract(F.coalesce("text", F.lit("")), TITLE, 0).alias("title"), ar.key_phrases("text").alias("phrases"))
    return dd.near_kept(rows, degrees=True).withColumnRenamed("id", "doc_id")


@query()
def batch_duplicates(spark, sf_dir):
    """Pages in the order of ids, by URL, content, and title with key phrases."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), tx.canonical_url("url").alias("url_key"), F.md5("html").alias("content_key"), F.regexp_extract(F.coalesce("html", F.lit("")), PAGE_TITLE, 1).alias("title"), ar.key_phrases("html").alias("phrases"))
    return dd.batch_duplicates(rows).withColumnRenamed("id", "page_id")


_HOST_OF = "lower(regexp_extract(coalesce(url, ''), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)', 2))"
_SCHEME_OF = "lower(regexp_extract(coalesce(url, ''), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)', 1))"
_PATH_OF = "regexp_extract(coalesce(url, ''), '^[^:]*://[^/?#]*([^?#]*)', 1)"


@query(f"""WITH u AS (SELECT page_id, trim(coalesce(url, '')) AS url FROM pages),
  p AS (SELECT *, {_SCHEME_OF} AS scheme, {_HOST_OF} AS host, {_PATH_OF} AS path, list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '') AS params FROM u),
  k AS (SELECT *, list_transform(list_sort(list_filter(list_transform(params, lambda x: {{'n': lower(split_part(x, '=', 1)), 'v': regexp_replace(x, '^[^=]*=?', ''), 'k': split_part(x, '=', 1)}}), lambda x: NOT list_contains({ql(tx.TRACKING_PARAMS)}, x.n))), lambda x: x.k || '=' || x.v) AS kept FROM p)
  SELECT page_id, CASE WHEN scheme = '' THEN lower(url) ELSE scheme || '://' || CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url_key FROM k""")
def plain_url_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.plain_url_key("url").alias("url_key"))


@query(f"""WITH h AS (SELECT page_id, coalesce(url, '') AS url, {_SCHEME_OF} AS scheme, {_HOST_OF} AS host, {_PATH_OF} AS path FROM pages), n AS (SELECT *, replace(host, 'www.', '') AS name FROM h)
  SELECT page_id, CASE WHEN name = '' THEN 'unknown' ELSE {case('name', tx.SOURCE_NAMES, "split_part(name, '.', 1)")} END AS source_name,
  CASE WHEN scheme NOT IN ('http', 'https') OR host = '' THEN 'unsupported' WHEN host = {q(tx.WRAPPER_HOST)} AND ({' OR '.join(f'starts_with(path, {q(p)})' for p in tx.WRAPPER_PATHS)}) THEN 'wrapper' ELSE 'direct_publisher' END AS url_class FROM n""")
def url_sources(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.source_name("url").alias("source_name"), tx.url_class("url").alias("url_class"))


_BUCKET = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(0, 32), lambda i: CAST(strpos('0123456789abcdef', substr(md5('plus:' || CAST(c_custkey AS VARCHAR)), CAST(i + 1 AS INTEGER), 1)) - 1 AS BIGINT))), lambda a, x: (a * 16 + x) % 100)"


@query(f"""WITH b AS (SELECT c_custkey, c_mktsegment, c_acctbal, {_BUCKET} AS bucket FROM customer)
  SELECT c_custkey, coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false) AS segment, (coalesce(c_mktsegment = 'MACHINERY', false) OR coalesce(c_acctbal > 5000, false)) AND bucket < 40 AS canary, bucket < 40 AS gradual FROM b""")
def flag_strategies(spark, sf_dir):
    """Market segments are a flag's segments; those of one test first, and so do large balances."""
    user = F.col("c_custkey")
    canary = dc.canary_enabled(user, F.col("c_mktsegment") == "MACHINERY", F.col("c_acctbal"), 40, "plus:", 5000)
    return table(spark, sf_dir, "customer").select("c_custkey", dc.segment_enabled(["BUILDING", "MACHINERY"], "c_mktsegment").alias("segment"), canary.alias("canary"), dc.flag_enabled(user, 40, "plus:").alias("gradual"))


@query("""WITH t AS (SELECT max(o_orderdate) AS now FROM orders), o AS (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders)
  SELECT o_orderkey, coalesce(date_diff('day', CAST(o_orderdate AS DATE), CAST(now AS DATE)), 0) AS days_held, CASE WHEN next >= o_orderdate THEN (epoch_us(next) - epoch_us(o_orderdate)) / 3600000000.0 END AS hours_until FROM o, t""")
def holding_times(spark, sf_dir):
    """Days that each order has been held, and hours from it to its customer's next one."""
    rows = table(spark, sf_dir, "orders")
    after = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    now = F.broadcast(rows.agg(F.max("o_orderdate").alias("now")))  # one row
    return rows.withColumn("next", after).join(now).select("o_orderkey", ar.days_held(F.col("o_orderdate"), F.col("now")).cast("long").alias("days_held"), ar.hours_until(F.col("next"), F.col("o_orderdate")).alias("hours_until"))


@query(EVENTS + f""", s AS (SELECT symbol, date, CASE WHEN value > 12 THEN 1.0 WHEN value < 6 THEN -1.0 ELSE 0.0 END AS value, least(1.0, n / 20.0) AS confidence FROM daily),
  k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS r, count(*) OVER (PARTITION BY symbol) AS c FROM s),
  g AS (SELECT symbol, min(date) AS period_start, max(date) AS period_end, coalesce(sum(value * confidence) / nullif(sum(confidence), 0), 0) AS cw, stddev_samp(value) AS spread, count(*) AS n, avg(CAST(confidence >= 0.7 AS DOUBLE)) AS share,
  sum(value * power(0.5, (c - r) / 7.0)) / sum(power(0.5, (c - r) / 7.0)) AS ewma, avg(value) FILTER (r > c // 2) - avg(value) FILTER (r <= c // 2) AS trend FROM k GROUP BY symbol)
  SELECT symbol, period_start, period_end, n, round(cw + 1e-9, 5) AS confidence_weighted, round(spread, 5) AS spread, round(share, 5) AS confident_share, round(ewma + 1e-9, 5) AS ewma, round(trend + 1e-9, 5) AS trend, round(least(10.0, abs(ewma) * 5 + abs(cw) * 2 + abs(coalesce(trend, 0)) * 3) + 1e-9, 5) AS conviction FROM g""")
def sentiment_rows(spark, sf_dir):
    """A row for each event type; its day's value is a label, and its number of events how sure that is."""
    value = F.when(F.col("value") > 12, 1.0).when(F.col("value") < 6, -1.0).otherwise(0.0)
    out = ar.sentiment_row(daily_events(spark, sf_dir).select("symbol", "date", value.alias("value"), F.least(F.lit(1.0), F.col("n") / 20).alias("confidence")))
    near = lambda c: F.round(F.col(c) + 1e-9, 5).alias(c)
    return out.select("symbol", "period_start", "period_end", "n", near("confidence_weighted"), F.round("spread", 5).alias("spread"), F.round("confident_share", 5).alias("confident_share"), near("ewma"), near("trend"), near("conviction"))


@query(f"""WITH r AS ({ORACLES["keyword_relevance"]}), e AS ({ORACLES["extraction_quality"]}), g AS (SELECT md5(text) AS h, min(doc_id) AS first FROM documents WHERE coalesce(text, '') <> '' GROUP BY 1),
  d AS (SELECT doc_id, coalesce(first < doc_id, false) AS again FROM documents LEFT JOIN g ON md5(text) = h)
  SELECT doc_id, CASE WHEN again THEN 'skipped' ELSE 'completed' END AS status, CASE WHEN NOT again THEN relevance END AS relevance, CASE WHEN NOT again THEN quality END AS quality FROM d JOIN r USING (doc_id) JOIN e USING (doc_id)""")
def article_processing(spark, sf_dir):
    """Documents whose text an earlier one has are skipped; the rest are scored for relevance and quality."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(text == "", F.concat(F.lit("id "), F.col("doc_id").cast("string"))).otherwise(F.md5("text")).alias("key"))
    marked = dd.first_per_key(docs, "key", "doc_id")
    steps = {"relevance": F.round(sc.keyword_relevance(F.col("text"), score_queries.CATEGORIES), 6), "quality": sc.text_quality(text, tx.text_counts("text")["n_sentences"])}
    return ar.processed(marked, F.col("is_duplicate"), steps).select("doc_id", "status", *steps)
