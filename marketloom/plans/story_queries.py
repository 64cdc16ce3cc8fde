"""Companies in articles, weighted fingerprints, and streams with timers."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import text as tx
from marketloom.operators import entities as en
from marketloom.operators import fingerprints as fp
from marketloom.operators import quality as qu
from marketloom.plans.news_queries import sql_list
from marketloom.plans.registry import query, table
from marketloom.sources import pages as pg
from marketloom.staging import shared_path, staged
from marketloom.streaming import events as st
from marketloom.streaming import state as ss

_DIRECTORY = r"""
w AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
raw AS (SELECT 'T' || CAST(item_id AS VARCHAR) AS ticker, w[1] || ' ' || w[2] || ' ' || w[3] AS name, 'name' AS kind FROM w WHERE len(w) >= 4 UNION ALL SELECT 'T' || CAST(item_id AS VARCHAR), w[4], 'alias' FROM w WHERE len(w) >= 4
  UNION ALL SELECT 'T' || CAST(item_id AS VARCHAR), CAST(item_id AS VARCHAR), 'symbol' FROM w),
directory AS (SELECT ticker, name, arg_min(kind, CASE kind WHEN 'symbol' THEN 0 WHEN 'name' THEN 1 ELSE 2 END) AS kind FROM raw WHERE name <> '' GROUP BY ticker, name)"""


def directory(spark, sf_dir):
    """A directory of names that texts do have: the first words of each benchmark item, the fourth as an alias, its number as a symbol."""
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("T"), F.col("item_id").cast("string")).alias("ticker"), F.col("item_id").cast("string").alias("symbol"), F.split(tx.normalized_title("text"), " ").alias("w"))
    long = F.size("w") >= 4
    said = F.array(F.struct(F.when(long, F.array_join(F.slice("w", 1, 3), " ")).alias("name"), F.lit("name").alias("kind")), F.struct(F.when(long, F.get("w", F.lit(3))).alias("name"), F.lit("alias").alias("kind")), F.struct(F.col("symbol").alias("name"), F.lit("symbol").alias("kind")))
    return items.select("ticker", F.inline(said)).where("name is not null")


@query("WITH " + _DIRECTORY.lstrip() + r""",
t AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS i FROM t), q AS (SELECT *, a || ' ' || lead(a, 1) OVER (PARTITION BY doc_id ORDER BY i) || ' ' || lead(a, 2) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM p),
m AS (SELECT doc_id, i, a AS said FROM q UNION ALL SELECT doc_id, i, c FROM q)
SELECT doc_id, ticker, kind, name, count(*) AS n, CAST(min(i) AS BIGINT) AS first_at FROM m JOIN directory ON said = name GROUP BY ALL""")
def company_mentions(spark, sf_dir):
    return en.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", directory(spark, sf_dir))


@query()
def similar_companies(spark, sf_dir):
    return en.fuzzy_mentions(table(spark, sf_dir, "documents"), "doc_id", "text", directory(spark, sf_dir))


@query()
def company_matches(spark, sf_dir):
    return en.ticker_matches(table(spark, sf_dir, "documents"), "doc_id", "text", directory(spark, sf_dir))


_PRINTS = rf"""
w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda x: regexp_matches(x, '^[\p{{L}}\p{{N}}]+$') AND NOT list_contains({sql_list(tx.STOP_WORDS)}, x)) AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS f, 1 AS weight FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), 1 FROM w
  UNION ALL SELECT doc_id, f, CASE WHEN regexp_matches(f, '{"|".join(fp.HEAVY_TERMS)}') THEN {fp.HEAVY_WEIGHT} ELSE 1 END FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1] || '_' || w[i + 2])) AS f FROM w)),
h AS (SELECT doc_id, weight, CAST('0x' || substr(md5(f), 17, 16) AS UBIGINT) AS h FROM f),
v AS (SELECT doc_id, b, sum(CASE WHEN (h >> CAST(b AS UBIGINT)) & 1 = 1 THEN weight ELSE -weight END) > 0 AS s FROM h, range(64) AS r(b) GROUP BY doc_id, b),
p AS (SELECT d.doc_id, coalesce(x, 0::UHUGEINT) AS x FROM documents d LEFT JOIN (SELECT doc_id, bit_or(CASE WHEN s THEN 1::UHUGEINT << CAST(b AS UHUGEINT) ELSE 0::UHUGEINT END) AS x FROM v GROUP BY doc_id) q ON d.doc_id = q.doc_id),
prints AS (SELECT doc_id, CAST(CASE WHEN x >= 9223372036854775808::UHUGEINT THEN CAST(x AS HUGEINT) - 18446744073709551616::HUGEINT ELSE CAST(x AS HUGEINT) END AS BIGINT) AS fingerprint, CAST(x AS UBIGINT) AS u FROM p)"""


@query("WITH " + _PRINTS.lstrip() + " SELECT doc_id, fingerprint FROM prints")
def weighted_fingerprints(spark, sf_dir):
    return fp.weighted_fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("WITH " + _PRINTS.lstrip() + ", d AS (SELECT DISTINCT fingerprint, u FROM prints) SELECT a.fingerprint AS fp_a, b.fingerprint AS fp_b, CAST(bit_count(xor(a.u, b.u)) AS INTEGER) AS bits FROM d a JOIN d b ON a.fingerprint < b.fingerprint AND bit_count(xor(a.u, b.u)) <= 3")
def fingerprint_links(spark, sf_dir):
    return fp.fingerprint_links(fp.weighted_fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query()
def fingerprint_classes(spark, sf_dir):
    return fp.fingerprint_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


_STATES = """e AS (SELECT event_id, user_id AS key, epoch_us(ts) AS t, event_type = 'error' AS bad FROM events), wm AS (SELECT (max(t) // 1000) * 1000 - 600000000 AS wm FROM e)"""


def _events(spark, sf_dir):
    return st.read_events(spark, sf_dir).select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("bad"), (F.col("event_type") == "error").alias("failed"))


def _utc(*columns):
    return [F.col(c).cast("timestamp_ntz").alias(c) for c in columns]


# failures since the last success, three to a round; a redelivery is due unless another result comes before it
@query(f"""WITH {_STATES}, r AS (SELECT *, sum(CAST(NOT bad AS INTEGER)) OVER (PARTITION BY key ORDER BY t, event_id) AS run, lead(t) OVER (PARTITION BY key ORDER BY t, event_id) AS next_t FROM e),
  n AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY t, event_id) AS k FROM r WHERE bad), a AS (SELECT *, (k - 1) % 3 + 1 AS attempts FROM n)
  SELECT key, 'dead' AS action, CAST(attempts AS INTEGER) AS attempts, make_timestamp(t) AS at FROM a WHERE attempts = 3
  UNION ALL SELECT key, 'retry', CAST(attempts AS INTEGER), make_timestamp(t + CAST(power(2, attempts) AS BIGINT) * 1000000) FROM a, wm WHERE attempts < 3 AND coalesce(t + CAST(power(2, attempts) AS BIGINT) * 1000000 <= next_t, ((t + CAST(power(2, attempts) AS BIGINT) * 1000000 + 999) // 1000) * 1000 <= wm)""")
def stream_redelivery(spark, sf_dir):
    # nothing is forgotten within a year, so that the number of attempts depends on the results alone
    return st.run_to_table(ss.keyed(_events(spark, sf_dir), "user_id", ss.Redelivery(forget=31_536_000)), "redelivery").select("key", "action", "attempts", *_utc("at"))


# an alert is new after a good event or a day without a bad one
@query(f"""WITH {_STATES}, r AS (SELECT *, sum(CAST(NOT bad AS INTEGER)) OVER (PARTITION BY key ORDER BY t, event_id) AS run FROM e),
  b AS (SELECT *, coalesce(CAST(t >= lag(t) OVER (PARTITION BY key, run ORDER BY t, event_id) + 86400000000 AS INTEGER), 1) AS new FROM r WHERE bad), g AS (SELECT *, sum(new) OVER (PARTITION BY key, run ORDER BY t, event_id) AS part FROM b),
  a AS (SELECT key, run, part, min(t) AS opened, max(t) AS seen, count(*) AS n FROM g GROUP BY key, run, part), z AS (SELECT a.*, (SELECT min(t) FROM r WHERE NOT r.bad AND r.key = a.key AND r.run = a.run + 1) AS good FROM a)
  SELECT key, 'opened' AS state, make_timestamp(opened) AS opened, make_timestamp(opened) AS at, 1 AS n FROM a
  UNION ALL SELECT key, 'resolved', make_timestamp(opened), make_timestamp(good), n FROM z WHERE good < seen + 86400000000
  UNION ALL SELECT key, 'expired', make_timestamp(opened), make_timestamp(seen + 86400000000), n FROM z, wm WHERE coalesce(good, 9e18) >= seen + 86400000000 AND (good IS NOT NULL OR EXISTS (SELECT 1 FROM e WHERE e.key = z.key AND e.t >= seen + 86400000000) OR ((seen + 86400000999) // 1000) * 1000 <= wm)""")
def stream_alert_states(spark, sf_dir):
    return st.run_to_table(ss.keyed(_events(spark, sf_dir), "user_id", ss.AlertStates(days=1)), "alert-states").select("key", "state", *_utc("opened", "at"), "n")


@query()
def stream_near_duplicates(spark, sf_dir):
    """Documents as a stream of fingerprints, marked by the index that grows with them."""
    prints = fp.weighted_fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("doc_id").alias("id"), F.timestamp_seconds("doc_id").alias("ts"), F.col("fingerprint").alias("fp"))
    prints, path, index = staged(prints, "prints"), shared_path(spark, "print-stream"), shared_path(spark, "near-duplicates")
    middle = prints.agg(F.percentile_approx("id", 0.5)).head()[0] or 0
    for part in (F.col("id") <= middle, F.col("id") > middle):  # the second half finds the index of the first
        prints.where(part).write.mode("append").parquet(path)
        marked = ss.near_duplicate_stream(spark.readStream.schema(prints.schema).parquet(path), "near-duplicates", path=index)
    return marked.select(F.col("id").alias("doc_id"), F.col("fp").alias("fingerprint"), F.col("keep_id").isNull().alias("kept"), F.coalesce("keep_id", "id").alias("keep_id"))


_GRADES = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS raw, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS line, substr(coalesce(text, ''), 1, 60) AS title FROM documents),
p AS (SELECT *, lower(line) AS low, list_filter(list_transform(string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 20) AS parts,
  list_filter(list_transform(regexp_split_to_array(raw, '\r\n|\n|\r'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS lines, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{{3,}}')) AS tt, list_distinct(regexp_extract_all(lower(line), '[a-z0-9]{{3,}}')) AS lt FROM t),
m AS (SELECT *, list_transform(list_filter(lines, lambda x: length(x) >= 20), lambda x: lower(x)) AS longs, len(list_filter(parts, lambda s: len(regexp_split_to_array(s, '\s+')) >= 7 AND regexp_matches(lower(s), '{"|".join(qu.ARTICLE_VERBS)}|{qu.ARTICLE_WORDS}'))) / greatest(len(parts), 1) AS prose,
  coalesce(len(list_intersect(tt, lt)) / nullif(len(tt), 0), 0) AS overlap, {" + ".join(f"(length(low) - length(replace(low, '{p}', ''))) / {len(p)}" for p in qu.BOILERPLATE_PHRASES)} AS clutter,
  ({" + ".join(f"(length(low) - length(replace(low, '{p}', '')))" for p in qu.SHELL_PHRASES)}) / greatest(length(line), 1) AS shell, regexp_matches(low, '{"|".join(qu.SHELL_PHRASES)}') AS any_shell FROM p),
r AS (SELECT *, CASE WHEN len(longs) < 2 THEN 0 ELSE 1 - len(list_distinct(longs)) / len(longs) END AS again FROM m),
s AS (SELECT *, any_shell AND (length(line) < 500 OR shell >= 0.15) AS is_shell, round(greatest(0, least(100, 10 + CASE WHEN length(line) >= 1600 THEN 30 WHEN length(line) >= 800 THEN 24 WHEN length(line) >= 400 THEN 16 WHEN length(line) >= 220 THEN 8 ELSE -12 END
  + CASE WHEN len(parts) >= 10 THEN 20 WHEN len(parts) >= 5 THEN 14 WHEN len(parts) >= 3 THEN 8 ELSE -8 END + CASE WHEN len(lines) >= 5 THEN 10 WHEN len(lines) >= 2 THEN 6 ELSE 0 END + CASE WHEN prose >= 0.6 THEN 12 WHEN prose < 0.3 THEN -10 ELSE 0 END
  + CASE WHEN regexp_matches(low, '(^|[^a-z0-9])(the|der)([^a-z0-9]|$)') THEN 12 ELSE -8 END + CASE WHEN overlap >= 0.45 THEN 12 WHEN overlap >= 0.2 THEN 7 ELSE 0 END + CASE WHEN clutter / greatest(len(parts), 1) >= 0.5 THEN -25 ELSE -least(10, clutter * 3) END
  + CASE WHEN again >= 0.35 THEN -20 WHEN again >= 0.15 THEN -8 ELSE 0 END)), 2) AS score FROM r)
SELECT doc_id, CASE WHEN is_shell THEN 0.0 ELSE CAST(score AS DOUBLE) END AS score, CASE WHEN is_shell THEN 'blocked_or_shell' WHEN score >= 75 THEN 'strong_full_text' WHEN score >= 52 THEN 'usable_full_text' ELSE 'weak_text' END AS grade FROM s
"""


@query(_GRADES)
def extraction_grades(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", qu.extraction_quality("text", F.substring(F.coalesce("text", F.lit("")), 1, 60), terms=["the", "der"]).alias("q")).select("doc_id", "q.score", "q.grade")


@query()
def page_articles(spark, sf_dir):
    """Each page's title, authors, dates, source, and the reading of it that won."""
    out = qu.best_reading(pg.read_pages(table(spark, sf_dir, "pages")))
    return out.select("page_id", "title", F.size("authors").cast("long").alias("n_authors"), "published", "updated", "source", "method", "basis", "grade", "score", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


_TERMS_SQL = " + ".join(f"{w} * ((length(low) - length(replace(low, '{t}', ''))) / {len(t)})" for t, w in qu.TERM_WEIGHTS.items())
_PARTS_SQL = rf"""
WITH t AS (SELECT doc_id, doc_id % 400 AS age, coalesce(text, '') AS x, lower(coalesce(text, '')) AS low FROM documents),
m AS (SELECT *, len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) AS words, len(list_filter(string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS sentences,
  len(list_filter(string_split(x, chr(10) || chr(10)), lambda p: trim(replace(p, chr(10), ' ')) <> '')) AS paragraphs, len(regexp_extract_all(x, '{qu.NUMBERS}')) AS numbers, len(regexp_extract_all(x, '"[^"]*"')) AS quotes, floor(round({_TERMS_SQL}, 6)) AS terms,
  len(regexp_extract_all(x, '\b\d{{4}}\b')) AS years, len(regexp_extract_all(x, '(?i){qu.MONTHS}')) AS months FROM t),
q AS (SELECT *, words / greatest(sentences, 1) AS mean, sentences / greatest(paragraphs, 1) AS per FROM m)
SELECT doc_id, round(CASE WHEN words < 150 THEN 0.1 WHEN words <= 5000 THEN 0.3 ELSE 0.2 END + CASE WHEN sentences >= 5 THEN 0.2 ELSE 0 END + CASE WHEN paragraphs >= 2 THEN 0.15 ELSE 0 END + CASE WHEN mean <= 35 THEN 0.1 ELSE 0 END + CASE WHEN numbers >= 3 THEN 0.1 ELSE 0 END
    + CASE WHEN quotes >= 1 THEN 0.05 ELSE 0 END + CASE WHEN terms >= 3 THEN 0.1 ELSE 0 END, 4) AS content,
  round(CASE WHEN paragraphs BETWEEN 2 AND 15 THEN 0.3 WHEN paragraphs > 15 THEN 0.2 ELSE 0.1 END + CASE WHEN mean BETWEEN 15 AND 25 THEN 0.3 WHEN mean BETWEEN 10 AND 30 THEN 0.2 ELSE 0.1 END + CASE WHEN per BETWEEN 3 AND 6 THEN 0.2 ELSE 0.1 END
    + CASE WHEN numbers > 0 THEN 0.1 ELSE 0 END + CASE WHEN quotes > 0 THEN 0.1 ELSE 0 END, 4) AS structure,
  round(CASE WHEN age <= 24 THEN 1.0 ELSE greatest(0.1, exp(-age / 24.0 / 7)) END, 5) AS timeliness,
  round(greatest(0.3, 0.8 - {" - ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN 0.1 ELSE 0 END" for p in qu.UNRIPE)}), 4) AS originality,
  round(CASE WHEN words = 0 THEN 0 ELSE least(1.0, (numbers + quotes + years + months + terms / 3) / words * 100 / 5) END, 5) AS factual FROM q
"""


@query(_PARTS_SQL)
def article_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 400).alias("age"), F.col("source").alias("host"), F.lit(None).cast("string").alias("author"))
    out = qu.assessed(docs, "text", "age", "host", "author", {"src0": 0.95, "src1": 0.5})
    return out.select("doc_id", *(F.round(c, n).cast("double").alias(c) for c, n in (("content", 4), ("structure", 4), ("timeliness", 5), ("originality", 4), ("factual", 5))))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}'']+') AS w, greatest(len(regexp_extract_all(coalesce(text, ''), '[.!?]+')), 1) AS s FROM documents),
  y AS (SELECT *, list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+')) - CASE WHEN regexp_matches(lower(x), '[^aeiouy]e$') AND len(regexp_extract_all(lower(x), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))) AS y FROM w)
  SELECT doc_id, CASE WHEN len(w) > 0 THEN round(206.835 - 1.015 * len(w) / s - 84.6 * y / len(w), 4) END AS ease FROM y""".replace("\\\\", "\\"))
def reading_ease(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(qu.reading_ease("text"), 4).alias("ease"))


def _signs(signs) -> str:
    return " + ".join(f"CAST(contains(h, '{s}') AS INTEGER)" for s in signs)


@query(f"""WITH p AS (SELECT page_id, lower(coalesce(html, '')) AS h FROM pages), n AS (SELECT *, len(list_filter(regexp_split_to_array(regexp_replace(h, '<[^>]*>', ' ', 'g'), '\\s+'), lambda w: w <> '')) AS n FROM p)
  SELECT page_id, CASE WHEN {_signs(pg.PAYWALL_SIGNS)} >= 2 THEN 'paywalled' WHEN {_signs(pg.PAYWALL_SIGNS)} = 1 OR {_signs(pg.FADE_SIGNS)} > 0 OR (n < 100 AND {_signs(pg.MEMBER_TERMS)} > 0) THEN 'preview' ELSE 'free' END AS status FROM n""")
def page_paywalls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pg.paywall_status("html").alias("status"))
