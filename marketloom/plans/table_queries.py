"""Relational, aggregation, ranking and experiment queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from marketloom.operators import aggregate as ag
from marketloom.operators import ranking as rk
from marketloom.operators import relational as rel
from marketloom.plans.registry import query, table


#: Means of amounts in cents can lie just between two rounded values; both engines are moved off such ties.
EPS = 1e-9


def r(column, digits: int = 6):
    return F.round(column, digits)


def mean(column, digits: int = 6):
    return F.round((F.col(column) if isinstance(column, str) else column) + EPS, digits)


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_shipdate FROM k WHERE r = 1""")
def latest_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rel.first_by(rows, ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), F.desc("l_partkey"), F.desc("l_suppkey"), F.desc("l_extendedprice")]).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("""WITH d AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1)
  SELECT k, v, 2 AS ver FROM d UNION ALL SELECT c_custkey, c_acctbal, 1 FROM customer WHERE c_custkey NOT IN (SELECT k FROM d)""")
def batch_upsert(spark, sf_dir):
    """Customers with their balance, updated by the largest order of those that have any."""
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(1).alias("ver"))
    changes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v")).withColumn("ver", F.lit(2))
    return rel.upsert(current, changes, ["k"], "ver")


@query("""WITH c AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1)
  SELECT k, v FROM c UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT k FROM c)""")
def insert_or_ignore(spark, sf_dir):
    """The largest order of each customer, joined by the balance of those without one."""
    current = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    changes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return rel.insert_or_ignore(current, changes, ["k"], [F.asc("v")])


@query("""SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""")
def orphan_anti_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    used = [orders.where(c).select(F.col("o_custkey").alias("k")) for c in ("o_orderstatus = 'P'", "o_totalprice > 450000")]
    return rel.orphans(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k", *used)


@query("""SELECT c_custkey AS k, (SELECT o_orderpriority FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderkey LIMIT 1) AS priority FROM customer""")
def correlated_first(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("priority"), "o_orderkey")
    return rel.lookup_first(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), facts, "k", "priority", "o_orderkey")


@query("""SELECT c_custkey AS k, round(coalesce(avg(o_totalprice), 0) + 1e-9, 6) AS price FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def correlated_mean(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price"))
    out = rel.lookup_mean(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), facts, "k", "price")
    return out.select("k", mean("price").alias("price"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day FROM events), c AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM e WHERE day >= DATE '2024-01-16'),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM e WHERE day < DATE '2024-01-16')
  SELECT c.event_id, p.event_id AS prior_event_id FROM c JOIN p ON c.user_id = p.user_id AND c.event_type = p.event_type AND c.nth = p.nth""")
def exact_greedy_match(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    out = rel.exact_greedy_match(rows.where("day >= '2024-01-16'"), rows.where("day < '2024-01-16'"), ["user_id", "event_type"], "event_id")
    return out.select("event_id", "prior_event_id")


@query("""WITH e AS (SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS day FROM events),
  j AS (SELECT c.event_id AS cur_id, p.event_id AS prior_id, round(1 / (1 + abs(c.value - p.value)), 6) AS score, row_number() OVER (PARTITION BY c.event_id ORDER BY round(1 / (1 + abs(c.value - p.value)), 6) DESC, abs(c.day - p.day), p.event_id) AS r
    FROM e c JOIN e p ON c.user_id = p.user_id AND c.event_type = 'purchase' AND p.event_type = 'click' AND abs(c.day - p.day) <= 3)
  SELECT cur_id, prior_id, score FROM j WHERE r = 1""")
def review_best_candidate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "value", F.to_date("ts").alias("day"))
    score = lambda c, p: r(1 / (1 + F.abs(c["value"] - p["value"])))
    return rel.best_candidate(rows.where("event_type = 'purchase'"), rows.where("event_type = 'click'"), "user_id", "day", 3, score)


@query("""WITH c AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), d AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
  SELECT (SELECT count(*) FROM (SELECT k FROM c INTERSECT SELECT k FROM d)) AS n_both, (SELECT count(*) FROM (SELECT k FROM c UNION SELECT k FROM d)) AS n_either, (SELECT count(*) FROM (SELECT k FROM c EXCEPT SELECT k FROM d)) AS n_first_only""")
def set_operations(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.lit(1).alias("a"))
    b = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"), F.lit(2).alias("a"))
    sides = a.union(b).groupBy("k").agg(F.bit_or("a").alias("side"))
    return sides.agg(F.count_if(F.col("side") == 3).alias("n_both"), F.count("*").alias("n_either"), F.count_if(F.col("side") == 1).alias("n_first_only"))


@query("""WITH s AS (SELECT source, count(*) AS mentions, avg(n_chars) AS m FROM documents GROUP BY source), k AS (SELECT *, row_number() OVER (ORDER BY mentions DESC, source) AS rank FROM s)
  SELECT source, mentions, round(m + 1e-9, 4) AS mean_score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def mention_leaders(spark, sf_dir):
    return ag.leaders(table(spark, sf_dir, "documents"), "source", "n_chars").select("source", "mentions", mean("mean_score", 4).alias("mean_score"), "rank")


@query("""WITH a AS (SELECT event_type, user_id, value, date_diff('microsecond', ts, TIMESTAMP '2024-01-31 00:00:00') / 3.6e9 AS age FROM events)
  SELECT event_type, count(*) FILTER (age <= 24) AS n_24h, count(*) FILTER (age <= 72) AS n_3d, count(*) FILTER (age <= 168) AS n_7d, count(*) FILTER (age <= 720) AS n_30d,
  round(avg(value) FILTER (age <= 24) + 1e-9, 5) AS mean_24h, round(avg(value) FILTER (age <= 72) + 1e-9, 5) AS mean_3d, round(avg(value) FILTER (age <= 168) + 1e-9, 5) AS mean_7d, round(avg(value) FILTER (age <= 720) + 1e-9, 5) AS mean_30d, count(DISTINCT user_id) AS n_sources FROM a GROUP BY event_type""")
def recency_buckets(spark, sf_dir):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "events").withColumn("age", (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9)
    out = ag.recency_summary(rows, "event_type", "age", "value", "user_id")
    return out.select("event_type", "n_24h", "n_3d", "n_7d", "n_30d", *(mean(c, 5).alias(c) for c in ("mean_24h", "mean_3d", "mean_7d", "mean_30d")), "n_sources")


@query("""WITH a AS (SELECT CASE WHEN age <= 24 THEN 'today_signal' WHEN age <= 72 THEN 'recent_pulse' WHEN age <= 168 THEN 'weekly_trend' WHEN age <= 720 THEN 'background_context' ELSE 'archive_context' END AS bucket
    FROM (SELECT date_diff('microsecond', ts, TIMESTAMP '2024-01-31 00:00:00') / 3.6e9 AS age FROM events)), l AS (SELECT unnest(['today_signal', 'recent_pulse', 'weekly_trend', 'background_context', 'archive_context', 'unknown']) AS label)
  SELECT label, count(bucket) AS n FROM l LEFT JOIN a ON bucket = label GROUP BY label""")
def bucket_counts(spark, sf_dir):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    rows = table(spark, sf_dir, "events").select(ag.recency_bucket((F.unix_micros(as_of) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9).alias("bucket"))
    labels = spark.createDataFrame([(x,) for x in ("today_signal", "recent_pulse", "weekly_trend", "background_context", "archive_context", "unknown")], "label string")
    return ag.label_counts(rows, "bucket", labels)


@query("""WITH b AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2), p AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM b)
  SELECT source, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) * 100 ELSE 0 END, 5) AS balance FROM p GROUP BY source""")
def entropy_balance(spark, sf_dir):
    return ag.entropy_balance(table(spark, sf_dir, "documents").where("lang is not null"), "source", "lang").select("source", r("balance", 5).alias("balance"))


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, round(n / (SELECT sum(n) FROM s), 6) AS share, n / (SELECT sum(n) FROM s) > 0.3 AS concentrated FROM s ORDER BY n DESC, source LIMIT 1""")
def top_share_warning(spark, sf_dir):
    return ag.top_share(table(spark, sf_dir, "documents"), "source", 0.3).select("source", r("share").alias("share"), "concentrated")


@query("""SELECT source, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM documents), 6) AS share, count(*) AS n FROM documents GROUP BY source""")
def source_shares(spark, sf_dir):
    return ag.shares(table(spark, sf_dir, "documents"), "source").select("source", "n", r("share").alias("share"))


_LINES = "(SELECT l_returnflag AS ticker, l_orderkey * 10 + l_linenumber AS seq, l_discount - 0.05 AS score, l_quantity AS weight, CASE l_linestatus WHEN 'F' THEN 'full_text' ELSE 'snippet' END AS basis, l_tax AS tax FROM lineitem)"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("ticker"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_discount") - 0.05).alias("score"), F.col("l_quantity").alias("weight"), F.when(F.col("l_linestatus") == "F", "full_text").otherwise("snippet").alias("basis"), F.col("l_tax").alias("tax"), F.col("l_orderkey").cast("string").alias("title"))


@query(f"""SELECT ticker, count(*) AS n, count(*) FILTER (basis = 'full_text') AS n_full_text, count(*) FILTER (basis = 'snippet') AS n_snippet, count(*) FILTER (score > 0.05) AS n_positive, count(*) FILTER (score < -0.05) AS n_negative, count(*) FILTER (abs(score) <= 0.05) AS n_neutral,
  round(sum(score * weight) / sum(weight), 4) AS weighted_sentiment FROM {_LINES} GROUP BY ticker""")
def weighted_sentiment(spark, sf_dir):
    return ag.coverage(lines(spark, sf_dir), "ticker").select("ticker", "n", "n_full_text", "n_snippet", "n_positive", "n_negative", "n_neutral", "weighted_sentiment")


@query(f"""WITH s AS (SELECT ticker, CASE WHEN score > 0.05 THEN 1 WHEN score < -0.05 THEN -1 ELSE 0 END * CASE WHEN tax - 0.04 > 0.05 THEN 1 WHEN tax - 0.04 < -0.05 THEN -1 ELSE 0 END AS x FROM (SELECT ticker, score * 2 AS score, (tax - 0.04) * 2 + 0.04 AS tax FROM {_LINES})), g AS (SELECT ticker, count(*) AS n, count(*) FILTER (x < 0) AS n_disagree FROM s GROUP BY ticker)
  SELECT ticker, n, n_disagree, round(n_disagree / n, 6) AS ratio, CASE WHEN n_disagree / n <= 0.1 THEN 'aligned' WHEN n_disagree / n <= 0.3 THEN 'mixed' ELSE 'divergent' END AS grade FROM g""")
def score_disagreement(spark, sf_dir):
    rows = lines(spark, sf_dir).select("ticker", (F.col("score") * 2).alias("ours"), ((F.col("tax") - 0.04) * 2 + 0.04 - 0.04).alias("theirs"))
    return ag.disagreement(rows, "ticker", "ours", "theirs").select("ticker", "n", "n_disagree", r("ratio").alias("ratio"), "grade")


@query("""SELECT event_type AS feature, CASE WHEN value > 10 THEN 'ok' ELSE 'slow' END AS status, count(*) AS n, round(avg(value) + 1e-9, 4) AS mean_duration, CAST(grouping(event_type, CASE WHEN value > 10 THEN 'ok' ELSE 'slow' END) AS BIGINT) AS level
  FROM events GROUP BY GROUPING SETS ((event_type), (CASE WHEN value > 10 THEN 'ok' ELSE 'slow' END), ())""")
def audit_summary_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("feature"), F.when(F.col("value") > 10, "ok").otherwise("slow").alias("status"), "value")
    return ag.audit_summary(rows, "feature", "status", "value").select("feature", "status", "n", mean("mean_duration", 4).alias("mean_duration"), "level")


@query("""WITH e AS (SELECT user_id % 20 AS publisher, event_id, value > 10 AS ok, event_type AS reason FROM events), t AS (SELECT publisher, reason, row_number() OVER (PARTITION BY publisher ORDER BY count(*) DESC, reason) AS r FROM e WHERE NOT ok GROUP BY 1, 2)
  SELECT e.publisher, count(*) AS attempts, count(*) FILTER (ok) AS successes, arg_max(e.reason, event_id) FILTER (NOT ok) AS last_reason, any_value(t.reason) AS top_reason, round(count(*) FILTER (ok) / count(*), 6) AS rate FROM e LEFT JOIN t ON e.publisher = t.publisher AND t.r = 1 GROUP BY e.publisher""")
def extraction_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("publisher"), "event_id", (F.col("value") > 10).alias("ok"), F.col("event_type").alias("reason"))
    return ag.success_rates(rows, "publisher", "ok", "reason", "event_id").select("publisher", "attempts", "successes", "last_reason", "top_reason", r("rate").alias("rate"))


_AB = "(SELECT *, CASE WHEN (CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 31, 2) AS INTEGER)) % 2 = 0 THEN 'control' ELSE 'treatment' END AS variation FROM events)"


def experiment(spark, sf_dir):
    bucket = F.conv(F.substring(F.md5(F.col("user_id").cast("string")), 31, 2), 16, 10).cast("int") % 2
    return table(spark, sf_dir, "events").withColumn("variation", F.when(bucket == 0, "control").otherwise("treatment"))


_METRICS = f"""u AS (SELECT variation, user_id, count(*) AS n, max(CAST(event_type = 'purchase' AS INTEGER)) AS hit, sum(value) FILTER (event_type = 'purchase') AS v FROM {_AB} GROUP BY 1, 2),
  m AS (SELECT variation, count(*) AS users, CAST(sum(hit) AS BIGINT) AS conversions, avg(hit) AS rate, coalesce(sum(v), 0) AS value, avg(CAST(n = 1 AS INTEGER)) AS bounce FROM u GROUP BY variation)"""


@query(f"WITH {_METRICS} SELECT variation, users, conversions, round(rate, 6) AS rate, round(value + 1e-9, 4) AS value, round(bounce, 6) AS bounce FROM m")
def ab_metrics(spark, sf_dir):
    out = ag.experiment_metrics(experiment(spark, sf_dir), "variation", "user_id", "event_type", "value", "purchase")
    return out.select("variation", "users", "conversions", r("rate").alias("rate"), mean("value", 4).alias("value"), r("bounce").alias("bounce"))


@query(f"""WITH {_METRICS}, j AS (SELECT t.variation, t.rate AS p1, t.users AS n1, c.rate AS p0, c.users AS n0, (t.users * t.rate + c.users * c.rate) / (t.users + c.users) AS p FROM m t JOIN m c ON t.variation = 'treatment' AND c.variation = 'control')
  SELECT variation, round((p1 - p0) / sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / n0)), 5) AS z, round(2 * asin(sqrt(p1)) - 2 * asin(sqrt(p0)), 6) AS cohens_h, round(p1 - p0 - 1.959964 * sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0), 6) AS ci_low, round(p1 - p0 + 1.959964 * sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0), 6) AS ci_high FROM j""")
def ab_ztest(spark, sf_dir):
    out = ag.z_test(ag.experiment_metrics(experiment(spark, sf_dir), "variation", "user_id", "event_type", "value", "purchase"), "variation", "control")
    return out.select("variation", r("z", 5).alias("z"), *(r(c).alias(c) for c in ("cohens_h", "ci_low", "ci_high")))


# the quantiles of 0.975 and 0.8, and the error function's series
_T = "1.0 / (1.0 + 0.3275911 * abs(x) / sqrt(2.0))"
_CDF = f"CASE WHEN x >= 0 THEN 1 - ({{tail}}) ELSE ({{tail}}) END".format(tail=f"(((((1.061405429 * {_T} - 1.453152027) * {_T}) + 1.421413741) * {_T} - 0.284496736) * {_T} + 0.254829592) * {_T} * exp(-x * x / 2) / 2")


@query(f"""WITH {_METRICS.replace("variation, user_id, count", "variation, event_id, count")}, j AS (SELECT t.variation, t.rate AS p1, t.users AS n1, c.rate AS p0, c.users AS n0, (t.users * t.rate + c.users * c.rate) / (t.users + c.users) AS p FROM m t JOIN m c ON t.variation = 'treatment' AND c.variation = 'control'),
  z AS (SELECT *, (p1 - p0) / sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / n0)) AS z, 2 * asin(sqrt(p0)) - 2 * asin(sqrt(p1)) AS h, 2.0 / (1.0 / n1 + 1.0 / n0) AS hm, 1.959963984540054 AS za, 0.8416212335729143 AS zb FROM j),
  e AS (SELECT *, (za + zb) * sqrt(0.18 / hm) AS mde FROM z), f AS (SELECT *, p0 + mde AS p2, (p0 + p0 + mde) / 2 AS pm, (SELECT 2 * (1 - ({_CDF})) FROM (SELECT abs(z) AS x)) AS pv, (SELECT {_CDF} FROM (SELECT h * sqrt(hm / 2) - za AS x)) AS pw FROM e)
  SELECT variation, round(pv, 5) AS p_value, CASE WHEN pv < 0.01 THEN 'highly_significant' WHEN pv < 0.05 THEN 'significant' WHEN pv < 0.1 THEN 'marginally_significant' ELSE 'not_significant' END AS significance,
  round(h, 6) AS effect_size, round(mde, 6) AS mde, round(pw, 5) AS power, CAST(greatest(100, floor(2 * (za + zb) * (za + zb) * pm * (1 - pm) / ((p2 - p0) * (p2 - p0)))) AS BIGINT) AS sample_size,
  CASE WHEN pv < 0.05 THEN CASE WHEN p1 > p0 THEN variation ELSE 'control' END END AS winner,
  list_filter([CASE WHEN least(n1, n0) < 100 THEN 'more_users' END, CASE WHEN pv >= 0.1 AND pw < 0.8 THEN 'low_power' END, CASE WHEN abs(h) < 0.2 THEN 'small_effect' WHEN abs(h) > 0.8 THEN 'large_effect' END, CASE WHEN (p1 / p0 - 1) * 100 > 10 THEN 'strong_lift' WHEN (p1 / p0 - 1) * 100 < -5 THEN 'negative_lift' END], lambda a: a IS NOT NULL) AS advice FROM f""")
def ab_plan(spark, sf_dir):
    # every event counts as a visitor of its own, since each user of the table converts
    out = ag.experiment_plan(ag.experiment_metrics(experiment(spark, sf_dir), "variation", "event_id", "event_type", "value", "purchase"), "variation", "control")
    return out.select("variation", r("p_value", 5).alias("p_value"), "significance", r("effect_size").alias("effect_size"), r("mde").alias("mde"), r("power", 5).alias("power"), "sample_size", "winner", "advice")


@query(f"SELECT variation, list(event_type || ':' || n ORDER BY event_type) AS events FROM (SELECT variation, event_type, count(*) AS n FROM {_AB} GROUP BY 1, 2) GROUP BY variation")
def experiment_breakdown(spark, sf_dir):
    out = ag.breakdown(experiment(spark, sf_dir), "variation", "event_type")
    return out.select("variation", F.transform(F.array_sort(F.map_keys("events")), lambda k: F.concat(k, F.lit(":"), F.element_at("events", k).cast("string"))).alias("events"))


@query("""WITH p AS (SELECT quality = 1 AS y, least(1.0, n_chars / 5000.0) AS s FROM labels JOIN documents USING (doc_id)), t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS threshold),
  c AS (SELECT threshold, count(*) FILTER (s >= threshold AND y) AS tp, count(*) FILTER (s >= threshold AND NOT y) AS fp, count(*) FILTER (s < threshold AND y) AS fn, count(*) FILTER (s < threshold AND NOT y) AS tn FROM p, t GROUP BY threshold),
  m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
  SELECT CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM m""")
def threshold_sweep(spark, sf_dir):
    pairs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 1).alias("y"), F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("s"))
    out = ag.threshold_sweep(pairs, "s", "y", [i / 10 for i in range(1, 10)])
    return out.select("threshold", "tp", "fp", "fn", "tn", *(r(c).alias(c) for c in ("precision", "recall", "f1")))


@query("""WITH b AS (SELECT list_distinct([quantile_cont(o_totalprice, i / 10.0) FOR i IN [0]]) AS unused FROM orders), q AS (SELECT quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM orders),
  d AS (SELECT o_totalprice AS x, len(list_filter(e, lambda y: y < o_totalprice)) AS bin FROM orders, q) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(x) + 1e-7, 3) AS mean FROM d GROUP BY bin""".replace("b AS (SELECT list_distinct([quantile_cont(o_totalprice, i / 10.0) FOR i IN [0]]) AS unused FROM orders), ", ""))
def confidence_deciles(spark, sf_dir):
    rows = ag.deciles(table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("x")), "x", "bin")
    return rows.groupBy("bin").agg(F.count("*").alias("n"), r(F.avg("x") + 1e-7, 3).alias("mean"))


@query("""WITH e AS (SELECT user_id % 10 AS worker, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'duplicate' ELSE 'success' END AS status, value FROM events),
  k AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY value) AS p, count(*) OVER (PARTITION BY worker) AS n FROM e)
  SELECT worker, count(*) AS n, round(count(*) FILTER (status = 'success') / count(*), 6) AS success_rate, round(count(*) FILTER (status = 'error') / count(*), 6) AS error_rate, round(count(*) FILTER (status = 'duplicate') / count(*), 6) AS duplicate_rate, round(avg(value) + 1e-9, 5) AS mean_seconds, max(value) FILTER (p = least(CAST(floor(n * 0.95) AS BIGINT) + 1, n)) AS p95 FROM k GROUP BY worker""")
def pipeline_metrics(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "duplicate").otherwise("success")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("worker"), status.alias("status"), "value")
    out = ag.pipeline_metrics(rows, "worker", "status", "value")
    return out.select("worker", "n", *(r(c).alias(c) for c in ("success_rate", "error_rate", "duplicate_rate")), mean("mean_seconds", 5).alias("mean_seconds"), "p95")


@query("""WITH k AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def per_group_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    return rk.top_per_group(rows, "l_suppkey", [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 10).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("""WITH k AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT o_orderkey, o_custkey FROM k WHERE r <= 3 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40""")
def capped_global_topn(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rk.capped_top(rows, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 40).select("o_orderkey", "o_custkey")


@query("""WITH k AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS stage FROM orders), c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY stage, o_totalprice DESC, o_orderkey) AS r FROM k)
  SELECT o_orderkey, o_custkey, CAST(stage AS INTEGER) AS stage FROM c WHERE r <= 2 ORDER BY stage, o_totalprice DESC, o_orderkey LIMIT 30""")
def priority_first_topn(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return rk.staged_top(rows, F.col("o_orderstatus") == "P", "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 30).select("o_orderkey", "o_custkey", "stage")


@query("""WITH k AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) SELECT event_id, event_type, CAST(rank AS INTEGER) AS rank FROM k ORDER BY rank, event_type LIMIT 25""")
def balanced_interleave(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return rk.interleaved(rows, "event_type", F.col("event_type"), [F.desc("value"), F.asc("event_id")], 25).select("event_id", "event_type", "rank")


@query("""WITH k AS (SELECT event_id, user_id % 50 AS ticker, event_type = 'purchase' AS good, row_number() OVER (PARTITION BY user_id % 50 ORDER BY value DESC, event_id) AS rank FROM events), f AS (SELECT ticker, coalesce(min(rank) FILTER (good), min(rank)) AS first FROM k GROUP BY ticker),
  n AS (SELECT k.ticker, min(rank) AS next FROM k JOIN f USING (ticker) WHERE rank <> first GROUP BY k.ticker)
  SELECT event_id, k.ticker, CASE WHEN rank = first THEN 'read_first' WHEN rank = next THEN 'read_next' ELSE 'background' END AS label FROM k JOIN f USING (ticker) LEFT JOIN n USING (ticker)""")
def reading_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("ticker"), "event_type", "value")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("value"), "event_id")))
    return rk.reading_labels(rows, "ticker", "rank", F.col("event_type") == "purchase").select("event_id", "ticker", "label")


@query("""WITH m AS (SELECT source, count(*) AS m FROM documents GROUP BY source), t AS (SELECT *, sum(m) OVER () AS n, row_number() OVER (ORDER BY m DESC, source) = 1 AS top FROM m),
  g AS (SELECT source, m, CASE WHEN top THEN greatest(CAST(ceil((m - 0.25 * n) / 0.75) AS BIGINT), 0) ELSE 0 END AS k FROM t), d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) SELECT doc_id, d.source FROM d JOIN g ON d.source = g.source WHERE r <= m - k""")
def trim_dominant_source(spark, sf_dir):
    return rk.trim_dominant(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 0.25)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(query AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS s FROM q, embeddings WHERE query_id <> vec_id),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(s, 5) AS similarity, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def cosine_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rk.cosine_topk(queries, vectors, 10).select("query_id", "vec_id", r("similarity", 5).alias("similarity"), "rank")


@query()
def quota_selection(spark, sf_dir):
    """Every user's events, at most 40 of a type and 15 of a hundred's digit, one task a user group."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.array((F.col("user_id") % 10).cast("string")).alias("tickers"), F.to_date("ts").cast("string").alias("day"))
    return rk.quota_selection(rows, "event_id", "event_type", "tickers", 40, 15, "day")


@query()
def capped_feeds(spark, sf_dir):
    """Each day's events as articles: types are providers with three feeds each, hundreds of users tickers, amounts URLs."""
    family = F.create_map(*(F.lit(x) for pair in {"purchase": rk.FAMILIES[0], "click": rk.FAMILIES[1], "view": rk.DISCOVERY}.items() for x in pair))
    ticker = lambda n: (F.col("user_id") % n).cast("string")
    part = F.col("user_id") % 3
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("batch"), F.col("event_id").alias("id"), F.col("event_type").alias("provider"), F.concat_ws("/", "event_type", part.cast("string")).alias("feed"), (part * 10).alias("feed_no"),
        F.element_at(family, F.col("event_type")).alias("family"), F.col("event_id").alias("pos"), F.round("value").cast("string").alias("url"), F.when(F.col("user_id") % 7 > 0, F.array(ticker(17), F.concat(F.lit("t"), ticker(5)))).otherwise(F.array().cast("array<string>")).alias("tickers"))
    return rk.capped_feeds(rows, 12, 8, 40, 0.3).withColumnRenamed("id", "event_id")
