"""Operators against small literal cases and plain reference loops."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions import text as tx
from marketloom.operators import aggregate as ag
from marketloom.operators import decision as dc
from marketloom.operators import dedup as dd
from marketloom.operators import events as ev
from marketloom.operators import models
from marketloom.operators import ranking as rk
from marketloom.operators import relational as rel
from marketloom.operators import timeseries as ts
from marketloom.sources import files

DAY = dt.date(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def series(spark, values, symbol="A"):
    return spark.createDataFrame([(symbol, DAY + dt.timedelta(days=i), v) for i, v in enumerate(values)], "symbol string, date date, close double")


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://WWW.Example.com:443/a/b/?utm_source=x&b=2&a=1#f", "https://example.com/a/b?a=1&b=2"),
        ("http://m.example.com:80/", "http://example.com/"),
        ("https://example.com/story/amp/", "https://example.com/story"),
        ("https://news.google.com/x?url=https%3A%2F%2Fwww.site.org%2Fp%3Fref%3D1", "https://site.org/p"),
        ("", ""),
        (None, ""),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, tx.canonical_url(F.lit(url).cast("string"))) == want


def test_titles_and_sets(spark):
    assert one(spark, tx.normalized_title(F.lit("  Apple's Q3: up_5%! "))) == "apple s q3 up 5"
    assert one(spark, tx.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert one(spark, tx.md5_bucket(F.lit("user-1"))) == int(__import__("hashlib").md5(b"user-1").hexdigest(), 16) % 100


def test_redaction(spark):
    assert one(spark, tx.redacted(F.lit("mail a.b@c.org token=abc123 x"))) == "mail [REDACTED] token=[REDACTED] x"


def test_lexicon(spark):
    score, confidence = tx.lexicon_sentiment(F.lit("Profit beats, profit! loss."), ["profit", "beats"], ["loss"])
    assert one(spark, score) == pytest.approx(1 / 3)
    assert one(spark, confidence) == pytest.approx(2 / 3)


def test_best_sentence(spark):
    assert one(spark, tx.best_sentence(F.lit("No hit here. Profit rose. Profit and loss rose."), ["profit", "loss"])) == "Profit and loss rose."


def test_windows_need_enough_rows(spark):
    got = [r.m for r in series(spark, [1.0, 2.0, 3.0]).select(ts.sma("close", 2).alias("m"), "date").orderBy("date").collect()]
    assert got == [None, 1.5, 2.5]


def test_ewma_is_pandas(spark):
    values = [random.Random(1).random() for _ in range(40)]
    got = [r.e for r in ts.ewma(series(spark, values), {"e": ("close", 0.2)}).orderBy("date").collect()]
    assert got == pytest.approx(pd.Series(values).ewm(alpha=0.2).mean().tolist())


def test_rsi_ends(spark):
    up = [r.rsi for r in ts.rsi(series(spark, [float(i) for i in range(16)])).orderBy("date").collect()]
    assert up[-1] == 100 and up[5] is None


def test_total_loss(spark):
    rets = series(spark, [0.1, -1.0, 0.5]).withColumnRenamed("close", "ret")
    assert [round(r.wealth, 6) for r in ts.drawdown(rets).orderBy("date").collect()] == [1.1, 0.0, 0.0]


def test_business_days(spark):
    got = ts.business_days(series(spark, [1.0] * 8)).count()
    assert got == len(pd.bdate_range("2024-01-01", "2024-01-08"))


def test_asof(spark):
    left, right = series(spark, [1.0, 2.0, 3.0]), series(spark, [5.0]).select("symbol", F.lit(DAY + dt.timedelta(days=1)).alias("date"), F.col("close").alias("v"))
    assert [r.v for r in ts.asof_join(left, right, "v", 0.0).orderBy("date").collect()] == [0.0, 5.0, 5.0]


def test_exact_greedy_is_a_loop(spark):
    rng = random.Random(3)
    cur = [(i, rng.choice("abc"), rng.choice(["x", "", None])) for i in range(40)]
    old = [(i, rng.choice("abc"), rng.choice(["x", "", None])) for i in range(40)]
    free, want = list(old), []
    for i, k, u in cur:
        hit = next((o for o in free if u and (o[1], o[2]) == (k, u)), None)
        if hit:
            free.remove(hit)
            want.append((i, hit[0]))
    a, b = (spark.createDataFrame(x, "id long, ticker string, url string") for x in (cur, old))
    assert sorted((r.id, r.prior_id) for r in rel.exact_greedy_match(a, b, ["ticker", "url"], "id").collect()) == sorted(want)


def test_orphans_keep_nulls(spark):
    rows, refs = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (None,)], "k int")
    assert {r.k for r in rel.orphans(rows, "k", refs).collect()} == {2, None}


def test_suffix_lookup(spark):
    rows = spark.createDataFrame([("news.bbc.co.uk",), ("x.org",)], "d string")
    table = spark.createDataFrame([("co.uk", 0.3), ("bbc.co.uk", 0.9)], "suffix string, v double")
    assert {r.d: r.v for r in rel.suffix_lookup(rows, "d", table, "v", 0.5).collect()} == {"news.bbc.co.uk": 0.9, "x.org": 0.5}


def test_capped_top_is_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abcd"), rng.randrange(9)) for i in range(60)]
    want, used = [], {}
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        if used.get(r[1], 0) < 3 and len(want) < 8:
            used[r[1]] = used.get(r[1], 0) + 1
            want.append(r[0])
    df = spark.createDataFrame(rows, "id long, g string, s int")
    assert [r.id for r in rk.capped_top(df, "g", [F.desc("s"), F.asc("id")], 3, 8).collect()] == want


def test_trim_dominant(spark):
    rows = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(10)], "id long, p string")
    kept = rk.trim_dominant(rows, "p", "id", 0.5).collect()
    assert sum(r.p == "a" for r in kept) == 3 and len(kept) == 6


def test_quota(spark):
    rows = spark.createDataFrame([(i, "p", ["t1"] if i % 2 else ["t2"]) for i in range(10)], "id long, p string, ts array<string>")
    assert [r.id for r in rk.quota_selection(rows, "id", "p", "ts", 5, 2).orderBy("id").collect()] == [0, 1, 2, 3]


def plain_capped_feeds(rows, per_source, per_ticker, total, share, direct_first):
    """Every article in turn, as the caps say, without candidates or sets."""
    out = []
    for batch in sorted({r["batch"] for r in rows}):
        mine = [r for r in rows if r["batch"] == batch and r["tickers"]]
        rank = lambda f: 4 if f == rk.DISCOVERY else rk.FAMILIES.index(f) if f in rk.FAMILIES else 3
        mine.sort(key=lambda r: (rank(r["family"]) if direct_first else 0, r["feed_no"], r["feed"], r["pos"], r["id"]))
        taken = []

        def fits(r):
            same = sum(t["provider"] == r["provider"] for t in taken) >= per_source or any(r["url"] is not None and t["url"] == r["url"] for t in taken)  # noqa: B023
            return not same and all(sum(x in t["tickers"] for t in taken) < per_ticker for x in r["tickers"])  # noqa: B023

        for provider in dict.fromkeys(r["provider"] for r in mine):
            own = [r for r in mine if r["provider"] == provider]
            if own[0]["family"] != rk.DISCOVERY:
                for r in own:
                    if len(taken) < total and fits(r):
                        taken.append(r)
                continue
            direct = sum(r["family"] != rk.DISCOVERY for r in taken)
            room = total if not direct or share >= 1 else 0 if share <= 0 else max(0, min(int(direct * share / (1 - share)), int(total * share), total - direct))
            end = min(total, len(taken) + room)
            queues = [[r for r in own if r["feed"] == f] for f in dict.fromkeys(r["feed"] for r in own)]
            while any(queues) and len(taken) < end:
                for q in queues:
                    while q and len(taken) < end:
                        r = q.pop(0)
                        if fits(r):
                            taken.append(r)
                            break
        out += [(batch, r["id"], i) for i, r in enumerate(taken, 1)]
    return out


@pytest.mark.parametrize("caps", [(6, 4, 20, 0.5, True), (50, 3, 12, 0.75, False), (4, 9, 30, 0.0, True), (9, 2, 100, 1.0, True)])
def test_capped_feeds(spark, caps):
    rng = random.Random(sum(caps[:3]))
    families = {"a": rk.FAMILIES[2], "b": rk.DISCOVERY, "c": rk.FAMILIES[0], "d": None, "e": rk.DISCOVERY}
    rows = []
    for i in range(600):
        provider, part = rng.choice("abcde"), rng.randrange(3)
        url = rng.choice([None, *(f"u{k}" for k in range(60))])
        rows.append(dict(batch=rng.randrange(2), id=i, provider=provider, feed=f"{provider}{part}", feed_no=part * 5 + "ebdac".index(provider), family=families[provider], pos=rng.randrange(40), url=url, tickers=sorted(rng.sample("QRSTUVW", rng.choice([0, 1, 1, 2])))))
    schema = "batch int, id long, provider string, feed string, feed_no int, family string, pos int, url string, tickers array<string>"
    got = rk.capped_feeds(spark.createDataFrame(rows, schema), *caps)
    want = plain_capped_feeds(rows, *caps)
    assert sorted((r.batch, r.id, r.place) for r in got.collect()) == sorted(want) and want
    assert rk.capped_feeds(spark.createDataFrame([], schema), *caps).count() == 0


def test_candidates_of_feeds_are_bounded(spark):
    rows = [(0, i, "p", "f", 0, None, i, f"u{i}", ["T"]) for i in range(500)]
    df = spark.createDataFrame(rows, "batch int, id long, provider string, feed string, feed_no int, family string, pos int, url string, tickers array<string>")
    assert rk.feed_candidates(df, 3, 10).count() == 13


def test_z_test(spark):
    m = spark.createDataFrame([("a", 1000, 0.10), ("b", 1000, 0.13)], "variation string, users long, rate double")
    row = ag.z_test(m, "variation", "a").head()
    from statistics import NormalDist

    assert row.p_value == pytest.approx(2 * (1 - NormalDist().cdf(abs(row.z))), abs=1e-6)


def test_discrete_quantile(spark):
    rows = spark.createDataFrame([("g", float(i)) for i in range(20)], "g string, x double")
    assert rows.groupBy("g").agg(ag.discrete_quantile("x", 0.95).alias("q")).head().q == 19.0


def leader_loop(rows):
    leaders, out = [], []
    for seq, url, title, tickers, day in rows:
        hit = None
        for i, (u, t, k, d) in enumerate(leaders):
            if url and url == u:
                hit = (i, "exact_url")
            elif title and title == t:
                hit = (i, "exact_title")
            elif title and t and not (tickers and k and not tickers & k):
                near = tickers & k and day and d and abs((day - d).days) <= 1
                s = dd.sequence_ratio(title, t)
                hit = (i, "similar_title") if s >= 0.82 else (i, "same_ticker_near_date") if near and s >= 0.72 else None
            if hit:
                break
        if hit is None:
            leaders.append((url, title, tickers, day))
            hit = (len(leaders) - 1, "leader")
        out.append((seq, *hit))
    return out


def test_leader_clusters_are_the_loop(spark):
    rng = random.Random(7)
    words = ["apple", "beats", "misses", "profit", "q3", "record", "shares"]
    rows = [(i, rng.choice(["", f"u{rng.randrange(9)}"]), " ".join(rng.choices(words, k=rng.randrange(3, 6))), set(rng.sample("ABC", rng.randrange(3))), DAY + dt.timedelta(days=rng.randrange(5))) for i in range(60)]
    df = spark.createDataFrame([("r", s, u, t, sorted(k), d) for s, u, t, k, d in rows], "run string, seq long, url_key string, title_key string, tickers array<string>, day date")
    got = sorted((r.seq, r.cluster, r.reason) for r in dd.leader_clusters(df, ["run"]).collect())
    assert got == leader_loop(rows)


def test_token_set():
    assert dd.token_set_score("apple beats q3", "q3 apple beats estimates") == 100
    assert dd.token_set_score("", "x") == 0


def test_minhash_finds_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    edit = base[:60] + ["changed"] + base[61:]
    rows = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(edit)), (3, " ".join(reversed(base))), (4, "")], "id long, text string")
    assert [(r.a, r.b) for r in dd.minhash_links(rows, "id", "text").collect()] == [(1, 2)]


def test_minhash_links_beyond_the_first_of_a_band(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    texts = [[f"x{rng.randrange(10**9)}" if rng.random() < 0.07 else w for w in base] for _ in range(60)]
    ids = [(i, t) for i, t in enumerate(texts)] + [(100 + i, [*t[:-1], "end"]) for i, t in enumerate(texts)]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in ids], "id long, text string")
    links = dd.minhash_links(rows, "id", "text", permutations=4, bands=4).collect()  # so few bands are full of other variants
    sets = {i: {tuple(t[k : k + 3]) for k in range(198)} for i, t in ids}
    for r in links:
        assert r.a < r.b and abs(r.jaccard - len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b])) < 1e-9 and r.jaccard >= 0.8
    assert len(links) == len({(r.a, r.b) for r in links}) and {(i, 100 + i) for i in range(60)} <= {(r.a, r.b) for r in links}


def test_cluster_confidence(spark):
    members = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.0), (1, "c", 0.5), (2, "a", 1.0)], "cluster long, source string, sentiment double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    rep = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    got = {r.cluster: (r.confidence, round(r.consensus, 4)) for r in dd.cluster_records(members, rep, ["a"]).collect()}
    assert got == {1: (0.9, 0.625), 2: (0.4, 1.0)}


def test_fuzzy_greedy(spark):
    cur = [(1, "T", "apple wins contract", DAY, ["x"]), (2, "T", "apple wins contract", DAY, ["x"]), (3, "U", "apple wins contract", DAY, ["x"]), (4, "T", None, DAY, ["x"])]
    old = [(8, "T", "apple wins contract", DAY + dt.timedelta(days=2), ["y"]), (9, "T", "apple wins contract", DAY + dt.timedelta(days=3), ["x"])]
    a, b = (spark.createDataFrame(x, "id long, ticker string, title string, day date, meta array<string>") for x in (cur, old))
    assert sorted((r.cur_id, r.prior_id) for r in ev.fuzzy_greedy_match(a, b).collect()) == [(1, 9), (2, 8)]


def test_may_reach_loses_nothing():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choices("abcde ", k=rng.randrange(1, 14))) for _ in "ab")
        assert dd.sequence_ratio(a, b) < 0.78 or dd.may_reach(a, b, 0.78)


def test_rules_first_match(spark):
    rows = spark.createDataFrame([(5,), (1,)], "x int")
    out = dc.rule_engine(rows, [("big", F.col("x") > 3, "buy", 0.9), ("any", F.col("x") > 0, "sell", 0.2)])
    assert [r.action for r in out.orderBy("x").collect()] == ["sell", "buy"]


def test_cooldown(spark):
    rows = spark.createDataFrame([("a", i, dt.datetime(2024, 1, 1, 0, m)) for i, m in enumerate((0, 30, 59))] + [("a", 9, dt.datetime(2024, 1, 1, 1, 0))], "symbol string, id long, ts timestamp")
    assert sorted(r.id for r in dc.with_cooldown(rows).collect()) == [0, 9]


def test_autoregression_follows_a_line():
    import numpy as np

    assert models.autoregression(np.arange(30.0), 2, 3) == pytest.approx([30, 31, 32])


def test_html():
    title, author, site, body = files.parse_html("<html><head><title> A &amp; B </title><meta name='author' content='X'></head><body><script>no</script><p>One  two</p><nav>menu</nav><p>three</p></body>")
    assert (title, author, body) == ("A & B", "X", "One two\nthree")
    assert files.parse_html(None) == ("", "", "", "")


def test_csv_json_and_rss(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\nbad,1,1,1,1,1\n")
    rows = files.read_prices_csv(spark, f"file://{tmp_path}/p.csv").collect()
    assert [(r.date, r.close) for r in rows] == [(dt.date(2024, 1, 2), 1.5)]
    (tmp_path / "a.json").write_text('{"timestamp": "2024-01-02T00:00:00", "feature": "f"}\nnot json\n{"timestamp": "2023-01-02T00:00:00", "feature": "g"}\n')
    assert [r.feature for r in files.read_audit_log(spark, f"file://{tmp_path}/a.json", "2024-01-01").collect()] == ["f"]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>http://x/1</link><description>d</description><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item></channel></rss>")
    assert files.read_rss(spark, f"file://{tmp_path}/f.xml").head().published_at == dt.datetime(2024, 1, 2, 10)


def test_run_table_replaces_its_partitions_only(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    files.write_run_table(spark.createDataFrame([(1, "a"), (2, "b")], "x int, run_id string"), path)
    files.write_run_table(spark.createDataFrame([(3, "b")], "x int, run_id string"), path)
    assert sorted((r.x, r.run_id) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_cosine_blocks(spark):
    from marketloom.operators import ranking as rk

    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(40)] + [(40, [0.0] * 4), (41, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = vectors.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    many, one = ({tuple(r) for r in rk.cosine_topk(queries, vectors, 5, block).collect()} for block in (4, 100))
    assert many == one and len(one) == 14 * 5
    length = lambda v: sum(x * x for x in v) ** 0.5
    for q, v in rows[0:40:3]:
        near = sorted(((-sum(a * b for a, b in zip(v, w)) / (length(v) * length(w)) if length(v) * length(w) else 9, i) for i, w in rows[:41] if i != q))[:5] if length(v) else None
        if near:
            got = sorted((r[3], -r[2]) for r in one if r[0] == q)
            assert [round(s, 9) for _, s in got] == [round(s, 9) for s, _ in near]
    assert rk.cosine_topk(queries.limit(0), vectors, 5).count() == 0
