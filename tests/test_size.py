"""What must not grow with the tables: broadcasts, candidates, memory."""

from __future__ import annotations

import random
from datetime import date
from difflib import SequenceMatcher
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa

from marketloom.operators import dedup as dd
from marketloom.operators import fingerprints as fp
from marketloom.sources import files


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprint_keys_are_not_broadcast(spark):
    prints = spark.createDataFrame([(0,), (7,), (15,), (-1,)], "fingerprint long")
    links = fp.fingerprint_links(prints)
    assert "Broadcast" not in plan_of(links)
    assert sorted(map(tuple, links.collect())) == [(0, 7, 3), (7, 15, 1)]


def test_bounds_of_titles_lose_nothing():
    rng, words = random.Random(3), ["ab", "bank", "cash", "dab", "gain", "loss", "x" * 30, "é"]
    titles = [" ".join(rng.choices(words, k=rng.randrange(6))) for _ in range(120)]
    table = dd.Titles(titles)
    for title in titles[:40]:
        most = table.most(title, 0.5, np.arange(len(titles)))
        shared, n = table.shared_words(title)
        for i, other in enumerate(titles):
            ratio = dd.sequence_ratio(title, other)
            assert not title or not other or ratio < 0.5 or most[i] >= ratio
            assert shared[i] == len(set(title.split()) & set(other.split())) and n == len(set(title.split()))


def test_leaders_that_cannot_reach_the_ratio_are_not_compared(monkeypatch):
    """Leaders that cannot reach a ratio are not compared."""
    calls = []
    monkeypatch.setattr(dd, "sequence_ratio", lambda a, b: calls.append(1) or SequenceMatcher(None, a, b).ratio())
    rng = random.Random(4)
    titles = ["".join(rng.choices("etaoinshrdlu ", k=50)).strip() for _ in range(150)]
    day = date(2024, 1, 1)

    class Grouped:  # what the operators ask of a frame, to reach the function that a task runs
        schema = type("S", (dict,), {"__missing__": lambda self, k: SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "string"))})()
        groupBy = cogroup = where = select = withColumn = lambda self, *a: self
        count = lambda self: 1
        applyInPandas = lambda self, f, schema: f

    rows = pd.DataFrame([(i, None, t, [], day, "r") for i, t in enumerate(titles)], columns=["seq", "url_key", "title_key", "tickers", "day", "run"])
    clusters = dd.leader_clusters(Grouped(), ["run"])(rows)
    assert len(clusters) == 150 and len(calls) < 1500  # 150 * 149 / 2 pairs, of which letters alone leave most


def test_cosine_pairs_are_chosen_before_they_are_joined(spark):
    """Ties by id, copies, zeros, nulls, other lengths and numbers without end give the same list as all pairs do."""
    from pyspark.sql import functions as F
    from marketloom.operators import ranking as rk

    rng = random.Random(5)
    vectors = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(60)] + [(60 + i, [1.0, 2.0, 3.0]) for i in range(30)]
    vectors += [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, 2.0]), (93, [float("inf"), 0.0, 1.0]), (94, [1e200, 1.0, 1.0]), (95, [float("nan"), 1.0, 1.0])]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    asks = rows.where("vec_id % 5 = 0 OR vec_id > 88").selectExpr("vec_id AS query_id", "embedding AS query")
    every = rows.join(asks).where("query_id <> vec_id").select("query_id", "vec_id", rk.cosine("query", "embedding").alias("similarity"))
    want = rk.top_per_group(every, "query_id", [F.desc("similarity"), F.asc("vec_id")], 4)
    got = rk.cosine_topk(asks, rows, 4, 10)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    scores = []
    for query in (2, 65):
        shared = SimpleNamespace(value=([query], [vectors[query][1]]))
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in vectors[:60]]), pa.array([v for _, v in vectors[:60]])], ["vec_id", "embedding"])
        scores += [x for part in rk._may_be_nearest(shared, 4, pa.int64())([batch]) for x in part.column(2).to_pylist()]
    assert len(scores) < 60


def test_pages_are_parsed_a_few_at_a_time(spark):
    pages = [f"<title>t{i}</title><p>body {i}</p>" for i in range(150)] + [None]
    assert max(len(x) for x in files.parsed_parts(pa.array(pages))) <= files.PARSED_AT_ONCE
    got = files.extract_html(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")).orderBy("page_id").collect()
    assert [(r.title, r.author, r.site, r.body) for r in got] == [files.parse_html(x) for x in pages]
    assert files.extract_html(spark.createDataFrame([], "page_id int, html string")).count() == 0


def test_pairs_of_articles_are_not_joined(spark):
    """Articles meet by blocks; no join of the links has a row for each pair that shares a phrase."""
    rows = spark.createDataFrame([(i, "title", ["1", f"p{i % 3}"]) for i in range(12)], "id long, title string, phrases array<string>")
    links = dd.near_links(rows)
    assert "Join" not in plan_of(links) and links.count() == 12 * 11 // 2


def test_windows_around_mentions_are_the_regex(spark):
    """Keywords within reach of a mention, by places instead of a search from every character; so 200 long texts take no minute."""
    import re
    import time

    from marketloom.operators import scoring as sc
    from pyspark.sql import functions as F

    rng = random.Random(6)
    texts = ["".join(rng.choices(["one", "One ", " one ", "xone", " the ", "é", "\n", "𝄞", "ab ", "thing", "." * 30], k=rng.randrange(60))) for _ in range(300)] + [None, "", "one", "one one", "y" * 150 + " one"]

    def score(text, reach):
        low = (text or "").lower()
        hits = sum(k in w for w in re.findall(rf"(?s)(.{{0,{reach}}}\bone\b.{{0,{reach}}})", low) for k in ("the", "thing"))
        return min(1.0, min(1.0, len(re.findall(r"\bone\b", low)) * 0.3) + min(0.4, hits * 0.1))

    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for reach in (5, 20, 100):
        got = {r.id: r.s for r in rows.select("id", sc.term_relevance(F.col("text"), F.lit(""), "hand", "one", ["the", "thing"], reach).alias("s")).collect()}
        assert all(abs(got[i] - score(t, reach)) < 1e-9 for i, t in enumerate(texts))
    long = spark.range(200).select(F.repeat(F.lit("lorem ipsum dolor "), 8000).alias("text"))
    began = time.time()
    assert long.select(sc.term_relevance(F.col("text"), F.lit(""), "hand", "one", ["the"]).alias("s")).agg(F.max("s")).head()[0] == 0
    assert time.time() - began < 15


def test_members_of_clusters_are_shuffled_once(spark):
    """Counts of distinct publishers and sources do not multiply the members."""
    from marketloom.operators import articles as ar

    rows = [(1, "u", "p", "s", "T"), (1, "v", "q", "s", None), (1, "u", "p", None, "T"), (2, "u", None, None, "S")]
    out = ar.cluster_context(spark.createDataFrame(rows, "cluster long, url string, publisher string, source string, ticker string"))
    assert "Expand" not in plan_of(out)
    assert sorted(map(tuple, out.collect())) == [("u", 2, 1, ["S", "T"]), ("v", 2, 1, ["T"])]


def test_fuzzy_match_of_one_large_ticker_is_the_loop(spark, monkeypatch):
    """One ticker's titles meet in many blocks, each telling a few of the similar ones only; the matches are those of a plain loop."""
    import datetime
    import random

    from marketloom.operators import events as ev

    monkeypatch.setattr(ev, "BLOCK_TITLES", 7)
    monkeypatch.setattr(ev, "BEST", 2)
    rng = random.Random(4)
    bases = [[f"w{rng.randrange(60)}" for _ in range(9)] for _ in range(3)]

    def event(i):
        title = " ".join(w if rng.random() < 0.85 else f"w{rng.randrange(60)}" for w in bases[rng.randrange(3)])
        return (i, "big" if i % 9 else f"small{i % 5}", title, datetime.date(2024, 1, 1 + rng.randrange(28)), [rng.choice("ab")])

    current, prior = [event(i) for i in range(60)], [event(100 + i) for i in range(80)]
    prior += [(300 + i, *prior[i][1:]) for i in range(30)]
    want, free = [], {p[0]: p for p in prior}
    for i, ticker, title, day, meta in current:
        able = [(ev.title_similarity(title, p[2]), meta == p[4], -p[0]) for p in free.values() if p[1] == ticker and abs((p[3] - day).days) <= 9]
        best = max((a for a in able if a[0] >= ev.THRESHOLD), default=None)
        if best:
            want.append((i, -best[2], best[0]))
            del free[-best[2]]
    frame = lambda rows: spark.createDataFrame(rows, "id long, ticker string, title string, day date, meta array<string>")
    got = sorted(tuple(r) for r in ev.fuzzy_greedy_match(frame(current), frame(prior), lookback_days=9).collect())
    assert got == want and len(want) > 20
    assert ev.fuzzy_greedy_match(frame(current).limit(0), frame(prior)).count() == 0


def test_sequence_ratio_is_that_of_difflib():
    import difflib
    import random

    from marketloom.operators.dedup import sequence_ratio

    rng = random.Random(6)
    for k in range(3000):
        letters = ("ab", "abcdefgh ", "the and of ratio\u00e9\U0001f600")[k % 3]
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(67))) for _ in range(2))
        b = a[: rng.randrange(67)] + b[:9] + a[rng.randrange(67) :] if k % 2 else b
        assert sequence_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_copies_of_articles_are_counted_not_paired(spark, monkeypatch):
    """Equal articles are one class; what stays and how many each is linked to is that of all pairs, also where only the order of two ids makes a link."""
    rng = random.Random(8)
    titles = ["alpha beta gamma delta", "alpha beta gamma delto", "alpha beta gamme dolta", "quite another headline"]
    kinds = [(rng.choice(titles), rng.sample("abcdefghij", rng.randrange(5))) for _ in range(40)]
    rows = [(i, *kinds[rng.randrange(40)]) for i in rng.sample(range(1000), 150)]
    frame = spark.createDataFrame(rows, "id long, title string, phrases array<string>")
    pairs = [(r.later, r.earlier) for r in dd.near_links(frame).collect()]
    n_links, linked = {i: 0 for i, _, _ in rows}, {}
    for later, earlier in pairs:
        n_links[later] += 1
        n_links[earlier] += 1
        linked.setdefault(later, []).append(earlier)
    stayed, want = set(), {}
    for i in sorted(n_links):
        keepers = [j for j in linked.get(i, []) if j in stayed]
        want[i] = (not keepers, min(keepers, default=i), n_links[i])
        stayed |= {i} - ({i} if keepers else set())
    seen, sought = [], dd.near_links
    monkeypatch.setattr(dd, "near_links", lambda articles, *a, **b: seen.append(articles.count()) or sought(articles, *a, **b))
    assert {r.id: (r.kept, r.keep_id, r.n_links) for r in dd.near_kept(frame, degrees=True).collect()} == want
    assert {r.id: (r.kept, r.keep_id) for r in dd.near_kept(frame).collect()} == {i: w[:2] for i, w in want.items()}
    distinct = {(t, frozenset(p)) for _, t, p in rows if p}
    assert seen == [len(distinct)] * 2 and len(distinct) < len(rows) / 2
