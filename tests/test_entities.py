"""Companies in articles and weighted fingerprints against plain loops."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.functions import text as tx
from marketloom.operators import entities as en
from marketloom.operators import fingerprints as fp

DIRECTORY = [("AAPL", "Apple Inc.", "name"), ("AAPL", "apple", "alias"), ("AAPL", "AAPL", "symbol"), ("F", "Ford Motor Company", "name"), ("F", "F", "symbol"), ("NYT", "New York", "alias"), ("YN", "york new", "alias"), ("ALL", "Allstate", "name"), ("X", "--", "name"), ("BOTH", "apple", "name"), ("BOTH", "Apple", "alias")]
TEXTS = ["Apple inc and APPLE, apple-pie; f. pineapple", "new york new york new", None, "", "Ford  motor\ncompany f F f", "Alstate and Allstates grew", "Forde Motor Compny or Apples Inc", "é"]


def plain_words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).strip().split()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(row[j - 1], old[j])
    return row[-1]


def plain_ratio(a, b):
    best = 0.0
    for s, t in ((a, b), (b, a)):
        if s and len(s) <= len(t):
            for i in range(-len(s) + 1, len(t)):
                w = t[max(0, i) : i + len(s)]
                best = max(best, 200 * lcs(s, w) / (len(s) + len(w)))
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("abc d", max_size=9), st.text("abc d", max_size=14))
def test_partial_ratio(a, b):
    assert en.common_length(a, b) == lcs(a, b)
    want = plain_ratio(a, b)
    assert abs(en.partial_ratio(a, b) - want) < 1e-9
    assert abs(en.partial_ratio(a, b, 85) - (want if want >= 85 else 0)) < 1e-9


@pytest.fixture(scope="module")
def frames(spark):
    articles = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, name string")
    return articles, spark.createDataFrame(DIRECTORY, "ticker string, name string, kind string")


def plain_mentions():
    names, out = {}, {}
    for ticker, name, kind in DIRECTORY:
        key = (ticker, " ".join(plain_words(name)))
        if key[1]:
            names[key] = min(names.get(key, "z"), kind, key=["symbol", "name", "alias", "z"].index)
    for i, t in enumerate(TEXTS):
        words = plain_words(t)
        for (ticker, name), kind in names.items():
            said = name.split()
            places = [k + 1 for k in range(len(words)) if words[k : k + len(said)] == said]
            if places:
                out[i, ticker, name] = (kind, len(places), places[0])
    return out


@pytest.mark.parametrize("shard", [1 << 20, 24])
def test_mentions(frames, monkeypatch, shard):
    monkeypatch.setattr(en, "name_shards", lambda names, f=en.name_shards: f(names, shard))
    got = {(r.doc_id, r.ticker, r.name): (r.kind, r.n, r.first_at) for r in en.mentions(*frames[:1], "doc_id", "text", frames[1]).collect()}
    assert got == plain_mentions()
    assert en.mentions(frames[0].limit(0), "doc_id", "text", frames[1]).count() == 0
    assert en.mentions(frames[0], "doc_id", "text", frames[1].limit(0)).count() == 0


def test_no_similar_name_is_lost(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde ") for _ in range(rng.randrange(2, 12))).strip() or "ab"
    names = sorted({word() for _ in range(60)})
    spans = sorted({word() for _ in range(60)} | {n[:i] + rng.choice("xyz") + n[i + 1 :] for n in names for i in [rng.randrange(len(n))]})
    frame = lambda column, rows: spark.createDataFrame([(x,) for x in rows], f"{column} string")
    got = {(r.span, r["name"]): r.ratio for r in en.similar_names(frame("span", spans), frame("name", names)).collect()}
    want = {(s, n): plain_ratio(s, n) for s in spans for n in names if min(len(s), len(n)) > 1}
    assert set(got) == {k for k, x in want.items() if x >= 85} and len(got) > 100
    assert all(abs(want[k] - x) < 1e-9 for k, x in got.items())
    with pytest.raises(ValueError):
        en.similar_names(frame("span", spans), frame("name", names), 75)


def test_matches_join_exact_and_similar(frames):
    got = {(r.doc_id, r.ticker): (r.mention_count, r.confidence, r.kinds) for r in en.ticker_matches(frames[0], "doc_id", "text", frames[1]).collect()}
    assert got[0, "AAPL"][1:] == (1.0, ["alias", "name"]) and got[4, "F"] == (5, 1.0, ["name", "similar", "symbol"])
    assert got[5, "ALL"][2] == ["similar"] and got[5, "ALL"][0] == 2 and 0.85 <= got[5, "ALL"][1] <= 1


def test_headlines(spark):
    rows = [(1, "Apple", ["iPhone"], "AAPL", "iphones sell"), (2, "Apple", None, "AAPL", "Aple falls"), (3, "Apple", [], "AAPL", "banks rise"), (4, None, None, "GM", "gm rises"), (5, "Intel", [None], "INTC", None), (6, "Apple", None, "AAPL", "aapl up")]
    out = en.headline_matches(spark.createDataFrame(rows, "k int, name string, aliases array<string>, ticker string, headline string"), "name", "aliases", "ticker", "headline")
    assert {r.k: r.matched for r in out.collect()} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True}


def plain_print(text):
    bare = [re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in re.split(r"\s+", (text or "").lower())]
    words = [w for w in bare if re.fullmatch(r"[^\W_]+", w) and w not in tx.STOP_WORDS]
    weighted = [(w, 1) for w in words] + [("_".join(p), 1) for p in zip(words, words[1:])]
    weighted += [(f, 3 if any(t in f for t in fp.HEAVY_TERMS) else 1) for f in map("_".join, zip(words, words[1:], words[2:]))]
    votes = [0] * 64
    for f, w in weighted:
        h = int(hashlib.md5(f.encode()).hexdigest(), 16)
        for b in range(64):
            votes[b] += w if h >> b & 1 else -w
    value = sum(1 << b for b in range(64) if votes[b] > 0)
    return value - (1 << 64) if value >> 63 else value


def test_weighted_fingerprints(spark):
    texts = ["Quarterly earnings beat the market, as revenue grew.", "stock", "two words", "", None, "the of and", "x " * 500, "Émile's café-bar (new) opened; it's 5% up."]
    out = fp.weighted_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    assert {r.doc_id: r.fingerprint for r in out.collect()} == {i: plain_print(t) for i, t in enumerate(texts)}


def test_no_link_is_lost(spark):
    rng = random.Random(6)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    prints = {0} | set(seeds) | {s ^ sum(1 << b for b in rng.sample(range(64), k)) for s in seeds for k in (1, 2, 3, 4, 6)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    got = {(r.fp_a, r.fp_b, r.bits) for r in fp.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fingerprint long")).collect()}
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert got == {(a, b, bits(a, b)) for a in signed for b in signed if a < b and bits(a, b) <= 3} and len(got) > 100


def test_classes(spark):
    base = " ".join(f"word{i} earnings" for i in range(300))
    rows = [(5, base), (3, base + " more"), (9, base), (1, "something else entirely different"), (2, None), (4, "")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in fp.fingerprint_classes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got[5][0] == got[9][0] == got[3][0] == 3 and got[1] == (1, 0) and got[2] == got[4] == (2, 0)


def test_best_names_need_no_pairs(spark, monkeypatch):
    """The best of all names, ties by name, for spans of which most hold a name or are held by one; those are never scored."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcd ", k=rng.randrange(2, 12))).strip() or "ab"
    spans, names = sorted({word() for _ in range(250)} | {"é", "aaaaaaaaaa"}), sorted({word() for _ in range(40)} | {"aaaa", "x"})
    want = {}
    for s in spans:
        found = [(-en.partial_ratio(s, n, 85), n) for n in names if len(s) > 1 and len(n) > 1]
        best = min((f for f in found if f[0]), default=None)
        if best:
            want[s] = (best[1], -best[0])
    rows, listed = spark.createDataFrame([(s,) for s in spans], "span string"), spark.createDataFrame([(n,) for n in names], "name string")
    shards = en.name_shards
    for shard in (1 << 20, 100):
        monkeypatch.setattr(en, "name_shards", lambda df, most=shard, plain=shards: plain(df, most))
        got = {r.span: (r["name"], r.ratio) for r in en.best_names(rows, listed).collect()}
        assert got == want and any(r < 100 for _, r in got.values())
    calls, plain = [], en.partial_ratio
    monkeypatch.setattr(en, "partial_ratio", lambda *a: calls.append(1) or plain(*a))
    index = en.NameIndex([n for n in names if len(n) > 1], 85)
    assert all(index.best(s) == want.get(s) for s in spans if len(s) > 1) and len(calls) < len(spans) * len(names) / 10
