"""Quality rules against plain loops."""

from __future__ import annotations

import base64
import random
import re

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketloom.llm import quality, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    words = WORD.findall(text or "")
    runs, covered = {}, set()
    for i in range(len(words) - 4):
        runs.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in runs.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def plain_verdict(text):
    raw, n = (text or "").encode(), plain_measures(text)
    failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
    squeeze = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    low, high = 0.0, 99.0
    for size, *band in quality.BANDS:
        if len(raw) >= size:
            low, high = band
    chunks = [raw[i : i + quality.CHUNK] for i in range(0, len(raw), quality.CHUNK)]
    chunks = [c for c in chunks if len(c) == quality.CHUNK]
    outside = [c for c in chunks if not quality.CHUNK_BAND[0] <= len(squeeze(c)) / len(c) <= quality.CHUNK_BAND[1]]
    sound = len(raw) < quality.BANDS[0][0] or low <= len(squeeze(raw)) / len(raw) <= high and len(outside) <= quality.CHUNK_SHARE * len(chunks)
    return *n, failed, not failed and sound


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", " ", "  ", "\n", "\t", "#", "<>", "\x1c", " ", "日本"]), max_size=60).map("".join))
def test_measures_are_the_plain_loops(text):
    assert quality.word_measures(text.encode()) == plain_measures(text)


@pytest.mark.parametrize("window", [1, 2, 3, 4, 5, 7, 8])
def test_repeated_words_of_any_window(window):
    rng = random.Random(window)
    for _ in range(50):
        words = [rng.choice([b"x", b"y"]) for _ in range(rng.randrange(30))]
        runs = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
        covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(window)}
        assert quality.repeated_words(words, window) == len(covered)


def prose(n, seed):
    rng = random.Random(seed)
    syllables = ["re", "tion", "an", "the", "ing", "er", "ou", "la", "st", "ch", "en", "qu", "ed", "ver"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", ",", "."]) for _ in range(n))


def test_odd_texts(spark):
    noise = base64.b64encode(random.Random(1).randbytes(9000)).decode()
    texts = [None, "", " \n\t", "one two", prose(9, 1), prose(12, 2), prose(400, 3), prose(60_000, 4), "x" * 40_000, " ".join(["spam", "eggs", "ham"] * 900), " ".join(f"{i}" for i in range(9)) + " " + noise, prose(900, 5) + "\n" + noise, prose(100, 6) + "\n" + " ".join(f"{'ab' * 20}{i % 10}{i // 10 % 10}" for i in range(400)), prose(400, 3)]
    kind = "doc_id long, text string, id string, n_words string, kept int, ratio string"
    rows = [(None if i == 5 else i // 2, t, "clash", "clash", 1, "clash") for i, t in enumerate(texts)]
    got = sorted(tuple(r)[:8] for r in quality.judge(spark.createDataFrame(rows, kind).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))).collect())
    want = sorted((-1 if r[0] is None else r[0], *plain_verdict(r[1])) for r in rows)
    assert got == want
    by_text = {t: plain_verdict(t)[-1] for t in texts}
    assert by_text[prose(60_000, 4)] and by_text[prose(12, 2)] and not by_text[texts[-3]] and not by_text["x" * 40_000] and not by_text[texts[10]]
    assert quality.judge(spark.createDataFrame([], kind)).count() == 0
    assert quality.judge(spark.createDataFrame([(None, "no id")], "doc_id long, text string")).head().doc_id is None


def test_query_is_the_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in queries.op12_quality_rules(spark, SF).collect()}
    assert got == {r.doc_id: plain_verdict(r.text) for r in docs}
    # sound prose stays: of the documents labelled good whatever passes the word measures
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert all(v[6] for k, v in got.items() if k in good and not v[5])
