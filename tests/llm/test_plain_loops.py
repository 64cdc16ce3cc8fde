"""Training order, language ID and decontamination against plain loops."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from marketloom.llm import bpe, common, decontam, langid, queries, training_order

SF = "/root/testdata/sf0.001"


def test_slots_do_not_depend_on_files(spark, tmp_path):
    """The same table in 3 and in 30 files gives the slots that a plain loop gives."""
    path = queries.tokenizer_path()
    docs = common.table(spark, SF, "documents").select("doc_id", "text", F.lit("clash").alias("place"), F.lit(1).alias("id"))
    domain, bits, most = training_order.domain_of(docs, seq_len=64)
    one, want = bpe.codec(path), []
    for r in docs.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h")).collect():
        ids = np.frombuffer(one.encode((r.text or "").encode()), np.int32).tolist()
        number = (r.h & (1 << 64) - 1) >> (64 - bits)
        for no in range(-(-len(ids) // 64)):
            place = int(training_order.feistel(np.array([number * most + no]), domain.size, 5)[0])
            want.append((place, r.doc_id, no, ids[64 * no : 64 * no + 64]))
    want = [(slot, *x[1:]) for slot, x in enumerate(sorted(want))]
    for files in (3, 30):
        docs.repartition(files).write.parquet(f"{tmp_path}/{files}")
        sequences, size = training_order.place_sequences(spark.read.parquet(f"{tmp_path}/{files}"), path, 5, seq_len=64)
        rows = training_order.read_shards(training_order.write_shards(sequences, size, 50257, seq_len=64, shard_places=2000)).collect()
        assert sorted((r.slot, r.id, r.seq_no, np.frombuffer(r.payload, "<u2").tolist()) for r in rows) == want


def test_null_and_negative_ids_stay_apart(spark):
    docs = spark.createDataFrame([(None, "a text"), (-1, "a text"), (-1, "a text")], "doc_id long, text string")
    rows = training_order.read_shards(training_order.write_shards(*training_order.place_sequences(docs, queries.tokenizer_path(), 1), 50257)).collect()
    assert sorted(r.has_id for r in rows) == [False, True, True] and {r.id for r in rows} == {-1}


def test_language_id_is_naive_bayes(spark):
    docs = common.table(spark, SF, "documents")
    model, sums, n_docs = langid.fit(docs), {}, {}
    rows = docs.collect()
    for r in rows:
        if r.lang is not None and r.text is not None:
            own = sums.setdefault(r.lang, [0.5] * (1 << langid.BUCKET_BITS))
            n_docs[r.lang] = n_docs.get(r.lang, 0) + 1
            for h in langid.gram_buckets(r.text):
                for b in h.tolist():
                    own[b] += 1
    names = sorted(sums)
    logs = {x: np.log(np.array(sums[x]) / sum(sums[x])) for x in names}
    got = {(r.doc_id): (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    for r in rows:
        grams = [b for h in langid.gram_buckets(r.text or "") for b in h.tolist()]
        if not grams:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        total = [math.log(n_docs[x] / sum(n_docs.values())) + logs[x][grams].sum() for x in names]
        best = int(np.argmax(total))
        score = 1 / sum(math.exp((t - total[best]) * min(1, langid.SCORE_GRAMS / len(grams))) for t in total)
        assert got[r.doc_id][0] == names[best] and abs(got[r.doc_id][1] - score) < 1e-3


def test_decontamination_is_all_pairs(spark):
    """Every document is aligned with every item; a pair is missed only if no gram is left, which no pair of this table is."""
    docs = {r.doc_id: r.text or "" for r in common.table(spark, SF, "documents").collect()}
    items = {r.item_id: r.text or "" for r in common.table(spark, SF, "benchmark").collect()}
    words = {k: decontam.words_of(t.lower().encode()) for k, t in items.items()}
    want = {}
    for d, text in docs.items():
        ids = decontam.words_of(text.lower().encode())
        for k, w in words.items():
            if len(w) and decontam.bound(w, ids) >= decontam.THRESHOLD * decontam.MATCH * len(w):
                score = decontam.align(w, ids)[0] / (decontam.MATCH * len(w))
                if score >= decontam.THRESHOLD:
                    want[d, k] = round(score, 6)
    got = {(r.doc_id, r.item_id): r.score for r in queries.op10_decontamination(spark, SF).collect()}
    assert got == want


def test_rare_words_lose_no_leak(spark):
    """Rare words of random items: whatever share of an item is left, in any order of frequency, one of its rare words is."""
    rng = np.random.default_rng(7)
    for _ in range(200):
        sizes = rng.integers(0, 12, 6)
        words, ends = rng.integers(0, 9, sizes.sum()).astype(np.uint64), np.concatenate(([0], np.cumsum(sizes)))
        threshold = float(rng.choice([0.3, 0.5, 0.8, 1.0]))
        word, item = decontam.rare_words(words, ends, rng.integers(0, 3, len(words)), threshold)
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            if b > a:
                left = rng.permutation(words[a:b])[: max(1, math.ceil(threshold * (b - a) - 1e-9))]
                assert set(left.tolist()) & set(word[item == k].tolist())


def test_a_common_stem_starts_nothing(spark):
    """Items with one stem: a text with the stem alone looks at none of them, a copy only at its own."""
    stem = "which of the following is true about"
    items = [(k, f"{stem} " + " ".join(f"q{k}x{i}" for i in range(12))) for k in range(300)]
    docs = [(d, f"{stem} something else number {d}") for d in range(50)] + [(99, "so " + items[7][1])]
    benchmark, frame = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r.doc_id, r.item_id, r.score) for r in decontam.contaminated(frame, benchmark).collect()]
    assert got == [(99, 7, 1.0)]
    ids = [decontam.words_of(t.encode()) for _, t in docs]
    table = benchmark.select(F.col("item_id").alias("item"), decontam.tokenised(benchmark).alias("words"))
    counts = decontam.word_frequencies(frame, np.unique(np.concatenate([decontam.words_of(t.encode()) for _, t in items])))
    assert dict(zip(*(x.tolist() for x in counts)))[int(decontam.words_of(b"following")[0])] == 51
    index = decontam.index_of(table, 3, decontam.THRESHOLD, counts)
    marks = np.full(len(index.grams), -1, np.int32)
    assert all(not len(decontam.seeds(index, x, 3, marks)[0]) for x in ids[:-1]) and (marks == -1).all()
    assert set(decontam.seeds(index, ids[-1], 3, marks)[0].tolist()) == {7}
