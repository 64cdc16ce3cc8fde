"""The training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketloom.llm import bpe, chat, common, decontam, exact_dedup, graph, langid, queries, simhash, substring_dedup, training_order, url_filter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, extra string"
ODD = [(1, None, "a"), (2, "", "b"), (3, "short", "c"), (4, " \t\n", "d"), (5, "short", None), (5, "short", None), (None, "no id at all", "e"), (7, "x" * 40_000, "f"), (8, "<|endoftext|> naïve 日本語 ok's\r\n\n end ", "g")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# BPE

PIECES = st.sampled_from(["'s", "'ll", "!'", " ", "  ", "\n", "\t", "\r\n", "a", "Hello", " world", "12", "3a", "é", "ß", "日本", "\u00a0", "\u200b", "<|endoftext|>", "<|end", "|>", ".", ",,", "_", "\x1f", "😀", "don't", "I'LL"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(PIECES, max_size=30).map("".join), st.text(max_size=60)))
def test_bpe_is_the_librarys(text):
    one = bpe.codec(queries.tokenizer_path())
    raw = text.encode("utf-8", "ignore")
    text = raw.decode()
    ids = np.frombuffer(one.encode(raw), np.int32).tolist()
    assert ids == one.tokenizer.encode(text, add_special_tokens=False).ids
    with pytest.MonkeyPatch.context() as m:  # cut at every certain place
        m.setattr(bpe, "FRAGMENT", 1)
        assert np.frombuffer(one.encode(raw), np.int32).tolist() == ids
    table = bpe.token_bytes(queries.tokenizer_path())
    assert b"".join(table[i] for i in ids).decode("utf-8", "replace") == one.tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_long_texts_cross_blocks(monkeypatch, tokenizer):
    monkeypatch.setattr(bpe, "FRAGMENT", 20)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    text = "Words, and more words'll be (cut) at 123 places.\n\n" * 40 + "z" * 300
    assert np.frombuffer(bpe.Codec(queries.tokenizer_path()).encode(text.encode()), np.int32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_columns(odd, nothing, tokenizer):
    path = queries.tokenizer_path()
    out = bpe.decode_documents(bpe.encode_documents(odd.withColumn("ids", F.lit("clash")), path), path).collect()
    assert len(out) == len(ODD)
    for r in out:
        assert r.ids == tokenizer.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert bpe.encode_documents(nothing, path).count() == 0


def test_bpe_on_the_table(spark, tokenizer):
    docs = {r.doc_id: r.text or "" for r in common.table(spark, SF, "documents").collect()}
    for r in queries.op5_bpe(spark, SF).collect():
        ids = tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# training order


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slots = training_order.feistel(np.arange(n), n, 5)
    assert sorted(slots.tolist()) == list(range(n))
    assert n < 7 or slots.tolist() != training_order.feistel(np.arange(n), n, 6).tolist()


def test_training_order_round_trip(odd, nothing, tokenizer):
    path = queries.tokenizer_path()
    sequences, size = training_order.place_sequences(odd, path, 9, seq_len=16)
    manifest = training_order.write_shards(sequences, size, len(bpe.token_bytes(path)), seq_len=16, shard_places=300)
    rows = training_order.read_shards(manifest).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert len({r.shard for r in rows}) > 2 and [r.shard for r in sorted(rows, key=lambda r: r.slot)] == sorted(r.shard for r in rows)
    got: dict = {}
    for r in sorted(rows, key=lambda r: r.seq_no):
        got.setdefault(r.id, []).extend(np.frombuffer(r.payload, "<u2").tolist())
        assert len(r.payload) == 2 * r.n_tokens
    for doc, text, _ in ODD:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert sorted(got.get(-1 if doc is None else doc, [])) == sorted(want * (2 if doc == 5 else 1))
    tail = training_order.read_shards(manifest, from_slot=150).collect()
    assert sorted(r.slot for r in tail) == list(range(150, len(rows)))
    empty = training_order.write_shards(*training_order.place_sequences(nothing, path, 9), 50257)
    assert empty.count() == 0 and training_order.read_shards(empty).count() == 0


# WARC


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nx", "same", "k"), (2, None, "same", None), (3, "u", None, None), (4, "u", "", None), (5, "ü", "é" * 9, None), (5, "ü", "é" * 9, None), (None, "u", "lost", None)], "page_id long, url string, html string, key string")
    archive = warc.write_archive(pages)
    assert spark.read.parquet(archive.payloads).count() == 4
    got = {(r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.describe_records(spark, archive).collect()}
    assert got == {(1, "response", None, 4), (2, "revisit", 1, 4), (3, "response", None, 0), (4, "revisit", 3, 0), (5, "response", None, 18), (None, "response", None, 4)}
    for r in warc.rebuild_records(spark, archive).collect():
        head, rest = bytes(r.record).split(b"\r\n\r\n", 1)
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert int(fields[b"Content-Length"]) == len(rest) - 4 and rest.endswith(b"\r\n\r\n")
        import base64

        assert fields[b"WARC-Payload-Digest"] == b"sha1:" + base64.b32encode(hashlib.sha1(r.payload).digest())
        if fields[b"WARC-Type"] == b"response":
            assert rest[:-4].endswith(bytes(r.payload))
    small = {(r.record_id, r.record_type) for r in warc.describe_records(spark, warc.write_archive(pages, min_revisit_bytes=5)).collect()}
    assert (2, "response") in small and (4, "response") in small
    assert warc.describe_records(spark, warc.write_archive(pages.limit(0))).count() == 0


# exact dedup


def test_cut_points_are_local():
    rng = random.Random(1)
    body = bytes(rng.randrange(256) for _ in range(60_000))
    ends = exact_dedup.cut_points(body)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(body) and sizes[:-1].min() >= exact_dedup.LEAST and sizes.max() <= exact_dedup.MOST
    shifted = exact_dedup.cut_points(b"some other start " + body)
    assert len({len(body) - e for e in ends} & {len(body) + 17 - e for e in shifted}) > len(ends) // 2
    assert exact_dedup.cut_points(b"") == [] and exact_dedup.cut_points(b"a" * 40_000)[-1] == 40_000


def test_exact_dedup_is_a_group_by(spark, nothing):
    rng = random.Random(2)
    long = ["".join(rng.choices("abc \n", k=n)) for n in (5000, 20_000)]
    rows = [*ODD, (10, long[0], ""), (11, long[0] + "x", ""), (12, long[1], ""), (13, long[0], ""), (14, None, "")]
    out = exact_dedup.exact_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    groups: dict = {}
    for doc, text, _ in rows:
        groups.setdefault(text or "", []).append(doc)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for r in out:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    for g in by_sha.values():
        assert sum(r.kept for r in out if by_sha[r.text_sha256] is g) == 1
    assert exact_dedup.exact_duplicates(nothing).count() == 0


# substring dedup


def brute_repeats(rows, window):
    seen: dict = {}
    for doc, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if doc is not None:
                seen[key] = min(seen.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and seen[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [400, 1])
def test_substring_dedup_is_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(substring_dedup, "SHARD_PASSAGES", limit)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    passages = [rng.choices(vocabulary, k=n) for n in (8, 12, 20, 45)]
    rows = []
    for doc in range(60):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choices(vocabulary, k=rng.randrange(12))
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 4)
            words += p[a : a + rng.randrange(4, 45)]
        rows.append((doc, " ".join(words)))
    rows += [(70, rows[3][1]), (71, rows[3][1]), (72, "a " * 300), (73, "a " * 200 + "b"), (None, rows[3][1]), (74, None), (75, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept_text", F.lit(1))
    got = rows_of(substring_dedup.remove_repeats(df, window=10), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == brute_repeats(rows, 10)


def test_substring_dedup_edges(odd, nothing):
    assert substring_dedup.remove_repeats(odd, window=50).count() == len(ODD)
    assert substring_dedup.remove_repeats(nothing).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=12), max_size=5), st.lists(st.sampled_from("ab"), min_size=4, max_size=12))
def test_automaton(known, text):
    automaton = substring_dedup.SuffixAutomaton()
    for i, x in enumerate(known):
        automaton.add(x, i)
    want = []
    for k in range(len(text) - 3):
        piece = text[k : k + 4]
        want.append(next((i for i, x in enumerate(known) if any(x[j : j + 4] == piece for j in range(len(x) - 3))), None))
    assert list(automaton.firsts(text, 4)) == want


# chat


def test_escape_round_trip(spark):
    texts = ["<|im_end|>", "<\\|x", "<\\\\|", "<", "|>", "<<|", "a\nb", "", None, "%0A\n%25"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u"), chat.unescaped_role(chat.escaped_role(F.col("t"))).alias("v")).collect():
        assert "<|" not in r.e and r.u == (r.t or "") and r.v == (r.t or "")


def test_reply_trees(spark):
    rng = random.Random(6)
    rows, parents = [], {}
    for tree in range(6):
        for node in range(rng.randrange(1, 40)):
            parent = rng.choice([None, *range(node)]) if node else None
            parents[tree, node * 7] = None if parent is None else parent * 7
            rows.append((tree, node * 7, parents[tree, node * 7], rng.choice(["user", "assistant", None]), rng.choice(["hi", None, "<|im_end|>\n"]), float(rng.randrange(4))))
    rows += [(9, 1, 2, "user", "cycle", 1.0), (9, 2, 1, "user", "cycle", 1.0), (None, 1, None, "user", "x", 1.0), (8, 5, 99, "user", "orphan", None), (8, 5, 99, "user", "orphan", None)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    by_node = {(r[0], r[1]): r for r in rows}
    children = {(r[0], r[2]) for r in rows if r[2] is not None}
    want = {}
    for (tree, node), r in by_node.items():
        if tree in (None, 9) or (tree, node) in children:
            continue
        path, at = [], node
        while at is not None:
            path.append(at)
            at = parents.get((tree, at))
        want.setdefault(tree, []).append((-sum(by_node[tree, n][5] or 0 for n in path), node, path[::-1]))
    got = chat.format_trees(df, top=2).select("*", chat.parse_formatted(F.col("formatted")).alias("turns")).collect()
    assert len(got) == sum(min(2, len(w)) for w in want.values())
    for r in got:
        score, leaf, path = sorted(want[r.tree])[r.rank - 1]
        assert (r.leaf, r.score, r.n_turns) == (leaf, -score, len(path))
        assert [(t.role, t.text) for t in r.turns] == [(by_node[r.tree, n][3] or "", by_node[r.tree, n][4] or "") for n in path]
    assert chat.format_trees(df.limit(0)).count() == 0


# language ID


def test_language_id_learns_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    langs = {r.doc_id: r.lang for r in common.table(spark, sf, "documents").collect()}
    rows = queries.op7_language_id(spark, sf).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und" and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.97


def test_language_id_edges(spark, odd, nothing):
    labelled = spark.createDataFrame([(1, "der und die das", "de"), (2, "the and of it", "en"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(labelled)
    assert model.languages == ["de", "en"]
    got = {(r.doc_id, r.text): r.lang_pred for r in langid.identify(odd.withColumn("score", F.lit(1)), model).collect()}
    assert got[1, None] == got[2, ""] == got[4, " \t\n"] == "und" and got[3, "short"] != "und"
    assert langid.identify(odd, langid.fit(labelled.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(nothing, model).count() == 0
    assert langid.bounded_sample(spark.range(20_000).withColumnRenamed("id", "doc_id"), "doc_id", 2000).count() < 2300


# URL filter


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("size", [1_000_000, 2])
def test_url_filter_is_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(url_filter, "RULES_PER_SHARD", size)
    rng = random.Random(8)
    urls = [None, "", "no scheme", "://", "http://", "https://A.Example.NET/en/x?q#f", "http://net", "http://example.com?x=/de/", "ftp://x.org/fr/", "a://b://example.net/en/", "http://É.net/", "http://.net/", "http://a\nb.net/x\ny"]
    urls += [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'X.y.'])}{rng.choice(['example.net', 'example.com', 'foo.org', 'net', 'notnet'])}{rng.choice(['', '/', '/en/', '/de/a', '/fr/?x', '#f'])}" for _ in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {i: brute_rule(u, queries.URL_RULES) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


# SimHash


def test_golay_neighbours_meet():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    for bit in (0, 7, 22):
        first, near = simhash.near_indices(words)[:, 0], simhash.near_indices(words ^ (1 << bit))
        assert (near == first[:, None]).any(1).all()


def test_near_pairs_are_brute_force(spark):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for fp in list(prints):
        for n in (1, 2, 3, 4):
            prints.add(fp ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    want = {tuple(sorted(x)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for x in [(a, b)]}
    assert len(got) == len(want) and {(r.fp_a, r.fp_b) for r in got} == want


def brute_print(text, n):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_are_brute_force(spark, odd, nothing):
    docs = common.table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {d: brute_print(t, 3) for d, t in texts.items()}
    component = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and component[b] < component[a]:
                    component[a], changed = component[b], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, SF).collect()}
    assert got == {d: (f"{prints[d]:016x}", component[d]) for d in prints}
    out = simhash.near_duplicates(odd, shingle=3).collect()
    assert len(out) == len(ODD) and {r.component_id for r in out if r.fp == 0} == {1}
    assert simhash.near_duplicates(nothing).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(50, 90), rng.randrange(50, 90)) for _ in range(30)] + [(95, 95)]
    component = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                component[a] = component[b] = min(component[a], component[b])
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == component and len(got) == len(component)


# decontamination


def test_alignment_is_smith_waterman():
    rng = random.Random(5)
    for _ in range(200):
        a, b = (np.array(rng.choices(range(4), k=rng.randrange(1, 9))) for _ in "ab")
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = max(0, table[i, j] + (decontam.MATCH if x == y else decontam.MISMATCH), table[i, j + 1] + decontam.GAP, table[i + 1, j] + decontam.GAP)
        score, first, last = decontam.align(a, b)
        assert score == table.max() and 0 <= first <= last <= len(b)
        assert score == 0 or (b[first] in a and b[last - 1] in a)


def test_decontamination(spark, odd, nothing):
    rng = random.Random(11)
    noise = lambda n: [f"n{rng.randrange(3000)}" for _ in range(n)]
    item = [f"q{i}" for i in range(40)]
    edited = [w for i, w in enumerate(item) if i % 9 != 4]
    edited[20] = "other"
    docs = [(1, " ".join(noise(60) + item + noise(60))), (2, ", ".join(noise(30) + edited + noise(30)).upper()), (3, " ".join(noise(200))), (4, None), (5, " ".join(noise(50) + item[:5] + noise(50))), (6, ""), (None, " ".join(item)), (2, "clean")]
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (7, " ".join(item))], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(df, benchmark).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7].score == 1 and got[1, 7].first_word == 60 and got[1, 7].n_words == 40
    assert {r.doc_id for r in decontam.drop_contaminated(df, benchmark).collect()} == {3, 4, 5, 6, None}
    assert decontam.contaminated(nothing, benchmark).count() == 0 and decontam.contaminated(odd, benchmark.limit(0)).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    docs, items = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    whole = rows_of(decontam.contaminated(docs, items), "doc_id", "item_id", "score")
    monkeypatch.setattr(decontam, "GRAMS_PER_PASS", 300)
    assert rows_of(decontam.contaminated(docs, items), "doc_id", "item_id", "score") == whole and whole


# SQL and the pipeline


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    from tests import oracle

    assert oracle.compare(queries.queries()[name](spark, SF), oracle.connect(SF), queries.oracle_sql()[name]) is None


def shingles_of(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_is_its_stages(spark, tokenizer):
    import corpus_pipeline

    docs = {r.doc_id: r.text for r in common.table(spark, SF, "documents").collect()}
    kept = {d: t for d, t in docs.items() if t and any(c.isalpha() for c in t)}
    last: dict = {}
    for d in sorted(kept):
        last[kept[d]] = d
    kept = {d: kept[d] for d in last.values()}
    sets = {d: shingles_of(t) for d, t in kept.items()}
    near = {a for a in sets for b in sets if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    frame = spark.createDataFrame([(d, t) for d, t in kept.items() if d not in near], "doc_id long, text string")
    leaks = {r.doc_id for r in decontam.contaminated(frame, common.table(spark, SF, "benchmark")).collect()}
    want = {d: t for d, t in kept.items() if d not in near | leaks}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    assert all(got[d] == tokenizer.encode(t, add_special_tokens=False).ids for d, t in want.items())


def test_exact_stage_keeps_repeated_rows_once(spark):
    import corpus_pipeline

    rows = [(1, "same"), (1, "same"), (2, "twice"), (2, "twice"), (3, "twice"), (4, "alone"), (4, "copied"), (5, "copied"), (None, "copied"), (None, "no id"), (None, "no id"), (6, None), (7, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.exact_dedup_stage(spark, docs, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    assert rows_of(got, "doc_id", "text") == sorted([(1, "same"), (3, "twice"), (4, "alone"), (5, "copied"), (None, "no id"), (7, "")], key=repr)


def test_decontamination_finds_items_however_often_they_leak(spark):
    rng = random.Random(12)
    noise = lambda n: [f"n{rng.randrange(3000)}" for _ in range(n)]
    item = [f"q{i}" for i in range(40)]
    edited = [w if i % 4 < 3 else f"x{i}" for i, w in enumerate(item)]
    docs = [(d, " ".join(noise(60) + (edited if d else item) + noise(60))) for d in range(101)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontam.contaminated(df, benchmark).collect()}
    assert got == {d: 0.6375 if d else 1.0 for d in range(101)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.lists(st.integers(0, 9), max_size=20))
def test_no_alignment_exceeds_its_bound(item, passage):
    a, b = np.array(item), np.array(passage, np.int64)
    assert decontam.align(a, b)[0] <= decontam.bound(a, b)


def test_language_stage_without_labels_passes_all(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words", None, "s", 1), (2, "123", None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert rows_of(corpus_pipeline.language_id(spark, docs, SF), "doc_id") == [(1,), (2,)]


def test_decontamination_by_one_seed_and_of_short_items(spark):
    item = [f"q{i}" for i in range(16)]
    edited = [w if c == "M" else f"x{i}" for i, (w, c) in enumerate(zip(item, "MMMxMMxMMxMMxMMx"))]
    docs = [(1, "a b " + " ".join(edited) + " c d"), (2, " ".join(item)), (3, "say Too, short here"), (4, "short too"), (5, "q0 q1 q3 q2"), (6, "lone")]
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, "Lone!"), (10, "..."), (11, None), (12, "too short")], "item_id long, text string")
    got = rows_of(decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark), "doc_id", "item_id", "score", "first_word", "n_words")
    assert got == sorted([(1, 7, (11 * 2 - 4) / 32, 2, 15), (2, 7, 1.0, 0, 16), (3, 8, 1.0, 1, 2), (3, 12, 1.0, 1, 2), (6, 9, 1.0, 0, 1)], key=repr)


def test_long_runs_are_encoded_at_once():
    """Text that the ranks can encode costs one call a run, and has the tokenizer's ids, next to runs they cannot encode too."""
    from tokenizers import Tokenizer

    from marketloom.llm import bpe

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    plain = " ".join(f"Wörter and words{i}'s, {i % 97}!\n" for i in range(4000))
    for text in (plain, plain + "日本 Ω" * 9 + plain, plain[:70_000] + "a" * 9000 + plain, "x", ""):
        one, calls = bpe.Codec(queries.tokenizer_path()), []
        encode = one._ids_of
        one._ids_of = lambda piece: calls.append(len(piece)) or encode(piece)
        assert np.frombuffer(one.encode(text.encode()), np.int32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        if text == plain:
            assert len(calls) <= len(text.encode()) // bpe.RUN + 1
