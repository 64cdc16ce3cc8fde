"""Each stage of the corpus pipeline on odd tables, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marketloom.llm import queries

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept int, component_id int, lang_pred int, score int, item_id int"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
ODD = [(1, "the same words here"), (1, "the same words here"), (2, "the same words here"), (3, None), (4, ""), (5, " \t\n"), (6, "12 34"), (None, "no id but letters"), (None, "no id but letters"), (7, LONG), (8, LONG + " x"), (9, "one text"), (9, "another text of this id"), (10, "one text"), (None, None)]


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def columns():
    import corpus_pipeline

    return corpus_pipeline.COLUMNS


def frame(spark, rows, lang="en"):
    return spark.createDataFrame([(d, t, lang if i % 2 else None, None, None, "clash", 1, 2, 3, 4, 5) for i, (d, t) in enumerate(rows)], KIND)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_language_stage(spark, stages, columns):
    out = stages["language ID"](spark, frame(spark, ODD), SF)
    assert out.columns == columns
    assert pairs(out) == sorted([(d, t) for d, t in ODD if t and any(c.isalpha() for c in t)], key=repr)
    assert stages["language ID"](spark, frame(spark, ODD).limit(0), SF).count() == 0


def test_exact_stage(spark, stages, columns):
    out = stages["exact dedup"](spark, frame(spark, ODD), SF)
    best = {}
    for d, t in ODD:
        best[t or ""] = max(best.get(t or "", -1), -1 if d is None else d)
    assert out.columns == columns
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in out.collect()), key=repr) == sorted(((d, t) for t, d in best.items()), key=repr)
    assert stages["exact dedup"](spark, frame(spark, ODD).limit(0), SF).count() == 0


def shingles_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_stage(spark, stages, columns):
    rng = random.Random(3)
    words = [f"w{rng.randrange(900)}" for _ in range(3000)]
    edited = [w if i % 60 else f"other{i}" for i, w in enumerate(words)]
    rows = [*ODD, (20, " ".join(words)), (19, " ".join(edited)), (None, " ".join(words)), (21, "one text"), (9, "one text")]
    order = lambda r: (r[0] is None, r[0] or 0)
    sets = {t or "": shingles_of(t) for _, t in rows}
    component = {t: t for t in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    component[a] = component[b] = min(component[a], component[b])
    groups: dict = {}
    for r in rows:
        groups.setdefault(component[r[1] or ""], []).append(r)
    out = stages["SimHash near-dedup"](spark, frame(spark, rows), SF)
    got = out.collect()
    assert out.columns == columns and len(got) == len(groups)
    for r in got:
        group = groups[component[r.text or ""]]
        assert order((r.doc_id,)) == min(order(x) for x in group) and (r.doc_id, r.text or "") in {(d, t or "") for d, t in group}
    assert stages["SimHash near-dedup"](spark, frame(spark, rows).limit(0), SF).count() == 0


def test_near_stage_links_near_fingerprints(spark, stages):
    """Two edits in sixty words leave less than 0.8 of five-word shingles; the fingerprints may still be near."""
    from marketloom.llm.simhash import fingerprint_of

    rng = random.Random(5)
    bits = lambda a, b: (fingerprint_of(a.encode(), 3) ^ fingerprint_of(b.encode(), 3)).bit_count()
    likeness = lambda a, b: len(shingles_of(a) & shingles_of(b)) / len(shingles_of(a) | shingles_of(b))
    rows, found = [], 0
    while found < 4:
        words = [f"w{rng.randrange(900)}" for _ in range(60)]
        a, b = " ".join(words), " ".join(w if i not in (20, 40) else f"other{i}" for i, w in enumerate(words))
        near = bits(a, b) <= 3
        if near or not rows:
            assert likeness(a, b) < 0.8
            rows += [(len(rows), a), (len(rows) + 1, b)]
            found += near
    out = {r.doc_id for r in stages["SimHash near-dedup"](spark, frame(spark, rows), SF).collect()}
    assert out == {i for i, (_, t) in enumerate(rows) if i % 2 == 0 or bits(rows[i - 1][1], t) > 3}


def test_decontamination_stage(spark, stages, columns):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where(F.length("text") > 40).orderBy("item_id").head()
    leak = f"before it, {item.text} and after"
    rows = [*ODD, (30, leak), (30, "nothing of the kind"), (None, leak.upper()), (31, leak), (31, leak)]
    out = stages["benchmark decontamination"](spark, frame(spark, rows), SF)
    assert out.columns == columns
    assert pairs(out) == sorted([(d, t) for d, t in rows if not t or item.text.lower() not in t.lower()], key=repr)
    assert stages["benchmark decontamination"](spark, frame(spark, rows).limit(0), SF).count() == 0


def test_bpe_stage(spark, stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    got = sorted(((r.doc_id, r.ids) for r in stages["BPE encoding and decoding"](spark, frame(spark, ODD), SF).collect()), key=repr)
    assert got == sorted(((d, tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in ODD), key=repr)
    assert stages["BPE encoding and decoding"](spark, frame(spark, ODD).limit(0), SF).count() == 0
