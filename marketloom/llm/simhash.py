"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each a word of the perfect
binary Golay code [23,12,7] (short ones padded with zeros). Every segment
decodes to one codeword index; the segments at distance one from it decode to
that index or to one of five others. At most three errors over three segments
leave one of two cases: some segment has none and another one at most, or all
have exactly one. So the keys are, for each ordered pair of segments, the one
as it is with the index of the other, and the indices of all three together.
A fingerprint is filed under its own keys and asks with all near indices;
keys of 33 to 36 bits keep chance meetings few, and the join verifies the
real distance. Distinct fingerprints stand for their documents throughout, so
copies cost nothing in the join, and links between fingerprints become
components.

Null texts and those without a word have fingerprint zero and link like any
other. Very long texts are hashed whole, block by block. Repeated rows and
ties share a fingerprint. Only the id and the text are read, so other columns
do not matter, whatever their names; an empty table has an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import join_groups, raw_rows, small_batches, staged, text_or_empty
from marketloom.llm.graph import connected_components

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the Golay code.
GOLAY = 0b101011100011
LENGTH, CHECK = 23, 11
#: Place and width of the three segments, and the pairs of an exact and a near one that are keys.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
MAX_BITS = 3
BLOCK = 1 << 16


def remainder(words: np.ndarray) -> np.ndarray:
    """The syndrome: each word modulo the generator polynomial over GF(2)."""
    words = words.astype(np.uint32)
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        words = np.where(words >> bit & 1, words ^ np.uint32(GOLAY << (bit - CHECK)), words)
    return words


@lru_cache(maxsize=1)
def near_errors() -> np.ndarray:
    """uint32[2048, 6]: per syndrome its error pattern, then the patterns of
    weight four that lead to the other codewords nearby (or the first again)."""
    rows: list[list[int]] = [[] for _ in range(1 << CHECK)]
    for weight in range(5):
        patterns = np.array([sum(1 << i for i in c) for c in combinations(range(LENGTH), weight)], np.uint32)
        for s, p in zip(remainder(patterns).tolist(), patterns.tolist()):
            if weight < 4 or rows[s][0].bit_count() == 3:
                rows[s].append(p)
    return np.array([r + [r[0]] * (6 - len(r)) for r in rows], np.uint32)


def near_indices(words: np.ndarray) -> np.ndarray:
    """uint32[n, 6]: the codeword index of each word, then those of its neighbours."""
    return (words.astype(np.uint32)[:, None] ^ near_errors()[remainder(words)]) >> CHECK


def segment(fp: np.ndarray, k: int) -> np.ndarray:
    at, width = SEGMENTS[k]
    return (fp >> np.uint64(at)) & np.uint64((1 << width) - 1)


def fingerprint_of(raw: bytes, shingle: int) -> int:
    """The SimHash of a UTF-8 text as an unsigned integer."""
    import xxhash

    words = raw.lower().split()  # of bytes: A-Z, and 0x20 and 0x09 to 0x0D, only
    if not words:
        return 0
    hash_, line = xxhash.xxh64_intdigest, b" ".join(words)
    votes, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    for low in range(0, n, BLOCK):
        h = np.array([hash_(line[a:b], 42) for a, b in zip(starts[low : min(n, low + BLOCK)].tolist(), last[low : low + BLOCK].tolist())], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text, shingle: int = 5):
    """Column of SimHash fingerprints (``long``) of a text column.

    A-Z are lower-cased; words are what ASCII white space separates; shingles
    of so many words count as often as they occur, a shorter text is one
    shingle. No words (also null): fingerprint zero.
    """

    @F.arrow_udf("long")
    def simhash(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(raw, shingle) for raw in raw_rows(column)], np.uint64).view(np.int64))

    return simhash(text_or_empty(text))


def _keys(fingerprints: DataFrame, probe: bool) -> DataFrame:
    """``fp, key``: the keys that each fingerprint is filed under, or those that it asks with."""

    def rows(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            own = [segment(fp, k).astype(np.int64) for k in range(3)]
            near = [near_indices(x).astype(np.int64) for x in own]
            # repeated indices of a segment stand for one
            new = [np.concatenate((np.ones((len(fp), 1), bool), x[:, 1:] != x[:, :1]), 1) for x in near]
            if not probe:
                near, new = [x[:, :1] for x in near], [x[:, :1] for x in new]
            x, y, z = near
            keys = [(x[:, :, None, None] << 24 | y[:, None, :, None] << 12 | z[:, None, None, :]).reshape(len(fp), -1)]
            real = [(new[0][:, :, None, None] & new[1][:, None, :, None] & new[2][:, None, None, :]).reshape(len(fp), -1)]
            for p, (i, j) in enumerate(PAIRS, 1):
                keys.append(p << 36 | own[i][:, None] << 12 | near[j])
                real.append(new[j])
            keys, real = np.concatenate(keys, 1), np.concatenate(real, 1)
            of, key = np.repeat(fp.view(np.int64), real.sum(1)), keys[real]
            for low in range(0, len(of), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array(of[low : low + BLOCK]), pa.array(key[low : low + BLOCK])], ["fp", "key"])

    return fingerprints.select("fp").mapInArrow(rows, "fp long, key long")


def near_pairs(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(fp_a, fp_b, bits)``: pairs of the distinct ``fp`` that differ in at most ``max_bits`` (3 at most), each once."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the code finds {MAX_BITS} differing bits at most")
    index, probe = _keys(fingerprints, False).alias("x"), _keys(fingerprints, True).alias("y")
    a, b = F.col("x.fp"), F.col("y.fp")
    bits = F.bit_count(a.bitwiseXOR(b))
    # each row makes many keys, which no estimate foresees: never broadcast
    met = index.hint("merge").join(probe, (F.col("x.key") == F.col("y.key")) & (a < b) & (bits <= max_bits))
    return met.select(a.alias("fp_a"), b.alias("fp_b"), bits.alias("bits")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, max_bits: int = MAX_BITS) -> DataFrame:
    """``(id, fp, component_id)``: a row for each row of ``docs``.

    Documents link when their fingerprints differ in at most ``max_bits``;
    ``component_id`` is the smallest id that a document reaches, itself
    included. Repeated ids share what the smallest of their fingerprints
    reaches only through their own; rows without an id link nothing and have
    no component of their own but that of their fingerprint.
    """
    small_batches(docs.sparkSession)
    prints = staged(docs.select(F.col(id_col).alias("id"), fingerprint(text, shingle).alias("fp")), "fingerprints")
    least = staged(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n_rows")), "distinct-fingerprints")
    # components are sought between distinct fingerprints, shifted to a dense order of no meaning
    links = near_pairs(least, max_bits).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    linked = connected_components(links)
    linked = staged(linked.join(least, linked.node == least.fp).select("node", "component", "first"), "linked-fingerprints")
    owner = staged(linked.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n_prints")), "components")
    owned = join_groups(linked, owner, ["component"], "n_prints", ["node"]).select(F.col("node").alias("fp"), "component_id")
    by_print = staged(least.join(owned, "fp", "left").select("fp", "n_rows", F.coalesce("component_id", "first").alias("component_id")), "print-components")
    return join_groups(prints, by_print, ["fp"], "n_rows", ["id"]).select(F.col("id").alias(id_col), "fp", "component_id")
