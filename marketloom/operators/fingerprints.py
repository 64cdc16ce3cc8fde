"""Weighted SimHash of articles: votes in JVM expressions, links by exact blocks of bits."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import text as tx
from marketloom.operators.articles import has_any, listed
from marketloom.operators.graph import components
from marketloom.staging import staged

# Terms that make a run of three words weigh three times as much, and the bits that may differ.
HEAVY_TERMS, HEAVY_WEIGHT = ["earnings", "revenue", "profit", "stock", "market"], 3
MAX_BITS = 3
#: Three differing bits leave at least three of six blocks equal: keys of three blocks each lose no link, and have 31 to 33 bits.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def feature_words(text) -> Column:
    """Lower-case words of letters and digits only, without stop words; punctuation around a word is not part of it."""
    bare = F.transform(F.split(F.lower(F.coalesce(tx.col(text), F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda w: w.rlike(r"^[\p{L}\p{N}]+$") & ~F.array_contains(listed(tx.STOP_WORDS), w))


def features(words: Column) -> Column:
    """``array<struct<feature, weight>>``: words, and runs of two and three of them, as often as they occur."""
    n = F.size(words)
    run = lambda k: F.transform(F.slice(words, 1, F.greatest(n - k + 1, F.lit(0))), lambda w, i: F.concat_ws("_", w, *(F.get(words, i + j) for j in range(1, k))))
    light = lambda f: F.struct(f.alias("feature"), F.lit(1).alias("weight"))
    heavy = lambda f: F.struct(f.alias("feature"), F.when(has_any(f, HEAVY_TERMS), HEAVY_WEIGHT).otherwise(1).alias("weight"))
    return F.concat(F.transform(words, light), F.transform(run(2), light), F.transform(run(3), heavy))


def weighted_fingerprints(articles: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, fingerprint`` (long): a bit is set where the weights of features whose hash has it exceed the others'.

    The hash is the last 64 bits of the md5. The votes are 32 sums of two bits each that tasks
    add up before they shuffle, so a very long text is no burden, and a text
    costs its words once. No feature (also a null text): fingerprint zero. Rows that
    share an id vote together.
    """
    words = articles.select(F.col(id_col).alias("id"), feature_words(text).alias("words"))
    rows = words.select("id", F.explode_outer(features(F.col("words"))).alias("x")).select("id", "x.weight", F.conv(F.substring(F.md5("x.feature"), 17, 16), 16, -10).cast("long").alias("h"))
    # two counts a sum, of a bit and of the one 32 places on: a text has fewer than two billion features
    both = F.lit(1 << 32 | 1).cast("long")
    votes = rows.groupBy("id").agg(F.sum("weight").alias("n"), *(F.sum(F.col("weight") * F.shiftrightunsigned("h", b).bitwiseAND(both)).alias(f"v{b}") for b in range(32)))
    for_bit = lambda b: F.col(f"v{b}").bitwiseAND(F.lit((1 << 32) - 1).cast("long")) if b < 32 else F.shiftrightunsigned(f"v{b - 32}", 32)
    signed = lambda b: (1 << b) if b < 63 else -(1 << 63)
    return votes.select(F.col("id").alias(id_col), reduce(add, (F.when(2 * for_bit(b) > F.col("n"), F.lit(signed(b)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64))).alias("fingerprint"))


def block_keys(fp: Column) -> Column:
    """``array<struct<which, key>>``: a fingerprint's blocks, three at a time."""
    block = lambda at, width: F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    out = []
    for which, chosen in enumerate(combinations(BLOCKS, 3)):
        key = F.lit(0).cast("long")
        for at, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(block(at, width))
        out.append(F.struct(F.lit(which).alias("which"), key.alias("key")))
    return F.array(*out)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """``fp_a, fp_b, bits``: pairs of distinct fingerprints that differ in ``MAX_BITS`` at most, each once.

    Keys are merged: twenty a fingerprint look as small as the file they come from, and would be broadcast.
    """
    distinct = staged(prints.select(F.col("fingerprint").alias("fp")).distinct(), "prints")
    keyed = distinct.select("fp", F.inline(block_keys(F.col("fp"))))
    a, b = keyed.withColumnRenamed("fp", "fp_a"), keyed.withColumnRenamed("fp", "fp_b")
    bits = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b")))
    return a.join(b.hint("merge"), ["which", "key"]).where(F.col("fp_a") < F.col("fp_b")).select("fp_a", "fp_b", bits.alias("bits")).where(F.col("bits") <= MAX_BITS).distinct()


def fingerprint_classes(articles: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, fingerprint, class_id, n_links``: the least id that an article reaches over links of fingerprints, and to how many other fingerprints its own is linked."""
    prints = staged(weighted_fingerprints(articles, id_col, text), "fingerprints")
    first = staged(prints.groupBy("fingerprint").agg(F.min(id_col).alias("first")), "first-ids")
    links = staged(fingerprint_links(first), "links")
    ends = links.join(first.select(F.col("fingerprint").alias("fp_a"), F.col("first").alias("a")), "fp_a").join(first.select(F.col("fingerprint").alias("fp_b"), F.col("first").alias("b")), "fp_b")
    degree = ends.select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").agg(F.count("*").alias("n_links"))
    found = components(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).withColumnRenamed("node", "first")
    group = first.join(found, "first", "left").join(degree, "first", "left").select("fingerprint", F.coalesce("component", "first").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return prints.join(group, "fingerprint").select(id_col, "fingerprint", "class_id", "n_links")
