"""Exact duplicates by content-defined chunk recipes.

Every text is cut where a rolling hash of its bytes says so, so that equal
passages are cut alike wherever they stand. Only digests of the chunks leave
the task: a dictionary gives each distinct chunk an identifier, verified by
length and two independent strong digests, and texts are equal when their
ordered lists of identifiers are. Long documents are never moved.

Chunks that very many texts hold, and recipes of very many copies, are dealt
over many tasks where they are joined.

A null text is the empty one, whose recipe is the empty list. Repeated rows
(same id, same text) count one by one; the first of them stays at most. Rows
with a null id stay only if their group has no other id at all. Very long
texts are lists of many chunks of bounded size. Only the id and the text are
read, so other columns, whatever their names, do not matter; an empty table
has an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketloom.llm.common import join_groups, mix64, raw_rows, small_batches, staged, text_or_empty

#: Chunks have about AVERAGE bytes beyond LEAST, and MOST at most.
LEAST, AVERAGE, MOST = 512, 2048, 16384
WINDOW = 32
BLOCK = 1 << 20
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def cut_points(raw: bytes) -> list[int]:
    """Ends of the chunks of ``raw``; the last is its length."""
    codes, found = np.frombuffer(raw, np.uint8), []
    for low in range(0, len(raw), BLOCK):
        first = max(0, low - WINDOW + 1)
        h = _GEAR[codes[first : low + BLOCK]]
        step = 1
        while step < WINDOW:  # h[i] covers bytes i - 2 * step + 1 .. i
            more = h.copy()
            more[step:] += h[:-step] << np.uint32(step)
            h, step = more, step * 2
        found.append(np.flatnonzero((h[low - first :] >> np.uint32(32 - AVERAGE.bit_length() + 1)) == 0) + low + 1)
    ends, last = [], 0
    for at in (*np.concatenate(found).tolist(), len(raw)) if found else ():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST or at == len(raw) > last:
            ends.append(at)
            last = at
    return ends


def chunk_digests(text):
    """Column ``array<struct<sha, check, n>>`` of the chunks of a text column."""

    @F.arrow_udf("array<struct<sha:binary,check:binary,n:int>>")
    def chunks(column: pa.Array) -> pa.Array:
        count, sha, check, size = [0], [], [], []
        for raw in raw_rows(column):
            last = 0
            for end in cut_points(raw):
                piece = raw[last:end]
                sha.append(hashlib.sha256(piece).digest())
                check.append(hashlib.blake2b(piece, digest_size=16).digest())
                size.append(end - last)
                last = end
            count.append(len(sha))
        return pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.StructArray.from_arrays([pa.array(sha, pa.binary()), pa.array(check, pa.binary()), pa.array(size, pa.int32())], ["sha", "check", "n"]))

    return chunks(text_or_empty(text))


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(recipes, dictionary)`` of ``docs``.

    ``recipes``: ``id, text_sha256, n_rows, recipe``, a row for each distinct
    pair of id and text; ``recipe`` lists chunk identifiers in order.
    ``dictionary``: ``sha, check, n, n_uses, chunk_id``, a row for each chunk.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(F.encode(text_or_empty(text), "UTF-8"), 256).alias("text_sha256"), F.posexplode_outer(chunk_digests(text)).alias("pos", "chunk"))
    uses = staged(rows.select("id", "text_sha256", "pos", "chunk.sha", "chunk.check", "chunk.n"), "chunk-uses")
    key = ["sha", "check", "n"]
    # chunks that share the short hash, hardly ever more than one, are told apart by a number
    same = Window.partitionBy("short").orderBy(*key)
    dictionary = uses.where("sha is not null").groupBy(*key).agg(F.count("*").alias("n_uses")).withColumn("short", F.xxhash64(*key))
    dictionary = staged(dictionary.select(*key, "n_uses", F.struct("short", F.row_number().over(same).alias("nth")).alias("chunk_id")), "chunk-dictionary")
    own = ["id", "text_sha256", "pos"]
    named = join_groups(uses.where("sha is not null"), dictionary, key, "n_uses", own).select(*own, "chunk_id")
    empty = uses.where("sha is null").select(*own, F.lit(None).cast(dictionary.schema["chunk_id"].dataType).alias("chunk_id"))
    listed = F.array_sort(F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "chunk_id"))))
    recipes = named.union(empty).groupBy("id", "text_sha256").agg(F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("n_rows"), listed.alias("steps"))
    return recipes.select("id", "text_sha256", "n_rows", F.transform("steps", lambda x: x["chunk_id"]).alias("recipe")), dictionary


def recipe_groups(recipes: DataFrame) -> DataFrame:
    """``recipe_sha, keep_id, group_size, n_recipes`` of the equal recipes; lists filed under one digest are compared in full."""
    found = recipes.groupBy("recipe_sha").agg(F.max("id").alias("keep_id"), F.sum("n_rows").alias("group_size"), F.count("*").alias("n_recipes"), F.min("recipe").alias("low"), F.max("recipe").alias("high"))
    return found.where(F.when(F.col("low") == F.col("high"), True).otherwise(F.raise_error(F.concat(F.lit("unequal recipes of one digest: "), "recipe_sha")).cast("boolean"))).drop("low", "high")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)``, a row for each row of ``docs``.

    Of equal texts the row with the largest id stays. Groups are made by
    partial sums, so a text that a third of all rows share is no hot key.
    """
    recipes = chunk_recipes(docs, id_col, text)[0]
    listed = F.concat_ws(",", F.transform("recipe", lambda c: F.concat_ws(":", c["short"], c["nth"])))
    recipes = staged(recipes.withColumn("recipe_sha", F.sha2(listed, 256)), "recipes")
    groups = staged(recipe_groups(recipes), "recipe-groups")
    rows = join_groups(recipes.drop("recipe"), groups, ["recipe_sha"], "n_recipes", ["id", "text_sha256"])
    rows = rows.select("*", F.posexplode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int"))).alias("nth", "_"))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 0)
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")
