"""Shared helpers: the folder all executors see, staged tables, Arrow text."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode and where none is set (tests)."""
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='marketloom-')}"
        spark.conf.set(CHECKPOINT_DIR, root)
        spark.sparkContext.setCheckpointDir(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString().replace("file:/", "file:///").replace("file://///", "file:///")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that go to Python at once at most; whole texts are long.
BATCH_ROWS = 512
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that Python tasks get in this session."""
    if int(spark.conf.get(BATCH_CONF)) > BATCH_ROWS or int(spark.conf.get(BATCH_CONF)) <= 0:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


#: Keys with more than one in so many of all rows are hot; there are at most so many of them.
HOT_PARTS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: list[str], total: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with the one row that ``groups`` has for each key, hot keys dealt over many tasks.

    ``size`` is the column of ``groups`` that tells how many of the rows have
    the key. Only the keys and sizes of hot ones are broadcast, HOT_PARTS at
    most; their groups are repeated once for each part, and a hash of the
    ``spread`` columns tells a row's part, so that a lost task comes out the
    same again. ``total`` is the number of rows, if it is known. Groups are
    read more than once (``sizes``, if given, instead of them where only keys
    and sizes matter): stage them. Keys must not be null.
    """
    sizes = groups if sizes is None else sizes
    total = total if total is not None else sizes.agg(F.sum(size)).head()[0] or 0
    limit = max(1, total // HOT_PARTS)
    hot = F.broadcast(sizes.where(F.col(size) > limit).select(*keys, F.ceil(F.col(size) / limit).alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("__part", F.when(parts == 1, 0).otherwise(F.pmod(F.xxhash64(*spread), parts))).drop("__parts")
    copies = groups.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).drop("__parts")
    return dealt.join(copies, [*keys, "__part"]).drop("__part")


def text_or_empty(column) -> F.Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def raw_rows(column: pa.Array):
    """The UTF-8 bytes of each value of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15


def word_ids(words: list[bytes]) -> np.ndarray:
    """The 64-bit hash of each word."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` ids, by doubling."""
    if len(ids) < k:
        return np.zeros(0, np.uint64)
    out, done, power, size = np.zeros(len(ids) + 1, np.uint64), 0, ids, 1
    while size <= k:
        if k & size:
            n = len(ids) - done - size + 1
            out, done = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + power[done : done + n], done + size
        if size * 2 <= k:
            power = power[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + power[size:]
        size *= 2
    return mix64(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by doubling."""
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
