"""Structured Streaming over event envelopes.

Sources keep the driver's types; ``ts`` becomes a timestamp with time zone
only inside the stream. Every query takes a checkpoint, so it resumes where it
stopped and sinks see each row once.
"""

from __future__ import annotations


from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.staging import shared_path

PROPS = "k long"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a stream of files; a table of one file is picked by name."""
    path = f"{sf_dir}/events.parquet"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema)
    rows = stream.parquet(path) if folder else stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def read_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """Envelopes from a topic: key, JSON payload and the broker's time."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load()
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("payload"), F.col("timestamp").alias("ts"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Process all that is there, into parquet, and read it as a batch.

    With the ``path`` of an earlier run it goes on where that one stopped;
    without one it begins anew, in the shared folder.
    """
    spark, path = stream.sparkSession, path or shared_path(stream.sparkSession, name)
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def window_counts(events: DataFrame, delay: str = "10 minutes", size: str = "1 day") -> DataFrame:
    """Counts and sums of each type per window, once the watermark has closed it."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark; state is bounded by the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def parsed(events: DataFrame, payload: str = "props", schema: str = PROPS) -> DataFrame:
    """Events with their payload, and whether it has the schema's fields."""
    fields = T._parse_datatype_string(schema).fieldNames()
    body = F.from_json(payload, schema, {"mode": "PERMISSIVE"})
    there = F.lit(True)
    for f in fields:
        there = there & F.col("body")[f].isNotNull()
    return events.withColumn("body", body).withColumn("valid", F.coalesce(there, F.lit(False)))


def with_dead_letters(stream: DataFrame, name: str, accept: Column) -> tuple[DataFrame, DataFrame]:
    """(good, dead): rows by ``accept``, written by one query whose batches overwrite themselves when repeated."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, name)

    def store(batch: DataFrame, epoch: int) -> None:
        marked = batch.withColumn("dead", ~F.coalesce(accept, F.lit(False)))
        marked.write.mode("overwrite").partitionBy("dead").parquet(f"{path}/rows/epoch={epoch}")

    stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("epoch", T.IntegerType()), T.StructField("dead", T.BooleanType())])
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    return rows.where("not dead").drop("dead", "epoch"), rows.where("dead").drop("dead", "epoch")


def retry_delay(attempt: Column, cap: int = 60) -> Column:
    """Seconds before the next try: two to the attempt, capped."""
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(float(cap)))


def retry_state(failures: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Attempts so far, the next delay, and whether the event is a dead letter."""
    out = failures.groupBy(key).agg(F.count("*").alias("attempts"))
    return out.select(key, "attempts", F.when(F.col("attempts") <= most, retry_delay(F.col("attempts"))).alias("delay"), (F.col("attempts") > most).alias("dead"))


def replay(events: DataFrame, since: str) -> DataFrame:
    """Events from a time on, in order of time."""
    return events.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).orderBy("ts", "event_id")


def _last_state(spark: SparkSession, path: str) -> str | None:
    """The newest whole state table under ``path``."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state-*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    epochs = [int(x.getPath().getParent().getName().removeprefix("state-")) for x in found or ()]
    return f"{path}/state-{max(epochs)}" if epochs else None


def upsert_state(stream: DataFrame, name: str, merge: Callable[[DataFrame, DataFrame], DataFrame], schema: str, path: str | None = None) -> DataFrame:
    """Fold each batch into a table by ``merge(state, batch)``; a table per epoch, the newest one is the state.

    With the ``path`` of an earlier run it goes on from that run's state. An
    epoch that is run again starts from the table of the epoch before it.
    """
    spark, path = stream.sparkSession, path or shared_path(stream.sparkSession, name)

    def fold(batch: DataFrame, epoch: int) -> None:
        state = spark.read.schema(schema).parquet(f"{path}/state-{epoch - 1}") if epoch else spark.createDataFrame([], schema)
        merge(state, batch).write.mode("overwrite").parquet(f"{path}/state-{epoch}")

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = _last_state(spark, path)
    return spark.read.schema(schema).parquet(last) if last else spark.createDataFrame([], schema)
