"""Keyed state with timers: redelivery, cooldown and alert states; and a near-duplicate index that grows by batch.

The processors give the same rows however a stream is cut into batches, as long
as the rows of a key come in the order of time: what a timer would have done
before a row is done when the row comes, and the timer does it where none
comes. State of a key ends with its timer, so it is bounded by the keys that
were active within the delay. All times are event times; a stream needs a
watermark, which ``keyed`` sets. The session's state store must be RocksDB
(``use_timers``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from marketloom.operators.dedup import kept_in_order
from marketloom.operators.fingerprints import MAX_BITS, block_keys
from marketloom.staging import shared_path, staged

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND, DAY = 1_000_000, 86_400_000_000
# Tries of an event, its longest delay in seconds, minutes of a cooldown, and days that an alert is kept.
MAX_RETRIES, MAX_DELAY, COOLDOWN_MINUTES, ALERT_DAYS = 3, 60, 60, 7


def use_timers(spark: SparkSession) -> None:
    """Timers need the RocksDB state store; the session's later streams use it too."""
    spark.conf.set(STORE, ROCKSDB)


def micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def moment(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


class Timed(StatefulProcessor):
    """One value a key, and one timer: ``due`` tells when it ends, ``row`` and ``ended`` what happens then.

    ``row(key, value, ts, row)`` and ``ended(key, value)`` return the new value
    (None: no state) and the rows to emit.
    """

    KIND: str
    COLUMNS: list[str]
    ORDER: list[str]

    def init(self, handle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", self.KIND)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = pd.concat([b for b in rows if len(b)]).sort_values(self.ORDER)
        value, out = tuple(self.value.get()) if self.value.exists() else None, []
        for ts, row in zip(micros(found["ts"]), found.itertuples(index=False)):
            while value is not None and self.due(value) <= ts:
                value, more = self.ended(key, value)
                out += more
            value, more = self.row(key, value, ts, row)
            out += more
        self._keep(value)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        value, out = tuple(self.value.get()) if self.value.exists() else None, []
        while value is not None and self.due(value) <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            value, more = self.ended(key, value)
            out += more
        self._keep(value)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def _keep(self, value) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if value is None:
            self.value.clear()
        else:
            self.value.update(value)
            self.handle.registerTimer(-(-self.due(value) // 1000))

    def close(self) -> None:
        pass


class Redelivery(Timed):
    """Attempts at an event: a failure waits for two to the number of failures, in seconds and capped, and is then delivered again; the last one is a dead letter, a success ends it.

    After a redelivery the event is forgotten if nothing is heard of it for ``forget`` seconds.
    """

    KIND = "attempts int, failed long, waiting boolean"
    COLUMNS, ORDER = ["key", "action", "attempts", "at"], ["ts", "event_id"]
    SCHEMA = "key {key}, action string, attempts int, at timestamp"

    def __init__(self, most: int = MAX_RETRIES, cap: int = MAX_DELAY, forget: int = 86_400) -> None:
        self.most, self.cap, self.forget = most, cap, forget

    def delay(self, attempts: int) -> int:
        return min(2**attempts, self.cap) * SECOND

    def due(self, value) -> int:
        attempts, failed, waiting = value
        return failed + self.delay(attempts) + (0 if waiting else self.forget * SECOND)

    def row(self, key, value, ts, row):
        if not row.failed:
            return None, []
        attempts = (value[0] if value else 0) + 1
        if attempts >= self.most:
            return None, [(key[0], "dead", attempts, moment(ts))]
        return (attempts, ts, True), []

    def ended(self, key, value):
        attempts, failed, waiting = value
        if not waiting:
            return None, []
        return (attempts, failed, False), [(key[0], "retry", attempts, moment(failed + self.delay(attempts)))]


class Cooldown(Timed):
    """Passes an alert unless another of its key passed less than so many minutes ago."""

    KIND = "last long"
    COLUMNS, ORDER = ["key", "event_id", "ts"], ["ts", "event_id"]
    SCHEMA = "key {key}, event_id long, ts timestamp"

    def __init__(self, minutes: int = COOLDOWN_MINUTES) -> None:
        self.wait = minutes * 60 * SECOND

    def due(self, value) -> int:
        return value[0] + self.wait

    def row(self, key, value, ts, row):
        return (value, []) if value is not None else ((ts,), [(key[0], row.event_id, moment(ts))])

    def ended(self, key, value):
        return None, []


class AlertStates(Timed):
    """The states of an alert: opened by a bad row, suppressed while it is open, resolved by a good one, expired when no bad one comes for so many days."""

    KIND = "opened long, seen long, n long"
    COLUMNS, ORDER = ["key", "state", "opened", "at", "n"], ["ts", "event_id"]
    SCHEMA = "key {key}, state string, opened timestamp, at timestamp, n long"

    def __init__(self, days: float = ALERT_DAYS) -> None:
        self.keep = int(days * DAY)

    def due(self, value) -> int:
        return value[1] + self.keep

    def row(self, key, value, ts, row):
        if value is None:
            return ((ts, ts, 1), [(key[0], "opened", moment(ts), moment(ts), 1)]) if row.bad else (None, [])
        opened, _, n = value
        return ((opened, ts, n + 1), []) if row.bad else (None, [(key[0], "resolved", moment(opened), moment(ts), n)])

    def ended(self, key, value):
        opened, _, n = value
        return None, [(key[0], "expired", moment(opened), moment(self.due(value)), n)]


def keyed(stream: DataFrame, key: str, processor: Timed, delay: str = "10 minutes") -> DataFrame:
    """``stream`` (``ts``, ``event_id`` and what the processor reads) through a processor, by ``key``."""
    use_timers(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    return stream.withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(processor, processor.SCHEMA.format(key=kind), "append", "eventTime")


_MARKED = "id long, ts timestamp, fp long, keep_id long"


def _linked(later: DataFrame, earlier: DataFrame, within: bool) -> DataFrame:
    """``later, earlier``: ids whose fingerprints differ in MAX_BITS at most."""
    a = later.select(F.col("id").alias("later"), F.col("fp").alias("f"), F.inline(block_keys(F.col("fp"))))
    b = earlier.select(F.col("id").alias("earlier"), F.col("fp").alias("g"), F.inline(block_keys(F.col("fp"))))
    met = a.join(b, ["which", "key"]).where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= MAX_BITS)
    return (met.where("later > earlier") if within else met).select("later", "earlier").distinct()


def mark_batch(batch: DataFrame, known: DataFrame) -> DataFrame:
    """``id, ts, fp, keep_id`` of a batch: null for what stays, else the least row that stayed and that it is like.

    ``known`` are rows that stayed before. What is like one of them goes; the
    rest is held against itself in the order of ids. The least row of each
    fingerprint stands for all, so copies cost nothing in the joins.
    """
    rows = staged(batch, "batch")
    first = staged(rows.groupBy("fp").agg(F.min("id").alias("id")), "prints")
    old = staged(_linked(first, known, False).groupBy("later").agg(F.min("earlier").alias("keep_id")).withColumnRenamed("later", "id"), "known-links")
    fresh = staged(first.join(old, "id", "left_anti"), "fresh")
    own = kept_in_order(fresh.select("id"), _linked(fresh, fresh, True)).where("NOT kept").select("id", "keep_id")
    of_print = first.join(old.unionByName(own), "id", "left").select("fp", F.col("id").alias("first"), "keep_id")
    keep = F.coalesce("keep_id", F.when(F.col("id") != F.col("first"), F.col("first")))
    return rows.join(of_print, "fp").select("id", "ts", "fp", keep.alias("keep_id"))


def near_duplicate_stream(prints: DataFrame, name: str, days: float = 30, path: str | None = None) -> DataFrame:
    """``id, ts, fp, keep_id`` of a stream of fingerprints (``id, ts, fp``), marked against all that stayed in the ``days`` before the batch.

    The index is the rows that stayed, in a folder for each epoch that is
    written once, so an epoch that is run again overwrites only itself; rows
    beyond ``days`` are not read. With the ``path`` of an earlier run it goes
    on from that run's index. Ids rise with time.
    """
    spark, path = prints.sparkSession, path or shared_path(prints.sparkSession, name)

    def fold(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        known = spark.createDataFrame([], _MARKED)
        if epoch:
            first = batch.agg(F.min("ts")).head()[0]
            recent = F.col("ts") >= F.lit(first) - F.expr(f"INTERVAL {int(days * 86_400)} SECONDS")
            if _written(spark, path):
                known = spark.read.schema(f"{_MARKED}, epoch int").parquet(_folder(path)).where((F.col("epoch") < epoch) & F.col("keep_id").isNull() & recent)
        mark_batch(batch.select("id", "ts", "fp"), known.select("id", "fp")).write.mode("overwrite").parquet(f"{_folder(path)}/epoch={epoch}")

    prints.writeStream.foreachBatch(fold).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not _written(spark, path):
        return spark.createDataFrame([], _MARKED)
    return spark.read.schema(_MARKED).parquet(_folder(path)).select("id", "ts", "fp", "keep_id")


def _folder(path: str) -> str:
    return f"{path}/index"


def _written(spark: SparkSession, path: str) -> bool:
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{_folder(path)}/epoch=*/_SUCCESS")
    return bool(pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern))
