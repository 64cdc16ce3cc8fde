"""Streams give what batches give."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketloom.operators import decision as dc
from marketloom.streaming import events as st
from marketloom.streaming import state


def table(spark, tmp_path, rows, schema):
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return str(tmp_path)


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_cooldown_is_the_batch_pass(spark, tmp_path):
    rows = [(i, at(m), i % 2, "error", 1.0, "{}") for i, m in enumerate((0, 5, 30, 61, 62, 100, 130, 200))]
    events = st.read_events(spark, table(spark, tmp_path, rows, SCHEMA)).select("user_id", "event_id", "ts")
    stream = st.run_to_table(state.keyed(events, "user_id", state.Cooldown()), "cooldown")
    batch = dc.with_cooldown(spark.createDataFrame([(u, i, t) for i, t, u, *_ in rows], "symbol long, id long, ts timestamp"))
    assert {r.event_id for r in stream.collect()} == {r.id for r in batch.collect()}


def test_dead_letters_and_repeats(spark, tmp_path):
    rows = [(1, at(0), 1, "a", 1.0, '{"k": 5}'), (2, at(1), 1, "a", 1.0, "no json"), (3, at(2), 1, "a", 1.0, None), (1, at(0), 1, "a", 1.0, '{"k": 5}')]
    events = st.parsed(st.read_events(spark, table(spark, tmp_path, rows, SCHEMA)))
    good, dead = st.with_dead_letters(events, "letters", F.col("valid"))
    assert sorted(r.event_id for r in good.collect()) == [1, 1] and sorted(r.event_id for r in dead.collect()) == [2, 3]
    unique = st.run_to_table(st.deduplicated(events.select("event_id", "ts"), ["event_id"]), "unique")
    assert sorted(r.event_id for r in unique.collect()) == [1, 2, 3]


def test_state_table(spark, tmp_path):
    rows = [(i, at(i), i % 2, "a", float(i), None) for i in range(6)]
    events = st.read_events(spark, table(spark, tmp_path, rows, SCHEMA)).select("user_id", "value")
    merge = lambda state, batch: state.union(batch).groupBy("user_id").agg(F.sum("value").alias("value"))
    state = st.upsert_state(events, "sums", merge, "user_id long, value double")
    assert {r.user_id: r.value for r in state.collect()} == {0: 6.0, 1: 9.0}


def test_retry_delays(spark):
    rows = spark.createDataFrame([("a",)] * 2 + [("b",)] * 4, "k string")
    assert {r.k: (r.attempts, r.delay, r.dead) for r in st.retry_state(rows, "k").collect()} == {"a": (2, 4.0, False), "b": (4, None, True)}
