"""Keyed state with timers and the near-duplicate index: batches, restarts and expiry against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from marketloom.streaming import events as st
from marketloom.streaming import state as ss

SCHEMA = "event_id long, ts timestamp, user_id long, bad boolean, failed boolean"
START = dt.datetime(2024, 1, 1)


def events(n, seed, spread):
    rng, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += rng.choice([0.5, 2, 4, 7, 40, spread])
        bad = rng.random() < 0.7
        rows.append((i, START + dt.timedelta(seconds=t), rng.randrange(3), bad, bad))
    return rows


def append(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def streamed(spark, rows, cuts, processor, tmp_path, name):
    """What a processor emits when the rows come in so many runs, each going on from the one before."""
    source, path = f"{tmp_path}/{name}-in", f"{tmp_path}/{name}-out"
    for k in range(cuts):
        append(spark, rows[k * len(rows) // cuts : (k + 1) * len(rows) // cuts], source)
        out = st.run_to_table(ss.keyed(spark.readStream.schema(SCHEMA).parquet(source), "user_id", processor, "0 seconds"), name, path=path)
    return sorted(map(tuple, out.collect()))


def by_key(rows):
    return {k: [r for r in rows if r[2] == k] for k in {r[2] for r in rows}}


def end_of(rows):
    return max(r[1] for r in rows)


def plain_redelivery(rows, forget):
    out, second = [], lambda n: dt.timedelta(seconds=n)
    for key, own in by_key(rows).items():
        attempts, failed, waiting = 0, None, False
        for _, ts, _, _, bad in [*own, (0, end_of(rows), 0, None, None)]:
            if failed is not None and waiting and failed + second(min(2**attempts, 60)) <= ts:
                out.append((key, "retry", attempts, failed + second(min(2**attempts, 60))))
                waiting = False
            if failed is not None and not waiting and failed + second(min(2**attempts, 60) + forget) <= ts:
                attempts, failed = 0, None
            if bad is None:
                break
            if not bad:
                attempts, failed, waiting = 0, None, False
            elif attempts + 1 >= 3:
                out.append((key, "dead", attempts + 1, ts))
                attempts, failed, waiting = 0, None, False
            else:
                attempts, failed, waiting = attempts + 1, ts, True
    return sorted(out)


def plain_alerts(rows, days):
    out, keep = [], dt.timedelta(days=days)
    for key, own in by_key(rows).items():
        opened = seen = None
        n = 0
        for _, ts, _, bad, _ in [*own, (0, end_of(rows), 0, None, None)]:
            if opened is not None and seen + keep <= ts:
                out.append((key, "expired", opened, seen + keep, n))
                opened = None
            if bad and opened is None:
                opened, seen, n = ts, ts, 1
                out.append((key, "opened", ts, ts, 1))
            elif bad:
                seen, n = ts, n + 1
            elif bad is False and opened is not None:
                out.append((key, "resolved", opened, ts, n))
                opened = None
    return sorted(out)


def plain_cooldown(rows, minutes):
    out = []
    for key, own in by_key(rows).items():
        last = None
        for i, ts, *_ in own:
            if last is None or ts - last >= dt.timedelta(minutes=minutes):
                out.append((key, i, ts))
                last = ts
    return sorted(out)


@pytest.mark.parametrize("cuts", [1, 3])
def test_redelivery(spark, tmp_path, cuts):
    rows = events(90, 1, 400)
    got = streamed(spark, rows, cuts, ss.Redelivery(forget=100), tmp_path, f"retry{cuts}")
    assert got == plain_redelivery(rows, 100) and {r[1] for r in got} == {"retry", "dead"}


@pytest.mark.parametrize("cuts", [1, 3])
def test_alert_states(spark, tmp_path, cuts):
    rows = events(90, 2, 90_000)
    got = streamed(spark, rows, cuts, ss.AlertStates(days=0.5), tmp_path, f"alerts{cuts}")
    assert got == plain_alerts(rows, 0.5) and {r[1] for r in got} == {"opened", "resolved", "expired"}


def test_cooldown_expires(spark, tmp_path):
    rows = events(60, 3, 900)
    assert streamed(spark, rows, 3, ss.Cooldown(minutes=5), tmp_path, "cool") == plain_cooldown(rows, 5)


def test_equal_times_and_no_rows(spark, tmp_path):
    rows = [(i, START, 1, True, True) for i in range(4)] + [(9, START + dt.timedelta(hours=1), 2, False, False)]
    assert streamed(spark, rows, 1, ss.Redelivery(), tmp_path, "ties") == [(1, "dead", 3, START), (1, "retry", 1, START + dt.timedelta(seconds=2))]
    assert streamed(spark, rows[:0], 1, ss.Redelivery(), tmp_path, "none") == []


def test_near_duplicates_in_five_batches_and_one(spark, tmp_path):
    rng = random.Random(7)
    seeds = [rng.getrandbits(63) for _ in range(25)]
    prints = []
    for i in range(200):
        fp = rng.choice(seeds)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            fp ^= 1 << rng.randrange(63)
        prints.append((i, START + dt.timedelta(seconds=i), fp))
    kept, want = [], {}
    for i, _, fp in prints:
        like = [k for k, g in kept if (fp ^ g).bit_count() <= 3]
        want[i] = min(like, default=None)
        if not like:
            kept.append((i, fp))

    def marked(cuts):
        source, path = f"{tmp_path}/in{cuts}", f"{tmp_path}/index{cuts}"
        for k in range(cuts):
            part = prints[k * 200 // cuts : (k + 1) * 200 // cuts]
            spark.createDataFrame(part, "id long, ts timestamp, fp long").coalesce(1).write.mode("append").parquet(source)
            if cuts == 1 or k in (1, 4):  # two runs: of two batches, then of three
                stream = spark.readStream.schema("id long, ts timestamp, fp long").option("maxFilesPerTrigger", 1).parquet(source)
                out = ss.near_duplicate_stream(stream, "near", path=path)
        return {r.id: r.keep_id for r in out.collect()}

    assert {i: k is None for i, k in marked(1).items()} == {i: k is None for i, k in want.items()}
    five = marked(5)
    assert {i: k is None for i, k in five.items()} == {i: k is None for i, k in want.items()}
    assert all(k is None or (want[k] is None and k < i) for i, k in five.items())


def test_index_forgets(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/index"
    for i, days in enumerate((0, 5, 40)):
        spark.createDataFrame([(i, START + dt.timedelta(days=days), 77)], "id long, ts timestamp, fp long").coalesce(1).write.mode("append").parquet(source)
        out = ss.near_duplicate_stream(spark.readStream.schema("id long, ts timestamp, fp long").parquet(source), "near", days=30, path=path)
    assert {r.id: r.keep_id for r in out.collect()} == {0: None, 1: 0, 2: None}
