"""Streams against the same rows as a table."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillfin.plans import present
from quillfin.streaming import events
from quillfin.streaming.recents import PROVIDER, held, recent_ring

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = datetime(2024, 3, 1)


def some_events(n, seed):
    r = random.Random(seed)
    rows = [(i, START + timedelta(seconds=r.randrange(86_400)), r.choice([1, 1, 1, 2, 3, None]), r.choice("ab"), round(r.uniform(0, 50), 2)) for i in range(n)]
    return sorted(rows, key=lambda e: e[1])


def streamed(spark, folder, batches, plan, mode="append"):
    """The last query's rows, and the query, after one file and one micro-batch for each of ``batches``."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i:03}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    query = (
        plan(source).writeStream.format("memory").queryName(f"t{random.getrandbits(60)}").outputMode(mode)
        .option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    return spark.table(query.name), query


PLANS = {
    "tumbling": lambda e: events.tumbling(e, "1 hour", ["event_type"]),
    "sliding": lambda e: events.sliding(e, "1 hour", "15 minutes", ["event_type"]),
    "sessions": lambda e: events.sessions(e, "20 minutes", ["user_id"]),
}


@pytest.mark.parametrize("kind", PLANS)
def test_stream_equals_table(spark, tmp_path, kind):
    rows = some_events(400, 1)
    r = random.Random(2)
    # Rows come up to five minutes late, which the watermark allows; a far row closes the last windows.
    arriving = sorted(rows, key=lambda e: e[1] + timedelta(seconds=r.randrange(300)))
    far = (9999, START + timedelta(days=9), 7, "end", 0.0)
    batches = [arriving[:150], arriving[150:300], arriving[300:], [far], [(10_000, START + timedelta(days=9), 7, "end", 0.0)]]
    got, query = streamed(spark, tmp_path, batches, PLANS[kind])
    want = PLANS[kind](spark.createDataFrame(rows, SCHEMA))
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(got.where("window_start < '2024-03-05'")) == key(want) and events.late(query) == 0


def test_late_rows_are_counted_and_in_no_window(spark, tmp_path):
    rows = some_events(200, 3)
    late = [(5000 + i, START + timedelta(minutes=i), 1, "late", 1.0) for i in range(3)]
    far = [(9000 + i, START + timedelta(days=9), 7, "end", 0.0) for i in range(2)]
    got, query = streamed(spark, tmp_path, [rows[:100], rows[100:], late, far[:1], far[1:]], PLANS["tumbling"])
    assert got.where("event_type = 'late'").count() == 0 and got.agg(F.sum("n")).first()[0] == 200
    assert events.late(query) > 0


def test_null_times_and_empty_tables(spark):
    odd = spark.createDataFrame([(1, None, 1, "a", 1.0), (2, START, None, None, None)], SCHEMA)
    for kind, plan in PLANS.items():
        assert [r["n"] for r in plan(odd).collect()] == ([1] if kind != "sliding" else [1] * 4)
        assert plan(odd.where("false")).collect() == []


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, PROVIDER)
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("sizes", [(300,), (40, 1, 200, 59)])
def test_ring_state_equals_the_sorted_log(spark, tmp_path, rocks, sizes):
    rows = some_events(300, 5)
    random.Random(1).shuffle(rows)
    cuts, at = [], 0
    for size in sizes:
        cuts.append(rows[at : at + size])
        at += size
    _, query = streamed(spark, tmp_path, cuts, lambda e: recent_ring(e, "ts", "event_id", 20, shards=4), "update")
    want = present.recent(spark.createDataFrame(rows, SCHEMA), "ts", "event_id", 20)
    assert [r["event_id"] for r in held(spark, f"{tmp_path}/ck", "ts", "event_id", 20).collect()] == [r["event_id"] for r in want.collect()]
    state = spark.read.format("statestore").option("stateVarName", "entries").load(f"{tmp_path}/ck")
    assert state.count() <= 4 * 20


def test_silence_is_said_once(spark, tmp_path, rocks):
    rows = some_events(3, 8)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    ring = recent_ring(source, "ts", "event_id", 2, keep=timedelta(hours=1), idle=timedelta(seconds=1), shards=1)
    query = ring.writeStream.format("memory").queryName("ring_idle").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if spark.table("ring_idle").where("idle").count():
                break
        found = spark.table("ring_idle").collect()
        assert [r["event_id"] for r in found if not r["idle"]] == [e[0] for e in rows[::-1][:2]]
        query.awaitTermination(4)
        assert spark.table("ring_idle").where("idle").count() == 1
    finally:
        query.stop()
