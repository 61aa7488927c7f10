"""Streams give the rows of their batch forms."""

from __future__ import annotations

import random

import pytest
from conftest import TINY
from pyspark.sql import functions as F

from gablestone.streaming import jobs


@pytest.fixture
def events(spark, tmp_path):
    e = spark.read.parquet(f"{TINY}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job_id"), "event_type")
    e.write.parquet(str(tmp_path / "events"))
    return spark.read.parquet(str(tmp_path / "events")), spark.readStream.schema(e.schema).parquet(str(tmp_path / "events"))


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_counts(events, tmp_path):
    batch, stream = events
    got = {tuple(r) for r in run(jobs.counts_stream(stream), tmp_path, "counts", "complete").collect()}
    want = {tuple(r) for r in batch.groupBy(F.date_trunc("hour", "ts"), "event_type").count().collect()}
    assert got == want


def test_sessions(events, tmp_path):
    batch, stream = events
    got = {tuple(r) for r in run(jobs.debounced_stream(stream, "job_id", 1_800_000), tmp_path, "bursts", "complete").collect()}
    want = {tuple(r) for r in jobs.debounced(batch, "job_id", 1_800_000).select("job_id", "started", "ended", "n").collect()}
    assert got == want


def test_state_machine(spark, tmp_path):
    rows = [("a", 1, "uploading"), ("a", 2, "queued"), ("a", 3, "completed"), ("a", 4, "running"), ("a", 5, "failed"), ("b", 6, "queued"), ("b", 7, "uploading")]
    df = spark.createDataFrame(rows, "job_id string, event_id long, state string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {(r.job_id, r.event_id): r.legal for r in run(jobs.state_machine(stream, "job_id", "state", "event_id"), tmp_path, "machine").collect()}
    assert got == {("a", 1): True, ("a", 2): True, ("a", 3): False, ("a", 4): True, ("a", 5): True, ("b", 6): False, ("b", 7): True}


def reported(rows, micros, final):
    """The rule as a loop: so long after the last report, or final."""
    last, out = {}, []
    for k, i, us, sure in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if last.get(k) is None or (final and sure) or us - last[k] >= micros:
            last[k] = us
            out.append((k, i))
    return out


def test_throttle_and_coalesce_equal_the_loop(spark, tmp_path):
    rows = [("a", 1, 0, False), ("a", 2, 990_000, False), ("a", 3, 1_010_000, False), ("a", 4, 1_500_000, True), ("a", 5, 2_300_000, False), ("a", 6, 2_500_000, False), ("b", 7, 10, True), ("b", 8, 20, True)]
    rng = random.Random(1)
    rows += [(rng.choice("cde"), 100 + i, rng.randrange(60_000_000), rng.random() < 0.1) for i in range(400)]
    df = spark.createDataFrame(rows, "job_id string, event_id long, us long, last boolean").withColumn("ts", F.timestamp_micros("us"))
    got = sorted((r.job_id, r.event_id) for r in jobs.throttled(df, "job_id", final=F.col("last")).collect())
    assert got == sorted(reported(rows, 1_000_000, True)) and ("a", 3) in got and ("a", 5) not in got and ("a", 6) in got
    heads = reported(rows, 33_000, False)
    runs = jobs.coalesced(df, "job_id").collect()
    us = {r[1]: r[2] for r in rows}
    assert sorted((r.job_id, int(r.started.timestamp() * 1e6 + 0.5)) for r in runs) == sorted((k, us[i]) for k, i in heads) and sum(r.n for r in runs) == len(rows)
    df.orderBy("us").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert sorted((r.job_id, r.event_id) for r in run(jobs.throttled_stream(stream, "job_id", final="last"), tmp_path, "throttle").collect()) == got


def test_import_happens_once(spark, tmp_path):
    sink = jobs.import_once(str(tmp_path / "target"))
    batch = spark.createDataFrame([("a", 1), ("b", 2)], "job_id string, n int")
    sink(batch, 0)
    sink(batch.union(spark.createDataFrame([("c", 3), ("c", 3)], batch.schema)), 1)
    sink(batch, 2)
    assert sorted(r.job_id for r in spark.read.parquet(str(tmp_path / "target")).collect()) == ["a", "b", "c"]
