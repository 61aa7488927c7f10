"""Jobs, progress and signals: latest state, transitions, throttling and debouncing.

Each operator has a batch form, and where it keeps state between events a streaming form
that gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# The states of a job and what each may become.
NEXT = {
    "uploading": ("queued", "failed"),
    "queued": ("running", "interrupted"),
    "running": ("completed", "failed", "interrupted"),
    "completed": (),
    "failed": ("completed",),
    "interrupted": ("completed",),
}
TERMINAL = ("completed", "failed", "interrupted")


def latest(events: DataFrame, key: str, value: str, ts: str = "ts", order: str | None = None) -> DataFrame:
    """(key, value, ts): the last of each key; ties go to the larger ``order``."""
    at = F.struct(ts, order) if order else F.col(ts)
    return events.groupBy(key).agg(F.max_by(value, at).alias(value), F.max(ts).alias(ts))


def may_follow(old: Column, new: Column) -> Column:
    out = F.lit(False)
    for state, nexts in NEXT.items():
        out = out | ((old == state) & new.isin(*nexts)) if nexts else out
    return out | (old.isNull() & (new == "uploading"))


def transitions(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """events with the state before and whether the step is legal."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("before", F.lag(state).over(w)).withColumn("legal", F.coalesce(may_follow(F.col("before"), F.col(state)), F.lit(False)))


def client_outcome(state: Column) -> Column:
    """What a polling client makes of a state: done, wait, or an error; unknown states are errors."""
    return F.when(state == "completed", "done").when(state.isin("queued", "running"), "wait").otherwise("error")


def _in_force(events: DataFrame, key: str, micros: int, ts: str, order: str, final: Column | None) -> DataFrame:
    """events with ``_head``, the time of the report in force, and ``_first``, whether this event is one.

    An event is a report if none is in force or the last one is so long ago, or if it is
    final. That depends on all before it, so a key's events are walked in order; a task
    holds one key's clock at a time, whatever the number of its events.
    """
    import pyarrow as pa

    rows = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_final", F.coalesce(final, F.lit(False)) if final is not None else F.lit(False))
    out = T.StructType([*rows.schema.fields, T.StructField("_head", T.LongType()), T.StructField("_first", T.BooleanType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), None
        for batch in batches:
            heads, first = [], []
            at = batch.schema.names.index
            for k, us, sure in zip(*(batch.column(at(c)).to_pylist() for c in (key, "_us", "_final"))):
                if k != now:
                    now, last = k, None
                new = last is None or sure or us - last >= micros
                last = us if new else last
                heads.append(last)
                first.append(new)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.int64()), pa.array(first, pa.bool_())], names=[*batch.schema.names, "_head", "_first"])

    return rows.repartition(key).sortWithinPartitions(key, "_us", order).mapInArrow(walk, out)


def coalesced(events: DataFrame, key: str, milliseconds: int = 33, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(key, started, n, last): the changes of a key that one update handles.

    The first change while none is pending starts the clock; what comes before it has run
    down is handled with it.
    """
    walked = _in_force(events.select(key, ts, order), key, milliseconds * 1000, ts, order, None)
    return walked.groupBy(key, "_head").agg(F.min(ts).alias("started"), F.count("*").alias("n"), F.max(ts).alias("last")).drop("_head")


def throttled(events: DataFrame, key: str, seconds: int = 1, ts: str = "ts", order: str = "event_id", final: Column | None = None) -> DataFrame:
    """The events that are reported: the first of a key, each so long after the last reported one, and all final ones."""
    return _in_force(events, key, seconds * 1_000_000, ts, order, final).where("_first").select(*events.columns)


def throttled_stream(stream: DataFrame, key: str, seconds: int = 1, ts: str = "ts", order: str = "event_id", final: str | None = None) -> DataFrame:
    """(key, order, ts) of the same events of a stream, which come in order; ``final`` names a boolean column."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = dict(stream.dtypes)
    given = stream.select(key, order, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), (F.coalesce(F.col(final), F.lit(False)) if final else F.lit(False)).alias("_final"))

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = held.get[0] if held.exists else None
        for frame in frames:
            frame = frame.sort_values(["_us", order])
            kept = []
            for us, sure in zip(frame["_us"], frame["_final"]):
                kept.append(last is None or bool(sure) or us - last >= seconds * 1_000_000)
                last = int(us) if kept[-1] else last
            yield frame.loc[kept, [key, order, ts]]
        if last is not None:
            held.update((last,))

    kept = T.StructType([T.StructField("last", T.LongType())])
    return given.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {ts} {kinds[ts]}", kept, "append", GroupStateTimeout.NoTimeout)


def debounced(events: DataFrame, key: str, gap_ms: int, ts: str = "ts") -> DataFrame:
    """(key, started, ended, n): bursts of events of a key; a burst ends when none comes for the gap."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    runs = events.withColumn("_new", F.when(gap.isNull() | (gap > gap_ms * 1000), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n")).drop("_run")


def debounced_stream(stream: DataFrame, key: str, gap_ms: int, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The same over a stream: session windows with a watermark."""
    s = F.session_window(ts, f"{gap_ms} milliseconds")
    got = stream.withWatermark(ts, late).groupBy(s.alias("w"), key).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))
    return got.select(key, "started", "ended", "n")


def counts_stream(stream: DataFrame, width: str = "1 hour", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(started, event_type, n) by tumbling window."""
    got = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("started"), "event_type", "n")


def state_machine(stream: DataFrame, key: str, state: str, order: str) -> DataFrame:
    """(key, state, legal) for each event of a stream, with each key's last legal state kept between batches.

    Illegal events are reported and don't change the state.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = dict(stream.dtypes)[key]
    out = f"{key} {kind}, {order} {dict(stream.dtypes)[order]}, {state} string, legal boolean"

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get[0] if held.exists else None
        for frame in frames:
            rows = []
            for o, s in sorted(zip(frame[order], frame[state])):
                legal = s in NEXT[now] if now else s == "uploading"
                now = s if legal else now
                rows.append((k[0], o, s, legal))
            yield pd.DataFrame(rows, columns=[key, order, state, "legal"])
        if now:
            held.update((now,))

    kept = T.StructType([T.StructField("state", T.StringType())])
    return stream.groupBy(key).applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.NoTimeout)


def import_once(target: str, key: str = "job_id", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: append the batch's jobs that the Parquet target doesn't hold yet, each once.

    The target is partitioned by a hash of the key, so a batch reads the keys of its own
    buckets only. A batch that is run again finds what it wrote.
    """

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        dealt = batch.dropDuplicates([key]).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            mine = [r[0] for r in dealt.select("_bucket").distinct().collect()]  # at most ``buckets``
            known = spark.read.parquet(target).where(F.col("_bucket").isin(mine)).select(key, "_bucket")
            dealt = dealt.join(known, [key, "_bucket"], "left_anti")
        dealt.write.mode("append").partitionBy("_bucket").parquet(target)

    return run
