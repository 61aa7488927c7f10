"""Queries on job states and progress events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gablestone.sources.derived import table
from gablestone.streaming import jobs as op

STATE = {"signup": "uploading", "view": "queued", "click": "running", "purchase": "completed", "error": "failed"}


def _events(spark, sf):
    s = F.create_map(*[x for k, v in STATE.items() for x in (F.lit(k), F.lit(v))])
    return table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("job_id"), "event_type", F.element_at(s, F.col("event_type")).alias("state"), "value")


def latest_job_state(spark, sf):
    return op.latest(_events(spark, sf), "job_id", "state", order="event_id")


def job_transitions(spark, sf):
    t = op.transitions(_events(spark, sf), "job_id", "state", ["ts", "event_id"])
    return t.groupBy(F.coalesce("before", F.lit("-")).alias("before"), "state", "legal").agg(F.count("*").alias("n"))


def progress_throttle(spark, sf):
    e = op.throttled(_events(spark, sf), "job_id", 3600, final=F.col("state").isin(*op.TERMINAL))
    return e.select("event_id", "job_id", "state")


def debounced_updates(spark, sf):
    return op.debounced(_events(spark, sf), "job_id", 1_800_000)


def signal_counts(spark, sf):
    e = _events(spark, sf)
    return e.groupBy(F.date_trunc("hour", "ts").alias("started"), "event_type").agg(F.count("*").alias("n"))


def restarted_jobs(spark, sf):
    last = op.latest(_events(spark, sf), "job_id", "state", order="event_id")
    after = F.when(F.col("state").isin("queued", "running"), "interrupted").otherwise(F.col("state"))
    return last.select("job_id", after.alias("state"))


def poll_outcomes(spark, sf):
    e = _events(spark, sf).withColumn("state", F.when(F.col("event_id") % 17 == 0, "lost").otherwise(F.col("state")))
    return e.select("event_id", op.client_outcome(F.col("state")).alias("outcome"))


def coalesced_updates(spark, sf):
    return op.coalesced(_events(spark, sf), "job_id", 43_200_000)


_E = "WITH e AS (SELECT event_id, ts, user_id AS job_id, event_type, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE.items()) + " END AS state FROM events)"
_LAST = f"{_E}, l AS (SELECT job_id, state, ts FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS i FROM e) WHERE i = 1)"
_LEGAL = " OR ".join(f"(before = '{a}' AND state = '{b}')" for a, bs in op.NEXT.items() for b in bs)



def _walked(key: str, clock: str, final: str) -> str:
    """r holds the reports (k, i): the first event of a key, then from each the next one that is final or late enough."""
    return f"""{_E.replace("WITH e", "WITH RECURSIVE e", 1)},
n AS (SELECT *, {key} AS k, {final} AS final, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM e),
nxt AS (SELECT a.k, a.i, min(b.i) AS j FROM n a JOIN n b ON a.k = b.k AND b.i > a.i AND (b.final OR b.ts >= a.ts + INTERVAL {clock}) GROUP BY a.k, a.i),
r AS (SELECT k, i FROM n WHERE i = 1 UNION ALL SELECT r.k, nxt.j FROM r JOIN nxt ON r.k = nxt.k AND r.i = nxt.i)"""


QUERIES = {f.__name__: f for f in (latest_job_state, job_transitions, progress_throttle, debounced_updates, signal_counts, restarted_jobs, poll_outcomes, coalesced_updates)}
SQL = {
    "latest_job_state": f"{_LAST} SELECT job_id, state, ts FROM l",
    "job_transitions": f"{_E}, t AS (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS before FROM e) SELECT coalesce(before, '-') AS before, state, coalesce({_LEGAL}, false) OR (before IS NULL AND state = 'uploading') AS legal, count(*) AS n FROM t GROUP BY ALL",
    "progress_throttle": _walked("job_id", "1 HOUR", "state IN ('completed', 'failed', 'interrupted')") + " SELECT event_id, job_id, state FROM n JOIN r USING (k, i)",
    "debounced_updates": f"{_E}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY job_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS run FROM g) SELECT job_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM r GROUP BY job_id, run",
    "signal_counts": "SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n FROM events GROUP BY ALL",
    "poll_outcomes": f"{_E} SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'error' WHEN state = 'completed' THEN 'done' WHEN state IN ('queued', 'running') THEN 'wait' ELSE 'error' END AS outcome FROM e",
    "coalesced_updates": _walked("job_id", "12 HOUR", "false") + ", h AS (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS j FROM r) SELECT n.k AS job_id, min(ts) AS started, count(*) AS n, max(ts) AS last FROM h JOIN n ON n.k = h.k AND n.i >= h.i AND (h.j IS NULL OR n.i < h.j) GROUP BY n.k, h.i",
    "restarted_jobs": f"{_LAST} SELECT job_id, CASE WHEN state IN ('queued', 'running') THEN 'interrupted' ELSE state END AS state FROM l",
}
