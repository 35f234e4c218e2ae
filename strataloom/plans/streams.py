"""Queries: streams with state a key."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataloom.sources.tables import scratch, table
from strataloom.streaming import activity as A
from strataloom.streaming import stateful as T


def _events(spark, sf):
    T.with_state_store(spark)
    return A.event_stream(spark, f"{sf}/events.parque[t]", table(spark, sf, "events").schema), f"{scratch(spark)}/stream-{uuid.uuid4().hex}"


def stream_failures(spark, sf):
    """What the turns of each user show to have failed, and which users have gone idle."""
    events, path = _events(spark, sf)
    turns = events.select(F.col("user_id").alias("session"), F.col("ts").alias("at"), F.col("event_id").alias("place"), F.col("event_type").alias("action"), (F.col("event_type") == "error").alias("is_error"), F.lit(None).cast("long").alias("nodes"))
    return A.drained(T.watched(turns), path).drop("batch")


def stream_metric_figures(spark, sf):
    """Totals of values by type of event, and figures of the last thousand."""
    events, path = _events(spark, sf)
    seen = events.select(F.lit("value").alias("name"), F.create_map(F.lit("type"), "event_type").alias("labels"), F.col("ts").alias("at"), F.col("event_id").alias("place"), "value")
    got = A.drained(T.metric_histories(seen), path, "update").drop("batch")
    return got.withColumns({c: F.round(c, 6) for c in ("total", "min", "max", "mean", "median", "p95", "p99")})


def stream_consolidation_due(spark, sf):
    """Types of events of which so many wait that they are due."""
    events, path = _events(spark, sf)
    return A.drained(T.consolidation_due(events.select(F.col("event_type").alias("scope"), F.col("event_id").alias("id"))), path, "update").drop("batch")


QUERIES = [stream_failures, stream_metric_figures, stream_consolidation_due]

SQL = {
    "stream_failures": """WITH g AS (SELECT user_id AS session, event_id, epoch_ms(ts) AS ms, coalesce(lower(event_type), '') AS a, epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) >= 3600000 AS gap FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
p AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY session ORDER BY ms, event_id) AS part FROM g),
t AS (SELECT session, part, ms, a, row_number() OVER w AS turn, lag(a, 1) OVER w AS l1, lag(a, 2) OVER w AS l2, lag(a, 3) OVER w AS l3, lag(a, 4) OVER w AS l4, lag(a, 5) OVER w AS l5 FROM p WINDOW w AS (PARTITION BY session, part ORDER BY ms, event_id)),
f AS (SELECT session, turn, CASE WHEN a = 'error' AND l1 = 'error' AND l2 = 'error' THEN 'explicit_error' WHEN a = l1 AND a = l2 THEN 'repetition_loop' WHEN a = l2 AND l1 = l3 OR a = l3 AND l1 = l4 AND l2 = l5 THEN 'circular_pattern' END AS failure,
 CASE WHEN a = l1 AND a = l2 THEN a WHEN a = l2 AND l1 = l3 THEN l1 || ' > ' || a ELSE l2 || ' > ' || l1 || ' > ' || a END AS detail FROM t),
l AS (SELECT session, part, max(turn) AS turn, max(ms) AS ms, part < max(part) OVER (PARTITION BY session) AS closed FROM t GROUP BY session, part)
SELECT session, turn, failure, detail FROM f WHERE failure IS NOT NULL
UNION ALL SELECT session, turn, 'idle', '' FROM l WHERE closed OR ms + 3600000 <= (SELECT max(ms) FROM t) - 600000""",
    "stream_metric_figures": """WITH v AS (SELECT 'value{type=' || event_type || '}' AS metric, value, row_number() OVER (PARTITION BY event_type ORDER BY epoch_ms(ts) DESC, event_id DESC) AS back FROM events WHERE value IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL),
k AS (SELECT metric, list(value ORDER BY value) AS l FROM v WHERE back <= 1000 GROUP BY 1)
SELECT metric, round(total, 6) AS total, len(l) AS count, round(l[1], 6) AS min, round(l[-1], 6) AS max, round(list_avg(l), 6) AS mean, round(list_median(l), 6) AS median, round(CASE WHEN len(l) >= 20 THEN l[(floor(len(l) * 0.95::DOUBLE))::INT + 1] ELSE l[-1] END, 6) AS p95,
 round(CASE WHEN len(l) >= 100 THEN l[(floor(len(l) * 0.99::DOUBLE))::INT + 1] ELSE l[-1] END, 6) AS p99 FROM k JOIN (SELECT metric, sum(value) AS total FROM v GROUP BY 1) USING (metric)""",
    "stream_consolidation_due": "SELECT event_type AS scope, 1::BIGINT AS round, count(DISTINCT event_id) AS items FROM events WHERE event_type IS NOT NULL GROUP BY 1 HAVING count(DISTINCT event_id) >= 20",
}
