"""Queries: differences between versions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.operators import differences as D
from strataloom.operators import sanitize as Z
from strataloom.sources.tables import table

from .markdown import _texts


def event_json_differences(spark, sf):
    """What changed in the properties from each event of a user to the next one."""
    before = F.lag("props").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = table(spark, sf, "events").select("event_id", before.alias("old"), F.col("props").alias("new")).where("old is not null and new is not null")
    return D.json_differences(pairs, "event_id", "old", "new")


def sanitized_differences(spark, sf):
    """How many lines of each Markdown text sanitizing changes."""
    pairs = Z.sanitized(_texts(spark, sf)).select("doc_id", F.col("raw").alias("old"), F.col("content").alias("new"))
    return D.line_counts(pairs, "doc_id", "old", "new")


QUERIES = [event_json_differences, sanitized_differences]

SQL = {
    "event_json_differences": """WITH p AS (SELECT event_id, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old, props AS new FROM events),
v AS (SELECT event_id, json_extract(old, '$.k')::VARCHAR AS a, json_extract(new, '$.k')::VARCHAR AS b FROM p WHERE old IS NOT NULL AND new IS NOT NULL)
SELECT event_id, '$.k' AS path, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'changed' END AS change, a AS old, b AS new FROM v WHERE a IS DISTINCT FROM b""",
}
