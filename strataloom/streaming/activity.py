"""Structured Streaming over append-only activity logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over parquet files as they arrive (a pattern where the path is one file)."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n) by event-time window; windows are final once the watermark has passed them."""
    stamped = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    got = stamped.groupBy(F.window("_at", window).alias("w"), key).agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def rate_limited(events: DataFrame, session: str, at: str, per_minute: float = 60.0, burst: float | None = None) -> DataFrame:
    """(session, calls, allowed): a token bucket for every session, refilled by event time up to ``burst`` (one minute's if unset), one token a call.

    Each micro-batch takes its events in order of time; state is the bucket, so memory is one row a session.
    """
    rate, most = per_minute / 60.0, per_minute if burst is None else burst

    def take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last, calls, allowed = state.get if state.exists else (most, -1.0, 0, 0)
        times = sorted(t for b in batches for t in b["t"])
        for t in times:
            tokens = min(most, tokens + max(0.0, t - last) * rate) if last >= 0 else tokens
            last = max(last, t)
            calls += 1
            if tokens >= 1:
                tokens -= 1
                allowed += 1
        state.update((tokens, last, calls, allowed))
        yield pd.DataFrame({"session": [key[0]], "calls": [calls], "allowed": [allowed]})

    timed = events.select(F.col(session).cast("long").alias("session"), F.col(at).cast("timestamp").cast("double").alias("t"))
    return timed.groupBy("session").applyInPandasWithState(take, "session long, calls long, allowed long", "tokens double, last double, calls long, allowed long", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into parquet under ``path``, and read the result."""
    spark = stream.sparkSession

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows/batch={epoch}")  # a batch that is run again replaces itself

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(batch).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
