"""Queries over the events as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabveil import streaming
from tabveil.operators.filters import constrain
from tabveil.registry import query, table


@query("stream_suppressed_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, CASE WHEN count(*) >= 10 THEN count(*) END AS n FROM events WHERE value > 1 GROUP BY 1, 2")
def stream(spark, sf_dir):
    events = streaming.read_stream(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)
    counts = streaming.windowed_counts(constrain(events, ["value > 1"]), "ts", ["event_type"], late="3650 days")
    return streaming.hide_small(streaming.latest(counts, "stream", ["start", "event_type"])).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")
