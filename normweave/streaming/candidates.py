"""Unanswered questions counted as they arrive, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normal_question
from ..operators.operations import masked_log


def count_candidates(log: DataFrame) -> DataFrame:
    """A stream of log rows (ts, question, response, answered) as running counts of unanswered questions.

    Texts are masked before they enter the state. The state has one row for each distinct question, and
    aggregates before it shuffles; write it in update or complete mode.
    """
    asked = masked_log(log).where(~F.coalesce("answered", F.lit(False))).withColumn("normalized_question", normal_question(F.col("question")))
    return asked.groupBy("normalized_question").agg(F.min_by("question", "ts").alias("question"), F.count(F.lit(1)).alias("asked_count"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


def start_candidates(log: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return count_candidates(log).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type, value) by tumbling window; rows later than `late` behind the stream are dropped by the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")
