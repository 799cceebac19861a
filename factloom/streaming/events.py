"""The progress stream of documents: events (event_id, document_id, stage, progress, sequence, …).

Order is that of the integer sequence, not of time; an event that does not raise its document's sequence is late
and dropped. The batch and streaming forms give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The stages in order; progress is ten for each.
STAGES = ("validating", "extracting", "chunking", "embedding", "classification", "fact_extraction", "verification", "synthesis", "building_visuals", "done")
FAILED = "failed"


def progress_of(stage):
    out = F
    for i, s in enumerate(STAGES):
        out = out.when(stage == s, 10 * (i + 1))
    return out.otherwise(0)


def status_of(stage):
    return F.when(stage == "done", "done").when(stage == FAILED, "failed").otherwise("processing")


def merge_monotonic(events: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The events that raised their document's sequence when they arrived, with status. Of events that arrived at once,
    the smaller event_id comes first, as in the stream."""
    before = Window.partitionBy("document_id").orderBy(arrival, "event_id").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("sequence").over(before)
    return events.withColumn("_top", top).filter(F.col("_top").isNull() | (F.col("sequence") > F.col("_top"))).drop("_top").withColumn("status", status_of(F.col("stage")))


def current_state(events: DataFrame) -> DataFrame:
    """document_id, stage, progress, sequence and status of each document's highest sequence."""
    return events.groupBy("document_id").agg(
        F.max_by("stage", "sequence").alias("stage"), F.max_by("progress", "sequence").alias("progress"), F.max("sequence").alias("sequence")
    ).withColumn("status", status_of(F.col("stage")))


def recover(streamed: DataFrame, polled: DataFrame) -> DataFrame:
    """Streamed and polled events together, once each."""
    return streamed.unionByName(polled).dropDuplicates(["event_id"])


def next_job(jobs: DataFrame, most_attempts: int = 3) -> DataFrame:
    """The oldest queued job with attempts left."""
    return jobs.filter((F.col("status") == "queued") & (F.col("attempts") < most_attempts)).orderBy("created_at", "job_id").limit(1)


_OUT = "document_id long, event_id long, stage string, progress long, sequence long"


def _raise_sequence(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    top = state.get[0] if state.exists else None
    for pdf in batches:
        pdf = pdf.sort_values(["arrival", "event_id"])
        best = pdf["sequence"].cummax().shift(1)
        floor = best if top is None else best.fillna(top).clip(lower=top)
        kept = pdf[floor.isna() | (pdf["sequence"] > floor)]
        if len(pdf):
            top = int(pdf["sequence"].max()) if top is None else max(top, int(pdf["sequence"].max()))
            state.update((top,))
        yield kept[["document_id", "event_id", "stage", "progress", "sequence"]]


def merge_stream(events: DataFrame) -> DataFrame:
    """The streaming form of merge_monotonic: keeps one number a document as state."""
    return events.groupBy("document_id").applyInPandasWithState(_raise_sequence, _OUT, "top long", "append", "NoTimeout")


def dedupe_stream(events: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(["event_id"])
