"""Structured Streaming forms: job states, and counts in event time with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery



def fold_into(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Run over all job events there are and append each batch's folded states to ``target``.

    events: a stream of job, state, at, event_id. A batch is folded before it is written, and written
    under its number, so a repeated batch replaces itself. Read the states back with ``latest``.
    """

    def sink(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("job").agg(
            F.max(F.struct("at", "event_id", "state")).alias("last"), F.max(F.when(F.col("state") == "running", F.col("at"))).alias("started_at"),
            F.max(F.when(F.col("state").isin("done", "failed"), F.col("at"))).alias("finished_at"), F.count(F.lit(1)).alias("events"),
        )
        last.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(states: DataFrame) -> DataFrame:
    """State of every job over all batches; equals ``operators.jobs.folded`` over all events."""
    m = states.groupBy("job").agg(F.max("last").alias("l"), F.max("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"), F.sum("events").alias("events"))
    return m.select("job", F.col("l.state").alias("status"), F.col("l.at").alias("updated_at"), "started_at", "finished_at", "events")


def windowed_counts(events: DataFrame, at: str, late: str, width: str) -> DataFrame:
    """start, state, n per tumbling window; rows later than ``late`` behind the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "state").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "state", "n")


