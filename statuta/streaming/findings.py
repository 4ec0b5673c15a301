"""Streams of events: windowed counts, sessions, duplicates, rate limits and the lifecycle of findings.

Each takes a streaming DataFrame and gives one, or runs a query to its end over files that are there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DELAY = "2 hours"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream, with event time and watermark."""
    rows = spark.readStream.schema(EVENT).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", DELAY)


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("first_ts"), "n")


def without_duplicates(events: DataFrame) -> DataFrame:
    """Each finding once within the watermark's delay."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def rate_limited(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """Requests over `most` within the `seconds` up to each, of each client, in event time; state is the client's recent times."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["at", "event_id"])
        for event_id, at in zip(rows["event_id"], rows["at"], strict=True):
            recent = [t for t in recent if t >= at - seconds * 1_000_000]
            recent.append(int(at))
            out.append((int(event_id), int(key[0]), len(recent), len(recent) > most))
        state.update((recent,))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "n", "limited"])

    timed = events.select("user_id", "event_id", F.unix_micros("ts").alias("at"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, n long, limited boolean", "recent array<long>", "append", GroupStateTimeout.NoTimeout)


def run_to_end(rows: DataFrame, folder: str) -> DataFrame:
    """The rows that a stream appends over all that there is now, written to folder/rows."""
    q = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")


def totals_to_end(rows: DataFrame, folder: str) -> DataFrame:
    """The totals that a stream of aggregates has over all that there is now: each batch's complete totals replace the ones before, by a folder of the batch."""
    seen = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        seen.append(number)

    q = rows.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not seen:
        return rows.sparkSession.createDataFrame([], rows.schema)
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows/{max(seen)}")


def write_batches(rows: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs merge on each batch; a batch may come again after a failure, so merge must be idempotent by batch number."""
    rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def poll(rows: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 1):
    """A running query that does the work on each batch of new rows, looking every so many seconds; stop() ends it. A batch may come again after a failure."""
    return rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
