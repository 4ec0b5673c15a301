"""Queries that run as streams over the events file, to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from statuta.catalog import query
from statuta.session import shared_dir
from statuta.streaming import findings as S


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("stream_tumbling", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    found = S.totals_to_end(S.tumbling(S.event_stream(spark, sf_dir)), _folder(spark))
    return found.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_deduplicated", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_deduplicated(spark, sf_dir):
    found = S.run_to_end(S.without_duplicates(S.event_stream(spark, sf_dir)).select("event_id", "event_type"), _folder(spark))
    return found.groupBy("event_type").agg(F.count("*").alias("n"))
