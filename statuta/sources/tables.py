"""The driver's tables, and the engine's entities over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as leaves: family source, code lang, editions in the order of ids."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("section_id"), F.col("source").alias("family_key"), F.col("lang").alias("section_code"), F.col("doc_id").alias("edition"), F.col("text").alias("plain_text"))


def html_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as leaves with HTML: family host, code first path segment."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("section_id"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("family_key"), F.regexp_extract("url", "://[^/]*/([a-z]{2})/", 1).alias("section_code"), F.col("html").alias("html_content"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as findings."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("finding_id"), F.col("event_type").alias("detector"), F.col("user_id").alias("document_id"), F.col("value").alias("score"), F.col("ts").alias("seen_at"), F.col("props").alias("detail_json"),
        F.when(F.col("value") >= 90, "error").when(F.col("value") >= 50, "warning").otherwise("info").alias("severity"),
        F.when(F.col("event_id") % 7 == 0, "fixed").when(F.col("event_id") % 5 == 0, "parse_bug").otherwise("new").alias("triage"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as document versions."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("version_no"), "role", "text")
