"""Merging a newly parsed document into the stored one, and what reviewers said with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import text as T


def merge_parsed(stored: DataFrame, parsed: DataFrame, key: str = "source_key") -> DataFrame:
    """Each leaf's change (added, removed, changed, unchanged), its text and its status afterwards.

    stored: key, sha, status, plain_text. parsed: key, sha, plain_text. A changed leaf's approval is reset, an
    unchanged one's is carried over; a removed leaf that reviewers touched is kept as an orphan.
    """
    s, p = stored.alias("s"), parsed.alias("p")
    both = s.join(p, key, "full_outer")
    change = F.when(F.col("s.sha").isNull(), "added").when(F.col("p.sha").isNull(), "removed").when(F.col("s.sha") == F.col("p.sha"), "unchanged").otherwise("changed")
    human = F.col("s.status").isin("approved", "inherited")
    status = F.when(change == "unchanged", F.col("s.status")).when((change == "removed") & human, "orphaned").when(change == "removed", "removed").otherwise("pending")
    return both.select(key, change.alias("change"), status.alias("status"), F.coalesce("p.plain_text", "s.plain_text").alias("plain_text"), (human & (change == "changed")).alias("approval_reset"))


def carry_over_report(merged: DataFrame) -> DataFrame:
    return merged.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed", "unchanged")), F.count_if("approval_reset").alias("approvals_reset"), F.count_if(F.col("status") == "orphaned").alias("orphaned"))


def reanchor_annotations(annotations: DataFrame, leaves: DataFrame, key: str = "section_id") -> DataFrame:
    """Annotations with their place in the leaves' new texts; those without a leaf need a check."""
    rows = annotations.join(leaves.select(key, F.col("plain_text").alias("__new")), key, "left")
    moved = T.reanchored(*map(F.col, ("__new", "highlighted_text", "start_offset", "end_offset", "context_before", "context_after")))
    return rows.withColumn("__at", moved).select(*annotations.columns, F.col("__at.start").alias("new_start"), F.col("__at.end").alias("new_end"), F.when(F.col("__new").isNull(), "orphaned").otherwise(F.col("__at.status")).alias("new_status"), F.col("__at.reason").alias("reason"))


def blockers(leaf: Column, toxic: Column, open_notes: Column, errors: Column) -> Column:
    """Reasons against a leaf's approval."""
    return F.array_compact(F.array(F.when(leaf.isNull(), "missing_leaf"), F.when(toxic > 0, "open_issue"), F.when(open_notes > 0, "open_annotations"), F.when(errors > 0, "open_error_findings")))


def effective_status(reasons: Column, approved: Column, inherited: Column) -> Column:
    return F.when(F.size(reasons) > 0, "blocked").when(approved, "approved").when(inherited, "inherited").otherwise("pending")


def new_versions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Versions to be created: documents whose digest isn't the active one's, with the next number. current: document, version_no, sha, is_active."""
    same = current.filter("is_active").select("document", "sha")
    last = current.groupBy("document").agg(F.max("version_no").alias("last"))
    return incoming.join(same, ["document", "sha"], "left_anti").join(last, "document", "left").select("document", "sha", (F.coalesce("last", F.lit(0)) + 1).alias("version_no"))


def valid_inheritance(claims: DataFrame, leaves: DataFrame) -> DataFrame:
    """Claims whose leaf and origin have equal text, markup and variant. claims: section_id, origin_id. leaves: section_id, text_sha, shape, variant_key."""
    mine = leaves.select("section_id", *(F.col(c).alias(f"m_{c}") for c in ("text_sha", "shape", "variant_key")))
    origin = leaves.select(F.col("section_id").alias("origin_id"), *(F.col(c).alias(f"o_{c}") for c in ("text_sha", "shape", "variant_key")))
    same = F.lit(True)
    for c in ("text_sha", "shape", "variant_key"):
        same = same & (F.coalesce(f"m_{c}", F.lit("")) == F.coalesce(f"o_{c}", F.lit("")))
    return claims.join(mine, "section_id").join(origin, "origin_id").filter(same).select("section_id", "origin_id")


def upsert_aliases(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Families with the union of old and new aliases. known: family_key, aliases. seen: family_key, alias."""
    new = seen.groupBy("family_key").agg(F.collect_set("alias").alias("new"))  # names of one statute: few
    both = known.join(new, "family_key", "full_outer")
    empty = F.array().cast("array<string>")
    return both.select("family_key", F.sort_array(F.array_union(F.coalesce("aliases", empty), F.coalesce("new", empty))).alias("aliases"))


def gate(metrics: DataFrame) -> DataFrame:
    """Whether a version passes its gates; null where something isn't measured. metrics: conserved, notes_conserved, failing (of its invariants)."""
    ok = F.when(F.col("conserved").isNull() | F.col("failing").isNull(), F.lit(None).cast("boolean")).otherwise((F.col("conserved") >= 99.99) & (F.coalesce("notes_conserved", F.lit(100.0)) >= 100.0) & (F.col("failing") == 0))
    health = F.when(ok.isNull() & F.col("failing").isNull(), "unmeasured").when(F.coalesce(ok, F.col("failing") == 0), "within_gate").otherwise("outside_gate")
    return metrics.withColumn("gate_ok", ok).withColumn("health", health)


def claimable(jobs: DataFrame, now: Column, timeout_seconds: int = 60) -> DataFrame:
    """Jobs in the order in which they can be claimed: queued ones that are due, and running ones whose heartbeat is late; those at their last attempt fail."""
    late = (F.col("state") == "running") & (F.unix_timestamp(now) - F.unix_timestamp("heartbeat_at") > timeout_seconds)
    due = (F.col("state") == "queued") & (F.col("available_at") <= now)
    action = F.when(late & (F.col("attempts") >= F.col("max_attempts")), "fail").when(late, "requeue").when(due, "claim")
    rows = jobs.withColumn("action", action).filter("action IS NOT NULL")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("action", "queue").orderBy("created_at", "id")))
