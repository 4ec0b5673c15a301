"""The library of documents: orders, metrics of versions, coverage of collector pages, leases, evidence, reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.operators import relations as R

#: Fixed value: the format of evidence bundles.
BUNDLE = "crx-evidence-v1"


def document_order(sort: str) -> list[Column]:
    """Sort columns of the documents' list: name, newest, pages, health, completion or risk, names last."""
    name = F.lower("name")
    health = F.when(F.col("health") == "outside_gate", 0).when(F.col("health") == "within_gate", 1).otherwise(2)
    done = F.when(F.col("total") > 0, F.col("reviewed") / F.col("total")).otherwise(0.0)
    orders = {"name": [], "newest": [F.desc_nulls_last("uploaded_at")], "pages": [F.coalesce("pages", F.lit(0)).desc()], "health": [health.asc()], "completion": [done.desc()], "risk": [F.coalesce("has_issues", F.lit(0)).desc()]}
    return [*orders[sort], name, F.col("id")]


def finding_order(sort: str) -> list[Column]:
    """Sort columns of the findings' queue: risk, score, blast (leaves of the same text), page or newest, ids last."""
    score = F.desc_nulls_last("score")
    orders = {"risk": [R.risk_rank(F.col("severity")).asc(), score], "score": [score], "blast": [F.greatest(F.coalesce("radius", F.lit(1)), F.lit(1)).desc(), score], "page": [F.asc_nulls_last("start_page"), F.lower("name")], "newest": [F.desc("seen_at")]}
    return [*orders[sort], F.col("finding_id")]


def upload_order(pending: DataFrame, threshold: int) -> DataFrame:
    """pending (size, name) with lane and place: risky ones, of threshold bytes or more, the largest first; then the others, the smallest first."""
    risky = F.col("size") >= threshold
    lane = F.when(risky, "risky").otherwise("rest")
    w = Window.partitionBy("lane").orderBy(F.when(risky, -F.col("size")).otherwise(F.col("size")), F.when(risky, F.lit(None)).otherwise(F.col("name")), F.desc("name"))
    return pending.withColumn("lane", lane).withColumn("place", F.row_number().over(w).cast("long"))


def joined_metrics(invariants: DataFrame, conservation: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Measurements of each active version, and the stems that have none.

    invariants: stem, passed, total. conservation: stem, conserved, gate_ok. versions: stem, version_id. The gate is both: text
    conserved and all invariants passed; where a report lacks a stem its side is null.
    """
    both = invariants.join(conservation, "stem", "full_outer")
    ok = F.when(F.col("gate_ok").isNotNull() & F.col("passed").isNotNull(), F.col("gate_ok") & (F.col("passed") == F.col("total"))).otherwise(F.col("gate_ok"))
    placed = both.withColumn("gate_ok", ok).join(versions, "stem", "left")
    return placed.filter("version_id IS NOT NULL").drop("stem"), placed.filter("version_id IS NULL").select("stem")


def upserted(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of known whose key new lacks."""
    return new.unionByName(known.join(new.select(key), key, "left_anti"))


def collector_cover(pages: DataFrame, leaves: DataFrame, by: str) -> DataFrame:
    """leaves with end_page, that of the last leaf of each run of body pages extended over the pages of notes alone that follow.

    pages: by, page, has_body, has_notes. leaves: by, leaf, start_page, end_page. A run ends before a page with body that comes
    after a page with notes.
    """
    w = Window.partitionBy(by).orderBy("page")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    # notes since the run began: a body page opens a new run if the page before it, or one since the last body page, has notes
    rows = pages.withColumn("bodies", F.count_if("has_body").over(w)).withColumn("noted", F.coalesce(F.max(F.when(F.col("has_notes"), F.col("page"))).over(upto), F.lit(-1))).withColumn("body_before", F.coalesce(F.max(F.when(F.col("has_body"), F.col("page"))).over(upto), F.lit(-1)))
    opens = F.col("has_body") & (F.col("noted") >= F.greatest("body_before", F.lit(0))) & (F.col("noted") >= 0)
    rows = rows.withColumn("run", F.count_if(opens).over(w))
    bodied = F.when(F.col("has_body"), F.col("page"))
    runs = rows.groupBy(by, "run").agg(F.min(bodied).alias("first"), F.max(bodied).alias("last"), F.max(F.when(F.col("has_notes") & ~F.col("has_body"), F.col("page"))).alias("notes"))
    runs = runs.filter("first IS NOT NULL AND notes > last")
    hit = leaves.join(runs, by).filter(F.col("start_page").between(F.col("first"), F.col("last")))
    latest = hit.groupBy(by, "run", "notes").agg(F.max_by("leaf", F.struct("start_page", "end_page", "leaf")).alias("leaf")).select(by, "leaf", "notes")
    return leaves.join(latest, [by, "leaf"], "left").withColumn("end_page", F.greatest("end_page", F.coalesce("notes", F.col("end_page")))).drop("notes")


def lease(held: DataFrame, asked: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Requests with granted and until. held: finding_id, actor, session, expires_at. asked: finding_id, actor, session. A lease that runs is refused to others and renewed for its holder."""
    h, a = held.alias("h"), asked.alias("a")
    other = (F.col("h.actor") != F.col("a.actor")) | (F.col("h.session") != F.col("a.session"))
    taken = F.coalesce((F.col("h.expires_at") > now) & other, F.lit(False))
    until = F.when(taken, F.col("h.expires_at")).otherwise(now + F.expr(f"INTERVAL {minutes} MINUTES"))
    return a.join(h, F.col("a.finding_id") == F.col("h.finding_id"), "left").select("a.finding_id", "a.actor", "a.session", (~taken).alias("granted"), until.alias("until"))


def alive(heartbeats: DataFrame, now: Column, seconds: int = 30) -> DataFrame:
    """worker, last heartbeat, and whether it is no older than seconds."""
    by = heartbeats.groupBy("worker").agg(F.max("heartbeat_at").alias("last"))
    return by.withColumn("alive", F.unix_micros("last") >= F.unix_micros(now) - seconds * 1_000_000)


def unreferenced(blobs: DataFrame, *references: DataFrame) -> DataFrame:
    """Blobs (name) that no reference (name) holds."""
    used = references[0].select("name")
    for r in references[1:]:
        used = used.union(r.select("name"))
    return blobs.join(used, "name", "left_anti")


def bound_sql(spark: SparkSession, sql: str, values: list) -> DataFrame:
    """A statement with ? for each value; those in quotes are none."""
    return spark.sql(sql, args=values)


def evidence(documents: DataFrame, parts: dict[str, tuple[DataFrame, list[str]]], key: str, at: datetime | None = None) -> DataFrame:
    """key, manifest (JSON of the document and its parts, each part's rows in its order), sha256 and bytes. A part's rows of one document are one array."""
    out = documents.select(key, F.struct(*documents.columns).alias("document"))
    for name, (rows, order) in parts.items():
        columns = [*order, *(c for c in rows.columns if c not in (key, *order))]
        held = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(held, key, "left").withColumn(name, F.coalesce(name, F.array().cast(held.schema[name].dataType)))
    fields = [F.lit(BUNDLE).alias("format"), *([F.lit(at.isoformat()).alias("generated_at")] if at else []), "document", *parts]
    text = F.to_json(F.struct(*fields))
    return out.select(key, text.alias("manifest")).select(key, "manifest", F.sha2("manifest", 256).alias("sha256"), F.octet_length("manifest").alias("bytes"))


def write_snapshot(rows: DataFrame, path: str) -> None:
    """Review state as JSON lines; an empty snapshot is refused."""
    if not rows.limit(1).count():
        raise ValueError("nothing to snapshot")
    rows.write.mode("errorifexists").json(path)


def report_lines(counts: DataFrame, title: str, label: str, value: str) -> DataFrame:
    """A Markdown table of a run: title, head and a line for each row, in the order of labels. counts is small: a row for each label."""
    row = F.concat(F.lit("| "), F.col(label).cast("string"), F.lit(" | "), F.col(value).cast("string"), F.lit(" |"))
    head = counts.sparkSession.createDataFrame([(0, f"# {title}"), (1, ""), (2, f"| {label} | {value} |"), (3, "|---|---|")], "n long, value string")
    lines = counts.select((F.row_number().over(Window.orderBy(label)) + 3).cast("long").alias("n"), row.alias("value"))
    return head.union(lines).orderBy("n")


def revoked(approvals: DataFrame, changed: DataFrame, key: str, origin: str) -> DataFrame:
    """Approvals that fall when texts change: those of changed leaves, and those that were inherited from or by one. approvals: key, origin (null if its own)."""
    ids = changed.select(F.col(key).alias("changed_id")).distinct()
    hit = lambda c: approvals.join(ids, F.col(c) == F.col("changed_id"), "left_semi")
    return hit(key).union(hit(origin)).distinct()


def activated(versions: DataFrame, document: str, number: str, chosen: DataFrame) -> DataFrame:
    """versions with is_active: of each document the chosen version, if it exists; documents without a choice keep theirs. chosen: document, wanted."""
    held = versions.join(chosen, document, "left").withColumn("__hit", F.max((F.col(number) == F.col("wanted")).cast("int")).over(Window.partitionBy(document)))
    active = F.when(F.coalesce("__hit", F.lit(0)) == 1, F.col(number) == F.col("wanted")).otherwise(F.col("is_active"))
    return held.withColumn("is_active", active).drop("wanted", "__hit")


def family_of(asked: DataFrame, variants: DataFrame, names: DataFrame) -> DataFrame:
    """family and its resolution for each asked code: the stored family of that name; else the least stored one whose document's name has the asked family. asked: asked_id, family, code. variants: family, code, document. names: document, family."""
    stored = variants.select(F.col("family").alias("stored"), "code").distinct()
    direct = asked.join(stored, (F.col("family") == F.col("stored")) & (asked["code"] == stored["code"]), "left").select("asked_id", "family", asked["code"], "stored")
    by_name = variants.join(names.withColumnRenamed("family", "named"), "document").groupBy("named", "code").agg(F.min("family").alias("bridged"))
    d = direct.alias("d")
    both = d.join(by_name.alias("n"), (F.col("d.family") == F.col("n.named")) & (F.col("d.code") == F.col("n.code")), "left")
    how = F.when(F.col("stored").isNotNull(), "stored").when(F.col("bridged").isNotNull(), "by_name").otherwise("unknown")
    return both.select("asked_id", F.coalesce("stored", "bridged", "d.family").alias("family"), how.alias("resolution"))
