"""Queries over findings, labels and versions: lifecycle, triage, review state, timelines, diffs, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from statuta.catalog import query
from statuta.functions import text as T
from statuta.operators import relations as R
from statuta.sources.tables import findings, table, turns

FINDINGS = """(SELECT event_id AS finding_id, event_type AS detector, user_id AS document_id, value AS score, ts AS seen_at, props AS detail_json,
  CASE WHEN value >= 90 THEN 'error' WHEN value >= 50 THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN event_id % 7 = 0 THEN 'fixed' WHEN event_id % 5 = 0 THEN 'parse_bug' ELSE 'new' END AS triage FROM events)"""
RISK = "CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"


@query("upsert_findings", f"""
    WITH k AS (SELECT detector || ':' || CAST(document_id AS VARCHAR) AS fingerprint, * FROM {FINDINGS}),
    p AS (SELECT fingerprint, arg_min(severity, {RISK}) AS severity, max(score) AS score, min(triage) AS triage, max(seen_at) AS seen_at, min(seen_at) AS first_seen FROM k WHERE finding_id < 5000 GROUP BY fingerprint),
    r AS (SELECT fingerprint, arg_min(severity, {RISK}) AS severity, max(score) AS score, max(seen_at) AS seen_at FROM k WHERE finding_id >= 5000 GROUP BY fingerprint)
    SELECT fingerprint, CASE WHEN p.triage IS NULL THEN 'inserted' WHEN r.seen_at IS NOT NULL THEN 'refreshed' WHEN p.triage = 'new' THEN 'closed' ELSE 'kept' END AS state,
      CASE WHEN p.triage IS NULL THEN 'new' WHEN r.seen_at IS NULL AND p.triage = 'new' THEN 'fixed' ELSE p.triage END AS triage,
      coalesce(r.severity, p.severity) AS severity, coalesce(r.score, p.score) AS score, coalesce(p.first_seen, r.seen_at) AS first_seen, coalesce(r.seen_at, p.seen_at) AS last_seen
    FROM p FULL JOIN r USING (fingerprint)""")
def upsert_findings(spark, sf_dir):
    rows = findings(spark, sf_dir).withColumn("fingerprint", F.concat_ws(":", "detector", "document_id"))
    prior = rows.filter("finding_id < 5000").groupBy("fingerprint").agg(R.worst("severity").alias("severity"), F.max("score").alias("score"), F.min("triage").alias("triage"), F.max("seen_at").alias("seen_at"), F.min("seen_at").alias("first_seen"))
    run = rows.filter("finding_id >= 5000").groupBy("fingerprint").agg(R.worst("severity").alias("severity"), F.max("score").alias("score"), F.max("seen_at").alias("seen_at"))
    return R.upsert_findings(prior, run)


@query("seed_findings", f"SELECT DISTINCT doc_id, 'quality_low' AS detector, 'warning' AS severity, CAST(0.5 AS DOUBLE) AS score FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT document_id FROM {FINDINGS} WHERE detector = 'click')")
def seed_findings(spark, sf_dir):
    known = findings(spark, sf_dir).filter("detector = 'click'").select(F.col("document_id").alias("doc_id"))
    return table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct().join(known, "doc_id", "left_anti").select("doc_id", F.lit("quality_low").alias("detector"), F.lit("warning").alias("severity"), F.lit(0.5).alias("score"))


def _queue(name: str, order_sql: str, order):
    @query(f"findings_queue_{name}", f"SELECT finding_id, severity, score, place FROM (SELECT finding_id, severity, score, row_number() OVER (ORDER BY {order_sql}, finding_id) AS place FROM {FINDINGS} WHERE triage = 'new') WHERE place <= 100")
    def queue(spark, sf_dir):
        rows = findings(spark, sf_dir).filter("triage = 'new'")
        return R.page(rows, [*order, F.col("finding_id")], 0, 100).select("finding_id", "severity", "score", "place")

    return queue


def _late(c):
    return lambda: F.desc_nulls_last(c)


class _Order(list):
    """Sort columns, made when they are asked for: no session exists at import."""

    def __iter__(self):
        return iter([f() for f in list.__iter__(self)])


_queue("risk", f"{RISK}, score DESC NULLS LAST", _Order([lambda: R.risk_rank(F.col("severity")), _late("score")]))
_queue("score", "score DESC NULLS LAST", _Order([_late("score")]))
_queue("newest", "seen_at DESC NULLS LAST", _Order([_late("seen_at")]))


@query("next_finding", f"SELECT finding_id, severity, score FROM {FINDINGS} WHERE triage = 'new' AND finding_id NOT IN (3, 8, 11) ORDER BY {RISK}, score DESC NULLS LAST, finding_id LIMIT 1")
def next_finding(spark, sf_dir):
    rows = findings(spark, sf_dir).filter((F.col("triage") == "new") & ~F.col("finding_id").isin(3, 8, 11))
    return rows.orderBy(R.risk_rank(F.col("severity")), F.desc_nulls_last("score"), "finding_id").limit(1).select("finding_id", "severity", "score")


@query("findings_filter", f"SELECT finding_id, detector FROM {FINDINGS} WHERE severity = 'warning' AND (detector ILIKE '%c%' OR detail_json ILIKE '%87%') AND triage <> 'fixed'")
def findings_filter(spark, sf_dir):
    return findings(spark, sf_dir).filter((F.col("severity") == "warning") & (F.col("detector").ilike("%c%") | F.col("detail_json").ilike("%87%")) & (F.col("triage") != "fixed")).select("finding_id", "detector")


@query("triage_histogram", f"SELECT detector, triage, count(*) AS n FROM {FINDINGS} GROUP BY detector, triage")
def triage_histogram(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("detector", "triage").agg(F.count("*").alias("n"))


@query("triage_normalize", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'parse_bug' WHEN 1 THEN 'not_a_defect' WHEN 2 THEN 'source_defect' WHEN 3 THEN 'new' END AS triage FROM events")
def triage_normalize(spark, sf_dir):
    raw = F.element_at(F.array(F.lit("Accepted"), F.lit(" dismissed "), F.lit("SOURCE-defect"), F.lit(None).cast("string"), F.lit("maybe")), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.triage(raw).alias("triage"))


@query("detector_coverage", f"SELECT detector, count(*) AS findings, count(*) FILTER (triage = 'fixed') AS stale, count(DISTINCT document_id) AS documents, max(seen_at) AS last_seen FROM {FINDINGS} GROUP BY detector")
def detector_coverage(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("detector").agg(F.count("*").alias("findings"), F.count_if(F.col("triage") == "fixed").alias("stale"), F.count_distinct("document_id").alias("documents"), F.max("seen_at").alias("last_seen"))


@query("system_totals", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM events) AS findings, (SELECT count(*) FROM labels) AS reviews, (SELECT count(DISTINCT conv_id) FROM conversations) AS versions")
def system_totals(spark, sf_dir):
    names = {"documents": "documents", "pages": "pages", "events": "findings", "labels": "reviews", "conversations": "versions"}
    number = {t: F.count_distinct("conv_id") if t == "conversations" else F.count("*") for t in names}
    counts = [table(spark, sf_dir, t).agg(number[t].alias("n")).select(F.lit(n).alias("name"), "n") for t, n in names.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.union(one)
    return out.agg(*(F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in names.values()))


@query("detail_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def detail_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter("k IS NOT NULL")


@query("effective_status", """
    WITH e AS (SELECT user_id AS doc_id, count(*) AS open_notes FROM events WHERE event_type = 'error' GROUP BY user_id)
    SELECT d.doc_id, CASE WHEN l.toxic = 1 OR e.open_notes > 0 THEN 'blocked' WHEN l.quality = 1 THEN 'approved' WHEN l.doc_id IS NOT NULL THEN 'in_progress' ELSE 'pending' END AS status,
      CAST(coalesce(l.toxic, 0) AS INTEGER) AS toxic, coalesce(e.open_notes, 0) AS open_notes
    FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN e USING (doc_id)""")
def effective_status(spark, sf_dir):
    notes = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("open_notes"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").join(notes, "doc_id", "left")
    status = F.when((F.col("toxic") == 1) | (F.col("open_notes") > 0), "blocked").when(F.col("quality") == 1, "approved").when(F.col("quality").isNotNull(), "in_progress").otherwise("pending")
    return rows.select("doc_id", status.alias("status"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("open_notes", F.lit(0)).alias("open_notes"))


@query("timeline_runs", """
    WITH f AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
    r AS (SELECT *, sum(CASE WHEN prev = role THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f)
    SELECT conv_id AS document_id, CAST(run AS BIGINT) AS run, CASE WHEN run = 1 THEN 'first' WHEN count(*) > 1 THEN 'unchanged' ELSE 'changed' END AS kind, count(*) AS editions, min(turn) AS from_edition, max(turn) AS to_edition FROM r GROUP BY conv_id, run""")
def timeline_runs(spark, sf_dir):
    return R.timeline(turns(spark, sf_dir), "document_id", "version_no", "role")


@query("leaf_diff", """
    WITH o AS (SELECT conv_id, turn, text FROM conversations), n AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE turn > (SELECT min(turn) FROM conversations))
    SELECT conv_id AS document_id, turn AS version_no, CASE WHEN o.text IS NULL THEN 'added' WHEN n.text IS NULL THEN 'removed' WHEN o.text = n.text THEN 'unchanged' ELSE 'changed' END AS change, sha256(coalesce(o.text, '')) AS old_sha, sha256(coalesce(n.text, '')) AS new_sha
    FROM o FULL JOIN n USING (conv_id, turn)""")
def leaf_diff(spark, sf_dir):
    rows = turns(spark, sf_dir)
    first = rows.agg(F.min("version_no").alias("first"))
    new = rows.join(F.broadcast(first), F.col("version_no") > F.col("first")).withColumn("version_no", F.col("version_no") - 1)
    sha = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    return R.keyed_diff(rows, new, ["document_id", "version_no"], "text").select("document_id", "version_no", "change", sha("old_value").alias("old_sha"), sha("new_value").alias("new_sha"))


@query("version_active", "SELECT conv_id AS document_id, max(turn) AS active_version, max(turn) + 1 AS next_version, count(*) AS versions FROM conversations GROUP BY conv_id")
def version_active(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("document_id").agg(F.max("version_no").alias("active_version"), (F.max("version_no") + 1).alias("next_version"), F.count("*").alias("versions"))


@query("overlay_replay", """
    SELECT b.item_id, CASE WHEN d.doc_id IS NULL THEN 'stale' WHEN d.text = b.text THEN 'superseded' WHEN NOT contains(d.text, b.text) THEN 'stale' ELSE 'applied' END AS state FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id""")
def overlay_replay(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("now"))
    rows = table(spark, sf_dir, "benchmark").join(docs, "item_id", "left")
    return rows.select("item_id", F.when(F.col("now").isNull(), "stale").when(F.col("now") == F.col("text"), "superseded").when(~F.contains("now", "text"), "stale").otherwise("applied").alias("state"))


@query("word_delta", """
    WITH w AS (SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS BIGINT) AS words FROM conversations)
    SELECT conv_id, turn, words, words - lag(words) OVER (PARTITION BY conv_id ORDER BY turn) AS delta FROM w""")
def word_delta(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_count("text", F.lit(r"[^ \t\r\n]+")).cast("long").alias("words"))
    return rows.withColumn("delta", F.col("words") - F.lag("words").over(Window.partitionBy("conv_id").orderBy("turn")))


@query("tumbling_events", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_events(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("session_windows", """
    WITH g AS (SELECT user_id, ts, event_id, lag(ts) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session""")
def session_windows(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.lag("ts").over(w).alias("prev"))
    new = F.when(F.col("prev").isNull() | (F.col("ts") - F.col("prev") > F.expr("INTERVAL 30 MINUTE")), 1).otherwise(0)
    rows = rows.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("rate_limit_windows", """
    WITH k AS (SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS n FROM events)
    SELECT event_id, user_id, n, n > 2 AS limited FROM k""")
def rate_limit_windows(spark, sf_dir):
    """Requests of the same client in the hour up to each; over two are refused."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-3_600_000_000, 0)
    return table(spark, sf_dir, "events").withColumn("at", at).select("event_id", "user_id", F.count("*").over(w).alias("n")).withColumn("limited", F.col("n") > 2)


@query("retry_backoff", "SELECT event_id, CAST(least(60, power(2, event_id % 9)) AS BIGINT) AS seconds FROM events")
def retry_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.least(F.lit(60), F.pow(F.lit(2), F.col("event_id") % 9)).cast("long").alias("seconds"))


@query("bulk_triage_conflicts", f"SELECT finding_id, triage AS current_triage, triage <> 'new' AS conflict FROM {FINDINGS} WHERE finding_id % 11 = 0")
def bulk_triage_conflicts(spark, sf_dir):
    """Requests that expect triage new, held against the current state."""
    rows = findings(spark, sf_dir)
    return conflicts(rows.filter("finding_id % 11 = 0"), rows)


@query("bulk_triage_conflicts_all", f"SELECT finding_id, triage AS current_triage, triage <> 'new' AS conflict FROM {FINDINGS}")
def bulk_triage_conflicts_all(spark, sf_dir):
    """bulk_triage_conflicts with a request for each finding."""
    rows = findings(spark, sf_dir)
    return conflicts(rows, rows)


def conflicts(asked, rows):
    requests = asked.select("finding_id", F.lit("new").alias("expected"))
    return requests.join(rows.select("finding_id", "triage"), "finding_id").select("finding_id", F.col("triage").alias("current_triage"), (F.col("triage") != F.col("expected")).alias("conflict"))
