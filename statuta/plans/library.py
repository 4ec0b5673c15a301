"""Queries over the library: documents are customers, leaves orders, notes line items, findings events, versions conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from statuta.catalog import query
from statuta.functions import headings as H
from statuta.functions import python as P
from statuta.functions import text as T
from statuta.operators import library as L
from statuta.operators import merge as M
from statuta.operators import relations as R
from statuta.operators.joins import small
from statuta.plans.review import FINDINGS, RISK
from statuta.session import ship
from statuta.sources.tables import findings, table

DOCUMENTS = """(SELECT c_custkey AS id, c_name AS name, c_nationkey AS pages, CASE WHEN c_acctbal < 0 THEN 'outside_gate' WHEN c_acctbal < 5000 THEN 'within_gate' ELSE 'unmeasured' END AS health, last AS uploaded_at, coalesce(total, 0) AS total, coalesce(reviewed, 0) AS reviewed, coalesce(has_issues, 0) AS has_issues
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last, count(*) AS total, count(*) FILTER (o_orderstatus <> 'O') AS reviewed, count(*) FILTER (o_orderstatus = 'P') AS has_issues FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"""


def documents(spark, sf_dir):
    of = lambda c: F.count_if(c)
    stats = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("uploaded_at"), F.count("*").alias("total"), of(F.col("o_orderstatus") != "O").alias("reviewed"), of(F.col("o_orderstatus") == "P").alias("has_issues"))
    health = F.when(F.col("c_acctbal") < 0, "outside_gate").when(F.col("c_acctbal") < 5000, "within_gate").otherwise("unmeasured")
    rows = table(spark, sf_dir, "customer").join(stats, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("pages"), health.alias("health"), "uploaded_at", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "reviewed", "has_issues")))


SORTS = {
    "name": "lower(name), id", "newest": "uploaded_at DESC NULLS LAST, lower(name), id", "pages": "pages DESC, lower(name), id", "health": "CASE health WHEN 'outside_gate' THEN 0 WHEN 'within_gate' THEN 1 ELSE 2 END, lower(name), id",
    "completion": "CASE WHEN total > 0 THEN reviewed / total ELSE 0 END DESC, lower(name), id", "risk": "has_issues DESC, lower(name), id",
}


@query("library_sorts", " UNION ALL ".join(f"SELECT '{n}' AS sort, id, place FROM (SELECT id, row_number() OVER (ORDER BY {o}) AS place FROM {DOCUMENTS}) WHERE place <= 40" for n, o in SORTS.items()))
def library_sorts(spark, sf_dir):
    """The first page of the documents' list in each of its orders."""
    rows = documents(spark, sf_dir)
    return reduce(lambda a, b: a.union(b), [R.page(rows, L.document_order(s), 0, 40).select(F.lit(s).alias("sort"), "id", "place") for s in SORTS])


@query("findings_sorts", f"""
    WITH v AS (SELECT md5(coalesce(props, '')) AS variant, count(*) AS radius FROM events GROUP BY 1), f AS (SELECT f.*, radius, c_nationkey AS start_page, coalesce(c_name, '') AS name FROM {FINDINGS} f JOIN v ON md5(coalesce(detail_json, '')) = variant LEFT JOIN customer ON c_custkey = document_id)
    SELECT 'blast' AS sort, finding_id, place FROM (SELECT finding_id, row_number() OVER (ORDER BY greatest(coalesce(radius, 1), 1) DESC, score DESC NULLS LAST, finding_id) AS place FROM f) WHERE place <= 60
    UNION ALL SELECT 'page', finding_id, place FROM (SELECT finding_id, row_number() OVER (ORDER BY start_page NULLS LAST, lower(name), finding_id) AS place FROM f) WHERE place <= 60""")
def findings_sorts(spark, sf_dir):
    """The queue by how many findings share a text, and by page."""
    rows = findings(spark, sf_dir).withColumn("variant", F.md5(F.coalesce("detail_json", F.lit(""))))
    radius = rows.groupBy("variant").agg(F.count("*").alias("radius"))
    leaf = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("start_page"), "c_name")
    rows = rows.join(radius, "variant").join(leaf, "document_id", "left").withColumn("name", F.coalesce("c_name", F.lit("")))
    return R.page(rows, L.finding_order("blast"), 0, 60).select(F.lit("blast").alias("sort"), "finding_id", "place").union(R.page(rows, L.finding_order("page"), 0, 60).select(F.lit("page").alias("sort"), "finding_id", "place"))


@query("findings_joined", f"SELECT finding_id, o_orderkey, c_name, place FROM (SELECT finding_id, o_orderkey, c_name, row_number() OVER (ORDER BY score DESC, seen_at DESC, finding_id) AS place FROM {FINDINGS} JOIN orders ON o_orderkey = finding_id JOIN customer ON c_custkey = document_id) WHERE place <= 200")
def findings_joined(spark, sf_dir):
    """Findings with leaf and document, the highest scores first."""
    leaves = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"), "o_orderkey")
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), "c_name")
    rows = findings(spark, sf_dir).join(leaves, "finding_id").join(docs, "document_id")
    return R.page(rows, [F.desc("score"), F.desc("seen_at"), F.col("finding_id")], 0, 200).select("finding_id", "o_orderkey", "c_name", "place")


@query("editions_in_order", "SELECT o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE year(o_orderdate) END NULLS LAST, 'Act' || o_orderpriority, o_orderkey) AS place FROM orders)")
def editions_in_order(spark, sf_dir):
    """Editions of a statute, the oldest first, those without a year last."""
    dated = F.when(F.col("o_orderkey") % 4 == 0, "undated").otherwise(F.concat(F.lit("Act, as amended upto 30.06."), F.year("o_orderdate").cast("string")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", H.edition_date(dated).alias("e"), F.concat(F.lit("Act"), "o_orderpriority").alias("name"))
    return rows.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("e.year").asc_nulls_last(), "name", "o_orderkey")).cast("long").alias("place"))


@query("edition_dates", """
    SELECT o_orderkey, y AS year, coalesce(y, 9999) AS sort_key, coalesce(CAST(y AS VARCHAR), 'year unknown') AS label
    FROM (SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN year(o_orderdate) WHEN 1 THEN 2000 + year(o_orderdate) % 100 WHEN 2 THEN year(o_orderdate) WHEN 3 THEN 2007 WHEN 4 THEN 1969 END AS INTEGER) AS y FROM orders)""")
def edition_dates(spark, sf_dir):
    year = F.year("o_orderdate").cast("string")
    j = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    key = F.col("o_orderkey") % 6
    name = F.when(key == 0, j("Customs Act, 1969 (as amended upto 30.06.", year, ")")).when(key == 1, j("Act 1990 dated 1/7/", F.substring(year, 3, 2))).when(key == 2, j("Rules 1940 as on June ", year)).when(key == 3, F.lit("Budget 2007-08 of 1990")).when(key == 4, F.lit("Customs Act, 1969 and 1970")).otherwise(F.lit("Act No. 12345"))
    return table(spark, sf_dir, "orders").select("o_orderkey", H.edition_date(name).alias("e")).select("o_orderkey", "e.year", "e.sort_key", "e.label")


@query("upload_order", "SELECT id, lane, row_number() OVER (PARTITION BY lane ORDER BY CASE WHEN lane = 'risky' THEN -size ELSE size END, CASE WHEN lane = 'risky' THEN NULL ELSE name END, name DESC) AS place FROM (SELECT p_partkey AS id, p_size AS size, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS name, CASE WHEN p_size >= 40 THEN 'risky' ELSE 'rest' END AS lane FROM part)")
def upload_order(spark, sf_dir):
    pending = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("name"))
    return L.upload_order(pending, 40).select("id", "lane", "place")


@query("review_facets", f"""
    WITH d AS (SELECT *, CASE WHEN total <= 0 OR reviewed <= 0 THEN 'untouched' WHEN reviewed >= total THEN 'complete' ELSE 'in_progress' END AS review FROM {DOCUMENTS})
    SELECT 'review' AS facet, review AS value, count(*) AS n FROM d GROUP BY review UNION ALL SELECT 'health', health, count(*) FROM d GROUP BY health UNION ALL SELECT 'flagged', CAST(has_issues > 0 AS VARCHAR), count(*) FROM d GROUP BY ALL
    UNION ALL SELECT 'lane', CASE WHEN c_mktsegment = 'BUILDING' THEN 'customs' WHEN c_mktsegment = 'MACHINERY' THEN 'sales_tax_rules' ELSE 'manual' END, count(*) FROM customer GROUP BY ALL UNION ALL SELECT 'status', CASE WHEN total = 0 OR total - reviewed = total THEN 'pending' WHEN has_issues > 0 THEN 'blocked' WHEN total = reviewed THEN 'approved' ELSE 'in_progress' END, count(*) FROM d GROUP BY ALL""")
def review_facets(spark, sf_dir):
    """Documents by lane, health, review, flag and status, in one pass."""
    segment = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    rows = documents(spark, sf_dir).join(segment, "id")
    title = F.when(F.col("c_mktsegment") == "BUILDING", "Customs Act, 1969").when(F.col("c_mktsegment") == "MACHINERY", "Sales Tax Rules, 2006").otherwise("notes")
    kind = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "acts_corpus").otherwise("upload")
    facets = {"review": H.review_facet(F.col("total"), F.col("reviewed")), "health": F.col("health"), "flagged": (F.col("has_issues") > 0).cast("string"), "lane": T.lane(title, kind, F.lit(None).cast("string")), "status": H.document_status(F.col("total"), F.col("total") - F.col("reviewed"), F.col("has_issues"))}
    each = F.array(*(F.struct(F.lit(n).alias("facet"), v.alias("value")) for n, v in facets.items()))
    return rows.select(F.explode(each).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


@query("page_cursors", """SELECT c_custkey, rtrim(translate(to_base64(encode('{"offset":' || c_custkey || ',"filter":"' || c_mktsegment || '"}')), '+/', '-_'), '=') AS cursor, c_custkey AS own, CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey END AS building, CAST(0 AS BIGINT) AS none, CAST(NULL AS BIGINT) AS broken FROM customer""")
def page_cursors(spark, sf_dir):
    """Cursors, and what they say under their own filter, under another, without one and when damaged."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", H.cursor(F.col("c_custkey"), F.col("c_mktsegment")).alias("cursor"))
    at = lambda text, filter: H.cursor_offset(text, filter)
    return rows.select("c_custkey", "cursor", at(F.col("cursor"), F.col("c_mktsegment")).alias("own"), at(F.col("cursor"), F.lit("BUILDING")).alias("building"), at(F.lit(""), F.lit("x")).alias("none"), at(F.concat(F.lit("!"), "cursor"), F.col("c_mktsegment")).alias("broken"))


PAGES_READ = "(SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS ocr, CASE l_orderkey % 9 WHEN 0 THEN 'mixed-ocr' WHEN 1 THEN 'other' END AS said, count(*) FILTER (l_linestatus = 'F') AS doubtful FROM lineitem GROUP BY l_orderkey)"


@query("provenance", f"""
    SELECT l_orderkey, kind, array_to_string(list_filter([kind, CASE WHEN l_orderkey % 4 = 0 OR l_orderkey % 5 = 0 THEN 'ocr-provisional' END, CASE WHEN doubtful > 0 THEN 'ocr-needs-review' END], lambda x: x IS NOT NULL), ',') AS tags
    FROM (SELECT *, CASE WHEN said = 'mixed-ocr' THEN said WHEN ocr < 1 THEN 'native-digital' WHEN ocr / total >= 0.9 THEN 'scanned-ocr' ELSE 'mixed-ocr' END AS kind FROM {PAGES_READ})""")
def provenance(spark, sf_dir):
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("ocr"), F.count_if(F.col("l_linestatus") == "F").alias("doubtful"))
    key = F.col("l_orderkey")
    said = F.when(key % 9 == 0, "mixed-ocr").when(key % 9 == 1, "other")
    kind = H.source_kind(F.col("ocr"), F.col("total"), said)
    tags = H.provenance_tags(kind, F.when(key % 4 == 0, True), F.when(key % 5 == 0, " provisional "), F.col("doubtful"))
    return by.select("l_orderkey", kind.alias("kind"), F.array_join(tags, ",").alias("tags"))


RAW_FLAGS = ["missing_table", '["wall_of_text"," x ",null,""]', '[{"code":"footnote_glue","message":"m"},{"reason":"r"},{}]', '{"flag":"heading_body_bleed"}', " ", '5', '"quoted"']


@query("quality_flag_entries", """
    WITH r(k, code, reason, critical) AS (VALUES (0, 'missing_table', 'Mentions a table but HTML has no <table>', true), (1, 'wall_of_text', 'Long body with almost no block structure (heading-only / wall of text)', true), (1, 'x', 'Parse quality issue: x', false),
      (2, 'footnote_glue', 'm', true), (2, 'quality', 'r', false), (3, 'heading_body_bleed', 'Heading looks like body text bled into the heading', true))
    SELECT event_id, code, reason, critical FROM events JOIN r ON event_id % 8 = k""")
def quality_flag_entries(spark, sf_dir):
    """Flags as they are stored, in any of their forms, as codes and reasons."""
    raw = F.when(F.col("event_id") % 8 < 7, F.element_at(F.array(*map(F.lit, [*RAW_FLAGS, ""])), (F.col("event_id") % 8 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", F.explode(T.flag_entries(raw)).alias("f")).select("event_id", "f.code", "f.reason", "f.critical")


@query("metrics_delta", """
    WITH m AS (SELECT user_id, event_id, value, event_id % 7 AS passed, lag(value) OVER w AS before, lag(event_id % 7) OVER w AS passed_before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, 'invariants passing' AS label, CAST(passed - passed_before AS VARCHAR) AS delta, passed > passed_before AS better FROM m WHERE passed <> passed_before
    UNION ALL SELECT event_id, 'body conserved', CASE WHEN value > before THEN '+' ELSE '' END || printf('%.3f', value - before) || '%', value > before FROM m WHERE abs(value - before) >= 0.0005""")
def metrics_delta(spark, sf_dir):
    """What each version's measurements gained on the one before; a share that moves by less than the gate can tell is left out."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("passed", F.col("event_id") % 7)
    rows = rows.select("event_id", "value", "passed", F.lag("value").over(w).alias("before"), F.lag("passed").over(w).alias("passed_before"))
    return rows.select("event_id", F.explode(T.metric_changes({"invariants passing": (F.col("passed"), F.col("passed_before"))}, {"body conserved": (F.col("value"), F.col("before"))})).alias("d")).select("event_id", "d.label", "d.delta", "d.better")


@query("header_medians", "SELECT l_suppkey, median(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) AS header, median(CASE WHEN l_linenumber > 1 THEN l_extendedprice END) AS footer FROM lineitem GROUP BY l_suppkey")
def header_medians(spark, sf_dir):
    """Where a document's headers and footers stand: medians of their tops, the mean of the two in the middle where their number is even."""
    top = lambda c: F.median(F.when(c, F.col("l_extendedprice")))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(top(F.col("l_linenumber") == 1).alias("header"), top(F.col("l_linenumber") > 1).alias("footer"))


@query("sync_summary", """
    WITH s AS (SELECT o_custkey, count(*) AS sections FROM orders GROUP BY o_custkey)
    SELECT count(*) AS discovered, count(sections) AS validated, count(*) FILTER (sections IS NULL) AS failed, count(*) FILTER (c_custkey % 3 = 0 AND sections IS NOT NULL) AS added, count(*) FILTER (c_custkey % 3 = 1 AND sections IS NOT NULL) AS updated, count(*) FILTER (c_custkey % 3 = 2 AND sections IS NOT NULL) AS skipped, CAST(sum(sections) AS BIGINT) AS sections FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def sync_summary(spark, sf_dir):
    """Counts of one run: documents found, valid, failed, added, updated and skipped, and their leaves."""
    sections = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("sections"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(sections, "c_custkey", "left")
    valid = F.col("sections").isNotNull()
    did = lambda k: F.count_if(valid & (F.col("c_custkey") % 3 == k))
    return rows.agg(F.count("*").alias("discovered"), F.count("sections").alias("validated"), F.count_if(~valid).alias("failed"), did(0).alias("added"), did(1).alias("updated"), did(2).alias("skipped"), F.sum("sections").alias("sections"))


COVER_SQL = """
    WITH RECURSIVE p AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey % 3 <> 0 AS has_body, o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 AS has_notes FROM orders),
    r AS (SELECT doc, page, has_body, has_notes, CAST(0 AS BIGINT) AS run, has_notes AS noted FROM p WHERE page = 1
      UNION ALL SELECT p.doc, p.page, p.has_body, p.has_notes, r.run + CASE WHEN p.has_body AND r.noted THEN 1 ELSE 0 END, p.has_notes OR (r.noted AND NOT p.has_body) FROM r JOIN p ON p.doc = r.doc AND p.page = r.page + 1),
    g AS (SELECT doc, run, min(page) FILTER (has_body) AS lo, max(page) FILTER (has_body) AS hi, max(page) FILTER (has_notes AND NOT has_body) AS notes FROM r GROUP BY doc, run)
    SELECT p.doc, p.page AS leaf, greatest(p.page, CASE WHEN g.hi = p.page AND g.notes > g.hi THEN g.notes ELSE p.page END) AS end_page FROM p LEFT JOIN g ON g.doc = p.doc AND g.hi = p.page WHERE p.has_body"""


@query("collector_cover", COVER_SQL)
def collector_cover(spark, sf_dir):
    """Each body page is a leaf of its own here; the last of a run takes the pages of notes that follow."""
    key = F.col("o_orderkey")
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("page"), (key % 3 != 0).alias("has_body"), ((key % 3 == 0) | (key % 7 == 0)).alias("has_notes"))
    leaves = pages.filter("has_body").select("doc", F.col("page").alias("leaf"), F.col("page").alias("start_page"), F.col("page").alias("end_page"))
    return L.collector_cover(pages, leaves, "doc").select("doc", "leaf", "end_page")


_MEASURED = """
    WITH v AS (SELECT conv_id AS version_id, CAST(conv_id AS VARCHAR) AS stem FROM conversations GROUP BY conv_id), i AS (SELECT CAST(doc_id AS VARCHAR) AS stem, quality AS passed, 1 AS total FROM labels), c AS (SELECT CAST(event_id AS VARCHAR) AS stem, value AS conserved, value >= 50 AS gate_ok FROM events),
    b AS (SELECT coalesce(i.stem, c.stem) AS stem, passed, total, conserved, CASE WHEN gate_ok IS NOT NULL AND passed IS NOT NULL THEN gate_ok AND passed = total ELSE gate_ok END AS gate_ok FROM i FULL JOIN c ON i.stem = c.stem)"""


def _measured(spark, sf_dir):
    versions = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("version_id")).distinct().withColumn("stem", F.col("version_id").cast("string"))
    invariants = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("stem"), F.col("quality").alias("passed"), F.lit(1).alias("total"))
    conservation = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("stem"), F.col("value").alias("conserved"), (F.col("value") >= 50).alias("gate_ok"))
    return L.joined_metrics(invariants, conservation, versions)


@query("metrics_upsert", _MEASURED + """
    , n AS (SELECT version_id, conserved, gate_ok FROM b JOIN v USING (stem)), k AS (SELECT conv_id AS version_id, CAST(1.5 AS DOUBLE) AS conserved, false AS gate_ok FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id UNION ALL SELECT -1, 2.5, true)
    SELECT * FROM n UNION ALL SELECT * FROM k WHERE version_id NOT IN (SELECT version_id FROM n)""")
def metrics_upsert(spark, sf_dir):
    """New measurements over the known ones of the same version."""
    new, _ = _measured(spark, sf_dir)
    known = table(spark, sf_dir, "conversations").filter("conv_id % 2 = 0").select(F.col("conv_id").alias("version_id")).distinct().select("version_id", F.lit(1.5).alias("conserved"), F.lit(False).alias("gate_ok"))
    known = known.union(spark.createDataFrame([(-1, 2.5, True)], known.schema))
    return L.upserted(known, new.select("version_id", "conserved", "gate_ok"), "version_id")


@query("metrics_unmatched", _MEASURED + " SELECT b.stem FROM b LEFT JOIN v USING (stem) WHERE version_id IS NULL")
def metrics_unmatched(spark, sf_dir):
    return _measured(spark, sf_dir)[1]


#: So many characters of a report's family are met in names before the whole is sought.
REPORT_KEY = 8


@query("report_documents", "SELECT s_suppkey, min(c_custkey) AS document FROM supplier JOIN customer ON contains(lower(c_name), lower(ltrim(substr(s_name, 10), '0'))) AND ltrim(substr(s_name, 10), '0') <> '' GROUP BY s_suppkey")
def report_documents(spark, sf_dir):
    """The first document whose name contains a report's family.

    A family's first REPORT_KEY characters, or as many as it has, are met at any place of a name by an equal join; then the whole family is
    sought in the names that were met. Families are counted before they are broadcast.
    """
    reports = table(spark, sf_dir, "supplier").select("s_suppkey", F.lower(F.ltrim(F.substring("s_name", 10, 1 << 30), F.lit("0"))).alias("family")).filter("family <> ''")
    families = reports.select("family").distinct().withColumn("key", F.substring("family", 1, REPORT_KEY))
    lengths = [r[0] for r in families.select(F.char_length("key")).distinct().collect()]  # REPORT_KEY of them at most
    names = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_name").alias("name"))
    parts = lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("name") - n + 1)), lambda i: i + n <= F.char_length("name") + 1), lambda i: F.substring(F.col("name"), i, F.lit(n)))
    keys = names.select("c_custkey", "name", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *map(parts, lengths)))).alias("key"))
    met = keys.join(small(families), "key").filter((F.char_length("family") <= REPORT_KEY) | F.contains("name", "family"))
    return reports.join(met.groupBy("family").agg(F.min("c_custkey").alias("document")), "family").select("s_suppkey", "document").groupBy("s_suppkey").agg(F.min("document").alias("document"))


NOW = "2024-01-02 00:00:00"


@query("lease_claims", f"""
    WITH h AS (SELECT event_id AS finding_id, event_type AS actor, CAST(user_id AS VARCHAR) AS session, ts + INTERVAL 6 HOUR AS expires_at FROM events WHERE event_id % 2 = 0), a AS (SELECT event_id AS finding_id, CASE WHEN event_id % 4 = 0 THEN event_type ELSE 'me' END AS actor, CAST(user_id AS VARCHAR) AS session FROM events),
    j AS (SELECT a.*, h.expires_at, coalesce(h.expires_at > TIMESTAMP '{NOW}' AND (h.actor <> a.actor OR h.session <> a.session), false) AS taken FROM a LEFT JOIN h USING (finding_id))
    SELECT finding_id, NOT taken AS granted, CASE WHEN taken THEN expires_at ELSE TIMESTAMP '{NOW}' + INTERVAL 15 MINUTE END AS until FROM j""")
def lease_claims(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("finding_id"), "event_type", F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    held = events.filter("finding_id % 2 = 0").select("finding_id", F.col("event_type").alias("actor"), "session", (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("expires_at"))
    asked = events.select("finding_id", F.when(F.col("finding_id") % 4 == 0, F.col("event_type")).otherwise("me").alias("actor"), "session")
    return L.lease(held, asked, F.expr(f"TIMESTAMP_NTZ '{NOW}'")).select("finding_id", "granted", "until")


@query("workers_alive", "SELECT event_type AS worker, max(ts) AS last, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 30 SECOND AS alive FROM events GROUP BY event_type")
def workers_alive(spark, sf_dir):
    beats = table(spark, sf_dir, "events").select(F.col("event_type").alias("worker"), F.col("ts").cast("timestamp").alias("heartbeat_at"))
    now = beats.agg(F.max("heartbeat_at")).first()[0]
    return L.alive(beats, F.lit(now)).select("worker", F.col("last").cast("timestamp_ntz").alias("last"), "alive")


@query("unreferenced_blobs", "SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def unreferenced_blobs(spark, sf_dir):
    blobs = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), "c_custkey")
    named = lambda rows, c: rows.select(F.format_string("Customer#%09d", F.col(c)).alias("name"))
    return L.unreferenced(blobs.select("name"), named(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), "o_custkey"), named(table(spark, sf_dir, "events").filter("event_type = 'error'"), "user_id"))


@query("bound_sql", "SELECT o_orderkey, '?' AS mark FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def bound_sql(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("statuta_orders")
    return L.bound_sql(spark, "SELECT o_orderkey, '?' AS mark FROM statuta_orders WHERE o_orderstatus = ? AND o_totalprice > ?", ["F", 100000])


@query("evidence_bundle", """SELECT c_custkey, '{"format":"crx-evidence-v1","document":{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"},"leaves":[' || coalesce(leaves, '') || '],"notes":[' || coalesce(notes, '') || ']}' AS manifest FROM customer
    LEFT JOIN (SELECT o_custkey, string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) AS leaves FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey
    LEFT JOIN (SELECT user_id, string_agg('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}', ',' ORDER BY event_id) AS notes FROM events WHERE event_type = 'error' GROUP BY 1) e ON e.user_id = c_custkey""")
def evidence_bundle(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    leaves = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    notes = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("c_custkey"), "event_id", "event_type")
    return L.evidence(docs, {"leaves": (leaves, ["o_orderkey"]), "notes": (notes, ["event_id"])}, "c_custkey").select("c_custkey", "manifest")


@query("run_report", """SELECT n, value FROM (SELECT 0 AS n, '# Findings' AS value UNION ALL SELECT 1, '' UNION ALL SELECT 2, '| detector | n |' UNION ALL SELECT 3, '|---|---|' UNION ALL SELECT 3 + row_number() OVER (ORDER BY detector), '| ' || detector || ' | ' || n || ' |' FROM (SELECT event_type AS detector, count(*) AS n FROM events GROUP BY event_type))""")
def run_report(spark, sf_dir):
    counts = findings(spark, sf_dir).groupBy("detector").agg(F.count("*").alias("n"))
    return L.report_lines(counts, "Findings", "detector", "n")


@query("revoked_approvals", """
    WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id - 1 END AS origin FROM labels), c AS (SELECT doc_id FROM documents WHERE length(text) > 1000)
    SELECT doc_id, origin FROM a WHERE doc_id IN (SELECT doc_id FROM c) OR origin IN (SELECT doc_id FROM c)""")
def revoked_approvals(spark, sf_dir):
    approvals = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") - 1).alias("origin"))
    return L.revoked(approvals, table(spark, sf_dir, "documents").filter("length(text) > 1000"), "doc_id", "origin")


@query("activated_versions", "SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND max(turn) OVER w >= 1 AND min(turn) OVER w <= 1 AND count(*) FILTER (turn = 1) OVER w > 0 THEN turn = 1 ELSE turn = max(turn) OVER w END AS is_active FROM conversations WINDOW w AS (PARTITION BY conv_id)")
def activated_versions(spark, sf_dir):
    """Every third document goes back to its version 1."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    rows = rows.withColumn("is_active", F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id")))
    chosen = rows.filter("conv_id % 3 = 0").select("conv_id", F.lit(1).cast("long").alias("wanted")).distinct()
    return L.activated(rows, "conv_id", "turn", chosen)


@query("timeline_family", """
    WITH v AS (SELECT lang AS code, source AS family, doc_id AS document FROM documents), n AS (SELECT doc_id AS document, lower(source) || '!' AS family FROM documents), a AS (SELECT doc_id AS asked_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lower(source) || '!' ELSE 'nothing' END AS family, lang AS code FROM documents),
    s AS (SELECT DISTINCT family AS stored, code FROM v), b AS (SELECT n.family AS named, code, min(v.family) AS bridged FROM v JOIN n USING (document) GROUP BY ALL)
    SELECT asked_id, coalesce(stored, bridged, a.family) AS family, CASE WHEN stored IS NOT NULL THEN 'stored' WHEN bridged IS NOT NULL THEN 'by_name' ELSE 'unknown' END AS resolution FROM a LEFT JOIN s ON a.family = stored AND a.code = s.code LEFT JOIN b ON a.family = named AND a.code = b.code""")
def timeline_family(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    variants = docs.select(F.col("source").alias("family"), F.col("lang").alias("code"), F.col("doc_id").alias("document"))
    named = F.concat(F.lower("source"), F.lit("!"))
    names = docs.select(F.col("doc_id").alias("document"), named.alias("family"))
    key = F.col("doc_id") % 3
    asked = docs.select(F.col("doc_id").alias("asked_id"), F.when(key == 0, F.col("source")).when(key == 1, named).otherwise("nothing").alias("family"), F.col("lang").alias("code"))
    return L.family_of(asked, variants, names)


@query("approval_blockers", """
    SELECT doc_id, array_to_string(list_filter([CASE WHEN text IS NULL THEN 'missing_leaf' END, CASE WHEN toxic > 0 THEN 'open_issue' END, CASE WHEN notes > 0 THEN 'open_annotations' END, CASE WHEN errors > 0 THEN 'open_error_findings' END], lambda x: x IS NOT NULL), ',') AS reasons,
      CASE WHEN text IS NULL OR toxic > 0 OR notes > 0 OR errors > 0 THEN 'blocked' WHEN quality = 1 THEN 'approved' WHEN doc_id % 5 = 0 THEN 'inherited' ELSE 'pending' END AS status
    FROM labels LEFT JOIN documents USING (doc_id) LEFT JOIN (SELECT user_id AS doc_id, count(*) FILTER (event_type = 'click') AS notes, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id) USING (doc_id)""")
def approval_blockers(spark, sf_dir):
    notes = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count_if(F.col("event_type") == "click").alias("notes"), F.count_if(F.col("event_type") == "error").alias("errors"))
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "left").join(notes, "doc_id", "left")
    reasons = M.blockers(F.col("text"), F.col("toxic"), F.col("notes"), F.col("errors"))
    return rows.select("doc_id", F.array_join(reasons, ",").alias("reasons"), M.effective_status(reasons, F.col("quality") == 1, F.col("doc_id") % 5 == 0).alias("status"))


@query("new_versions", """
    WITH c AS (SELECT conv_id AS document, turn AS version_no, text AS sha, turn = max(turn) OVER (PARTITION BY conv_id) AS is_active FROM conversations), i AS (SELECT conv_id AS document, CASE WHEN conv_id % 2 = 0 THEN text ELSE text || '!' END AS sha FROM conversations QUALIFY turn = max(turn) OVER (PARTITION BY conv_id) UNION ALL SELECT -7, 'x')
    SELECT i.document, sha256(i.sha) AS sha, coalesce((SELECT max(version_no) FROM c WHERE c.document = i.document), 0) + 1 AS version_no FROM i WHERE NOT EXISTS (SELECT 1 FROM c WHERE is_active AND c.document = i.document AND c.sha = i.sha)""")
def new_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("version_no"), "text")
    rows = rows.withColumn("is_active", F.col("version_no") == F.max("version_no").over(Window.partitionBy("document")))
    incoming = rows.filter("is_active").select("document", F.when(F.col("document") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("sha")).union(spark.createDataFrame([(-7, "x")], "document long, sha string"))
    return M.new_versions(rows.withColumnRenamed("text", "sha"), incoming).select("document", F.sha2("sha", 256).alias("sha"), "version_no")


@query("valid_inheritance", "WITH l AS (SELECT doc_id AS section_id, text, lang FROM documents) SELECT a.section_id, b.section_id AS origin_id FROM l a JOIN l b ON b.section_id = a.section_id - 1 WHERE coalesce(a.text, '') = coalesce(b.text, '') AND coalesce(a.lang, '') = coalesce(b.lang, '') UNION ALL SELECT section_id, section_id FROM l")
def valid_inheritance(spark, sf_dir):
    """Claims of each leaf on the one before it and on itself."""
    leaves = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha"), F.lit("").alias("shape"), F.col("lang").alias("variant_key"))
    claims = leaves.select("section_id", F.explode(F.array(F.col("section_id") - 1, F.col("section_id"))).alias("origin_id"))
    return M.valid_inheritance(claims, leaves)


@query("family_aliases", "SELECT family_key, array_to_string(list_sort(list_distinct(list(alias))), ',') AS aliases FROM (SELECT n_regionkey AS family_key, n_name AS alias FROM nation UNION ALL SELECT r_regionkey, r_name FROM region) GROUP BY family_key")
def family_aliases(spark, sf_dir):
    known = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("family_key"), F.array("r_name").alias("aliases"))
    seen = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("family_key"), F.col("n_name").alias("alias"))
    return M.upsert_aliases(known, seen).select("family_key", F.array_join("aliases", ",").alias("aliases"))


@query("claimable_jobs", f"""
    WITH j AS (SELECT event_id AS id, event_type AS queue, CASE WHEN event_id % 3 = 0 THEN 'running' ELSE 'queued' END AS state, ts AS created_at, ts + INTERVAL 1 HOUR AS available_at, ts + INTERVAL 2 HOUR AS heartbeat_at, event_id % 4 AS attempts FROM events),
    a AS (SELECT *, CASE WHEN state = 'running' AND date_diff('second', heartbeat_at, TIMESTAMP '{NOW}') > 60 THEN CASE WHEN attempts >= 3 THEN 'fail' ELSE 'requeue' END WHEN state = 'queued' AND available_at <= TIMESTAMP '{NOW}' THEN 'claim' END AS action FROM j)
    SELECT id, action, row_number() OVER (PARTITION BY action, queue ORDER BY created_at, id) AS place FROM a WHERE action IS NOT NULL""")
def claimable_jobs(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    after = lambda h: ts + F.expr(f"INTERVAL {h} HOURS")
    key = F.col("event_id")
    jobs = table(spark, sf_dir, "events").select(key.alias("id"), F.col("event_type").alias("queue"), F.when(key % 3 == 0, "running").otherwise("queued").alias("state"), ts.alias("created_at"), after(1).alias("available_at"), after(2).alias("heartbeat_at"), (key % 4).alias("attempts"), F.lit(3).alias("max_attempts"))
    return M.claimable(jobs, F.lit(NOW).cast("timestamp")).select("id", "action", F.col("place").cast("long").alias("place"))


@query("version_gates", """
    WITH m AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 99.9 + value / 1000 END AS conserved, CASE WHEN event_id % 5 > 0 THEN 99.5 + value / 100 END AS notes, CASE WHEN event_id % 7 > 0 THEN event_id % 2 END AS failing FROM events),
    g AS (SELECT *, CASE WHEN conserved IS NULL OR failing IS NULL THEN NULL ELSE conserved >= 99.99 AND coalesce(notes, 100) >= 100 AND failing = 0 END AS gate_ok FROM m)
    SELECT event_id, gate_ok, CASE WHEN failing IS NULL THEN 'unmeasured' WHEN coalesce(gate_ok, failing = 0) THEN 'within_gate' ELSE 'outside_gate' END AS health FROM g""")
def version_gates(spark, sf_dir):
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(key % 3 > 0, 99.9 + F.col("value") / 1000).alias("conserved"), F.when(key % 5 > 0, 99.5 + F.col("value") / 100).alias("notes_conserved"), F.when(key % 7 > 0, key % 2).alias("failing"))
    return M.gate(rows).select("event_id", "gate_ok", "health")


@query("canonical_rows", """SELECT c_custkey, '{"a":' || c_nationkey || ',"b":"' || c_mktsegment || '"}' AS json, c_nationkey % 40 AS roman FROM customer""")
def canonical_rows(spark, sf_dir):
    """JSON with its keys in order, and numbers written and read as Roman numerals."""
    ship(spark)
    number = F.col("c_nationkey") % 40
    roman = F.element_at(F.array(*(F.lit(P.roman(n)) for n in range(1, 40))), F.greatest(number, F.lit(1)))
    raw = F.concat(F.lit('{ "b" : "'), "c_mktsegment", F.lit('", "a": '), F.col("c_nationkey").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "customer").select("c_custkey", P.canonical_json(raw).alias("json"), F.when(number == 0, 0).otherwise(P.roman_value(roman)).alias("roman"))


@query("stable_ids", """
    WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_name)) AS x FROM customer)
    SELECT c_custkey, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', ((strpos('0123456789abcdef', substr(x, 17, 1)) - 1) % 4 + 1)::BIGINT, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS id FROM h""")
def stable_ids(spark, sf_dir):
    """Ids that depend on names alone."""
    ship(spark)
    return table(spark, sf_dir, "customer").select("c_custkey", P.identity("c_name").alias("id"))


@query("merge_report", """
    WITH s AS (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN 'approved' ELSE 'pending' END AS status FROM documents WHERE doc_id % 5 <> 0), p AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 6 <> 0),
    m AS (SELECT CASE WHEN s.doc_id IS NULL THEN 'added' WHEN p.doc_id IS NULL THEN 'removed' WHEN s.text = p.text THEN 'unchanged' ELSE 'changed' END AS change, s.status FROM s FULL JOIN p USING (doc_id))
    SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change = 'changed' AND status = 'approved') AS approvals_reset, count(*) FILTER (change = 'removed' AND status = 'approved') AS orphaned FROM m""")
def merge_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_key"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.col("source_key")
    stored = docs.filter(key % 5 != 0).select("source_key", F.sha2("text", 256).alias("sha"), F.when(key % 4 == 0, "approved").otherwise("pending").alias("status"), F.col("text").alias("plain_text"))
    new = F.when(key % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    parsed = docs.filter(key % 6 != 0).select("source_key", F.sha2(new, 256).alias("sha"), new.alias("plain_text"))
    return M.carry_over_report(M.merge_parsed(stored, parsed))


@query("moved_annotations", """
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 45 ELSE 40 END AS new_start, CASE doc_id % 3 WHEN 0 THEN 85 ELSE 80 END AS new_end, CASE doc_id % 3 WHEN 0 THEN 'anchored' WHEN 1 THEN 'orphaned' ELSE 'anchored' END AS new_status
    FROM documents WHERE length(text) >= 140 AND strpos(text, substr(text, 41, 40)) = 41 AND strpos(substr(text, 42), substr(text, 41, 40)) = 0""")
def moved_annotations(spark, sf_dir):
    """Notes on a passage that stands once in its leaf: in every third leaf a word was put before the text, another third lost its leaf."""
    quote = F.substring("text", 41, 40)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter((F.char_length("text") >= 140) & (F.position(quote, F.col("text")) == 41) & (F.position(quote, F.col("text"), F.lit(42)) == 0))
    none = F.lit("")
    notes = docs.select(F.col("doc_id").alias("section_id"), quote.alias("highlighted_text"), F.lit(40).alias("start_offset"), F.lit(80).alias("end_offset"), none.alias("context_before"), none.alias("context_after"))
    key = F.col("doc_id") % 3
    leaves = docs.filter(key != 1).select(F.col("doc_id").alias("section_id"), F.when(key == 0, F.concat(F.lit("New. "), "text")).otherwise(F.col("text")).alias("plain_text"))
    return M.reanchor_annotations(notes, leaves).select(F.col("section_id").alias("doc_id"), "new_start", "new_end", "new_status")
