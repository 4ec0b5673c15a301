"""Queries of intake over documents as leaves, line items as notes and orders as readings of lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta.catalog import query
from statuta.operators import intake as I
from statuta.session import ship
from statuta.sources.tables import table


@query("junk_leaves", """
    WITH l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'PART I' WHEN 1 THEN '' WHEN 2 THEN 'Contents' ELSE '7' END AS code, CASE doc_id % 3 WHEN 0 THEN 'The Gazette of Pakistan, Extra.' ELSE 'heading' END AS heading,
      CASE doc_id % 5 WHEN 0 THEN '] THE GAZETTE OF PAKISTAN, EXTRA., MAY 4, 2021 ' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN 'Section  Page No. ' WHEN doc_id % 7 = 0 THEN 'Page No ' ELSE '' END || regexp_replace(coalesce(text, ''), '[^a-z]+', ' ', 'g') AS body FROM documents),
    b AS (SELECT *, trim(regexp_replace(body, '[ ]+', ' ', 'g')) AS t FROM l), r AS (SELECT *, trim(regexp_replace(t, '^\\]? ?THE GAZETTE OF PAKISTAN, EXTRA\\., MAY 4, 2021 ?', '')) AS rest FROM b)
    SELECT doc_id, code <> 'Contents' AND (doc_id % 11 = 0 OR (doc_id % 3 = 0 AND length(rest) < 80 AND (code IN ('', 'PART I') OR doc_id % 5 = 0)) OR (code = 'PART I' AND contains(body, 'Page No'))) AS junk FROM r""")
def junk_leaves(spark, sf_dir):
    i = F.col("doc_id")
    code = F.when(i % 4 == 0, "PART I").when(i % 4 == 1, "").when(i % 4 == 2, "Contents").otherwise("7")
    heading = F.when(i % 3 == 0, "The Gazette of Pakistan, Extra.").otherwise("heading")
    top = F.when(i % 5 == 0, "] THE GAZETTE OF PAKISTAN, EXTRA., MAY 4, 2021 ").otherwise("")
    body = F.concat(top, F.when(i % 11 == 0, "Section  Page No. ").when(i % 7 == 0, "Page No ").otherwise(""), F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z]+", " "))
    return table(spark, sf_dir, "documents").select("doc_id", I.junk_leaf(code, heading, body, F.lit(None).cast("string")).alias("junk"))


@query("upload_errors", """
    WITH d AS (SELECT o_orderkey AS document, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 4 END AS declared, o_custkey % 4 AS pages FROM orders), l AS (SELECT l_orderkey AS document, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS source_key, l_partkey % 6 AS start_page, l_suppkey % 6 AS end_page FROM lineitem)
    SELECT document, '/' AS pointer, 'zero_sections' AS code FROM d WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.document = d.document)
    UNION ALL SELECT document, '/metadata/total_pages', 'page_count_mismatch' FROM d WHERE declared <> pages
    UNION ALL SELECT l.document, coalesce(nullif(source_key, ''), '/'), 'invalid_page_span' FROM l JOIN d USING (document) WHERE start_page < 1 OR end_page < start_page OR end_page > pages""")
def upload_errors(spark, sf_dir):
    key = F.col("o_orderkey")
    documents = table(spark, sf_dir, "orders").select(key.alias("document"), F.when(key % 3 != 0, key % 4).alias("declared"), (F.col("o_custkey") % 4).alias("pages"))
    part = F.col("l_partkey")
    leaves = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document"), F.when(part % 5 == 0, "").otherwise(part.cast("string")).alias("source_key"), (part % 6).alias("start_page"), (F.col("l_suppkey") % 6).alias("end_page"), F.col("l_linenumber").alias("sort_order"),
    )
    return I.upload_errors(documents, leaves)


@query("scanned_leaves", """
    SELECT o_orderkey, coalesce(2 BETWEEN least(a, b) AND greatest(a, b) OR 5 BETWEEN least(a, b) AND greatest(a, b) OR 11 BETWEEN least(a, b) AND greatest(a, b), false) AS scanned
    FROM (SELECT o_orderkey, coalesce(s, e) AS a, coalesce(e, s) AS b FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE o_custkey % 17 END AS s, CASE WHEN o_orderkey % 5 IN (1, 2) THEN NULL ELSE o_orderkey % 13 END AS e FROM orders))""")
def scanned_leaves(spark, sf_dir):
    key = F.col("o_orderkey")
    start, end = F.when(key % 5 >= 2, F.col("o_custkey") % 17), F.when(~(key % 5).isin(1, 2), key % 13)
    return table(spark, sf_dir, "orders").select("o_orderkey", I.meets_scanned(start, end, F.array(F.lit(2), F.lit(5), F.lit(11)).cast("array<bigint>")).alias("scanned"))


@query("contents_without_repeats", """
    WITH r AS (SELECT p_brand AS document, p_partkey AS at, CAST(p_size AS VARCHAR) AS code, p_type || CASE WHEN p_partkey % 13 = 0 THEN ' omitted' ELSE ' x y' END AS heading FROM part),
    w AS (SELECT *, string_split(lower(trim(heading)), ' ') AS h FROM r),
    pairs AS (SELECT DISTINCT a.document, a.code FROM w a JOIN w b ON a.document = b.document AND a.code = b.code AND a.at < b.at
      WHERE contains(lower(a.heading), 'omitted') OR contains(lower(b.heading), 'omitted') OR NOT coalesce(a.h[1] = b.h[1] AND a.h[2] = b.h[2] AND a.h[3] = b.h[3], false))
    SELECT document, at, code, heading FROM r WHERE EXISTS (SELECT 1 FROM pairs p WHERE p.document = r.document AND p.code = r.code) OR r.at = (SELECT min(x.at) FROM r x WHERE x.document = r.document AND x.code = r.code)""".replace(" AS at,", ' AS "at",').replace("SELECT document, at,", 'SELECT document, "at",'))
def contents_without_repeats(spark, sf_dir):
    heading = F.concat("p_type", F.when(F.col("p_partkey") % 13 == 0, " omitted").otherwise(" x y"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("document"), F.col("p_partkey").alias("at"), F.col("p_size").cast("string").alias("code"), heading.alias("heading"))
    return I.without_repeated_codes(rows)


@query("spliced_notes", """
    WITH n AS (SELECT l_suppkey AS document, l_orderkey AS page, l_linenumber AS idx, CASE WHEN min(l_partkey) % 3 = 0 THEN NULL ELSE CAST(min(l_partkey) AS VARCHAR) END AS marker, min(l_returnflag) || CASE WHEN min(l_partkey) % 4 = 0 THEN ' as follows:' ELSE '' END AS text FROM lineitem GROUP BY ALL),
    m AS (SELECT *, idx = min(idx) OVER (PARTITION BY document, page) AND marker IS NULL AS lead_in FROM n),
    t AS (SELECT document, page, coalesce(max(idx) FILTER (text LIKE '%as follows:'), max(idx)) AS idx FROM m WHERE NOT lead_in GROUP BY ALL),
    c AS (SELECT m.document, t.page, t.idx, m.text AS more, m.page AS to_page, m.idx AS c_idx FROM m JOIN t ON m.document = t.document AND m.page = t.page + 1 WHERE m.lead_in)
    SELECT m.document, m.page, m.idx, m.marker, CASE WHEN c.more IS NOT NULL THEN m.text || chr(10) || c.more ELSE m.text END AS text, coalesce(c.to_page, m.page) AS end_page
    FROM m LEFT JOIN c USING (document, page, idx) WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.document = m.document AND x.to_page = m.page AND x.c_idx = m.idx)""")
def spliced_notes(spark, sf_dir):
    once = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("flag"))
    notes = once.select(
        F.col("l_suppkey").alias("document"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), F.when(F.col("part") % 3 != 0, F.col("part").cast("string")).alias("marker"),
        F.concat("flag", F.when(F.col("part") % 4 == 0, " as follows:").otherwise("")).alias("text"),
    )
    return I.splice_continuations(notes)


@query("paired_lines", """
    WITH a AS (SELECT o_custkey % 20 AS document, o_custkey AS page, o_orderkey AS line, CAST(o_orderkey % 50 AS DOUBLE) AS x0, CAST(o_orderkey % 90 * 8 AS DOUBLE) AS y0, CAST(o_orderkey % 50 + 200 AS DOUBLE) AS x1, CAST(o_orderkey % 90 * 8 + 12 AS DOUBLE) AS y1 FROM orders),
    b AS (SELECT document, page, line AS second, x0 + line % 7 * 40 AS x0, y0 + line % 5 * 4 - 8 AS y0, x1 + line % 7 * 40 AS x1, y1 + line % 5 * 4 - 8 AS y1 FROM a),
    m AS (SELECT b.document, b.page, b.second, a.line, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS area FROM a JOIN b ON a.document = b.document AND a.page = b.page AND (b.y0 + b.y1) / 2 BETWEEN a.y0 - 4 AND a.y1 + 4),
    k AS (SELECT *, row_number() OVER (PARTITION BY document, page, second ORDER BY area DESC, line) AS k FROM m WHERE area > 0)
    SELECT b.document, b.page, b.second, k.line FROM b LEFT JOIN k ON b.document = k.document AND b.page = k.page AND b.second = k.second AND k.k = 1""")
def paired_lines(spark, sf_dir):
    key = F.col("o_orderkey")
    first = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 20).alias("document"), F.col("o_custkey").alias("page"), key.alias("line"), (key % 50).cast("double").alias("x0"), (key % 90 * 8).cast("double").alias("top"), (key % 50 + 200).cast("double").alias("x1"), (key % 90 * 8 + 12).cast("double").alias("bottom"),
    )
    right, down = F.col("line") % 7 * 40, F.col("line") % 5 * 4 - 8
    second = first.select("document", "page", "line", (F.col("x0") + right).alias("x0"), (F.col("top") + down).alias("top"), (F.col("x1") + right).alias("x1"), (F.col("bottom") + down).alias("bottom"))
    return I.pair_lines(first, second)


@query("sign_offs", """
    SELECT o_orderkey AS document, CASE o_orderkey % 3 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'legal_approved' ELSE 'other' END AS stage, 'a' || CAST(o_custkey % 3 AS VARCHAR) AS actor,
      CASE WHEN o_orderkey % 11 = 0 THEN 'not_found' WHEN o_orderkey % 3 = 2 THEN 'unknown_stage' WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'F' THEN 'not_all_approved' WHEN o_orderkey % 3 = 1 AND o_orderstatus <> 'O' THEN 'review_first'
        WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = o_custkey % 3 THEN 'same_actor' END AS error FROM orders""")
def sign_offs(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    requests = orders.select(key.alias("document"), F.when(key % 3 == 0, "reviewed").when(key % 3 == 1, "legal_approved").otherwise("other").alias("stage"), F.concat(F.lit("a"), (F.col("o_custkey") % 3).cast("string")).alias("actor"))
    documents = orders.filter(key % 11 != 0).select(key.alias("document"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("in_progress").alias("status"), F.when(F.col("o_orderstatus") == "O", "reviewed").alias("signoff_stage"), F.concat(F.lit("a"), (key % 2).cast("string")).alias("reviewed_by"))
    return I.sign_offs(requests, documents)


@query("proposal_issues", """
    WITH p AS (SELECT doc_id, text, regexp_replace(text, '[^A-Za-z]+', ' ', 'g') AS plain FROM documents WHERE text IS NOT NULL),
    r AS (SELECT doc_id, plain AS old_plain, '<p>' || plain || '</p>' AS old_html, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN plain || ' more' ELSE plain END AS plain, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '<p>' || plain || '<b> more</b></p>' WHEN 2 THEN '<p onclick=x>' || plain || '</p>' ELSE '<p>' || plain || '</p>' END AS html FROM p),
    found AS (
      SELECT doc_id, 'error' AS level, 'unsafe_html' AS code FROM r WHERE doc_id % 5 = 2 UNION ALL SELECT doc_id, 'error', 'empty_body' FROM r WHERE trim(plain) = '' AND trim(old_plain) <> ''
      UNION ALL SELECT doc_id, 'error', 'page_coverage_changed' FROM r WHERE doc_id % 7 = 3 UNION ALL SELECT doc_id, 'error', 'footnote_marker_conservation' FROM r WHERE doc_id % 11 = 4
      UNION ALL SELECT doc_id, 'warning', 'no_change' FROM r WHERE trim(plain) = trim(old_plain) AND html = old_html)
    SELECT 'd' AS document, doc_id AS section_id, level, code FROM found""")
def proposal_issues(spark, sf_dir):
    ship(spark)
    i = F.col("doc_id")
    plain = F.regexp_replace("text", "[^A-Za-z]+", " ")
    note = lambda marker: F.array(F.struct(marker.alias("marker"), F.lit("t").alias("text"), F.lit("t").alias("html")))
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").withColumn("plain", plain).withColumn("html", F.concat(F.lit("<p>"), "plain", F.lit("</p>")))
    head = [F.lit("d").alias("document"), i.alias("section_id")]
    originals = rows.select(*head, "html", F.col("plain").alias("plain_text"), F.lit(3).alias("start_page"), F.lit(4).alias("end_page"), note(F.lit("1")).alias("footnotes"))
    html = F.when(i % 5 == 0, "").when(i % 5 == 1, F.concat(F.lit("<p>"), "plain", F.lit("<b> more</b></p>"))).when(i % 5 == 2, F.concat(F.lit("<p onclick=x>"), "plain", F.lit("</p>"))).when(i % 5 == 3, F.col("html"))
    changed = F.when(i % 5 == 0, "").when(i % 5 == 1, F.concat("plain", F.lit(" more")))
    proposals = rows.select(*head, html.alias("html"), changed.alias("plain_text"), F.when(i % 7 == 3, 2).alias("start_page"), F.lit(None).cast("int").alias("end_page"), F.when(i % 11 == 4, note(F.lit("2"))).alias("footnotes"))
    return I.proposal_issues(proposals, originals)


@query("sync_actions", """
    SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN 'created' WHEN o_orderkey % 3 <> 1 AND o_orderstatus <> 'P' AND o_orderkey % 5 > 0 THEN 'skipped' ELSE 'updated' END AS action FROM orders""")
def sync_actions(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    stored = orders.filter(key % 4 > 0).select(key.alias("key"), F.when(key % 3 == 1, "old").otherwise("h").alias("source_hash"), (F.col("o_orderstatus") != "P").alias("usable"), F.when(key % 5 > 0, "lane").alias("lane"))
    return I.sync_actions(orders.select(key.alias("key"), F.lit("h").alias("source_hash")), stored)
