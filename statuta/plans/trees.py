"""Queries over document trees: documents as nodes of their sources, each with one note."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta.catalog import query
from statuta.functions import text as T
from statuta.operators import checks, tree_invariants
from statuta.operators.checks import Case
from statuta.session import ship
from statuta.sources.tables import table

#: The same nodes in SQL.
TREE = """(SELECT source AS document, CASE WHEN doc_id % 3 = 0 THEN 'schedule' ELSE 'chapter' END AS side, CASE WHEN doc_id % 10 = 0 THEN 'root' WHEN doc_id % 4 < 2 THEN 'division' ELSE 'section' END AS level, doc_id % 4 AS root_at, doc_id AS place,
    CASE WHEN doc_id % 10 = 0 THEN 'CHAPTER ' || CAST(doc_id % 4 AS VARCHAR) ELSE CAST(doc_id % 9 AS VARCHAR) END AS code, ['FIRST SCHEDULE', 'SECOND SCHEDULE', 'THIRD SCHEDULE', 'TWENTY-FIRST SCHEDULE'][doc_id % 4 + 1] AS root_code,
    text AS plain_text, lang, CAST(doc_id % 7 AS VARCHAR) || '.' || CAST(doc_id % 11 AS VARCHAR) AS ref, CAST(doc_id % 7 AS VARCHAR) || '.' || CAST(doc_id % 5 AS VARCHAR) AS cite FROM documents)"""
CASES = [
    Case("count", "section_code_count", "4", "3"), Case("any", "any_section_html_contains", "5", "cite\">3.1<"), Case("plain", "plain_contains", "2", "the"), Case("divisions", "division_code_count", "FIRST", "1", div="6"),
    Case("leaf", "any_schedule_leaf_html_contains", "THIRD", "cite\">2.2<"), Case("texts", "footnote_ref_distinct_texts", arg="3", ref="3.3"), Case("scoped", "footnote_not_contains", arg="en", ref="2.9", applies_to="1"), Case("gap", "section_heading_equals", "8", "", status="known_gap"),
]


def tree(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    number = lambda n: (i % n).cast("string")
    root = F.element_at(F.array(*map(F.lit, ("FIRST SCHEDULE", "SECOND SCHEDULE", "THIRD SCHEDULE", "TWENTY-FIRST SCHEDULE"))), (i % 4 + 1).cast("int"))
    html = F.concat(F.lit('<p><sup class="cite">'), F.concat_ws(".", number(7), number(5)), F.lit("</sup></p>"))
    note = F.struct(F.concat_ws(".", number(7), number(11)).alias("ref"), number(11).alias("marker"), F.lit(1).alias("page"), F.col("lang").alias("text"), F.lit("").alias("html"))
    return d.select(
        F.col("source").alias("document"), F.when(i % 3 == 0, "schedule").otherwise("chapter").alias("side"), F.when(i % 10 == 0, "root").when(i % 4 < 2, "division").otherwise("section").alias("level"), (i % 4).cast("int").alias("root_at"), root.alias("root_code"),
        T.first_line(F.col("text")).alias("root_heading"), F.lit(None).cast("int").alias("part_at"), F.lit(None).cast("string").alias("part_code"), F.array(i).alias("place"), F.when(i % 10 == 0, F.concat(F.lit("CHAPTER "), number(4))).otherwise(number(9)).alias("code"),
        F.lit("").alias("heading"), i.cast("int").alias("start_page"), (i + 1).cast("int").alias("end_page"), F.col("text").alias("plain_text"), html.alias("html"), F.array(note).alias("footnotes"), F.lit(0).alias("n_review"),
    )


def notes(nodes):
    return nodes.filter("plain_text IS NOT NULL").select("document", "place", "code", F.posexplode("footnotes").alias("idx", "n")).select("document", "place", "code", "idx", "n.*")


@query("regression_checks", f"""
    WITH t AS (SELECT * FROM {TREE} WHERE document IS NOT NULL), leaf AS (SELECT * FROM t WHERE plain_text IS NOT NULL), d AS (SELECT DISTINCT document FROM t),
    third AS (SELECT document, min(root_at) AS r FROM t WHERE side = 'schedule' AND contains(root_code, 'THIRD') GROUP BY document), one AS (SELECT document, min(root_at) AS r FROM t WHERE side = 'schedule' AND contains(root_code, 'FIRST') GROUP BY document),
    found AS (
      SELECT document, 'count' AS id, (SELECT count(*) FROM leaf l WHERE l.document = d.document AND side = 'chapter' AND code = '4') = 3 AS ok FROM d
      UNION ALL SELECT document, 'any', (SELECT bool_or(cite = '3.1') FROM leaf l WHERE l.document = d.document AND side = 'chapter' AND code = '5') FROM d
      UNION ALL SELECT document, 'plain', (SELECT arg_min(contains(plain_text, 'the'), place) FROM leaf l WHERE l.document = d.document AND side = 'chapter' AND code = '2') FROM d
      UNION ALL SELECT d.document, 'divisions', CASE WHEN one.r IS NOT NULL AND (SELECT count(*) FROM t WHERE t.document = d.document AND side = 'schedule' AND level = 'root' AND root_at = one.r) > 0
        THEN (SELECT count(*) FROM t WHERE t.document = d.document AND side = 'schedule' AND level = 'division' AND root_at = one.r AND code = '6') = 1 END FROM d LEFT JOIN one USING (document)
      UNION ALL SELECT d.document, 'leaf', (SELECT bool_or(cite = '2.2') FROM leaf l WHERE l.document = d.document AND side = 'schedule' AND root_at = third.r) FROM d LEFT JOIN third USING (document)
      UNION ALL SELECT document, 'texts', (SELECT count(DISTINCT coalesce(lang, '')) FROM leaf l WHERE l.document = d.document AND ref = '3.3') >= 3 FROM d
      UNION ALL SELECT document, 'scoped', (SELECT bool_and(NOT contains(coalesce(lang, ''), 'en')) FROM leaf l WHERE l.document = d.document AND ref = '2.9') FROM d
      UNION ALL SELECT document, 'gap', (SELECT arg_min(true, place) FROM leaf l WHERE l.document = d.document AND side = 'chapter' AND code = '8') FROM d)
    SELECT document, id, CASE id WHEN 'count' THEN 'section_code_count' WHEN 'any' THEN 'any_section_html_contains' WHEN 'plain' THEN 'plain_contains' WHEN 'divisions' THEN 'division_code_count' WHEN 'leaf' THEN 'any_schedule_leaf_html_contains'
      WHEN 'texts' THEN 'footnote_ref_distinct_texts' WHEN 'scoped' THEN 'footnote_not_contains' ELSE 'section_heading_equals' END AS kind,
      CASE WHEN id = 'gap' THEN 'known_gap' WHEN id = 'scoped' AND NOT contains(document, '1') THEN 'skipped' ELSE 'active' END AS status, coalesce(ok, false) AS passed, ok IS NOT NULL AS found FROM found""")
def regression_checks(spark, sf_dir):
    return checks.run(tree(spark, sf_dir).filter("document IS NOT NULL"), CASES)


@query("invariant_notes_where_cited", f"""
    WITH t AS (SELECT * FROM {TREE} WHERE plain_text IS NOT NULL), citing AS (SELECT document, cite AS ref, count(*) AS n FROM t GROUP BY ALL), held AS (SELECT DISTINCT document, ref FROM t), copies AS (SELECT document, ref, lang, count(*) AS n FROM t GROUP BY ALL)
    SELECT t.document, t.code AS subject, 'cited elsewhere: ' || t.ref AS evidence FROM t JOIN citing c ON t.document = c.document AND t.ref = c.ref WHERE t.ref <> t.cite
    UNION ALL SELECT t.document, t.code, 'uncited copy: ' || t.ref FROM t JOIN copies c ON t.document = c.document AND t.ref = c.ref AND t.lang IS NOT DISTINCT FROM c.lang WHERE c.n > 1 AND t.ref <> t.cite AND NOT EXISTS (SELECT 1 FROM citing g WHERE g.document = t.document AND g.ref = t.ref)
    UNION ALL SELECT t.document, t.code, 'note is elsewhere: ' || t.cite FROM t JOIN held h ON t.document = h.document AND t.cite = h.ref WHERE t.ref <> t.cite""")
def invariant_notes_where_cited(spark, sf_dir):
    nodes = tree(spark, sf_dir)
    return tree_invariants.notes_where_cited(nodes, notes(nodes)).select("document", "subject", "evidence")


@query("tree_invariants_report")
def tree_invariants_report(spark, sf_dir):
    ship(spark)
    nodes = tree(spark, sf_dir)
    roots = nodes.filter("level = 'root'").groupBy("document").agg(F.count_if(F.col("side") == "chapter").cast("int").alias("n_chapters"), F.count_if(F.col("side") == "schedule").cast("int").alias("n_schedules"))
    calibration = "named_struct('page_w', 595.0D, 'page_h', 842.0D, 'header_max_top', 60.0D, 'footer_min_top', 780.0D, 'body_size', 12.0D, 'footnote_size', 9.0D, 'body_min_size', 10.5D, 'rule_x0_lo', 0.0D, 'rule_x0_hi', 1.0D, 'rule_w_lo', 0.0D, 'rule_w_hi', 1.0D, 'page_offset_support', 0.4D, 'zone_mode', 'size', 'page_offset', n_chapters * 20, 'pages_sampled', 5)"
    meta = roots.selectExpr("*", "n_chapters AS chapters_count", "n_schedules + 1 AS schedules_count", "1000 AS total_pages", "0 AS toc_pages_scanned", f"{calibration} AS calibration", "named_struct('pages', 3, 'pages_ocred', array(5), 'needs_review_tokens', 2) AS ocr")
    return tree_invariants.violations(nodes, notes(nodes), meta).groupBy("document", "invariant").agg(F.count("*").alias("failures"))
