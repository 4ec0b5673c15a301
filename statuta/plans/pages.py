"""Queries of page geometry and invariants over line items as words and over documents as leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.catalog import query
from statuta.functions import text as T
from statuta.operators import geometry as G
from statuta.operators import invariants as I
from statuta.session import ship
from statuta.sources.tables import table


def words(spark, sf_dir) -> DataFrame:
    """Line items as positioned words: a page for each order."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit("lineitem").alias("document"), F.col("l_orderkey").cast("int").alias("page"), F.col("l_returnflag").alias("text"), (F.col("l_partkey") % 400).cast("double").alias("x0"), (F.col("l_partkey") % 400 + 12).cast("double").alias("x1"),
        (F.col("l_linenumber") * 14).cast("double").alias("top"), F.when(F.col("l_quantity") > 25, 10.0).otherwise(8.0).alias("size"),
    )


@query("geometry_lines")
def geometry_lines(spark, sf_dir):
    ship(spark)
    return G.page_lines(words(spark, sf_dir))


@query("geometry_calibration", """
    WITH l AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_quantity > 25 THEN 10.0 ELSE 8.0 END) AS size FROM lineitem GROUP BY ALL), s AS (SELECT size, count(*) AS n FROM l GROUP BY size HAVING count(*) >= 4),
    b AS (SELECT size AS body FROM s ORDER BY n DESC, size DESC LIMIT 1), t AS (SELECT size AS note FROM s, b WHERE size < body - 0.5 ORDER BY n DESC, size DESC LIMIT 1)
    SELECT 'lineitem' AS document, CAST(body AS DOUBLE) AS body, CAST(note AS DOUBLE) AS note, CAST((body + note) / 2 AS DOUBLE) AS boundary FROM b LEFT JOIN t ON true""")
def geometry_calibration(spark, sf_dir):
    rows = words(spark, sf_dir).groupBy("document", "page", "top").agg(F.max("size").alias("size"))
    return G.calibrate(rows)


@query("geometry_footnotes")
def geometry_footnotes(spark, sf_dir):
    ship(spark)
    lines = words(spark, sf_dir).withColumn("text", F.concat_ws(" ", F.col("x0").cast("int").cast("string"), "text", F.lit("note"))).withColumn("line", F.row_number().over(Window.partitionBy("page").orderBy("top", "x0")))
    return G.page_footnotes(lines, 9.0)


def leaf_frames(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents as leaves of their source, line items as notes, sources as documents."""
    docs = table(spark, sf_dir, "documents")
    none = lambda c: F.lit(None).cast("string").alias(c)
    leaf = docs.select(
        F.col("source").alias("document"), F.col("doc_id").alias("section_id"), (F.col("doc_id") % 50).cast("string").alias("code"), T.first_line(F.col("text")).alias("heading"), F.lit("chapter").alias("hierarchy_kind"), F.col("lang").alias("chapter_code"),
        none("part_code"), none("division_code"), F.col("doc_id").cast("int").alias("start_page"), (F.col("doc_id") + 1).cast("int").alias("end_page"), F.col("text").alias("plain_text"), none("html"), F.col("doc_id").alias("sort_order"),
    )
    note = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("src"), F.col("l_suppkey") % 20).alias("document"), F.col("l_orderkey").alias("section_id"), F.col("l_linenumber").alias("idx"), F.concat_ws(".", F.col("l_suppkey"), F.col("l_partkey")).alias("ref"),
        F.col("l_partkey").cast("string").alias("marker"), F.col("l_suppkey").cast("int").alias("page"), F.col("l_returnflag").alias("text"), F.col("l_linestatus").alias("html"),
    )
    doc = leaf.groupBy("document").agg(F.count("*").cast("int").alias("total_pages")).select("document", "total_pages", F.col("total_pages").alias("sections_count"), none("preamble"), F.lit("size").alias("zone_mode"))
    return leaf, note, doc


@query("invariants_report")
def invariants_report(spark, sf_dir):
    return I.report(I.violations(*leaf_frames(spark, sf_dir)))


@query("invariant_footnote_years", "SELECT 'src' || CAST(l_suppkey % 20 AS VARCHAR) AS document, count(*) AS failures FROM lineitem WHERE l_partkey BETWEEN 1800 AND 2099 GROUP BY ALL")
def invariant_footnote_years(spark, sf_dir):
    found = I.footnote_rows(leaf_frames(spark, sf_dir)[1]).filter("invariant = 'no_year_marker_refs'")
    return found.groupBy("document").agg(F.count("*").alias("failures"))


@query("invariant_code_order", """
    WITH o AS (SELECT source, doc_id, doc_id % 50 AS code, lag(doc_id % 50) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents)
    SELECT source AS document, CAST(doc_id AS VARCHAR) AS subject, CAST(code AS VARCHAR) AS evidence FROM o WHERE before > code""")
def invariant_code_order(spark, sf_dir):
    return I.code_order(leaf_frames(spark, sf_dir)[0]).select("document", "subject", "evidence")


@query("invariant_structural_lines", """
    SELECT source AS document, CAST(doc_id AS VARCHAR) AS subject, CASE WHEN doc_id % 3 = 0 THEN 'CHAPTER IV' ELSE 'Division IIA' END AS evidence FROM documents WHERE doc_id % 3 < 2""")
def invariant_structural_lines(spark, sf_dir):
    """Headings that are put before the texts of two leaves of three; in the third they stand within quotation marks."""
    key = F.col("section_id") % 3
    head = F.when(key == 0, "CHAPTER IV\n").when(key == 1, "Division IIA\n“").otherwise("“\nPART II\n")
    leaf = leaf_frames(spark, sf_dir)[0].withColumn("plain_text", F.concat(head, F.replace(F.coalesce("plain_text", F.lit("")), F.lit("\n"), F.lit(" "))))
    return I.structural_lines(leaf).select("document", "subject", "evidence")


@query("invariant_ocr_fidelity", """
    WITH p AS (SELECT l_suppkey, 100.0 * count(*) FILTER (l_returnflag <> 'R') / count(*) AS agreement, 100.0 * count(*) FILTER (l_discount < 0.02) / count(*) AS low_share, count(*) AS pages FROM lineitem GROUP BY l_suppkey),
    d AS (SELECT l_suppkey, agreement < 85 OR low_share > 15 AS under, l_suppkey % 3 = 0 AS provisional, CASE WHEN l_suppkey % 2 = 0 THEN 'few pages' END AS reason FROM p WHERE l_suppkey % 7 > 0)
    SELECT CAST(l_suppkey AS VARCHAR) AS document, 'ocr_fidelity_floor' AS invariant FROM d WHERE under AND NOT provisional
    UNION ALL SELECT CAST(l_suppkey AS VARCHAR), 'provisional_is_flagged' FROM d WHERE under <> provisional OR (provisional AND coalesce(reason, '') = '')""")
def invariant_ocr_fidelity(spark, sf_dir):
    """Suppliers as scanned documents; every seventh was not scanned."""
    of = lambda c: 100.0 * F.count_if(c) / F.count("*")
    by = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(of(F.col("l_returnflag") != "R").alias("agreement"), of(F.col("l_discount") < 0.02).alias("low_share"), F.count("*").alias("n"))
    key = F.col("l_suppkey")
    doc = by.select(key.cast("string").alias("document"), F.when(key % 7 > 0, F.col("n")).alias("ocr_pages"), "agreement", "low_share", (key % 3 == 0).alias("provisional"), F.when(key % 2 == 0, "few pages").alias("reason"))
    return I.ocr_rows(doc).select("document", "invariant")


@query("page_bodies", """
    WITH l AS (SELECT l_orderkey AS page, l_partkey AS id, l_linenumber * 14.0 AS top, CASE WHEN l_linenumber % 6 = 1 THEN '- ' || l_suppkey || ' -' ELSE 'text ' || l_suppkey END AS text FROM lineitem), p AS (SELECT page, max(TRY_CAST(nullif(regexp_extract(text, '^[^0-9A-Za-z_]*(\\d{1,4})[^0-9A-Za-z_]*$', 1), '') AS INTEGER)) AS printed_page FROM l WHERE top < 20 OR top > 90 GROUP BY page)
    SELECT page, id, text, printed_page FROM l LEFT JOIN p USING (page) WHERE top BETWEEN 20 AND 90""")
def page_bodies(spark, sf_dir):
    """Line items as lines: the first and those far down are running heads, and some of them a lone number."""
    number = F.col("l_suppkey").cast("string")
    text = F.when(F.col("l_linenumber") % 6 == 1, F.concat(F.lit("- "), number, F.lit(" -"))).otherwise(F.concat(F.lit("text "), number))
    lines = table(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("document"), F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("id"), (F.col("l_linenumber") * 14.0).alias("top"), text.alias("text"))
    return G.without_running_heads(lines, 20.0, 90.0).select("page", "id", "text", "printed_page")
