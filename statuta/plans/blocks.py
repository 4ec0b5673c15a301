"""Queries of blocks, notes, table rows, images and refusals: lines are line items, leaves orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from statuta.catalog import query
from statuta.operators import blocks as B
from statuta.sources.tables import table

KINDS = ["text", "subsec", "clause", "rule", "htext", "subhead", "table", "recital", "act-title", "text"]
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_OPEN = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in B.LISTS.items())


@query("block_html", f"""
    WITH l AS (SELECT l_orderkey AS leaf, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS "at", {KINDS}[CAST(l_partkey % 10 + 1 AS INTEGER)] AS kind, CASE WHEN l_partkey % 13 = 0 THEN '' ELSE 'x' || l_suppkey END AS html FROM lineitem),
    o AS (SELECT *, last_value(CASE WHEN kind <> 'text' THEN kind END IGNORE NULLS) OVER (PARTITION BY leaf ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opener FROM l),
    b AS (SELECT *, CASE WHEN kind <> 'text' THEN kind WHEN opener IN ('rule', 'htext', 'subsec', 'clause', 'recital') THEN opener ELSE 'text' END AS block FROM o),
    n AS (SELECT *, CASE WHEN kind IN ('rule', 'table', 'recital', 'act-title') OR lag(block) OVER w IS DISTINCT FROM block THEN 1 ELSE 0 END AS fresh FROM b WINDOW w AS (PARTITION BY leaf ORDER BY "at")),
    k AS (SELECT *, sum(fresh) OVER (PARTITION BY leaf ORDER BY "at") AS number, count(*) FILTER (kind IN ('subsec', 'clause')) OVER (PARTITION BY leaf ORDER BY "at") AS item FROM n),
    i AS (SELECT leaf, number, block, CASE WHEN block IN ('subsec', 'clause') THEN item ELSE 0 END AS item, coalesce(string_agg(html, ' ' ORDER BY "at") FILTER (html <> ''), '') AS x FROM k GROUP BY ALL),
    g AS (SELECT leaf, number, block, CASE WHEN block IN ('subsec', 'clause') THEN (CASE block {_OPEN} END) || chr(10) || string_agg('<li>' || x || '</li>', chr(10) ORDER BY item) || chr(10) || '</ol>' WHEN min(x) = '' THEN NULL WHEN block = 'table' THEN min(x) WHEN block IN ('recital', 'act-title') THEN '<p class="' || block || '">' || min(x) || '</p>' ELSE '<p>' || min(x) || '</p>' END AS html FROM i GROUP BY leaf, number, block)
    SELECT leaf, sha256(coalesce(string_agg(html, chr(10) ORDER BY number), '')) AS html FROM g GROUP BY leaf""")
def block_html(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % 10 + 1).cast("int"))
    html = F.when(F.col("l_partkey") % 13 == 0, "").otherwise(F.concat(F.lit("x"), F.col("l_suppkey").cast("string")))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("leaf"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("at"), kind.alias("kind"), html.alias("html"))
    return B.block_html(lines, "leaf", "at").select("leaf", F.sha2("html", 256).alias("html"))


@query("gazette_classes", "SELECT o_orderkey, ['act-title', 'act-title', 'act-long-title', 'recital', 'recital', 'enacting-formula', 'enacting-clause', 'act-title', NULL, NULL][CAST(o_orderkey % 10 + 1 AS INTEGER)] AS class FROM orders")
def gazette_classes(spark, sf_dir):
    lines = [" AN ", "the Ordinance", "to further amend the Act", "WHEREAS it is", "And whereas it is", "It is hereby enacted", "There is hereby enacted", "Tables", "AN ACT", "to whom"]
    line = F.element_at(F.array(*map(F.lit, lines)), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", B.gazette_class(line).alias("class"))


@query("note_texts", """SELECT p_partkey, '3Substituted for "' || p_brand || '"' || chr(10) || 'up to ' || p_size || ' 5%' || chr(10) || 'over it & more ' || p_type || chr(10) || 'end' AS text FROM part""")
def note_texts(spark, sf_dir):
    """Notes with a table of two columns, a repeated line and an empty one."""
    cell = lambda x: F.concat(F.lit('<div style="flex:0 0 50%; min-width:0">'), x, F.lit("</div>"))
    cells = F.concat(cell(F.concat(F.lit("<b>up to</b> "), F.col("p_size").cast("string"))), cell(F.lit(" 5%")), cell(F.lit("over it &amp; more")), cell(F.col("p_type")))
    html = F.concat(F.lit('<p><sup class="cite" data-ref="9.3">9.3</sup>Substituted for &quot;'), "p_brand", F.lit('&quot;</p><div class="fn-table" style="x">'), cells, F.lit("</div><p></p><p>end</p><p> end </p>"))
    return table(spark, sf_dir, "part").select("p_partkey", B.note_text(html).alias("text"))


@query("folded_rows", "SELECT p_partkey, '1.|' || p_name || ' more|' || p_size || ' and;2.|x|;3.||y;|w|z' AS grid FROM part")
def folded_rows(spark, sf_dir):
    """A table with a row that goes on with cells above it, one that begins a row, and one that has a cell below an empty one."""
    size = F.col("p_size").cast("string")
    row = lambda *cells: F.array(*(F.lit(c) if isinstance(c, str) else c for c in cells))
    grid = F.array(row("1.", F.col("p_name"), size), row("", "more", "and"), row("2.", "x", ""), row("3.", "", "y"), row(" ", "w", "z"))
    shown = F.array_join(F.transform(B.folded_rows(grid), lambda r: F.array_join(F.transform(r, lambda c: F.trim(c)), "|")), ";")
    return table(spark, sf_dir, "part").select("p_partkey", shown.alias("grid"))


@query("image_pages", """
    WITH b AS (SELECT l_orderkey AS page, l_returnflag = 'R' AS is_image, CAST(l_partkey % 300 AS DOUBLE) AS x0, l_partkey % 300 + 100.0 + l_quantity * 5 AS x1, CAST(l_linenumber * 20 AS DOUBLE) AS top, l_linenumber * 20 + l_quantity * 8 AS bottom FROM lineitem),
    a AS (SELECT page, max(CASE WHEN is_image THEN (x1 - x0) * (bottom - top) END) AS largest, sum(CASE WHEN is_image THEN (x1 - x0) * (bottom - top) END) AS summed, (max(CASE WHEN is_image THEN x1 END) - min(CASE WHEN is_image THEN x0 END)) * (max(CASE WHEN is_image THEN bottom END) - min(CASE WHEN is_image THEN top END)) AS images, (max(x1) - min(x0)) * (max(bottom) - min(top)) AS ink FROM b GROUP BY page)
    SELECT o_orderkey AS page, coalesce(largest >= 0.5 * 300000 OR (ink > 0 AND images >= 0.9 * ink AND summed >= 0.2 * 300000), false) AS is_scan FROM orders LEFT JOIN a ON page = o_orderkey""")
def image_pages(spark, sf_dir):
    x0, top = (F.col("l_partkey") % 300).cast("double"), (F.col("l_linenumber") * 20).cast("double")
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_returnflag") == "R").alias("is_image"), x0.alias("x0"), (x0 + 100.0 + F.col("l_quantity") * 5).alias("x1"), top.alias("top"), (top + F.col("l_quantity") * 8).alias("bottom"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.lit(500.0).alias("width"), F.lit(600.0).alias("height"))
    return B.image_pages(boxes, pages, "page")


@query("refused_documents", """
    WITH c AS (SELECT source, sum(coalesce(CASE WHEN doc_id % 2 = 0 THEN length(lang) + 2 END, 0) + length(coalesce(text, ''))) AS carried, count(*) FILTER (doc_id % 19 = 7) AS orphans, coalesce(bool_or(doc_id % 11 = 3), false) AS chapters, (min(doc_id) % 3 * 8 + 1) * sum(length(coalesce(text, ''))) AS extracted FROM documents GROUP BY source)
    SELECT source, 'text_lost' AS reason FROM c WHERE extracted >= 500 AND carried < 0.1 * extracted UNION ALL SELECT source, 'orphan_leaves' FROM c WHERE orphans > 0 AND chapters""")
def refused_documents(spark, sf_dir):
    """Sources as documents; every nineteenth leaf has no container, and some are chapters."""
    key = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    leaves = docs.select("source", F.when(key % 19 != 7, key).alias("container"), (key % 11 == 3).alias("is_chapter"), F.col("text").alias("plain_text"), F.when(key % 2 == 0, F.concat(F.lit("<p>"), "lang", F.lit("</p>"))).alias("html"))
    whole = docs.groupBy("source").agg(((F.min("doc_id") % 3 * 8 + 1) * F.sum(F.char_length(F.coalesce("text", F.lit(""))))).alias("extracted")).withColumn("preamble", F.lit(None).cast("string"))
    return B.refused(whole, leaves, "source")


@query("approvable_groups", """
    SELECT sha256(coalesce(text, '')) AS variant, count(*) AS members FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT coalesce(lang, '')) = 1 AND NOT bool_or(coalesce(toxic = 1, false))""")
def approvable_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    variants = rows.select(sha.alias("variant"), F.col("doc_id").alias("leaf"), sha.alias("text_sha"), F.coalesce("lang", F.lit("")).alias("shape"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("blocked"))
    return B.approvable(variants, "variant")
