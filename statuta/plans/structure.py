"""Queries of structure builders over lines of documents, line items as lines and orders as notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta.catalog import query
from statuta.operators import structure as S
from statuta.session import ship
from statuta.sources.tables import table


def document_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))


@query("layout_blocks", """
    WITH l AS (SELECT source AS document, doc_id AS section_id, unnest(generate_series(0, len(split(text, chr(10))) - 1)) AS "at", split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
    k AS (SELECT document, section_id, "at", "at" % 7 = 6 AS tab, CASE WHEN "at" % 5 = 0 THEN 'Provided ' ELSE '' END || a["at" + 1] AS text FROM l),
    o AS (SELECT *, CASE WHEN tab THEN 'table' WHEN "at" % 5 = 0 THEN 'proviso' END AS opener FROM k),
    h AS (SELECT *, last_value(opener IGNORE NULLS) OVER w AS held FROM o WINDOW w AS (PARTITION BY document, section_id ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    b AS (SELECT *, sum(CASE WHEN opener IS NULL AND held = 'proviso' THEN 0 ELSE 1 END) OVER (PARTITION BY document, section_id ORDER BY "at") AS block FROM h)
    SELECT document, section_id, CAST(block AS BIGINT) AS block, coalesce(arg_min(opener, "at") FILTER (opener IS NOT NULL), 'text') AS class, string_agg(text, chr(10) ORDER BY "at") AS text FROM b GROUP BY document, section_id, block""")
def layout_blocks(spark, sf_dir):
    at = F.col("at")
    rows = document_lines(spark, sf_dir).select(
        F.col("source").alias("document"), F.col("doc_id").alias("section_id"), at.cast("long").alias("at"), F.lit(1).alias("page"), F.when(at % 7 == 6, "table").otherwise("text").alias("kind"),
        F.concat(F.when(at % 5 == 0, "Provided ").otherwise(""), "line").alias("text"), F.lit(72.0).alias("x0"), F.lit(520.0).alias("x1"), (at * 14.0).alias("top"),
    )
    return S.layout_blocks(rows)


LINES = """(SELECT l_orderkey % 100 AS document, l_orderkey * 10 + l_linenumber AS "at", l_orderkey AS page, CASE WHEN l_linenumber = 1 THEN 'CHAPTER ' || ['I', 'V', 'X'][l_orderkey % 3 + 1] WHEN l_returnflag = 'N' THEN 'NEW RATES' WHEN l_returnflag = 'R' THEN 'lower' ELSE 'ALL TAXES' END AS text FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL))"""


@query("chapter_captions", f"""
    WITH l AS (SELECT * FROM {LINES}), w AS (SELECT *, lead(text, 1) OVER o AS t1, lead(page, 1) OVER o AS p1, lead(text, 2) OVER o AS t2, lead(page, 2) OVER o AS p2, lead(text, 3) OVER o AS t3, lead(page, 3) OVER o AS p3 FROM l WINDOW o AS (PARTITION BY document ORDER BY "at")),
    c AS (SELECT document, "at", substr(text, 9) AS numeral, coalesce(p1 = page AND t1 IN ('NEW RATES', 'ALL TAXES'), false) AS g1, coalesce(p2 = page AND t2 IN ('NEW RATES', 'ALL TAXES'), false) AS g2, coalesce(p3 = page AND t3 IN ('NEW RATES', 'ALL TAXES'), false) AS g3, t1, t2, t3 FROM w WHERE text LIKE 'CHAPTER%'),
    f AS (SELECT document, "at", numeral, t1 || CASE WHEN g2 THEN ' ' || t2 ELSE '' END || CASE WHEN g2 AND g3 THEN ' ' || t3 ELSE '' END AS caption FROM c WHERE g1)
    SELECT document, numeral, arg_min(caption, "at") AS caption FROM f GROUP BY document, numeral""")
def chapter_captions(spark, sf_dir):
    key, number = F.col("l_orderkey"), F.col("l_linenumber")
    numeral = F.element_at(F.array(*map(F.lit, ("I", "V", "X"))), (key % 3 + 1).cast("int"))
    text = F.when(number == 1, F.concat(F.lit("CHAPTER "), numeral)).when(F.col("l_returnflag") == "N", "NEW RATES").when(F.col("l_returnflag") == "R", "lower").otherwise("ALL TAXES")
    once = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    rows = once.select((key % 100).alias("document"), (key * 10 + number).alias("at"), key.alias("page"), text.alias("text"))
    return S.chapter_captions(rows)


@query("missing_schedules", """
    WITH toc AS (SELECT CAST(n_regionkey AS VARCHAR) AS document, n_nationkey AS "at", n_nationkey % 17 + 1 AS ordinal, n_name AS code FROM nation), body AS (SELECT * FROM toc WHERE "at" % 3 = 0),
    gone AS (SELECT t.* FROM toc t WHERE NOT EXISTS (SELECT 1 FROM body b WHERE b.document = t.document AND b.ordinal = t.ordinal))
    SELECT g.document, g.ordinal, g.code, max(b."at") AS after_at FROM gone g LEFT JOIN body b ON g.document = b.document AND b.ordinal < g.ordinal GROUP BY ALL""")
def missing_schedules(spark, sf_dir):
    toc = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("document"), F.col("n_nationkey").alias("at"), (F.col("n_nationkey") % 17 + 1).alias("ordinal"), F.col("n_name").alias("code"))
    return S.missing_schedules(toc.filter("at % 3 = 0"), toc)


@query("claimed_placeholders", """
    WITH missing AS (SELECT DISTINCT CAST(o_custkey % 50 AS VARCHAR) AS document, CAST(o_orderkey % 400 AS VARCHAR) AS code FROM orders), notes AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS document, o_orderkey % 60 AS page, CAST(o_custkey % 5 + 1 AS VARCHAR) AS marker, CAST(o_orderkey % 400 AS VARCHAR) AS code FROM orders WHERE o_orderstatus = 'F'),
    lines AS (SELECT CAST(l_suppkey % 50 AS VARCHAR) AS document, l_orderkey * 10 + l_linenumber AS "at", l_orderkey % 60 AS page, CAST(l_linenumber AS VARCHAR) AS marker FROM lineitem WHERE l_returnflag = 'R'),
    f AS (SELECT n.document, n.code, l."at", n.page, n.marker, row_number() OVER (PARTITION BY n.document, n.code ORDER BY l."at" IS NULL, l."at", n.page, n.marker) AS k FROM notes n LEFT JOIN lines l USING (document, page, marker))
    SELECT m.document, m.code, f.page, f.marker, f."at" FROM missing m LEFT JOIN f ON m.document = f.document AND m.code = f.code AND f.k = 1""")
def claimed_placeholders(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    document, code = (F.col("o_custkey") % 50).cast("string").alias("document"), (F.col("o_orderkey") % 400).cast("string")
    notes = orders.filter("o_orderstatus = 'F'").select(document, (F.col("o_orderkey") % 60).alias("page"), (F.col("o_custkey") % 5 + 1).cast("string").alias("marker"), F.concat(F.lit("Section “"), code, F.lit("” omitted by the Act")).alias("text"))
    bracket = F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_returnflag") == "R", "[ ]").otherwise("[text"))
    lines = items.select((F.col("l_suppkey") % 50).cast("string").alias("document"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), (F.col("l_orderkey") % 60).alias("page"), bracket.alias("text"))
    return S.claim_placeholders(orders.select(document, code.alias("code")).distinct(), lines, notes)


@query("discover_structure")
def discover_structure(spark, sf_dir):
    """Documents' lines numbered as sections, so that every document has a rising run with strays in it."""
    ship(spark)
    at = F.col("at")
    number = (F.when(at % 9 == 4, at + 90).otherwise(at) + 1).cast("string")
    text = F.when(at % 20 == 7, F.concat(F.lit("PART "), F.element_at(F.array(*map(F.lit, ("I", "II", "III"))), (at % 3 + 1).cast("int")))).otherwise(F.concat(number, F.lit(". "), F.col("line"), F.lit(".— text")))
    return S.discover(document_lines(spark, sf_dir).select(F.concat_ws("/", "source", "doc_id").alias("document"), at.cast("long").alias("at"), text.alias("text")))


@query("reconcile_containers")
def reconcile_containers(spark, sf_dir):
    """Parts of a brand as contents, two thirds of them as body."""
    ship(spark)
    toc = table(spark, sf_dir, "part").select(F.lit("part").alias("document"), F.col("p_brand").alias("container"), F.col("p_partkey").alias("at"), F.concat(F.lit("DIVISION "), F.col("p_size").cast("string")).alias("code"), F.col("p_name").alias("heading"))
    return S.reconcile_containers(toc.filter("at % 3 > 0"), toc)


@query("continued_tables")
def continued_tables(spark, sf_dir):
    """Items of an order as tables of one row below a head, which continue each other until the flag changes."""
    ship(spark)
    head = F.array(F.lit("Item"), F.col("l_returnflag"))
    grid = F.array(head, F.array(F.col("l_linenumber").cast("string"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("%"))))
    return S.merge_leaf_tables(table(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("document"), F.col("l_orderkey").alias("section_id"), F.col("l_linenumber").cast("long").alias("at"), F.lit("table").alias("kind"), F.col("l_linestatus").alias("text"), grid.alias("grid")))
