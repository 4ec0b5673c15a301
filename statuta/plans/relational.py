"""Queries over orders, line items, customers and parts: statistics, paging, joins, ordered sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from statuta.catalog import query
from statuta.functions import text as T
from statuta.operators import relations as R
from statuta.sources.tables import table


@query("document_stats", """
    SELECT c.c_custkey, count(o_orderkey) AS sections, count(*) FILTER (o_orderstatus = 'F') AS approved, count(*) FILTER (o_orderstatus = 'P') AS has_issues, count(*) FILTER (o_orderstatus = 'O') AS pending,
      CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'blocked' WHEN count(o_orderkey) > 0 AND count(*) FILTER (o_orderstatus = 'F') = count(o_orderkey) THEN 'approved' WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'in_progress' ELSE 'pending' END AS status
    FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey""")
def document_stats(spark, sf_dir):
    of = lambda s: F.count_if(F.col("o_orderstatus") == s)
    stats = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("sections"), of("F").alias("approved"), of("P").alias("has_issues"), of("O").alias("pending"))
    all_ = table(spark, sf_dir, "customer").select("c_custkey").join(stats, "c_custkey", "left").fillna(0)
    status = F.when(F.col("has_issues") > 0, "blocked").when((F.col("sections") > 0) & (F.col("approved") == F.col("sections")), "approved").when(F.col("approved") > 0, "in_progress").otherwise("pending")
    return all_.withColumn("status", status)


@query("library_page", "SELECT c_custkey, c_name, CAST(place AS BIGINT) AS place FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY lower(c_name), c_custkey) AS place FROM customer WHERE c_name ILIKE '%1%' AND c_mktsegment = 'BUILDING') WHERE place > 20 AND place <= 40")
def library_page(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").filter(F.col("c_name").ilike("%1%") & (F.col("c_mktsegment") == "BUILDING")).select("c_custkey", "c_name")
    return R.page(rows, [F.lower("c_name"), F.col("c_custkey")], 20, 20)


@query("keyset_page", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 700 ORDER BY c_custkey LIMIT 50")
def keyset_page(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_custkey > 700").orderBy("c_custkey").limit(50).select("c_custkey", "c_name")


@query("facet_counts", "SELECT 'segment' AS facet, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY c_nationkey UNION ALL SELECT 'health', CASE WHEN c_acctbal < 0 THEN 'outside_gate' ELSE 'within_gate' END, count(*) FROM customer GROUP BY ALL")
def facet_counts(spark, sf_dir):
    health = F.when(F.col("c_acctbal") < 0, "outside_gate").otherwise("within_gate")
    facets = F.array(*(F.struct(F.lit(n).alias("facet"), v.cast("string").alias("value")) for n, v in (("segment", F.col("c_mktsegment")), ("nation", F.col("c_nationkey")), ("health", health))))
    return table(spark, sf_dir, "customer").select(F.explode(facets).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


@query("family_groups", "SELECT p_brand, count(*) AS members, min(p_partkey) AS first_member, count(DISTINCT p_type) AS kinds FROM part GROUP BY p_brand")
def family_groups(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("members"), F.min("p_partkey").alias("first_member"), F.count_distinct("p_type").alias("kinds"))


@query("hierarchy_flatten", """
    SELECT r_name AS chapter, n_name AS part, c_custkey AS division, count(DISTINCT o_orderkey) AS sections, count(l_orderkey) AS footnotes
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def hierarchy_flatten(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    notes = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("notes"))
    leaves = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(notes, "o_orderkey", "left").groupBy("c_custkey").agg(F.count("*").alias("sections"), F.sum(F.coalesce("notes", F.lit(0))).alias("footnotes"))
    tree = t("customer").select("c_custkey", "c_nationkey").join(t("nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return tree.join(leaves, "c_custkey").select(F.col("r_name").alias("chapter"), F.col("n_name").alias("part"), F.col("c_custkey").alias("division"), "sections", "footnotes")


@query("sections_by_page", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 100 AND 300 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 7)")
def sections_by_page(spark, sf_dir):
    """Leaves whose range holds a page, or that a footnote of the page belongs to."""
    noted = table(spark, sf_dir, "lineitem").filter("l_quantity = 7").select(F.col("l_orderkey").alias("noted")).distinct()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(noted, F.col("o_orderkey") == F.col("noted"), "left")
    return orders.filter(F.col("o_custkey").between(100, 300) | F.col("noted").isNotNull()).select("o_orderkey")


@query("ocr_point_in_interval", """
    WITH i AS (SELECT o_orderkey, o_custkey * 10 AS lo, o_custkey * 10 + 25 AS hi FROM orders WHERE o_orderkey % 20 = 0)
    SELECT event_id, min(o_orderkey) AS leaf FROM events LEFT JOIN i ON user_id BETWEEN lo AND hi GROUP BY event_id""")
def ocr_point_in_interval(spark, sf_dir):
    return leaf_of_events(table(spark, sf_dir, "events"), table(spark, sf_dir, "orders").filter("o_orderkey % 20 = 0"))


@query("ocr_point_in_interval_all", """
    WITH i AS (SELECT o_orderkey, o_custkey * 10 AS lo, o_custkey * 10 + 25 AS hi FROM orders)
    SELECT event_id, min(o_orderkey) AS leaf FROM events LEFT JOIN i ON user_id BETWEEN lo AND hi GROUP BY event_id""")
def ocr_point_in_interval_all(spark, sf_dir):
    """ocr_point_in_interval with all leaves."""
    return leaf_of_events(table(spark, sf_dir, "events"), table(spark, sf_dir, "orders"))


def leaf_of_events(events, orders):
    leaves = orders.select("o_orderkey", (F.col("o_custkey") * 10).alias("lo"), (F.col("o_custkey") * 10 + 25).alias("hi"))
    hit = R.point_in_interval(events.select("event_id", "user_id"), leaves, "event_id", "user_id", "lo", "hi", ["o_orderkey"], 32)
    return hit.select("event_id", F.col("hit.o_orderkey").alias("leaf"))


@query("occurrence_match", """
    WITH o AS (SELECT doc_id, lang, length(text) // 50 AS page FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id, lang, length(text) // 50 AS page FROM documents WHERE doc_id % 2 = 1)
    SELECT o.doc_id AS old_id, min(n.doc_id) AS new_id FROM o JOIN n ON o.lang IS NOT DISTINCT FROM n.lang AND n.page BETWEEN o.page - 1 AND o.page + 1 GROUP BY o.doc_id HAVING count(*) = 1""")
def occurrence_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.floor(F.char_length("text") / 50).alias("page"))
    return R.unique_band_match(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), ["lang"], "page", 1, "doc_id", "doc_id")


@query("folio_consensus", """
    WITH p AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey % 40 AS printed FROM orders),
    v AS (SELECT doc, page + d AS page, printed + d AS candidate, count(*) AS votes FROM p, (SELECT unnest(range(-5, 6)) AS d) WHERE printed > 0 AND printed + d > 0 GROUP BY ALL),
    r AS (SELECT p.doc, p.page, p.printed, candidate, votes, row_number() OVER (PARTITION BY p.doc, p.page ORDER BY votes DESC NULLS LAST, (candidate = p.printed) DESC, candidate) AS k FROM p LEFT JOIN v USING (doc, page))
    SELECT doc, page, printed AS mine, coalesce(candidate, printed) AS voted, coalesce(votes, 0) AS votes FROM r WHERE k = 1""")
def folio_consensus(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.row_number().over(w).cast("long").alias("page"), (F.col("o_orderkey") % 40).alias("printed"))
    return R.folio_votes(pages, "doc", "page", "printed")


@query("footnote_runs", """
    WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, lag(l_returnflag) OVER w AS prev, row_number() OVER w AS k FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
    r AS (SELECT *, sum(CASE WHEN prev = l_returnflag THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY k) AS run FROM f)
    SELECT l_orderkey, CAST(run AS BIGINT) AS run, l_returnflag, count(*) AS lines, min(k) AS first_line, max(k) AS last_line FROM r GROUP BY ALL""")
def footnote_runs(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long")
    lines = R.runs(table(spark, sf_dir, "lineitem").withColumn("k", k), ["l_orderkey"], order, "l_returnflag")  # the order of k, so that rows are sorted once
    return lines.groupBy("l_orderkey", "run", "l_returnflag").agg(F.count("*").alias("lines"), F.min("k").alias("first_line"), F.max("k").alias("last_line"))


@query("size_changepoint", """
    WITH f AS (SELECT l_orderkey, CAST(l_quantity > 25 AS INTEGER) AS big, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS k FROM lineitem),
    s AS (SELECT l_orderkey, k, coalesce(sum(big) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(1 - big) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS score FROM f
          UNION ALL SELECT l_orderkey, count(*), sum(big) FROM f GROUP BY l_orderkey),
    b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, k) AS place, max(k) OVER (PARTITION BY l_orderkey) AS n FROM s)
    SELECT l_orderkey, k, CAST(score AS BIGINT) AS score, n FROM b WHERE place = 1""")
def size_changepoint(spark, sf_dir):
    return R.changepoint(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_quantity") > 25)


@query("code_sort_order", """
    WITH c AS (SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'A' WHEN 2 THEN 'AB' ELSE '-B' END AS code FROM part)
    SELECT p_partkey, code, row_number() OVER (ORDER BY CAST(regexp_extract(code, '^([0-9]{1,3})', 1) AS INTEGER), regexp_extract(code, '([A-Z]*)$', 1), p_partkey) AS place FROM c""")
def code_sort_order(spark, sf_dir):
    """The place of each code in the statute's order.

    The rank over all rows is made of ranks within code numbers and running totals over these, which are few.
    """
    tail = F.element_at(F.array(F.lit(""), F.lit("A"), F.lit("AB"), F.lit("-B")), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), tail).alias("code")).withColumn("key", T.code_sort_key(F.col("code")))
    sizes = rows.groupBy("key.number").agg(F.count("*").alias("n"))
    before = sizes.select("number", (F.sum("n").over(Window.orderBy("number")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("key.number").orderBy("key.suffix", "p_partkey"))
    return rows.withColumn("within", within).withColumn("number", F.col("key.number")).join(before, "number").select("p_partkey", "code", (F.col("before") + F.col("within")).alias("place"))


@query("codes_monotone", """
    WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lag(l_linenumber) OVER w AS prev FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice))
    SELECT l_orderkey, count(*) AS breaks FROM o WHERE prev > l_linenumber GROUP BY l_orderkey""")
def codes_monotone(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lag("l_linenumber").over(w).alias("prev")).filter("prev > l_linenumber").groupBy("l_orderkey").agg(F.count("*").alias("breaks"))


@query("ordinals_contiguous", "SELECT l_orderkey, ordinal AS missing FROM (SELECT l_orderkey, unnest(range(min(l_linenumber), max(l_linenumber) + 1)) AS ordinal FROM lineitem GROUP BY l_orderkey) EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem")
def ordinals_contiguous(spark, sf_dir):
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"), F.collect_set("l_linenumber").alias("held"))
    return by.select("l_orderkey", F.explode(F.array_except(F.sequence("lo", "hi"), "held")).alias("missing")).select("l_orderkey", F.col("missing").cast("long").alias("missing"))


@query("unique_marker_citation", "SELECT l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem WHERE l_returnflag = 'R') WHERE n = 1")
def unique_marker_citation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.min("l_orderkey").alias("l_orderkey"), F.count("*").alias("n")).filter("n = 1").select("l_orderkey", "l_partkey")


@query("mode_and_leftmost", """
    WITH c AS (SELECT l_suppkey, round(l_quantity) AS size, count(*) AS n, min(l_orderkey) AS first_at FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, first_at, size) AS k FROM c)
    SELECT l_suppkey, size AS modal_size, n, (SELECT min(size) FROM c d WHERE d.l_suppkey = r.l_suppkey AND d.n >= 4) AS leftmost FROM r WHERE k = 1""")
def mode_and_leftmost(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.round("l_quantity").alias("size")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_at"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "first_at", "size"))
    return counts.groupBy("l_suppkey").agg(best.alias("b"), F.min(F.when(F.col("n") >= 4, F.col("size"))).alias("leftmost")).select("l_suppkey", F.col("b.size").alias("modal_size"), (-F.col("b.n")).alias("n"), "leftmost")


@query("ocr_fidelity", """
    WITH p AS (SELECT l_suppkey, l_orderkey, 100.0 * count(*) FILTER (l_returnflag <> 'R') / count(*) AS agreement, count(*) AS tokens, count(*) FILTER (l_discount < 0.02) AS low FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, round(avg(CAST(agreement AS DOUBLE)), 4) AS agreement, round(CAST(100.0 * sum(low) / sum(tokens) AS DOUBLE), 4) AS low_share, avg(CAST(agreement AS DOUBLE)) >= 85 AND 100.0 * sum(low) / sum(tokens) <= 15 AS admitted FROM p GROUP BY l_suppkey""")
def ocr_fidelity(spark, sf_dir):
    """Agreement is a mean over pages, the share of doubtful tokens over tokens; both must be within the floor."""
    pages = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg((100.0 * F.count_if(F.col("l_returnflag") != "R") / F.count("*")).alias("agreement"), F.count("*").alias("tokens"), F.count_if(F.col("l_discount") < 0.02).alias("low"))
    by = pages.groupBy("l_suppkey").agg(F.avg("agreement").alias("a"), (100.0 * F.sum("low") / F.sum("tokens")).alias("s"))
    return by.select("l_suppkey", F.round("a", 4).alias("agreement"), F.round("s", 4).alias("low_share"), ((F.col("a") >= 85) & (F.col("s") <= 15)).alias("admitted"))


@query("orphan_adoption", """
    WITH leaf AS (SELECT o_orderkey, o_custkey AS lo, o_custkey + 3 AS hi FROM orders WHERE o_orderkey % 10 = 0), note AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 100 AS page FROM lineitem WHERE l_returnflag = 'R'),
    r AS (SELECT note.*, leaf.o_orderkey, row_number() OVER (PARTITION BY page ORDER BY lo, hi, o_orderkey) AS k FROM (SELECT DISTINCT page FROM note) note JOIN leaf ON page BETWEEN lo AND hi)
    SELECT page, r.o_orderkey AS leaf, count(*) AS notes FROM r JOIN note USING (page) WHERE k = 1 GROUP BY ALL""")
def orphan_adoption(spark, sf_dir):
    """Notes go to the first leaf, by start, then end, that covers their page."""
    return adopted(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 0"))


@query("orphan_adoption_all", """
    WITH leaf AS (SELECT o_orderkey, o_custkey AS lo, o_custkey + 3 AS hi FROM orders), note AS (SELECT l_suppkey % 100 AS page, count(*) AS notes FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
    r AS (SELECT page, notes, o_orderkey, row_number() OVER (PARTITION BY page ORDER BY lo, hi, o_orderkey) AS k FROM note JOIN leaf ON page BETWEEN lo AND hi)
    SELECT page, o_orderkey AS leaf, notes FROM r WHERE k = 1""")
def orphan_adoption_all(spark, sf_dir):
    """orphan_adoption with all leaves."""
    return adopted(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


def adopted(lineitem, orders):
    leaf = orders.select("o_orderkey", F.col("o_custkey").alias("lo"), (F.col("o_custkey") + 3).alias("hi"))
    notes = lineitem.filter("l_returnflag = 'R'").select((F.col("l_suppkey") % 100).alias("page")).groupBy("page").agg(F.count("*").alias("notes"))
    hit = R.point_in_interval(notes, leaf, "notes", "page", "lo", "hi", ["lo", "hi", "o_orderkey"], 8)
    return hit.filter("hit.o_orderkey IS NOT NULL").select("page", F.col("hit.o_orderkey").alias("leaf"), "notes")


@query("push_plan", """
    WITH l AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), r AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0)
    SELECT l.c_custkey, CASE WHEN r.c_custkey IS NULL THEN 'upload' WHEN r.c_acctbal <> l.c_acctbal THEN 'refresh' ELSE 'skip' END AS action FROM l LEFT JOIN r USING (c_custkey)""")
def push_plan(spark, sf_dir):
    local = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select("c_custkey", "c_acctbal")
    remote = table(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("there"))
    return local.join(remote, "c_custkey", "left").select("c_custkey", F.when(F.col("there").isNull(), "upload").when(F.col("there") != F.col("c_acctbal"), "refresh").otherwise("skip").alias("action"))


@query("qa_export_flat", "SELECT o_orderkey, o_custkey, o_orderstatus, count(l_orderkey) AS annotations, count(*) FILTER (l_returnflag = 'R') AS open_annotations, round(100.0 * count(*) FILTER (l_returnflag <> 'R') / greatest(count(l_orderkey), 1), 2) AS completion FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def qa_export_flat(spark, sf_dir):
    notes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("annotations"), F.count_if(F.col("l_returnflag") == "R").alias("open_annotations"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(notes, "o_orderkey", "left").fillna(0)
    done = F.col("annotations") - F.col("open_annotations")
    return rows.withColumn("completion", F.round(100.0 * done / F.greatest("annotations", F.lit(1)), 2))


@query("schema_checks", """
    SELECT 'orders_fk_customer' AS check_name, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'lineitem_fk_orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'documents_unique_id', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)
    UNION ALL SELECT 'orders_status_domain', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F', 'P')
    UNION ALL SELECT 'lineitem_unique_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def schema_checks(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    found = {
        "orders_fk_customer": t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "lineitem_fk_orders": t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "documents_unique_id": t("documents").groupBy("doc_id").count().filter("count > 1"),
        "orders_status_domain": t("orders").filter(~F.col("o_orderstatus").isin("O", "F", "P")),
        "lineitem_unique_line": t("lineitem").groupBy("l_orderkey", "l_linenumber").count().filter("count > 1"),
    }
    out = None
    for name, rows in found.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
        out = one if out is None else out.unionByName(one)
    return out
