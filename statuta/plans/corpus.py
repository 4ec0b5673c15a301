"""Queries over leaves: detectors, flags, variants, lanes, search and text audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.catalog import query
from statuta.functions import python as P
from statuta.functions import text as T
from statuta.operators import detectors as D
from statuta.operators import relations as R
from statuta.operators.joins import small
from statuta.session import cut, ship
from statuta.sources.tables import html_leaves, leaves, table

SPACED = r"trim(regexp_replace(coalesce({x}, ''), '[ \t\r\n]+', ' ', 'g'))"
BARE = r"regexp_replace(regexp_replace({x}, '^[ \t\r\n]+', ''), '[ \t\r\n]+$', '')"
STRIPPED = r"trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"
SHAPE = r"sha256(lower(array_to_string(regexp_extract_all(coalesce(html, ''), '(?i)<(/?(?:p|div|table|thead|tbody|tr|td|th|ul|ol|li|h[1-6]|section|article|br))\b', 1), '|')))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


REGRESSION_SQL = f"""
WITH o AS (
  SELECT doc_id, source, lang, length({BARE.format(x="coalesce(text, '')")}) AS len, regexp_matches(text, '(?i)\\b(omitted|repealed)\\b') AS gone FROM documents
), p AS (
  SELECT *, lag(doc_id) OVER w AS prev_id, lag(len) OVER w AS prev_len FROM o WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)
)
SELECT doc_id AS section_id, source AS family_key, lang AS section_code, prev_id, CAST(len AS BIGINT) AS len, CAST(prev_len AS BIGINT) AS prev_len,
       round(1 - CAST(len AS DOUBLE) / greatest(prev_len, 1), 3) AS score
FROM p WHERE prev_len >= 300 AND len < 0.25 * prev_len AND NOT coalesce(gone, false)
"""


@query("detect_regression", REGRESSION_SQL)
def detect_regression(spark, sf_dir):
    return D.regression(leaves(spark, sf_dir))


HEADING_SQL = f"""
WITH b AS (
  SELECT doc_id, text, length({SPACED.format(x="text")}) AS body_len, length({SPACED.format(x="split_part(coalesce(text, ''), chr(10), 1)")}) AS heading_len FROM documents
)
SELECT doc_id AS section_id, CAST(body_len AS BIGINT) AS body_len, CAST(heading_len AS BIGINT) AS heading_len, CAST(0.9 AS DOUBLE) AS score
FROM b WHERE body_len > 0 AND NOT regexp_matches(text, '(?i)\\b(omitted|repealed)\\b') AND abs(body_len - heading_len) <= 12
"""


@query("detect_heading_only", HEADING_SQL)
def detect_heading_only(spark, sf_dir):
    return D.heading_only(leaves(spark, sf_dir), T.first_line(F.col("plain_text")))


SHORT_SQL = """
WITH l AS (
  SELECT doc_id AS section_id, source AS family_key, lang AS section_code, CAST(length(coalesce(text, '')) AS BIGINT) AS len FROM documents
), r AS (
  SELECT *, count(*) OVER (PARTITION BY family_key, section_code) AS n, row_number() OVER (PARTITION BY family_key, section_code ORDER BY len, section_id) AS k FROM l
), m AS (
  SELECT *, max(CASE WHEN k = n // 2 + 1 THEN len END) OVER (PARTITION BY family_key, section_code) AS median FROM r
)
SELECT section_id, family_key, section_code, len, median, round(1 - CAST(len AS DOUBLE) / median, 3) AS score
FROM m WHERE n >= 3 AND median >= 50 AND len < 0.2 * median
"""


@query("detect_short_vs_siblings", SHORT_SQL)
def detect_short_vs_siblings(spark, sf_dir):
    return D.short_vs_siblings(leaves(spark, sf_dir), ["family_key", "section_code"])


# the operator's pattern with word borders in place of look-arounds
GLYPHS = r"(?i)(?:\b[A-Z]\s+[A-Z](?:\s+[A-Z])+\b)|(?:CHAP\s+TER)|(?:SCHED\s+ULE)|(?:SECT\s+ION)|(?:\bO\s+mitted\b)|(?:\bR\s+epealed\b)"
GLYPH_SQL = rf"""
WITH h AS (SELECT doc_id, regexp_extract_all(text, '{GLYPHS}')[1:5] AS hits FROM documents)
SELECT doc_id AS section_id, CAST(i AS BIGINT) AS "at", substr(hits[i + 1], 1, 80) AS fragment, CAST(0.7 AS DOUBLE) AS score
FROM (SELECT doc_id, hits, unnest(range(len(hits))) AS i FROM h)
"""


@query("detect_glyph_split", GLYPH_SQL)
def detect_glyph_split(spark, sf_dir):
    return D.glyph_split(leaves(spark, sf_dir))


#: Pages twice, the second time in another markup where they have paragraphs.
DRIFTED_SQL = "(SELECT page_id, url, html FROM pages UNION ALL SELECT page_id + 1000000000, url, replace(replace(html, '<p>', '<div>'), '</p>', '</div>') FROM pages)"
DRIFT_SQL = f"""
WITH l AS (SELECT page_id AS section_id, regexp_extract(url, '://[^/]*/([a-z]{{2}})/', 1) AS section_code, sha256({STRIPPED}) AS text_sha, {SHAPE} AS shape FROM {DRIFTED_SQL}),
d AS (SELECT section_code, text_sha, count(*) AS members, count(DISTINCT shape) AS shapes FROM l GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT shape) > 1)
SELECT section_id, section_code, members, shapes, CAST(0.4 AS DOUBLE) AS score FROM l JOIN d USING (section_code, text_sha)
"""


@query("detect_markup_drift", DRIFT_SQL)
def detect_markup_drift(spark, sf_dir):
    rows = html_leaves(spark, sf_dir)
    other = F.replace(F.replace("html_content", F.lit("<p>"), F.lit("<div>")), F.lit("</p>"), F.lit("</div>"))
    rows = rows.union(rows.withColumn("section_id", F.col("section_id") + 1_000_000_000).withColumn("html_content", other))
    return D.markup_drift(rows, ["section_code"])


@query(
    "detectors_union",
    f"""
    WITH f AS (
      SELECT section_id, 'regression_vs_previous_edition' AS detector, 'error' AS severity, score FROM ({REGRESSION_SQL})
      UNION ALL SELECT section_id, 'heading_only_body', 'warning', score FROM ({HEADING_SQL})
      UNION ALL SELECT section_id, 'short_vs_siblings', 'warning', score FROM ({SHORT_SQL})
      UNION ALL SELECT section_id, 'glyph_split', 'warning', score FROM ({GLYPH_SQL})
      UNION ALL SELECT section_id, 'markup_only_drift', 'info', score FROM ({DRIFT_SQL})
    ) SELECT section_id, detector, severity, count(*) AS findings, max(score) AS score FROM f GROUP BY section_id, detector, severity
    """,
)
def detectors_union(spark, sf_dir):
    """Texts are read once, for all detectors."""
    heading = T.first_line(F.col("plain_text"))
    rows = cut(D.readings(leaves(spark, sf_dir), heading))
    return D.union(
        ("regression_vs_previous_edition", "error", D.regression(rows)), ("heading_only_body", "warning", D.heading_only(rows, heading)), ("short_vs_siblings", "warning", D.short_vs_siblings(rows, ["family_key", "section_code"])),
        ("glyph_split", "warning", D.glyph_split(rows)), ("markup_only_drift", "info", detect_markup_drift(spark, sf_dir)),
    )


FLAGS_SQL = rf"""
WITH b AS (
  SELECT page_id, coalesce(html, '') AS html, {STRIPPED} AS body, trim(coalesce(url, '')) AS heading FROM pages
), f AS (
  SELECT page_id, list_filter([
    CASE WHEN regexp_matches(html, '(?i)(?:Table\s+\d+|see\s+Table)\b') AND NOT regexp_matches(html, '(?i)<table\b') THEN 'missing_table' END,
    CASE WHEN regexp_matches(body, '[A-Za-z]{{3,}}[0-9]\b') AND NOT regexp_matches(html, '(?i)<sup\b[^>]*>|class\s*=\s*["''][^"'']*\bcite\b') THEN 'footnote_glue' END,
    CASE WHEN length(body) > 800 AND len(regexp_extract_all(html, '(?i)<(?:p|table|ul|ol|div|li|h[1-6])\b')) <= 1 THEN 'wall_of_text' END,
    CASE WHEN heading <> '' AND (length(heading) > 120 OR len(regexp_extract_all(heading, '[.!?](?:\s|$)')) >= 2) THEN 'heading_body_bleed' END
  ], lambda x: x IS NOT NULL) AS flags FROM b
)
"""


def _flags(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    none = F.lit(None).cast("int")
    return pages.select("page_id", T.quality_flags(F.col("html"), F.lit(""), F.col("url"), none, none, none).alias("flags"))


@query("quality_flags", FLAGS_SQL + "SELECT page_id, unnest(flags) AS flag FROM f")
def quality_flags(spark, sf_dir):
    return _flags(spark, sf_dir).select("page_id", F.explode("flags").alias("flag"))


@query("flag_histogram", FLAGS_SQL + "SELECT flag, count(*) AS leaves FROM (SELECT unnest(flags) AS flag FROM f) GROUP BY flag")
def flag_histogram(spark, sf_dir):
    return quality_flags(spark, sf_dir).groupBy("flag").agg(F.count("*").alias("leaves"))


@query("offenders_ranked", FLAGS_SQL + "SELECT * FROM (SELECT page_id, CAST(len(flags) AS BIGINT) AS flag_count, row_number() OVER (ORDER BY len(flags) DESC, page_id) AS place FROM f) WHERE place <= 25")
def offenders_ranked(spark, sf_dir):
    counted = _flags(spark, sf_dir).select("page_id", F.size("flags").cast("long").alias("flag_count"))
    return R.page(counted, [F.desc("flag_count"), F.col("page_id")], 0, 25)


VARIANT_SQL = f"SELECT doc_id, source, lang, sha256(concat_ws('|', {SPACED.format(x='lang')}, {SPACED.format(x='text')})) AS variant_key FROM documents"


def _variants(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "source", "lang", T.variant_key(F.col("lang"), F.col("text")).alias("variant_key"))


@query("variant_key", VARIANT_SQL)
def variant_key(spark, sf_dir):
    return _variants(spark, sf_dir)


@query("variant_groups", f"SELECT variant_key, count(*) AS members, min(doc_id) AS first_doc, max(doc_id) AS last_doc, count(DISTINCT source) AS families FROM ({VARIANT_SQL}) GROUP BY variant_key HAVING count(*) > 1")
def variant_groups(spark, sf_dir):
    by = _variants(spark, sf_dir).groupBy("variant_key")
    return by.agg(F.count("*").alias("members"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count_distinct("source").alias("families")).filter("members > 1")


@query("blast_radius", f"WITH v AS ({VARIANT_SQL}), g AS (SELECT variant_key, count(*) AS radius, count(DISTINCT source) > 1 AS cross_family FROM v GROUP BY variant_key) SELECT doc_id, greatest(coalesce(radius, 1), 1) AS radius, cross_family FROM v JOIN g USING (variant_key)")
def blast_radius(spark, sf_dir):
    """Keys are computed once: a join on them would compute them for either side, and again for its filter of nulls."""
    v = cut(_variants(spark, sf_dir).drop("lang"))
    g = v.groupBy("variant_key").agg(F.count("*").alias("radius"), (F.count_distinct("source") > 1).alias("cross_family"))
    return v.join(g, "variant_key").select("doc_id", F.greatest("radius", F.lit(1)).alias("radius"), "cross_family")


@query(
    "approval_inheritance",
    f"""
    WITH v AS ({VARIANT_SQL}), a AS (SELECT variant_key, min(doc_id) AS origin FROM v JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 GROUP BY variant_key),
    blocked AS (SELECT doc_id FROM labels WHERE toxic = 1)
    SELECT v.doc_id, a.origin, CASE WHEN v.doc_id = a.origin THEN 'approved' ELSE 'inherited' END AS status
    FROM v JOIN a USING (variant_key) WHERE v.doc_id NOT IN (SELECT doc_id FROM blocked)
    """,
)
def approval_inheritance(spark, sf_dir):
    v, labels = cut(_variants(spark, sf_dir).select("doc_id", "variant_key")), table(spark, sf_dir, "labels")
    approved = v.join(labels.filter("quality = 1 AND toxic = 0"), "doc_id").groupBy("variant_key").agg(F.min("doc_id").alias("origin"))
    free = v.join(labels.filter("toxic = 1"), "doc_id", "left_anti")
    return free.join(approved, "variant_key").select("doc_id", "origin", F.when(F.col("doc_id") == F.col("origin"), "approved").otherwise("inherited").alias("status"))


@query("html_shapes", f"SELECT page_id, {SHAPE} AS shape, sha256({STRIPPED}) AS text_sha FROM pages")
def html_shapes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_hashes(F.col("html")).alias("h")).select("page_id", "h.shape", "h.text_sha")


@query(
    "lane_classify",
    """
    WITH p AS (SELECT p_partkey, lower(CASE p_partkey % 6 WHEN 0 THEN 'Sales Tax Rules ' WHEN 1 THEN 'Customs Act, 1969 ' WHEN 2 THEN 'Finance Act, 2019 ' WHEN 3 THEN 'Income Tax Ordinance ' WHEN 4 THEN 'Federal Excise ' ELSE 'Tax Laws (Amendment) ' END || p_type) AS t FROM part)
    SELECT p_partkey, CASE WHEN regexp_matches(t, '\\b(rules?|regulations?)\\b') THEN CASE WHEN contains(t, 'income tax rule') THEN 'income_tax_rules' WHEN contains(t, 'sales tax rule') OR contains(t, 'sales tax special procedure') THEN 'sales_tax_rules' WHEN contains(t, 'customs rule') THEN 'customs_rules' WHEN contains(t, 'federal excise rule') THEN 'federal_excise_rules' ELSE 'other_rules' END
      WHEN contains(t, 'income tax ordinance') THEN 'ordinance' WHEN contains(t, 'customs act') THEN 'customs' WHEN contains(t, 'sales tax act') THEN 'sales_tax' WHEN contains(t, 'federal excise') THEN 'federal_excise'
      WHEN contains(t, 'tax laws') AND contains(t, 'amendment') THEN 'tax_laws_amendment' WHEN contains(t, 'finance supplementary') OR regexp_matches(t, '\\bfinance act\\b') THEN 'finance' ELSE 'other_acts' END AS lane
    FROM p
    """,
)
def lane_classify(spark, sf_dir):
    title = F.element_at(F.array(*map(F.lit, ("Sales Tax Rules ", "Customs Act, 1969 ", "Finance Act, 2019 ", "Income Tax Ordinance ", "Federal Excise ", "Tax Laws (Amendment) "))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.lane(F.concat(title, "p_type"), F.lit("acts_corpus"), F.lit(None).cast("string")).alias("lane"))


@query(
    "family_and_edition",
    r"""
    WITH n AS (SELECT o_orderkey, 'Statute of ' || o_orderpriority || ', ' || CAST(year(o_orderdate) AS VARCHAR) || ' amended' AS name FROM orders)
    SELECT o_orderkey, lower(trim(regexp_replace(name, ',?\s*(?:19|20)\d{2}[\s\S]*$', ''))) AS family_key, CAST(regexp_extract(name, '((?:19|20)\d{2})', 1) AS INTEGER) AS edition_year FROM n
    """,
)
def family_and_edition(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("Statute of "), "o_orderpriority", F.lit(", "), F.year("o_orderdate").cast("string"), F.lit(" amended"))
    return orders.select("o_orderkey", T.family_key(name).alias("family_key"), T.edition_year(name).alias("edition_year"))


@query("search_prefix", r"""
    WITH t AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z0-9_]+') AS w FROM documents)
    SELECT doc_id, CAST(len(list_filter(w, lambda x: starts_with(x, 'th') OR starts_with(x, 'ing'))) AS BIGINT) AS hits FROM t
    WHERE len(list_filter(w, lambda x: starts_with(x, 'th'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'ing'))) > 0""")
def search_prefix(spark, sf_dir):
    begins = lambda terms: rf"(?:^|[^a-z0-9_])(?:{'|'.join(terms)})"
    terms = T.search_terms("th* & ing")
    low = docs(spark, sf_dir).select("doc_id", F.lower("text").alias("low"))
    every = reduce(lambda a, b: a & b, [F.col("low").rlike(begins([t])) for t in terms])
    return low.filter(every).select("doc_id", F.regexp_count("low", F.lit(begins(terms))).cast("long").alias("hits"))


@query("search_ilike", "SELECT doc_id, source, lang FROM documents WHERE text ILIKE '%license%'")
def search_ilike(spark, sf_dir):
    return docs(spark, sf_dir).filter(F.col("text").ilike("%license%")).select("doc_id", "source", "lang")


@query(
    "search_snippet",
    """
    WITH m AS (SELECT doc_id, text, strpos(lower(text), 'license') - 1 AS p, length(text) AS n FROM documents WHERE strpos(lower(text), 'license') > 0)
    SELECT doc_id, (CASE WHEN p > 50 THEN '…' ELSE '' END) || substr(text, CAST(greatest(0, p - 50) + 1 AS BIGINT), CAST(least(n, p + 77) - greatest(0, p - 50) AS BIGINT)) || (CASE WHEN p + 77 < n THEN '…' ELSE '' END) AS snippet,
           CAST((n - length(replace(lower(text), 'license', ''))) // 7 AS BIGINT) AS matches FROM m
    """,
)
def search_snippet(spark, sf_dir):
    hit = docs(spark, sf_dir).filter(F.locate("license", F.lower("text")) > 0)
    return hit.select("doc_id", T.snippet(F.col("text"), "license").alias("s")).select("doc_id", "s.snippet", "s.matches")


@query("hyphen_vocabulary", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z]+')) AS word FROM documents) GROUP BY word HAVING count(*) >= 3")
def hyphen_vocabulary(spark, sf_dir):
    words = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z][A-Za-z]+)"), 1)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 3")


#: Bytes of text whose words one task counts.
DEALT = 8 << 20


@query("conservation_audit", """
    WITH s AS (SELECT doc_id, word, count(*) AS s FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z]+')) AS word FROM documents) GROUP BY ALL),
    o AS (SELECT doc_id, word, count(*) AS o FROM (SELECT doc_id, unnest(regexp_extract_all(substr(text, 1, length(text) * 9 // 10), '[A-Za-z][A-Za-z]+')) AS word FROM documents) GROUP BY ALL)
    SELECT doc_id, CAST(sum(s) AS BIGINT) AS words, CAST(sum(greatest(s - coalesce(o, 0), 0)) AS BIGINT) AS missing, round(100.0 * CAST(sum(s) - sum(greatest(s - coalesce(o, 0), 0)) AS DOUBLE) / CAST(sum(s) AS DOUBLE), 3) AS conserved
    FROM s LEFT JOIN o USING (doc_id, word) GROUP BY doc_id""")
def conservation_audit(spark, sf_dir):
    """Words of whole texts that their first nine tenths lack. Texts are dealt by id, about DEALT bytes to a task, and not their words with an id each."""
    part = F.substring(F.col("text"), F.lit(1), F.floor(F.char_length("text") * 9 / 10).cast("int"))
    words = lambda x, kept: F.transform(F.regexp_extract_all(x, F.lit("([A-Za-z][A-Za-z]+)"), 1), lambda w: F.struct(w.alias("word"), F.lit(kept).alias("kept")))
    tasks = max(spark.sparkContext.defaultParallelism, (docs(spark, sf_dir).agg(F.sum(F.octet_length("text"))).first()[0] or 0) // DEALT)
    rows = docs(spark, sf_dir).select("doc_id", "text").repartition(tasks, "doc_id").select("doc_id", F.explode(F.concat(words(F.col("text"), False), words(part, True))).alias("w")).select("doc_id", "w.word", "w.kept")
    return R.conservation(rows, "doc_id")


@query("amending_density", "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z])(?:the|und|les)(?:[^A-Za-z]|$)')) AS BIGINT) AS hits, round(10000.0 * len(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z])(?:the|und|les)(?:[^A-Za-z]|$)')) / length(text), 3) AS density FROM documents WHERE length(text) > 0")
def amending_density(spark, sf_dir):
    hits = F.regexp_count("text", F.lit(r"(?i)(?:^|[^A-Za-z])(?:the|und|les)(?:[^A-Za-z]|$)"))
    return docs(spark, sf_dir).filter(F.char_length("text") > 0).select("doc_id", hits.cast("long").alias("hits"), F.round(F.lit(10000.0) * hits / F.char_length("text"), 3).alias("density"))


@query("text_density", "SELECT source, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, round(CAST(sum(length(text)) AS DOUBLE) / count(*), 3) AS density, CAST(sum(length(text)) AS DOUBLE) / count(*) < 200 AS implausible FROM documents GROUP BY source")
def text_density(spark, sf_dir):
    by = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("pages"), F.sum(F.char_length("text").cast("long")).alias("chars"))
    ratio = F.col("chars") / F.col("pages")
    return by.select("source", "pages", "chars", F.round(ratio, 3).alias("density"), (ratio < 200).alias("implausible"))


@query("dedupe_exact", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def dedupe_exact(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("source_key_collision", "SELECT regexp_extract(url, '([^/]*)$', 1) AS stem, count(DISTINCT regexp_extract(url, '://([^/?#]*)', 1)) AS corpora FROM pages GROUP BY ALL HAVING count(DISTINCT regexp_extract(url, '://([^/?#]*)', 1)) > 1")
def source_key_collision(spark, sf_dir):
    stem = F.regexp_extract("url", "([^/]*)$", 1)
    return table(spark, sf_dir, "pages").groupBy(stem.alias("stem")).agg(F.count_distinct(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("corpora")).filter("corpora > 1")


@query("verbatim_quotes", "SELECT item_id, doc_id, CAST(strpos(d.text, b.text) AS BIGINT) AS place FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def verbatim_quotes(spark, sf_dir):
    """Passages that documents contain. Passages and documents meet on the hash of a word pair, each passage's rarest, not all with all.

    Only ids and pairs meet; texts are fetched for the documents that were met. Passages of fewer than four words
    have no pair of inner words: they are sought in all documents, as a broadcast if they are few enough.
    """
    pairs = lambda w: F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1))), F.lit(1), F.greatest(F.lit(1), F.size(w) - 1))
    words = lambda x: F.regexp_extract_all(x, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"), words("text").alias("w")).filter("quote IS NOT NULL")
    short = quotes.filter("size(w) < 4").select("item_id", "quote")
    long = quotes.filter("size(w) >= 4")
    # inner words only: a passage may begin and end within a word of the document
    inner = long.select("item_id", "quote", F.slice("w", F.lit(2), F.size("w") - 2).alias("w")).select("item_id", "quote", F.explode(F.array_distinct(pairs(F.col("w")))).alias("pair"))
    held = docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", words("text").alias("w")).select(F.col("doc_id").alias("held_id"), F.explode(F.array_distinct(pairs(F.col("w")))).alias("pair"))
    wanted = inner.select("pair").distinct()
    counts = held.join(small(wanted), "pair").groupBy("pair").agg(F.count("*").alias("n"))
    rarest = inner.join(counts, "pair").groupBy("item_id", "quote").agg(F.min_by("pair", F.struct("n", "pair")).alias("pair"))
    met = held.join(small(rarest), "pair").select("held_id", "item_id", "quote").distinct()
    found = docs(spark, sf_dir).join(met, F.col("doc_id").eqNullSafe(F.col("held_id"))).filter(F.contains("text", "quote")).select("item_id", "doc_id", "text", "quote")
    found = found.union(docs(spark, sf_dir).join(small(short), F.contains("text", "quote")).select("item_id", "doc_id", "text", "quote"))
    return found.select("item_id", "doc_id", F.position("quote", "text").cast("long").alias("place")).distinct()


INVARIANTS = {
    "no_glued_marker_digit": r"[a-z]\d\[",
    "no_split_ordinals": r"\b\d+ (?:st|nd|rd|th)\b",
    "no_jammed_words": r"[A-Za-z]{25,}",
    "no_control_chars": r"[\x00-\x08\x0B\x0C\x0E-\x1F]",
    "no_stray_dotnumber": r"(?m)^\.\d{2,}$",
    "no_stray_space_hyphen": r"[a-z]- [a-z]",
}


#: Damage that is put at the end of texts, one for each invariant.
DAMAGE = [" word7[x", " in the 21 st year", " abcdefghijklmnopqrstuvwxyzabc ", " bell\x07", "\n.12\n", " self- made"]
DAMAGED_SQL = "(SELECT doc_id, coalesce(text, '') || CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DAMAGE)) + " ELSE '' END AS text FROM documents)"


@query("invariants_text", "\nUNION ALL ".join(f"SELECT '{n}' AS invariant, doc_id, CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS hits FROM {DAMAGED_SQL} WHERE regexp_matches(text, '{p}')" for n, p in INVARIANTS.items()))
def invariants_text(spark, sf_dir):
    """Violations of the invariants that are one pattern over a leaf's text, all in one pass, in texts of which some are damaged."""
    put = F.element_at(F.array(*map(F.lit, [*DAMAGE, "", "", ""])), (F.col("doc_id") % 9 + 1).cast("int"))
    rows = docs(spark, sf_dir).select("doc_id", F.concat(F.coalesce("text", F.lit("")), put).alias("text"))
    counted = rows.select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("invariant"), F.regexp_count("text", F.lit(T.as_in_sql(p))).cast("long").alias("hits")) for n, p in INVARIANTS.items()))).alias("v"))
    return counted.select("v.invariant", "doc_id", "v.hits").filter("hits > 0")


@query("invariants_html", """
    SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<strong\\b')) AS BIGINT) AS opened, CAST(len(regexp_extract_all(html, '(?i)</strong>')) AS BIGINT) AS closed,
           len(regexp_extract_all(html, '(?i)<strong\\b')) <> len(regexp_extract_all(html, '(?i)</strong>')) AS unbalanced, CAST(len(regexp_extract_all(html, '(?i)<li\\b')) AS BIGINT) AS items, regexp_matches(html, '(?i)<script\\b|<style\\b') AS unsafe FROM pages""")
def invariants_html(spark, sf_dir):
    number = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", number(r"(?i)<strong\b").alias("opened"), number(r"(?i)</strong>").alias("closed"), (number(r"(?i)<strong\b") != number(r"(?i)</strong>")).alias("unbalanced"), number(r"(?i)<li\b").alias("items"), F.col("html").rlike(r"(?i)<script\b|<style\b").alias("unsafe"))


@query("html_sanitize")
def html_sanitize(spark, sf_dir):
    ship(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", P.sanitize_html("html").alias("s"))
    return pages.select("page_id", "s.changed", F.char_length("s.html").alias("html_length"), F.sha2("s.text", 256).alias("text_sha"), F.array_join("s.diagnostics", ",").alias("diagnostics"), "s.text_fidelity", "s.structure_fidelity", F.sha2("s.signature", 256).alias("signature_sha"))


#: Markup around a name, what may stay of it, and what was dropped.
SANITIZED = [
    ('<p onclick="x" class="cite odd">', " &amp; b</p>", '<p class="cite">', " &amp; b</p>", "dropped_attr:p.onclick,dropped_class:p", True, True),
    ('<div style="text-align:center; margin-left:32px">', "<script>evil()</script></div>", '<div class="crx-align-center crx-indent-2">', "</div>", "converted_style:div,dropped_tag:script", True, True),
    ("<font>", "</font><!-- c -->", "", "", "unwrapped_tag:font,dropped_comment", True, True),
    ('<td colspan="2" style="flex: 0 0 33.3%">', "</td>", '<td colspan="2" style="flex:0 0 33.3%">', "</td>", "converted_style:td", True, True),
    ('<ol start="3"><li value="4">', "<br/></li></ol>", '<ol start="3"><li value="4">', "<br></li></ol>", "", True, True),
    ("<svg><ul><li>gone</li></ul></svg><p>", "</p>", "<p>", "</p>", "dropped_tag:svg", True, False),
    ("<p>", "</p>", "<p>", "</p>", "", False, True),
]


@query("sanitizer_cases", "WITH c(k, a, z, notes, changed, same) AS (VALUES " + ", ".join(f"({i}, '{a}', '{z}', '{n}', {c}, {t})" for i, (_, _, a, z, n, c, t) in enumerate(SANITIZED)) + f") SELECT p_partkey, a || p_name || z AS html, notes AS diagnostics, changed, true AS text_fidelity, same AS structure_fidelity FROM part JOIN c ON p_partkey % {len(SANITIZED)} = k")
def sanitizer_cases(spark, sf_dir):
    """Names in all kinds of markup."""
    ship(spark)
    case = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in SANITIZED)), (F.col("p_partkey") % len(SANITIZED) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", P.sanitize_html(F.concat(case(0), "p_name", case(1))).alias("s"))
    return rows.select("p_partkey", "s.html", F.array_join("s.diagnostics", ",").alias("diagnostics"), "s.changed", "s.text_fidelity", "s.structure_fidelity")


@query("text_diff")
def text_diff(spark, sf_dir):
    """Lines that differ from the edition before; editions are ordered by id alone, and texts joined to them."""
    ship(spark)
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    order = docs(spark, sf_dir).select("doc_id", "source", "lang").select(F.col("doc_id").alias("new_id"), F.lag("doc_id").over(w).alias("old_id")).filter("old_id IS NOT NULL")
    text = docs(spark, sf_dir).select("doc_id", "text")
    new = order.join(text.withColumnsRenamed({"doc_id": "new_id", "text": "new"}), "new_id")
    rows = new.join(text.withColumnsRenamed({"doc_id": "old_id", "text": "old"}), "old_id").filter("old IS NOT NULL")
    return rows.select(F.col("new_id").alias("doc_id"), F.explode(P.text_diff("old", "new")).alias("line"))


@query("reanchor")
def reanchor(spark, sf_dir):
    """Each leaf's 40th to 80th character, or as many as it has, sought in the text with its first 20 characters cut off."""
    ship(spark)
    rows = docs(spark, sf_dir).filter("text IS NOT NULL")
    found = T.reanchored(F.substring("text", 21, 1 << 30), F.substring("text", 41, 40), F.lit(40), F.lit(80), F.substring("text", 1, 40), F.substring("text", 81, 60))
    return rows.select("doc_id", found.alias("a")).select("doc_id", "a.*")
