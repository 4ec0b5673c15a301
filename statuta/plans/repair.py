"""Queries over damaged text, wrapped headings and labels. Damage is put into texts of the tables, so that SQL can say what comes out."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta.catalog import query
from statuta.functions import headings as H
from statuta.functions import repair as P
from statuta.functions import text as T
from statuta.operators import structure as S
from statuta.session import ship
from statuta.sources.tables import table

HEADS = ["(1) ", "(iv) ", "(ab) ", "12. ", "4[5(1B) ", "20.1[(6) ", "(l) "]
_PROBE = r"CASE WHEN regexp_matches({p}, '^\(\d+[A-Z]{{0,3}}\)') THEN 'subsec' WHEN regexp_matches({p}, '^\((?:xc|xl|l?x{{0,3}})(?:ix|iv|v?i{{0,3}})\)(?:\s|$)') AND NOT starts_with({p}, '(l)') THEN 'roman' WHEN regexp_matches({p}, '^\([a-z]{{1,3}}\)') THEN 'clause' END"


@query("line_classes", rf"""
    WITH l AS (SELECT doc_id, CASE WHEN doc_id % 8 = 7 THEN upper(split_part(coalesce(text, ''), chr(10), 1)) ELSE list_extract({HEADS}, CAST(doc_id % 8 + 1 AS INTEGER)) || split_part(coalesce(text, ''), chr(10), 1) END AS line FROM documents),
    a AS (SELECT doc_id, regexp_replace(line, '^\s+', '') AS s FROM l),
    p AS (SELECT doc_id, s, regexp_replace(regexp_replace(s, '^\d+\.\S*', ''), '^\s+', '') AS s2, regexp_replace(regexp_replace(s, '^(?:[\d*]+\s*\[+\s*)+(?:[\d*]+\s*)?', ''), '^\s+', '') AS s3, length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(s, '[^\p{{Lu}}]', '', 'g')) AS capitals FROM a)
    SELECT doc_id, coalesce({_PROBE.format(p='s')}, {_PROBE.format(p='s2')}, {_PROBE.format(p='s3')}, CASE WHEN regexp_matches(s, '^\d{{1,3}}\.\s+[A-Z]') THEN 'rule' WHEN letters >= 8 AND capitals / letters > 0.7 THEN 'htext' ELSE 'text' END) AS class FROM p""")
def line_classes(spark, sf_dir):
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % 8 + 1).cast("int"))
    first = T.first_line(F.col("text"))
    line = F.when(F.col("doc_id") % 8 == 7, T.simple_upper(first)).otherwise(F.concat(F.when(F.col("doc_id") % 8 < 7, head), first))
    return table(spark, sf_dir, "documents").select("doc_id", P.line_class(line).alias("class"))


@query("text_repair", r"""
    SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(text, '. ', '7['), '([a-z])(\d)\[', '\1 \2[', 'g'), '(\d{4})(\d)\[', '\1 \2[', 'g')) AS markers,
      sha256(replace(text, '.' || chr(10), chr(10) || '12*[')) AS merged, sha256(replace(replace(text, 'a', '*'), 'o', '•')) AS glyphs FROM documents""")
def text_repair(spark, sf_dir):
    sha = lambda x: F.sha2(x, 256)
    text = F.col("text")
    put = lambda x, old, new: F.replace(x, F.lit(old), F.lit(new))
    fused, alone, private = put(text, ". ", "7["), put(text, ".\n", "\n 12* \n ["), put(put(text, "a", ""), "o", "")
    return table(spark, sf_dir, "documents").select("doc_id", sha(P.spaced_markers(fused)).alias("markers"), sha(P.merged_markers(alone)).alias("merged"), sha(P.printed_glyphs(private)).alias("glyphs"))


@query("repeated_lines", r"""
    WITH l AS (SELECT doc_id, list_transform(string_split(replace(text, '. ', '.' || chr(10) || chr(10)) || chr(10) || text, chr(10)), lambda x: trim(x)) AS l FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, sha256(array_to_string(list_filter(l, lambda x, i: x <> '' AND (i = 1 OR x <> l[i - 1])), '|')) AS lines FROM l""")
def repeated_lines(spark, sf_dir):
    text = F.concat(F.replace("text", F.lit(". "), F.lit(".\n\n")), F.lit("\n"), F.col("text"))
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.split(text, "\n").alias("l"))
    return rows.select("doc_id", F.sha2(F.array_join(P.without_repeats(F.col("l")), "|"), 256).alias("lines"))


@query("dehyphenate")
def dehyphenate(spark, sf_dir):
    """All texts with each word's last syllable wrapped, repaired by the vocabulary of the texts; how many words came back whole."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    damaged = docs.withColumn("damaged", F.regexp_replace("text", r"([a-z]{3})((?:ent|ing|en)[^A-Za-z])", "$1-\n$2"))
    return S.dehyphenate(damaged, docs, "doc_id", "damaged").select("doc_id", F.sha2("repaired", 256).alias("repaired_sha"), (F.char_length("damaged") - F.char_length("repaired")).cast("long").alias("shorter"), F.regexp_count("damaged", F.lit(r"-\n[a-z]")).cast("long").alias("wraps"))


@query("close_spaced_words")
def close_spaced_words(spark, sf_dir):
    """All texts with the letters of some words apart, closed up where the vocabulary knows the word."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    damaged = docs.withColumn("damaged", F.regexp_replace("text", r" ([a-z])([a-z])([a-z])([a-z]) ", " $1 $2 $3 $4 "))
    return S.close_spaced(damaged, docs, "doc_id", "damaged").select("doc_id", F.sha2("repaired", 256).alias("repaired_sha"), (F.col("repaired") == F.col("text")).alias("restored"))


@query("wrapped_headings", """
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Non-' || p_type ELSE p_name || ' ' || p_type END AS joined,
      CASE WHEN p_partkey % 3 = 0 THEN 'Rates of Tax for ' || p_brand || ' and ' || p_type END AS title FROM part""")
def wrapped_headings(spark, sf_dir):
    key = F.col("p_partkey")
    joined = P.heading_joined(F.when(key % 2 == 0, "Non-").otherwise(F.col("p_name")), F.col("p_type"))
    other = F.when(key % 3 == 0, F.concat(F.lit("Rates of  Tax for "), "p_type")).when(key % 3 == 1, F.concat(F.lit("Rates for "), "p_type")).otherwise("Rates of")
    return table(spark, sf_dir, "part").select("p_partkey", joined.alias("joined"), P.parallel_title(F.concat(F.lit("Rates of Tax for "), "p_brand"), other).alias("title"))


@query("printed_pages", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_partkey % 5 - 1 > 0 THEN l_partkey % 5 - 1 WHEN l_linenumber > 3 THEN l_linenumber - 3 ELSE l_linenumber END AS BIGINT) AS printed FROM lineitem")
def printed_pages(spark, sf_dir):
    printed = P.printed_page(F.col("l_partkey") % 5 - 1, F.col("l_linenumber"), F.lit(3))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", printed.cast("long").alias("printed"))


@query("stacked_fractions", "SELECT p_partkey, 'see (A x ' || p_size || ') / ' || CASE WHEN p_partkey % 2 = 0 THEN '85' ELSE 'B' END || ' and A x 7' || chr(10) || '9' AS plain FROM part")
def stacked_fractions(spark, sf_dir):
    below = F.when(F.col("p_partkey") % 2 == 0, "85").otherwise("B")
    size = F.col("p_size").cast("string")
    span = F.concat(F.lit('<p>see <span class="frac" x="1"><span style="display:block;"><b>A</b> x '), size, F.lit('</span><span style="display:block; border-top:1px solid;"> '), below, F.lit("</span></span> and A x 7</p>"))
    plain = F.concat(F.lit("see A x "), size, F.lit("\n"), below, F.lit(" and A x 7\n9"))
    return table(spark, sf_dir, "part").select("p_partkey", P.fractions_repaired(plain, span).alias("plain"))


@query("anchor_context", "SELECT doc_id, substr(text, 41, 60) AS before, substr(text, 141, 60) AS after FROM documents WHERE text IS NOT NULL")
def anchor_context(spark, sf_dir):
    found = P.context(F.col("text"), F.lit(100), F.lit(140))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", found.alias("c")).select("doc_id", "c.before", "c.after")


DIFF_LINES = ["@@ -1,2 +1,2 @@", "+new", "-old", " same"]


@query("diff_line_classes", f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'hunk' WHEN 1 THEN 'add' WHEN 2 THEN 'del' ELSE 'ctx' END AS class FROM events WHERE len({DIFF_LINES}) = 4")
def diff_line_classes(spark, sf_dir):
    line = F.when(F.col("event_id") % 5 < 4, F.element_at(F.array(*map(F.lit, [*DIFF_LINES, ""])), (F.col("event_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", P.diff_line_class(line).alias("class"))


_TITLES = "CASE o_orderkey % 7 WHEN 0 THEN '] THE GAZETTE OF PAKISTAN, EXTRA., JULY 1, 2019 ' || o_orderpriority WHEN 1 THEN o_orderpriority || ' of income ......... 12-14 Chapter-IV' WHEN 2 THEN 'Section Page No. ' || o_orderpriority || ' 9' WHEN 3 THEN '| ] ' || o_orderpriority || '  duty 7' WHEN 4 THEN o_orderpriority || ' … 31' WHEN 5 THEN '' END"


def _titles():
    key, name = F.col("o_orderkey") % 7, F.col("o_orderpriority")
    join = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    return F.when(key == 0, join("] THE GAZETTE OF PAKISTAN, EXTRA., JULY 1, 2019 ", name)).when(key == 1, join(name, " of income ......... 12-14 Chapter-IV")).when(key == 2, join("Section Page No. ", name, " 9")).when(key == 3, join("| ] ", name, "  duty 7")).when(key == 4, join(name, " … 31")).when(key == 5, F.lit(""))


_WEEK = "MONDAY|TUESDAY|WEDNESDAY|THURSDAY|FRIDAY|SATURDAY|SUNDAY|JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER"
NORMAL_SQL = rf"""
    WITH h AS (SELECT o_orderkey, regexp_replace(trim(coalesce({_TITLES}, '')), '^[\]\s|]+', '') AS t FROM orders),
    f AS (SELECT *, regexp_matches(t, '(?i)THE\s+GAZETTE\s+OF\s+PAKISTAN') AS g, regexp_matches(t, '[.…·•]{{2,}}|…+') AS d, regexp_matches(t, '(?i)Section\s+Page\s+No\.?') AS c FROM h),
    b AS (SELECT *, trim(regexp_replace(regexp_replace(CASE WHEN g THEN regexp_replace(t, '(?i)^\]?\s*THE\s+GAZETTE\s+OF\s+PAKISTAN(?:[\s,.]|EXTRA\.?|EXTRAORDINARY|ISLAMABAD|{_WEEK}|\d{{1,4}})*', '') ELSE t END, '[.…·•]{{2,}}|…+', ' ', 'g'), '\s+', ' ', 'g')) AS bare FROM f),
    k AS (SELECT *, regexp_replace(bare, '(?i)[\s.·•…]*\d{{1,4}}(?:\s*[-–]\s*\d{{1,4}})?(?:\s+Chapter[-–]?\s*[IVXLC0-9]+)?\s*$', '') AS cut FROM b),
    n AS (SELECT *, CASE WHEN g OR d OR c THEN rtrim(trim(cut, ' .·•…'), ' .') ELSE bare END AS heading, CASE WHEN g OR d OR c THEN trim(rtrim(cut, ' .·•…')) ELSE bare END AS label FROM k)
    SELECT o_orderkey, CASE WHEN c THEN trim(regexp_replace(heading, '(?i)Section\s+Page\s+No\.?', '')) ELSE heading END AS heading, CASE WHEN c THEN trim(regexp_replace(label, '(?i)Section\s+Page\s+No\.?', '')) ELSE label END AS label FROM n"""


@query("normalized_headings", NORMAL_SQL)
def normalized_headings(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", H.normalize_heading(_titles()).alias("heading"), H.normalize_heading(_titles(), label=True).alias("label"))


@query("leaf_labels", f"""
    WITH n AS ({NORMAL_SQL}), c AS (SELECT o_orderkey, label, CASE o_orderkey % 5 WHEN 0 THEN 'PART I' WHEN 1 THEN '12A' WHEN 2 THEN ' ' WHEN 3 THEN 'Third Schedule' ELSE 'II' END AS code, CASE o_orderkey % 3 WHEN 0 THEN 'schedule' WHEN 1 THEN 'Chapter ' END AS kind FROM n),
    k AS (SELECT o_orderkey, label, trim(code) AS code, CASE WHEN lower(trim(coalesce(kind, ''))) IN ('schedule', 'chapter') THEN lower(trim(kind)) WHEN regexp_matches(code || ' ' || label, '(?i)\\bschedule\\b') THEN 'schedule' ELSE 'chapter' END AS kind FROM c),
    x AS (SELECT *, CASE WHEN kind = 'schedule' AND code <> '' AND NOT regexp_matches(code, '(?i)schedule') AND NOT regexp_matches(code, '(?i)^(PART|CHAPTER|SCHEDULE|DIVISION|PREAMBLE)\\b') THEN 'Schedule ' || code ELSE code END AS h, CASE WHEN code = '' OR regexp_matches(code, '(?i)^(PART|CHAPTER|SCHEDULE|DIVISION|PREAMBLE)\\b') THEN code ELSE 'Section ' || code END AS s FROM k)
    SELECT o_orderkey, kind, CASE WHEN h = '' AND label = '' THEN NULL WHEN label = '' THEN h WHEN h = '' THEN label ELSE h || ': ' || label END AS hierarchy, CASE WHEN s = '' AND label = '' THEN NULL WHEN label = '' THEN s WHEN s = '' THEN label ELSE s || ': ' || label END AS section FROM x""")
def leaf_labels(spark, sf_dir):
    key = F.col("o_orderkey")
    code = F.element_at(F.array(*map(F.lit, ("PART I", "12A", " ", "Third Schedule", "II"))), (key % 5 + 1).cast("int"))
    kind = F.when(key % 3 == 0, "schedule").when(key % 3 == 1, "Chapter ")
    shown = H.normalize_heading(_titles(), label=True)
    return table(spark, sf_dir, "orders").select("o_orderkey", H.hierarchy_kind(kind, code, shown).alias("kind"), H.hierarchy_label(code, _titles(), kind).alias("hierarchy"), H.section_label(code, _titles()).alias("section"))


@query("norm_text_hash", r"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g'))) AS sha FROM documents")
def norm_text_hash(spark, sf_dir):
    """Hashes of texts with ligatures, wide letters and no-break spaces in place of plain ones: those of the plain texts."""
    ship(spark)
    odd = F.translate(F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("oe"), F.lit("ｏｅ")), " ", " ")
    return table(spark, sf_dir, "documents").select("doc_id", T.text_sha(odd).alias("sha"))


@query("amending_phrases", r"""
    WITH t AS (SELECT doc_id, text, CAST((length(text) - length(replace(text, '. ', ''))) // 2 AS BIGINT) AS hits FROM documents)
    SELECT doc_id, hits, round(10000.0 * hits / greatest(length(text) + 17 * hits, 1), 3) AS density, 10000.0 * hits / greatest(length(text) + 17 * hits, 1) >= 2.0 AS amending FROM t WHERE text IS NOT NULL""")
def amending_phrases(spark, sf_dir):
    """Amending phrases in 10,000 characters, in texts whose sentences end in one."""
    text = F.replace("text", F.lit(". "), F.lit(" shall be omitted, "))
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", text.alias("t"))
    return rows.select("doc_id", *T.amending_density(F.col("t")))
