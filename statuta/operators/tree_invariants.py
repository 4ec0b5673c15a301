"""Invariants that need containers, notes of several leaves or metadata; frames as `statuta.sources.trees` gives them.

Each gives violations: document, invariant, subject, evidence. Patterns and word lists are fixed values.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.functions.text import AMENDING, AMENDING_DENSITY
from statuta.operators.checks import TABLE, is_leaf, text
from statuta.operators.invariants import CITED, violation

ORDINALS = "FIRST SECOND THIRD FOURTH FIFTH SIXTH SEVENTH EIGHTH NINTH TENTH ELEVENTH TWELFTH THIRTEENTH FOURTEENTH FIFTEENTH SIXTEENTH SEVENTEENTH".split()
NUMERALS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}
BOLD_MARKER = r"<li>(?:<sup[^>]*>[^<]*</sup>)?\[*\s*<strong>\((?:\d+[A-Za-z]{0,2}|[a-z]{1,3})\)"
OMITTED_DIVISION = r"(?i)Division\s+([IVXLC]+(?:\s?[A-Z]{1,2})?)\b[^.]{0,40}?\bomitted\b"
INSERTION = r"(?i)^\s*(?:Inserted|Added)\s+by\b"
ELEMENT = r"(?i)\b(?:sections?|sub-?sections?|clauses?|paras?|paragraphs?|divisions?|parts?|provisos?|explanations?|schedules?|tables?)\b"
OMISSION = r"(?is)^\s*Section\b[^0-9A-Za-z]{0,10}\S+.{0,40}?\b(?:omitted|substituted|repealed)\b"
HISTORY = r"(?i)omitted|substituted|read as follows"
RATE = r"^[\d.,]+%[\]”;.)]*$"
SERIAL = r"^(?:[IVXLCivxlc]+|\d{1,3})\.?$|^\([a-z]{1,3}\)$"
NOT_FRONT_MATTER = r"(?m)^\s*Contents\s*$|^\s*Section\s+Description\s+Page\s*$|[.…]{5,}\s*\d{1,4}\s*$|^\s*\(\d{1,2}[a-z]?\)\s*[“\"]"


def roman(numeral: Column) -> Column:
    """Value of a numeral of the letters I to C; a letter before a greater one counts against it."""
    value = F.transform(F.split(F.upper(numeral), ""), lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair]), c), F.lit(0)))
    return F.aggregate(F.reverse(value), F.struct(F.lit(0).alias("total"), F.lit(0).alias("top")), lambda a, v: F.struct((a["total"] + F.when(v >= a["top"], v).otherwise(-v)).alias("total"), F.greatest(a["top"], v).alias("top")), lambda a: a["total"])


def chapter_number(code: Column) -> Column:
    """Number of a chapter's code, with inserted letters as hundredths; null if it is not a numeral."""
    pattern = r"(?i)^CHAPTER\s+([IVXLC]+)(?:[\s\-]*([A-Z]{1,3}))?$"
    letters = F.upper(F.regexp_extract(F.trim(code), pattern, 2))
    after = F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0.0), lambda a, c: a + (F.ascii(c) - 64) / 100.0)
    return F.when(F.trim(code).rlike(pattern), roman(F.regexp_extract(F.trim(code), pattern, 1)) + after)


def schedule_ordinal(code: Column) -> Column:
    word = F.upper(F.regexp_extract(F.coalesce(code, F.lit("")), rf"(?i)\b({'|'.join(ORDINALS)})\s+SCHEDULE", 1))
    return F.nullif(F.array_position(F.array(*map(F.lit, ORDINALS)), word), F.lit(0).cast("long")).cast("int")


def amending(tree: DataFrame) -> DataFrame:
    """Documents with two amending phrases or more in 10,000 characters of their chapters and preamble."""
    side = tree.filter((is_leaf() & (F.col("side") == "chapter")) | (F.col("level") == "preamble"))
    by = side.groupBy("document").agg(F.sum(F.regexp_count(text("plain_text"), F.lit(AMENDING))).alias("hits"), (F.sum(F.char_length(text("plain_text"))) + F.count("*") - 1).alias("chars"))
    return by.filter((F.col("chars") > 0) & (10000.0 * F.col("hits") / F.col("chars") >= AMENDING_DENSITY)).select("document")


def lost_bodies(tree: DataFrame, notes: DataFrame) -> DataFrame:
    """Divisions of the first schedule with a heading but no text beyond it, unless a note says that they are omitted."""
    bare = F.upper(F.regexp_replace(F.regexp_replace(text("code"), r"(?i)^division\s+", ""), " ", ""))
    live = tree.filter((F.col("side") == "schedule") & (F.col("level") == "division") & F.contains(F.upper(text("root_code")), F.lit("FIRST")))
    live = live.filter((F.trim(text("heading")) != "") & ~F.col("heading").rlike("(?i)omitted|repealed") & (F.char_length(F.trim(text("plain_text"))) <= F.char_length(F.trim("heading")) + 4)).withColumn("bare", bare)
    gone = notes.select("document", F.explode(F.regexp_extract_all(text("text"), F.lit(OMITTED_DIVISION), 1)).alias("bare")).select("document", F.upper(F.regexp_replace("bare", r"\s+", "")).alias("bare")).distinct()
    return violation(live.join(gone, ["document", "bare"], "left_anti"), "division_iia_non_empty", "code", "heading")


def bold_markers(tree: DataFrame) -> DataFrame:
    start = F.locate("<li>", text("html"))
    hit = F.regexp_extract(F.when(start > 0, F.substring(text("html"), start, F.lit(40))).otherwise(""), f"({BOLD_MARKER})", 1)
    return violation(tree.filter((F.col("side") == "chapter") & is_leaf() & (hit != "")), "no_bold_body_subsection_marker", "code", hit)


def preambles(tree: DataFrame) -> DataFrame:
    """The first chapter's code as a line of the preamble; a preamble inside the first leaf; a preamble that is contents or sections."""
    shown = F.concat_ws("\n", text("plain_text"), F.regexp_replace(text("html"), "<[^>]+>", "\n"))
    of = lambda what, order: F.min(F.when(what, F.struct(F.col("place").alias("place"), order.alias("v"))))["v"]
    by = tree.groupBy("document").agg(
        of(F.col("level") == "preamble", shown).alias("shown"), of(F.col("level") == "preamble", text("plain_text")).alias("preamble"),
        of((F.col("side") == "chapter") & (F.col("level") == "root"), F.trim(text("code"))).alias("chapter"), of(is_leaf(), F.struct(text("code").alias("code"), F.upper(text("plain_text")).alias("body"))).alias("first"),
    )
    twice = by.filter((F.coalesce("chapter", F.lit("")) != "") & F.array_contains(F.transform(F.split("shown", "\n"), F.trim), F.col("chapter")))
    recital = lambda c: F.contains(c, F.lit("WHEREAS")) | F.contains(c, F.lit("IT IS HEREBY ENACTED"))
    up, none = F.upper(F.coalesce("preamble", F.lit(""))), F.trim(F.coalesce("preamble", F.lit(""))) == ""
    enacting = (F.contains(up, F.lit("ACT")) | F.contains(up, F.lit("ORDINANCE"))) & recital(up)
    swallowed = violation(by.filter(none & F.coalesce(recital(F.col("first.body")), F.lit(False))), "preamble_present", "first.code", F.substring("first.body", 1, 90))
    wrong = violation(by.filter(~none & ~enacting & F.col("preamble").rlike(NOT_FRONT_MATTER)), "preamble_present", "document", F.substring("preamble", 1, 90))
    return violation(twice, "preamble_no_chapter_heading", "chapter", "chapter").unionByName(swallowed).unionByName(wrong)


def faults(html: str) -> list[str]:
    """What is wrong with a fragment of HTML read as XML."""
    try:
        root = ET.fromstring(f"<root>{html}</root>")
    except ET.ParseError as e:
        return [f"malformed: {e}"[:80]]
    nested = any(p.find(".//p") is not None for p in root.iter("p"))
    stray = next((e.tag for e in root.iter() if e.tag not in ("ol", "ul") and any(c.tag == "li" for c in e)), None)
    return (["nested <p>"] if nested else []) + ([f"<li> in <{stray}>"] if stray else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_faults(html: pd.Series) -> pd.Series:
    return html.map(lambda h: faults(h) if h else [])


def html_well_formed(tree: DataFrame, notes: DataFrame) -> DataFrame:
    fragments = tree.select("document", F.coalesce("code", "level").alias("subject"), "html").unionByName(notes.select("document", F.concat_ws(" ", F.lit("note"), "ref").alias("subject"), "html"))
    found = fragments.filter(text("html") != "").select("document", "subject", F.explode(html_faults("html")).alias("fault"))
    return violation(found, "html_well_formed", "subject", "fault")


def empty_schedules(tree: DataFrame) -> DataFrame:
    by = tree.filter("side = 'schedule'").groupBy("document", "root_at").agg(F.first("root_code").alias("root_code"), F.count_if(is_leaf() & (text("html") != "")).alias("n"))
    return violation(by.filter("n = 0"), "schedules_have_content", "root_code", "n")


def notes_where_cited(tree: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes on a leaf that does not cite them but another does; uncited notes on several leaves; citations of notes that only other leaves have.

    A note that tells the history of its own leaf's code may stay. Own and other leaves are told apart by counts, so that a reference
    that thousands of leaves cite is one row of the join.
    """
    leaves = tree.filter(is_leaf())
    cites = leaves.select("document", "place", "code", F.explode(F.array_distinct(F.regexp_extract_all(text("html"), F.lit(CITED), 1))).alias("ref"))
    citing = cites.groupBy("document", "ref").agg(F.count("*").alias("citing"))
    held = notes.groupBy("document", "ref").agg(F.lit(1).alias("known"))
    copies = notes.select("document", "ref", "text", "place").distinct().groupBy("document", "ref", "text").agg(F.count("*").alias("copies"))
    cited = cites.select("document", "place", "ref", F.lit(1).alias("own"))
    named = text("text").rlike(HISTORY) & (text("code") != "") & F.regexp_like(text("text"), F.concat(F.lit(r"\b\Q"), F.col("code"), F.lit(r"\E\b")))
    rows = notes.join(cited, ["document", "place", "ref"], "left").filter("own IS NULL").filter(~named)
    same = F.col("t.text").eqNullSafe(F.col("c.text")) & F.col("t.ref").eqNullSafe(F.col("c.ref")) & (F.col("t.document") == F.col("c.document"))
    rows = rows.join(citing, ["document", "ref"], "left").alias("t").join(copies.alias("c"), same, "left").select("t.*", "c.copies")
    elsewhere = violation(rows.filter("citing > 0"), "footnote_on_citing_leaf", "code", F.concat(F.lit("cited elsewhere: "), "ref"))
    twice = violation(rows.filter("citing IS NULL AND copies > 1"), "footnote_on_citing_leaf", "code", F.concat(F.lit("uncited copy: "), "ref"))
    away = cites.join(held, ["document", "ref"]).join(notes.select("document", "place", "ref"), ["document", "place", "ref"], "left_anti")
    return elsewhere.unionByName(twice).unionByName(violation(away, "footnote_on_citing_leaf", "code", F.concat(F.lit("note is elsewhere: "), "ref")))


def insertion_pairs(tree: DataFrame, notes: DataFrame) -> DataFrame:
    """Insertion notes that name nothing, cited at an empty bracket, whose next note tells of an omission and is on other leaves only."""
    pattern = r"^(\d+)\.(\d+)$"
    after = F.concat_ws(".", F.regexp_extract("ref", pattern, 1), (F.regexp_extract("ref", pattern, 2).cast("bigint") + 1).cast("string"))
    single = notes.filter(F.col("ref").rlike(pattern) & text("text").rlike(INSERTION) & ~text("text").rlike(ELEMENT)).withColumn("after", after)
    blocks = tree.filter(is_leaf()).select("document", "place", F.regexp_extract_all(text("html"), F.lit(r"(?s)<p[^>]*>(.*?)</p>"), 1).alias("blocks"))
    rest = lambda b: F.regexp_replace(F.regexp_replace(b, r'<sup class="cite"[^>]*>[^<]*</sup>', ""), "<[^>]+>", "")
    single = single.join(blocks, ["document", "place"]).filter(F.exists("blocks", lambda b: F.contains(b, F.concat(F.lit(">"), F.col("ref"), F.lit("</sup>"))) & rest(b).rlike(r"^[\[\]\s]*$")))
    told = notes.groupBy("document", F.col("ref").alias("after")).agg(F.min_by(text("text"), F.struct("place", "idx")).alias("told")).filter(F.col("told").rlike(OMISSION))
    pairs = single.join(told, ["document", "after"])
    split = pairs.join(notes.select("document", "place", F.col("ref").alias("after")), ["document", "place", "after"], "left_anti")
    return violation(split, "insertion_note_paired_with_omission", "code", F.concat_ws(" without ", "ref", "after"))


def dropped_rows(notes: DataFrame) -> DataFrame:
    """Paragraphs of two rates or more right after a table of a note."""
    after = F.explode(F.regexp_extract_all(F.when(F.contains(text("html"), F.lit("fn-table")), text("html")).otherwise(""), F.lit(r"</div>\s*<p>([^<]+)</p>"), 1))
    rows = notes.select("document", "ref", after.alias("row")).withColumn("tokens", F.split(F.trim("row"), r"\s+"))
    return violation(rows.filter((F.size("tokens") >= 2) & F.forall("tokens", lambda t: t.rlike(RATE))), "no_dropped_table_row_paragraph", "ref", "row")


def serial_heads(tree: DataFrame) -> DataFrame:
    """Tables whose head begins with a row led by a serial label."""
    tables = tree.filter(is_leaf()).select("document", "code", F.explode(F.regexp_extract_all(text("html"), F.lit(rf"(?s)({TABLE}.*?</table>)"), 1)).alias("table")).filter(F.contains("table", F.lit("</thead>")))
    row = F.regexp_extract(F.regexp_extract("table", r"(?s)^(.*?)</thead>", 1), r"(?s)<tr>(.*?)</tr>", 1)
    cells = F.filter(F.transform(F.regexp_extract_all(row, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), 1), F.trim), lambda c: c != "")
    rows = tables.select("document", "code", cells.alias("cells")).filter(F.size("cells") >= 2)
    return violation(rows.filter(F.get("cells", F.lit(0)).rlike(SERIAL)), "no_serial_first_row_in_thead", "code", F.concat_ws(" | ", "cells"))


def structure(tree: DataFrame, meta: DataFrame) -> DataFrame:
    """Chapters: at least one, numbers rising, counts as the metadata tell; schedules: ordinals from one without gaps, unless the document amends others."""
    roots = tree.filter("level = 'root'")
    w = Window.partitionBy("document").orderBy("root_at")
    chapters = roots.filter("side = 'chapter'").withColumn("n", chapter_number(F.col("code"))).withColumn("before", F.lag("n").over(w))
    name = "structure_counts"
    order = violation(chapters.filter("n <= before"), name, "code", F.concat_ws(" then ", "before", "n"))
    counts = [
        violation(meta.filter("n_chapters < 1"), name, "document", F.lit("no chapters")),
        violation(meta.filter("coalesce(chapters_count, -1) <> n_chapters"), name, "document", F.concat_ws("/", F.lit("chapters"), F.coalesce("chapters_count", F.lit(-1)), "n_chapters")),
        violation(meta.filter("coalesce(schedules_count, -1) <> n_schedules"), name, "document", F.concat_ws("/", F.lit("schedules"), F.coalesce("schedules_count", F.lit(-1)), "n_schedules")),
    ]
    by = roots.filter("side = 'schedule'").groupBy("document").agg(F.count("*").alias("n"), F.collect_set(schedule_ordinal(F.col("code"))).alias("held"))  # seventeen ordinals at most
    none = violation(by.filter(F.size("held") == 0), name, "document", F.concat_ws(" ", "n", F.lit("schedules without an ordinal")))
    own = by.filter(F.size("held") > 0).join(amending(tree), "document", "left_anti").withColumn("lo", F.array_min("held"))
    start = violation(own.filter("lo > 1"), name, "document", F.concat(F.lit("schedules begin at "), "lo"))
    gaps = own.select("document", F.explode(F.array_except(F.sequence("lo", F.array_max("held")), "held")).alias("missing"))
    return reduce(DataFrame.unionByName, [order, *counts, none, start, violation(gaps, name, "document", F.concat(F.lit("missing schedule "), "missing"))])


def calibration_sane(meta: DataFrame) -> DataFrame:
    """Sizes, cut-offs and offsets that contradict each other or lack support."""
    c = lambda name, default=0: F.coalesce(F.col(f"calibration.{name}"), F.lit(default))
    mode, offset = F.coalesce("calibration.zone_mode", F.lit("")), c("page_offset")
    total = F.coalesce("total_pages", F.lit(0))
    rules = {
        "page box": ~((c("page_w") > 100) & (c("page_w") < 2000) & (c("page_h") > 100) & (c("page_h") < 2000)),
        "header and footer": ~((c("header_max_top", -1) > 0) & (c("header_max_top", -1) < c("footer_min_top", -1)) & (c("footer_min_top", -1) < c("page_h"))),
        "sizes": (mode != "none") & ~((c("footnote_size") < c("body_min_size")) & (c("body_min_size") < c("body_size"))),
        "zone mode": ~mode.isin("rule", "size", "none"),
        "rule window": (mode == "rule") & ~((c("rule_x0_lo") < c("rule_x0_hi")) & (c("rule_w_lo") < c("rule_w_hi"))),
        "page offset": (F.abs(offset) > 60) & (c("page_offset_support", 0.0) < 0.5),
        "no sampled pages": (c("pages_sampled") == 0) & (F.coalesce("ocr.pages", F.lit(0)) == 0),
        "offset beyond the document": (total != 0) & (F.abs(offset) >= total),
    }
    missing = F.when(F.col("calibration").isNull(), F.array(F.lit("missing")))
    found = missing.otherwise(F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull()))
    return violation(meta.select("document", F.explode(found).alias("rule")), "calibration_sane", "document", "rule")


def ocr_provenance(tree: DataFrame, meta: DataFrame) -> DataFrame:
    """Doubtful tokens that no leaf declares although leaves cover scanned pages; and declared ones where less than half of the body was scanned."""
    scanned = meta.filter("ocr IS NOT NULL").select("document", "ocr", (F.coalesce("total_pages", F.lit(0)) - F.coalesce("toc_pages_scanned", F.lit(0))).alias("body"))
    leaves = tree.filter(is_leaf()).join(scanned.select("document", F.col("ocr.pages_ocred").alias("pages")), "document")
    covers = F.exists(F.coalesce("pages", F.array()), lambda p: p.between(F.col("start_page"), F.coalesce(F.nullif("end_page", F.lit(0)), F.col("start_page"))))
    by = leaves.groupBy("document").agg(F.sum("n_review").alias("declared"), F.count_if(F.col("n_review") > 0).alias("declaring"), F.coalesce(F.bool_or(covers), F.lit(False)).alias("covered"))
    rows = scanned.join(by, "document", "left").fillna(0, ["declared", "declaring"])
    claimed = F.coalesce("ocr.needs_review_tokens", F.lit(0))
    reached = (F.size(F.coalesce("ocr.pages_ocred", F.array())) == 0) | F.coalesce("covered", F.lit(False))
    lost = violation(rows.filter((claimed > 0) & reached & (F.col("declared") == 0)), "no_unreviewed_ocr_token", "document", claimed)
    over = (F.col("body") > 0) & (F.coalesce("ocr.pages", F.lit(0)) < 0.5 * F.col("body")) & (F.col("declaring") > 0)
    return lost.unionByName(violation(rows.filter(over), "bold_gate_unchanged_on_text_layer", "document", "declaring"))


def violations(tree: DataFrame, notes: DataFrame, meta: DataFrame) -> DataFrame:
    found = [f(tree) for f in (bold_markers, preambles, empty_schedules, serial_heads)] + [f(tree, notes) for f in (lost_bodies, html_well_formed, notes_where_cited, insertion_pairs)]
    return reduce(DataFrame.unionByName, found + [dropped_rows(notes), structure(tree, meta), calibration_sane(meta), ocr_provenance(tree, meta)])
