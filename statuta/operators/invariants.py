"""Structural invariants of documents, each a frame of violations: document, invariant, subject, evidence.

Frames: leaf (document, section_id, code, heading, hierarchy_kind, chapter_code, part_code, division_code, start_page, end_page,
plain_text, html, sort_order), note (document, section_id, idx, ref, marker, page, text, html) and
doc (document, total_pages, sections_count, preamble, zone_mode, ...). Patterns are fixed values.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.operators.joins import small
from statuta.session import cut

#: Invariants that one pattern over one column of a leaf decides.
LEAF_PATTERNS: dict[str, tuple[tuple[str, ...], str]] = {
    "no_glued_marker_digit": (("plain_text", "html"), r"[a-z]\d\[|\b(?:19|20)\d{3}\["),
    "no_pua_glyphs": (("plain_text", "html"), r"[\uE000-\uF8FF]"),
    "no_stray_dotnumber": (("plain_text",), r"(?m)^\.\d{2,}$"),
    "no_orphan_marker_li": (("html",), r"(?i)<li[^>]*>\s*\(\w{1,4}\)\s*[.\]]?\s*</li>"),
    "no_omitted_heading_emdash": (("html",), r"(?i)<h4[^>]*>[^<]*(?:omitted|repealed)[^<]*[-–—]\s*</h4>"),
    "no_split_ordinals": (("plain_text",), r"\b\d+ (?:st|nd|rd|th)\b"),
    "no_control_chars": (("plain_text", "html", "heading"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]"),
    "no_footnote_text_in_body": (("plain_text",), r"(?i)the following table was substituted"),
    "no_toc_row_in_heading": (("heading",), r"\.{4,}\s*\d+|\s\d{1,3}\s+\d{1,3}[A-Z]{0,2}\.\s"),
    "no_formula_legend_inside_cell": (("html",), r"(?i)<td[^>]*>[^<]*\bwhere\s+[A-Z]\s+is\s+the\b"),
    "no_inline_formula_legend": (("html",), r"(?i)class=\"formula\"[^>]*>[^<]*</\w+>\s*(?:<[^>]+>\s*)*where\b(?![^<]*legend)"),
}


def _one_of(characters: str) -> str:
    """A class of single characters: Java looks these up, while it tries ranges one after the other."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in characters)


#: Signs: what no text lacks that one of the patterns matches, with a rare first character, so that most texts are passed over at little cost.
DIGIT, LETTER = f"[{_one_of(string.digits)}]", f"[{_one_of(string.ascii_letters)}]"
_USUAL = _one_of("".join(c for c in map(chr, (9, 10, 13, *range(0x20, 0x7F), *range(0xA0, 0x100))) if c not in string.digits + ".bB"))
PLAIN_SIGN = (
    rf"[^{_USUAL}](?:(?<=[0-9])(?:\[| (?:st|nd|rd|th))|(?<=(?:\A|[\n\r\u0085\u2028\u2029])\.)[0-9][0-9]|(?<=[bB])[lL][eE] [wW][aA][sS] [sS]|"
    r"(?<=[\x00-\x08\x0B\x0C\x0E-\x1F\uE000-\uF8FF]))"
)
MARKER_SIGN = DIGIT + r"\*?\s*[\u0085\u2028\u2029]?\n"
STRUCTURAL_SIGN = r"[CPpDd](?:HAPTER|[aA][rR][tT]|[iI][vV][iI][sS][iI][oO][nN])\s+[IVXLC\d]"
BLEED_SIGN = DIGIT + DIGIT + r"\s*[\u0085\u2028\u2029]?(?:\n|\z)"
JAMMED_SIGN = f"[^{LETTER[1:]}{LETTER}{{25}}"
SPACED_SIGN = r" [A-Za-z] (?<=(?:\A|[^0-9A-Za-z_])[A-Za-z] [A-Za-z] )[A-Za-z](?![0-9A-Za-z_])"
CITED = r'<sup class="cite"[^>]*>([^<]+)</sup>'
WORDS = ("the", "and", "of", "shall", "which", "that", "with", "under", "for", "this", "from", "section", "any", "such")
STRUCTURAL = r"^\W*(?:CHAPTER\s+[IVXLC\d]+|(?i:PART)\s+[IVXLC\d]+[A-Z]?|(?i:DIVISION)\s+[IVXLC\d]+[A-Z]?)\W*$"
ROMAN = {n: i for i, n in enumerate("I II III IV V VI VII VIII IX X".split(), 1)}


def violation(rows: DataFrame, name: str, subject: Column | str, evidence: Column | str) -> DataFrame:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select("document", F.lit(name).alias("invariant"), as_column(subject).cast("string").alias("subject"), F.substring(as_column(evidence).cast("string"), 1, 200).alias("evidence"))


def _hit(name: str, when: Column, evidence: Column) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("invariant"), F.substring(evidence.cast("string"), 1, 200).alias("evidence")))


def _plain() -> Column:
    return F.coalesce("plain_text", F.lit(""))


def by_pattern() -> dict[str, Column]:
    """Evidence of each one-pattern invariant."""
    found = {}
    for name, (columns, pattern) in LEAF_PATTERNS.items():
        hit = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), f"({pattern})", 1), F.lit(""))  # noqa: B023, E731
        found[name] = F.coalesce(*(F.when(_plain().rlike(PLAIN_SIGN), hit(c)) if c == "plain_text" else hit(c) for c in columns))
    return found


def bare_marker_lines() -> Column:
    """A marker alone on a line above one that opens a bracket; and above one that tells of an edit."""
    lines = F.split(_plain(), "\n")

    def one(line: Column, at: Column) -> Column:
        below, bare = F.get(lines, at + 1), line.rlike(r"^\s*\d{1,3}\*?\s*$")
        edit = below.rlike(r"^\s*[A-Z].*\b(?i:substituted|inserted|omitted|added|repealed)\b")
        return F.array(_hit("no_bare_footnote_marker_line", bare & below.rlike(r"^\s*\["), line), _hit("no_footnote_note_in_body", bare & edit, below))

    return F.when(_plain().rlike(MARKER_SIGN), F.flatten(F.transform(lines, one)))


def jammed_words() -> Column:
    """Runs of 25 letters or more that hold two function words or more."""
    runs = F.regexp_extract_all(_plain(), F.lit("([A-Za-z]{25,})"), 1)
    held = lambda run: F.size(F.filter(F.array(*map(F.lit, WORDS)), lambda w: F.contains(F.lower(run), w)))
    return F.when(F.concat(F.lit(" "), _plain()).rlike(JAMMED_SIGN), F.transform(runs, lambda run: _hit("no_jammed_words", held(run) >= 2, run)))


def words_cut() -> Column:
    """Words cut by a hyphen and a space."""
    return F.when(F.contains(_plain(), F.lit("- ")), F.regexp_extract_all(_plain(), F.lit(r"([a-z]+- [a-z]+)"), 1))


def words_spaced() -> Column:
    """Runs of single letters."""
    return F.when(_plain().rlike(SPACED_SIGN), F.regexp_extract_all(_plain(), F.lit(r"\b((?:[A-Za-z] ){2,}[A-Za-z])\b"), 1))


def joined_words(leaf: DataFrame, rows: DataFrame, least: int = 5) -> DataFrame:
    """Words cut or spaced (arrays cut and spaced of rows) whose joined form the document has elsewhere, for spaced ones `least` times. Of the document's words only those are counted."""
    part = lambda name, word, n: F.transform(name, lambda x: F.struct(F.lit({"cut": "no_stray_space_hyphen", "spaced": "no_glyph_spaced_cell"}[name]).alias("invariant"), x.alias("evidence"), word(x).alias("word"), F.lit(n).alias("least")))
    either = [rows.select("document", "section_id", F.inline(part(name, word, n))) for name, word, n in (("cut", lambda x: F.replace(x, F.lit("- "), F.lit("")), 1), ("spaced", lambda x: F.lower(F.replace(x, F.lit(" "), F.lit(""))), least))]
    found = either[0].unionByName(either[1])
    wanted = found.select("document", "word").distinct()
    texts = leaf if wanted.head(1) else leaf.filter(F.lit(False))
    words = texts.select("document", F.explode(F.regexp_extract_all(F.lower(_plain()), F.lit("([a-z]{3,})"), 1)).alias("word"))
    held = words.join(small(wanted), ["document", "word"]).groupBy("document", "word").agg(F.count("*").alias("n"))
    met = found.join(held, ["document", "word"]).filter("n >= least")
    return met.select("document", "invariant", F.col("section_id").cast("string").alias("subject"), F.substring("evidence", 1, 200).alias("evidence"))


def duplicate_division_codes(leaf: DataFrame) -> DataFrame:
    by = leaf.filter("division_code IS NOT NULL").select("document", "hierarchy_kind", "chapter_code", "part_code", F.upper(F.trim("division_code")).alias("code"), "section_id", F.col("code").alias("leaf"))
    again = by.groupBy("document", "hierarchy_kind", "chapter_code", "part_code", "code", "leaf").agg(F.count("*").alias("n")).filter("n > 1")
    return violation(again, "no_duplicate_division_code_within_part", "code", "n")


def parts_contiguous(leaf: DataFrame) -> DataFrame:
    """Part numerals from the least to the greatest of a schedule, without gaps."""
    value = F.create_map(*[x for n, i in ROMAN.items() for x in (F.lit(n), F.lit(i))])
    numerals = leaf.filter("hierarchy_kind = 'schedule'").select("document", "chapter_code", F.try_element_at(value, F.upper(F.regexp_extract("part_code", r"(?i)([IVX]+)\s*$", 1))).alias("n")).filter("n IS NOT NULL")
    by = numerals.groupBy("document", "chapter_code").agg(F.collect_set("n").alias("held"), F.min("n").alias("lo"), F.max("n").alias("hi"))  # ten numerals at most
    gaps = by.select("document", "chapter_code", F.explode(F.array_except(F.sequence("lo", "hi"), "held")).alias("missing"))
    return violation(gaps, "schedule_parts_contiguous", "chapter_code", "missing")


def page_number_bleed(offset: int = 0) -> Column:
    """Lines that end in punctuation and a number that is a page of the leaf."""

    def one(line: Column) -> Column:
        number = F.nullif(F.regexp_extract(line, r"[.;:,—-]\s*(\d{2,4})\s*$", 1), F.lit("")).cast("int")
        within = number.between(F.col("start_page"), F.col("end_page")) | (number + offset).between(F.col("start_page"), F.col("end_page"))
        return _hit("no_page_number_bleed", within & ~line.rlike(r"(?i)(?:rs\.?|rupees|section)\s*[\d,]+\s*$"), line)

    return F.when((F.col("end_page") - F.col("start_page") <= 10) & _plain().rlike(BLEED_SIGN), F.transform(F.split(_plain(), "\n"), one))


def footnote_rows(note: DataFrame) -> DataFrame:
    """Schema, page and year of references; ordinals cut from their numbers."""
    page = F.nullif(F.regexp_extract(F.coalesce("ref", F.lit("")), r"^(\d+)\.", 1), F.lit("")).cast("int")
    hits = F.array(
        _hit("footnote_schema", F.expr("ref IS NULL OR marker IS NULL OR text IS NULL OR html IS NULL"), F.col("ref")), _hit("footnote_refs_printed_page", page.isNull() | (page > 900), F.col("ref")),
        _hit("no_year_marker_refs", T.is_year_like(F.regexp_extract(F.coalesce("ref", F.lit("")), r"\.([^.]*)$", 1)), F.col("ref")), _hit("no_split_ordinals", F.coalesce("text", F.lit("")).rlike(r"\b\d+ (?:st|nd|rd|th)\b|^(?:st|nd|rd|th)\b"), F.col("ref")),
    )
    return in_rows(note.select("document", "section_id", F.explode(hits).alias("v")))


def footnote_order(note: DataFrame) -> DataFrame:
    """Notes that come before a note of a lower page or marker."""
    key = F.struct(F.col("page"), T.marker_sort_key(F.col("marker")))
    w = Window.partitionBy("document", "section_id").orderBy("idx")
    rows = note.withColumn("key", key).withColumn("before", F.lag("key").over(w))
    return violation(rows.filter(F.col("before") > F.col("key")), "footnotes_in_numeric_order", "section_id", "ref")


def html_form() -> dict[str, Column]:
    """Evidence of each invariant of a leaf's HTML, text and heading as a whole."""
    html = F.coalesce("html", F.lit(""))
    opened, closed = F.regexp_count(html, F.lit(r"(?i)<strong\b")), F.regexp_count(html, F.lit("(?i)</strong>"))
    head = F.regexp_extract(html, r"(?i)<table[\s\S]*?<thead>([\s\S]*?)</thead>", 1)
    body = F.regexp_extract(html, r"(?i)<table[\s\S]*?<tbody>([\s\S]*?)</tbody>", 1)
    numbering = r"(?i)<t[dh][^>]*>\s*\(\d\)\s*</t[dh]>"
    marker = F.regexp_extract(_plain(), r"^\s*(\d{1,3})\[", 1)
    word = F.lower(F.regexp_extract(F.coalesce("heading", F.lit("")), r"(?<![A-Za-z])([A-Za-z]{4,}+)\W*+$", 1))
    first = F.lower(F.regexp_extract(_plain(), r"^\W*([A-Za-z]{4,})", 1))
    return {
        "strong_balanced": F.when(opened != closed, F.concat_ws("/", opened, closed)), "numbering_row_in_thead": F.when((head != "") & ~head.rlike(numbering) & body.rlike(numbering), F.substring(body, 1, 80)),
        "leading_marker_cited": F.when((marker != "") & ~html.rlike(r"(?i)<sup|class=\"[^\"]*(?:cite|marker)"), marker), "no_heading_word_duplication": F.when((word != "") & (word == first), F.substring(word, 1, 200)),
    }


def structural_hits() -> Column:
    """Lines in a body that are a chapter, part or division heading, before any quotation begins."""
    quote = "[\"“”‘]"
    before = F.split(F.get(F.split(_plain(), quote, 2), 0), "\n")
    lines = F.when(_plain().rlike(quote), F.slice(before, F.lit(1), F.size(before) - 1)).otherwise(before)  # the line of the quotation mark goes
    return F.when(_plain().rlike(STRUCTURAL_SIGN), F.transform(lines, lambda line: _hit("no_structural_heading_in_body", line.rlike(STRUCTURAL), line)))


def in_rows(hits: DataFrame) -> DataFrame:
    """Violations of hits v, where there are some."""
    return hits.filter("v IS NOT NULL").select("document", "v.invariant", F.col("section_id").cast("string").alias("subject"), "v.evidence")


def structural_lines(leaf: DataFrame) -> DataFrame:
    return in_rows(leaf.select("document", "section_id", F.explode(structural_hits()).alias("v")))


def code_order(leaf: DataFrame) -> DataFrame:
    w = Window.partitionBy("document").orderBy("sort_order")
    rows = leaf.filter("hierarchy_kind = 'chapter'").withColumn("key", T.code_sort_key(F.col("code"))).withColumn("before", F.lag("key").over(w))
    return violation(rows.filter(F.col("before") > F.col("key")), "section_codes_ordered", "section_id", "code")


def clause_codes(leaf: DataFrame, first: int = 3, jump: int = 8) -> DataFrame:
    """In a document of one chapter, a first code above `first`, or a jump above `jump`."""
    single = leaf.filter("hierarchy_kind = 'chapter'").groupBy("document").agg(F.count_distinct("chapter_code").alias("chapters")).filter("chapters = 1").select("document")
    w = Window.partitionBy("document").orderBy("sort_order")
    number = F.nullif(F.regexp_extract("code", r"^(\d+)", 1), F.lit("")).cast("int")
    rows = leaf.join(single, "document").filter("hierarchy_kind = 'chapter'").withColumn("number", number).withColumn("before", F.lag("number").over(w)).withColumn("place", F.row_number().over(w))
    return violation(rows.filter(((F.col("place") == 1) & (F.col("number") > first)) | (F.col("number") - F.col("before") > jump)), "clause_codes_plausible", "section_id", "code")


def document_rows(leaf: DataFrame, note: DataFrame, doc: DataFrame) -> DataFrame:
    """Counts and states of whole documents; leaf: document, hierarchy_kind, chars."""
    counted = leaf.groupBy("document").agg(F.sum("chars").alias("chars"), F.count("*").alias("leaves"), F.count_if(F.col("hierarchy_kind") == "chapter").alias("in_chapters"))
    notes = note.groupBy("document").agg(F.count("*").alias("notes"))
    rows = doc.join(counted, "document", "left").join(notes, "document", "left").fillna(0, ["chars", "leaves", "in_chapters", "notes"])
    density = (F.col("chars") + F.char_length(F.coalesce("preamble", F.lit("")))) / F.greatest("total_pages", F.lit(1))
    found = [
        violation(rows.filter((F.col("total_pages") > 0) & (F.col("leaves") > 0) & (density < 200)), "text_density_plausible", "document", density),
        violation(rows.filter("total_pages > 0 AND leaves = 0"), "document_carries_its_text", "document", "total_pages"),
        violation(rows.filter("sections_count IS NOT NULL AND in_chapters <> sections_count"), "no_orphan_sections", "document", F.concat_ws("/", "in_chapters", "sections_count")),
        violation(rows.filter("zone_mode = 'none' AND notes > 0"), "zone_mode_none_has_no_footnotes", "document", "notes"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def ocr_rows(doc: DataFrame) -> DataFrame:
    """Agreement and doubtful tokens of scanned documents against the floor; provisional ones must say so. doc: ocr_pages, agreement, low_share, provisional, reason."""
    scanned = doc.filter("ocr_pages IS NOT NULL")
    under = (F.col("agreement") < 85) | (F.col("low_share") > 15) | (F.col("ocr_pages") == 0)
    floor = violation(scanned.filter(under & ~F.coalesce("provisional", F.lit(False))), "ocr_fidelity_floor", "document", F.concat_ws("/", "agreement", "low_share"))
    flagged = under != F.coalesce("provisional", F.lit(False))
    reason = F.coalesce("provisional", F.lit(False)) & (F.coalesce("reason", F.lit("")) == "")
    return floor.unionByName(violation(scanned.filter(flagged | reason), "provisional_is_flagged", "document", "reason"))


def citations_resolve(cites: DataFrame, note: DataFrame, share: float = 0.8) -> DataFrame:
    """Leaves that cite references (cites: document, section_id, ref); of those that exist, fewer than `share` are among the leaf's own notes. Only notes that are cited are compared."""
    cited = cites.select("document", "ref").distinct()
    note = (note if cited.head(1) else note.filter(F.lit(False))).join(small(cited), ["document", "ref"], "left_semi")
    own = note.select("document", "section_id", "ref", F.lit(1).alias("own")).distinct()
    known = note.select("document", "ref", F.lit(1).alias("known")).distinct()
    rows = cites.join(own, ["document", "section_id", "ref"], "left").join(known, ["document", "ref"]).groupBy("document").agg(F.sum(F.coalesce("own", F.lit(0))).alias("bound"), F.count("*").alias("all"))
    return violation(rows.filter(F.col("bound") < share * F.col("all")), "citation_refs_resolve", "document", F.concat_ws("/", "bound", "all"))


#: Hits in a text's lines and words, and violations among a document's leaves.
HITS: tuple[Callable[[], Column], ...] = (bare_marker_lines, jammed_words, page_number_bleed, structural_hits)
AMONG: tuple[Callable[[DataFrame], DataFrame], ...] = (duplicate_division_codes, parts_contiguous, code_order, clause_codes)


def readings(leaf: DataFrame) -> DataFrame:
    """What the invariants ask of each leaf's text, in one pass: hits, words cut and spaced, references cited, length."""
    none = F.array().cast("array<struct<invariant:string,evidence:string>>")
    cites = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(CITED), 1))
    size = F.char_length(_plain()) + F.char_length(T.strip_html(F.col("html")))
    whole = by_pattern() | html_form()
    read = leaf.select(
        "document", "section_id", "hierarchy_kind", *(e.alias(f"of_{name}") for name, e in whole.items()), *(h().alias(f"in_{i}") for i, h in enumerate(HITS)),
        words_cut().alias("cut"), words_spaced().alias("spaced"), cites.alias("refs"), size.alias("chars"),
    )
    # a second step, so that what is used twice is computed once
    some = F.coalesce(*(F.col(f"of_{name}") for name in whole)).isNotNull()
    held = F.when(some, F.filter(F.array(*(F.struct(F.lit(name).alias("invariant"), F.col(f"of_{name}").alias("evidence")) for name in whole)), lambda v: v["evidence"].isNotNull()))
    hits = F.flatten(F.array(*(F.coalesce(c, none) for c in (held, *(F.col(f"in_{i}") for i in range(len(HITS)))))))
    return read.select("document", "section_id", "hierarchy_kind", hits.alias("hits"), "cut", "spaced", "refs", "chars")


def violations(leaf: DataFrame, note: DataFrame, doc: DataFrame) -> DataFrame:
    """Texts are read once; and once more for the words that are sought, if there are some."""
    rows = cut(readings(leaf))
    out = document_rows(rows, note, doc).unionByName(footnote_rows(note)).unionByName(footnote_order(note)).unionByName(citations_resolve(rows.select("document", "section_id", F.explode("refs").alias("ref")), note))
    out = out.unionByName(in_rows(rows.select("document", "section_id", F.explode("hits").alias("v")))).unionByName(cut(joined_words(leaf, rows)))
    for f in AMONG:
        out = out.unionByName(f(leaf))
    return out


def report(found: DataFrame, most: int = 20) -> DataFrame:
    """Failures of each document and invariant, with the first `most` subjects. Evidence is not carried: it decides nothing among equal subjects."""
    found = found.select("document", "invariant", "subject")
    w = Window.partitionBy("document", "invariant").orderBy("subject")
    counted = found.groupBy("document", "invariant").agg(F.count("*").alias("failures"))
    first = found.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).groupBy("document", "invariant").agg(F.sort_array(F.collect_list("subject")).alias("subjects"))
    return counted.join(first, ["document", "invariant"])
