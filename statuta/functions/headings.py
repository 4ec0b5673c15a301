"""Headings, labels, provenance and editions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chrome of contents pages that leaks into headings, codes of containers, kinds of sources, patterns of dates.
GAZETTE = r"(?i)THE\s+GAZETTE\s+OF\s+PAKISTAN"
GAZETTE_PREFIX = (
    r"(?i)^\]?\s*THE\s+GAZETTE\s+OF\s+PAKISTAN(?:[\s,.]|EXTRA\.?|EXTRAORDINARY|ISLAMABAD|MONDAY|TUESDAY|WEDNESDAY|THURSDAY|FRIDAY|SATURDAY|SUNDAY|"
    r"JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER|\d{1,4})*"
)
CONTENTS = r"(?i)Section\s+Page\s+No\.?"
LEADERS = r"[.…·•]{2,}|…+"
LEADING_JUNK = r"^[\]\s|]+"
TRAILING_PAGE = r"(?i)[\s.·•…]*\d{1,4}(?:\s*[-–]\s*\d{1,4})?(?:\s+Chapter[-–]?\s*[IVXLC0-9]+)?\s*$"
CONTAINER_CODE = r"(?i)^(PART|CHAPTER|SCHEDULE|DIVISION|PREAMBLE)\b"
SCHEDULE = r"(?i)\bschedule\b"
DOTS = " .·•…"
SOURCE_KINDS = ("native-digital", "scanned-ocr", "mixed-ocr")
SCANNED_SHARE = 0.9
DATED = r"(?i)(?:amended|upto|up\s*to|as\s+on|dated).{0,40}?(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})"
DATED_YEAR = r"(?i)(?:amended|upto|up\s*to|as\s+on|dated).{0,40}?\b((?:19|20)\d{2})\b"
YEAR_SPAN = r"\b(20\d{2}|19\d{2})\s*[-–]\s*(\d{2})\b"
ANY_YEAR = r"\b(20\d{2}|19\d{2})\b"
UNKNOWN_YEAR = 9999


def _gone(x: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(x, pattern, by)


def normalize_heading(heading: Column, label: bool = False) -> Column:
    """A heading without the chrome of contents pages. label: as labels are shown, which keep dots in front."""
    raw = _gone(F.trim(F.coalesce(heading, F.lit(""))), LEADING_JUNK)
    gazette, leaders, contents = raw.rlike(GAZETTE), raw.rlike(LEADERS), raw.rlike(CONTENTS)
    bare = F.when(gazette, F.trim(_gone(raw, GAZETTE_PREFIX))).otherwise(raw)
    bare = F.trim(_gone(F.when(leaders, _gone(bare, LEADERS, " ")).otherwise(bare), r"\s+", " "))
    cut = _gone(bare, TRAILING_PAGE)
    cut = F.trim(F.rtrim(cut, F.lit(DOTS))) if label else F.rtrim(F.btrim(cut, F.lit(DOTS)), F.lit(" ."))
    bare = F.when(gazette | leaders | contents, cut).otherwise(bare)
    return F.when(contents, F.trim(_gone(bare, CONTENTS))).otherwise(bare)


def hierarchy_kind(kind: Column, code: Column, heading: Column) -> Column:
    """chapter or schedule: as stored, else by the words of code and heading."""
    known = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    named = F.concat_ws(" ", F.coalesce(code, F.lit("")), F.coalesce(heading, F.lit(""))).rlike(SCHEDULE)
    return F.when(known.isin("schedule", "chapter"), known).when(named, "schedule").otherwise("chapter")


def _joined(code: Column, heading: Column) -> Column:
    return F.when((code == "") & (heading == ""), F.lit(None).cast("string")).when(heading == "", F.trim(code)).when(F.trim(code) == "", heading).otherwise(F.concat(code, F.lit(": "), heading))


def hierarchy_label(code: Column, heading: Column, kind: Column) -> Column:
    """code: heading; a schedule's bare code is named a schedule."""
    code, shown = F.trim(F.coalesce(code, F.lit(""))), normalize_heading(heading, label=True)
    bare = (hierarchy_kind(kind, code, shown) == "schedule") & (code != "") & ~code.rlike(SCHEDULE) & ~code.rlike(CONTAINER_CODE)
    return _joined(F.when(bare, F.concat(F.lit("Schedule "), code)).otherwise(code), shown)


def section_label(code: Column, heading: Column) -> Column:
    """Section code: heading, without the word where the code is a container's; null if both are empty."""
    code, shown = F.trim(F.coalesce(code, F.lit(""))), normalize_heading(heading, label=True)
    named = F.when((code == "") | code.rlike(CONTAINER_CODE), code).otherwise(F.concat(F.lit("Section "), code))
    return _joined(named, shown)


def source_kind(ocr_pages: Column, total_pages: Column, explicit: Column) -> Column:
    """As stated, else by the share of pages that were read by OCR."""
    share = ocr_pages / F.when(total_pages > 0, total_pages)
    return F.when(explicit.isin(*SOURCE_KINDS), explicit).when(F.coalesce(ocr_pages, F.lit(0)) < 1, "native-digital").when(share >= SCANNED_SHARE, "scanned-ocr").otherwise("mixed-ocr")


def provenance_tags(kind: Column, provisional: Column, floor: Column, doubtful: Column) -> Column:
    """The kind, and whether the text is provisional or has tokens to be reviewed."""
    loose = F.coalesce(provisional, F.lit(False)) | F.coalesce(F.trim(floor) == "provisional", F.lit(False))
    return F.array_distinct(F.array_compact(F.array(kind, F.when(loose, "ocr-provisional"), F.when(doubtful > 0, "ocr-needs-review"))))


def review_facet(total: Column, reviewed: Column) -> Column:
    total, reviewed = F.coalesce(total, F.lit(0)), F.coalesce(reviewed, F.lit(0))
    return F.when((total <= 0) | (reviewed <= 0), "untouched").when(reviewed >= total, "complete").otherwise("in_progress")


def document_status(total: Column, pending: Column, has_issues: Column) -> Column:
    """A document's status by its leaves': untouched ones first, then blocked ones."""
    return F.when((total == 0) | (pending == total), "pending").when(has_issues > 0, "blocked").when(pending == 0, "approved").otherwise("in_progress")


def edition_date(name: Column) -> Column:
    """year, sort_key and label of the edition that a name states: a date after a word like dated, a year after one, the first of a span of years, any year."""
    name = F.coalesce(name, F.lit(""))
    date = F.regexp_extract(name, DATED, 1)
    tail = F.element_at(F.split(date, "[./-]"), 3).cast("int")
    first = lambda pattern: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1).cast("int"))
    year = F.coalesce(F.when(date != "", F.when(tail < 100, tail + 2000).otherwise(tail)), first(DATED_YEAR), first(YEAR_SPAN), first(ANY_YEAR))
    return F.struct(year.alias("year"), F.coalesce(year, F.lit(UNKNOWN_YEAR)).alias("sort_key"), F.coalesce(year.cast("string"), F.lit("year unknown")).alias("label"))


def cursor(offset: Column, fingerprint: Column) -> Column:
    """An opaque place in a filtered list."""
    state = F.concat(F.lit('{"offset":'), offset.cast("string"), F.lit(',"filter":"'), fingerprint, F.lit('"}'))
    return F.rtrim(F.translate(F.base64(F.encode(state, "UTF-8")), "+/", "-_"), F.lit("="))


def cursor_offset(text: Column, fingerprint: Column) -> Column:
    """The offset of a cursor, 0 without one, null for one that is no cursor, names no place or belongs to another filter."""
    padded = F.rpad(F.translate(text, "-_", "+/"), F.ceil(F.length(text) / 4) * 4, "=")
    state = F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")
    found = F.from_json(F.when(state.rlike(r"^\{.*\}$"), state), "offset long, filter string")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast("long")).when((found["filter"] == fingerprint) & (found["offset"] >= 0), found["offset"])
