"""What decides whether parsed rows are taken in: junk leaves, upload errors, scanned pages, repeated codes, notes over pages, paired lines, sign-off. Patterns are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTENTS_HEAD = r"(?i)Section\s+Page\s+No\.?"
MASTHEAD = r"(?i)THE\s+GAZETTE\s+OF\s+PAKISTAN"
MASTHEAD_START = (
    r"(?i)^\]?\s*THE\s+GAZETTE\s+OF\s+PAKISTAN(?:[\s,.]|EXTRA\.?|EXTRAORDINARY|ISLAMABAD|MONDAY|TUESDAY|WEDNESDAY|THURSDAY|FRIDAY|SATURDAY|SUNDAY"
    r"|JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER|\d{1,4})*+"
)
CONTAINER = r"(?i)^(PART|CHAPTER|SCHEDULE|DIVISION|PREAMBLE)\b"
OPEN_END = r"(?i)(?:as follows|as under|namely|the following)\s*:?-?\s*[\"“]?\s*$"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def junk_leaf(code: Column, heading: Column, plain: Column, html: Column) -> Column:
    """Whether a leaf is a fragment of a contents page or a masthead; leaves coded or headed Contents are kept."""
    code, heading, plain, html = F.trim(_text(code)), _text(heading), _text(plain), _text(html)
    kept = (code == "Contents") | F.startswith(heading, F.lit("Contents"))
    body = F.when(F.trim(plain) != "", plain).otherwise(F.regexp_replace(html, "<[^>]+>", " "))
    body = F.trim(F.regexp_replace(body, r"\s+", " "))
    rest = F.trim(F.regexp_replace(body, MASTHEAD_START, ""))
    masthead = heading.rlike(MASTHEAD) & (F.char_length(rest) < 80) & ((code == "") | code.rlike(CONTAINER) | body.rlike(MASTHEAD))
    return ~kept & (F.concat_ws("\n", heading, plain, html).rlike(CONTENTS_HEAD) | masthead | (code.rlike(CONTAINER) & F.contains(plain, F.lit("Page No"))))


def meets_scanned(start: Column, end: Column, pages: Column) -> Column:
    """Whether a scanned page lies in a leaf's span: reversed spans are turned, a missing end is the other one."""
    a, b = F.coalesce(start, end), F.coalesce(end, start)
    return F.coalesce(F.exists(pages, lambda p: p.between(F.least(a, b), F.greatest(a, b))), F.lit(False))


def upload_errors(documents: DataFrame, leaves: DataFrame, most: int = 500) -> DataFrame:
    """document, pointer, code: no leaves, another page count than declared, spans outside the file; the first `most` of each document.

    documents: document, declared (or null), pages; leaves: document, source_key, start_page, end_page, sort_order.
    """
    counts = leaves.groupBy("document").agg(F.count("*").alias("n"))
    whole = documents.join(counts, "document", "left")
    empty = whole.filter("n IS NULL").select("document", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("place"), F.lit("/").alias("pointer"), F.lit("zero_sections").alias("code"))
    other = documents.filter("declared <> pages").select("document", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("place"), F.lit("/metadata/total_pages").alias("pointer"), F.lit("page_count_mismatch").alias("code"))
    bad = F.col("start_page").isNull() | F.col("end_page").isNull() | (F.col("start_page") < 1) | (F.col("end_page") < F.col("start_page")) | (F.col("end_page") > F.col("pages"))
    pointer = F.coalesce(F.nullif("source_key", F.lit("")), F.lit("/"))
    spans = leaves.join(documents.select("document", "pages"), "document").filter(bad).select("document", F.lit(2).alias("rank"), F.col("sort_order").cast("long").alias("place"), pointer.alias("pointer"), F.lit("invalid_page_span").alias("code"))
    found = empty.unionByName(other).unionByName(spans)
    w = Window.partitionBy("document").orderBy("rank", "place", "pointer")
    return found.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).select("document", "pointer", "code")


def shared_words(a: Column, b: Column) -> Column:
    """How many words two headings share from their start, without case."""
    pairs = F.arrays_zip(F.split(F.lower(F.trim(a)), r"\s+").alias("a"), F.split(F.lower(F.trim(b)), r"\s+").alias("b"))
    same = F.transform(pairs, lambda p: p["a"].eqNullSafe(p["b"]) & p["a"].isNotNull())
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False).cast("int") - 1).otherwise(F.size(same))


def without_repeated_codes(rows: DataFrame) -> DataFrame:
    """Contents without rows that repeat a code, unless two rows of it are both real: one is omitted or repealed, or their headings share fewer than three words.

    rows: document, at, code, heading. Rows of one code are few; each is held against the others by a join on the code.
    """
    many = rows.withColumn("n", F.count("*").over(Window.partitionBy("document", "code"))).withColumn("first", F.min("at").over(Window.partitionBy("document", "code")))
    again = many.filter("n > 1").select("document", "code", "at", F.lower(F.trim(_text(F.col("heading")))).alias("h"))
    gone = F.col("h").rlike(r"omitted|\*\*\*|repealed")
    # headings that agree in their first two words agree with each other, so two real ones are two different starts, or a start with fewer words
    start = F.when(F.size(F.split("h", r"\s+")) >= 3, F.concat_ws(" ", F.slice(F.split("h", r"\s+"), 1, 3))).otherwise(F.concat(F.lit("\u0000"), "h"))
    real = again.withColumn("start", F.when(F.col("h") != "", start)).groupBy("document", "code").agg(
        F.bool_or(gone).alias("gone"), F.count_distinct("start").alias("starts"), F.count_if(F.col("start").startswith("\u0000")).alias("short"), F.count("start").alias("titled"),
    )
    real = real.filter("gone OR starts > 1 OR (short > 0 AND titled > 1)").select("document", "code", F.lit(True).alias("real"))
    return many.join(real, ["document", "code"], "left").filter((F.col("n") == 1) | F.col("real") | (F.col("at") == F.col("first"))).select(*rows.columns)


def ends_open(text: Column) -> Column:
    """Whether a note's text stops at a cue or within a quotation."""
    t = F.rtrim(_text(text))
    return t.rlike(OPEN_END) | (F.regexp_count(t, F.lit("“")) > F.regexp_count(t, F.lit("”")))


def splice_continuations(notes: DataFrame) -> DataFrame:
    """Notes with a page's leading continuation joined to the note of the page before that was left open, else to its last note.

    notes: document, page, idx, marker (null: continuation), text. A continuation without a page right before it that has notes stays.
    A page that holds only a continuation passes the one after it on to the same note. Gives document, page, idx, marker, text, end_page.
    """
    by_page = Window.partitionBy("document", "page")
    rows = notes.withColumn("lead_in", (F.col("idx") == F.min("idx").over(by_page)) & F.col("marker").isNull())
    own = rows.filter("NOT lead_in").groupBy("document", "page").agg(F.max("idx").alias("last_idx"), F.max(F.when(ends_open(F.col("text")), F.col("idx"))).alias("open_idx"))
    target = own.select("document", F.col("page").alias("target_page"), F.coalesce("open_idx", "last_idx").alias("target_idx"))
    moved = rows.filter("lead_in").withColumn("target_page", F.col("page") - 1).join(target, ["document", "target_page"])
    joined = moved.groupBy("document", F.col("target_page").alias("page"), F.col("target_idx").alias("idx")).agg(F.min_by("text", "page").alias("more"), F.max("page").alias("to_page"))
    stay = rows.join(moved.select("document", "page", "idx"), ["document", "page", "idx"], "left_anti")
    out = stay.join(joined, ["document", "page", "idx"], "left")
    return out.select("document", "page", "idx", "marker", F.when(F.col("more").isNotNull(), F.trim(F.concat_ws("\n", "text", "more"))).otherwise(F.col("text")).alias("text"), F.coalesce("to_page", "page").alias("end_page"))


def pair_lines(first: DataFrame, second: DataFrame, reach: float = 4.0, cell: float = 50.0) -> DataFrame:
    """Each line of the second reading with the line of the first that it overlaps most, if its middle is within `reach` of it: document, page, second, line (or null).

    Both: document, page, line, x0, top, x1, bottom. Lines meet in cells of `cell` points of height, so that no page is joined whole.
    """
    boxes = first.withColumn("cell", F.explode(F.sequence(F.floor((F.col("top") - reach) / cell), F.floor((F.col("bottom") + reach) / cell))))
    other = second.select("document", "page", F.col("line").alias("second"), *(F.col(c).alias(f"r_{c}") for c in ("x0", "top", "x1", "bottom")))
    middle = (F.col("r_top") + F.col("r_bottom")) / 2
    met = other.withColumn("cell", F.floor(middle / cell)).join(boxes, ["document", "page", "cell"]).filter(middle.between(F.col("top") - reach, F.col("bottom") + reach))
    wide = F.least("x1", "r_x1") - F.greatest("x0", "r_x0")
    high = F.least("bottom", "r_bottom") - F.greatest("top", "r_top")
    best = met.withColumn("area", F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))).filter("area > 0").groupBy("document", "page", "second").agg(F.min_by("line", F.struct(-F.col("area"), F.col("line"))).alias("line"))
    return other.select("document", "page", "second").join(best, ["document", "page", "second"], "left")


def sign_offs(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """document, stage, actor, error: what each request would meet. requests: document, stage, actor; documents: document, status, signoff_stage, reviewed_by."""
    rows = requests.join(documents, "document", "left")
    early = (F.col("signoff_stage").isNull()) | (F.col("signoff_stage") != "reviewed") | (F.coalesce("reviewed_by", F.lit("")) == "")
    error = (
        F.when(F.col("status").isNull(), "not_found").when(~F.col("stage").isin("reviewed", "legal_approved") | F.col("stage").isNull(), "unknown_stage")
        .when((F.col("stage") == "reviewed") & (F.col("status") != "approved"), "not_all_approved").when((F.col("stage") == "legal_approved") & early, "review_first")
        .when((F.col("stage") == "legal_approved") & (F.col("reviewed_by") == F.col("actor")), "same_actor")
    )
    return rows.select("document", "stage", "actor", error.alias("error"))


ACTIVE_HTML = r"(?i)<\s*(script|style|iframe|object|embed|link|meta|form)\b|\bon[a-z]+\s*=|javascript\s*:"


def proposal_issues(proposals: DataFrame, originals: DataFrame) -> DataFrame:
    """document, section_id, level, code: what speaks against changed leaves; an error blocks approval. Null columns of a proposal leave the original as it is.

    Both: document, section_id, html, plain_text, start_page, end_page, footnotes (marker, text, html). Executors need the package.
    """
    from statuta.functions.python import visible_words

    names = ("html", "plain_text", "start_page", "end_page", "footnotes")
    old = originals.select("document", "section_id", *(F.col(c).alias(f"old_{c}") for c in names))
    rows = proposals.select("document", "section_id", *names).join(old, ["document", "section_id"])
    for c in ("html", "plain_text"):
        rows = rows.withColumn(c, F.coalesce(c, f"old_{c}", F.lit("")))
    rows = rows.withColumn("seen", visible_words("html"))
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    notes, old_notes = F.col("footnotes"), F.coalesce("old_footnotes", F.array())
    markers = lambda x: F.transform(x, lambda n: F.coalesce(n["marker"], F.lit("None")))
    first = F.nullif("old_start_page", F.lit(0))
    last = F.coalesce(F.nullif("old_end_page", F.lit(0)), first)
    moved = first.isNotNull() & last.isNotNull()
    issues = {
        "unsafe_html": F.col("html").rlike(ACTIVE_HTML) | F.coalesce(F.exists(notes, lambda n: _text(n["html"]).rlike(ACTIVE_HTML)), F.lit(False)),
        "empty_body": (F.trim("plain_text") == "") & (F.trim(_text(F.col("old_plain_text"))) != ""),
        "html_plain_parity": squeezed(F.col("seen")) != squeezed(F.col("plain_text")),
        "page_coverage_changed": moved & (F.coalesce(F.col("start_page") != first, F.lit(False)) | F.coalesce(F.col("end_page") != last, F.lit(False))),
        "bad_footnote": F.coalesce(F.exists(notes, lambda n: n["marker"].isNull() | n["text"].isNull()), F.lit(False)),
        "footnote_marker_conservation": notes.isNotNull() & (markers(F.coalesce(notes, F.array())) != markers(old_notes)),
        "no_change": (F.trim("plain_text") == F.trim(_text(F.col("old_plain_text")))) & (F.trim("html") == F.trim(_text(F.col("old_html")))),
    }
    found = [F.when(bad, F.struct(F.lit("warning" if code == "no_change" else "error").alias("level"), F.lit(code).alias("code"))) for code, bad in issues.items()]
    return rows.select("document", "section_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("document", "section_id", "i.*")


def sync_actions(found: DataFrame, stored: DataFrame) -> DataFrame:
    """key, action: skipped if the stored document has the same source hash, files that can be read and a lane; else updated, or created. found: key, source_hash; stored: key, source_hash, usable, lane."""
    rows = found.join(stored.select("key", F.col("source_hash").alias("old"), "usable", "lane", F.lit(True).alias("known")), "key", "left")
    same = F.col("old").eqNullSafe(F.col("source_hash")) & F.coalesce("usable", F.lit(False)) & (F.coalesce("lane", F.lit("")) != "")
    return rows.select("key", F.when(F.col("known").isNull(), "created").when(same, "skipped").otherwise("updated").alias("action"))
