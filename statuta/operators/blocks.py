"""Blocks of a leaf's lines as HTML, notes with tables as text, sparse rows of tables, pages that are images, refusals of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import repair as P

# Kinds of lines, the markup of lists, patterns of gazette lines, of notes' tables and of cells that begin a row, limits.
LISTS = {
    "subsec": '<ol class="subsection" style="list-style-type: none; padding-left: 0; margin-left: 1.5em;">',
    "clause": '<ol class="subsection" type="a" style="list-style-type: none; padding-left: 0; margin-left: 3.5em;">',
    "roman": '<ol class="subsection" type="i" style="list-style-type: none; padding-left: 0; margin-left: 5.5em;">',
}
GAZETTE = {
    "act-title": r"(?i)^(?:(?:THE\s+)?(?:AN|ACT|ORDINANCE|A\s+BILL)|TABLES?)$", "act-long-title": r"(?i)^to\s+(?:provide|amend|consolidate|levy|give|make|further|enact)\b", "recital": r"(?i)^(?:AND\s+)?WHEREAS\b",
    "enacting-formula": r"(?i)^It\s+is\s+hereby\s+enacted\b", "enacting-clause": r"(?i)^There\s+is\s+hereby\s+enacted\b",
}
NOTE_TABLE = r'(?s)<div class="fn-table"[^>]*>(.*?</div>)</div>'
NOTE_CELL = r'(?s)<div style="flex:0 0 ([\d.]+)%;[^"]*">(.*?)</div>'
CITE = r'<sup class="cite"[^>]*>(?:[^<]*\.)?([^<.]*)</sup>'
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
ROW_HEAD = r"^(?:\d{1,3}\.|\(?\d{1,3}\)?)$"
IMAGE_OF_PAGE, IMAGE_OF_INK, LEAST_IMAGE = 0.5, 0.9, 0.2
LEAST_EXTRACTED, LEAST_CARRIED = 500, 0.10

#: Kinds that take plain lines after them into their block, and kinds of which each line is a block of its own.
_ABSORB = ("rule", "htext", *LISTS, *(k for k in GAZETTE if k != "act-title"))
_ALONE = ("rule", "table", *GAZETTE)


def gazette_class(line: Column) -> Column:
    """The class of a gazette's title, recital or enacting line; null for others."""
    line = F.trim(F.coalesce(line, F.lit("")))
    return F.coalesce(*(F.when(line.rlike(pattern), name) for name, pattern in GAZETTE.items()))


def block_html(lines: DataFrame, leaf: str, at: str) -> DataFrame:
    """leaf and html. lines: leaf, at (their order), kind (of line_class, gazette_class, subhead or table) and html.

    A plain line goes on with the block before it, but for titles, subheads and tables; list items of one kind are one
    list; consecutive titles or subheads are one paragraph. A leaf's blocks are one array.
    """
    w = Window.partitionBy(leaf).orderBy(at)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("kind")
    opener = F.last(F.when(kind != "text", kind), ignorenulls=True).over(upto)
    block = F.when(kind != "text", kind).when(opener.isin(*_ABSORB), opener).otherwise("text")
    rows = lines.withColumn("block", block)
    fresh = kind.isin(*_ALONE) | ~F.lag("block").over(w).eqNullSafe(F.col("block"))
    rows = rows.withColumn("number", F.sum(F.when(fresh, 1).otherwise(0)).over(upto)).withColumn("item", F.count_if((kind != "text") & kind.isin(*LISTS)).over(upto))
    some = F.trim(F.coalesce("html", F.lit(""))) != ""
    gather = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(some, F.struct(at, F.col(c).alias("x"))))), lambda s: s["x"]), " ")
    items = rows.groupBy(leaf, "number", "block", F.when(F.col("block").isin(*LISTS), F.col("item")).otherwise(0).alias("item")).agg(gather("html").alias("x"))
    blocks = items.groupBy(leaf, "number", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("item", "x"))), lambda s: s["x"]).alias("xs"))
    name, body = F.col("block"), F.element_at("xs", 1)
    styles = F.create_map(*[F.lit(v) for pair in LISTS.items() for v in pair])
    listed = F.concat(F.try_element_at(styles, name), F.lit("\n"), F.array_join(F.transform("xs", lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), "\n"), F.lit("\n</ol>"))
    paragraph = F.concat(F.when(name.isin(*GAZETTE), F.concat(F.lit('<p class="'), name, F.lit('">'))).otherwise("<p>"), body, F.lit("</p>"))
    shown = F.when(name.isin(*LISTS), listed).when(body == "", F.lit(None)).when(name == "table", body).otherwise(paragraph)
    return blocks.groupBy(leaf).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", shown.alias("x")))), lambda s: s["x"]), "\n").alias("html"))


def table_text(cells: Column) -> Column:
    """A note's table row by row: its cells' widths say how many columns it has."""
    texts = F.transform(F.regexp_extract_all(cells, F.lit(NOTE_CELL), 2), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))
    width = F.get(F.regexp_extract_all(cells, F.lit(NOTE_CELL), 1), F.lit(0)).cast("double")
    columns = F.greatest(F.lit(1), F.round(F.lit(100.0) / width).cast("int"))

    def shown(c: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.floor((F.size(c["t"]) - 1) / c["n"]).cast("int")), lambda r: F.array_join(F.slice(c["t"], r * c["n"] + 1, c["n"]), " "))
        return F.when(F.size(c["t"]) > 0, F.array_join(rows, "\n")).otherwise("")

    return P.once(F.struct(texts.alias("t"), columns.alias("n")), shown)


def note_text(html: Column) -> Column:
    """A note's text from its HTML: marks as bare digits, tables row by row, blocks as lines, without blank lines and repeats of the line before."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), CITE, "$1")
    parts = lambda b: F.zip_with(F.split(b, NOTE_TABLE), F.transform(F.regexp_extract_all(b, F.lit(NOTE_TABLE), 1), table_text), lambda g, t: F.concat(F.coalesce(g, F.lit("")), F.coalesce(t, F.lit(""))))
    whole = F.array_join(P.once(bare, parts), "")
    text = F.regexp_replace(F.regexp_replace(whole, "</(?:p|div)>", "\n"), "<[^>]+>", "")
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.array_join(P.without_repeats(F.split(text, "\n")), "\n")


def folded_rows(rows: Column) -> Column:
    """Rows of cells without those that only go on with cells of the row before: some cell empty, none that begins a row, each below one that isn't empty."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""

    def step(done: Column, row: Column) -> Column:
        last = F.element_at(done, -1)
        below = F.zip_with(last, row, lambda a, b: empty(b) | ~empty(a))
        goes_on = (F.size(done) > 0) & F.exists(row, empty) & F.exists(row, lambda c: ~empty(c)) & ~F.exists(row, lambda c: F.trim(F.coalesce(c, F.lit(""))).rlike(ROW_HEAD)) & F.forall(below, lambda x: F.coalesce(x, F.lit(False)))
        merged = F.zip_with(last, row, lambda a, b: F.when(empty(b), a).otherwise(F.concat_ws(" ", a, b)))
        return F.when(F.coalesce(goes_on, F.lit(False)), F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(done, F.array(row)))

    return F.aggregate(rows, F.array().cast("array<array<string>>"), step)


def image_pages(boxes: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """key and is_scan: whether images are a page's content, by its area or by that of its ink. boxes: key, is_image, x0, top, x1, bottom. pages: key, width, height."""
    image = F.col("is_image")
    own = F.abs(F.col("x1") - F.col("x0")) * F.abs(F.col("bottom") - F.col("top"))
    hull = lambda c: (F.max(F.when(c, F.col("x1"))) - F.min(F.when(c, F.col("x0")))) * (F.max(F.when(c, F.col("bottom"))) - F.min(F.when(c, F.col("top"))))
    by = boxes.groupBy(key).agg(F.max(F.when(image, own)).alias("largest"), F.sum(F.when(image, own)).alias("summed"), hull(image).alias("images"), hull(F.lit(True)).alias("ink"))
    area = F.col("width") * F.col("height")
    scan = (F.col("largest") >= IMAGE_OF_PAGE * area) | ((F.col("ink") > 0) & (F.col("images") >= IMAGE_OF_INK * F.col("ink")) & (F.col("summed") >= LEAST_IMAGE * area))
    return pages.join(by, key, "left").select(key, F.coalesce(scan, F.lit(False)).alias("is_scan"))


def refused(documents: DataFrame, leaves: DataFrame, key: str) -> DataFrame:
    """key and reason of documents that may not be written: text that was read and got lost, or leaves without a container where there are chapters.

    documents: key, extracted (characters read), preamble. leaves: key, container, is_chapter, plain_text, html.
    """
    size = lambda c: F.char_length(F.coalesce(c, F.lit("")))
    by = leaves.groupBy(key).agg(F.sum(size(F.col("plain_text")) + size(F.regexp_replace("html", "<[^>]+>", " "))).alias("carried"), F.count_if(F.col("container").isNull()).alias("orphans"), F.bool_or(F.coalesce("is_chapter", F.lit(False))).alias("chapters"))
    rows = documents.join(by, key, "left")
    lost = (F.col("extracted") >= LEAST_EXTRACTED) & (F.coalesce("carried", F.lit(0)) + size(F.col("preamble")) < LEAST_CARRIED * F.col("extracted"))
    reasons = F.array_compact(F.array(F.when(lost, "text_lost"), F.when((F.col("orphans") > 0) & F.col("chapters"), "orphan_leaves")))
    return rows.select(key, F.explode(reasons).alias("reason"))


def approvable(variants: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Groups whose leaves may be approved together: least members or more, equal text and markup in all, nothing against any. variants: key, leaf, text_sha, shape, blocked."""
    by = variants.groupBy(key).agg(F.count("*").alias("members"), F.count_distinct(F.struct("text_sha", "shape")).alias("kinds"), F.bool_or("blocked").alias("blocked"))
    return by.filter((F.col("members") >= least) & (F.col("kinds") == 1) & ~F.col("blocked")).select(key, "members")
