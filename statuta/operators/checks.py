"""Regression cases over document trees: a case is an aggregate over the nodes of a document, so all cases of all documents take one grouping.

Cases of codes in order take a second one over parts and divisions, and cases of different texts a third over these: no task collects a document's nodes.

Nodes are as `statuta.sources.trees.nodes` gives them. A schedule target is the first schedule whose code holds the case's code;
a section target the first leaf of the chapters with that code. A case whose target is missing fails, with found = false.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE = '<table class="fbr-table">'
NOTE_TABLE = "fn-table"


@dataclass(frozen=True)
class Case:
    id: str
    kind: str
    code: str = ""
    arg: str | tuple[str, ...] = ""
    target: str = "section"  # or schedule, schedule_leaf
    div: str | None = None
    div_heading: str = ""
    div_probe: str = ""
    part: str | None = None
    ref: str | None = None
    field: str = "html"
    status: str = "active"
    applies_to: str | None = None


def text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def holds(name: str, part: str) -> Column:
    return F.contains(text(name), F.lit(part))


def folded(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"\s+", " "))


def same_code(name: str, code: str | None) -> Column:
    return folded(F.col(name)) == F.lit(" ".join((code or "").upper().split()))


def is_level(*levels: str) -> Column:
    return F.col("level").isin(*levels)


def is_leaf() -> Column:
    return F.col("plain_text").isNotNull() & ~is_level("preamble")


def in_schedule(case: Case) -> Column:
    return (F.col("side") == "schedule") & F.contains(F.upper(text("root_code")), F.lit(case.code.upper()))


def first(scope: Column, wanted: Column, order: list[Column], value: Column, root: Column | None = None) -> Column:
    """The value at the first wanted row of the first root in scope; null if that root has none."""
    root = F.col("root_at") if root is None else root
    least = F.min(F.when(scope, F.struct(root.alias("root"), (~wanted).alias("missing"), *(c.alias(f"o{i}") for i, c in enumerate(order)), value.alias("value"))))
    return F.when(~least["missing"], least["value"])


def some(scope: Column, wanted: Column, ok: Column, root: Column | None = None, order: list[Column] | None = None) -> Column:
    """Whether one of the wanted rows of the first root in scope holds; null if there are none."""
    return ~first(scope, wanted, order or [], ~ok, root)


def at_target(case: Case, value: Column) -> Column:
    """The value at the node that a case names."""
    if case.target == "schedule":
        return first(in_schedule(case), is_level("root"), [], value)
    if case.target == "schedule_leaf":
        return first(in_schedule(case), is_leaf(), [F.col("place")], value)
    return first((F.col("side") == "chapter") & is_leaf() & (F.col("code") == case.code), F.lit(True), [F.col("place")], value, F.lit(0))


def at_division(case: Case, value: Column, parts: bool = True) -> Column:
    """The value at the first division with the code, heading and text that a case names; parts with a text come after divisions."""
    level = is_level("division") | (is_level("part") & F.col("plain_text").isNotNull()) if parts else is_level("division")
    wanted = level & same_code("code", case.div) & holds("heading", case.div_heading)
    if parts:
        wanted &= holds("html", case.div_probe)
    return first(in_schedule(case), wanted, [is_level("part"), F.col("place")], value)


def notes_with(ref: str | None) -> Column:
    return F.filter(F.coalesce("footnotes", F.array()), lambda n: n["ref"] == F.lit(ref))


def at_note(ref: str | None, value: Callable[[Column], Column]) -> Column:
    """The value at the first note of a document with this reference."""
    return first(is_leaf() & (F.size(notes_with(ref)) > 0), F.lit(True), [F.col("place")], value(F.get(notes_with(ref), F.lit(0))), F.lit(0))


def no_note(case: Case, field: str) -> Column:
    """Whether no note with this reference holds the text; null if there is no such note."""
    clean = F.forall(notes_with(case.ref), lambda n: ~F.contains(F.coalesce(n[field], F.lit("")), F.lit(case.arg)))
    return F.bool_and(F.when(is_leaf() & (F.size(notes_with(case.ref)) > 0), clean))


@dataclass(frozen=True)
class Codes:
    """What is asked of the folded codes of the wanted rows below the first anchor of the first root in scope; null without an anchor. kept says which rows these are."""

    scope: Column
    wanted: Column
    anchors: Column
    ok: Callable[[Column], Column]


@dataclass(frozen=True)
class Texts:
    """What is asked of the number of different values of all nodes of a document."""

    values: Column
    ok: Callable[[Column], Column]


def at_codes(nodes: DataFrame, asked: dict[int, Codes]) -> DataFrame:
    """document and a column for each of the asked: roots and anchors are found first, then the rows below them are counted."""
    held = {i: q.scope & (is_level("root") | q.anchors | q.wanted) for i, q in asked.items()}
    rows = nodes.select("document", "side", "level", "root_at", "root_code", "part_at", "part_code", "place", "code", "heading", F.col("plain_text").isNotNull().alias("__leaf"))
    rows = rows.withColumn("plain_text", F.when(F.col("__leaf"), "")).filter(reduce(lambda a, b: a | b, held.values()))
    least = [F.min(F.when(held[i], F.struct("root_at"))).alias(f"r{i}") for i in asked]
    anchors = [F.min(F.when(q.scope & q.anchors, F.struct("root_at", (~q.anchors & ~is_level("root")).alias("below"), "part_at"))).alias(f"a{i}") for i, q in asked.items()]
    firsts = rows.groupBy("document").agg(*least, *anchors).withColumnRenamed("document", "__document")
    rows = rows.join(firsts, F.col("document").eqNullSafe(F.col("__document")))
    below = lambda i: F.coalesce(F.col(f"a{i}.root_at") == F.col(f"r{i}.root_at"), F.lit(False))
    kept = lambda i, q: q.scope & q.wanted & below(i) & (F.col("root_at") == F.col(f"r{i}.root_at")) & (F.col(f"a{i}.part_at").isNull() | F.col("part_at").eqNullSafe(F.col(f"a{i}.part_at")))
    return rows.groupBy("document").agg(*(F.when(F.bool_or(below(i)), q.ok(F.coalesce(kept(i, q), F.lit(False)))).alias(f"c{i}") for i, q in asked.items()))


def at_texts(nodes: DataFrame, asked: dict[int, Texts]) -> DataFrame:
    """document and a column for each of the asked; no row for a document without values."""
    of = lambda i: lambda v: F.struct(F.lit(i).alias("case"), v.alias("value"))
    values = F.concat(*(F.transform(F.coalesce(q.values, F.array().cast("array<string>")), of(i)) for i, q in asked.items()))
    rows = nodes.select("document", F.explode(values).alias("v")).select("document", "v.case", "v.value").distinct()
    return rows.groupBy("document").agg(*(F.count_if(F.col("case") == i).alias(f"c{i}") for i in asked))


def code_equal(code: str | None) -> Column:
    return folded(F.col("code")) == F.lit(" ".join((code or "").upper().split()))


def listed(kept: Column) -> Column:
    """Codes of the kept rows in order, as an aggregate: parts or divisions of a part."""
    row = F.struct((~is_level("root")).alias("below"), "part_at", "place", folded(F.col("code")).alias("code"))
    return F.transform(F.array_sort(F.collect_list(F.when(kept, row))), lambda r: r["code"])


def division_codes(case: Case, ok: Callable[[Column], Column]) -> Codes:
    if case.part:
        return Codes(in_schedule(case) & (is_level("root") | same_code("part_code", case.part)), is_level("division") & F.col("part_at").isNotNull(), is_level("part"), ok)
    return Codes(in_schedule(case), is_level("division"), is_level("root"), ok)


def words_of(arg: str | tuple[str, ...]) -> Column:
    return F.array(*(F.lit(" ".join(a.upper().split())) for a in arg)).cast("array<string>")


def refs(case: Case) -> Column:
    value = F.transform(F.coalesce("footnotes", F.array()), lambda n: F.coalesce(n["ref"], F.lit("")))
    return at_division(case, value) if case.div else at_target(case, value)


def in_order(found: Column, arg: tuple[str, ...]) -> Column:
    at = F.array(*(F.array_position(found, F.lit(a)) for a in arg))
    return F.when(found.isNotNull(), ~F.exists(at, lambda p: p == 0) & (F.array_sort(at) == at))


def chapter_heading(case: Case) -> Column:
    return first((F.col("side") == "chapter") & is_level("root") & (F.col("code") == case.code), F.lit(True), [], text("heading") == F.lit(case.arg))


def part_heading(case: Case) -> Column:
    return first(in_schedule(case), is_level("part") & same_code("code", case.part), [F.col("place")], text("heading") == F.lit(case.arg))


def part_division_heading(case: Case) -> Column:
    held = is_level("division") & same_code("code", case.div) & holds("heading", case.arg)
    return some(in_schedule(case), F.col("part_at").isNotNull() & same_code("part_code", case.part), held, order=[F.col("part_at")])


def section_rows(case: Case) -> Column:
    return (F.col("side") == "chapter") & is_leaf() & (F.col("code") == case.code)


def largest_table() -> Column:
    rows = F.transform(F.regexp_extract_all(text("html"), F.lit(rf"({TABLE}[\s\S]*?</table>)"), 1), lambda t: F.size(F.split(t, "<tr>")) - 1)
    return F.coalesce(F.array_max(rows), F.lit(0))


def body(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)^.*?</h4>", ""), r"<[^>]+>", ""))


def in_preamble(case: Case, ok: Callable[[Column], Column]) -> Column:
    return F.bool_or(F.when(is_level("preamble"), ok(text({"html": "html"}.get(case.field, "plain_text")))))


def has(case: Case) -> Callable[[Column], Column]:
    return lambda c: F.contains(c, F.lit(case.arg))


def like(case: Case) -> Callable[[Column], Column]:
    return lambda c: c.rlike(case.arg)


CHECKS: dict[str, Callable[[Case], Column | Codes | Texts]] = {
    "chapter_heading_equals": chapter_heading,
    "any_schedule_leaf_html_contains": lambda c: some(in_schedule(c), is_leaf(), holds("html", c.arg)),
    "section_heading_equals": lambda c: first(section_rows(c), F.lit(True), [F.col("place")], text("heading") == F.lit(c.arg), F.lit(0)),
    "has_fbr_table": lambda c: at_target(c, holds("html", TABLE)),
    "has_subsection_li": lambda c: at_target(c, text("html").rlike(rf"<li>\s*(?:<[^>]+>\s*)*\Q{c.arg}\E")),
    "footnote_text_nonempty": lambda c: at_note(c.arg, lambda n: F.trim(F.coalesce(n["text"], F.lit(""))) != ""),
    "footnote_any_contains": lambda c: at_target(c, F.exists(F.coalesce("footnotes", F.array()), lambda n: F.contains(F.coalesce(n["text"], F.lit("")), F.lit(c.arg)))),
    "footnote_html_has_table": lambda c: at_note(c.arg, lambda n: F.contains(F.coalesce(n["html"], F.lit("")), F.lit(NOTE_TABLE))),
    "schedule_has_table": lambda c: some(in_schedule(c), is_leaf(), holds("html", TABLE)),
    "division_table_count": lambda c: at_division(c, (F.size(F.split(text("html"), TABLE)) - 1) == int(c.arg), parts=False),
    "division_code_count": lambda c: division_codes(c, lambda kept: F.count_if(kept & code_equal(c.div)) == int(c.arg)),
    "schedule_part_codes": lambda c: Codes(in_schedule(c), is_level("part"), is_level("root"), lambda kept: listed(kept) == words_of(c.arg)),
    "part_division_codes": lambda c: division_codes(c, lambda kept: listed(kept) == words_of(c.arg)),
    "schedule_max_table_rows": lambda c: some(in_schedule(c), is_leaf(), largest_table() >= int(c.arg)),
    "schedule_code_equals": lambda c: first(in_schedule(c), is_level("root"), [], text("code") == F.lit(c.arg)),
    "division_heading_contains": lambda c: first(in_schedule(c), is_level("division") & same_code("code", c.div), [F.col("place")], holds("heading", c.arg)),
    "part_heading_equals": part_heading,
    "part_division_heading_contains": part_division_heading,
    "division_body_excludes": lambda c: at_division(c, ~holds("plain_text", c.arg), parts=False),
    "division_html_contains": lambda c: at_division(c, holds("html", c.arg)),
    "division_html_not_contains": lambda c: at_division(c, ~holds("html", c.arg)),
    "body_not_starts_with": lambda c: at_target(c, ~F.startswith(body(text("html")), F.lit(c.arg))),
    "footnote_contains": lambda c: at_note(c.ref, lambda n: F.contains(F.coalesce(n["text"], F.lit("")), F.lit(c.arg))),
    "footnote_html_contains": lambda c: at_note(c.ref, lambda n: F.contains(F.coalesce(n["html"], F.lit("")), F.lit(c.arg))),
    "footnote_not_contains": lambda c: no_note(c, "text"),
    "footnote_html_not_contains": lambda c: no_note(c, "html"),
    "footnote_ref_distinct_texts": lambda c: Texts(F.when(is_leaf(), F.transform(notes_with(c.ref), lambda n: F.coalesce(n["text"], F.lit("")))), lambda n: n >= int(c.arg)),
    "division_page_range": lambda c: at_division(c, F.concat_ws("-", "start_page", "end_page") == F.lit(c.arg)),
    "division_footnote_contains": lambda c: at_division(c, F.exists(notes_with(c.ref), lambda n: F.contains(F.coalesce(n["text"], F.lit("")), F.lit(c.arg)))),
    "footnote_refs_exact": lambda c: F.array_sort(refs(c)) == F.array(*map(F.lit, sorted(c.arg))).cast("array<string>"),
    "footnote_refs_ordered_subsequence": lambda c: in_order(refs(c), c.arg),
    "section_code_count": lambda c: F.count_if(section_rows(c)) == int(c.arg),
    "any_section_html_contains": lambda c: F.bool_or(F.when(section_rows(c), holds("html", c.arg))),
    "tree_division_heading_contains": lambda c: F.bool_or(F.when((F.col("side") == "chapter") & is_level("division") & same_code("code", c.div), holds("heading", c.arg))),
}
for _name, _column in (("plain", "plain_text"), ("html", "html")):
    CHECKS[f"{_name}_contains"] = lambda c, col=_column: at_target(c, has(c)(text(col)))
    CHECKS[f"{_name}_not_contains"] = lambda c, col=_column: at_target(c, ~has(c)(text(col)))
    CHECKS[f"{_name}_matches"] = lambda c, col=_column: at_target(c, like(c)(text(col)))
    CHECKS[f"{_name}_not_matches"] = lambda c, col=_column: at_target(c, ~like(c)(text(col)))
CHECKS |= {
    "preamble_contains": lambda c: in_preamble(c, has(c)),
    "preamble_not_contains": lambda c: in_preamble(c, lambda x: ~has(c)(x)),
    "preamble_matches": lambda c: in_preamble(c, like(c)),
    "preamble_not_matches": lambda c: in_preamble(c, lambda x: ~like(c)(x)),
}


def run(nodes: DataFrame, cases: Iterable[Case]) -> DataFrame:
    """A row for each document and case: document, id, kind, status (skipped where the case's scope is not in the name), passed, found."""
    cases = list(cases)
    if len({c.id for c in cases}) < len(cases):
        raise ValueError("ids of cases must differ")
    asked = {i: CHECKS[c.kind](c) for i, c in enumerate(cases)}
    of = lambda kind: {i: q for i, q in asked.items() if isinstance(q, kind)}
    # the set has one value: with it Spark hashes the nodes, and does not sort them with their texts
    by = nodes.groupBy("document").agg(F.collect_set("document").alias("__held"), *(q.alias(f"c{i}") for i, q in of(Column).items()))
    for part, found in ((of(Codes), at_codes), (of(Texts), at_texts)):
        if part:
            more = found(nodes, part).withColumnRenamed("document", "__document")
            by = by.join(more, F.col("document").eqNullSafe(F.col("__document")), "left").drop("__document")
    by = by.withColumns({f"c{i}": q.ok(F.coalesce(f"c{i}", F.lit(0))) for i, q in of(Texts).items()})
    rows = [
        F.struct(
            F.lit(c.id).alias("id"), F.lit(c.kind).alias("kind"),
            (F.when(F.contains("document", F.lit(c.applies_to)), F.lit(c.status)).otherwise("skipped") if c.applies_to else F.lit(c.status)).alias("status"),
            F.coalesce(f"c{i}", F.lit(False)).alias("passed"), F.col(f"c{i}").isNotNull().alias("found"),
        )
        for i, c in enumerate(cases)
    ]
    return by.select("document", F.explode(F.array(*rows)).alias("r")).select("document", "r.*")


def summary(results: DataFrame) -> DataFrame:
    """Passed, failed, known gaps and skipped cases of each document; only active cases can fail it."""
    live = (F.col("status") == "active") & ~F.col("passed")
    return results.groupBy("document").agg(
        F.count_if((F.col("status") == "active") & F.col("passed")).alias("passed"), F.count_if(live).alias("failed"),
        F.count_if(~F.col("status").isin("active", "skipped")).alias("known_gaps"), F.count_if(F.col("status") == "skipped").alias("skipped"),
    )
