"""Repairs of extracted text, and classes of its lines, as columns."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Private glyphs and what they print as, markers of line classes, patterns of damaged text, limits of vocabularies.
GLYPHS_FROM, GLYPHS_TO = "", "** ••"
SUBSECTION = r"^\(\d+[A-Z]{0,3}\)"
GAP, SOLID = r"[\t\n\f\r ]", r"[^\t\n\f\r ]"  # SQL's white space, which Java's and Python's exceed
ROMAN = rf"^\((?!l\))(?:xc|xl|l?x{{0,3}})(?:ix|iv|v?i{{0,3}})\)(?:{GAP}|(?![\s\S]))"
CLAUSE = r"^\([a-z]{1,3}\)"
RULE = rf"^\d{{1,3}}\.{GAP}+[A-Z]"
CITATION_HEAD = rf"^\d+\.{SOLID}*"
MARKER_HEAD = rf"^(?:[\d*]+{GAP}*\[+{GAP}*)+(?:[\d*]+{GAP}*)?"
FUSED_WORD = r"([a-z])(\d)\["
FUSED_YEAR = r"(\d{4})(\d)\["
BARE_MARKER = r"(?m)^[ \t]*(\d{1,3}\*?)[ \t]*\n[ \t]*\["
HYPHEN_WRAP = r"([A-Za-z]+)-(?:[ \t]*\n[ \t]*|[ \t]+)([a-z]{2,})"
WRAP_CHAIN = r"[A-Za-z]+(?:-(?:[ \t]*\n[ \t]*|[ \t]+)[a-z]{2,})+"
SPACED_WORD = r"(?:\b[A-Za-z] ){2,}[A-Za-z][a-z]{0,3}\b"
FRACTION = r'<span class="frac"[^>]*><span style="display:block;">(.*?)</span><span style="display:block; border-top:[^"]*">(.*?)</span></span>'
LEAST_WORD, LEAST_SPACED, PASSES = 3, 5, 8


def printed_glyphs(x: Column) -> Column:
    """Private glyphs as what they print."""
    return F.translate(x, GLYPHS_FROM, GLYPHS_TO)


def all_caps(x: Column) -> Column:
    """Whether a line of eight letters or more is mostly capital."""
    letters, capitals = F.regexp_count(x, F.lit(r"\p{L}")), F.regexp_count(x, F.lit(r"\p{Lu}"))
    return (letters >= 8) & (capitals / letters > 0.7)


def line_class(line: Column) -> Column:
    """subsec, roman, clause, rule, htext or text; a marker may stand behind a citation or opening brackets."""
    left = lambda x: F.regexp_replace(x, f"^{GAP}+", "")
    bare = left(F.coalesce(line, F.lit("")))
    probes = [bare, left(F.regexp_replace(bare, CITATION_HEAD, "")), left(F.regexp_replace(bare, MARKER_HEAD, ""))]
    # the first probe that has any marker decides
    marks = [F.when(p.rlike(SUBSECTION), "subsec").when(p.rlike(ROMAN), "roman").when(p.rlike(CLAUSE), "clause") for p in probes]
    return F.coalesce(*marks, F.when(bare.rlike(RULE), "rule").when(all_caps(bare), "htext").otherwise("text"))


def spaced_markers(x: Column) -> Column:
    """Markers that are glued to the word or year before them, set apart."""
    return F.regexp_replace(F.regexp_replace(x, FUSED_WORD, "$1 $2["), FUSED_YEAR, "$1 $2[")


def merged_markers(x: Column) -> Column:
    """Markers alone on a line, set before the bracket that they open on the next one."""
    return F.regexp_replace(x, BARE_MARKER, "$1[")


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once: what a lambda names is else computed for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def without_repeats(lines: Column) -> Column:
    """Lines without blank ones, and without those that repeat the line before."""
    kept = lambda t: F.filter(t, lambda x, i: (x != "") & ((i == 0) | (x != F.get(t, i - 1))))
    return once(F.transform(lines, lambda x: F.trim(x)), kept)


def heading_joined(before: Column, more: Column) -> Column:
    """A wrapped heading: a fragment that ends in a hyphen goes on without a space."""
    glue = F.when((before == "") | before.endswith("-"), "").otherwise(" ")
    return F.when(before == "", more).otherwise(F.trim(F.concat(before, glue, more)))


def parallel_title(a: Column, b: Column) -> Column:
    """Two halves of one title that share two words or more at their beginning, as one; null if they aren't such halves."""
    x, y = F.filter(F.split(a, r"\s+"), lambda w: w != ""), F.filter(F.split(b, r"\s+"), lambda w: w != "")
    both = F.arrays_zip(x.alias("x"), y.alias("y"))
    differ = F.transform(both, lambda p, i: F.when(p["x"].eqNullSafe(p["y"]), F.lit(None).cast("int")).otherwise(i))
    n = F.array_min(differ)
    shared = (n >= 2) & (n < F.size(x)) & (n < F.size(y))
    part = lambda words, start, length: F.array_join(F.slice(words, start, length), " ")
    return F.when(shared, F.concat_ws(" ", part(x, F.lit(1), n), part(x, n + 1, F.size(x)), F.lit("and"), part(y, n + 1, F.size(y))))


def printed_page(printed: Column, page: Column, offset: Column) -> Column:
    """The folio that a page prints, else the one that the offset implies, else the page's own number; never below one."""
    implied = page - offset
    return F.when(printed > 0, printed).when(implied > 0, implied).otherwise(page)


def fractions_repaired(plain: Column, html: Column) -> Column:
    """Stacked fractions of the HTML as (numerator) / denominator in the text, each at its first place."""
    parts = lambda k: F.transform(F.regexp_extract_all(html, F.lit(f"(?s){FRACTION}"), k), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))
    found = F.arrays_zip(parts(1).alias("n"), parts(2).alias("d"))

    def one(text: Column, f: Column) -> Column:
        stacked = F.concat(f["n"], F.lit("\n"), f["d"])
        at = F.instr(text, stacked)
        fixed = F.concat(F.substring(text, F.lit(1), at - 1), F.lit("("), f["n"], F.lit(") / "), f["d"], F.substring(text, at + F.char_length(stacked), F.char_length(text)))
        return F.when((f["n"] != "") & (f["d"] != "") & (at > 0), fixed).otherwise(text)

    return F.aggregate(found, plain, one)


def context(text: Column, start: Column, end: Column, reach: int = 60) -> Column:
    """What stands before and after a span; positions are code points from 0, the end exclusive."""
    left = F.greatest(F.lit(0), start - reach)
    return F.struct(F.substring(text, left + 1, start - left).alias("before"), F.substring(text, end + 1, F.lit(reach)).alias("after"))


def diff_line_class(line: Column) -> Column:
    line = F.coalesce(line, F.lit(""))
    return F.when(line.startswith("@@"), "hunk").when(line.startswith("+"), "add").when(line.startswith("-"), "del").otherwise("ctx")


def _chains(text: str) -> set[tuple[str, str]]:
    """All joined and hyphenated forms, in lower case, that the wraps of a text may mean."""
    out = set()
    for m in re.finditer(WRAP_CHAIN, text):
        words = re.split(r"-\s+", m[0].lower())
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                before, last = "".join(words[i : j - 1]), words[j - 1]
                out.add((before + last, f"{before}-{last}"))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("joined", T.StringType()), T.StructField("hyphenated", T.StringType())])))
def wrap_candidates(text: pd.Series) -> pd.Series:
    """What the vocabulary must say about the wraps of each text."""
    return text.map(lambda t: [{"joined": a, "hyphenated": b} for a, b in sorted(_chains(t))] if t else [])


def unwrapped(text: str, solid: set[str]) -> str:
    """Words that wraps cut, joined if the joined form is a solid word and hyphenated otherwise; again while chains of wraps are left."""
    for _ in range(PASSES):
        new = re.sub(HYPHEN_WRAP, lambda m: m[1] + ("" if (m[1] + m[2]).lower() in solid else "-") + m[2], text)
        if new == text:
            break
        text = new
    return text


@F.pandas_udf(T.StringType())
def dehyphenated(text: pd.Series, solid: pd.Series) -> pd.Series:
    return pd.Series([unwrapped(t, set(s if s is not None else ())) if t is not None else None for t, s in zip(text, solid, strict=True)])


@F.pandas_udf(T.StringType())
def unspaced(text: pd.Series, solid: pd.Series) -> pd.Series:
    """Words whose letters stand apart, closed up if the closed form is a solid word."""
    return pd.Series([re.sub(SPACED_WORD, lambda m, s=set(s if s is not None else ()): m[0].replace(" ", "") if m[0].replace(" ", "").lower() in s else m[0], t) if t is not None else None for t, s in zip(text, solid, strict=True)])
