"""Page geometry, footnotes, tables and structure: what goes by position, page by page.

Words have document, page, text, x0, x1, top, size. The functions below take a page's or a document's rows
in order and are plain Python; the frames at the end of the file deal pages or documents to them. Pages are bounded by nature.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions.python import from_roman

LINE_GAP = 3.0
GLUE_GAP = 2.0
MARKER = re.compile(r"^(\d{1,4}[a-z]?|\*)\.?$")
#: Words after which a number is part of a sentence.
JOINING = frozenset(("to", "and", "or", "of", "at"))


def group_lines(tops: list[float], gap: float = LINE_GAP) -> list[int]:
    """The line of each word: that of the nearest member within gap, else a new one."""
    lines: list[list[float]] = []
    out = []
    for top in tops:
        near = [(min(abs(top - t) for t in line), i) for i, line in enumerate(lines)]
        if near and min(near)[0] <= gap:
            i = min(near)[1]
        else:
            i = len(lines)
            lines.append([])
        lines[i].append(top)
        out.append(i)
    return out


def merge_split_words(words: list[dict]) -> list[dict]:
    """Words that a change of font or an ordinal cut in two, joined again. Words of a line, by x0."""
    out: list[dict] = []
    for w in words:
        if out:
            a, gap = out[-1], w["x0"] - out[-1]["x1"]
            kern = -1.0 <= gap <= 0.5 and abs(w["top"] - a["top"]) <= 0.3 and abs(w["size"] - a["size"]) <= 0.3 and not MARKER.match(w["text"]) and not MARKER.match(a["text"])
            ordinal = w["text"] in ("st", "nd", "rd", "th") and w["size"] < a["size"] - 0.5 and a["text"][-1:].isdigit() and -1 <= gap <= 1 and abs(w["top"] - a["top"]) <= 2.5
            if kern or ordinal:
                out[-1] = a | {"text": a["text"] + w["text"], "x1": w["x1"]}
                continue
        out.append(dict(w))
    return out


def join_words(words: list[dict]) -> str:
    """A line's text: words closer than GLUE_GAP are one, and so are a hyphen's two sides."""
    out = ""
    for i, w in enumerate(words):
        if i:
            a = words[i - 1]
            glued = w["x0"] - a["x1"] < GLUE_GAP or bool(re.search(r"[A-Za-z]-$", a["text"])) and w["text"][:1].islower()
            out += "" if glued else " "
        out += w["text"]
    return out


def zone_top(sizes: list[float], boundary: float) -> int | None:
    """The line where notes begin: the first k with the most large lines before it and small ones from it on; None if all lines are before it."""
    best, at = -1, 0
    big, small = 0, sum(s < boundary for s in sizes)
    for k in range(len(sizes) + 1):
        if big + small > best:
            best, at = big + small, k
        if k < len(sizes):
            big += sizes[k] >= boundary
            small -= sizes[k] < boundary
    return at if at < len(sizes) else None


def parse_footnotes(lines: list[str], open_before: bool = False) -> list[tuple[str | None, str]]:
    """Marker and text of each note of a page's note zone; text before the first marker continues the page before (marker None).

    A number is no marker if it is a year, if a joining word follows, or if it repeats an accepted marker in brackets.
    """
    notes: list[list] = []
    seen: set[str] = set()
    for line in lines:
        m = re.match(r"^\s*(\[?)(\d{1,4}[a-z]?|\*)\.?\s+(.*)$", line)
        marker = m[2] if m else None
        if marker and re.fullmatch(r"\d{4}", marker) and 1800 <= int(marker) <= 2099:
            marker = None
        if marker and m[3].split(" ", 1)[0].lower() in JOINING:
            marker = None
        if marker and m[1] and (marker in seen or open_before and not notes):
            marker = None
        if marker:
            notes.append([marker, m[3].strip()])
            seen.add(marker)
        elif notes:
            notes[-1][1] = f"{notes[-1][1]} {line.strip()}".strip()
        else:
            notes.append([None, line.strip()])
    return [tuple(n) for n in notes]


def valleys(spans: list[list[tuple[float, float]]], least: float = 6.5) -> list[tuple[int, int]]:
    """White columns between the words of rows: places that at most an eighth of the rows cover, `least` points wide or more."""
    if not spans or not any(spans):
        return []
    rows = len(spans)
    allow = min(max(1, round(0.12 * rows)), rows - 1)
    lo, hi = int(min(a for row in spans for a, _ in row)), int(max(b for row in spans for _, b in row)) + 1
    cover = Counter(x for row in spans for x in {x for a, b in row for x in range(int(a), int(b) + 1)})
    out, start = [], None
    for x in range(lo, hi + 1):
        if cover[x] <= allow and x < hi:
            start = x if start is None else start
        elif start is not None:
            if x - start >= least:
                out.append((start, x))
            start = None
    return out


def normalize_grid(rows: list[list[str]]) -> list[list[str]]:
    """A raw grid with columns that are empty in every row dropped, spans that repeat evenly folded, and short rows filled."""
    width = max((len(r) for r in rows), default=0)
    filled = [[*(c or "" for c in r), *[""] * (width - len(r))] for r in rows]
    for span in range(2, width // 3 + 1):
        if width % span == 0 and all(not c for r in filled for i, c in enumerate(r) if i % span):
            return [r[::span] for r in filled]
    used = [i for i in range(width) if any(r[i] for r in filled)]
    return [[r[i] for i in used] for r in filled]


def header_rows(grid: list[list[str]]) -> int:
    """How many rows head a table: up to the last numbering row `(1) (2) ...` among the first six; none if the first row begins with a serial."""
    numbering = [i for i, row in enumerate(grid[:6]) if sum(bool(re.fullmatch(r"\(\d+\)", c.strip())) for c in row) >= 2]
    if numbering:
        return numbering[-1] + 1
    return 0 if not grid or re.fullmatch(r"\(?\d+[.)]?", (grid[0][0] if grid[0] else "").strip()) else 1


@dataclass
class TocState:
    chapter: str | None = None
    part: str | None = None
    division: str | None = None
    in_schedules: bool = False
    rows: list[dict] = field(default_factory=list)
    pending: dict | None = None


TOC_ROW = re.compile(r"^\s*(\d{1,3}(?:[.\s-]?[A-Z]{1,4})?)\.?\s+(.+?)(?:[.\s·•…]{2,}|\s+)(\d{1,4})(?:\s*[-–—]\s*\d{1,4})?\s*$")
TOC_OPEN = re.compile(r"^\s*(\d{1,3}(?:[.\s-]?[A-Z]{1,4})?)\.\s+(\D.+?)\s*$")


def parse_toc(lines: list[str]) -> list[dict]:
    """Rows of a table of contents with the containers above each: kind, code, heading, page."""
    s = TocState()
    for raw in lines:
        line = re.sub(r"(?:\s*\.\s*){4,}", " .... ", raw).strip()
        if not line or re.fullmatch(r"(?i)schedules|(?:sections?|contents|page(?: no\.?)?|\s)+", line):
            continue
        if m := re.match(r"(?i)^(?:the\s+)?([A-Z]+\s+)?schedule\b\s*(.*)$", line):
            s.in_schedules, s.chapter, s.part, s.division = True, line, None, None
            s.rows.append({"kind": "schedule", "code": (m[1] or "").strip(), "heading": m[2].strip(), "page": None, "above": None})
        elif (m := re.match(r"^CHAPTER\s+([IVXLC\d]+[A-Z]?)\W*(.*)$", line)) and not s.in_schedules:
            s.chapter, s.part, s.division = m[1], None, None
            s.rows.append({"kind": "chapter", "code": m[1], "heading": m[2].strip(), "page": None, "above": None})
        elif m := re.match(r"(?i)^PART\s+([IVXLC\d]+[A-Z]?)\W*(.*)$", line):
            s.part, s.division = m[1], None
            s.rows.append({"kind": "part", "code": m[1], "heading": m[2].strip(), "page": None, "above": s.chapter})
        elif m := re.match(r"(?i)^DIVISION\s+([IVXLC\d]+[A-Z]?)\W*(.*)$", line):
            if m[1] != s.division:
                s.division = m[1]
                s.rows.append({"kind": "division", "code": m[1], "heading": m[2].strip(), "page": None, "above": s.part or s.chapter})
        elif m := TOC_ROW.match(line):
            s.rows.append({"kind": "section", "code": re.sub(r"[\s.\-]", "", m[1]), "heading": m[2].strip(" ."), "page": int(m[3]), "above": s.division or s.part or s.chapter})
            s.pending = None
        elif m := TOC_OPEN.match(line):
            s.pending = {"kind": "section", "code": re.sub(r"[\s.\-]", "", m[1]), "heading": m[2], "page": None, "above": s.division or s.part or s.chapter}
            s.rows.append(s.pending)
        elif s.pending is not None:
            if m := re.match(r"^(.*?)[.\s]*(\d{1,4})$", line):
                s.pending |= {"heading": f"{s.pending['heading']} {m[1]}".strip(" ."), "page": int(m[2])}
                s.pending = None
            else:
                s.pending["heading"] = f"{s.pending['heading']} {line}"
    return s.rows


def match_sections(planned: list[tuple[str, int]], found: list[tuple[str, int]]) -> list[int | None]:
    """For each planned (code, page), the place in found (code, page), in order: the nearest page within 2, then 4, then 8 of the expected one plus the drift.

    The drift is the median of the last five offsets, from three on.
    """
    cursor, offsets, out = 0, [], []
    for code, page in planned:
        drift = sorted(offsets[-5:])[len(offsets[-5:]) // 2] if len(offsets) >= 3 else 0
        pick = None
        for reach in (2, 4, 8):
            near = [(abs(p - page - drift), i) for i, (c, p) in enumerate(found[cursor:], cursor) if c == code and abs(p - page - drift) <= reach]
            if near:
                pick = min(near)[1]
                break
        if pick is not None:
            offsets.append(found[pick][1] - page)
            cursor = pick + 1
        out.append(pick)
    return out


def align_tokens(first: list[tuple[str, float]], second: list[tuple[str, float]]) -> list[dict]:
    """Readings of two engines side by side: agreed where the bare texts are equal, else the surer one, to be reviewed."""
    from difflib import SequenceMatcher

    bare = lambda t: re.sub(r"[^a-z0-9]", "", t.lower().translate(str.maketrans("|", "l")))
    out = []
    for op, a, b, c, d in SequenceMatcher(a=[bare(t) for t, _ in first], b=[bare(t) for t, _ in second], autojunk=False).get_opcodes():
        for k in range(max(b - a, d - c)):
            x = first[a + k] if a + k < b else None
            y = second[c + k] if c + k < d else None
            best = max((t for t in (x, y) if t), key=lambda t: t[1])
            out.append({"text": x[0] if op == "equal" else best[0], "conf": best[1], "agree": op == "equal"})
    return out


def chapter_value(numeral: str) -> int | None:
    return int(numeral) if numeral.isdigit() else from_roman(re.sub(r"[^IVXLCDM]", "", numeral.upper()) or "")


def each_page(rows: DataFrame, order: list[str], columns: list[str], fold: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """What fold gives for the rows of each page in order. Pages come sorted, so one pass over a partition holds one page at a time."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def done() -> list[tuple]:
            return [(*key, *row) for row in fold(held)] if held else []

        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                found = (row["document"], int(row["page"]))
                if found != key:
                    out += done()
                    key, held = found, []
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(done(), columns=names)

    pages = rows.filter("page IS NOT NULL").select("document", "page", *columns).repartition("document", "page").sortWithinPartitions("document", "page", *order)
    return pages.mapInPandas(run, schema)


def page_lines(words: DataFrame) -> DataFrame:
    """Lines of each page: line, top, x0, size (the largest), text."""

    def fold(page: list[dict]) -> list[tuple]:
        lines: dict[int, list[dict]] = {}
        for line, word in zip(group_lines([w["top"] for w in page]), page):
            lines.setdefault(line, []).append(word)
        out = []
        for line, held in sorted(lines.items()):
            merged = merge_split_words(sorted(held, key=lambda w: w["x0"]))
            out.append((line, min(w["top"] for w in held), min(w["x0"] for w in held), max(w["size"] for w in held), join_words(merged)))
        return out

    return each_page(words, ["top", "x0", "text"], [c for c in words.columns if c not in ("document", "page")], fold, "document string, page int, line int, top double, x0 double, size double, text string")


def without_running_heads(lines: DataFrame, header: float, footer: float) -> DataFrame:
    """Lines between the cuts, with the printed page of those below or above: a lone number."""
    lone = F.nullif(F.regexp_extract("text", r"^\W*(\d{1,4})\W*$", 1), F.lit("")).cast("int")
    outside = (F.col("top") < header) | (F.col("top") > footer)
    printed = lines.filter(outside).groupBy("document", "page").agg(F.max(lone).alias("printed_page"))
    return lines.filter(~outside).join(printed, ["document", "page"], "left")


def page_footnotes(lines: DataFrame, boundary: float) -> DataFrame:
    """Notes of each page: marker (null: a continuation) and text, below the place where small lines begin."""

    def fold(page: list[dict]) -> list[tuple]:
        at = zone_top([r["size"] for r in page], boundary)
        return [(i, m, t) for i, (m, t) in enumerate(parse_footnotes([r["text"] for r in page[at:]]))] if at is not None else []

    return each_page(lines, ["line", "text"], ["line", "size", "text"], fold, "document string, page int, idx int, marker string, text string")


def calibrate(lines: DataFrame, least: int = 4) -> DataFrame:
    """Body and note size of each document: the commonest size, and the commonest smaller one; and the boundary between them."""
    sizes = lines.groupBy("document", F.round("size", 1).alias("size")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    body = sizes.groupBy("document").agg(F.max_by("size", F.struct("n", "size")).alias("body"))
    small = sizes.join(body, "document").filter(F.col("size") < F.col("body") - 0.5).groupBy("document").agg(F.max_by("size", F.struct("n", "size")).alias("note"))
    return body.join(small, "document", "left").select("document", "body", "note", ((F.col("body") + F.col("note")) / 2).alias("boundary"))


def toc_rows(lines: DataFrame) -> DataFrame:
    """Rows of each document's table of contents; lines: document, page, line, text."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = parse_toc(rows.sort_values(["page", "line"])["text"].tolist())
        return pd.DataFrame([(rows["document"].iloc[0], i, r["kind"], r["code"], r["heading"], r["page"], r["above"]) for i, r in enumerate(found)], columns=["document", "idx", "kind", "code", "heading", "printed_page", "above"]).astype({"printed_page": "Int32"})

    return lines.groupBy("document").applyInPandas(run, "document string, idx int, kind string, code string, heading string, printed_page int, above string")
