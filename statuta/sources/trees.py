"""Documents as a row for each node of their trees, and their metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = ["code", "heading", "start_page", "end_page", "plain_text", "html", "footnotes"]


def nodes(documents: DataFrame, key: str = "file") -> DataFrame:
    """document, side (chapter, schedule; null for the preamble), level (preamble, root, part, division, section), root_at, root_code,
    root_heading, part_at, part_code, place (walk order), and the node's own code, heading, pages, texts and footnotes."""

    def row(level: DataFrame, kind: str, side: str, node: str, place: list[Column], part: bool) -> DataFrame:
        pieces = [F.col("j").alias("part_at"), F.col("p.code").alias("part_code")] if part else [F.lit(None).cast("int").alias("part_at"), F.lit(None).cast("string").alias("part_code")]
        return level.select(
            F.col(key).alias("document"), F.lit(side).alias("side"), F.lit(kind).alias("level"), F.col("i").alias("root_at"), F.col("c.code").alias("root_code"), F.col("c.heading").alias("root_heading"), *pieces, F.array(*place).alias("place"),
            *(F.col(f"{node}.{f}").alias(f) for f in NODE), F.size(F.coalesce(F.col(f"{node}.ocr_review"), F.array())).alias("n_review"),
        )

    lit, found = F.lit, []
    for k, (source, side) in enumerate((("chapters", "chapter"), ("schedules", "schedule"))):
        roots = documents.select(key, F.posexplode(source).alias("i", "c"))
        parts = roots.select("*", F.posexplode("c.parts").alias("j", "p"))
        head, below = [lit(k), F.col("i")], [lit(k), F.col("i"), lit(1), F.col("j")]
        found += [
            row(roots, "root", side, "c", head, False),
            row(roots.select("*", F.posexplode("c.sections").alias("at", "s")), "section", side, "s", [*head, lit(3), F.col("at")], False),
            row(parts, "part", side, "p", below, True),
            row(parts.select("*", F.posexplode("p.sections").alias("at", "s")), "section", side, "s", [*below, lit(3), F.col("at")], True),
        ]
        for level, place, part in ((parts.select("*", F.posexplode("p.divisions").alias("m", "d")), [*below, lit(2), F.col("m")], True), (roots.select("*", F.posexplode("c.divisions").alias("m", "d")), [*head, lit(2), F.col("m")], False)):
            found.append(row(level, "division", side, "d", place, part))
            found.append(row(level.select("*", F.posexplode("d.sections").alias("at", "s")), "section", side, "s", [*place, lit(3), F.col("at")], part))
    out = reduce(DataFrame.unionByName, found)
    raw = F.col("preamble")
    preamble = documents.filter(raw.isNotNull()).select(
        F.col(key).alias("document"), lit("preamble").alias("level"), F.array(lit(-1)).alias("place"), F.coalesce(F.get_json_object(raw, "$.plain_text"), raw).alias("plain_text"), F.get_json_object(raw, "$.html").alias("html"), lit(0).alias("n_review"),
    )
    return out.unionByName(preamble, allowMissingColumns=True)


def notes(tree: DataFrame) -> DataFrame:
    """A row for each footnote of a leaf, with the leaf's place and code."""
    leaves = tree.filter("plain_text IS NOT NULL AND level <> 'preamble'")
    return leaves.select("document", "place", "code", F.posexplode("footnotes").alias("idx", "n")).select("document", "place", "code", "idx", "n.*")


def metadata(documents: DataFrame, key: str = "file") -> DataFrame:
    """document, the metadata's fields, and whether the document amends others (its name says so or its first chapter has no numeral)."""
    return documents.select(F.col(key).alias("document"), "metadata.*", F.size(F.coalesce("chapters", F.array())).alias("n_chapters"), F.size(F.coalesce("schedules", F.array())).alias("n_schedules"))
