"""Quality detectors over leaves: section_id, family_key, section_code, edition, plain_text or html_content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.session import cut

OMITTED = r"(?i)\b(omitted|repealed)\b"
#: What no text with one of those words lacks, with a rare first character: most texts are passed over at little cost.
OMITTED_SIGN = r"[mMpP](?:(?<=[oO][mM])[iI][tT]{2}[eE][dD]|(?<=[rR][eE][pP])[eE][aA][lL][eE][dD])"


def gone(text: Column) -> Column:
    """Whether a text says that it was omitted or repealed."""
    return text.rlike(OMITTED_SIGN) & text.rlike(T.as_in_sql(OMITTED))


def body_length(text: Column, heading: Column, slack: int) -> Column:
    """Length of a text without superfluous white space; null where its beginning alone is longer than the heading by more than slack, which spares the rest of most texts."""
    begins = F.substring(text, F.lit(1), F.char_length(F.coalesce(heading, F.lit(""))) + 8 * slack)
    return F.when(T.norm_length(begins) - T.norm_length(heading) <= slack, T.norm_length(text))


def fragments(text: Column, pattern: str, most: int) -> Column:
    """The first `most` matches; the engine's own pattern is sought only in texts that have its sign."""
    hits = F.slice(F.regexp_extract_all(text, F.lit(pattern), 0), 1, most)
    return F.when(text.rlike(T.GLYPH_SIGN), hits) if pattern == T.GLYPH_SPLIT else hits


def readings(leaves: DataFrame, heading: Column, slack: int = 12, most: int = 5) -> DataFrame:
    """What the detectors of texts ask of each text, without the text: computed once, they take it in place of leaves."""
    text = F.col("plain_text")
    return leaves.select(
        "section_id", "family_key", "section_code", "edition", T.trimmed_length(text).alias("trimmed_len"), gone(text).alias("gone"), F.char_length(F.coalesce(text, F.lit(""))).alias("text_len"),
        body_length(text, heading, slack).alias("body_len"), T.norm_length(heading).alias("heading_len"), fragments(text, T.GLYPH_SPLIT, most).alias("fragments"),
    )


def _asked(leaves: DataFrame, **columns: Column) -> DataFrame:
    """Leaves with what is asked of their texts; readings have it."""
    return leaves if "plain_text" not in leaves.columns else leaves.withColumns(columns).drop("plain_text")


def regression(leaves: DataFrame, least: int = 300, share: float = 0.25) -> DataFrame:
    """Leaves that lost most of their text since the edition before."""
    w = Window.partitionBy("family_key", "section_code").orderBy("edition", "section_id")
    rows = _asked(leaves, trimmed_len=T.trimmed_length(F.col("plain_text")), gone=gone(F.col("plain_text"))).withColumnRenamed("trimmed_len", "len")
    rows = rows.withColumn("prev_id", F.lag("section_id").over(w)).withColumn("prev_len", F.lag("len").over(w))
    lost = rows.filter((F.col("prev_len") >= least) & (F.col("len") < share * F.col("prev_len")) & ~F.coalesce("gone", F.lit(False)))
    return lost.select("section_id", "family_key", "section_code", "prev_id", F.col("len").cast("long").alias("len"), F.col("prev_len").cast("long").alias("prev_len"), F.round(1 - F.col("len") / F.greatest("prev_len", F.lit(1)), 3).alias("score"))


def heading_only(leaves: DataFrame, heading: Column, slack: int = 12) -> DataFrame:
    """Leaves whose text is little more than their heading."""
    text = F.col("plain_text")
    rows = _asked(leaves, body_len=body_length(text, heading, slack), heading_len=T.norm_length(heading), gone=gone(text))
    found = rows.filter((F.col("body_len") > 0) & ~F.col("gone") & (F.abs(F.col("body_len") - F.col("heading_len")) <= slack))
    return found.select("section_id", F.col("body_len").cast("long").alias("body_len"), F.col("heading_len").cast("long").alias("heading_len"), F.lit(0.9).alias("score"))


def short_vs_siblings(leaves: DataFrame, group: list[str], least: int = 50, share: float = 0.2) -> DataFrame:
    """Leaves much shorter than the upper median of their group of three or more.

    The median is read off the counts of the group's lengths, so that no task holds a group's leaves.
    """
    rows = _asked(leaves, text_len=F.char_length(F.coalesce("plain_text", F.lit("")))).select("section_id", *group, F.col("text_len").cast("long").alias("len"))
    lengths = rows.groupBy(*group, "len").agg(F.count("*").alias("c"))
    by = Window.partitionBy(*group)
    lengths = lengths.withColumn("n", F.sum("c").over(by)).withColumn("upto", F.sum("c").over(by.orderBy("len")))
    middle = lengths.filter(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*group).agg(F.min("len").alias("median"), F.max("n").alias("n")).filter((F.col("n") >= 3) & (F.col("median") >= least))
    r, m = rows.alias("r"), middle.alias("m")
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"m.{g}"))
    found = r.join(m, same & (F.col("len") < share * F.col("median")))
    return found.select("section_id", *(F.col(f"r.{g}") for g in group), "len", "median", F.round(1 - F.col("len") / F.col("median"), 3).alias("score"))


def glyph_split(leaves: DataFrame, pattern: str = T.GLYPH_SPLIT, most: int = 5) -> DataFrame:
    """The first fragments of words whose letters stand apart, at most `most` of a leaf."""
    rows = _asked(leaves, fragments=fragments(F.col("plain_text"), pattern, most))
    return rows.select("section_id", F.posexplode("fragments").alias("at", "fragment")).select("section_id", F.col("at").cast("long").alias("at"), F.substring("fragment", 1, 80).alias("fragment"), F.lit(0.7).alias("score"))


def markup_drift(leaves: DataFrame, group: list[str]) -> DataFrame:
    """Leaves of equal text and different markup: each member of such a group. Hashes are computed once."""
    rows = cut(leaves.select("section_id", *group, T.html_hashes(F.col("html_content")).alias("h")).select("section_id", *group, "h.text_sha", "h.shape"))
    drifting = rows.groupBy(*group, "text_sha").agg(F.count("*").alias("members"), F.count_distinct("shape").alias("shapes")).filter("members >= 2 AND shapes > 1")
    return rows.join(drifting, [*group, "text_sha"]).select("section_id", *group, "members", "shapes", F.lit(0.4).alias("score"))


def union(*detected: tuple[str, str, DataFrame]) -> DataFrame:
    """All findings with detector and severity, a count for each leaf and detector."""
    out = None
    for name, severity, found in detected:
        part = found.groupBy("section_id").agg(F.count("*").alias("findings"), F.max("score").alias("score")).select("section_id", F.lit(name).alias("detector"), F.lit(severity).alias("severity"), "findings", "score")
        out = part if out is None else out.unionByName(part)
    return out
