"""Relational operators of versions, findings, review state, paging, joins and ordered sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__rank = 1").drop("__rank")


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """added, removed, changed or unchanged for each key of either side."""
    o, n = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("in_old")), new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("in_new"))
    both = o.join(n, keys, "full_outer")
    state = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged").otherwise("changed")
    return both.select(*keys, state.alias("change"), "old_value", "new_value")


def runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """df with run, the number of the stretch of equal values that a row is in."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def timeline(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """A row for each run: its kind (first; unchanged if longer than one, even where it differs from the one before; else changed), first and last."""
    grouped = runs(df, [by], [order], value).groupBy(by, "run").agg(F.count("*").alias("editions"), F.min(order).alias("from_edition"), F.max(order).alias("to_edition"))
    kind = F.when(F.col("run") == 1, "first").when(F.col("editions") > 1, "unchanged").otherwise("changed")
    return grouped.select(by, "run", kind.alias("kind"), "editions", "from_edition", "to_edition")


def upsert_findings(prior: DataFrame, run: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Findings after a run: seen ones refreshed, triage untouched; new ones inserted; new and unseen ones closed.

    prior and run: key, severity, score, seen_at; prior also triage and first_seen.
    """
    p, r = prior.alias("p"), run.alias("r")
    both = p.join(r, key, "full_outer")
    seen = F.col("r.seen_at").isNotNull()
    known = F.col("p.triage").isNotNull()
    triage = F.when(~known, "new").when(~seen & (F.col("p.triage") == "new"), "fixed").otherwise(F.col("p.triage"))
    state = F.when(~known, "inserted").when(seen, "refreshed").when(F.col("p.triage") == "new", "closed").otherwise("kept")
    return both.select(key, state.alias("state"), triage.alias("triage"), F.coalesce("r.severity", "p.severity").alias("severity"), F.coalesce("r.score", "p.score").alias("score"), F.coalesce("p.first_seen", "r.seen_at").alias("first_seen"), F.coalesce("r.seen_at", "p.seen_at").alias("last_seen"))


def risk_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def worst(severity: str) -> Column:
    """The severity of the highest risk, as an aggregate."""
    return F.min_by(severity, risk_rank(F.col(severity)))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit in an order that must be total, with their rank in the page."""
    some = df.orderBy(*order).offset(offset).limit(limit)
    return some.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long") + offset)


def point_in_interval(points: DataFrame, intervals: DataFrame, key: str, point: str, start: str, end: str, order: list[str], width: int) -> DataFrame:
    """key, point and hit, the first interval by `order` that holds each point, null if none.

    Points and bounds are whole numbers. Of the intervals that cover a cell of `width` whole only the first
    counts, so each cell has one; only intervals that begin or end within a cell are compared with the
    cell's points. Equal points are looked up once, and of equal intervals only the first.
    """
    best = lambda c="rank": F.min(c).alias(c)
    ranked = intervals.select(F.col(start).alias("lo"), F.col(end).alias("hi"), F.struct(*order).alias("rank")).filter("lo <= hi").groupBy("lo", "hi").agg(best())
    cells = ranked.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    whole = (F.col("lo") <= F.col("cell") * width) & (F.col("hi") >= (F.col("cell") + 1) * width - 1)
    covered = cells.filter(whole).groupBy("cell").agg(F.min("rank").alias("cover"))
    asked = points.select(F.col(point).alias("at")).distinct().withColumn("cell", F.floor(F.col("at") / width))
    met = asked.join(cells.filter(~whole), "cell").filter(F.col("at").between(F.col("lo"), F.col("hi"))).groupBy("at").agg(best())
    hits = asked.join(covered, "cell", "left").join(met, "at", "left").select("at", F.least("cover", "rank").alias("hit"))
    return points.select(key, point).join(hits.filter("hit IS NOT NULL"), F.col(point) == F.col("at"), "left").select(key, point, "hit")


def unique_band_match(old: DataFrame, new: DataFrame, keys: list[str], at: str, band: int, old_id: str, new_id: str) -> DataFrame:
    """Pairs with equal keys (null equals null) and places at most `band` apart, where the old row has just one candidate.

    New rows are counted by key and place first, so that cells meet and not rows.
    """
    cells = new.groupBy(*keys, at).agg(F.count("*").alias("n"), F.min(new_id).alias("new_id"))
    near = cells.withColumn("at", F.explode(F.sequence(F.col(at) - band, F.col(at) + band))).groupBy(*keys, "at").agg(F.sum("n").alias("n"), F.min("new_id").alias("new_id")).filter("n = 1")
    o, n = old.alias("o"), near.alias("n")
    same = F.col(f"o.{at}") == F.col("n.at")
    for k in keys:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    return o.join(n, same).select(F.col(f"o.{old_id}").alias("old_id"), "new_id")


def folio_votes(pages: DataFrame, by: str, at: str, printed: str, reach: int = 5) -> DataFrame:
    """The printed page that most neighbours imply; a page keeps its own if no other has more votes, ties go to the least.

    Neighbours are found by exploding offsets, so the join is on equal pages.
    """
    own = pages.filter(F.col(printed) > 0).select(by, F.col(at).alias("q"), F.col(printed).alias("n"))
    votes = own.withColumn("d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).select(by, (F.col("q") + F.col("d")).alias(at), (F.col("n") + F.col("d")).alias("candidate")).filter("candidate > 0")
    counted = votes.groupBy(by, at, "candidate").agg(F.count("*").alias("votes"))
    mine = pages.select(by, at, F.col(printed).alias("mine")).join(counted, [by, at], "left")
    return mine.groupBy(by, at, "mine").agg(F.max(F.struct("votes", (F.col("candidate") == F.col("mine")).alias("own"), (-F.col("candidate")).alias("least"))).alias("best")).select(by, at, "mine", F.coalesce(-F.col("best.least"), "mine").alias("voted"), F.coalesce("best.votes", F.lit(0)).alias("votes"))


def changepoint(df: DataFrame, by: str, order: list[str], big: Column) -> DataFrame:
    """The first place k that maximises big rows before it plus small rows from it on."""
    rows = df.withColumn("__big", big.cast("int"))
    w = Window.partitionBy(by).orderBy(*order)
    before = F.coalesce(F.sum("__big").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(1 - F.col("__big")).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.select(by, (F.row_number().over(w) - 1).alias("k"), (before + after).alias("score"), "__big")
    best = rows.groupBy(by).agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("best"), F.sum("__big").alias("all_big"), F.count("*").alias("n"))
    # k = n: all rows before it
    return best.select(by, F.when(F.col("best.score") >= F.col("all_big"), -F.col("best.k")).otherwise(F.col("n")).cast("long").alias("k"), F.greatest("best.score", "all_big").cast("long").alias("score"), "n")


def conservation(words: DataFrame, by: str) -> DataFrame:
    """Words of the source that the output lacks, as a multiset, and the share that is kept. words: by, word and kept, false for one in the source and true for one in the output."""
    counted = words.groupBy(by, "word").agg(F.count_if(~F.col("kept")).alias("s"), F.count_if("kept").alias("o"))
    lost = F.greatest(F.col("s") - F.col("o"), F.lit(0))
    both = counted.filter("s > 0").groupBy(by).agg(F.sum("s").alias("words"), F.sum(lost).alias("missing"))
    return both.withColumn("conserved", F.round(100.0 * (F.col("words") - F.col("missing")) / F.col("words"), 3))
