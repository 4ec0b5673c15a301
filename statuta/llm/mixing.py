"""Mixing sources to target weights (operator 3), in DataFrame and SQL functions only.

The mix holds `share` times the words of all texts. Sources get it by weight; none may get more than
`most` times its own words, and what one leaves goes to the others by weight, until none is above. Within
a source each document wants target / words copies: the whole part is taken, and the fraction is settled by
pivotal dependent rounding, with the words as mass. Two fractional documents meet; a random draw moves as
much mass from one to the other as makes one of them whole, in proportions that keep each one's
expectation, and their words together stay as they were. So a source's words stay at its target but for
one last document, which goes to the nearer whole number.

The pairing is a reduction tree: within a source, documents are dealt by hash to chunks of about CHUNK,
each chunk is folded by one aggregate() and leaves at most one fractional document, and those meet in the
next level's chunks. No task holds more than a few chunks, whatever the size of a source. Draws are hashes
of the seed and both ids, so a rerun takes the same. Rows of an id that more than CHUNK rows have are
dealt by row as well. Running totals over sources are taken in ranges of SOURCES, so that no task holds all
sources either.

Nulls: a null text has no words; a null source is a source of its own, last in order. Texts without words
are taken 0 times. Null ids are dealt by their text's hash. Repeated rows are rounded each. Long texts only
count by their words. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.llm import common

CHUNK, SOURCES = 128, 100_000
#: Words of all texts that the mix holds, and copies of a source's words at most.
SHARE, MOST = 1.5, 2.0
WEIGHTS = (3, 1, 2)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], per_part: int = SOURCES) -> DataFrame:
    """df with sums over all rows before each one in a total order, by name. Rows fall into ranges of about per_part; their totals are collected."""
    parts = max(1, math.ceil(df.count() / per_part))
    placed = common.cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    totals = placed.groupBy("__part").agg(*(F.sum(c).cast("double").alias(n) for n, c in sums.items())).orderBy("__part").collect()
    before, at = [], dict.fromkeys(sums, 0.0)
    for r in totals:
        before.append((r["__part"], dict(at)))
        at = {n: v + r[n] for n, v in at.items()}
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = lambda n: F.try_element_at(F.create_map(*[F.lit(x) for k, v in before for x in (k, v[n])]), F.col("__part")) if before else F.lit(0.0)
    return placed.select("*", *((F.coalesce(F.sum(c).over(w), F.lit(0)) + start(n)).alias(n) for n, c in sums.items())).drop("__part")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, per_part: int = SOURCES) -> DataFrame:
    """source, source_size, target and rows of each source; sizes has source and size.

    A source is full if at the level where it becomes so the sum of all targets is within the mix; that
    sum is read off running totals in the order of cap / weight.
    """
    by = common.cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    by = running(by, [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, per_part)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    by = common.cut(by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    words, every_weight = by.agg(F.sum("source_size"), F.sum("weight")).first()
    total = float((words or 0) * share)
    by = running(by, [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], {"caps": F.col("cap"), "lighter": F.col("weight")}, per_part)
    rest = F.lit(every_weight or 0.0) - F.col("lighter") - F.col("weight")
    by = common.cut(by.withColumn("full", F.col("caps") + F.col("cap") + F.col("cap") / F.col("weight") * rest <= total))
    capped, free = by.agg(F.sum(F.when(F.col("full"), F.col("cap"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
    level = (total - (capped or 0.0)) / free if free else 0.0
    return by.select("source", "source_size", "n_docs", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.lit(level) * F.col("weight"))).alias("target"))


#: One pivotal step of the fold: acc.a is the fractional document so far, x the next one.
#: up: x's mass goes to a, until a is whole or x is empty; down: the other way. Each with the chance that
#: keeps both expectations.
STEP = """
transform(array(struct(
  least(acc.a.size * (1 - acc.a.p), x.size * x.p) AS up,
  least(acc.a.size * acc.a.p, x.size * (1 - x.p)) AS down,
  pmod(xxhash64({seed}, acc.a.h, x.h, acc.a.row, x.row), 9007199254740992) / 9007199254740992D AS u)), s ->
  CASE
    WHEN acc.a IS NULL THEN struct(x AS a, acc.done AS done)
    WHEN s.u * (s.up + s.down) < s.down THEN
      CASE WHEN acc.a.size * (1 - acc.a.p) <= x.size * x.p
        THEN struct({x_less} AS a, concat(acc.done, array({a_one})) AS done)
        ELSE struct({a_more} AS a, concat(acc.done, array({x_zero})) AS done) END
    ELSE
      CASE WHEN acc.a.size * acc.a.p <= x.size * (1 - x.p)
        THEN struct({x_more} AS a, concat(acc.done, array({a_zero})) AS done)
        ELSE struct({a_less} AS a, concat(acc.done, array({x_one})) AS done) END
  END)[0]
"""
ITEM = "struct<size:bigint,p:double,h:bigint,row:bigint,doc_id:{kind},whole:bigint>"


def _with_p(who: str, p: str) -> str:
    return f"struct({who}.size AS size, CAST({p} AS DOUBLE) AS p, {who}.h AS h, {who}.row AS row, {who}.doc_id AS doc_id, {who}.whole AS whole)"


def _fold(seed: int, kind: str) -> str:
    a, x = "acc.a", "x"
    step = STEP.format(
        seed=seed,
        x_less=_with_p(x, "greatest(0D, x.p - acc.a.size * (1 - acc.a.p) / x.size)"), x_more=_with_p(x, "least(1D, x.p + acc.a.size * acc.a.p / x.size)"),
        a_less=_with_p(a, "greatest(0D, acc.a.p - x.size * (1 - x.p) / acc.a.size)"), a_more=_with_p(a, "least(1D, acc.a.p + x.size * x.p / acc.a.size)"),
        a_one=_with_p(a, "1"), a_zero=_with_p(a, "0"), x_one=_with_p(x, "1"), x_zero=_with_p(x, "0"),
    )
    item = ITEM.format(kind=kind)
    return f"aggregate(items, CAST(struct(NULL AS a, array() AS done) AS struct<a:{item},done:array<{item}>>), (acc, x) -> CAST({step} AS struct<a:{item},done:array<{item}>>))"


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7, chunk: int = CHUNK, draw: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of each row of docs; draw is what chance is drawn by, the id if not given."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text_hash = F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    drawn = F.xxhash64(F.lit(seed), F.col(id_col), F.when(F.col(id_col).isNull(), text_hash)) if draw is None else F.xxhash64(F.lit(seed), draw)
    sizes = common.cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), drawn.alias("h")))
    crowded = common.cut(sizes.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > chunk).select(F.col("h").alias("crowd")))
    if crowded.limit(1).count():
        # sizes is written, so its rows keep their numbers
        placed = sizes.withColumn("row", F.monotonically_increasing_id()).join(common.small(crowded), F.col("h") == F.col("crowd"), "left")
        sizes = common.cut(placed.select("doc_id", "source", "size", F.when(F.col("crowd").isNull(), F.col("h")).otherwise(F.xxhash64("h", "row")).alias("h")))
    targets = common.cut(source_targets(sizes.select("source", "size"), weights, share, most))
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    few = common.small(targets)
    wanted = sizes.alias("d").join(few.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target", "t.n_docs", (F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(0.0)).alias("rate"))
    wanted = wanted.withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.floor("rate"))
    per_doc = ["source", "doc_id", "size", "whole"]
    fractional = (F.col("size") > 0) & (F.col("p") > 0)
    settled = [wanted.filter(~fractional).select(*per_doc, F.lit(0.0).alias("p"))]
    live = wanted.filter(fractional).select("source", F.col("n_docs").alias("n"), F.struct("size", "p", "h", F.lit(0).cast("bigint").alias("row"), "doc_id", "whole").alias("item"))
    levels = max(1, math.ceil(math.log(max(largest, 2), chunk)))
    for level in range(levels):
        chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / chunk))
        folded = live.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64(F.lit(level), F.col("item.h")), F.col("chunks"))).groupBy("source", "chunk", "chunks").agg(F.sort_array(F.collect_list("item")).alias("items"))
        folded = folded.withColumn("items", F.transform("items", lambda x, i: x.withField("row", i.cast("bigint"))))
        folded = common.cut(folded.select("source", "chunks", F.expr(_fold(seed * 1000 + level, kind)).alias("r")))
        done = folded.select("source", F.explode("r.done").alias("i"))
        rest = folded.filter("r.a IS NOT NULL")
        if level == levels - 1:
            done = done.union(rest.select("source", F.col("r.a").withField("p", F.when(F.col("r.a.p") >= 0.5, 1.0).otherwise(0.0)).alias("i")))
        else:
            # a document that came out whole needs no further meeting
            still = (F.col("r.a.p") > 1e-12) & (F.col("r.a.p") < 1 - 1e-12)
            done = done.union(rest.filter(~still).select("source", F.col("r.a").withField("p", F.round("r.a.p")).alias("i")))
            live = rest.filter(still).select("source", F.col("chunks").alias("n"), F.col("r.a").alias("item"))
        settled.append(done.select("source", "i.doc_id", "i.size", "i.whole", "i.p"))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    out = out.alias("d").join(few.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    return out.select("d.doc_id", "d.source", "d.size", "t.source_size", "t.target", (F.col("d.whole") + F.round("d.p")).cast("long").alias("copies"))


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    mixed = mix(docs, common.word_count(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")
