"""Document fingerprints by winnowing (operator 2), in DataFrame and SQL functions only.

Words are hashed, each run of K words gets one hash (a gram), and of each window of W grams the least is
kept, of equal ones the rightmost, with its position. Two texts that share a run of K + W - 1 words share
a fingerprint hash: the match guarantee. A text of fewer words than K has one gram, of all its words; one
with fewer grams than W has one window. A text without words has an empty fingerprint.

A selected gram is one number: its 31-bit hash above, and 2^32 - 1 less its position below, so that the
least number of a window is the rightmost of its least hashes. All is one expression over arrays, for each
row by itself; nothing is exploded or shuffled.

Likeness is the Jaccard similarity of the sets of hashes; two empty ones are alike (1).

Nulls: a null text is empty. Rows are ordered by falling id, null ids last, equal ids by a hash of the
text; each row's next is the one after it, the last row's is the first. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.llm import common

K, W = 5, 16
ROWS_PER_BUCKET, MOST_BUCKETS = 4_000, 50_000

_FINGERPRINT = r"""
transform(array(filter(split({text}, '[\\x20\\x09-\\x0D]+'), w -> w != '')), words ->
transform(array(transform(words, w -> xxhash64(w))), h ->
transform(array(CASE WHEN size(h) = 0 THEN CAST(array() AS array<bigint>)
  WHEN size(h) < {k} THEN array(shiftleft(xxhash64(h) & 2147483647L, 32) + 4294967295L)
  ELSE transform(sequence(0, size(h) - {k}), i -> shiftleft(xxhash64({gram}) & 2147483647L, 32) + (4294967295L - i)) END), g ->
  CASE WHEN size(g) <= {w} THEN filter(array(array_min(g)), x -> x IS NOT NULL)
  ELSE {least} END
)[0])[0])[0]
"""


def _least(w: int) -> str:
    """The least of each w neighbours of the array g, each once: of windows twice as long each time, the last two of which may overlap."""
    steps, have, name = [], 1, "g"
    while have < w:
        shift = min(have, w - have)
        steps.append((f"m{have + shift}", f"zip_with({name}, slice({name}, {shift + 1}, size(g)), (x, y) -> least(x, y))"))
        have, name = have + shift, f"m{have + shift}"
    out = f"array_distinct(slice({name}, 1, size(g) - {w} + 1))"
    for name, step in reversed(steps):
        out = f"transform(array({step}), {name} -> {out})[0]"
    return out


def winnow(text: str, k: int = K, w: int = W) -> Column:
    """The selected grams of a text column, by name: array<bigint> in the order of their positions."""
    return F.expr(_FINGERPRINT.format(text=f"coalesce(`{text}`, '')", k=k, w=w, gram=", ".join(f"h[i + {j}]" for j in range(k)), least=_least(w)))


def gram_set(selected: Column) -> Column:
    """The distinct hashes of selected grams."""
    return F.array_distinct(F.transform(selected, lambda x: F.shiftright(x, 32)))


def gram_positions(selected: Column) -> Column:
    """Hash and word position of each selected gram."""
    return F.transform(selected, lambda x: F.struct(F.shiftright(x, 32).alias("hash"), (F.lit(4294967295) - x.bitwiseAND(F.lit(4294967295))).alias("position")))


def digest(selected: Column) -> Column:
    """A fingerprint as text: the hashes in order, in hexadecimal, each with its position."""
    return F.array_join(F.transform(selected, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 32))), F.lit("@"), (F.lit(4294967295) - x.bitwiseAND(F.lit(4294967295))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes (distinct arrays)."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def _order_key(id_col: str, text_col: str) -> Column:
    """A string that sorts rows by falling id, null ids last, equal ids by a hash of the text."""
    number = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    falling = number(F.col(id_col).cast("long").bitwiseXOR(F.lit(9223372036854775807)))
    return F.concat(F.coalesce(falling, F.lit("g")), number(F.xxhash64(text_col)))


def _ranges(keys: DataFrame, buckets: int) -> tuple[list[str], int]:
    """The last key of each of so many ranges of about equal rows, by Spark's sample of keys, and the rows of the largest."""
    ranged = keys.repartitionByRange(buckets, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.max("key").alias("last"), F.count("*").alias("n"))
    found = ranged.select("last", "n").collect()  # at most MOST_BUCKETS
    return sorted(r["last"] for r in found), max((r["n"] for r in found), default=0)


def _bucket(key: str, bounds: list[str]) -> Column:
    """How many of the bounds, of which the last is left out, are below a key; by halving."""
    if len(bounds) < 2:
        return F.lit(0)
    table, middle = f"split('{','.join(bounds[:-1])}', ',')", "CAST((r.a + r.b) div 2 AS INT)"  # the table is folded to a literal
    return F.expr(f"""aggregate(sequence(1, {len(bounds).bit_length()}), named_struct('a', 0, 'b', {len(bounds) - 1}), (r, i) ->
        CASE WHEN r.a >= r.b THEN r WHEN {table}[{middle}] < {key} THEN named_struct('a', {middle} + 1, 'b', r.b) ELSE named_struct('a', r.a, 'b', {middle}) END, r -> r.a)""")


def with_next(docs: DataFrame, id_col: str, carried: list[str], text_col: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """docs with next_<column> for each carried one, of the next row by falling id, the last row's of the first.

    Rows fall into ranges of the order that hold about equally many, whatever the ids, and each range is one
    window, so that there is no global sort; the first row of each range also goes to the range before as a
    guest. Where rows with equal ids and texts crowd a range, a number of the row is added to the order:
    such rows are alike, so it decides nothing but their range (docs must then be a table or a checkpoint, so that
    rows keep their numbers). Bounds and first rows are collected, at most MOST_BUCKETS. Columns of docs with the
    names of new ones are replaced.
    """
    docs = docs.drop(*(f"next_{c}" for c in carried), "__key", "__bucket", "__place", "__at", "__top", "__to")
    key, number = _order_key(id_col, text_col), F.lpad(F.hex(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 32))), 8, "0")
    keys = common.cut(docs.select(key.alias("key"), number.alias("number")))
    n = keys.count()
    if not n:
        return docs.select("*", *(F.col(c).alias(f"next_{c}") for c in carried))
    buckets = min(MOST_BUCKETS, math.ceil(n / rows_per_bucket))
    bounds, largest = _ranges(keys, buckets)
    if largest > 4 * max(rows_per_bucket, n / buckets):
        key, keys = F.concat(key, number), keys.select(F.concat("key", "number").alias("key"))
        bounds, _ = _ranges(keys, buckets)
    tops = keys.groupBy(_bucket("key", bounds).alias("bucket")).agg(F.min("key").alias("top")).orderBy("bucket").collect()
    rows = docs.withColumn("__key", key).withColumn("__bucket", _bucket("__key", bounds))
    # the first of a range goes to the range before, that of the first range to the last
    edges = docs.sparkSession.createDataFrame([(t.bucket, t.top, tops[i - 1].bucket) for i, t in enumerate(tops)], "__at int, __top string, __to int")
    rows = rows.join(F.broadcast(edges), (F.col("__bucket") == F.col("__at")) & (F.col("__key") == F.col("__top")), "left")
    place = lambda at, guest: F.struct(F.col(at).alias("at"), F.lit(guest).alias("guest"))
    rows = rows.withColumn("__place", F.explode(F.when(F.col("__to").isNull(), F.array(place("__bucket", 0))).otherwise(F.array(place("__bucket", 0), place("__to", 1)))))
    order = Window.partitionBy("__place.at").orderBy("__place.guest", "__key")
    rows = rows.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in carried))
    return rows.filter("__place.guest = 0").select(*docs.columns, *(f"next_{c}" for c in carried))


def fingerprints(docs: DataFrame, text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """docs with fingerprint (selected grams)."""
    return docs.withColumn("fingerprint", winnow(text_col, k, w))


def op2_winnowing(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(fingerprints(docs), "doc_id", ["text", "fingerprint"])
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    docs = docs.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    docs = docs.select("doc_id", "n_chars", "edited", "fingerprint", "next_fingerprint", winnow("edited").alias("edited_fingerprint"))
    sets = docs.select("*", gram_set(F.col("fingerprint")).alias("own"), gram_set(F.col("edited_fingerprint")).alias("changed"), gram_set(F.col("next_fingerprint")).alias("following"))
    return sets.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digest(F.col("fingerprint")).alias("fingerprint"), digest(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
