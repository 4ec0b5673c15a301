"""Best-fit packing (operator 1).

Texts go whole into training sequences of several permitted lengths. A text longer than the longest
length is cut into pieces of that length and a rest. Items are dealt by a hash of their id and row to shards
of about ITEMS_PER_SHARD, so that no task's work grows with the corpus and no key, not even an id that a
third of all rows have, can make a shard hot; only ids and lengths are shuffled, and they are written once
before, so that a task that runs again deals alike. Within a shard, from the longest item down, each goes to the open bin
with the least room that holds it (best fit). If none does, a bin is opened: of the permitted lengths
that hold the item, the one with the least cost for each word that it can still be filled with. That joint
choice is compared with always opening one length; the cheapest of these packings is kept. At last each
bin shrinks to the least permitted length that holds its contents.

A sequence of length c costs c + c * c / attention + overhead.

Nulls and empty texts: length 0, in no bin (bin_id null, bin_size 0). Null ids are dealt like others. Ties
go by id, then by row. Repeated rows are packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm import common

SIZES = (512, 1024, 2048, 4096, 8192)
ITEMS_PER_SHARD = 2_000


def sequence_cost(size: int, attention: int = 8192, overhead: int = 256) -> float:
    return size + size * size / attention + overhead


def best_fit(lengths: list[int], sizes: tuple[int, ...], opening: Callable[[int, int], int]) -> tuple[list[int], list[int], list[int]]:
    """For lengths that fall: each one's bin, its offset there, and each bin's contents."""
    room_bits, by_room = 0, {}
    where, offsets, filled, caps = [], [], [], []
    left = sum(lengths)
    for n in lengths:
        fits = room_bits >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                room_bits ^= 1 << room
        else:
            b, room = len(caps), opening(n, left)
            caps.append(room)
            filled.append(0)
        where.append(b)
        offsets.append(filled[b])
        filled[b] += n
        left -= n
        if room := room - n:
            if stack := by_room.get(room):
                stack.append(b)
            else:
                by_room[room] = [b]
                room_bits |= 1 << room
    return where, offsets, filled


def pack_lengths(lengths: list[int], sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """For lengths that fall, each within 1 to the longest size: bin and offset of each, and the size of each bin."""
    price = {c: cost(c) for c in sizes}
    policies = [lambda n, left: min((c for c in sizes if c >= n), key=lambda c: (price[c] / min(c, left), c))]
    policies += [lambda n, left, at=i: next(c for c in sizes[at:] if c >= n) for i in range(len(sizes))]
    best = None
    for opening in policies:
        where, offsets, filled = best_fit(lengths, sizes, opening)
        fitted = [next(c for c in sizes if c >= n) for n in filled]
        total = sum(price[c] for c in fitted)
        if best is None or total < best[0]:
            best = total, where, offsets, fitted
    return best[1:]


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = sequence_cost, items_per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """A row for each piece: the id, piece, piece_start, length, bin_id, bin_size, bin_offset."""
    if not sizes or min(sizes) < 1:
        raise ValueError("sizes must be positive")
    sizes = tuple(sorted(set(sizes)))
    top = sizes[-1]
    common.ship(docs.sparkSession)
    items = common.cut(docs.select(F.col(id_col).alias("item"), F.coalesce(length, F.lit(0)).cast("long").alias("n"), F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).alias("deal")))
    shards = max(1, math.ceil(items.count() / items_per_shard))
    items = items.select(F.pmod("deal", F.lit(shards)).alias("shard"), "item", "n")

    def pack_shard(shard: pa.Table) -> pa.Table:
        base = shard["shard"][0].as_py() << 31
        item, sizes_of = shard["item"].to_pylist(), shard["n"].to_pylist()
        pieces = []  # row, piece, start, length
        for row, n in enumerate(sizes_of):
            pieces += [(row, k, k * top, min(top, n - k * top)) for k in range(max(1, -(-n // top)))]
        order = sorted((i for i, p in enumerate(pieces) if p[3]), key=lambda i: (-pieces[i][3], str(item[pieces[i][0]]), pieces[i][1]))
        where, offsets, fitted = pack_lengths([pieces[i][3] for i in order], sizes, cost) if order else ([], [], [])
        put = {i: (base + b, fitted[b], at) for i, b, at in zip(order, where, offsets, strict=True)}
        out = list(zip(*((k, at, n, *put.get(i, (None, 0, 0))) for i, (_, k, at, n) in enumerate(pieces)), strict=True))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        columns = [shard["item"].combine_chunks().take(pa.array([p[0] for p in pieces])), *(pa.array(c, kind) for c, kind in zip(out, kinds, strict=True))]
        return pa.table(columns, names=["item", "piece", "piece_start", "length", "bin_id", "bin_size", "bin_offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    packed = items.groupBy("shard").applyInArrow(pack_shard, f"item {kind}, piece int, piece_start long, length long, bin_id long, bin_size int, bin_offset long")
    return packed.withColumnRenamed("item", id_col)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return pack(docs, common.word_count(F.col("text")))
