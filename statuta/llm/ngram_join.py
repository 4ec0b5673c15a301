"""N-gram Jaccard join by MinHash banding (operator 7).

Two texts are linked if the Jaccard similarity of their sets of 5-word shingles is 0.8 or more.

1. Each text gets its set of 64-bit shingle hashes, from it a key (texts with equal sets share it), the size
   of the set and BANDS hashes, each over ROWS minima. Bands and rows are chosen for the recall wanted
   at the threshold. Texts with equal sets are one class from here on: one row, and how many there are.
2. Classes are dealt by band hash. Within a bucket each class is tied to the least class, never to all
   others, and ties make candidate components (labels travel along ties until none changes).
3. Each component of two classes or more is verified: all its pairs of similar size, on the full
   sets, in blocks whose members and bytes are bounded. A block pair counts overlaps, by products of small
   incidence matrices where many texts share a hash, and gives a row for each of its classes, not for each
   pair, so a large group of near copies makes no quadratic output, and its blocks spread over the cluster.
4. Verified links give each class its number of linked texts, and components again: the class id is
   the least id in it.

Texts that share a band bucket always share a component, so verifying components verifies every candidate
pair of the banding and more. The result has a row for each document: class_id, n_links (other documents
that it is linked with, copies included), n_copies (documents with an equal set, itself included).

A text of fewer words than five has one shingle, of all its words. A null text or one without words has no
shingle and no link: it is a class of its own. Rows with null ids take part; class_id is the least
id that isn't null, else null. Repeated rows are copies. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.llm import common, tokens

WORDS, THRESHOLD, RECALL = 5, (4, 5), 0.997
MOST_HASHES = 256
#: Members of a block; how many blocks a size class has before they grow, and up to which size; shingles of a block.
BLOCK, BLOCKS, LARGEST_BLOCK, BLOCK_SHINGLES = 128, 24, 2_048, 1 << 20


def choose_bands(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows, so the fewest chance candidates, that reach the recall at the threshold."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall")


BANDS, ROWS = choose_bands(THRESHOLD[0] / THRESHOLD[1])

_rng = np.random.default_rng(20240229)
_TURN = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_FLIP = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def band_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of band hashes for each set; sets must not be empty."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    grams = np.concatenate(sets)
    low = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(sets), BANDS), np.int64)
    for band in range(BANDS):
        total = np.full(len(sets), band + 1, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            turned = (low ^ _FLIP[i]) * _TURN[i]
            turned ^= turned >> np.uint32(15)
            least = np.minimum.reduceat(turned, starts)
            total = tokens.mix(total * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, band] = total.view(np.int64)
    return out


def set_key(s: np.ndarray) -> bytes:
    """128 bits of a set, whatever the order."""
    a, b = tokens.mix(s), tokens.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64) ^ np.uint64(len(s))], np.uint64).tobytes()


def signatures(hashed: DataFrame) -> DataFrame:
    """id, hash, key, size and bands of each row of id, text and hash; key and bands are null for texts without shingles."""
    common.ship(hashed.sparkSession)
    schema = T.StructType([hashed.schema["id"], hashed.schema["hash"], T.StructField("key", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for a, b in common.slices(batch.column(1), 1 << 19):
                part = batch.slice(a, b - a)
                sets = tokens.shingle_sets(*common.utf8(part.column(1)), WORDS)
                some = [i for i, s in enumerate(sets) if len(s)]
                bands = [None] * len(sets)
                if some:
                    for i, row in zip(some, band_hashes([sets[i] for i in some]), strict=True):
                        bands[i] = row
                keys = [set_key(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(bands, pa.list_(pa.int64()))], names=schema.names)

    return hashed.select("id", "text", "hash").mapInArrow(run, schema)


def components(ties: DataFrame) -> DataFrame:
    """node and label, the least node that ties reach; ties has a and b, both ways or not.

    Each round a node takes the least label among its own and its neighbours', a node that is a label takes
    the least that its holders met, and then each the label of its label. Labels only fall, so rounds end by
    themselves, when none changes; nodes are hashes, and paths of 2,000 and 200,000 took 15 and 23 rounds. Only
    aggregations and joins by key.
    """
    both = common.cut(ties.select("a", "b").union(ties.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = common.cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        met = common.cut(labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("near")))  # used twice
        hook = met.groupBy(F.col("old").alias("root")).agg(F.min("near").alias("hook"))
        stepped = met.join(hook, met.node == hook.root, "left").select("node", "old", F.least("near", "hook").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = common.cut(stepped.join(jump, stepped.label == jump["at"], "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = moved.select("node", "label")
        if not moved.filter("label <> old").limit(1).count():
            return labels


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096, most: int = 1 << 21) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted distinct arrays.

    Hashes that many texts hold are counted by products of incidence matrices, `width` at a time; the pairs
    that hold a rarer one are listed, at most about `most` at a time.
    """
    n, m = len(left), len(right)
    out = np.zeros((n, m), np.float32)
    sizes = [len(s) for s in left], [len(s) for s in right]
    values, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    a, b = code[: sum(sizes[0])], code[sum(sizes[0]) :]
    held = np.bincount(a, minlength=len(values)), np.bincount(b, minlength=len(values))
    pairs = held[0] * held[1]
    common_ones = pairs > n * m // 200
    rows = np.repeat(np.arange(n), sizes[0]), np.repeat(np.arange(m), sizes[1])

    number = np.cumsum(common_ones) - 1
    sides = []
    for row, c in zip(rows, (a, b), strict=True):
        keep = common_ones[c]
        row, c = row[keep], number[c[keep]]
        order = np.argsort(c, kind="stable")
        sides.append((row[order], c[order]))
    for at in range(0, int(common_ones.sum()), width):
        two = []
        for (row, c), k in zip(sides, (n, m), strict=True):
            i, j = np.searchsorted(c, [at, at + width])
            one = np.zeros((k, width), np.float32)
            one[row[i:j], c[i:j] - at] = 1
            two.append(one)
        out += two[0] @ two[1].T

    rare = ~common_ones & (pairs > 0)
    if rare.any():
        order = np.argsort(b, kind="stable")
        place, right_rows = np.concatenate([[0], np.cumsum(held[1])]), rows[1][order]
        keep = rare[a]
        left_rows, c = rows[0][keep], a[keep]
        times = held[1][c]
        ends = np.cumsum(times)
        start = 0
        while start < len(c):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            t = times[start:stop]
            within = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
            met = np.repeat(left_rows[start:stop], t) * m + right_rows[np.repeat(place[c[start:stop]], t) + within]
            out += np.bincount(met, minlength=n * m).reshape(n, m)
            start = stop
    return out.astype(np.int32)


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs reach the threshold."""
    both = overlaps(left, right)
    union = np.array([len(s) for s in left], np.int32)[:, None] + np.array([len(s) for s in right], np.int32)[None, :] - both
    return THRESHOLD[1] * both >= THRESHOLD[0] * union


def placed_in_blocks(members: DataFrame) -> DataFrame:
    """Each member once for each block pair that it takes part in: the pair (size class and block of both sides), and whether it is on the first, the second or both sides.

    A component of at most BLOCK members and BLOCK_SHINGLES shingles is one block. In a larger one, size
    classes grow by the inverse of the threshold, so that linked sets are in equal or adjacent ones; each is
    cut by hash into blocks, of which none is expected to hold more than BLOCK_SHINGLES. Blocks have BLOCK
    members; where a class has more than BLOCKS times as many they grow with it, up to LARGEST_BLOCK, so that
    a set is sent to a few dozen tasks and not to thousands. Only cells of large components are joined, so
    that a large component is no hot key.
    """
    grown = THRESHOLD[1] / THRESHOLD[0]
    members = members.withColumn("cls", F.floor(F.log("size") / F.lit(math.log(grown))).cast("int"))
    large = members.groupBy("comp").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).filter((F.col("n") > BLOCK) | (F.col("shingles") > BLOCK_SHINGLES)).select("comp")
    fits = F.greatest(F.lit(1.0), F.floor(F.lit(float(BLOCK_SHINGLES)) / F.pow(F.lit(grown), F.col("cls") + 1)))
    per = F.least(fits, F.greatest(F.lit(float(BLOCK)), F.least(F.lit(float(LARGEST_BLOCK)), F.col("n") / BLOCKS)))
    cells = members.groupBy("comp", "cls").agg(F.count("*").alias("n")).join(large, "comp", "left_semi").withColumn("blocks", F.ceil(F.col("n") / per).cast("int"))
    near = lambda by, name: cells.select("comp", (F.col("cls") + by).alias("cls"), F.col("blocks").alias(name))
    known = common.cut(cells.join(near(-1, "above"), ["comp", "cls"], "left").join(near(1, "below"), ["comp", "cls"], "left"))
    out = members.join(common.small(known), ["comp", "cls"], "left").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda c1, b1, c2, b2, first, second: F.struct(c1.alias("c1"), b1.alias("b1"), c2.alias("c2"), b2.alias("b2"), first.alias("first"), second.alias("second"))
    c, b = F.col("cls"), F.col("block")
    own = F.transform(up_to(F.col("blocks")), lambda q: pair(c, F.least(b, q), c, F.greatest(b, q), b <= q, b >= q))
    above = F.transform(up_to(F.coalesce("above", F.lit(0))), lambda q: pair(c, b, c + 1, q, F.lit(True), F.lit(False)))
    below = F.transform(up_to(F.coalesce("below", F.lit(0))), lambda q: pair(c - 1, q, c, b, F.lit(False), F.lit(True)))
    zero, yes = F.lit(0), F.lit(True)
    sides = F.when(F.col("blocks").isNull(), F.array(pair(zero, zero, zero, zero, yes, yes))).otherwise(F.concat(own, above, below))
    return out.select("node", "comp", "copies", F.explode(sides).alias("pair")).select("node", "comp", "copies", "pair.*")


def hashed_sets(texts: DataFrame) -> DataFrame:
    """node and grams, the bytes of its sorted shingle hashes, of each row of node and text."""
    common.ship(texts.sparkSession)

    def run(batches):
        for batch in batches:
            for a, b in common.slices(batch.column(1), 1 << 19):
                part = batch.slice(a, b - a)
                sets = tokens.shingle_sets(*common.utf8(part.column(1)), WORDS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "grams"])

    return texts.select("node", "text").mapInArrow(run, "node long, grams binary")


def links_of(node: np.ndarray, copies: np.ndarray, first: np.ndarray, second: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, label (the least node that links of this block pair reach) and links of each linked row; rows are in the order of nodes."""
    a, b, n = np.flatnonzero(first), np.flatnonzero(second), len(node)
    links = np.zeros(n, np.int64)
    root = np.arange(n)
    if len(a) and len(b) and n > 1:
        hit = linked([sets[k] for k in a], [sets[k] for k in b])
        hit &= a[:, None] != b[None, :]
        links[a] += hit @ copies[b]
        if not (first[0] and second[0]):  # else both sides are one block: each pair is seen from both
            links[b] += hit.T @ copies[a]
        left, right = np.nonzero(hit)
        left, right = a[left], b[right]
        while True:  # rows are in order, so the least place is the least node
            new = root.copy()
            np.minimum.at(new, left, root[right])
            np.minimum.at(new, right, root[left])
            new = new[new]
            if (new == root).all():
                break
            root = new
    some = np.flatnonzero(links)
    return node[some], node[root[some]], links[some]


def verify(members: DataFrame, texts: DataFrame) -> DataFrame:
    """node, label (the least node that links of this block pair reach) and links of each linked node, a row for each block pair.

    members: node, comp, size, copies. texts: node, text, of members at least; repeated nodes count once.
    Each text is hashed once; its set goes to the tasks of its block pairs, in their order, so that a Python
    worker holds the sets of one block pair and one batch, whatever a task is dealt.
    """
    keys = ["comp", "c1", "b1", "c2", "b2"]
    dealt = placed_in_blocks(members).join(hashed_sets(texts), "node").repartition(*keys).sortWithinPartitions(*keys, "node")

    def run(batches):
        held, current = [], None

        def settled():
            if len(held) < 2:
                return []
            node, copies, first, second, sets = zip(*held, strict=True)
            return [links_of(np.array(node), np.array(copies), np.array(first), np.array(second), list(sets))]

        for batch in batches:
            out = []
            key = np.stack([batch.column(k).to_numpy() for k in range(5)], 1)
            node, copies = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            first, second = batch.column(7).to_numpy(zero_copy_only=False), batch.column(8).to_numpy(zero_copy_only=False)
            raw, at = common.utf8(batch.column(9))
            for i, k in enumerate(map(tuple, key.tolist())):
                if k != current:
                    out += settled()
                    held, current = [], k
                if not held or held[-1][0] != node[i]:
                    held.append((node[i], copies[i], first[i], second[i], raw[at[i] : at[i + 1]].copy().view(np.uint64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["node", "label", "links"])
        for last in settled():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], names=["node", "label", "links"])

    return dealt.select(*keys, "node", "copies", "first", "second", "grams").mapInArrow(run, "node long, label long, links long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, text_hash, class_id, n_links, n_copies and keeper of each row of docs.

    keeper: whether the row is the first of its class, by id (nulls last), then text_hash. Rows with equal
    ids and texts are all keepers or none is.
    """
    hashed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    signed = common.cut(signatures(hashed))
    # node: a number for each class of equal sets; its text is that of the least id
    classes = signed.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("least"), F.count("*").alias("copies"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"))
    classes = common.cut(classes.select(F.xxhash64("key").alias("node"), "key", "least", F.col("least.id").alias("first"), F.col("least.hash").alias("hash"), "copies", "size", "bands"))
    dealt = classes.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("bucket"))
    buckets = dealt.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("bucket", "least")
    ties = dealt.join(buckets, "bucket").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    members = common.cut(classes.select("node", "first", "hash", "size", "copies").join(components(ties).withColumnRenamed("label", "comp"), "node"))
    wanted = common.small(members.select(F.col("first").alias("__id"), F.col("hash").alias("__hash"), "node"))
    texts = hashed.join(wanted, F.col("hash").eqNullSafe(F.col("__hash")) & F.col("id").eqNullSafe(F.col("__id"))).select("node", "text")
    verified = common.cut(verify(members.select("node", "comp", "size", "copies"), texts))
    totals = verified.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(verified.select(F.col("node").alias("a"), F.col("label").alias("b")))
    named = classes.select("node", "key", "least", "copies").join(totals, "node", "left").join(labels, "node", "left")
    head = named.filter("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("head"))
    named = named.join(head, "label", "left").select("key", F.coalesce("head", "least").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    out = signed.select("id", "hash", "key").join(named, "key", "left")
    alone = F.col("key").isNull()
    keeper = alone | (F.col("id").eqNullSafe(F.col("head.id")) & F.col("hash").eqNullSafe(F.col("head.hash")))
    return out.select(F.col("id").alias(id_col), F.col("hash").alias("text_hash"), F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), keeper.alias("keeper"))


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(common.read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash", "keeper")
