"""Quality rules: robust multivariate outliers (operator 9).

Counts of each text, then two verdicts. The base rules reject texts of fewer than MIN_WORDS words, and
texts of whose words more than half are in repeated 3-word windows. The others are judged by the minimum
covariance determinant: for each language and source, location and scatter are estimated from that
share H of documents whose scatter has the least determinant, found by concentration steps: from medians
and absolute deviations, take the H documents with the least distances, estimate anew, and so on, until the
distance of the last one taken moves by less than SETTLED in each group, STEPS times at most. A document
goes if its squared Mahalanobis distance is over CUTOFF.

The vector of a text: the logarithm of its mean word length, and square roots of the share of symbols
among characters, of repeated lines among lines, of words in repeated windows, and of its letters that are
capital. Most clean texts have none of some of these, so their scatter may vanish; FLOOR, the spread that
is always allowed, is added to it. A group's location and scatter are drawn towards those of all documents,
which count as PRIOR documents of the group, so that few documents don't make a norm of their own.

Steps run as aggregations over all documents that keep only sums, so that a group's size bounds no task;
quantiles of distances are sketches with a rank error of 1 / ACCURACY. The estimates, one row for each
group, are inverted by a function over these rows and joined back.

Nulls: a null text has no words and fails the base rules; null languages and sources make groups of their
own. Null ids, repeated rows and ties are judged like others, texts of any length as a whole. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.llm import common, tokens

MIN_WORDS, MOST_REPEATED = 50, 50
H, STEPS, SETTLED, PRIOR, ACCURACY = 0.75, 8, 0.01, 200, 2_000
DIMENSIONS = ("word_length", "symbols", "dup_lines", "repeats", "capitals")
FLOOR = (0.06, 0.04, 0.16, 0.12, 0.05)
#: For a normal vector of five dimensions, one clean text in 10^8 is beyond 46.
CUTOFF = 45.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals")
SYMBOL, LETTER, CAPITAL = (np.zeros(256, np.int8) for _ in range(3))
SYMBOL[list(b"#*$%&|<>")] = 1
LETTER[65:91] = LETTER[97:123] = 1
CAPITAL[65:91] = 1


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def count(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text, by name."""
    n = len(offsets) - 1
    spans = tokens.Spans(raw)
    starts, ends, bounds = tokens.word_spans(raw, offsets)
    words = spans.hashes(starts, ends)
    full = ~tokens.BLANK[raw]
    out = {"n_words": np.diff(bounds), "word_chars": per_text(full & ((raw & 0xC0) != 0x80), offsets), "n_symbols": per_text(SYMBOL[raw], offsets), "n_letters": per_text(LETTER[raw], offsets), "n_capitals": per_text(CAPITAL[raw], offsets)}

    windows = tokens.gram_hashes(words, 3)
    repeated = np.zeros(len(words) + 1, np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a < 4:
            continue
        own = windows[a : b - 2]
        order = np.argsort(own, kind="stable")
        in_order = own[order]
        same = in_order[1:] == in_order[:-1]
        if same.any():
            twice = np.zeros(len(own), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(b - a, bool)
            for k in range(3):
                cover[k : k + len(own)] |= twice
            repeated[a:b] = cover
    out["n_repeat_words"] = per_text(repeated[:-1], bounds)

    breaks = np.flatnonzero(raw == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(raw)]
    if len(line_starts):
        line_ends = np.minimum(np.append(line_starts[1:], len(raw)), len(raw))
        ends_at_break = raw[line_ends - 1] == 10
        words_before = np.concatenate([[0], np.cumsum(full)])
        line_ends = line_ends - ends_at_break
        some = words_before[np.maximum(line_ends, line_starts)] > words_before[line_starts]
        line_starts, line_ends = line_starts[some], line_ends[some]
        lines, text = spans.hashes(line_starts, line_ends), np.searchsorted(offsets, line_starts, "right") - 1
        order = np.lexsort((lines, text))
        again = (lines[order][1:] == lines[order][:-1]) & (text[order][1:] == text[order][:-1])
        out["n_dup_lines"], out["n_lines"] = np.bincount(text[order][1:][again], minlength=n), np.bincount(text, minlength=n)
    else:
        out["n_dup_lines"] = out["n_lines"] = np.zeros(n, np.int64)
    return out


def with_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the text if none are named) and the counts."""
    common.ship(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    docs = docs.select(text_col, *(c for c in keep if c != text_col))
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    places = [docs.columns.index(c) for c in keep]

    def run(batches):
        for batch in batches:
            for a, b in common.slices(batch.column(0)):
                part = batch.slice(a, b - a)
                found = count(*common.utf8(part.column(0)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=schema.names)

    return docs.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vector() -> list[Column]:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    parts = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_capitals", "n_letters")]
    return [p.alias(n) for p, n in zip(parts, DIMENSIONS, strict=True)]


def _moments() -> list[Column]:
    d = DIMENSIONS
    return [F.count("*").alias("n"), F.array(*(F.avg(x) for x in d)).alias("mean"), F.array(*(F.avg(F.col(x) * F.col(y)) for i, x in enumerate(d) for y in d[i:])).alias("cross")]


def _shape(mean: list[float], cross: list[float], floor: tuple[float, ...]) -> np.ndarray:
    k = len(mean)
    scatter = np.zeros((k, k))
    scatter[np.triu_indices(k)] = cross
    scatter = scatter + np.triu(scatter, 1).T - np.outer(mean, mean)
    return scatter + np.diag(np.square(floor))


def _inverted(estimates: DataFrame, consistency: float, floor: tuple[float, ...], prior: float) -> DataFrame:
    """grp, mean and the inverse scatter as its upper triangle, the rest of it doubled. estimates: grp, n, mean and cross; grp 0 is all documents."""
    estimates = common.cut(estimates.select("grp", "n", "mean", "cross"))
    pooled = estimates.filter("grp = 0").first()
    k = len(DIMENSIONS)
    whole = (np.array(pooled["mean"]), _shape(pooled["mean"], pooled["cross"], (0,) * k)) if pooled else (np.zeros(k), np.zeros((k, k)))

    def run(frames):
        for f in frames:
            means, inverse = [], []
            for grp, n, m, c in zip(f["grp"], f["n"], f["mean"], f["cross"], strict=True):
                own = 1.0 if grp == 0 else n / (n + prior)
                shape = own * _shape(list(m), list(c), (0,) * k) + (1 - own) * whole[1]
                means.append((own * np.array(m) + (1 - own) * whole[0]).tolist())
                inverse.append((np.linalg.inv(shape * consistency + np.diag(np.square(floor))) * (2 - np.eye(k)))[np.triu_indices(k)].tolist())
            yield pd.DataFrame({"grp": f["grp"], "mean": means, "inverse": inverse})

    return common.cut(estimates.mapInPandas(run, "grp long, mean array<double>, inverse array<double>"))


def _distance() -> Column:
    k = len(DIMENSIONS)
    gap = [F.col(x) - F.col("mean")[i] for i, x in enumerate(DIMENSIONS)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    terms = [F.col("inverse")[n] * gap[i] * gap[j] for n, (i, j) in enumerate(pairs)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def outliers(stats: DataFrame, groups: list[str], cutoff: float = CUTOFF, h: float = H, steps: int = STEPS, floor: tuple[float, ...] = FLOOR, prior: float = PRIOR) -> DataFrame:
    """stats with distance (squared Mahalanobis, robust); stats has DIMENSIONS, and judged says which rows teach and are judged."""
    common.ship(stats.sparkSession)
    # groups are numbered by a hash of their names; 0 is all documents
    number = F.xxhash64(*groups, *(F.col(g).isNull() for g in groups))
    rows = common.cut(stats.withColumn("grp", F.when(number == 0, F.lit(1).cast("long")).otherwise(number)))
    taught = rows.filter("judged").select("grp", *DIMENSIONS)
    taught = taught.union(taught.withColumn("grp", F.lit(0).cast("long")))
    # the start: medians, and deviations from them on the diagonal
    middle = common.cut(taught.groupBy("grp").agg(F.count("*").alias("n"), F.array(*(F.percentile_approx(x, 0.5, ACCURACY) for x in DIMENSIONS)).alias("mean")))
    apart = taught.join(common.small(middle), "grp").select("grp", "n", "mean", *(F.abs(F.col(x) - F.col("mean")[i]).alias(x) for i, x in enumerate(DIMENSIONS)))
    spread = apart.groupBy("grp").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.array(*(F.percentile_approx(x, 0.5, ACCURACY) for x in DIMENSIONS)).alias("mad"))
    k = len(DIMENSIONS)
    cross = [(F.col("mean")[i] * F.col("mean")[j] + (F.pow(1.4826 * F.col("mad")[i], 2) if i == j else F.lit(0.0))) for i in range(k) for j in range(i, k)]
    estimate, before = _inverted(spread.select("grp", "n", "mean", F.array(*cross).alias("cross")), 1.0, floor, prior), None
    for step in range(steps):
        near = taught.join(common.small(estimate), "grp").select("grp", *DIMENSIONS, _distance().alias("distance"))
        bound = common.cut(near.groupBy("grp").agg(F.percentile_approx("distance", h, ACCURACY).alias("bound")))
        moved = F.col("bound") < (1 - SETTLED) * F.col("before")
        last = step == steps - 1 or before is not None and not bound.join(before, "grp").filter(moved).limit(1).count()
        inner = near.join(common.small(bound), "grp").filter("distance <= bound").groupBy("grp").agg(*_moments())
        # the nearer h of a normal cloud are less spread than all of it
        estimate = _inverted(inner, consistency(h, k) if last else 1.0, floor, prior)
        if last:
            break
        before = bound.withColumnRenamed("bound", "before")
    return rows.join(common.small(estimate), "grp", "left").withColumn("distance", F.when(F.col("judged") & F.col("mean").isNotNull(), _distance())).withColumn("outlier", F.coalesce(F.col("distance") > cutoff, F.lit(False))).drop("grp", "mean", "inverse")


def consistency(h: float, k: int) -> float:
    """By how much the scatter of the nearest h of a k-dimensional normal cloud is less than the whole one."""
    draws = np.sort(np.random.default_rng(5).chisquare(k, 200_000))
    bound = draws[int(h * len(draws)) - 1]
    inner = np.mean(np.random.default_rng(6).chisquare(k + 2, 200_000) <= bound)
    return float(h / inner)


def judge(docs: DataFrame, text_col: str = "text", groups: tuple[str, str] = ("lang", "source"), id_col: str = "doc_id") -> DataFrame:
    """The id, groups, counts, base_failed, distance, outlier and kept of each row."""
    stats = with_counts(docs.select(id_col, *groups, text_col), text_col, [id_col, *groups])
    stats = stats.withColumn("base_failed", base_failed()).withColumn("judged", ~F.col("base_failed")).select("*", *vector())
    return outliers(stats, list(groups)).withColumn("kept", ~F.col("base_failed") & ~F.col("outlier")).drop("judged")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge(common.read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", *DIMENSIONS)
