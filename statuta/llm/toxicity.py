"""Toxicity by noisy-channel deobfuscation (operator 5).

Writers hide words by leetspeak (1d10t), spacing (i d i o t, i.d.i.o.t) and repetition (idiooot). Each
token that may be hidden spans a lattice: a leet sign stands for some letters, a run of three or more
equal letters for one or two, signs between single letters for nothing. Viterbi decoding finds the path
that is likeliest under a trigram model of characters, and the words of the restored text are scored.
Tokens of letters only and without such runs have one path and are left alone. A sign at the end of a
word may be punctuation or a letter, so both readings count.

The character model mixes trigrams of all texts with those of the words that mark toxic texts in clear. The
score is a logistic regression on restored words and word beginnings, learned from a bounded sample of
labelled rows: about SAMPLE of each class, by hash of the id, equal texts once. Only features that are
much more frequent in toxic texts are used, the MOST_FEATURES most frequent of them. Features are counted
by Spark; the driver gets the chosen ones and which rows of the sample hold them. Whole texts are scored.

Nulls: a null text is empty; an empty text has the score of a text without marks. Rows with a null label
or id don't teach. Without labelled rows of both classes the score is the share of toxic ones, 0 if there
are none. Tokens of any length take linear time. Repeated rows get equal scores. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.llm import common

#: Labelled rows of each class that teach, about; how often a feature must be seen in the toxic ones, and how much more often than in others.
SAMPLE, SUPPORT, RATIO = 4_000, 3, 12.0
#: Features of the model at most.
MOST_FEATURES = 20_000
PREFIXES = (4, 5, 6)

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
JOINERS = " .-_*"
EDGE = ".,;:?\"'()[]{}<>#%&*-_=~`^/\\|!$+"

_SPACED = re.compile(r"(?<!\S)[a-z0-9@$!|+]([ .\-_*])(?:[a-z0-9@$!|+]\1){2,}[a-z0-9@$!|+](?![^\W_])")
_RUN = re.compile(r"([^\W\d_])\1\1+")
#: Places of a token with more than one reading: runs, and signs for several letters.
_OPEN = re.compile(rf"([^\W\d_]|[{re.escape(''.join(LEET))}])\1\1+|[{re.escape(''.join(c for c, v in LEET.items() if len(v) > 1))}]")
#: What the others read as.
_READ = str.maketrans({c: v for c, v in LEET.items() if len(v) == 1} | dict.fromkeys(JOINERS))

#: Characters of the model: 0 border or space, 1 to 26 letters, 27 other, then small letters of Latin-1.
_CLASS = np.full(256, 27, np.uint8)
_CLASS[32] = _CLASS[9:14] = 0
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
WIDTH = 64


def char_class(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    if "ß" <= c <= "ÿ":
        return 28 + ord(c) - 0xDF
    return 0 if c.isspace() else 27


def trigram_counts(raw: np.ndarray) -> np.ndarray:
    """Counts of character trigrams of a batch of texts, by the number of the trigram."""
    codes = _CLASS[raw]
    if len(raw) > 1:
        lead = raw[:-1] == 0xC3
        after = raw[1:][lead]
        small = np.where((after >= 0x80) & (after <= 0x9E), after + 0x20, after).astype(np.int64)
        codes[1:][lead] = np.where(small >= 0x9F, 28 + small - 0x9F, 27)
        keep = np.ones(len(raw), bool)
        keep[:-1] = ~lead
        codes = codes[keep]
    wide = codes.astype(np.int32)
    return np.bincount((wide[:-2] * WIDTH + wide[1:-1]) * WIDTH + wide[2:], minlength=WIDTH**3) if len(wide) > 2 else np.zeros(WIDTH**3, np.int64)


def corpus_trigrams(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """Trigram counts over all texts; as many as the characters of the model allow."""
    common.ship(docs.sparkSession)

    def run(batches):
        total = np.zeros(WIDTH**3, np.int64)
        for batch in batches:
            for a, b in common.slices(batch.column(0)):
                total += trigram_counts(common.utf8(batch.column(0).slice(a, b - a))[0])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["gram", "n"])

    counted = docs.select(text_col).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in counted.collect()}


class CharModel:
    """log P(c | a, b): trigrams of the corpus and of marked words, backed off to their last two and last characters."""

    def __init__(self, corpus: dict[int, int], words: list[str]):
        counts = np.zeros(WIDTH**3)
        for g, n in corpus.items():
            counts[g] = n
        self.log = np.log(0.5 * self._smooth(counts) + 0.5 * self._smooth(self._of(words)))

    @staticmethod
    def _of(words: list[str]) -> np.ndarray:
        counts = np.zeros(WIDTH**3)
        for w in words:
            codes = [0, 0, *map(char_class, w), 0]
            for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
                counts[(a * WIDTH + b) * WIDTH + c] += 1
        return counts

    @staticmethod
    def _smooth(counts: np.ndarray) -> np.ndarray:
        three = counts.reshape(WIDTH, WIDTH, WIDTH)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 0.5) / (one.sum() + 0.5 * WIDTH)
        p2 = (two + 2 * p1) / (two.sum(1, keepdims=True) + 2)
        p3 = (three + 2 * p2[None]) / (three.sum(2, keepdims=True) + 2)
        # a word begins after a border: two borders are read as one
        p3[0, 0] = p2[0]
        return p3


def readings(place: str) -> list[str]:
    """What a run, or a single character, may stand for; signs between letters for nothing."""
    letters = LEET.get(place[0], place[0] if place[0].isalpha() else "")
    if not letters:
        return [place.translate(_READ)]
    return [x * k for x in letters for k in ((1, 2) if len(place) > 2 else (len(place),))]


def lattice(token: str) -> list[list[str]]:
    """The readings of all places of a token."""
    out, at = [], 0
    for m in _OPEN.finditer(token):
        out += [readings(c) for c in token[at : m.start()]]
        out.append(readings(m[0]))
        at = m.end()
    return out + [readings(c) for c in token[at:]]


def decode(token: str, model: CharModel) -> str:
    """The likeliest path through a token's lattice.

    Two places with one reading settle all before them, so only stretches between such are searched, with
    a back pointer for each step; the rest is translated at once.
    """
    log, out, at = model.log, [], 0
    last = (0, 0)  # the classes of the last two characters, where all is settled
    paths: dict | None = None  # else by these: score, and the readings since, each with its predecessor

    def extended(options: list[str]) -> dict:
        new: dict = {}
        for (a, b), (score, way) in paths.items():
            for option in options:
                s, x, y = score, a, b
                for c in option:
                    z = char_class(c)
                    s += log[x, y, z]
                    x, y = y, z
                if (old := new.get((x, y))) is None or s > old[0]:
                    new[x, y] = s, (way, option)
        return new

    def settle(way: tuple | None) -> None:
        back = []
        while way:
            way, option = way
            back.append(option)
        out.extend(reversed(back))

    def plain(piece: str) -> None:
        nonlocal paths, last
        k = 0
        while paths is not None and k < len(piece):
            paths = extended([piece[k]])
            k += 1
            if k == 2:
                ((_, way),) = paths.values()
                settle(way)
                paths = None
        out.append(piece[k:])
        if paths is None and piece:
            last = (char_class(piece[-2]) if len(piece) > 1 else last[1], char_class(piece[-1]))

    for m in _OPEN.finditer(token):
        plain(token[at : m.start()].translate(_READ))
        options = readings(m[0])
        if len(options) == 1:
            plain(options[0])
        else:
            paths = {last: (0.0, None)} if paths is None else paths
            paths = extended(options)
        at = m.end()
    plain(token[at:].translate(_READ))
    if paths is not None:
        settle(max(((s + log[a, b, 0], way) for (a, b), (s, way) in paths.items()), key=lambda p: p[0])[1])
    return "".join(out)


def hidden_flags(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text may have runs of equal letters, and spaced words."""
    n = len(offsets) - 1
    letter = (raw >= 97) & (raw <= 122) | (raw >= 65) & (raw <= 90) | (raw >= 128)
    folded = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    runs, spaced = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    if len(raw) > 7:
        runs[:-2] = letter[:-2] & (folded[:-2] == folded[1:-1]) & (folded[:-2] == folded[2:])
        runs[:-4] |= (raw[:-4] >= 128) & (raw[:-4] == raw[2:-2]) & (raw[:-4] == raw[4:])
        sign = np.zeros(256, bool)
        sign[list(b"0123456789@$!|+")] = True
        joint = np.zeros(256, bool)
        joint[list(JOINERS.encode())] = True
        one = letter | sign[raw]
        between = joint[raw]
        # letter, joiner, letter, joiner, letter, joiner, letter
        spaced[:-6] = one[:-6] & between[1:-5] & one[2:-4] & between[3:-3] & one[4:-2] & between[5:-1] & one[6:]
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    counted = [sums(x) for x in (runs, spaced)]
    return tuple(c[offsets[1:]] > c[offsets[:-1]] for c in counted) if n else (np.zeros(0, bool),) * 2


class Restorer:
    """Words of restored texts; without a model, of texts as they are. Short decoded tokens are kept."""

    def __init__(self, model: CharModel | None):
        self.model, self.kept = model, {}

    def decoded(self, token: str) -> str:
        if (found := self.kept.get(token)) is None:
            found = decode(token, self.model).strip(EDGE)
            if len(token) <= 64:
                if len(self.kept) > 50_000:
                    self.kept.clear()
                self.kept[token] = found
        return found

    def words(self, text: str, runs: bool, spaced: bool) -> set[str]:
        """Distinct words of the restored text in lower case, without signs at their ends. runs and spaced: whether it may have such."""
        text = text.lower()
        if self.model is None:
            return {w for token in set(text.split()) if (w := token.strip(EDGE))}
        found = set()
        for token in set(text.split()):
            word = token.strip(EDGE)
            if word.isalpha():
                found.add(word)
                if token is not word:
                    # signs that may be part of the word: one before it, or one or two $ after it
                    before, _, after = token.partition(word)
                    if before[-1:] in LEET or after in ("$", "$$"):
                        found.add(self.decoded((before[-1:] if before[-1:] in LEET else "") + word + (after if after in ("$", "$$") else "")))
            elif word and not token.isdigit() and any(c.isalpha() for c in token) and any(c in LEET for c in token):
                found.add(self.decoded(token))
                found.add(self.decoded(word))
            else:
                found.add(word)
                if any(c in JOINERS for c in word):
                    found.add("".join(c for c in word if c not in JOINERS))
                    found.update(w.strip(EDGE) for w in re.split(r"[.\-_*]+", word))
        if runs:
            for word in [w for w in found if _RUN.search(w)]:
                found.remove(word)
                found.add(self.decoded(word))
        if spaced:
            for m in _SPACED.finditer(text):
                joined = self.decoded(m[0])
                # single letters that belong to the words around
                found.update(joined[a : len(joined) - b] for a in range(3) for b in range(3) if len(joined) - a - b >= 4 or a + b == 0)
        found.discard("")
        return found

    def restored(self, text: str) -> str:
        """The text with hidden words restored, in lower case."""
        text = _SPACED.sub(lambda m: self.decoded(m[0]), text.lower())

        def one(m: re.Match) -> str:
            token = m[0]
            hidden = any(c.isalpha() for c in token) and any(c in LEET for c in token) or _RUN.search(token)
            return self.decoded(token) if hidden else token

        return re.sub(r"\S+", one, text)


def features(words: set[str]) -> set[str]:
    out = {f"={w}" for w in words if len(w) >= 3}
    for n in PREFIXES:
        out.update(w[:n] for w in words if len(w) >= n)
    return out


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[str, float]
    trigrams: dict[int, int] = field(default_factory=dict)
    words: tuple[str, ...] = ()

    def key(self) -> tuple:
        return (round(self.bias, 12), len(self.weights), self.words[:50], len(self.trigrams), sum(self.trigrams.values()))

    def scorer(self) -> tuple[Restorer, frozenset, dict]:
        whole = frozenset(f[1:] for f in self.weights if f[0] == "=")
        begins = {n: frozenset(f for f in self.weights if f[0] != "=" and len(f) == n) for n in PREFIXES}
        return Restorer(CharModel(self.trigrams, list(self.words))), whole, begins

    def score(self, words: set[str], whole: frozenset, begins: dict) -> float:
        hits = {f"={w}" for w in words & whole}
        for n, known in begins.items():
            if known:
                hits.update(known.intersection([w[:n] for w in words]))
        z = self.bias + sum(self.weights[f] for f in sorted(hits))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit(labels: np.ndarray, doc: np.ndarray, col: np.ndarray, names: list[str], steps: int = 1_000, decay: float = 4e-4, prior: float = 0.1) -> tuple[float, dict[str, float]]:
    """Logistic regression of labels on features that mark label 1, moved so that 0.5 has the best F1 where label 1 is as frequent as prior. doc and col: which row holds which feature."""
    n, k, n1 = len(labels), len(names), int(labels.sum())
    n0 = n - n1
    w, bias = np.zeros(k), 0.0
    moment, size, b1, b2 = np.zeros(k + 1), np.zeros(k + 1), 0.9, 0.999
    balance = np.where(labels == 1, 0.5 / max(n1, 1), 0.5 / max(n0, 1))
    for t in range(1, steps + 1):
        z = bias + np.bincount(doc, w[col], n)
        error = (1 / (1 + np.exp(-z)) - labels) * balance
        slope = np.append(np.bincount(col, error[doc], k) + decay * w, error.sum())
        moment, size = b1 * moment + (1 - b1) * slope, b2 * size + (1 - b2) * slope**2
        step = 0.1 * (moment / (1 - b1**t)) / (np.sqrt(size / (1 - b2**t)) + 1e-10)
        w, bias = np.maximum(w - step[:-1], 0), bias - step[-1]
    z = bias + np.bincount(doc, w[col], n)
    weight = np.where(labels == 1, prior / max(n1, 1), (1 - prior) / max(n0, 1))
    order = np.argsort(-z, kind="stable")
    hit, called = np.cumsum((weight * labels)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (called + prior)
    last = np.append(z[order][1:] < z[order][:-1], False)  # equal ones go together
    if last.any():
        cut = int(np.argmax(np.where(last, f1, -1)))
        bias -= (z[order][cut] + z[order][cut + 1]) / 2
    # a text without a mark is not toxic
    bias = min(bias, -1.0)
    return bias, {f: float(x) for f, x in zip(names, w, strict=True) if x > 1e-3}


def sampled(docs: DataFrame, labels: DataFrame, counts: dict[int, int], id_col: str, text_col: str, sample: int) -> DataFrame:
    """key (a hash of the text), text and label of the rows that teach, equal texts of a label once. labels: the id and __label."""
    spread = 1 << 40
    passes = lambda h, n: F.pmod(h, F.lit(spread)) < F.when(F.col("__label") == 1, F.lit(min(spread, math.ceil(spread * sample / max(n.get(1, 0), 1))))).otherwise(F.lit(min(spread, math.ceil(spread * sample / max(n.get(0, 0), 1)))))
    picked = labels.filter(passes(F.xxhash64(F.lit(29), F.col(id_col)), counts))  # about 2 * sample rows of two numbers
    text = F.coalesce(F.col(text_col), F.lit(""))
    taught = docs.select(id_col, text.alias("text")).join(F.broadcast(picked), id_col).select(F.xxhash64(F.lit(31), "text").alias("key"), "text", F.col("__label"))
    taught = common.cut(taught.dropDuplicates(["key", "__label"]))
    # an id may have many texts
    sizes = {int(r["__label"]): r["n"] for r in taught.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    return taught.filter(passes(F.col("key"), sizes)).withColumnRenamed("__label", "label") if any(n > 2 * sample for n in sizes.values()) else taught.withColumnRenamed("__label", "label")


def with_features(taught: DataFrame, trigrams: dict[int, int] | None = None, marked: tuple[str, ...] = ()) -> DataFrame:
    """key, label and features of each row; of restored words if there are trigrams."""
    common.ship(taught.sparkSession)

    def run(batches):
        restorer = Restorer(CharModel(trigrams, list(marked)) if trigrams is not None else None)
        for batch in batches:
            runs, spaced = hidden_flags(*common.utf8(batch.column(1)))
            found = [sorted(features(restorer.words(t, r, s))) for t, r, s in zip(batch.column(1).to_pylist(), runs.tolist(), spaced.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(found, pa.list_(pa.string()))], names=["key", "label", "features"])

    return common.cut(taught.select("key", "text", "label").mapInArrow(run, "key long, label int, features array<string>"))


def chosen_features(rows: DataFrame, n1: int, n0: int) -> list[str]:
    """The features that mark label 1, the most frequent first; at most MOST_FEATURES."""
    counted = rows.select("label", F.explode("features").alias("f")).groupBy("f").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    marks = counted.filter((F.col("p") >= max(SUPPORT, n1 // 500)) & ((F.col("p") + 0.1) / n1 / ((F.col("q") + 0.5) / n0) >= RATIO))
    return [r.f for r in marks.orderBy(F.desc("p"), "f").limit(MOST_FEATURES).select("f").collect()]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """A model of labelled texts; labels has the id and the label."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    counts = {int(r["__label"]): r["n"] for r in known.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    if not ones or not zeros:
        share = 0.0 if not ones else 1.0
        return ToxicityModel(math.inf if share else -math.inf, {})
    taught = sampled(docs, known, counts, id_col, text_col, sample)
    clear = with_features(taught)
    drawn = sorted((r.key, r.label) for r in clear.select("key", "label").collect())
    target = np.array([label for _, label in drawn], np.int64)
    n1, n0 = int(target.sum()), int(len(target) - target.sum())
    if not n1 or not n0:
        return ToxicityModel(-math.inf, {})
    trigrams = corpus_trigrams(docs, text_col)
    marked = tuple(sorted(f[1:] for f in chosen_features(clear, n1, n0) if f[0] == "=" and f[1:].isalpha()))
    restored = with_features(taught, trigrams, marked)
    names = chosen_features(restored, n1, n0)
    place = docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(names)], "f string, col long")  # at most MOST_FEATURES
    held = restored.select("key", "label", F.explode("features").alias("f")).join(F.broadcast(place), "f").select("key", "label", "col").collect()
    at = {row: i for i, row in enumerate(drawn)}
    pairs = sorted((at[r.key, r.label], r.col) for r in held)
    doc, col = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    bias, weights = fit(target, doc, col, names, prior=ones / (ones + zeros))
    return ToxicityModel(bias, weights, trigrams, marked)


_scorers: dict[tuple, tuple] = {}


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the text if none are named) and toxicity of each row; a toxicity that docs has is replaced."""
    common.ship(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text_col, "toxicity")]
    docs = docs.select(text_col, *keep)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("toxicity", T.DoubleType())])
    places = [docs.columns.index(c) for c in keep]

    def run(batches):
        key = model.key()
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = model.scorer()
        restorer, whole, begins = _scorers[key]
        for batch in batches:
            for a, b in common.slices(batch.column(0)):
                part = batch.slice(a, b - a)
                runs, spaced = hidden_flags(*common.utf8(part.column(0)))
                found = [model.score(restorer.words(t or "", r, s), whole, begins) for t, r, s in zip(part.column(0).to_pylist(), runs.tolist(), spaced.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), pa.array(found, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out: Column = common.crc_mod(F.col("doc_id"), 5) == 0
    model = learn(docs, labels.filter(~held_out))
    scored = score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
