"""Language identification by cross-parsing entropy (operator 6).

For each language a suffix automaton of sample text is built. A text is parsed greedily into the longest
phrases that occur in the sample: the automaton walks as long as it can, then a new phrase begins. The
cost of a language is phrases * log2(sample length) / symbols, an estimate of the cross entropy; the
language with the least cost wins, ties by name. score is how far the second is behind: 1 - best / second.

Symbols are bytes of UTF-8, letters in lower case, each run of other ASCII characters one space. Texts are
parsed in blocks of at most BLOCK symbols, so that all blocks of a batch walk in step over arrays; a
border costs at most one phrase, in each language alike.

The samples are bounded: of each language SAMPLE_DOCS documents by hash of their id and text, SAMPLE_CHARS
characters from a place that the hash chooses; with many languages fewer of each, so that all have at most
SAMPLE_ALL, and of more languages than MOST_LANGUAGES the most frequent. Everything else covers whole texts.
Only the samples leave the executors and go to them again; each worker builds the automata once.

Nulls: a null text, or one without letters, is `und` with score 0. Documents with a null language don't
teach. Without any sample all is `und`. Null and equal ids teach and are judged like others; rows with equal
ids and texts teach once. Texts of any length are judged whole. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.llm import common

#: Documents of a language that teach, and characters of each; documents of all languages together, and languages.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_ALL, MOST_LANGUAGES = 64, 400, 1_024, 500
BLOCK = 1024

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def fold(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, and where each text's begin."""
    out = _FOLD[raw]
    if len(raw) > 1:  # capital letters of Latin-1: 0xC3 0x80 to 0x9E
        capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:][capital] += 32
    keep = np.ones(len(out), bool)
    blank = out == 32
    keep[1:] = ~(blank[1:] & blank[:-1])
    inner = offsets[:-1]
    keep[inner[inner < len(out)]] = True
    places = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=places[1:])
    return out[keep], places[offsets]


class Automaton:
    """The suffix automaton of a sample as a table of steps that begin a new phrase where they must.

    steps[state + symbol] is the next state, times the size of the alphabet; its complement if the symbol
    begins a new phrase.
    """

    def __init__(self, sample: bytes):
        symbols = sorted(set(sample))
        self.code = np.zeros(256, np.int32)  # 0: a symbol that the sample lacks
        for i, s in enumerate(symbols, 1):
            self.code[s] = i
        width = len(symbols) + 1
        moves, link, length, last = [{}], [-1], [0], 0
        for c in self.code[np.frombuffer(sample, np.uint8)].tolist():
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        start = np.zeros(width, np.int32)
        for c, t in moves[0].items():
            start[c] = t * width
        # the last state is that after a symbol which the sample lacks: such a symbol is a phrase of its own
        start[0] = len(moves) * width
        self.steps = np.tile(~start, len(moves) + 1)
        rows = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        columns = np.fromiter((c for m in moves for c in m), np.int64, len(rows))
        self.steps[rows * width + columns] = np.fromiter((t for m in moves for t in m.values()), np.int64, len(rows)) * width

    def phrases(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each block. Blocks must come longest first."""
        codes = self.code[symbols]
        state = np.zeros(len(starts), np.int32)
        found = np.ones(len(starts), np.int32)
        found[lengths == 0] = 0
        falling = -lengths
        for i in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(falling, -i, "left"))  # blocks longer than i
            s = state[:n]
            step = self.steps.take(s + codes.take(starts[:n] + i))
            new = step >> 31
            np.bitwise_xor(step, new, out=s)
            found[:n] -= new
        if len(starts):  # a block that begins outside the sample has counted its first phrase twice
            some = lengths > 0
            found[some] -= self.steps[codes[starts[some]]] < 0
        return found


def blocks(offsets: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and length of each block, longest first."""
    lengths = np.diff(offsets)
    count = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), count)
    within = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][text] + within * size
    length = np.minimum(size, offsets[1:][text] - start)
    order = np.argsort(-length, kind="stable")
    return text[order], start[order], length[order]


_automata: dict[tuple, list] = {}


def automata(samples: tuple[tuple[str, bytes], ...]) -> list:
    if samples not in _automata:
        _automata.clear()
        _automata[samples] = [(name, Automaton(text), math.log2(max(len(text), 2))) for name, text in samples]
    return _automata[samples]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def identify(column: pa.Array, samples: tuple[tuple[str, bytes], ...]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    raw, offsets = common.utf8(column)
    symbols, bounds = fold(raw, offsets)
    text, start, length = blocks(bounds)
    n = len(column)
    models = automata(samples)
    costs = np.zeros((max(len(models), 1), n))
    size = np.maximum(np.diff(bounds), 1)
    for i, (_, automaton, bits) in enumerate(models):
        costs[i] = np.bincount(text, automaton.phrases(symbols, start, length), n) * bits / size
    letters = np.concatenate([[0], np.cumsum((symbols > 96) & (symbols < 123))])
    plain = letters[bounds[1:]] > letters[bounds[:-1]]
    known = [bool(models) and (bool(p) or has_letter(column[i].as_py())) for i, p in enumerate(plain)]
    best = costs.argmin(0)
    first = costs[best, np.arange(n)]
    costs[best, np.arange(n)] = np.inf
    second = costs.min(0)
    score = np.where(np.isinf(second), 1.0, 1 - first / np.where(second > 0, second, 1))
    names = [models[b][0] if k else "und" for b, k in zip(best, known, strict=True)]
    return names, np.where(known, np.clip(score, 0, 1), 0.0)


def draw_samples(docs: DataFrame, teaches: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", n_docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[tuple[str, bytes], ...]:
    """Bounded sample text of each language, folded."""
    able = docs.filter(teaches & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(17), F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    counts = {r.lang: r.n for r in able.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return ()
    n_docs = max(1, min(n_docs, SAMPLE_ALL // len(counts)))
    spread = 1 << 40
    limits = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(spread, math.ceil(spread * 4 * n_docs / n))))])
    picked = able.filter(F.pmod("h", F.lit(spread)) < F.try_element_at(limits, F.col("lang")))
    room = F.greatest(F.lit(1), F.char_length("text") - chars)
    part = F.substring("text", (F.pmod(F.shiftright("h", 7), room) + 1).cast("int"), F.lit(chars))
    # about 4 * n_docs passages of each language, whatever the number of rows
    rows = picked.select("lang", "h", part.alias("part")).distinct().collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h, r.part)):
        if has_letter(r.part) and r.part not in (own := texts.setdefault(r.lang, [])) and len(own) < n_docs:
            own.append(r.part)
    out = []
    for lang, parts in sorted(texts.items()):
        raw = np.frombuffer(" ".join(parts).encode(), np.uint8)
        out.append((lang, fold(raw, np.array([0, len(raw)]))[0].tobytes()))
    return tuple(out)


def predict(docs: DataFrame, samples: tuple[tuple[str, bytes], ...], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """docs with the predicted language and its score; columns of docs with these names are replaced."""
    docs = docs.drop(*names)
    common.ship(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for a, b in common.slices(batch.column(at)):
                part = batch.slice(a, b - a)
                found, score = identify(part.column(at), samples)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = common.crc_mod(F.col("doc_id"), 3) == 1
    samples = draw_samples(docs, ~held_out)
    return predict(docs.select("doc_id", "text"), samples).select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
