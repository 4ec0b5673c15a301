"""Personal data by bootstrapped contextual extraction (operator 10).

Base entities (e-mail addresses, IP addresses, card and phone numbers) are found by fixed patterns in
whole texts. They, and long quoted hexadecimal keys, are the seeds. A cue is a word with a sign behind
it, as in `token = "` or `phone:`, and what follows is an instance; so patterns and instances make a graph.
A pattern is the cue, or its sign with the shape of the instance. Each round, Spark scores patterns by the
mean score of their distinct instances, for each kind, and instances by the patterns that reach CONFIDENT
with at least LEAST distinct instances: 1 - product of (1 - score). Seeds keep score 1. After ROUNDS rounds
the patterns that still are confident find identifiers that no base pattern knows, in a last pass.

The graph is aggregated before it is shuffled, and so is each pattern's sum, so that a frequent cue
makes no task large. Accepted patterns go to the executors, at most MOST_PATTERNS, those with the most distinct
instances; what is beyond is joined with the texts' cues by shuffle, so that all of them are applied.

Positions are code points, ends exclusive. Nulls: a null text is empty and has no span. Null ids, ties and
repeated rows are judged like others. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.llm import common

#: Base kinds in their order; secret and others found by patterns come after.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
CONFIDENT, LEAST, ROUNDS, MOST_PATTERNS = 0.4, 4, 4, 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_CUE = re.compile(r"(?<![A-Za-z_-])([A-Za-z_-]++)([\x20]?[=:#]{1,3}[\x20]?[\"'(]?)([^\s\"',;()]{4,}+)")
_KEY = re.compile(r"[0-9a-f]{32,}")
_TWO_DIGITS = re.compile(r"[0-9][^0-9]*+[0-9]")
#: After so many characters of an instance, further cues are sought in the rest of it, and base entities there don't make it theirs.
LONG = 256


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, from each @, in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of all base entities, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def shape(value: str) -> str:
    """digits, hexadecimal digits, letters with digits, or nothing of these."""
    if not _DIGIT.search(value):
        return "word"
    if value.isdigit():
        return "digits"
    bare = value.lower()
    return "hex" if all(c in "0123456789abcdef" for c in bare) else "mixed"


def identifier(value: str) -> bool:
    """Whether an instance may be an identifier: six characters or more, two of them digits."""
    return len(value) >= 6 and _TWO_DIGITS.search(value) is not None


def cues(text: str):
    """Start, end, value, cue pattern and shape pattern of each instance; a cue's word and an instance are whole runs, however long."""
    if "=" not in text and ":" not in text and "#" not in text:
        return
    at = 0
    while m := _CUE.search(text, at):
        at = min(m.end(), m.start(3) + LONG)
        value, word = m[3].rstrip(".:!?"), m[1].lstrip("-").lower()
        if value and word:
            sign = re.sub(r"[\x20\"'(]", "", m[2])
            word = word if len(word) <= 64 else hashlib.blake2b(word.encode(), digest_size=12).hexdigest()
            yield m.start(3), m.start(3) + len(value), value, f"{word}{sign}", f"{sign}|{shape(value)}"


class Met:
    """Which base entities lie in ranges that are asked for in the order of their starts; linear over both."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.own = [(kind, [s[1:] for s in spans if s[0] == kind]) for kind in BASE]
        self.at = [0] * len(BASE)

    def kind(self, start: int, end: int) -> str | None:
        """The first kind of an entity that the range meets; of a long range only its first LONG characters count."""
        end = min(end, start + LONG)
        for i, (kind, own) in enumerate(self.own):
            at = self.at[i]
            while at < len(own) and own[at][1] <= start:
                at += 1
            self.at[i] = at
            if at < len(own) and own[at][0] < end:
                return kind
        return None


def graph(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """pattern, instance and kind (null: no seed) of all cues; each once."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for a, b in common.slices(batch.column(0), 8 << 20):
                edges = set()
                for text in batch.column(0).slice(a, b - a).to_pylist():
                    if not text:
                        continue
                    met = None
                    for start, end, value, cue, shaped in cues(text):
                        met = Met(base_spans(text)) if met is None else met
                        kind = met.kind(start, end) or ("secret" if _KEY.fullmatch(value) else None)
                        name = hashlib.blake2b(value.encode(), digest_size=12).hexdigest()
                        edges.add((cue, name, kind, identifier(value)))
                        edges.add((shaped, name, kind, identifier(value)))
                columns = list(zip(*sorted(edges, key=str), strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.bool_())], names=["pattern", "instance", "kind", "able"])

    return docs.select(text_col).mapInArrow(run, "pattern string, instance string, kind string, able boolean").groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.bool_or("able").alias("able"))


def confident_patterns(edges: DataFrame, confident: float = CONFIDENT, least: int = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind, score and support of the patterns that stay confident."""
    edges = common.cut(edges)
    seeds = edges.filter("kind IS NOT NULL").groupBy("instance", F.col("kind")).agg(F.lit(1.0).alias("score"))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    scores, patterns = seeds, None
    for _ in range(rounds):
        sums = edges.select("pattern", "instance").join(scores.select("instance", "kind", "score"), "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("support"))
        patterns = sums.join(sizes, "pattern").select("pattern", "kind", "support", (F.col("sum") / (F.col("size") + 1)).alias("score")).filter((F.col("score") >= confident) & (F.col("support") >= least))
        patterns = common.cut(patterns)
        found = edges.filter("able AND kind IS NULL").select("pattern", "instance").join(common.small(patterns), "pattern").groupBy("instance", "kind").agg((1 - F.product(1 - F.col("score"))).alias("score"))
        scores = common.cut(seeds.unionByName(found))
    return patterns


class Patterns(dict):
    """Accepted patterns, and the kind that each finds. rest: pattern and kind of those beyond MOST_PATTERNS, a table, or None."""

    rest: DataFrame | None = None


def learn(docs: DataFrame, text_col: str = "text") -> Patterns:
    """All accepted patterns; the kind of each is that of the highest score."""
    found = confident_patterns(graph(docs, text_col))
    best = common.cut(found.groupBy("pattern").agg(F.max(F.struct("score", "kind")).alias("best"), F.max("support").alias("support")).select("pattern", "best.kind", "support"))
    many = best.count() > MOST_PATTERNS
    first = common.cut(best.orderBy(F.desc("support"), "pattern").limit(MOST_PATTERNS)) if many else best
    out = Patterns((r.pattern, r.kind) for r in first.collect())
    if many:
        out.rest = common.cut(best.join(F.broadcast(first.select("pattern")), "pattern", "left_anti").select("pattern", "kind"))
    return out


_KEY_COL, _MORE = "__pii_key", "__pii_more"


def with_rest(docs: DataFrame, patterns: dict[str, str], text_col: str) -> DataFrame:
    """docs and, if some patterns are not broadcast, a map of those that the row's text has, with their kinds. Equal texts are looked up once."""
    rest = getattr(patterns, "rest", None)
    if rest is None:
        return docs
    known = dict(patterns)

    def run(batches):
        for batch in batches:
            for a, b in common.slices(batch.column(1), 8 << 20):
                part = batch.slice(a, b - a)
                names = sorted({(key, p) for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for _, _, value, *both in cues(text or "") if identifier(value) for p in both if p not in known})
                columns = list(zip(*names, strict=True)) or [[]] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=[_KEY_COL, "pattern"])

    keyed = docs.withColumn(_KEY_COL, F.sha2(F.col(text_col).cast("binary"), 256))
    names = keyed.select(_KEY_COL, text_col).mapInArrow(run, f"{_KEY_COL} string, pattern string").distinct()
    held = names.join(rest, "pattern").groupBy(_KEY_COL).agg(F.map_from_entries(F.collect_list(F.struct("pattern", "kind"))).alias(_MORE))
    return keyed.join(held, _KEY_COL, "left").select(*docs.columns, _MORE)


def rest_of(batch: pa.RecordBatch, has_rest: bool) -> list[dict[str, str]]:
    """The patterns that with_rest added to each row."""
    return [dict(m or ()) for m in batch.column(batch.num_columns - 1).to_pylist()] if has_rest else [{}] * batch.num_rows


def all_spans(text: str, patterns: dict[str, str], more: dict[str, str] | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and those that patterns add, or more of them; each by kind, then start."""
    spans, added, more = base_spans(text), [], more or {}
    if patterns:
        met = Met(spans)
        for start, end, value, cue, shaped in cues(text):
            kind = patterns.get(cue) or more.get(cue) or patterns.get(shaped) or more.get(shaped)
            if kind and identifier(value) and not met.kind(start, end):
                added.append((kind, start, end))
    return spans, sorted(added, key=lambda s: (KINDS.index(s[0]), s[1]))


def extract(docs: DataFrame, patterns: dict[str, str], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the text if none are named), base and added: arrays of (kind, start, end). Columns of docs with these names are replaced."""
    common.ship(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text_col, "base", "added")]
    docs = docs.select(text_col, *keep)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("base", span), T.StructField("added", span)])
    places = [docs.columns.index(c) for c in keep]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    known, has_rest = dict(patterns), getattr(patterns, "rest", None) is not None

    def run(batches):
        for batch in batches:
            found = [all_spans(t or "", known, more) for t, more in zip(batch.column(0).to_pylist(), rest_of(batch, has_rest), strict=True)]
            as_rows = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f[i]] for f in found], kind) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *as_rows], names=schema.names)

    return with_rest(docs, patterns, text_col).mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, of overlapping ones all together, as its kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, patterns: dict[str, str], text_col: str = "text") -> DataFrame:
    """docs with all spans masked in the text; a null text stays null."""
    common.ship(docs.sparkSession)
    at, names = docs.columns.index(text_col), docs.columns
    known, has_rest = dict(patterns), getattr(patterns, "rest", None) is not None

    def run(batches):
        for batch in batches:
            texts = [t and masked(t, [s for some in all_spans(t, known, more) for s in some]) for t, more in zip(batch.column(at).to_pylist(), rest_of(batch, has_rest), strict=True)]
            columns = list(batch.columns)[: len(names)]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return with_rest(docs, patterns, text_col).mapInArrow(run, docs.schema)


def op10_bootstrapped_pii(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = extract(docs, learn(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    # all spans: by kind in the order of KINDS, then start
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(order[s["kind"]].alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [number(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"))
