"""Each operator against a plain version of it, an exact round trip, or held-out accuracy."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from statuta.llm import common, fingerprints, langid, mixing, ngram_join, packing, pii, quality, sharding, tokens, toxicity, url_filter
from tests.conftest import SF, SF01

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(i, n):
    import zlib

    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def docs(spark):
    return common.read(spark, SF01, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


# 1


def plain_best_fit(lengths, sizes, opening):
    bins, left = [], sum(lengths)
    for n in lengths:
        fits = [(cap - used, i) for i, (cap, used) in enumerate(bins) if cap - used >= n]
        if fits:
            room = min(f[0] for f in fits)
            i = next(i for r, i in fits if r == room)
            bins[i][1] += n
        else:
            bins.append([opening(n, left), n])
        left -= n
    return sorted(used for _, used in bins)


def test_best_fit_is_the_plain_one():
    rng = random.Random(3)
    for _ in range(50):
        sizes = tuple(sorted(rng.sample(range(8, 200), 4)))
        lengths = sorted((rng.randint(1, sizes[-1]) for _ in range(rng.randint(1, 80))), reverse=True)
        opening = lambda n, left: next(c for c in sizes if c >= n)  # noqa: E731, B023
        _, offsets, filled = packing.best_fit(lengths, sizes, opening)
        # of bins with equal room another may be taken, which leaves the same amounts of room and as many bins
        assert sum(filled) == sum(lengths) and len(filled) == len(plain_best_fit(lengths, sizes, opening))
        one = sizes[-1:]
        largest = lambda n, left: one[0]  # noqa: E731, B023
        assert sorted(packing.best_fit(lengths, one, largest)[2]) == plain_best_fit(lengths, one, largest)


def test_packing_round_trip(spark, texts):
    out = __spark_entry__.queries()["op1_best_fit_packing"](spark, SF01).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append((r.piece_start, r.length))
        if r.length:
            bins[r.bin_id, r.bin_size].append((r.bin_offset, r.length))
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: len(WORD.findall(t)) for i, t in texts.items()}
    for (_, size), held in bins.items():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= size and size == next(c for c in packing.SIZES if c >= end)  # no smaller size holds it


def test_joint_choice_is_no_dearer_than_one_size():
    rng = random.Random(5)
    lengths = sorted((min(8192, int(rng.lognormvariate(6, 1)) + 1) for _ in range(800)), reverse=True)
    cost = lambda fitted: sum(map(packing.sequence_cost, fitted))
    joint = cost(packing.pack_lengths(lengths)[2])
    for size in packing.SIZES:
        # one size for all: longer texts are cut by it
        cut = sorted((min(size, n - at) for n in lengths for at in range(0, n, size)), reverse=True)
        alone = cost([size] * len(packing.best_fit(cut, (size,), lambda n, left, s=size: s)[2]))
        again = cost(packing.pack_lengths(cut)[2])
        assert again <= alone and (size < packing.SIZES[-1] or joint <= alone)


# 2


def test_fingerprints_match_plain_winnowing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(n))) for i, n in enumerate([0, 1, 4, 5, 6, 19, 20, 21, 60, 400])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [((x >> 32), 4294967295 - (x & 4294967295)) for x in r.f] for r in df.select("doc_id", fingerprints.winnow("text").alias("f")).collect()}
    hashes = {r.w: r.h for r in spark.createDataFrame([(c,) for c in "abcdef"], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    grams = {(i, k): tuple(hashes[w] for w in t.split()[k : k + fingerprints.K]) for i, t in rows for k in range(max(0, len(t.split()) - fingerprints.K + 1))}
    distinct = sorted(set(grams.values()))
    made = spark.createDataFrame(distinct, ", ".join(f"c{j} long" for j in range(fingerprints.K)))
    value = {tuple(r[:-1]): r.h & 2147483647 for r in made.select("*", F.xxhash64(*made.columns).alias("h")).collect()}
    for i, t in rows:
        n = len(t.split())
        if n < fingerprints.K:
            assert len(got[i]) == (n > 0)
            continue
        g = [(value[grams[i, k]], k) for k in range(n - fingerprints.K + 1)]
        want = []
        for at in range(max(1, len(g) - fingerprints.W + 1)):
            least = min(h for h, _ in g[at : at + fingerprints.W])
            pick = max((h, k) for h, k in g[at : at + fingerprints.W] if h == least)
            if pick not in want:
                want.append(pick)
        assert got[i] == want


def test_windows_of_any_length(spark):
    rng = random.Random(6)
    rows = [[rng.randrange(50) for _ in range(n)] for n in (17, 40, 90)]
    df = spark.createDataFrame([(r,) for r in rows], "g array<long>")
    for w in (1, 2, 3, 5, 7, 8, 13, 16, 17):
        got = [r[0] for r in df.select(F.expr(fingerprints._least(w))).collect()]
        assert got == [list(dict.fromkeys(min(g[i : i + w]) for i in range(len(g) - w + 1))) for g in rows]


def test_edited_texts(spark, texts):
    out = {r.doc_id: r for r in __spark_entry__.queries()["op2_winnowing"](spark, SF01).collect()}
    order = sorted(texts, reverse=True)
    for i, nxt in zip(order, [*order[1:], order[0]], strict=True):
        n = len(texts[i])
        edited = texts[i][: n - n // 3] + texts[nxt][: n // 3]
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[i].n_chars == n
    same = defaultdict(set)
    for i, t in texts.items():
        same[t].add(out[i].fingerprint)
    assert all(len(f) == 1 for f in same.values())
    assert np.mean([r.near_edited for r in out.values()]) > 0.3 > 0.1 > np.mean([r.near_next for r in out.values()])


# 3


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = rest / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > 2 * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
            free.remove(s)
    return target


def test_mixing(spark, docs, texts):
    run = lambda: {r.doc_id: r for r in __spark_entry__.queries()["op3_source_mixing"](spark, SF01).collect()}
    out = run()
    assert {i: r.taken for i, r in run().items()} == {i: r.taken for i, r in out.items()}
    sizes, taken = Counter(), Counter()
    for r in out.values():
        assert r.size == len(WORD.findall(texts[r.doc_id])) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = plain_targets(dict(sizes))
    for r in out.values():
        assert abs(r.target - want[r.source]) < 1e-6 * want[r.source] + 1e-6
    largest = defaultdict(int)
    for r in out.values():
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in want)


def test_targets_with_full_sources(spark):
    rng = random.Random(8)
    for _ in range(5):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 500, 100_000]) for i in range(9)} | {None: 70}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        want = plain_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_rounding_keeps_expectations(spark):
    rows = spark.createDataFrame([(i, "w " * (1 + i % 7), "a" if i % 3 else "b") for i in range(400)], "doc_id long, text string, source string")
    copies, rates = defaultdict(list), {}
    for seed in range(6):
        taken, target = Counter(), {}
        for r in mixing.mix(rows, common.word_count(F.col("text")), seed=seed, chunk=16).collect():
            rates[r.source] = r.target / r.source_size
            assert r.copies in (int(rates[r.source]), int(rates[r.source]) + 1)
            copies[r.source, r.size].append(r.copies)
            taken[r.source] += r.copies * r.size
            target[r.source] = r.target
        assert all(abs(taken[s] - target[s]) <= 4 for s in target)  # the last document has 7 words at most
    # each document is taken as often as its source's rate, long ones and short ones alike
    assert all(abs(np.mean(c) - rates[s]) < 0.2 for (s, _), c in copies.items())


# 4


def test_url_rules_joined_equal_inline(spark):
    urls = ["http://a.example.net/en/1", "https://example.net/en", "http://x.NET/", "http://x.net", "http://x.org/fr/z?q", "http://www.cheap-pills.example.com/en/", "http://cheap-pillsx.com/", "nothing", None, "http://example.com/de/", "http://fr.example.com/de/?a#b", "ftp://u@net/x://y", "http://net/a", "http://éx.net/é", "http://a.org/b/setup.EXE", "http://a.org/b/setup.exe", "http://a.org/wp-login.php", "http://a.org/xwp-login", "http://a.org/" + "a-" * 50_000 + "casino"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, *urls])], "page_id long, url string")
    rules = [*url_filter.LISTED, *url_filter.PATTERNS, url_filter.Rule("any", "block", "*/x*", 0)]
    rows = lambda n: sorted(map(tuple, url_filter.judge(df, "url", rules, inline=n).collect()), key=str)
    assert rows(1000) == rows(0)


def test_an_index_of_many_rules(spark):
    """Thousands of rules, joined by their rarest tokens, against each rule as a plain regular expression."""
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    rules = {f"^{rng.choice(words)}-{rng.choice(words)}^" for _ in range(4000)} | {f"||{rng.choice(words)}.org/{rng.choice(words)}" for _ in range(1500)} | {f"/{rng.choice(words)}*{rng.choice(words)}^" for _ in range(600)}
    rules = [url_filter.Rule(p, "block", p, i % 3) for i, p in enumerate(sorted(rules))]
    urls = [f"http://{rng.choice(words)}.{rng.choice(words)}.org/{rng.choice(words)}-{rng.choice(words)}/{rng.choice(words)}" for _ in range(150)]
    assert len(rules) > 4000
    out = {r.url: (r.matched_rule, r.verdict) for r in url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), "url", rules, inline=100).collect()}
    compiled = [(re.compile(url_filter.to_regex(r.pattern)), r) for r in rules]
    for u in urls:
        hits = [r for c, r in compiled if c.search(u.partition("://")[2])]
        best = min(hits, key=lambda r: (-r.tier, -len(r.pattern), r.name), default=None)
        assert out[u] == ((best.name, "block") if best else (None, "allow"))
    assert sum(v[0] is not None for v in out.values()) > 50


def test_urls_against_sql(spark):
    got = sorted(map(tuple, __spark_entry__.queries()["op4_url_filter"](spark, SF01).collect()))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF01}/pages.parquet'")
    assert got == sorted(con.sql(url_filter.OP4_SQL).fetchall())


# 5


def test_held_out_toxicity(spark):
    labels = {r.doc_id: r.toxic for r in common.read(spark, SF01.replace("0.01", "0.1"), "labels").collect()}
    out = __spark_entry__.queries()["op5_toxicity"](spark, SF01.replace("0.01", "0.1")).collect()
    held = [(labels[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) for r in out)
    hit = sum(a == b == 1 for a, b in held)
    assert 2 * hit / (sum(a for a, _ in held) + sum(b for _, b in held)) > 0.9


def hide(word, rng):
    """A word in leetspeak, spaced or with a letter repeated."""
    way = rng.randrange(3)
    if way == 0:
        leet = {"o": "0", "i": "1", "e": "3", "a": "4", "s": "5", "t": "7", "l": "1"}
        return "".join(leet.get(c, c) for c in word)
    if way == 1:
        return rng.choice(" .-").join(word)
    k = rng.randrange(1, len(word))
    return word[:k] + word[k] * 4 + word[k + 1 :]


def test_decoding_raises_the_recall_of_hidden_words(spark):
    """Held-out toxic texts whose marks are hidden: the decoder finds most of them, none are found without it."""
    sf = SF01.replace("0.01", "0.1")
    rows = common.read(spark, sf, "documents").select("doc_id", "text")
    labels = common.read(spark, sf, "labels").select("doc_id", "toxic")
    held = common.crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.learn(rows, labels.filter(~held))
    restorer, whole, begins = model.scorer()
    raw = toxicity.Restorer(None)
    marks = {w for w in whole if w.isalpha() and len(w) >= 4}
    rng, clear, found, without = random.Random(3), 0, 0, 0
    for r in rows.join(labels.filter("toxic = 1").filter(held), "doc_id").orderBy("doc_id").collect():
        if model.score(restorer.words(r.text, True, True), whole, begins) < 0.5:
            continue
        hidden = re.sub(r"[^\W\d_]+", lambda m: hide(m[0].lower(), rng) if m[0].lower() in marks or any(m[0].lower()[:n] in known for n, known in begins.items()) else m[0], r.text)
        clear += 1
        found += model.score(restorer.words(hidden, True, True), whole, begins) >= 0.5
        without += model.score(raw.words(hidden, True, True), whole, begins) >= 0.5
    print("hidden toxic texts:", clear, "found with the decoder:", found, "without:", without)
    assert clear > 50 and found >= 0.8 * clear and found >= without + 0.3 * clear


def test_long_tokens_are_decoded_in_linear_time(spark, docs):
    import time

    model = toxicity.CharModel(toxicity.corpus_trigrams(docs), ["idiot"])
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789+/"
    rng = random.Random(1)
    token = "".join(rng.choices(alphabet, k=5_000_000))
    began = time.perf_counter()
    toxicity.Restorer(model).words(token, True, False)
    assert time.perf_counter() - began < 20


def test_hidden_words_are_restored(spark, docs):
    model = toxicity.CharModel(toxicity.corpus_trigrams(docs), "loser idiot pathetic scum worthless moron trash clown disgusting stupid".split())
    r = toxicity.Restorer(model)
    for hidden, word in (("1d10t", "idiot"), ("l0ser", "loser"), ("p@th3t1c", "pathetic"), ("$cum", "scum"), ("stuuuupid", "stupid"), ("m o r o n", "moron"), ("c-l-o-w-n", "clown"), ("t.r.a.s.h", "trash")):
        assert word in r.words(f"you are {hidden} and more", True, True), hidden
    plain = "The and attion to thanedble the anea"
    assert r.restored(plain) == plain.lower()


def test_decoding_is_the_likeliest_path(spark, docs):
    import itertools

    model = toxicity.CharModel(toxicity.corpus_trigrams(docs), ["idiot", "loser"])

    def total(path):
        codes = [0, 0, *map(toxicity.char_class, path), 0]
        return sum(model.log[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))

    for token in ("1d10t", "l0$er", "!1aaa1", "7h3", "1!1x!1", "aaa111a!!", "st1ff", "1", "ab", "i.d.!.o.t"):
        paths = ["".join(p) for p in itertools.product(*toxicity.lattice(token))]
        assert abs(total(toxicity.decode(token, model)) - max(map(total, paths))) < 1e-9


# 6


def test_phrases_are_longest_matches():
    rng = random.Random(2)
    sample = "".join(rng.choice("abc ") for _ in range(300))
    model = langid.Automaton(sample.encode())
    for n in (1, 2, 17, 900, 1024):
        text = "".join(rng.choice("abcd ") for _ in range(n))
        i = count = 0
        while i < n:
            k = 1
            while i + k < n + 1 and text[i : i + k] in sample:
                k += 1
            i += max(1, k - 1)
            count += 1
        symbols = np.frombuffer(text.encode(), np.uint8)
        got = model.phrases(symbols, np.array([0]), np.array([n]))[0]
        assert got == count  # a symbol that the sample lacks is a phrase of its own


def test_held_out_language(spark, docs):
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = __spark_entry__.queries()["op6_language_id"](spark, SF01).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) for r in out)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


# 7


def plain_join(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t)
        sets[i] = frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids, links = sorted(sets), Counter()
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverse = defaultdict(list)
    for i in ids:
        for g in sets[i]:
            inverse[g].append(i)
    both = Counter()
    for held in inverse.values():
        for k, a in enumerate(held):
            for b in held[k + 1 :]:
                both[a, b] += 1
    for (a, b), n in both.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (find(i), links[i]) for i in ids}


def test_join_against_all_pairs(spark, texts):
    out = {r.doc_id: (r.class_id, r.n_links) for r in __spark_entry__.queries()["op7_ngram_jaccard_join"](spark, SF01).collect()}
    assert out == plain_join(texts)


def test_join_of_a_large_group(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    made = {}
    for i in range(700):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(120)] = f"x{rng.randrange(50)}"
        made[i] = " ".join(words[: rng.choice([120, 120, 118, 97])])
    made |= {1000 + i: " ".join(f"y{rng.randrange(9999)}" for _ in range(30)) for i in range(50)}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(df).collect()}
    want = plain_join(made)
    lost = sum(abs(got[i][1] - want[i][1]) for i in made)
    assert lost <= 0.003 * sum(n for _, n in want.values())
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}


def test_bands_reach_the_recall():
    b, r = ngram_join.choose_bands(0.8)
    assert 1 - (1 - 0.8**r) ** b >= ngram_join.RECALL


# 8


def test_store(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target=400_000, arrival_rows=40)
    for k in range(4):
        store.append(docs.filter(F.pmod("doc_id", F.lit(4)) == k))
    before = store.runs()
    assert store.head()["version"] == 4 and len(before) == 4 and store.compact_all() >= 1
    after = store.runs()
    assert sum(r["files"] for r in after) < sum(r["files"] for r in before)
    same = lambda df: sorted(map(tuple, df.select("doc_id", "text").collect()))
    assert same(store.read()) == same(docs) == same(store.read(4))
    assert store.vacuum() > 0 and same(store.read()) == same(docs)
    other = sharding.ShardStore(spark, str(tmp_path / "store"))
    head = store.head()
    assert not other._publish(head | {"open": []})  # that version is taken
    assert other._commit(None, {before[0]["path"]}) is None  # removed by the compaction
    assert store.head() == head


def test_tiers_are_the_plain_ones(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target=1000, fanout=4)
    run = lambda i, files, mean, level=0: {"path": f"data/{i}", "files": files, "bytes": files * mean, "level": level}
    assert [store.tier(run(0, 3, n)) for n in (1000, 999, 250, 249, 62, 1)] == [0, 1, 1, 2, 3, 5]
    assert store.tier(run(0, 1, 500, 1)) == 0 and store.tier(run(0, 1, 499, 1)) == 1 and store.tier(run(0, 5, 400, 2)) == 0
    for r in (run(0, 1, 300), run(1, 2, 280), run(2, 3, 100), run(3, 1, 1200), run(4, 1, 90), run(5, 2, 20)):
        store._commit(r, set())
    assert [[r["path"] for r in runs] for runs in store.plan()] == [["data/2", "data/4"]]  # the others have fewer than four shards or are full


def test_full_runs_move_to_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "LIST", 3)
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target=10)
    for i in range(9):
        store._commit({"path": f"data/{i}", "files": 1, "bytes": 20 if i % 4 else 1, "level": 0}, set())
    head = store.head()
    assert len(head["lists"]) == 1 and len(head["full"]) == 2 and len(head["open"]) == 3
    assert sorted(r["path"] for r in store.runs()) == [f"data/{i}" for i in range(9)] and len(store.runs(3)) == 3


def test_compaction_query(spark, texts):
    out = __spark_entry__.queries()["op8_compaction"](spark, SF01).collect()
    assert {r.doc_id: r.text_sha256 for r in out} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


# 9


def test_base_counts(spark, texts):
    out = {r.doc_id: r for r in __spark_entry__.queries()["op9_quality_rules"](spark, SF01).collect()}
    for i, t in texts.items():
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        number, cover = Counter(windows), set()
        for k, x in enumerate(windows):
            if number[x] > 1:
                cover.update((k, k + 1, k + 2))
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_outliers_agree_with_quality_labels(spark):
    labels = {r.doc_id: r.quality for r in common.read(spark, SF01, "labels").collect()}
    out = [(labels[r.doc_id], r.kept) for r in __spark_entry__.queries()["op9_quality_rules"](spark, SF01).collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([kept for good, kept in out if good]) > 0.98
    assert np.mean([kept for good, kept in out if not good]) < 0.2


def test_scatter_ignores_outliers(spark):
    rng = np.random.default_rng(1)
    clean = rng.normal(0.5, 0.05, (900, 5))
    wild = rng.normal(3, 0.5, (100, 5))
    rows = [(i, "g", True, *map(float, v)) for i, v in enumerate(np.vstack([clean, wild]))]
    stats = spark.createDataFrame(rows, "doc_id long, grp0 string, judged boolean, " + ", ".join(f"{d} double" for d in quality.DIMENSIONS))
    out = {r.doc_id: r.outlier for r in quality.outliers(stats, ["grp0"], floor=(0.001,) * 5).collect()}
    assert all(out[i] for i in range(900, 1000)) and sum(out[i] for i in range(900)) <= 2


def plain_outliers(vectors, groups):
    """Distances by the same estimates, one group after the other."""
    k, floor = len(quality.DIMENSIONS), np.diag(np.square(quality.FLOOR))
    every = np.array(vectors)
    members = defaultdict(list)
    for i, g in enumerate(groups):
        members[g].append(i)
    members = {g: every[m] for g, m in members.items()} | {0: every}
    rank = lambda x, q: np.sort(x)[max(0, int(np.ceil(q * len(x))) - 1)]

    def blended(n, mean, shape, factor):
        out = {}
        for g in members:
            own = 1.0 if g == 0 else n[g] / (n[g] + quality.PRIOR)
            out[g] = own * mean[g] + (1 - own) * mean[0], np.linalg.inv((own * shape[g] + (1 - own) * shape[0]) * factor + floor)
        return out

    middle = {g: np.array([rank(x, 0.5) for x in m.T]) for g, m in members.items()}
    mad = {g: np.diag([np.square(1.4826 * rank(np.abs(x - c), 0.5)) for x, c in zip(m.T, middle[g], strict=True)]) for g, m in members.items()}
    estimate, before = blended({g: len(m) for g, m in members.items()}, middle, mad, 1.0), None
    distance = lambda g, m: np.einsum("ij,jk,ik->i", m - estimate[g][0], estimate[g][1], m - estimate[g][0])
    for step in range(quality.STEPS):
        far = {g: distance(g, m) for g, m in members.items()}
        bound = {g: rank(d, quality.H) for g, d in far.items()}
        last = step == quality.STEPS - 1 or before is not None and all(bound[g] >= (1 - quality.SETTLED) * before[g] for g in bound)
        inner = {g: m[far[g] <= bound[g]] for g, m in members.items()}
        estimate = blended({g: len(m) for g, m in inner.items()}, {g: m.mean(0) for g, m in inner.items()}, {g: (m.T @ m) / len(m) - np.outer(m.mean(0), m.mean(0)) for g, m in inner.items()}, quality.consistency(quality.H, k) if last else 1.0)
        if last:
            break
        before = bound
    return [float(distance(g, np.array([v]))[0]) for v, g in zip(vectors, groups, strict=True)]


def test_distances_are_the_plain_ones(spark, docs):
    rows = [r for r in quality.judge(docs).collect() if not r.base_failed]
    want = plain_outliers([[r[d] for d in quality.DIMENSIONS] for r in rows], [(r.lang, r.source) for r in rows])
    assert len({(r.lang, r.source) for r in rows}) > 20
    assert np.allclose([r.distance for r in rows], want, rtol=1e-6, atol=1e-8)
    assert [r.kept for r in rows] == [d <= quality.CUTOFF for d in want]


# 10


def plain_spans(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_are_the_patterns(texts):
    rng = random.Random(9)
    odd = ["".join(rng.choice("ab1.2@+-() 40é\n") for _ in range(60)) for _ in range(4000)]
    for t in [*texts.values(), *odd, "4111 1111 1111 1111", "a@b@c.de.f@g.h", "1.2.3.4.5.6.7.8", "+1 (017) 555-7713"]:
        assert pii.base_spans(t) == plain_spans(t), t


def test_patterns_are_bootstrapped(spark):
    rng = random.Random(6)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'and so on token = "{hexa(40)}" it goes') for i in range(30)] + [(100 + i, f"with password={'1a' + hexa(16)} there") for i in range(20)] + [(200 + i, f"note: the thing {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    patterns = pii.learn(df)
    assert patterns.get("token=") == "secret" and patterns.get("password=") == "secret" and "note:" not in patterns
    assert pii.extract(df, patterns).filter("doc_id BETWEEN 100 AND 199 AND size(added) = 1").count() == 20
    assert pii.mask(df, patterns).filter("doc_id = 100").first().text == "with password=[SECRET] there"


# tokens


def test_words_and_shingles():
    rng = random.Random(7)
    batch = ["".join(rng.choice("ab é\n\t漢") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    column = pa.array([*batch, None])
    raw, offsets = common.utf8(column)
    hashes, bounds = tokens.word_hashes(raw, offsets)
    seen = {}
    for i, t in enumerate([*batch, ""]):
        words = WORD.findall(t)
        assert bounds[i + 1] - bounds[i] == len(words)
        for w, h in zip(words, hashes[bounds[i] : bounds[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert [b - a for a, b in common.slices(column, 64)] and sum(b - a for a, b in common.slices(column, 64)) == 201


def test_pipeline_stages_against_plain_ones(spark, tmp_path):
    rows, seen = common.read(spark, SF, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows.collect()
        stage(spark, rows, SF).write.parquet(str(tmp_path / str(k)))
        rows = spark.read.parquet(str(tmp_path / str(k)))
        seen.append((before, rows.collect()))
    (docs, spoken), (_, single), (_, masked), (_, copied), (_, packed) = seen

    assert {r.doc_id for r in spoken} == {r.doc_id for r in docs if langid.has_letter(r.text)}
    lang = {r.doc_id: r.lang for r in docs}
    assert np.mean([r.lang == lang[r.doc_id] for r in spoken]) > 0.97

    heads = plain_join({r.doc_id: r.text for r in spoken})
    assert sorted(r.doc_id for r in single) == sorted(i for i, (c, _) in heads.items() if i == c)

    text = {r.doc_id: r.text for r in single}
    for r in masked:
        for kind, a, b in plain_spans(text[r.doc_id]):
            assert text[r.doc_id][a:b] not in r.text or text[r.doc_id][a:b] in "".join(f"[{k.upper()}]" for k in pii.KINDS), (kind, a, b)
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
    assert all(r.text == text[r.doc_id] for r in masked if not plain_spans(text[r.doc_id]) and "=" not in text[r.doc_id])

    size = {r.doc_id: len(WORD.findall(r.text)) for r in masked}
    source, total = {r.doc_id: r.source for r in masked}, Counter()
    for i, n in size.items():
        total[source[i]] += n
    want, copies, taken = plain_targets(dict(total)), Counter(r.doc_id for r in copied), Counter()
    for i in size:
        assert copies[i] in (int(want[source[i]] / total[source[i]]), int(want[source[i]] / total[source[i]]) + 1)
        taken[source[i]] += copies[i] * size[i]
    assert all(abs(taken[s] - want[s]) <= max(n for i, n in size.items() if source[i] == s) / 2 + 1 for s in want)

    words, room = Counter(), defaultdict(int)
    for r in packed:
        words[r.doc_id] += r.length
        room[r.bin_id, r.bin_size] += r.length
    assert words == Counter({i: n * size[i] for i, n in copies.items()}) and all(n <= cap for (_, cap), n in room.items())


def test_pipeline_of_the_smallest_table(spark):
    out = __spark_entry__.queries()["pipeline"](spark, SF).collect()
    assert out and all(r.length <= r.bin_size for r in out if r.length)
