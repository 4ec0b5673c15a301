"""Inputs on which the operators once did less than the whole job."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from statuta.llm import common, mixing, ngram_join, pii, quality
from tests.conftest import SF


def test_a_long_chain_is_one_component(spark):
    r = random.Random(3)
    ids = r.sample(range(1 << 40), 3000)
    ties = list(zip(ids, ids[1:], strict=False)) + [(-5, -4), (-4, -9)]
    found = {x.node: x.label for x in ngram_join.components(spark.createDataFrame(ties, "a long, b long")).collect()}
    assert found == dict.fromkeys(ids, min(ids)) | dict.fromkeys((-5, -4, -9), -9)


def secret(i, n=40):
    return "".join(random.Random(i).choices("0123456789abcdef", k=n))


def test_patterns_beyond_the_broadcast_bound_are_applied(spark, monkeypatch):
    rows = [(10 * c + i, f"x{'abcdefghijkl'[c]}={secret(10 * c + i)} end") for c in range(12) for i in range(4 + c % 3)]
    rows += [(1000 + c, f"with x{'abcdefghijkl'[c]}=Qz7-{c}4711 there") for c in range(12)] * 2 + [(None, None), (None, "with xa=Qz7-94711 there")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    outcome = lambda p: (sorted(map(str, pii.extract(df, p).collect())), sorted(map(str, pii.mask(df, p).collect())))
    whole = outcome(pii.learn(df))
    assert sum("SECRET" in r for r in whole[1]) == len(rows) - 1
    monkeypatch.setattr(pii, "MOST_PATTERNS", 3)
    few = pii.learn(df)
    assert len(few) == 3 and few.rest.count() >= 9
    assert outcome(few) == whole


def test_long_values_are_masked_whole(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"
    jwt = "".join(random.Random(1).choices(alphabet, k=700))
    inner = f"{'a' * 300}&key={secret(99)}"
    rows = [(i, f"so token={secret(i)} it goes, key={secret(50 + i)} on") for i in range(30)]
    rows += [(100, f"so token={jwt} it goes"), (101, f"so token={jwt[:400]}/me@example.org. it goes"), (102, f"see link={inner} there")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.mask(df, pii.learn(df)).collect()}
    assert out[100] == "so token=[SECRET] it goes" and out[101] == "so token=[SECRET]. it goes"
    assert secret(99) not in out[102]


def test_long_values_are_told_apart(spark):
    a = secret(1, 300)
    df = spark.createDataFrame([(f"token={a}0",), (f"token={a}1",)], "text string")
    assert pii.graph(df).filter("pattern = 'token=' AND kind = 'secret'").count() == 2


def test_rows_of_small_groups_are_judged_by_all(spark):
    r = random.Random(2)
    good = [("en", "hot", True, *(0.3 + 0.02 * r.gauss(0, 1) for _ in quality.DIMENSIONS)) for _ in range(600)]
    rows = [*good, ("xx", None, True, *[3.0] * len(quality.DIMENSIONS)), ("yy", "rare", True, *good[0][3:])]
    names = ["lang", "source", "judged", *quality.DIMENSIONS]
    out = quality.outliers(spark.createDataFrame(rows, names), ["lang", "source"])
    assert out.filter("lang = 'xx' AND outlier").count() == 1 and out.filter("lang = 'yy' AND NOT outlier").count() == 1
    assert out.filter(F.col("lang") == "en").filter("outlier").count() < 30


def test_a_large_group_of_long_texts(spark, monkeypatch):
    """Blocks are bounded by shingles as well as by members, and rare hashes are counted like frequent ones."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 4_000)
    r = random.Random(5)
    base = [f"w{i}" for i in range(500)]
    made = {}
    for i in range(120):
        words = list(base)
        for _ in range(r.randint(0, 12)):
            words[r.randrange(500)] = f"x{r.randrange(40)}"
        made[i] = " ".join(words[: r.choice([500, 480, 410])])
    got = {x.doc_id: (x.class_id, x.n_links) for x in ngram_join.join(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in made.items()}
    want = {i: sum(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in made if j != i) for i in made}
    lost = sum(want[i] - got[i][1] for i in made)
    assert 0 <= lost <= 0.003 * sum(want.values()) and max(want.values()) > 60


def test_overlaps_are_those_of_sets():
    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([pool[:60], r.choice(pool, 30), r.integers(0, 1 << 63, 20).astype(np.uint64)])) for _ in range(70)]
    got = ngram_join.overlaps(sets[:40], sets[40:], width=16, most=50)
    assert [[len(set(a.tolist()) & set(b.tolist())) for b in sets[40:]] for a in sets[:40]] == got.tolist()


def test_a_long_text_full_of_entities_takes_linear_time():
    import time

    patterns = {"token=": "secret", "key=": "secret"}
    one = f"token={secret(1)} mail a@example.org or 10.1.2.3 or +1 (017) 555-7713, key={secret(2)} "
    began = time.perf_counter()
    base, added = pii.all_spans(one * 10_000, patterns)
    assert len(added) == 20_000 and len(base) == 30_000 and time.perf_counter() - began < 15


def test_no_span_is_added_without_a_pattern():
    assert pii.all_spans(f"so thing={secret(3)} it goes", {"token=": "secret"}) == ([], [])


def test_long_cue_words_are_cues():
    word = "a_very_long_name_of_an_access_token_in_a_config"
    assert [c[3] for c in pii.cues(f"--{word}: {secret(4)}")] == [f"{word}:"] and [c[3] for c in pii.cues(f"x{word * 3}={secret(4)}")] != []


def test_short_passages_are_quoted(spark, tmp_path):
    passages = ["", " ", "fox", "own fo", "the quick brown", "quick brown fox jumps", "absent", None, "Straße", "ick brown fox jumps ov", "50%_x"]
    texts = ["the quick brown fox jumps over", "fox fox", "", None, "in der Straße 50%_x"]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sorted(map(tuple, __spark_entry__.queries()["verbatim_quotes"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert out == sorted(con.sql(__spark_entry__.oracle_sql()["verbatim_quotes"]).fetchall())
    assert {i for i, _, _ in out} == {0, 1, 2, 3, 4, 5, 8, 9, 10}


def test_headings_are_whole(spark):
    found = __spark_entry__.queries()["discover_structure"](spark, SF)
    assert max(len(str(v)) for r in found.collect() for v in r) > 100


def test_shuffled_joins_equal_broadcasts(spark, monkeypatch):
    """Each user of counted broadcasts, with none allowed and with all."""
    docs = common.read(spark, SF, "documents")
    whole = lambda df: sorted(map(str, df.collect()))
    run = {
        "mixing": lambda: whole(mixing.mix(docs, common.word_count(F.col("text")), chunk=16)),
        "join": lambda: whole(ngram_join.join(docs)),
        "quality": lambda: [(r.doc_id, r.kept, round(r.distance or 0, 6)) for r in quality.judge(docs).orderBy("doc_id").collect()],
        "pii": lambda: sorted(pii.learn(docs).items()),
    }
    before = {name: f() for name, f in run.items()}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    for name, f in run.items():
        assert f() == before[name], name
