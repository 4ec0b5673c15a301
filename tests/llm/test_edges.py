"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for each operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from statuta.llm import common, fingerprints, langid, mixing, ngram_join, packing, pii, quality, sharding, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies long, verdict string, lang_pred string, base string, toxicity double, next_text string, label long, size long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))


def make(spark, rows):
    more = (7, "v", "p", "b", 0.5, "n", 3, 4)
    return spark.createDataFrame([(*r, *more) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(i, f"{text} number {i}", "en", "a", 50) for i in range(30)]
    rows += [(100, None, "en", "a", None), (101, "", "en", None, 0), (102, " \n\t ", None, "b", 4), (103, "zzz", "de", "b", 3), (None, text, None, None, None), (None, None, None, None, None)]
    rows += [(104, text, "en", "a", 9)] * 3 + [(105, LONG, "en", "c", len(LONG)), (106, "a" * 300_000, "en", "c", 300_000), (107, "1234 5678 ++ @@ ..", "en", "c", 5)]
    return make(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def test_packing_of_one_repeated_id(spark):
    rows = spark.createDataFrame([(5, "a b c")] * 600, "doc_id long, text string")
    out = packing.pack(rows, common.word_count(F.col("text")), items_per_shard=50).collect()
    per_shard = {}
    for r in out:
        per_shard[r.bin_id >> 31] = per_shard.get(r.bin_id >> 31, 0) + 1
    assert len(out) == 600 and len(per_shard) == 12 and max(per_shard.values()) < 100


def test_packing(docs, none):
    out = packing.pack(docs, common.word_count(F.col("text")), items_per_shard=5).collect()
    assert sum(r.piece == 0 for r in out) == docs.count()
    assert sum(r.length for r in out if r.doc_id == 105) == 60_000
    assert all((r.bin_id is None) == (r.length == 0) for r in out)
    assert packing.pack(none, common.word_count(F.col("text"))).count() == 0


def test_fingerprints(docs, none):
    out = fingerprints.with_next(fingerprints.fingerprints(docs), "doc_id", ["text", "fingerprint"]).collect()
    assert len(out) == docs.count()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[100].fingerprint == [] and by[101].fingerprint == [] and len(by[103].fingerprint) == 1
    assert len({tuple(r.fingerprint) for r in out if r.doc_id == 104}) == 1
    assert by[107].next_text == "a" * 300_000 and by[0].next_text in (None, "the quick brown fox jumps over the lazy dog and runs away")
    assert fingerprints.with_next(fingerprints.fingerprints(none), "doc_id", ["text", "fingerprint"]).count() == 0


def test_fingerprints_of_odd_ids(spark):
    """One outlying id, one repeated id and null ids: ranges stay about equal, and each row meets the next."""
    rows = [(i, f"text {i}") for i in range(600)] + [(10**15, "far"), (-(10**15), "near")] + [(77, f"again {i}") for i in range(300)] + [(55, "same")] * 300 + [(None, f"none {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df.write.mode("overwrite").parquet(path := f"{common.shared_dir(spark)}/odd-{len(rows)}")
    df = spark.read.parquet(path)
    out = fingerprints.with_next(df, "doc_id", ["text"], rows_per_bucket=50).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted((str(i), t) for i, t in rows)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]] % (1 << 64)))
    want = sorted((str(a[0]), a[1], b[1]) for a, b in zip(order, [*order[1:], order[0]], strict=True))
    assert sorted((str(r.doc_id), r.text, r.next_text) for r in out) == want
    bounds, largest = fingerprints._ranges(df.select(fingerprints._order_key("doc_id", "text").alias("key")), 25)
    assert len(bounds) > 15 and largest < 500  # 300 equal rows are one key


def test_mixing(docs, none):
    out = mixing.mix(docs, common.word_count(F.col("text"))).collect()
    assert len(out) == docs.count()
    assert all(0 <= r.copies <= 2 for r in out)
    assert {r.source for r in out} == {"a", "b", "c", None}
    assert mixing.mix(none, common.word_count(F.col("text"))).count() == 0


def test_mixing_of_one_repeated_id(spark):
    rows = spark.createDataFrame([(5, "a b c", "s", i) for i in range(900)] + [(i, "a b", "t", i) for i in range(300)], "doc_id long, text string, source string, n long")
    run = lambda: sorted(map(tuple, mixing.mix(rows, common.word_count(F.col("text")), chunk=16).select("doc_id", "source", "copies").collect()))
    out = run()
    taken = sum(c for i, s, c in out if s == "s") * 3
    want = next(r.target for r in mixing.mix(rows, common.word_count(F.col("text")), chunk=16).filter("source = 's'").select("target").take(1))
    assert len(out) == 1200 and abs(taken - want) <= 3 and run() == out


def test_targets_in_ranges(spark):
    rows = spark.createDataFrame([(f"s{i}", 1 + i * i % 97) for i in range(200)] + [(None, 50)], "source string, size long")
    one = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    many = {r.source: r.target for r in mixing.source_targets(rows, per_part=7).collect()}
    assert one.keys() == many.keys() and all(abs(one[s] - many[s]) < 1e-6 for s in one)


def test_url_filter(docs, none):
    out = url_filter.judge(docs, "text", url_filter.LISTED).collect()
    assert len(out) == docs.count() and all(r.verdict == "allow" and r.host == "" for r in out)
    assert url_filter.judge(none, "text", url_filter.LISTED).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert toxicity.score(docs, model).filter("toxicity BETWEEN 0 AND 1").count() == docs.count()
    assert toxicity.score(none, toxicity.learn(none, labels.limit(0))).count() == 0
    assert toxicity.score(docs, toxicity.learn(docs, labels.filter("toxic = 1"))).select("toxicity").distinct().collect()[0][0] == 1.0


def test_langid(docs, none):
    out = langid.predict(docs, langid.draw_samples(docs, F.lit(True))).collect()
    assert len(out) == docs.count()
    assert all(r.lang_pred == "und" and r.lang_score == 0 for r in out if not langid.has_letter(r.text))
    assert {r.lang_pred for r in out if langid.has_letter(r.text)} <= {"en", "de"}
    assert langid.predict(none, ()).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, ()).collect()} == {"und"}


def test_langid_of_equal_ids(spark, docs):
    """Null ids, or the same id everywhere, teach all languages."""
    rows = common.read(spark, "/root/testdata/sf0.001", "documents").select("text", "lang")
    for doc_id in (None, 7):
        same = rows.withColumn("doc_id", F.lit(doc_id).cast("long"))
        samples = langid.draw_samples(same, F.lit(True))
        assert {name for name, _ in samples} == {r.lang for r in rows.select("lang").distinct().collect() if r.lang}
        right = langid.predict(same, samples).filter("lang IS NOT NULL AND lang_pred <> 'und'").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
        assert right > 0.95


def test_langid_of_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 30)
    monkeypatch.setattr(langid, "SAMPLE_ALL", 60)
    rows = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{i % 40} " * 50, f"l{i % 40}") for i in range(400)], "doc_id long, text string, lang string")
    samples = langid.draw_samples(rows, F.lit(True))
    assert len(samples) == 30 and all(len(text) <= 2 * langid.SAMPLE_CHARS + 1 for _, text in samples)


def test_ngram_join(docs, none):
    out = ngram_join.join(docs).collect()
    assert len(out) == docs.count()
    three = [r for r in out if r.doc_id == 104]
    assert all(r.n_copies == 4 and r.class_id == three[0].class_id for r in three)  # and the row without an id
    assert all(r.class_id == r.doc_id and r.n_links == 0 for r in out if r.doc_id in (100, 101, 102, 103, 106))
    assert ngram_join.join(none).count() == 0


def test_sharding(spark, docs, none, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target=1 << 20, arrival_rows=5)
    store.append(docs)
    store.append(none)
    store.compact_all()
    assert store.read().count() == docs.count()
    assert len(store.runs()) == 1
    empty = sharding.ShardStore(spark, str(tmp_path / "e"))
    assert empty.read() is None and empty.vacuum() == 0


def test_quality(docs, none):
    out = quality.judge(docs).collect()
    assert len(out) == docs.count()
    assert all(r.base_failed and not r.kept for r in out if (r.n_words or 0) < 50)
    assert quality.judge(none).count() == 0


def test_pii(docs, none):
    patterns = pii.learn(docs)
    assert pii.extract(docs, patterns).count() == docs.count()
    masked = pii.mask(docs, patterns)
    assert masked.columns == docs.columns and masked.filter("doc_id = 100 AND text IS NULL").count() == 1
    assert pii.extract(none, pii.learn(none)).count() == 0


def test_pipeline(spark, docs, none, tmp_path):
    for name, table in (("full", docs), ("none", none)):
        rows = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, str(tmp_path))
            if k < 4:
                assert out.columns == table.columns
            out.write.parquet(f"{tmp_path}/{name}{k}")
            rows = spark.read.parquet(f"{tmp_path}/{name}{k}")
        assert (rows.count() > 0) == (name == "full")
    kept = spark.read.parquet(f"{tmp_path}/full1")
    assert kept.filter("text LIKE 'the quick%'").count() == 1  # all of them are linked
    assert kept.filter("doc_id IN (103, 105, 106)").count() == 3
