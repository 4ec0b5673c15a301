"""A training corpus from the documents table: each stage calls one operator and works on what the one before kept.

All stages take empty tables, nulls in any column, texts of any length, and further columns of any name that
don't begin with two underscores; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import common, langid, mixing, ngram_join, packing, pii

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; documents without a language go, the others get the predicted one.

    A null text, or one without letters, has no language. Null ids and repeated rows are judged like others;
    ties between languages go by name.
    """
    samples = langid.draw_samples(docs, F.lit(True))
    found = langid.predict(docs, samples, names=("__lang", "__lang_score"))
    kept = found.filter(F.col("__lang") != "und")
    return kept.withColumn("lang", F.col("__lang")).select(*docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join; of each class the document with the least id stays, once.

    Texts of five words or more are alike from a similarity of 0.8 of their shingles on; shorter ones are alike if all
    their words are. Null texts and texts without words are alike to nothing and stay, all of them. Nulls come last
    among ids; of rows with equal ids and texts one stays.
    """
    decided = ngram_join.join(docs.select("doc_id", "text")).select("doc_id", "text_hash", "keeper")
    rows = common.cut(decided.groupBy("doc_id", "text_hash").agg(F.first("keeper").alias("keeper"), F.count("*").alias("n")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "keeper", "n"))
    hashed = docs.withColumn("__text_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__text_hash").eqNullSafe(F.col("__hash"))
    kept = hashed.join(rows.filter("NOT keeper OR n > 1"), same, "left_anti")
    repeated = rows.filter("keeper AND n > 1")
    if repeated.limit(1).count():
        kept = kept.union(hashed.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__text_hash"]))
    return kept.select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in the texts; n_chars is counted anew.

    A null text stays null, with a null n_chars. All rows stay, repeated ones and null ids too; equal texts are masked alike.
    """
    clean = pii.mask(docs, pii.learn(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document as many times as the mix takes it.

    Texts without words are taken 0 times and so go, null ones too; a null source is a source of its own. Rows
    with equal ids and texts are drawn each. docs must be a table or a checkpoint, as a stage's input is, so that rows
    keep their numbers.
    """
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    taken = mixing.mix(rows, common.word_count(F.col("text")), "__row", draw=F.xxhash64("doc_id", "text"))
    taken = taken.filter("copies > 0").select(F.col("doc_id").alias("__taken"), F.col("copies").alias("__copies"))
    copies = F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))
    return rows.join(taken, F.col("__row") == F.col("__taken")).withColumn("__copy", copies).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts packed into sequences, a row for each piece of a text: the longest sequence cuts longer ones.

    Null texts and texts without words are in no sequence: bin_id is null and length 0. Repeated rows are packed each.
    """
    return packing.pack(docs, common.word_count(F.col("text")))


STAGES = [("language ID", language), ("n-gram Jaccard join", one_of_each_class), ("PII", without_personal_data), ("mixing sources to target weights", mixed), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.cut(docs)
    return docs
