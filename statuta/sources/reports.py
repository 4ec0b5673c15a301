"""Readers of quality reports: totals of invariants and cases, and conserved words, for each edition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.sources.files import file_name

RESULT = "struct<invariants:array<struct<name:string,passed:boolean,failures:array<string>>>,cases:array<struct<passed:boolean>>>"
EDITIONS = "struct<editions:array<struct<json:string,name:string,body_conserved:double,body_missing:long,footnote_conserved:double,footnote_missing:long,passed:boolean>>>"


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(file_name().alias("file"), "value")


def read_invariants(spark: SparkSession, path: str, most: int = 5) -> DataFrame:
    """edition, totals and passed of invariants and cases, names of failing invariants, and the first `most` failures of each. A report on one target has no outer names: its file is the name."""
    raw = whole(spark, path)
    single = F.from_json("value", RESULT)
    results = F.when(single["invariants"].isNotNull(), F.create_map("file", single)).otherwise(F.from_json("value", f"map<string,{RESULT}>"))
    rows = raw.select(F.explode(results).alias("path", "r")).filter("r IS NOT NULL")
    invariants, cases = F.coalesce("r.invariants", F.array()), F.coalesce("r.cases", F.array())
    passed = lambda x: F.coalesce(x["passed"], F.lit(False))
    failing = F.filter(invariants, lambda i: ~passed(i) & i["name"].isNotNull())
    return rows.select(
        stem(F.col("path")).alias("edition"), F.size(invariants).alias("invariants_total"), F.size(F.filter(invariants, passed)).alias("invariants_passed"), F.size(cases).alias("cases_total"), F.size(F.filter(cases, passed)).alias("cases_passed"),
        F.transform(failing, lambda i: i["name"]).alias("failing_invariants"), F.transform(failing, lambda i: F.struct(i["name"].alias("name"), F.slice(F.coalesce(i["failures"], F.array().cast("array<string>")), 1, most).alias("failures"))).alias("failures"),
    )


def read_conservation(spark: SparkSession, path: str) -> DataFrame:
    """edition, conserved shares and missing words of body and footnotes, and the gate."""
    rows = whole(spark, path).select(F.explode(F.from_json("value", EDITIONS)["editions"]).alias("e"))
    name = F.coalesce(F.nullif("e.json", F.lit("")), "e.name")
    return rows.filter(F.coalesce(name, F.lit("")) != "").select(stem(name).alias("edition"), "e.body_conserved", "e.body_missing", "e.footnote_conserved", "e.footnote_missing", F.col("e.passed").alias("gate_ok"))


def metrics(invariants: DataFrame, conservation: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both reports for each version (document_id, edition), and the editions that no version has."""
    both = invariants.join(conservation, "edition", "full_outer")
    return versions.join(both, "edition"), both.select("edition").join(versions, "edition", "left_anti")
