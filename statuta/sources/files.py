"""Readers and writers of documents, reports and listings."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOOTNOTE = T.StructType([T.StructField(n, t) for n, t in (("ref", T.StringType()), ("marker", T.StringType()), ("page", T.IntegerType()), ("text", T.StringType()), ("html", T.StringType()))])
SECTION = T.StructType([
    T.StructField("code", T.StringType()), T.StructField("heading", T.StringType()), T.StructField("start_page", T.IntegerType()), T.StructField("page_number", T.IntegerType()), T.StructField("end_page", T.IntegerType()),
    T.StructField("html", T.StringType()), T.StructField("plain_text", T.StringType()), T.StructField("footnotes", T.ArrayType(FOOTNOTE)),
    T.StructField("ocr_review", T.ArrayType(T.StringType())),
])
DIVISION = T.StructType([*SECTION.fields, T.StructField("sections", T.ArrayType(SECTION))])
PART = T.StructType([*DIVISION.fields, T.StructField("divisions", T.ArrayType(DIVISION))])
CONTAINER = T.StructType([*PART.fields, T.StructField("parts", T.ArrayType(PART))])
CALIBRATION = T.StructType([
    *(T.StructField(n, T.DoubleType()) for n in "page_w page_h header_max_top footer_min_top body_size footnote_size body_min_size rule_x0_lo rule_x0_hi rule_w_lo rule_w_hi page_offset_support".split()),
    T.StructField("zone_mode", T.StringType()), T.StructField("page_offset", T.IntegerType()), T.StructField("pages_sampled", T.IntegerType()),
])
OCR = T.StructType([
    T.StructField("pages", T.IntegerType()), T.StructField("pages_ocred", T.ArrayType(T.IntegerType())), T.StructField("needs_review_tokens", T.IntegerType()), T.StructField("mean_agreement", T.DoubleType()),
    T.StructField("low_conf_share", T.DoubleType()), T.StructField("provisional", T.BooleanType()), T.StructField("provisional_reason", T.StringType()),
])
METADATA = T.StructType([
    T.StructField("filename", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("total_pages", "toc_pages_scanned", "sections_count", "chapters_count", "schedules_count")),
    T.StructField("calibration", CALIBRATION), T.StructField("ocr", OCR),
])
DOCUMENT = T.StructType([
    T.StructField("metadata", METADATA),
    T.StructField("preamble", T.StringType()), T.StructField("chapters", T.ArrayType(CONTAINER)), T.StructField("schedules", T.ArrayType(CONTAINER)),
])


def file_name() -> Column:
    """The name of the file that a row was read from; paths come with percent escapes, in which a plus is itself."""
    return F.url_decode(F.replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.lit("+"), F.lit("%2B")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Document JSON files, with the name of each."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("file", file_name())


def flatten(documents: DataFrame, key: str = "file") -> DataFrame:
    """A row for each leaf of chapters and schedules, in walk order: sections, then parts, then divisions of each level.

    A leaf carries the codes of the containers above it. The walk order is an array of places, then renumbered
    by start page (0 if none).
    """
    fields = ["code", "heading", "start_page", "page_number", "end_page", "html", "plain_text", "footnotes"]

    def leaf(level: DataFrame, source: str, kind: str, above: dict[str, str], order: list) -> DataFrame:
        out = level.select(key, F.lit(kind).alias("hierarchy_kind"), *(F.col(c).alias(n) for n, c in above.items()), F.array(*order).alias("place"), F.posexplode(source).alias("at", "s"))
        for n in ("chapter_code", "part_code", "division_code"):
            if n not in above:
                out = out.withColumn(n, F.lit(None).cast("string"))
        return out.select(key, "hierarchy_kind", "chapter_code", "part_code", "division_code", F.concat("place", F.array(F.col("at"))).alias("place"), *(F.col(f"s.{f}").alias(f) for f in fields))

    found = []
    for k, (root, kind) in enumerate((("chapters", "chapter"), ("schedules", "schedule"))):
        chapters = documents.select(key, F.posexplode(root).alias("i", "c"))
        found.append(leaf(chapters, "c.sections", kind, {"chapter_code": "c.code"}, [F.lit(k), F.col("i"), F.lit(0)]))
        parts = chapters.select(key, "i", "c", F.posexplode("c.parts").alias("j", "p"))
        found.append(leaf(parts, "p.sections", kind, {"chapter_code": "c.code", "part_code": "p.code"}, [F.lit(k), F.col("i"), F.lit(1), F.col("j"), F.lit(0)]))
        deep = parts.select(key, "i", "j", "c", "p", F.posexplode("p.divisions").alias("m", "d"))
        found.append(leaf(deep, "d.sections", kind, {"chapter_code": "c.code", "part_code": "p.code", "division_code": "d.code"}, [F.lit(k), F.col("i"), F.lit(1), F.col("j"), F.lit(1), F.col("m")]))
        direct = chapters.select(key, "i", "c", F.posexplode("c.divisions").alias("m", "d"))
        found.append(leaf(direct, "d.sections", kind, {"chapter_code": "c.code", "division_code": "d.code"}, [F.lit(k), F.col("i"), F.lit(2), F.col("m")]))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    start = F.coalesce(F.nullif("start_page", F.lit(0)), F.nullif("page_number", F.lit(0)))
    out = out.withColumn("start_page", start).drop("page_number")
    return out.withColumn("sort_order", F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("start_page", F.lit(0)), "place")) - 1)


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Files by their first bytes: whether each is a PDF."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", (F.substring(F.col("content"), 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))


def pair_directories(files: DataFrame) -> DataFrame:
    """Folders with how many PDF and JSON files each has; a pair has one of both. files: path, is_pdf."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    by = files.groupBy(folder.alias("folder")).agg(F.count_if(F.col("is_pdf")).alias("pdfs"), F.count_if(F.lower("path").endswith(".json")).alias("jsons"))
    return by.withColumn("is_pair", (F.col("pdfs") == 1) & (F.col("jsons") == 1))


def match_json_to_pdf(jsons: DataFrame, pdfs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with the PDF that their metadata names (the first by path), and those without. jsons: file, filename; pdfs: path."""
    first = pdfs.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path").groupBy("filename").agg(F.min("path").alias("pdf"))
    return jsons.join(first, "filename"), jsons.join(first, "filename", "left_anti")


OCR_ROW = r"^\|\s*(\d+)\s*\|\s*(-?\d+)\s*\|\s*(-?\d+)\s*\|\s*(.*?)\s*\|\s*([\d.]+)\s*\|\s*(.*?)\s*\|\s*([\d.]+)\s*\|\s*(.*?)\s*\|\s*$"


def read_ocr_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the Markdown tables of disagreements."""
    lines = spark.read.text(path).filter(F.col("value").rlike(OCR_ROW))
    names = (("page", "int"), ("x0", "int"), ("top", "int"), ("tesseract", "string"), ("tess_conf", "double"), ("rapidocr", "string"), ("rapid_conf", "double"), ("accepted", "string"))
    return lines.select(file_name().alias("file"), *(F.regexp_extract("value", OCR_ROW, i).cast(t).alias(n) for i, (n, t) in enumerate(names, 1)))


def write_documents(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def write_flat_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).csv(path)


def prometheus_lines(counts: DataFrame, metric: str, label: str) -> DataFrame:
    """counts (label, n) as lines of the text format."""
    return counts.select(F.format_string(f'{metric}{{{label}="%s"}} %d', F.col(label), F.col("n")).alias("value"))


def layout_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, page, line and text of page layouts as text, whose pages end in form feeds."""
    pages = spark.read.text(path, wholetext=True).select(file_name().alias("file"), F.posexplode(F.split("value", "\f")).alias("page", "text"))
    return pages.select("file", (F.col("page") + 1).alias("page"), F.posexplode(F.split("text", "\r?\n")).alias("line", "text"))


def cached(spark: SparkSession, folder: str, identity: str, parameters: dict, compute) -> DataFrame:
    """What compute() gives, written once for a digest of identity and parameters and read after that. folder is shared by all executors."""
    name = hashlib.sha256(json.dumps([identity, parameters], sort_keys=True).encode()).hexdigest()
    path = f"{folder}/{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
