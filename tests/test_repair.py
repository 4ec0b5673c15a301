"""Repairs of text, labels and library operators against plain versions; what the core may import."""

import ast
import random
import re
import unicodedata
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from statuta.functions import headings as H
from statuta.functions import python
from statuta.functions import repair as P
from statuta.functions import text as T
from statuta.operators import geometry
from statuta.operators import library as L
from statuta.operators import relations as R
from statuta.operators import structure as S
from statuta.sources import files
from statuta.sources.tables import table
from statuta.streaming import findings as S2
from tests.conftest import SF


def test_the_core_does_not_import_the_subpackage():
    root = Path(__spark_entry__.__file__).parent / "statuta"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            names = [n for node in ast.walk(ast.parse(path.read_text())) for n in ([node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else [])]
            assert not [n for n in names if n.startswith("statuta.llm")], path


def vocabulary(texts, pattern):
    return Counter(w.lower() for t in texts for w in re.findall(pattern, t or ""))


def test_dehyphenation_against_a_plain_one(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    solid, cut = vocabulary(texts.values(), "[A-Za-z]{3,}"), vocabulary(texts.values(), "[A-Za-z]{2,}-[a-z]{2,}")
    rng = random.Random(1)
    damaged = {i: re.sub("[A-Za-z]{6,}", lambda m: m[0] if rng.random() < 0.7 else m[0][:2] + "- " + m[0][2:4] + "-\n" + m[0][4:], t or "") for i, t in texts.items()}

    def plain(text):
        def one(m):
            joined, hyphenated = (m[1] + m[2]).lower(), f"{m[1]}-{m[2]}".lower()
            return m[1] + ("" if solid[joined] >= 3 and solid[joined] > cut[hyphenated] else "-") + m[2]

        for _ in range(8):
            text = re.sub(P.HYPHEN_WRAP, one, text)
        return text

    df = spark.createDataFrame([(i, t) for i, t in damaged.items()], "doc_id long, damaged string")
    out = {r.doc_id: r.repaired for r in S.dehyphenate(df, table(spark, SF, "documents"), "doc_id", "damaged").collect()}
    assert out == {i: plain(t) for i, t in damaged.items()} and any(t != damaged[i] for i, t in out.items())


def test_spaced_words_against_a_plain_one(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    solid = vocabulary(texts.values(), "[A-Za-z]{3,}")
    damaged = {i: re.sub(r" ([a-z]{4}) ", lambda m: f" {' '.join(m[1])} ", t or "") for i, t in texts.items()}
    close = lambda t: re.sub(P.SPACED_WORD, lambda m: m[0].replace(" ", "") if solid[m[0].replace(" ", "").lower()] >= 5 else m[0], t, flags=re.ASCII)
    df = spark.createDataFrame([(i, t) for i, t in damaged.items() if t.isascii()], "doc_id long, damaged string")
    out = {r.doc_id: r.repaired for r in S.close_spaced(df, table(spark, SF, "documents"), "doc_id", "damaged").collect()}
    assert out == {i: close(t) for i, t in damaged.items() if t.isascii()} and len(out) > 10


def test_texts_are_composed(spark):
    odd = ["ﬁne  print", "état", "１２３ ｋｇ", "plain é ü ß", "a b　c\x1fd\x85e", "Å", "…and", "x²", None, "  "]
    got = [r.x for r in spark.createDataFrame(list(enumerate(odd)), "i int, t string").select("i", T.norm_text(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t or "")).strip() for t in odd]


@pytest.mark.parametrize(("line", "kind"), [("(1) x", "subsec"), ("(1AAA) x", "subsec"), ("(iv) x", "roman"), ("(l) x", "clause"), ("(xli) x", "roman"), ("(ab) x", "clause"), ("4[5(1B) “x”", "subsec"), ("20.1[ (6) x", "subsec"), ("1. Application", "rule"), ("1. application", "text"), ("THE FIRST PART", "htext"), ("THE 1ST", "text"), ("233 (2A) x", "text"), ("", "text"), (None, "text")])
def test_line_classes(spark, line, kind):
    assert spark.createDataFrame([(line,)], "t string").select(P.line_class(F.col("t"))).first()[0] == kind


def test_labels(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(H.normalize_heading(F.lit("] THE GAZETTE OF PAKISTAN, EXTRA., JULY 1, 2019 Rates"))) == "Rates"
    assert one(H.normalize_heading(F.lit("Tax on income ....... 12-14 Chapter-IV"))) == "Tax on income" and one(H.normalize_heading(F.lit("Rate 7"))) == "Rate 7"
    assert one(H.section_label(F.lit("12A"), F.lit("Tax"))) == "Section 12A: Tax" and one(H.section_label(F.lit(None).cast("string"), F.lit(""))) is None
    assert one(H.hierarchy_label(F.lit("II"), F.lit("Rates"), F.lit("schedule"))) == "Schedule II: Rates"
    assert one(H.cursor_offset(H.cursor(F.lit(40), F.lit("f")), F.lit("f"))) == 40 and one(H.cursor_offset(H.cursor(F.lit(40), F.lit("f")), F.lit("g"))) is None


def test_ranges_and_bands_against_plain_loops(spark):
    rng = random.Random(4)
    points = [(i, rng.randrange(-50, 300)) for i in range(400)]
    spans = [(i, a := rng.randrange(-60, 280), a + rng.choice([0, 3, 40, 200])) for i in range(60)] + [(99, 5, 2)]
    df = spark.createDataFrame(points, "k long, p long"), spark.createDataFrame(spans, "i long, lo long, hi long")
    got = {r.k: r.hit and r.hit.i for r in R.point_in_interval(*df, "k", "p", "lo", "hi", ["lo", "i"], 16).collect()}
    assert got == {k: min(((lo, i) for i, lo, hi in spans if lo <= p <= hi), default=(0, None))[1] for k, p in points}
    old = [(i, rng.choice(["a", None]), rng.randrange(400)) for i in range(120)]
    new = [(1000 + i, rng.choice(["a", None]), rng.randrange(400)) for i in range(120)]
    make = lambda rows: spark.createDataFrame(rows, "id long, g string, at long")
    found = {r.old_id: r.new_id for r in R.unique_band_match(make(old), make(new), ["g"], "at", 1, "id", "id").collect()}
    near = {i: [j for j, h, b in new if h == g and abs(a - b) <= 1] for i, g, a in old}
    assert found == {i: js[0] for i, js in near.items() if len(js) == 1} and found


def test_snapshots_and_choices(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id long, t string")
    L.write_snapshot(rows, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 1
    with pytest.raises(ValueError, match="nothing"):
        L.write_snapshot(rows.limit(0), str(tmp_path / "e"))
    versions = spark.createDataFrame([("d", 1, False), ("d", 2, True), ("e", 1, True)], "doc string, n int, is_active boolean")
    chosen = spark.createDataFrame([("d", 1), ("e", 9)], "doc string, wanted int")
    assert {(r.doc, r.n) for r in L.activated(versions, "doc", "n", chosen).filter("is_active").collect()} == {("d", 1), ("e", 1)}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from statuta import session

    class Unset:
        def isEmpty(self):  # noqa: N802
            return True

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Unset()})()})()

        def getConf(self):  # noqa: N802
            return {}

    spark = type("Session", (), {"sparkContext": Context(), "conf": {}})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(spark)


def test_layouts_and_caches(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\fthree\r\nfour")
    rows = files.layout_lines(spark, str(tmp_path / "a.txt")).orderBy("page", "line").collect()
    assert [(r.page, r.line, r.text) for r in rows] == [(1, 0, "one"), (1, 1, "two"), (2, 0, "three"), (2, 1, "four")]
    calls = []
    compute = lambda: calls.append(1) or spark.range(3)
    for dpi in (300, 300, 200):
        assert files.cached(spark, str(tmp_path / "cache"), "page 1", {"dpi": dpi}, compute).count() == 3
    assert len(calls) == 2


def test_polling(spark, tmp_path):
    import time

    spark.range(5).selectExpr("id", "id * 2 AS x").write.parquet(str(tmp_path / "in"))
    seen = []
    rows = spark.readStream.schema("id long, x long").parquet(str(tmp_path / "in"))
    q = S2.poll(rows, lambda batch, n: seen.append(batch.count()), str(tmp_path / "state"))
    deadline = time.time() + 60
    while sum(seen) < 5 and time.time() < deadline:
        time.sleep(0.2)
    q.stop()
    assert sum(seen) == 5


def test_files_of_documents(spark, tmp_path):
    pdfs = spark.createDataFrame([("/b/x.pdf",), ("/a/x.pdf",), ("/a/y.pdf",)], "path string")
    jsons = spark.createDataFrame([("1.json", "x.pdf"), ("2.json", "z.pdf")], "file string, filename string")
    found, without = files.match_json_to_pdf(jsons, pdfs)
    assert [tuple(r) for r in found.select("file", "pdf").collect()] == [("1.json", "/a/x.pdf")] and [r.file for r in without.collect()] == ["2.json"]
    files.write_documents(jsons, str(tmp_path / "j"))
    files.write_flat_csv(jsons, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_contents_of_documents(spark):
    lines = ["CHAPTER I", "PRELIMINARY", "1. Short title 3", "2. Definitions 4"]
    df = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(lines)], "document string, page int, line int, text string")
    want = [(r["kind"], r["code"], r["page"]) for r in geometry.parse_toc(lines)]
    assert [(r.kind, r.code, r.printed_page) for r in geometry.toc_rows(df).orderBy("idx").collect()] == want and len(want) >= 2


def test_visible_text(spark):
    rows = spark.createDataFrame([("<p>a &amp; <b>b</b><script>x</script></p>",), (None,)], "h string")
    assert [r[0] for r in rows.select(python.visible_text("h")).collect()] == ["a & b", ""]
    assert [r[0] for r in rows.select(python.visible_words("h")).collect()] == ["a & b", ""]
