"""Queries against their SQL on small tables of odd rows."""

import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from statuta import catalog
from statuta.functions import text as T
from statuta.operators import structure
from tests.test_queries import plain


@pytest.fixture
def against_sql(spark, tmp_path):
    """Whether a query over these tables (name: rows and schema) returns what its SQL returns; the rows."""

    def compare(name, **tables):
        con = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
            con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        df = catalog.queries()[name](spark, str(tmp_path))
        found = con.sql(catalog.oracle_sql()[name])
        at = [found.columns.index(c) for c in df.columns]
        rows = [tuple(r) for r in df.collect()]
        assert plain(rows) == plain(tuple(r[i] for i in at) for r in found.fetchall())
        return rows

    return compare


def most_rows(df):
    """The most rows that any operator of a query that has run gave out."""
    rows, plans = [0], [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        if p.metrics().contains("numOutputRows"):
            rows.append(p.metrics().apply("numOutputRows").value())
        name = p.getClass().getSimpleName()
        under = [p.finalPhysicalPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        plans += under
    return max(rows)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(*texts):
    """Texts with ids that put no damage at their ends and no markers before them, and as they are."""
    return [(k, t, "en", "src1", len(t or "")) for i, t in enumerate(texts) for k in (72 * i + 7, 72 * i + 24)], DOCUMENTS


def test_borders_and_line_ends_of_invariants_are_ascii(against_sql):
    found = against_sql("invariants_text", documents=documents("né1 st and 21 sté", "the 21 st year", "a\n.12\r\nb", "a\r.12\nb", "a\n.12\u2028b", "a\n.12", None))
    assert {(i, k) for i, k, _ in found} >= {("no_split_ordinals", 7), ("no_split_ordinals", 24)}


def test_lines_of_sharp_s_and_odd_white_space(against_sql):
    texts = ["Straße a b", "Straße", "straßen", "ŉabcdef", "ﬁ abcdef", "ᾳabcdeſ", "ßßßßßßßß", "\x0b(1) x", "\x0bCAPITALS ONLY", "\U00010428bcdefgß", None, ""]
    found = dict(against_sql("line_classes", documents=documents(*texts)))
    assert found[72 + 7] == "text"  # seven letters, eight if ß were two


def test_report_families_of_any_length(against_sql):
    families = ["1", "0012", "customs act", "customs act, 1969 as amended " + "x" * 90, "ÉTÉ", "000", "", "tax", "customer#0000000012", "é", None]
    names = ["Customs Act, 1969", "CUSTOMS ACT, 1969 AS AMENDED " + "X" * 90 + " up to 2001", "customs act, 1969 as amended " + "x" * 89, "Customer#000000012", "été 12", "", "x", None, "12"]
    suppliers = [(k, f and "Supplier#" + f) for k, f in enumerate(families)] + [(0, "Supplier#tax"), (20, "short")]
    found = against_sql("report_documents", supplier=(suppliers, "s_suppkey long, s_name string"), customer=([(9 - k, n) for k, n in enumerate(names)], "c_custkey long, c_name string"))
    assert (3, 8) in found  # a family of more than 100 characters


def test_placeholders_meet_one_bracket_of_each_marker(spark, against_sql):
    orders = [(k % 7 * 400 + k % 3, k % 5, "OF"[k % 2]) for k in range(60)], "o_orderkey long, o_custkey long, o_orderstatus string"
    items = [(k % 7 * 400 + k % 4, k % 5 + 50, k % 6 + 1, "RN"[k % 4 == 3]) for k in range(400)], "l_orderkey long, l_suppkey long, l_linenumber int, l_returnflag string"
    assert against_sql("claimed_placeholders", orders=orders, lineitem=items)
    notes = spark.createDataFrame([("d", 1, "3", f"Section {k} omitted") for k in range(200)], "document string, page long, marker string, text string")
    lines = spark.createDataFrame([("d", k, 1, "3[ ]") for k in range(500)], "document string, at long, page long, text string")
    found = structure.claim_placeholders(spark.createDataFrame([("d", str(k)) for k in range(201)], "document string, code string"), lines, notes)
    assert sorted((r.code, r["at"]) for r in found.collect()) == sorted([(str(k), 0) for k in range(200)] + [("200", None)])
    assert most_rows(found) <= 1_000  # 200 * 500 rows if notes met all brackets


def test_regression_checks_collect_no_nodes(spark, against_sql, tmp_path):
    rows = [(k, f"the text {k % 11}" if k % 13 else None, [None, "en", "de", "xen"][k // 308 % 4], [None, "src1", "src22", "s"][k // 7 % 4], 9) for k in range(3000)]
    assert any(r[1] == "texts" and r[4] for r in against_sql("regression_checks", documents=(rows, DOCUMENTS)))
    assert "collect_list" not in catalog.queries()["regression_checks"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


COPIES = [(k, [" one  two\n", "one two", "two", None, "e\u0301t\u00e9 \u2126", "\ufb01ne"][k % 6], ["en", "de", None][k // 6 % 3], f"src{k % 4}", 9) for k in range(60)]


def python_passes(df):
    """How many times a query that has run sends rows to Python, what it cut off before not counted."""
    return df._jdf.queryExecution().executedPlan().toString().count("EvalPython")


def test_variant_keys_are_computed_once(spark, against_sql, tmp_path):
    rows = [(k, *r) for k, *r in COPIES if not (r[0] or "").startswith(("e", "\ufb01"))]  # SQL composes no characters
    against_sql("blast_radius", documents=(rows, DOCUMENTS))
    assert python_passes(catalog.queries()["blast_radius"](spark, str(tmp_path))) == 0


def test_normal_texts_are_those_of_python(spark):
    odd = ["\u2126 \ufb01 e\u0301", "\u00a8\u00a0\u3000x\x1c\x85y\x0b", "\u1e9b\u0323 \u00bd", "\u200b a", "", None, " \r\n"]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").orderBy("i").select(T.norm_text(F.col("t")).alias("x")).collect()]
    assert got == [" ".join(unicodedata.normalize("NFKC", t or "").split()) for t in odd]


def test_approvals_are_inherited_by_keys_computed_once(spark, against_sql, tmp_path):
    rows = [(k, *r) for k, *r in COPIES if not (r[0] or "").startswith(("e", "ﬁ"))]
    labels = [(k, k % 3 % 2, int(k % 7 == 0)) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int"
    assert against_sql("approval_inheritance", documents=(rows, DOCUMENTS), labels=labels)
    assert python_passes(catalog.queries()["approval_inheritance"](spark, str(tmp_path))) == 0


def test_markup_drift_hashes_are_computed_once(spark, against_sql, tmp_path):
    pages = [(k, f"https://h{k % 3}.net/{['en', 'de'][k % 2]}/x", ["<p>a</p>", "<p>a </p>", "<h1>b</h1>", None, "a"][k % 5]) for k in range(40)], "page_id long, url string, html string"
    assert against_sql("detect_markup_drift", pages=pages)
    assert python_passes(catalog.queries()["detect_markup_drift"](spark, str(tmp_path))) == 0


def test_notes_are_read_once(spark, against_sql, tmp_path):
    parts = [(k, f"Brand#{k}", k, "LARGE") for k in range(9)], "p_partkey long, p_brand string, p_size int, p_type string"
    against_sql("note_texts", part=parts)
    plan = catalog.queries()["note_texts"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count('sup class="cite"[^>]') == 1  # the marks' pattern; each mention is computed anew for each line


def test_detectors_union_hashes_pages_once(spark, against_sql, tmp_path):
    pages = [(k, f"https://h{k % 3}.net/{['en', 'de'][k % 2]}/x", ["<p>a</p>", "<p>a </p>", "<h1>b</h1>", None, "a"][k % 5]) for k in range(40)], "page_id long, url string, html string"
    rows = [(k, ["A B C word", "omitted", "x" * 400, "y", None][k % 5], "en", f"src{k % 2}", 9) for k in range(50)]
    assert against_sql("detectors_union", pages=pages, documents=(rows, DOCUMENTS))
    assert python_passes(catalog.queries()["detectors_union"](spark, str(tmp_path))) == 0


def test_structure_is_discovered_many_documents_at_once(spark):
    rows = [(f"d{k}", i, t) for k in range(5) for i, t in enumerate(["PART I", "Beginnings", f"{k + 1}. Short title.— text", "9. Long title.— text", None])]
    found = structure.discover(spark.createDataFrame(rows, "document string, at long, text string"))
    assert sorted((r.document, r["at"], r.kind, r.code, r.container_at) for r in found.collect())[:3] == [("d0", 0, "part", "PART I", None), ("d0", 2, "section", "1", 0), ("d0", 3, "section", "9", 0)]
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_where_texts_were_dealt(spark, against_sql, tmp_path):
    rows = [(k % 7, ["one two two three", "", None, "ab ab cd x", "éa word"][k % 5] , "en", "s", 9) for k in range(20) if k < 7]
    against_sql("conservation_audit", documents=(rows, DOCUMENTS))
    df = catalog.queries()["conservation_audit"](spark, str(tmp_path))
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning(doc_id") == 1


def test_runs_are_sorted_once(spark, against_sql, tmp_path):
    rows = [(k % 3, k % 5, k % 2, k, 1.0, "ARN"[k // 4 % 3]) for k in range(60)]
    against_sql("footnote_runs", lineitem=(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string"))
    df = catalog.queries()["footnote_runs"](spark, str(tmp_path))
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Sort [") == 1


def test_detectors_union_reads_texts_once(spark, against_sql, tmp_path):
    bodies = ["A  B\tC", "x A\nB C", "A B Cé", "A B C2", "the CHAP  TER", "SCHED\nule", "sect ION", "o mitted", "xR epealed", "R  epealed", "word A B", "\n\n x ", "head\nbody of the text", "head\n" + " " * 300 + "b", " head \r\n\tbody ", "é omitted é", "éomitted", "unrepealed", "REPEALED", "y" * 400, "  z" * 200 + "\n", "", None]
    rows = [(k, bodies[k * 7 % 23], ["en", "de", None][k % 3], f"src{k % 2}", 9) for k in range(138)] + [(k, "z" * (k % 5 * 90 + 2), "en", "src2", 9) for k in range(200, 210)], DOCUMENTS
    pages = [(k, "https://h.net/en/x", ["<p>a</p>", None][k % 2]) for k in range(6)], "page_id long, url string, html string"
    found = against_sql("detectors_union", pages=pages, documents=rows)
    assert {f[1] for f in found} == {"regression_vs_previous_edition", "heading_only_body", "short_vs_siblings", "glyph_split", "markup_only_drift"}
    for name in ("detect_regression", "detect_heading_only", "detect_short_vs_siblings", "detect_glyph_split"):
        against_sql(name, documents=rows)
    read = catalog.queries()["detectors_union"](spark, str(tmp_path)).inputFiles()
    assert not [f for f in read if "documents.parquet" in f]  # what is asked of texts was computed before, for all detectors
