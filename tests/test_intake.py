"""Intake on small fixtures: nulls, empty frames, ties."""

import json

from pyspark.sql import functions as F

from statuta.operators import intake as I
from statuta.session import ship
from statuta.sources import reports


def test_junk(spark):
    rows = [
        ("PART I", "x", "1 Page No 2", None, True), ("7", "x", "1 Page No 2", None, False), (None, "x", "Section Page No.", None, True), ("Contents", "x", "Section Page No.", None, False), ("", "Contents · p3", "Section Page No", None, False),
        ("", "THE GAZETTE OF PAKISTAN", "] THE GAZETTE OF PAKISTAN, EXTRA., MAY 4, 2021", None, True), ("", "THE GAZETTE OF PAKISTAN", "", "<p>" + "law " * 30 + "</p>", False), (None, None, None, None, False),
    ]
    df = spark.createDataFrame(rows, "code string, heading string, plain string, html string, want boolean")
    assert df.filter(I.junk_leaf(F.col("code"), F.col("heading"), F.col("plain"), F.col("html")) != F.col("want")).collect() == []


def test_scanned(spark):
    rows = [(1, 4, [3], True), (4, 1, [3], True), (None, 3, [3], True), (3, None, [3], True), (None, None, [3], False), (1, 2, [], False), (1, 2, None, False)]
    df = spark.createDataFrame(rows, "a int, b int, p array<int>, want boolean")
    assert df.filter(I.meets_scanned(F.col("a"), F.col("b"), F.col("p")) != F.col("want")).collect() == []


def test_upload_errors(spark):
    documents = spark.createDataFrame([("a", 3, 3), ("b", 4, 3), ("c", None, 3)], "document string, declared int, pages int")
    leaves = spark.createDataFrame([("a", "k", 1, 3, 0), ("b", "k", 0, 1, 0), ("b", None, None, 1, 1), ("b", "m", 2, 4, 2)], "document string, source_key string, start_page int, end_page int, sort_order int")
    got = {tuple(r) for r in I.upload_errors(documents, leaves).collect()}
    assert got == {("b", "/metadata/total_pages", "page_count_mismatch"), ("b", "k", "invalid_page_span"), ("b", "/", "invalid_page_span"), ("b", "m", "invalid_page_span"), ("c", "/", "zero_sections")}
    assert I.upload_errors(documents, leaves, most=1).filter("document = 'b'").first().code == "page_count_mismatch"


def test_repeated_codes(spark):
    rows = [(0, "1", "Tax on income of firms"), (1, "1", "tax on income again"), (2, "2", "Rates"), (3, "2", "Other matters here"), (4, "3", "A b c"), (5, "3", "[Omitted]"), (6, "4", None), (7, "4", "x y z"), (8, None, "n")]
    df = spark.createDataFrame([("d", *r) for r in rows], "document string, at int, code string, heading string")
    assert sorted(r["at"] for r in I.without_repeated_codes(df).collect()) == [0, 2, 3, 4, 5, 6, 8]
    shared = spark.createDataFrame([("A b c", "a B d", 2), ("x", "y", 0), ("x y", "x y", 2), ("x y", "x", 1)], "a string, b string, want int")
    assert shared.filter(I.shared_words(F.col("a"), F.col("b")) != F.col("want")).collect() == []


def test_splice(spark):
    rows = [(1, 0, "1", "read as follows:"), (1, 1, "2", "closed."), (2, 0, None, "the quote"), (2, 1, "3", "end"), (5, 0, None, "far"), (6, 0, "4", "“open"), (6, 1, None, "later")]
    df = spark.createDataFrame([("d", *r) for r in rows], "document string, page int, idx int, marker string, text string")
    got = {(r.page, r.idx): (r.text, r.end_page) for r in I.splice_continuations(df).collect()}
    assert got == {(1, 0): ("read as follows:\nthe quote", 2), (1, 1): ("closed.", 1), (2, 1): ("end", 2), (5, 0): ("far", 5), (6, 0): ("“open", 6), (6, 1): ("later", 6)}


def test_pair_lines(spark):
    columns = "document string, page int, line int, x0 double, top double, x1 double, bottom double"
    first = spark.createDataFrame([("d", 1, 0, 0.0, 48.0, 100.0, 60.0), ("d", 1, 1, 0.0, 60.0, 100.0, 72.0)], columns)
    second = spark.createDataFrame([("d", 1, 0, 10.0, 49.0, 60.0, 61.0), ("d", 1, 1, 50.0, 66.0, 90.0, 70.0), ("d", 1, 2, 300.0, 48.0, 400.0, 60.0), ("d", 2, 0, 0.0, 48.0, 9.0, 60.0)], columns)
    assert {(r.page, r.second, r.line) for r in I.pair_lines(first, second).collect()} == {(1, 0, 0), (1, 1, 1), (1, 2, None), (2, 0, None)}


def test_sign_offs(spark):
    documents = spark.createDataFrame([("a", "approved", None, None), ("b", "pending", None, None), ("c", "approved", "reviewed", "x")], "document string, status string, signoff_stage string, reviewed_by string")
    requests = spark.createDataFrame([("a", "reviewed", "x"), ("b", "reviewed", "x"), ("a", "legal_approved", "y"), ("c", "legal_approved", "x"), ("c", "legal_approved", "y"), ("c", None, "y"), ("z", "reviewed", "x")], "document string, stage string, actor string")
    got = sorted((r.document, r.stage or "", r.actor, r.error or "") for r in I.sign_offs(requests, documents).collect())
    assert got == sorted([("a", "reviewed", "x", ""), ("b", "reviewed", "x", "not_all_approved"), ("a", "legal_approved", "y", "review_first"), ("c", "legal_approved", "x", "same_actor"), ("c", "legal_approved", "y", ""), ("c", "", "y", "unknown_stage"), ("z", "reviewed", "x", "not_found")])


def test_reports(spark, tmp_path):
    one = {"invariants": [{"name": "a", "passed": True}, {"name": "b", "passed": False, "failures": list("uvwxyz")}], "cases": [{"passed": True}]}
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "r.json").write_text(json.dumps({"out/x.json": one, "out/y.json": {"invariants": []}}))
    (tmp_path / "act one +1%.json").write_text(json.dumps(one))
    many = {r.edition: r for r in reports.read_invariants(spark, str(tmp_path / "many")).collect()}
    assert set(many) == {"x", "y"} and many["x"].failing_invariants == ["b"] and many["x"].failures[0].failures == list("uvwxy") and many["y"].invariants_total == 0
    assert [(r.edition, r.invariants_passed, r.cases_passed) for r in reports.read_invariants(spark, str(tmp_path / "act*.json")).collect()] == [("act one +1%", 1, 1)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.json").write_text(json.dumps({"editions": [{"json": "a/x.json", "body_conserved": 99.9, "passed": False}, {"name": "", "passed": True}]}))
    conserved = reports.read_conservation(spark, str(tmp_path / "c"))
    assert [(r.edition, r.body_conserved, r.gate_ok) for r in conserved.collect()] == [("x", 99.9, False)]
    versions = spark.createDataFrame([(1, "x")], "document_id long, edition string")
    found, unknown = reports.metrics(reports.read_invariants(spark, str(tmp_path / "many")), conserved, versions)
    assert [(r.document_id, r.gate_ok, r.cases_total) for r in found.collect()] == [(1, False, 1)] and [r.edition for r in unknown.collect()] == ["y"]


def test_proposals(spark):
    ship(spark)
    columns = "document string, section_id long, html string, plain_text string, start_page int, end_page int, footnotes array<struct<marker:string,text:string,html:string>>"
    old = spark.createDataFrame([("d", i, "<p>a  b</p>", "a b", 1, 2, [("1", "t", "t")]) for i in range(6)], columns)
    new = [("d", 0, None, None, None, None, None), ("d", 1, "<p>x<script>y</script></p>", "x", 1, 3, None), ("d", 2, "", "", None, None, []), ("d", 3, "<p>c</p>", "d", None, None, [("1", None, "<a onclick=f>")]), ("d", 4, "<p>c</p>", "c", 1, 2, [("1", "u", None)]), ("d", 9, "z", "z", 1, 1, None)]
    got = {}
    for r in I.proposal_issues(spark.createDataFrame(new, columns), old).collect():
        got.setdefault(r.section_id, set()).add(r.code)
    assert got == {0: {"no_change"}, 1: {"unsafe_html", "page_coverage_changed"}, 2: {"empty_body", "footnote_marker_conservation"}, 3: {"html_plain_parity", "unsafe_html", "bad_footnote"}}


def test_sync(spark):
    found = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h"), ("e", None)], "key string, source_hash string")
    stored = spark.createDataFrame([("a", "h", True, "l"), ("b", "h", None, "l"), ("e", None, True, "l")], "key string, source_hash string, usable boolean, lane string")
    assert {tuple(r) for r in I.sync_actions(found, stored).collect()} == {("a", "skipped"), ("b", "updated"), ("c", "created"), ("e", "skipped")}
