"""Functions, geometry, invariants, merging, files and streams on small fixtures."""

import json

from pyspark.sql import functions as F

from statuta import catalog
from statuta.functions import python as P
from statuta.functions import text as T
from statuta.operators import detectors, geometry, invariants, merge, relations
from statuta.sources import files
from statuta.streaming import findings as S
from tests.conftest import SF


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_families(spark):
    names = {
        "Income Tax Rules 2002 updated upto 2014": "income tax rules, 2002", "Sales Tax Special Procedure (Withholding) Rules, 2007": "sales tax special procedure (withholding) rules, 2007", "Customs Act, 1969 (as amended upto 30.06.2020)": "customs act, 1969",
        "Finance Act, 2019": "finance act", "The Benami Transactions Act, 2017": "benami transactions act, 2017", "": "unknown", "Federal Excise Act 2005 - amended upto 2021": "federal excise act, 2005",
    }
    rows = spark.createDataFrame(list(names.items()), "name string, want string").select("name", "want", T.portal_family_key(F.col("name")).alias("got")).collect()
    assert [(r.name, r.got) for r in rows] == [(r.name, r.want) for r in rows]
    assert one(spark, T.family_key(F.lit("Customs Act, 1969 amended"))) == "customs act"
    assert one(spark, T.family_title(F.lit("finance act"))) == "Finance act"


def test_lanes(spark):
    cases = [("Federal Excise Rules 2005", "acts_corpus", None, "federal_excise_rules"), ("Export Regulations", "acts_corpus", "acts", "other_acts"), ("Anything", "upload", None, "manual"), ("x", "acts_corpus", "ordinance", "ordinance"), ("", "acts_corpus", None, "other_acts"), ("Tax Laws (Second Amendment) Act", "acts_corpus", None, "tax_laws_amendment")]
    rows = spark.createDataFrame(cases, "name string, kind string, origin string, want string").select("want", T.lane(F.col("name"), F.col("kind"), F.col("origin")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_order_of_codes_and_markers(spark):
    codes = ["5", "4B", "4AB", "4", "221-A", "4A", "odd", "221"]
    rows = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [r.c for r in rows.orderBy(T.code_sort_key(F.col("c"))).collect()] == ["4", "4A", "4AB", "4B", "5", "221", "221-A", "odd"]
    markers = ["36b", "*", "100", "36", "9", "36a"]
    rows = spark.createDataFrame([(c,) for c in markers], "c string")
    assert [r.c for r in rows.orderBy(T.marker_sort_key(F.col("c"))).collect()] == ["*", "9", "36", "36a", "36b", "100"]
    assert one(spark, T.is_year_like(F.lit("1990"))) and not one(spark, T.is_year_like(F.lit("263"))) and not one(spark, T.is_year_like(F.lit("1990a")))
    assert one(spark, T.norm_code(F.lit("14.A"))) == "14A" and one(spark, T.page_num(F.lit("1 2-29"))) == 12


def test_flags(spark):
    none = F.lit(None).cast("int")
    flags = lambda html, plain, heading="", s=none, e=none, t=none: one(spark, T.quality_flags(F.lit(html), F.lit(plain), F.lit(heading), s, e, t))
    assert flags("<p>x</p>", "see Table here") == ["missing_table"]
    assert flags("<table><tr></tr></table>", "see Table here") == []
    assert flags("<p>x</p>", "estimates7 are") == ["footnote_glue"] and flags("<sup>7</sup>", "estimates7 are") == []
    assert flags("<h4>x</h4>", "a " * 500) == ["wall_of_text"]
    assert flags("<p></p>", "x", "One. Two. Three") == ["heading_body_bleed"]
    assert flags("<p></p>", "x", "h", F.lit(1995), F.lit(1995), F.lit(291)) == ["page_range_out_of_bounds"]


def test_snippet_and_terms(spark):
    s = one(spark, T.snippet(F.lit("a" * 60 + "Needle" + "b" * 100 + "needle"), "needle"))
    assert s.matches == 2 and s.snippet == "…" + "a" * 50 + "Needle" + "b" * 70 + "…"
    assert one(spark, T.snippet(F.lit("x" * 120), "q")).snippet == "x" * 100 + "…"
    assert T.search_terms("Tax* & (rate)") == ["tax", "rate"]


def test_python_functions(spark):
    parts = lambda h: tuple(P.clean(h)[k] for k in ("html", "text", "changed"))
    assert parts("<p onclick='x'>a &amp; b<script>evil()</script></p>") == ("<p>a &amp; b</p>", "a & b", True)
    assert parts('<p class="cite">ok<br></p>') == ('<p class="cite">ok<br></p>', "ok", False)
    made = P.clean('<td rowspan="2" style="FLEX: 0 0 12.5%; font-weight:700" class="odd frac" href="x">1<font>2</font><!-- c --></td>')
    assert made["html"] == '<td rowspan="2" style="flex:0 0 12.5%" class="crx-bold frac">12</td>' and made["text_fidelity"] and made["structure_fidelity"]
    assert made["diagnostics"] == ["converted_style:td", "dropped_class:td", "dropped_attr:td.href", "unwrapped_tag:font", "dropped_comment"] and made["signature"] == "td rowspan=2"
    assert not P.clean("<ul><li>a</li></ul><svg><li>b</li></svg>")["structure_fidelity"] and P.clean("<svg>b</svg>a")["text_fidelity"]
    assert [P.style_class("margin-left", v) for v in ("40px", "6pt", "9em", "1ex")] == ["crx-indent-2", "crx-indent-1", "crx-indent-4", None]
    assert [P.from_roman(P.roman(n)) for n in (1, 4, 9, 14, 40, 90, 444, 1999)] == [1, 4, 9, 14, 40, 90, 444, 1999] and P.from_roman("AB") is None
    rows = spark.createDataFrame([("ﬁne", "a\nb", "a\nc")], "t string, o string, n string").select(P.nfkc("t").alias("t"), P.text_diff("o", "n").alias("d")).first()
    assert rows.t == "fine" and "-b" in rows.d and "+c" in rows.d


def test_reanchoring(spark):
    found = lambda *a: tuple(one(spark, T.reanchored(*map(F.lit, a))))
    assert found("xx foo yy", "foo", 3, 6, "", "") == (3, 6, "anchored", T.SAME_PLACE)
    assert found("xx foo yy", "foo", 0, 3, "", "") == (3, 6, "anchored", T.ONE_MATCH)
    assert found("foo one foo two", "foo", 9, 12, "one ", " two") == (8, 11, "anchored", T.BY_CONTEXT)
    assert found("foo foo", "foo", 9, 12, "", "") == (9, 12, "needs_recheck", "2" + T.NO_CONTEXT)
    assert found("foo foo foo", "foo", 9, 12, "z", "q") == (9, 12, "needs_recheck", "3" + T.UNDECIDED)
    assert found("aaaa", "aa", 9, 11, "x", "") == (9, 11, "needs_recheck", "3" + T.UNDECIDED)
    assert found("a", "b", 0, 1, "", "")[3] == T.GONE and found(None, "b", 0, 1, "", "")[3] == T.GONE and found("a", "", 0, 0, "", "")[3] == T.NO_QUOTE


def test_geometry(spark):
    assert geometry.group_lines([10, 11, 30, 12.5, 31]) == [0, 0, 1, 0, 1]
    w = lambda text, x0, x1, top=10.0, size=10.0: {"text": text, "x0": x0, "x1": x1, "top": top, "size": size}
    assert [x["text"] for x in geometry.merge_split_words([w("sec", 0, 10), w("tion", 10.2, 30), w("21", 40, 50), w("st", 50.5, 55, 8.0, 6.0)])] == ["section", "21st"]
    assert geometry.join_words([w("a", 0, 5), w("b", 9, 12), w("c", 13, 15)]) == "a bc"
    assert geometry.zone_top([10, 10, 8, 8], 9) == 2 and geometry.zone_top([10, 10], 9) is None
    notes = geometry.parse_footnotes(["goes on", "1. First note", "continued", "1990 was a year", "2 to be folded", "3 Third"])
    assert notes == [(None, "goes on"), ("1", "First note continued 1990 was a year 2 to be folded"), ("3", "Third")]
    assert geometry.valleys([[(0, 10), (30, 40)]] * 10) == [(11, 30)]
    assert geometry.normalize_grid([["a", None, "b"], ["c", "", ""]]) == [["a", "b"], ["c", ""]]
    assert geometry.header_rows([["x", "y"], ["(1)", "(2)"], ["1.", "z"]]) == 2 and geometry.header_rows([["1.", "z"]]) == 0 and geometry.header_rows([["h"], ["1."]]) == 1
    toc = geometry.parse_toc(["CHAPTER I PRELIMINARY", "1. Short title ........ 5", "4 A. Long name that", "goes on 12", "THE FIRST SCHEDULE", "PART I Rates"])
    assert [(r["kind"], r["code"], r["page"]) for r in toc] == [("chapter", "I", None), ("section", "1", 5), ("section", "4A", 12), ("schedule", "FIRST", None), ("part", "I", None)]
    assert geometry.match_sections([("1", 5), ("2", 8), ("9", 9)], [("1", 6), ("2", 3), ("2", 12)]) == [0, 2, None]
    assert [t["agree"] for t in geometry.align_tokens([("tax", 90.0), ("rnte", 40.0)], [("Tax", 80.0), ("rate", 95.0)])] == [True, False]
    assert geometry.chapter_value("XIV") == 14 and geometry.chapter_value("7") == 7


LEAF = "document string, section_id long, code string, heading string, hierarchy_kind string, chapter_code string, part_code string, division_code string, start_page int, end_page int, plain_text string, html string, sort_order int"


def test_invariants(spark):
    texts = ["glued a7[ here", "12\n[text", "exam- ple and example", "THEshallwhichthatwithunderforthis", "PART I", "fine", "ends here. 13", ".25"]
    leaf = spark.createDataFrame([("d", i, str(9 - i), "Some heading", "chapter", "I", None, None, 13, 14, t, "<strong>x" if i == 5 else "<p>x</p>", i) for i, t in enumerate(texts)], LEAF)
    note = spark.createDataFrame([("d", 0, 0, "3.1990", "1990", 3, "t 30 th June", "h"), ("d", 0, 1, "bad", "2", 3, "t", "h"), ("d", 0, 2, "3.1", "1", 3, None, "h")], "document string, section_id long, idx int, ref string, marker string, page int, text string, html string")
    doc = spark.createDataFrame([("d", 100, 7, None, "none")], "document string, total_pages int, sections_count int, preamble string, zone_mode string")
    found = invariants.violations(leaf, note, doc)
    by = {(r.invariant, r.subject) for r in found.collect()}
    for want in (("no_glued_marker_digit", "0"), ("no_bare_footnote_marker_line", "1"), ("no_stray_space_hyphen", "2"), ("no_jammed_words", "3"), ("no_structural_heading_in_body", "4"), ("strong_balanced", "5"), ("no_page_number_bleed", "6"), ("no_stray_dotnumber", "7"), ("section_codes_ordered", "1"), ("footnote_schema", "0"), ("footnote_refs_printed_page", "0"), ("no_year_marker_refs", "0"), ("footnotes_in_numeric_order", "0"), ("no_orphan_sections", "d"), ("text_density_plausible", "d"), ("zone_mode_none_has_no_footnotes", "d"), ("clause_codes_plausible", "0")):
        assert want in by, want
    assert [r.evidence for r in found.filter("invariant = 'no_split_ordinals'").collect()] == ["3.1990"]
    assert invariants.report(found).filter("invariant = 'no_jammed_words'").first().subjects == ["3"]


def test_merge(spark):
    stored = spark.createDataFrame([("a", "1", "approved", "x"), ("b", "2", "approved", "y"), ("c", "3", "pending", "z"), ("e", "5", "approved", "w")], "source_key string, sha string, status string, plain_text string")
    parsed = spark.createDataFrame([("a", "1", "x"), ("b", "9", "yy"), ("d", "4", "n")], "source_key string, sha string, plain_text string")
    out = {r.source_key: (r.change, r.status) for r in merge.merge_parsed(stored, parsed).collect()}
    assert out == {"a": ("unchanged", "approved"), "b": ("changed", "pending"), "c": ("removed", "removed"), "d": ("added", "pending"), "e": ("removed", "orphaned")}
    report = merge.carry_over_report(merge.merge_parsed(stored, parsed)).first()
    assert (report.added, report.approvals_reset, report.orphaned) == (1, 1, 1)
    metrics = spark.createDataFrame([(99.995, 100.0, 0), (99.0, 100.0, 0), (None, None, None), (None, None, 2)], "conserved double, notes_conserved double, failing int")
    assert [r.health for r in merge.gate(metrics).collect()] == ["within_gate", "outside_gate", "unmeasured", "outside_gate"]


def test_intervals_and_bands(spark):
    points = spark.createDataFrame([(1, 5), (2, 50), (3, 12)], "id long, p long")
    spans = spark.createDataFrame([(10, 0, 9), (11, 4, 20), (12, 5, 5)], "leaf long, a long, b long")
    got = {r.id: r.hit.leaf if r.hit else None for r in relations.point_in_interval(points, spans, "id", "p", "a", "b", ["a", "b", "leaf"], 4).collect()}
    assert got == {1: 10, 2: None, 3: 11}


def test_upper_median(spark):
    leaves = spark.createDataFrame([(i, "f", "c", i, "x" * n) for i, n in enumerate([100, 100, 60, 5])], "section_id long, family_key string, section_code string, edition long, plain_text string")
    assert [r.section_id for r in detectors.short_vs_siblings(leaves, ["family_key"]).collect()] == [3]


def test_files(spark, tmp_path):
    folder = tmp_path / "act"
    folder.mkdir()
    (folder / "act.pdf").write_bytes(b"%PDF-1.4 x")
    (folder / "note.pdf").write_bytes(b"not one")
    section = {"code": "1", "heading": "h", "start_page": 4, "plain_text": "t", "footnotes": [{"ref": "1.1", "marker": "1"}]}
    tree = {"metadata": {"filename": "act.pdf", "total_pages": 3}, "chapters": [{"code": "I", "sections": [section], "parts": [{"code": "P", "sections": [section | {"start_page": 0, "page_number": 2}]}]}], "schedules": [{"code": "S", "divisions": [{"code": "D", "sections": [section | {"start_page": None}]}]}]}
    (folder / "act.json").write_text(json.dumps(tree))
    listing = files.pdf_files(spark, str(folder))
    assert {r.path.rsplit("/", 1)[1]: r.is_pdf for r in listing.collect()} == {"act.pdf": True, "note.pdf": False, "act.json": False}
    assert files.pair_directories(listing).first().is_pair
    leaves = files.flatten(files.read_documents(spark, str(folder / "act.json"))).orderBy("sort_order").collect()
    assert [(r.hierarchy_kind, r.part_code, r.division_code, r.start_page) for r in leaves] == [("schedule", None, "D", None), ("chapter", "P", None, 2), ("chapter", None, None, 4)]
    (tmp_path / "r.md").write_text("# x\n| 3 | 10 | 20 | teh | 40.5 | the | 91 | the |\n|---|\n")
    row = files.read_ocr_report(spark, str(tmp_path / "r.md")).first()
    assert (row.page, row.tesseract, row.rapid_conf, row.accepted) == (3, "teh", 91.0, "the")
    assert [r.value for r in files.prometheus_lines(spark.createDataFrame([("done", 3)], "state string, n long"), "jobs", "state").collect()] == ['jobs{state="done"} 3']


def test_streams(spark, tmp_path):
    limited = S.run_to_end(S.rate_limited(S.event_stream(spark, SF), 2, 3600), str(tmp_path / "c"))
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert limited.count() == n
    seen = []
    S.write_batches(S.event_stream(spark, SF).select("event_id"), lambda df, k: seen.append(df.count()), str(tmp_path / "d"))
    assert sum(seen) == n


def test_signs_hide_no_violation(spark):
    odd = ["x2[a", "é1999[ 19990[", "", "\n.12 b", "a\r.123", ".12", "9.12\n.1", "21 st", "a1 nd é", "3 rds", "\x0bx", "é\x1f", "x THE Following table was Substituted", "table was said", "café 12", "", None]
    odd += ["12 \n[a", " 3* \n\n Was omitted", "3\n Word substituted", "4\r\n[x", "[4\n", "and the of andtheofsuchwhichthatwith x", "éandtheofsuchwhichthatwithx", "ab- cd abcd", "ab - cd", "A B C abc abc abc abc abc", "xA B C é", "PART 2\n“\nPART 3", "(part iv)\nPART IV", "a “\nCHAPTER I", "x. 12 \ny, 13", "rs. 12\n;— 11 ", "12, 11"]
    leaf = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "section_id long, plain_text string").selectExpr("'d' document", "section_id", "plain_text", "string(null) html", "plain_text heading", "10 start_page", "14 end_page")
    x = F.coalesce("plain_text", F.lit(""))
    for name, e in invariants.by_pattern().items():
        columns, pattern = invariants.LEAF_PATTERNS[name]
        if "plain_text" in columns:
            assert leaf.filter(~e.eqNullSafe(F.nullif(F.regexp_extract(x, f"({pattern})", 1), F.lit("")))).collect() == []
    hits = {h.__name__: sorted((r.section_id, r.v.invariant, r.v.evidence) for r in leaf.select("section_id", F.explode(h()).alias("v")).collect() if r.v) for h in invariants.HITS}
    at = odd.index("12 \n[a")
    assert hits["bare_marker_lines"] == [(at, "no_bare_footnote_marker_line", "12 "), (at + 2, "no_footnote_note_in_body", " Word substituted"), (at + 3, "no_bare_footnote_marker_line", "4\r")]
    assert [h[0] for h in hits["jammed_words"]] == [at + 5, at + 6]
    assert [(h[0], h[2]) for h in hits["structural_hits"]] == [(odd.index("PART 2\n“\nPART 3"), "PART 2"), (odd.index("(part iv)\nPART IV"), "PART IV")]
    assert [(odd[h[0]], h[2]) for h in hits["page_number_bleed"] if h[0] >= len(odd) - 3] == [("x. 12 \ny, 13", "x. 12 "), ("x. 12 \ny, 13", "y, 13"), ("rs. 12\n;— 11 ", ";— 11 "), ("12, 11", "12, 11")]
    rows = leaf.select("document", "section_id", invariants.words_cut().alias("cut"), invariants.words_spaced().alias("spaced"))
    assert sorted((r.subject, r.invariant, r.evidence) for r in invariants.joined_words(leaf, rows).collect()) == sorted([(str(odd.index("ab- cd abcd")), "no_stray_space_hyphen", "ab- cd"), (str(odd.index("A B C abc abc abc abc abc")), "no_glyph_spaced_cell", "A B C")])


def test_invariants_read_texts_before_they_are_joined(spark):
    plan = catalog.queries()["invariants_report"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "text:string" not in plan  # texts were read once and cut off; each invariant read them, and twice, before
