"""Formulas, layout, planning and exports on small tables."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import formulas
from docloom.operators import layout, materials


def collect(df):
    return sorted(tuple(r) for r in df.collect())


def test_formula_parser():
    assert formulas.parse("x = a + b*c") == ["eq", ["symbol", "x"], ["add", ["symbol", "a"], ["mul", ["symbol", "b"], ["symbol", "c"]]]]
    assert formulas.parse(r"$\frac{1}{2}x^2$") == ["mul", ["div", ["num", "1"], ["num", "2"]], ["pow", ["symbol", "x"], ["num", "2"]]]
    assert formulas.parse("x²") == formulas.parse("x^{2}") and formulas.parse("-x + |y|")[0] == "add"
    assert formulas.parse("a - b - c") == ["sub", ["sub", ["symbol", "a"], ["symbol", "b"]], ["symbol", "c"]]
    assert formulas.parse(r"\left( a \right)") == ["symbol", "a"] and formulas.parse(r"x\times y") == formulas.parse("x × y")
    for bad in ("", "a +", "(a", "a)", "a # b", "x" * 3000, "(" * 100 + "a" + ")" * 100, "\x00"):
        with pytest.raises(formulas.FormulaError):
            formulas.parse(bad)
    assert formulas.differences(formulas.parse("a^2"), formulas.parse("a^3")) == ["symbol_error", "exponent_error", "structure_error"]
    assert "operator_error" in formulas.differences(formulas.parse("a+b"), formulas.parse("a-b"))
    assert formulas.loose("X plus Y ist gleich 2 mal Z.") == "x+y=2*z" and formulas.loose("x²") == "x^2"


def test_layout(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 5.0, False), (1, 2, 6.0, 0.0, 9.0, 5.0, False), (1, 3, 11.0, 0.0, 14.0, 5.0, False), (1, 4, 90.0, 90.0, 95.0, 95.0, False), (1, 9, 0.0, 0.0, 100.0, 100.0, True)], "page int, path_id int, x0 double, y0 double, x1 double, y1 double, background boolean")
    assert collect(layout.near_groups(boxes, 2.0)) == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 4), (1, 9, 9)]
    others = spark.createDataFrame([(1, 70, 0.0, 0.0, 1.0, 1.0), (1, 71, 0.0, 0.0, 4.0, 4.0)], "page int, span int, x0 double, y0 double, x1 double, y1 double")
    assert collect(layout.best_overlap(boxes.where("path_id < 3"), others, "path_id", "span")) == [(1, 71, 16.0)]
    lines = spark.createDataFrame([(1, 0, "An open line", 0.0, 10.0), (1, 1, "ends here.", 11.0, 21.0), (1, 2, "Next one.", 60.0, 70.0), (1, 3, "1. numbered", 71.0, 81.0)], "page int, line int, text string, y0 double, y1 double")
    assert [r.paragraph for r in layout.paragraphs(lines, 12.0).orderBy("line").collect()] == [1, 1, 2, 3]
    cut = spark.createDataFrame([("d", 0, "Donau-"), ("d", 1, "dampfer und Vor-"), ("d", 2, "und Nachname"), ("d", 3, "end")], "d string, line long, text string")
    assert [r.text for r in layout.joined_hyphens(cut, "d", ("und",)).orderBy("line").collect()] == ["Donaudampfer und Vor- und Nachname", "end"]
    one = spark.range(1)
    assert one.select(layout.heading_score(F.lit(20.0), F.lit(10.0), F.lit(True), F.lit("2.1 Title"))).first()[0] == 5
    assert one.select(layout.contents_line(F.lit("Intro ...... 12"))).first()[0] and one.select(layout.margin_line(F.lit(0.99), F.lit("12"))).first()[0]
    classes = spark.createDataFrame([(1, 0, "Title", 5, False, False), (1, 1, "- item", 0, False, False), (1, 2, "goes on", 1, False, False), (1, 3, "12", 0, True, False), (1, 4, "Text.", 1, False, False)], "page long, line long, text string, score int, margin boolean, contents boolean")
    assert [r["class"] for r in layout.line_classes(classes).orderBy("line").collect()] == ["heading", "bullet", "bullet", "margin", "body"]


def test_exports(spark):
    assert [materials.url_problem(u) for u in ("https://e.org/a", "http://e.org", "https://u:p@e.org/", "https://127.0.0.1/", "https://e.org/?token=1", "https://host/", "https://e.org/../a", None)] == [None, "scheme", "credentials", "host", "credentials", "host", "path", "missing"]
    claims = spark.createDataFrame([(1, "t", "https://e.org/a"), (2, "t", "http://e.org/a"), (3, "t", "https://e.org/b")], "claim_id int, text string, url string")
    approved = spark.createDataFrame([("https://e.org/a",), ("http://e.org/a",)], "url string")
    assert {r.claim_id: (r.url, r.withheld) for r in materials.published(claims, approved).collect()} == {1: ("https://e.org/a", None), 2: (None, "scheme"), 3: (None, "not_approved")}
    pick = lambda c: spark.range(1).select(c).first()[0]
    assert [pick(materials.image_safety(F.lit(s)))["status"] for s in ("i.png", "data:x", "https://e/i", "../i")] == ["ok", "rejected", "external", "rejected"]
    assert tuple(pick(materials.title_parts(F.lit("3.2_Linear_Maps")))) == ("3.2", "Linear Maps") and pick(materials.breadcrumb(F.array(F.lit(" a "), F.lit(""), F.lit("b")))) == "a > b"
    assert pick(materials.matching_key(F.lit("Straße,  X!"))) == "strasse x" and pick(materials.clean_token(F.lit("﻿ ﬁ "))) == "fi"
    assert pick(materials.text_similarity(F.lit("abcd"), F.lit("bcde"))) == 0.75 and pick(materials.text_similarity(F.lit(""), F.lit("x"))) == 0.0
    assert materials.signature(b"k", "a", "m") != materials.signature(b"k", "b", "m")
    assert pick(materials.nearest_role(F.array(F.lit("slides"), F.lit("x"), F.lit("notes"), F.lit("y")), ("slides", "notes"))) == "notes"
    assert tuple(pick(materials.video_kind(F.lit("Grundlagen Block 3")))) == ("foundation", "3")
    assert pick(materials.official_subtitle(F.lit("https://e.org/a.srt"), F.array(F.lit("s")), F.array(F.lit("s")), F.lit("p"), F.array(F.lit("p"))))
    assert pick(materials.expression_verdict(F.lit(True), F.lit(True), F.lit(0.9))) == "accepted" and pick(materials.issue_category(F.lit("latex_braces"))) == "formula"
    assert pick(formulas.repaired_escapes(F.lit("\times \frac"))) == r"\times \frac"


def test_planning(spark):
    files = spark.createDataFrame([("a_001.pdf", None), ("b_002.pdf", "u2"), ("c_003.pdf", "old"), ("d.pdf", None)], "name string, url string")
    urls = spark.createDataFrame([("001", "u1"), ("002", "u2"), ("003", "u3")], "index string, url string")
    assert {r.name[0]: (r.url, r.state) for r in materials.urls_by_index(files, urls).collect()} == {"a": ("u1", "new"), "b": ("u2", "same"), "c": ("old", "kept"), "d": (None, "missing")}
    actions = materials.required_actions(spark.createDataFrame([("a",), ("b",), ("c",)], "resource_id string"), spark.createDataFrame([("a.txt", "transcript"), ("b.mp4", "video")], "name string, kind string"))
    assert dict(collect(actions)) == {"a": "none", "b": "extract_audio", "c": "download"}
    docs = spark.createDataFrame([("d", True, "completed", True), ("e", True, "running", True), ("f", True, "completed", True)], "document_id string, available boolean, status string, verified boolean")
    blocks = spark.createDataFrame([("d", "primary", "x"), ("f", "primary", " ")], "document_id string, role string, text string")
    assert [r.document_id for r in materials.eligible(docs, blocks).collect()] == ["d"]
    b = spark.createDataFrame([("1", "paragraph", "abc"), ("2", "image", ""), ("3", "paragraph", "xyz")], "block_id string, type string, text string")
    got = {r.block_id: (r.role, r.intervals and [tuple(i) for i in r.intervals]) for r in materials.primary_intervals(b, spark.createDataFrame([("3", 1, 2)], "block_id string, start long, end long")).collect()}
    assert got == {"1": ("primary", [(0, 3)]), "2": ("reference", None), "3": ("selected", [(1, 2)])}
    records = spark.createDataFrame([("r", 1, 0, 10)], "record_id string, version int, start int, end int")
    hits = spark.createDataFrame([("h", "r", 1, 0, 5), ("i", "r", 2, 0, 50), ("j", "q", 1, 0, 1)], "hit_id string, record_id string, version int, start int, end int")
    assert {r.hit_id: r.problems for r in materials.hit_problems(hits, records).collect()} == {"h": [], "i": ["version", "window"], "j": ["missing"]}
    ledger = spark.createDataFrame([("e", 1, "q1", "v")], "entity string, revision int, request string, value string")
    entries = spark.createDataFrame([("e", 2, "q2", "w"), ("e", 1, "q1", "v"), ("e", 5, "q3", "x"), ("f", 1, "q1", "z")], ledger.schema)
    assert [r.state for r in materials.appended(ledger, entries).orderBy("request", "entity").collect()] == ["replayed", "accepted", "accepted", "conflict"]
    with pytest.raises(ValueError):
        materials.cursor_page(spark.createDataFrame([(1,)], "rank int"), "f", ("g", 0, 0.0), 1.0, 5)
    assert materials.cursor_page(spark.createDataFrame([(1,), (2,)], "rank int"), "f", ("f", 1, 0.0), 1.0, 5).count() == 1
    plan = materials.planned_within(spark.createDataFrame([("c", 1, 6.0), ("c", 2, 5.0), ("d", 1, 9.0)], "course_id string, n int, size double"), "n", "size", 10.0)
    assert [r.planned for r in plan.orderBy("course_id", "n").collect()] == [True, False, True]
    items = spark.createDataFrame([("i", [("r", "s")]), ("j", [("r", "x"), ("q", "s")])], "item_id string, evidence array<struct<record_id:string,sha:string>>")
    assert collect(materials.index_items(items, spark.createDataFrame([("r", "s")], "record_id string, sha string"))) == [("i", 1, True), ("j", 1, False)]
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id int, leader int")
    assert collect(materials.merged_clusters(clusters, spark.createDataFrame([(1, "a"), (2, "bb"), (3, "c")], "id int, text string"))) == [(1, 2, "bb"), (3, 3, "c")]
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    runs = spark.createDataFrame([("a", "running", "2024-01-01 00:00:00", "g"), ("b", "running", "2024-01-01 00:00:00", None), ("c", "running", "2024-01-01 00:59:59", None), ("d", "done", "2024-01-01 00:00:00", None)], "run_id string, state string, heartbeat string, generation string")
    assert dict(collect(materials.recovery(runs.withColumn("heartbeat", F.col("heartbeat").cast("timestamp")), now, 60))) == {"a": "resume", "b": "abandon", "c": "wait", "d": "none"}
    sources = spark.createDataFrame([("s1", '{"source_type":"video"}'), ("s2", '{"source_type":"pdf"}')], "source_id string, data string")
    assert [r.source_id for r in materials.source_page(sources, "video", "s").collect()] == ["s1"]
    kept = materials.kept_statements(spark.createDataFrame([("a", True, "verified"), (" ", False, "verified")], "text string, visual boolean, status string"))
    assert [(r.text, r.status) for r in kept.collect()] == [("a", "pending")]
    lectures = spark.createDataFrame([("l",), ("m",), ("n",)], "lecture_id string")
    audits = spark.createDataFrame([("l", "passed"), ("m", "failed"), ("n", "passed")], "lecture_id string, status string")
    assert collect(materials.handoff(lectures, audits, spark.createDataFrame([("l",)], "lecture_id string"))) == [("l",)]


def test_token_windows_cover_the_text(spark):
    text = "one two, three four five. six seven"
    rows = materials.token_windows(spark.createDataFrame([(1, text), (2, "..."), (3, " ")], "id int, text string"), "text", 5).orderBy("id", "chunk").collect()
    parts = [text[r.start : r.end] for r in rows if r.id == 1]
    assert "".join(parts) == text and parts[0].strip() == "one two," and [(r.start, r.end) for r in rows if r.id == 3] == [(0, 1)]
