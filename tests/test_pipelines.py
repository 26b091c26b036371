"""Composed operators, word-processor files, saved pages and configuration."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators import pipelines
from docloom.sources import office, parse


def docx(body):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return buffer.getvalue()


def test_docx():
    paragraph = lambda text, extra="": f"<w:p><w:pPr>{extra}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    data = docx(
        paragraph("Title", '<w:pStyle w:val="Heading1"/>') + paragraph("Body") + paragraph("item", "<w:numPr/>") + paragraph(" ")
        + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    )
    assert [(b[1], b[2], b[4]) for b in office.docx_blocks(data)] == [("heading", 1, "Title"), ("paragraph", 0, "Body"), ("list_item", 0, "item"), ("table", 0, "a | b")]
    assert next(office.docx_blocks(b"no"))[1] == "error" and next(office.docx_blocks(docx("<x")))[1] == "error"


def test_discovery_and_kinds(spark):
    page = "<h1>Week 1</h1><ul><li><a href='/a.pdf'>Slides</a></li></ul><h1>Week 2</h1><a href='/b.mp4'>Video</a>"
    rows = office.discovered(spark.createDataFrame([(1, page)], "page_id long, html string"), "page_id", "html").orderBy("ordinal").collect()
    assert [(r.section, r.title, r.url) for r in rows] == [("Week 1", "Slides", "/a.pdf"), ("Week 2", "Video", "/b.mp4")]
    texts = spark.createDataFrame([("int x = f(1);", 0.9, 10.0), ("a = b + c", 0.0, 10.0), ("Title", 0.0, 15.0), ("A sentence with many longer words.", 0.0, 10.0)], "t string, m double, s double").coalesce(1)
    assert [r.k for r in texts.select(office.text_kind(F.col("t"), F.col("m"), F.col("s"), F.lit(10.0)).alias("k")).collect()] == ["code", "math", "heading", "paragraph"]


def test_config():
    assert office.config('{"a": 1}') == {"a": 1}
    assert office.config("a: 1\nb: x # note\nc: true\nd: -2.5\n# no\ne:\n") == {"a": 1, "b": "x", "c": True, "d": -2.5, "e": None}
    for bad in ("[1]", "a:\n  b: 1", "nothing"):
        with pytest.raises(ValueError):
            office.config(bad)


def test_document_text(spark):
    words = [("d", 1, 0.0, 0.0, 9.0, 10.0, "A"), ("d", 1, 10.0, 0.3, 19.0, 10.0, "hyphen-"), ("d", 1, 0.0, 12.0, 9.0, 22.0, "ated"), ("d", 1, 10.0, 12.0, 19.0, 22.0, "word."), ("d", 1, 0.0, 60.0, 9.0, 70.0, "New."), ("d", 2, 0.0, 0.0, 9.0, 10.0, "Next")]
    got = pipelines.document_text(spark.createDataFrame(words, "doc_id string, page int, x double, y double, x_end double, y_end double, text string"))
    assert got.first().text == "A hyphenated word.\n\nNew.\n\nNext"


def test_canonical_items(spark):
    items = spark.createDataFrame([("1", "t", "pending", ["e"]), ("2", "", "pending", [])], "item_id string, text string, status string, expressions array<string>")
    evidence = spark.createDataFrame([("1", "s", "c", 1, 0.0, 1.0, "t", "support", 0.7, 1), ("1", "s", "c", 1, 0.0, 1.0, "t", "support", 0.9, 2)], "item_id string, source_id string, chunk_id string, segment_id long, start double, end double, kind string, relation string, confidence double, ordinal long")
    checks = spark.createDataFrame([("e", "verified", 1)], "expression_id string, status string, ordinal long")
    got = {r.item_id: (r.status, r.confidence, r.evidence_count, r.codes) for r in pipelines.canonical_items(items, evidence, checks).collect()}
    assert got["1"] == ("verified", 0.7, 1, []) and got["2"][3] == ["no_text", "no_evidence", "confidence_range"]


def test_projection_audit(spark):
    blocks = spark.createDataFrame([(1, "link", 0, "x", None), (1, "list_item", 1, "y", None), (2, "heading", 1, " ", None)], "page_id long, kind string, level long, text string, href string")
    parts = spark.createDataFrame([(1, 0, 5, 10), (1, 5, 10, 10), (2, 0, 5, 10)], "page_id long, start int, end int, length int")
    assert sorted((r.page_id, r.code) for r in pipelines.projection_audit(blocks, parts).collect()) == [(1, "link_target"), (2, "coverage"), (2, "empty_heading")]


def test_workflows(spark):
    stages = spark.createDataFrame([("a", [], "1"), ("b", ["a"], "2"), ("c", [], "1")], "stage_id string, after array<string>, config_hash string")
    done = spark.createDataFrame([("a", "0"), ("b", "2"), ("c", "1")], "stage_id string, config_hash string")
    ran = []
    receipts = pipelines.run_to_end(stages, done, ran.append)
    assert ran == ["a", "b"] and {r.stage_id: r.config_hash for r in receipts.collect()} == {"a": "1", "b": "2", "c": "1"}
    again = []
    pipelines.run_to_end(stages, receipts, again.append)
    assert again == []
    numbers = spark.createDataFrame([(5,), (3,)], "n int")
    assert {r.n for r in pipelines.until_stable(numbers, lambda df: df.select(F.greatest(F.col("n") - 1, F.lit(0)).cast("int").alias("n"))).collect()} == {0}
    with pytest.raises(RuntimeError):
        pipelines.until_stable(numbers, lambda df: df.select((F.col("n") + 1).alias("n")), 3)


def test_stores_and_times(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "t", ["a", "b"], None)], "id int, text string, tags array<string>, lang string")
    row = pipelines.chunk_store(chunks, "id", "text", ["tags", "lang"]).first()
    assert row.metadata == {"tags": "a,b"} and row.id == "1"
    times = spark.createDataFrame([("2024-01-02",), ("03.02.2024",), (None,)], "t string").coalesce(1)
    assert [r.x and r.x.isoformat() for r in times.select(pipelines.parsed_times(F.col("t")).alias("x")).collect()] == ["2024-01-02T00:00:00", "2024-02-03T00:00:00", None]
    with pytest.raises(Exception, match="no time"):
        spark.createDataFrame([("soon",)], "t string").select(pipelines.parsed_times(F.col("t"))).collect()
    metrics = spark.createDataFrame([(i, "a|b" if i % 2 else None) for i in range(2500)], "n long, t string")
    manifest = {r.part: r.rows for r in pipelines.write_report(metrics, f"{tmp_path}/report", "R").collect()}
    assert manifest == {"metrics": 2500, "report": 2504}
    lines = [r.value for r in spark.read.text(f"{tmp_path}/report/report").collect()]
    assert {"# R", "| n | t |", "|-|-|", r"| 1 | a\|b |", "| 2 |  |"} <= set(lines)
    assert list(parse.text_blocks("a\n\n\nb"))[1][4] == "b"
