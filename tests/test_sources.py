"""Parsers, scans, sinks and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.sources import parse, sinks, tables
from docloom.streaming import events as stream


def test_html_blocks():
    page = '<body><h2>T</h2><ul><li>one <a href="/x">link</a><ul><li>deep</ul><li>two</ul><pre>a\n  b</pre><p>x<br>y<p>z &amp; w<script>no</script><img src="i.png" alt="pic"></body>'
    got = [(b[1], b[2], b[4], b[5]) for b in parse.html_blocks(page)]
    assert ("heading", 2, "T", None) in got and ("link", 1 * 0, "link", "/x") in got and ("list_item", 2, "deep", None) in got
    assert ("code", 0, "a\n  b", None) in got and ("paragraph", 0, "z & w", None) in got and ("image", 0, "pic", "i.png") in got
    assert ("list_item", 1, "one link", None) in got and not any("no" in b[2] for b in got)


def test_subtitles():
    srt = "1\n00:00:01,000 --> 00:00:03,000\nA &amp; <i>b</i>\n\n2\n00:00:02,500 --> 00:00:04,000\nc\nd\n"
    assert list(parse.subtitles(srt)) == [(0, 1.0, 3.0, "A & b"), (1, 2.5, 4.0, "c\nd")]
    vtt = "WEBVTT\n\nNOTE x\n\nSTYLE\n::cue{}\n\nid\n00:01.000 --> 00:02.000 align:start\n<v Bob>hi\n"
    assert list(parse.subtitles(vtt)) == [(0, 1.0, 2.0, "hi")]
    for bad in ("00:00:03,000 --> 00:00:01,000\nx", "00:99:03,000 --> 00:00:01,000\nx", "0:1 --> 0:2\nx"):
        with pytest.raises(ValueError):
            list(parse.subtitles(bad))
    rolling = "00:01.000 --> 00:02.000\na b c\n\n00:02.000 --> 00:03.000\nb c d\n\n00:03.000 --> 00:04.000\nd\n"
    assert [x[3] for x in parse.rolling_subtitles(rolling)] == ["a b c", "d"]
    assert list(parse.plain_transcript("a\n\n b")) == [(0, None, None, "a"), (1, None, None, "b")]


def test_code_markdown_notebook():
    assert list(parse.code_lines("a\r\nb\u2028c")) == [(0, "a\r\n"), (1, "b\u2028"), (2, "c")]
    symbols = list(parse.python_symbols('import os\nfrom a import b\nclass C:\n    "doc"\n    def f(self): pass\n'))
    assert {(s[1], s[2]) for s in symbols} == {("import", "os"), ("import", "a.b"), ("class", "C"), ("function", "f")}
    assert next(parse.python_symbols("def ("))[1] == "error"
    blocks = [(b[1], b[2], b[4]) for b in parse.markdown_blocks("# H\n\ntext\nmore\n- a\n  - b\n> q\n```py\nx = 1\n```\n")]
    assert blocks == [("heading", 1, "H"), ("paragraph", 0, "text more"), ("list_item", 1, "a"), ("list_item", 2, "b"), ("quote", 0, "q"), ("code", 0, "x = 1")]
    book = {"metadata": {"kernelspec": {"language": "python"}}, "cells": [{"cell_type": "markdown", "source": ["a", "b"]}, {"cell_type": "code", "source": "x"}]}
    assert list(parse.notebook_cells(json.dumps(book))) == [(0, "markdown", None, "ab"), (1, "code", "python", "x")]
    assert parse.gutter("1 a\n2 b\n3 c") and not parse.gutter("1 a\n3 b\n4 c") and not parse.gutter("1 a\n2 b")


def test_archives_and_mail():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "x")
        z.writestr("A.TXT", "y")
        z.writestr("../up", "z")
        z.writestr("bomb", "0" * 900_000)
    assert [m[3] for m in parse.zip_members(buffer.getvalue())] == ["ok", "collision", "unsafe_path", "ratio"]
    assert next(parse.zip_members(b"no"))[3] == "not_an_archive"
    raw = b"From: Bob <bob@e.org>\r\nSubject: Hi\r\nDate: Mon, 01 Jan 2024 10:00:00 +0100\r\nContent-Type: text/plain\r\n\r\nsee https://e.org/a. and https://e.org/a,\r\n"
    subject, sender, date, plain, links = next(parse.mail(raw))
    assert (subject, sender, date, links) == ("Hi", "bob@e.org", "2024-01-01T10:00:00+01:00", ["https://e.org/a"]) and plain.startswith("see")
    assert parse.mailbox('(\\HasNoChildren \\Sent) "/" "Sent Items"') == ("Sent Items", "sent")


def test_parsed_runs_on_columns(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "")], "id long, text string")
    assert sorted(tuple(r) for r in parse.parsed(df, parse.code_lines, "text", parse.LINES, ("id",)).collect()) == [(1, 0, "a\n"), (1, 1, "b")]


def test_scans(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes("name;x\nÄ;1,5\nb;2 000,25\n".encode("latin-1"))
    got = tables.french_csv(spark, str(tmp_path / "f.csv"), "name string, x string", ["x"]).collect()
    assert [tuple(r) for r in got] == [("Ä", 1.5), ("b", 2000.25)]
    assert set(tables.csv_files(spark, [str(tmp_path / "f.csv")], sep=";")) == {"f"}
    one = spark.createDataFrame([("1,2,3",), ("4",)], ["a,b"])
    assert [tuple(r) for r in tables.split_single_column(one).collect()] == [("1", "2"), ("4", None)]
    (tmp_path / "g.jsonl").write_text('{"b":1,"a":2}\n\n{"a":1,"a":2}\n{"a":NaN}\n{"a":1e999}\n')
    lines = {r.line: (r.value, r.error is None) for r in tables.json_lines(spark, str(tmp_path / "g.jsonl")).collect()}
    assert lines == {1: ('{"a":2,"b":1}', True), 3: (None, False), 4: (None, False), 5: (None, False)}
    with pytest.raises(ValueError):
        (tmp_path / "h.csv").write_text("x\n1\n")
        tables.delimiter(spark, str(tmp_path / "h.csv"))
    files = spark.createDataFrame([("Übung, 1.pdf",), ("ubung 10.pdf",), ("x.txt",)], ["name"])
    assert tables.find_files(files, "name", "Übung 1").count() == 1 and tables.find_files(files, "name", "ubung 1", exact=False).count() == 2


def test_stores(spark, tmp_path):
    blobs = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b"a"),)], "content binary")
    assert sinks.install(blobs, f"{tmp_path}/blobs") == 2 and sinks.install(blobs, f"{tmp_path}/blobs") == 0
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    assert sinks.register(rows, f"{tmp_path}/reg", ["k"]) == 2 and sinks.register(rows, f"{tmp_path}/reg", ["k"]) == 0
    first = sinks.build_generation(rows, f"{tmp_path}/gen")
    second = sinks.build_generation(rows.limit(1), f"{tmp_path}/gen")
    assert first != second and sinks.active_generation(spark, f"{tmp_path}/gen").count() == 1
    built = []
    build = lambda: built.append(1) or rows
    for _ in range(2):
        assert sinks.cached(spark, f"{tmp_path}/cache", {"a": 1}, build).count() == 3
    assert built == [1]
    sinks.snapshot({"rows": rows}, f"{tmp_path}/snap")
    assert sinks.restored(spark, f"{tmp_path}/snap", "rows").count() == 3
    rows.limit(1).write.mode("append").parquet(f"{tmp_path}/snap/rows")
    with pytest.raises(RuntimeError):
        sinks.restored(spark, f"{tmp_path}/snap", "rows")
    states = sinks.build_states(spark.createDataFrame([("a", True), ("b", True), ("c", False)], "generation string, finished boolean"), "b")
    assert {r.generation: r.state for r in states.collect()} == {"a": "retired", "b": "active", "c": "interrupted"}
    wanted = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0])], "id int, v array<double>")
    stored = spark.createDataFrame([(1, [1.0 + 1e-8]), (2, [2.5])], "id int, v array<double>")
    assert {r.id: r.action for r in sinks.vector_upserts(wanted, stored, "id", "v").collect()} == {1: "keep", 2: "replace", 3: "insert"}
    sample = spark.createDataFrame([("jobs", {"b": 'q"', "a": "1"}, 2.0)], "name string, labels map<string,string>, value double")
    assert sample.select(sinks.exposition(sample)).first()[0] == 'jobs{a="1",b="q\\""} 2.0'
    blocks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "d int, o int, t string")
    assert sinks.assembled(blocks, "d", "o", "t").first().t == "a\n\nb"


def test_streams(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    source = stream.event_stream(spark, f"{tmp_path}/events", events.schema)

    def run(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        query.processAllAvailable()
        query.stop()
        return spark.table(name)

    got = run(stream.windowed(source, "ts", ["event_type"], "value"), "w", "complete")
    want = events.groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert got.count() == want.count() and got.agg(F.sum("n")).first()[0] == events.count()
    jobs = source.select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    states = run(stream.job_states(jobs, "user_id", {"new": ("view",), "view": ("click",)}, "new", ("click",)), "j", "update")
    assert states.select("user_id").distinct().count() == events.select("user_id").distinct().count()
    assert run(stream.first_requests(source, ["user_id"], "ts"), "f", "append").count() <= events.count()
    assert run(stream.sessions(source, "ts", "user_id"), "s", "append").count() >= 0


def test_cells_of_nested_tables(spark):
    page = "<tr><td>lost</td></tr><table><tr><th>a<td>b <table><tr><td>c<td>d<tr><td>e</table> f<tr><td>g</table><td>h<table><td>no row</table>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<p>")], "doc long, html string")
    cells = parse.parsed(pages, parse.html_cells, "html", parse.TABLE_CELLS, ("doc",))
    assert "Exchange" not in cells._jdf.queryExecution().executedPlan().toString()
    found = {r.text: (r.table, r.row, r.column, r.header) for r in cells.collect()}
    outer, inner = found["a"][0], found["c"][0]
    assert outer < inner and found == {"a": (outer, 0, 0, True), "b f": (outer, 0, 1, False), "c": (inner, 0, 0, False), "d": (inner, 0, 1, False), "e": (inner, 1, 0, False), "g": (outer, 1, 0, False)}


def test_parsed_rows_come_in_small_batches():
    """However many rows a batch of texts, or one text, gives."""
    rows = [(1, "x")] * 10_000 + [(2, "y" * 600_000)] * 5 + [(3, None)]
    found = list(parse.batched(iter(rows)))
    assert [r for part in found for r in part] == rows and all(0 < len(part) <= parse.BATCH_ROWS for part in found)
    assert max(sum(len(r[1] or "") for r in part) for part in found) <= parse.BATCH_CHARACTERS + 600_000
    assert list(parse.batched(iter([]))) == []


def test_an_embedding_hashes_each_token_once(spark):
    rows = spark.createDataFrame([("a b a",), ("Ä, 1",), ("",), (None,)], "t string")
    vectors = [r.v for r in rows.select(text.hash_embedding(F.col("t")).alias("v")).collect()]
    assert all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in vectors[:2]) and vectors[2] == [0.0] * 16
    plan = rows.select(text.hash_embedding(F.col("t")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("sha2(") == 1  # not once more in each lambda


def test_pages_of_one_form_have_the_blocks_of_a_single_parse(monkeypatch):
    import random

    rng = random.Random(7)
    tags = ["<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<h2>", "</h2>", "<pre class='x y'>", "</pre>", "<td>", "<TR>", "</table>", "<br>", "<br/>", "<a href='?a&amp;b'>", "</a>", '<img src="i" alt="&lt;">']
    tags += ["<title>", "</title>", "<script>", "</script>", "<textarea>", "</textarea>", "<xmp>", "</xmp>", "<!DOCTYPE html>", "<!-- c -->", "<template>", "</template>", "<blockquote>", "</blockquote>", "<p"]
    texts = ["", "", "a", " b\n c ", "&amp;", "&am", "&lt;p&gt;", "1 < 2", "&#0;", "x &", "\0", "\ue0001\ue001", ">"]
    plain = parse._page_blocks
    for _ in range(3000):
        form = rng.choices(tags[:18] if rng.random() < 0.5 else tags, k=rng.randrange(1, 12))
        for _ in range(4):
            page = "".join(rng.choice(texts) + tag for tag in form) + rng.choice(texts)
            got = list(parse.html_blocks(page))
            with monkeypatch.context() as m:
                m.setattr(parse, "_formed_blocks", lambda text: None)
                assert got == list(parse.html_blocks(page)), page
    parsed = []
    monkeypatch.setattr(parse, "_page_blocks", lambda text: parsed.append(text) or plain(text))
    for i in range(100):
        assert [b[4] for b in parse.html_blocks(f"<h4>order {i} &amp; more</h4><pre>x\n {i}</pre><p>end")] == [f"order {i} & more", f"x\n {i}", "end"]
    assert len(parsed) == 2  # the first page, and the form


def test_cells_of_pages_of_one_form_are_those_of_a_single_parse(monkeypatch):
    import random

    rng = random.Random(11)
    tags = ["<table>", "</table>", "<table>", "<tr>", "<tr>", "</tr>", "<td>", "<td>", "<td>", "</td>", "<TH>", "</th>", "<b>", "</b>", "<p>", "<td class='x > y'>", "<td a=b>", "<br>", "<br/>", "<!-- c -->", "<script>", "</script>", "<title>", "</title>", "<xmp>", "</xmp>", "<td", "<>"]
    texts = ["", "a", "7", " b\n c\u00a0d ", "&amp;", "&am", "&lt;td&gt;", "1 < 2", "2 > 1", "&#0;", "x &", "\0", "\ue0001\ue001"]
    for _ in range(3000):
        form = rng.choices(tags[:16] if rng.random() < 0.7 else tags, k=rng.randrange(1, 14))
        for _ in range(4):
            page = "".join(rng.choice(texts) + tag for tag in form) + rng.choice(texts)
            got = list(parse.html_cells(page))
            with monkeypatch.context() as m:
                m.setattr(parse, "_pieces", lambda text: None)
                assert got == list(parse.html_cells(page)), page
    trees, tree = [], parse._Tree
    monkeypatch.setattr(parse, "_Tree", lambda: trees.append(1) or tree())
    for i in range(100):
        assert [c[1:] for c in parse.html_cells(f"<h5>{i}</h5><table><tr><th>n &gt; {i}<td> {i}\n{i} <b>no</b> &amp; more</table>")] == [(0, 0, True, f"n > {i}"), (0, 1, False, f"{i} {i} & more")]
        assert list(parse.html_cells(f"<h5>{i}</h5>no table")) == []
    assert len(trees) == 4  # the first page of each form, and the form


def test_cells_leave_in_columns(spark, sf_dir):
    """As html_cells() gives them, in small batches, whether pages have many cells, long ones or none."""
    import pyarrow as pa

    order = "<table><tr><th>part<th>n<tr><td>{0}<td>{0} &amp; more</table>"
    pages = [order.format(i) for i in range(4000)] + [None, "", "<p>none", "<table>" + "<tr><td>x<td>y" * 10_000 + "</table>"] + ["<table><tr><td>" + "z" * 700_000 + "</table>"] * 4
    want = [(i, *cell) for i, page in enumerate(pages) if page is not None for cell in parse.html_cells(page)]
    batches = [list(zip(at, *cells, strict=True)) for at, cells in parse._held_cells(pa.array(pages))]
    assert [row for batch in batches for row in batch] == want and all(0 < len(batch) < 2 * parse.BATCH_ROWS for batch in batches)
    assert max(sum(len(row[-1]) for row in batch) for batch in batches) < parse.BATCH_CHARACTERS + 700_000
    rows = spark.createDataFrame([(i, None if i % 7 == 3 else f"k{i}", page) for i, page in enumerate(pages)], "doc long, name string, html string")
    cells = parse.table_cells(rows, "html", ("doc", "name"))
    assert cells.schema == parse.parsed(rows, parse.html_cells, "html", parse.TABLE_CELLS, ("doc", "name")).schema
    assert sorted(tuple(r) for r in cells.drop("name").collect()) == want and cells.where("name IS DISTINCT FROM if(doc % 7 = 3, NULL, 'k' || doc)").count() == 0
    from docloom.plans import documents

    plan = documents.tables(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_lines_of_order_pages_move_once_and_as_they_are(spark, sf_dir):
    from docloom.plans import documents

    plan = documents._order_pages(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    moved = plan[plan.index("partial_collect_list") :]
    assert moved.count("Exchange hashpartitioning") == 1 and plan.count("Exchange hashpartitioning") == 1 and "format_string" not in plan
