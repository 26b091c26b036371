"""Special cases of operators: small tables, and the rows that each must give."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pytest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from tests.compare import value

from docloom.functions import formulas
from docloom.functions import text as T
from docloom.operators import aggregates, control, filters, folds, knowledge, layout, materials, pipelines, relational, windows
from docloom.sources import office, parse, sinks, tables

Given = Callable[..., DataFrame]
CASES: dict[str, tuple[Callable[[Given], DataFrame], str, tuple]] = {}


def case(name: str, schema: str, *rows: tuple) -> Callable:
    """Registers a function of `given` (schema, rows to a table) with the rows that it gives; arrays are compared joined by commas."""

    def add(function: Callable[[Given], DataFrame]) -> Callable:
        CASES[name] = function, schema, rows
        return function

    return add


def each(given: Given, schema: str, values: list[tuple], **columns: Column) -> DataFrame:
    """A table of numbered values with columns computed from them."""
    df = given(f"i long, {schema}", *((i, *v) for i, v in enumerate(values)))
    return df.select("i", *(c.alias(name) for name, c in columns.items()))


# --- scans ------------------------------------------------------------------------------------------------------------------


@case("s04_single_column", "a string, b string", ("1", "2"), ("4", None), ("x", "y"))
def single_column(given: Given) -> DataFrame:
    return tables.split_single_column(given("`a,b` string", ("1,2,3",), ("4",), (" x , y",)))


@case(
    "s07_strict_json", "i long, value string, ok boolean", (0, '{"a":2,"b":1}', True), (1, None, False), (2, None, False), (3, None, False), (4, '[1,"ä"]', True),
    (5, None, False), (6, None, False),
)
def strict_json(given: Given) -> DataFrame:
    texts = [('{"b":1,"a":2}',), ('{"a":1,"a":2}',), ('{"a":NaN}',), ('{"a":1e999}',), ('[1, "ä"]',), ("{",), (None,)]
    r = tables.strict_json("t")
    return each(given, "t string", texts, value=r["value"], ok=r["error"].isNull())


@case(
    "s10_subtitles", "i long, seg long, start double, end double, text string", (0, 0, 1.0, 3.0, "A & b"), (0, 1, 2.5, 4.0, "c\nd"), (1, 0, 1.0, 2.0, "hi"),
)
def subtitles(given: Given) -> DataFrame:
    srt = "1\n00:00:01,000 --> 00:00:03,000\nA &amp; <i>b</i>\n\n2\n00:00:02,500 --> 00:00:04,000\nc\nd\n"
    vtt = "WEBVTT\n\nNOTE x\n\nSTYLE\n::cue{}\n\nid\n00:01.000 --> 00:02.000 align:start\n<v Bob>hi\n"
    found = parse.parsed(given("i long, t string", (0, srt), (1, vtt)), parse.subtitles, "t", parse.SEGMENTS, ("i",))
    return found.withColumnRenamed("seg_id", "seg")


@case("s11_rolling_subtitles", "seg long, text string", (0, "a b c"), (1, "d"))
def rolling(given: Given) -> DataFrame:
    text = "00:01.000 --> 00:02.000\na b c\n\n00:02.000 --> 00:03.000\nb c d\n\n00:03.000 --> 00:04.000\nd\n"
    return parse.parsed(given("i long, t string", (0, text)), parse.rolling_subtitles, "t", parse.SEGMENTS, ("i",)).withColumnRenamed("seg_id", "seg")


@case("s15_gutter", "i long, gutter boolean", (0, True), (1, False), (2, False), (3, False))
def gutter(given: Given) -> DataFrame:
    known = F.pandas_udf(lambda texts: texts.map(parse.gutter), "boolean")
    return each(given, "t string", [("1 a\n2 b\n3 c",), ("1 a\n3 b\n4 c",), ("1 a\n2 b",), ("",)], gutter=known("t"))


@case("s14_text_kind", "i long, kind string", (0, "code"), (1, "math"), (2, "heading"), (3, "paragraph"))
def text_kind(given: Given) -> DataFrame:
    texts = [("int x = f(1);", 0.9, 10.0), ("a = b + c", 0.0, 10.0), ("Title", 0.0, 15.0), ("A sentence with many longer words.", 0.0, 10.0)]
    return each(given, "t string, m double, s double", texts, kind=office.text_kind(F.col("t"), F.col("m"), F.col("s"), F.lit(10.0)))


@case("s29_find_files", "name string, exact boolean", ("Übung, 1.pdf", True), ("Übung, 1.pdf", False), ("ubung 10.pdf", False))
def find_files(given: Given) -> DataFrame:
    files = given("name string", ("Übung, 1.pdf",), ("ubung 10.pdf",), ("x.txt",))
    one, many = tables.find_files(files, "name", "Übung 1"), tables.find_files(files, "name", "ubung 1", exact=False)
    return one.withColumn("exact", F.lit(True)).union(many.withColumn("exact", F.lit(False)))


@case("s32_lecture_files", "i long, class string, number string", (0, "subtitle", None), (1, "document", "3.1"), (2, "other", None), (3, "code", "12"))
def lecture_files(given: Given) -> DataFrame:
    names = [("a.SRT",), ("3.1_intro.pdf",), ("x",), ("12_code.py",)]
    return each(given, "n string", names, **{"class": filters.file_class(F.col("n")), "number": filters.lecture_number(F.col("n"))})


@case("m12_folder_sizes", "folder string, size long", ("a", 12), ("b", 5))
def folder_sizes(given: Given) -> DataFrame:
    return tables.folder_sizes(given("path string, length long", ("file:/r/a/x", 5), ("file:/r/a/y/z", 7), ("file:/r/b/x", 5), ("file:/r/top", 99)), "/r")


def _archive(members: dict[str, str]) -> bytearray:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return bytearray(buffer.getvalue())


@case("s18_zip_members", "i long, name string, status string", (0, "a.txt", "ok"), (0, "A.TXT", "collision"), (0, "../up", "unsafe_path"), (0, "bomb", "ratio"), (1, None, "not_an_archive"))
def zip_members(given: Given) -> DataFrame:
    rows = (0, _archive({"a.txt": "x", "A.TXT": "y", "../up": "z", "bomb": "0" * 900_000})), (1, bytearray(b"no"))
    found = parse.parsed(given("i long, raw binary", *rows), parse.zip_members, "raw", parse.MEMBERS, ("i",))
    return found.withColumn("name", F.when(F.col("status") != "not_an_archive", F.col("name")))


@case("s23_docx_blocks", "kind string, level long, text string", ("heading", 1, "Title"), ("paragraph", 0, "Body"), ("list_item", 0, "item"), ("table", 0, "a | b"))
def docx_blocks(given: Given) -> DataFrame:
    p = lambda text, style="": f"<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    cells = "".join(f"<w:tc>{p(x)}</w:tc>" for x in "ab")
    body = p("Title", '<w:pStyle w:val="Heading1"/>') + p("Body") + p("item", "<w:numPr/>") + p(" ") + f"<w:tbl><w:tr>{cells}</w:tr></w:tbl>"
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    file = _archive({"word/document.xml": f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>'})
    return parse.parsed(given("i long, raw binary", (0, file)), office.docx_blocks, "raw", parse.BLOCKS, ("i",))


@case("s28_mailboxes", "i long, name string, kind string", (0, "Sent Items", "sent"))
def mailboxes(given: Given) -> DataFrame:
    part = lambda k: F.pandas_udf(lambda lines: lines.map(lambda x: parse.mailbox(x)[k]), "string")
    return each(given, "t string", [('(\\HasNoChildren \\Sent) "/" "Sent Items"',)], name=part(0)("t"), kind=part(1)("t"))


# --- sinks and stores -------------------------------------------------------------------------------------------------------


@case("k08_build_states", "generation string, state string", ("a", "retired"), ("b", "active"), ("c", "interrupted"))
def build_states(given: Given) -> DataFrame:
    return sinks.build_states(given("generation string, finished boolean", ("a", True), ("b", True), ("c", False)), "b")


@case("k09_vector_upserts", "id long, action string", (1, "keep"), (2, "replace"), (3, "insert"), (4, "replace"))
def vector_upserts(given: Given) -> DataFrame:
    schema = "id long, v array<double>"
    return sinks.vector_upserts(given(schema, (1, [1.0]), (2, [2.0]), (3, [3.0]), (4, [1.0, 2.0])), given(schema, (1, [1.0 + 1e-8]), (2, [2.5]), (4, [1.0])), "id", "v")


@case("k12_exposition", "line string", ('jobs{a="1",b="q\\""} 2.0',), ("up 1.0",), ('d{p="x\\\\y"} 0.5',))
def exposition(given: Given) -> DataFrame:
    samples = given("name string, labels map<string,string>, value double", ("jobs", {"b": 'q"', "a": "1"}, 2.0), ("up", {}, 1.0), ("d", {"p": "x\\y"}, 0.5))
    return samples.select(sinks.exposition(samples).alias("line"))


@case("k15_markdown", "d long, text string", (1, "# H\n\n- a\n\nplain"), (2, "```\nx = 1\n```\n\n> q"))
def markdown(given: Given) -> DataFrame:
    rows = ((1, 2, "paragraph", 0, "plain"), (1, 0, "heading", 1, "H"), (1, 1, "list_item", 1, "a"), (2, 0, "code", 0, "x = 1"), (2, 1, "quote", 0, "q"))
    blocks = given("d long, o long, kind string, level long, text string", *rows)
    return sinks.assembled(blocks.withColumn("text", sinks.markdown(F.col("kind"), F.col("level"), F.col("text"))), "d", "o", "text")


@case("k16_document_text", "doc_id string, text string", ("d", "A hyphenated word.\n\nNew.\n\nNext"))
def document_text(given: Given) -> DataFrame:
    words = (
        ("d", 1, 0.0, 0.0, 9.0, 10.0, "A"), ("d", 1, 10.0, 0.3, 19.0, 10.0, "hyphen-"), ("d", 1, 0.0, 12.0, 9.0, 22.0, "ated"),
        ("d", 1, 10.0, 12.0, 19.0, 22.0, "word."), ("d", 1, 0.0, 60.0, 9.0, 70.0, "New."), ("d", 2, 0.0, 0.0, 9.0, 10.0, "Next"),
    )
    return pipelines.document_text(given("doc_id string, page int, x double, y double, x_end double, y_end double, text string", *words))


# --- predicates and projections ---------------------------------------------------------------------------------------------


@case("p03_source_page", "source_id string", ("s1",))
def source_page(given: Given) -> DataFrame:
    return materials.source_page(given("source_id string, data string", ("s1", '{"source_type":"video"}'), ("s2", '{"source_type":"pdf"}'), ("t", '{"source_type":"video"}')), "video", "s")


@case("p04_exclusion", "i long, reason string", (0, "toc"), (1, "reference"), (2, "empty_list"), (3, "table"), (4, "non_text"), (5, None))
def exclusion(given: Given) -> DataFrame:
    rows = [(True, True, "x", True, True), (False, True, "x", True, True), (False, False, " ", True, True), (False, False, "x", True, True), (False, False, None, False, False), (False, False, "x", True, False)]
    c = F.col
    return each(given, "a boolean, b boolean, t string, l boolean, g boolean", rows, reason=filters.exclusion(c("a"), c("b"), c("t"), c("l"), c("g")))


@case("p05_primary_intervals", "block_id string, role string, intervals string", ("1", "primary", "0-3"), ("2", "reference", None), ("3", "selected", "1-2,2-3"))
def primary_intervals(given: Given) -> DataFrame:
    blocks = given("block_id string, type string, text string", ("1", "paragraph", "abc"), ("2", "image", ""), ("3", "paragraph", "xyz"))
    found = materials.primary_intervals(blocks, given("block_id string, start long, end long", ("3", 2, 3), ("3", 1, 2)))
    return found.withColumn("intervals", F.array_join(F.transform("intervals", lambda x: F.concat_ws("-", x["start"], x["end"])), ","))


@case("p09_kept_statements", "text string, status string", ("a", "pending"), ("b", "verified"))
def kept_statements(given: Given) -> DataFrame:
    return materials.kept_statements(given("text string, visual boolean, status string", ("a", True, "verified"), (" ", False, "verified"), ("b", False, "verified")))


@case("p11_of_block", "resource_id string", ("r1",), ("r3",))
def of_block(given: Given) -> DataFrame:
    return materials.of_block(given("resource_id string, lecture_blocks array<string>", ("r1", ["a", "b"]), ("r2", ["b"]), ("r3", ["a"]), ("r4", [])), "a")


@case("p15_nearest_role", "i long, role string", (0, "notes"), (1, "slides"), (2, None))
def nearest_role(given: Given) -> DataFrame:
    return each(given, "c array<string>", [(["slides", "x", "notes", "y"],), (["slides"],), (["x"],)], role=materials.nearest_role(F.col("c"), ("slides", "notes")))


@case("p16_url_language", "i long, lang string", (0, "de"), (1, None), (2, "en"))
def url_language(given: Given) -> DataFrame:
    return each(given, "u string", [("https://e.org/de/x",), ("https://e.org/x/de/",), ("http://e.org/en/",)], lang=filters.url_language(F.col("u"), ("de", "en")))


@case("p18_video_kind", "i long, kind string, block string", (0, "foundation", "3"), (1, "supplement", None), (2, "supplement", "12"))
def video_kind(given: Given) -> DataFrame:
    v = materials.video_kind(F.col("t"))
    return each(given, "t string", [("Grundlagen Block 3",), ("Extra",), ("More, Part 12",)], kind=v["kind"], block=v["block"])


@case("p20_official_subtitle", "i long, ok boolean", (0, True), (1, False), (2, False), (3, False))
def official_subtitle(given: Given) -> DataFrame:
    rows = [("https://e.org/a.srt", ["s"], ["s"], "p", ["p"]), ("https://e.org/a.txt", ["s"], ["s"], "p", ["p"]), ("https://e.org/a.vtt", ["s", "t"], ["s"], "p", ["p"]), ("https://e.org/a.vtt", ["s"], ["s"], "q", ["p"])]
    c = F.col
    schema = "u string, s array<string>, allowed array<string>, page string, pages array<string>"
    return each(given, schema, rows, ok=materials.official_subtitle(c("u"), c("s"), c("allowed"), c("page"), c("pages")))


@case("p21_needs_visual", "i long, needs boolean", (0, True), (1, False), (2, False))
def needs_visual(given: Given) -> DataFrame:
    rows = [("pending", "Figure missing"), ("verified", "figure missing"), ("pending", "none")]
    return each(given, "s string, r string", rows, needs=filters.needs_visual(F.col("s"), F.col("r"), ("figure", "slide")))


@case("p22_evidence_type", "i long, types string", (0, "definition"), (1, "example,theorem"), (2, ""))
def evidence_type(given: Given) -> DataFrame:
    rules = {"definition": "(?i)^definition|heißt", "example": "(?i)beispiel|example", "theorem": "(?i)satz|theorem"}
    return each(given, "t string", [("Definition 3",), ("Beispiel zum Satz",), ("plain",)], types=filters.cues(F.col("t"), rules))


@case("p23_expression_verdict", "i long, verdict string", (0, "accepted"), (1, "rejected"), (2, "rejected"), (3, "review"), (4, "review"))
def expression_verdict(given: Given) -> DataFrame:
    rows = [(True, True, 0.9), (False, True, 0.9), (True, True, 0.1), (True, True, 0.5), (True, False, 0.9)]
    return each(given, "v boolean, m boolean, c double", rows, verdict=materials.expression_verdict(F.col("v"), F.col("m"), F.col("c")))


@case("p28_url_problems", "i long, problem string", (0, None), (1, "scheme"), (2, "credentials"), (3, "host"), (4, "credentials"), (5, "host"), (6, "path"), (7, "missing"), (8, "port"))
def url_problems(given: Given) -> DataFrame:
    urls = ["https://e.org/a", "http://e.org", "https://u:p@e.org/", "https://127.0.0.1/", "https://e.org/?token=1", "https://host/", "https://e.org/../a", None, "https://e.org:8443/"]
    return each(given, "u string", [(u,) for u in urls], problem=materials.url_policy("u"))


@case("p29_image_safety", "i long, status string, code string", (0, "ok", "local"), (1, "rejected", "inline"), (2, "external", "remote"), (3, "rejected", "path"), (4, "rejected", "missing"), (5, "rejected", "scheme"))
def image_safety(given: Given) -> DataFrame:
    s = materials.image_safety(F.col("u"))
    return each(given, "u string", [("i.png",), ("data:x",), ("https://e/i",), ("../i",), (None,), ("JavaScript:x",)], status=s["status"], code=s["code"])


@case("p30_issue_category", "i long, category string", (0, "formula"), (1, "timing"), (2, "identity"), (3, "content"))
def issue_category(given: Given) -> DataFrame:
    return each(given, "c string", [("latex_braces",), ("segment_gap",), ("ref_missing",), ("blank",)], category=materials.issue_category(F.col("c")))


@case("p32_evidence_times", "i long, start double, end double", (0, 1.0, 9.0), (1, None, None))
def evidence_times(given: Given) -> DataFrame:
    start, end = filters.evidence_times("e")
    return each(given, "e array<struct<start:double,end:double>>", [([(4.0, 9.0), (1.0, 2.0)],), ([],)], start=start, end=end)


@case("p33_renamed", "a long, b string", (1, "x"))
def renamed(given: Given) -> DataFrame:
    return filters.renamed(given("`a__int` long, `b__text` string", (1, "x")), "__")


@case("p35_evidence_gate", "candidate_id string, segment_ids string, start double, end double, valid boolean", ("a", "1,2", 0.0, 5.0, True), ("b", "1,9", 0.0, 2.0, False), ("d", "", None, None, False))
def evidence_gate(given: Given) -> DataFrame:
    segments = given("chunk_id string, segment_id long, start double, end double", ("c", 1, 0.0, 2.0), ("c", 2, 2.0, 5.0))
    return knowledge.evidence_gate(given("candidate_id string, chunk_id string, segment_ids array<long>", ("a", "c", [2, 1, 2]), ("b", "c", [1, 9]), ("d", "c", [])), segments)


@case("p36_verbatim_gate", "ref_id string, text string, verbatim boolean", ("r", "b c", True), ("r", "x", False), ("q", "a", False))
def verbatim_gate(given: Given) -> DataFrame:
    schema = "ref_id string, text string"
    return knowledge.verbatim_gate(given(schema, ("r", "b c"), ("r", "x"), ("q", "a")), given(schema, ("r", "a b c")))


@case("p37_eligible", "document_id string", ("d",))
def eligible(given: Given) -> DataFrame:
    docs = given("document_id string, available boolean, status string, verified boolean", ("d", True, "completed", True), ("e", True, "running", True), ("f", True, "completed", True))
    return materials.eligible(docs, given("document_id string, role string, text string", ("d", "primary", "x"), ("f", "primary", " "), ("e", "primary", "y")))


@case("p38_parser_of", "i long, parser string, status string, reason string", (0, "html", "ready", None), (1, None, "unsupported", "format"), (2, None, "skipped", "not_primary"), (3, "notebook", "ready", None))
def parser_of(given: Given) -> DataFrame:
    p = filters.parser_of(F.col("s"), F.col("r"))
    return each(given, "s string, r string", [("htm", "primary"), ("pdf", "primary"), ("htm", "other"), ("ipynb", "primary")], parser=p["parser"], status=p["status"], reason=p["reason"])


@case("p40_lecture_number", "i long, number string", (0, "3.1"), (1, None), (2, "12"), (3, None))
def lecture_number(given: Given) -> DataFrame:
    return each(given, "n string", [("3.1_intro.pdf",), ("intro_3.pdf",), ("12_x",), ("3._x",)], number=filters.lecture_number(F.col("n")))


@case("p41_unresolved_formulas", "block_id string", ("a",), ("b",))
def unresolved_formulas(given: Given) -> DataFrame:
    return materials.unresolved_formulas(given("block_id string, type string, text string", ("a", "formula", None), ("b", "formula", " "), ("c", "formula", "x"), ("d", "paragraph", "")))


@case("p42_published", "claim_id long, url string, withheld string", (1, "https://e.org/a", None), (2, None, "scheme"), (3, None, "not_approved"))
def published(given: Given) -> DataFrame:
    claims = given("claim_id long, text string, url string", (1, "t", "https://e.org/a"), (2, "t", "http://e.org/a"), (3, "t", "https://e.org/b"))
    return materials.published(claims, given("url string", ("https://e.org/a",), ("http://e.org/a",)))


# --- joins ------------------------------------------------------------------------------------------------------------------


@case("j03_committed_records", "record_id string, run_id string", ("a", "r"), ("c", "r"))
def committed_records(given: Given) -> DataFrame:
    references = given("record_id string, run_id string", ("a", "r"), ("b", "s"), ("c", "r"), ("d", "absent"))
    return materials.committed(references, given("run_id string, state string", ("r", "committed"), ("s", "failed")))


@case("j08_overlapping", "source_id string, evidence_id long, window_id long", ("s", 1, 10), ("s", 1, 11))
def overlapping(given: Given) -> DataFrame:
    e = given("source_id string, evidence_id long, segments array<long>, start double, end double", ("s", 1, [1], 0.0, 1.0), ("s", 2, [7], 50.0, 51.0))
    return knowledge.overlapping(e, given("source_id string, window_id long, segments array<long>, start double, end double", ("s", 10, [1], 90.0, 91.0), ("s", 11, [5], 1.0, 3.0)))


@case("j10_verified_items", "item_id string, status string", ("i", "verified"), ("j", "pending"))
def verified_items(given: Given) -> DataFrame:
    items = given("item_id string, status string, expressions array<string>", ("i", "pending", ["e1", "e2"]), ("j", "pending", []))
    return knowledge.verified_items(items, given("expression_id string, status string, ordinal long", ("e1", "rejected", 1), ("e1", "verified", 2)))


@case("j11_unverified_expressions", "expression_id string", ("b",), ("c",))
def unverified_expressions(given: Given) -> DataFrame:
    return relational.without(given("expression_id string", ("a",), ("b",), ("c",)), given("expression_id string", ("a",), ("a",)), "expression_id")


@case("j12_frame_matches", "formula_id string, frames long", ("f", 2))
def frame_matches(given: Given) -> DataFrame:
    frames = given("frame_id string, variants array<string>", ("x", ["a", "b"]), ("y", ["b"]))
    return knowledge.frame_matches(given("formula_id string, variants array<string>", ("f", ["a", "b"]), ("g", ["a"])), frames, 2)


@case("j16_hit_problems", "hit_id string, problems string", ("h", ""), ("i", "version,window"), ("j", "missing"))
def hit_problems(given: Given) -> DataFrame:
    hits = given("hit_id string, record_id string, version int, start int, end int", ("h", "r", 1, 0, 5), ("i", "r", 2, 0, 50), ("j", "q", 1, 0, 1))
    return materials.hit_problems(hits, given("record_id string, version int, start int, end int", ("r", 1, 0, 10)))


@case("j20_required_actions", "resource_id string, action string", ("a", "none"), ("b", "extract_audio"), ("c", "download"), ("d", "transcribe"))
def required_actions(given: Given) -> DataFrame:
    files = given("name string, kind string", ("a.txt", "transcript"), ("b.mp4", "video"), ("d.mp3", "audio"), ("d.mp4", "video"))
    return materials.required_actions(given("resource_id string", ("a",), ("b",), ("c",), ("d",)), files)


@case("j22_companion", "resource_id string, lecture_id string, status string", ("r1", "l1", "parent"), ("r2", "l1", "section"), ("r3", None, "ambiguous"), ("r4", None, "none"))
def companion(given: Given) -> DataFrame:
    resources = given("resource_id string, parent_id string, sections array<string>", ("r1", "l1", ["s9"]), ("r2", None, ["s1"]), ("r3", None, ["s2"]), ("r4", None, []))
    return relational.companion(resources, given("lecture_id string, sections array<string>", ("l1", ["s1", "s2"]), ("l2", ["s2"])))


@case("j24_urls_by_index", "name string, url string, state string", ("a_001.pdf", "u1", "new"), ("b_002.pdf", "u2", "same"), ("c_003.pdf", "old", "kept"), ("d.pdf", None, "missing"))
def urls_by_index(given: Given) -> DataFrame:
    files = given("name string, url string", ("a_001.pdf", None), ("b_002.pdf", "u2"), ("c_003.pdf", "old"), ("d.pdf", None))
    return materials.urls_by_index(files, given("index string, url string", ("001", "u1"), ("002", "u2"), ("003", "u3")))


BOXES = "page int, path_id int, x0 double, y0 double, x1 double, y1 double, background boolean"


@case("j19_near_boxes", "page long, path_id long, group long", (1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 4), (1, 9, 9))
def near_boxes(given: Given) -> DataFrame:
    boxes = given(BOXES, (1, 1, 0.0, 0.0, 5.0, 5.0, False), (1, 2, 6.0, 0.0, 9.0, 5.0, False), (1, 3, 11.0, 0.0, 14.0, 5.0, False), (1, 4, 90.0, 90.0, 95.0, 95.0, False), (1, 9, 0.0, 0.0, 100.0, 100.0, True))
    return layout.near_groups(boxes, 2.0).toDF("page", "path_id", "group")


@case("j21_best_overlap", "page long, span long, area double", (1, 71, 16.0))
def best_overlap(given: Given) -> DataFrame:
    boxes = given(BOXES, (1, 1, 0.0, 0.0, 5.0, 5.0, False), (1, 2, 6.0, 0.0, 9.0, 5.0, False))
    others = given("page int, span int, x0 double, y0 double, x1 double, y1 double", (1, 70, 0.0, 0.0, 1.0, 1.0), (1, 71, 0.0, 0.0, 4.0, 4.0))
    return layout.best_overlap(boxes, others, "path_id", "span").toDF("page", "span", "area")


# --- groups -----------------------------------------------------------------------------------------------------------------


@case("a05_formula_groups", "plain_key string, representative string, variants string, status string, group_id string", ("a+b", "f2", "f1,f2", "verified", "KE0001"), ("a-b", "f3", "f3", "rejected", "KE0002"))
def formula_groups(given: Given) -> DataFrame:
    rows = (("f1", "a + b", None, "sum", "pending", 2), ("f2", "a+b", None, "sum", "verified", 1), ("f3", "a-b", None, "sum", "rejected", 3))
    return knowledge.formula_groups(given("formula_id string, plain string, latex string, kind string, status string, ordinal long", *rows))


@case("a06_canonical_statements", "id string, key string, text string, kind string, sources string, confidence double", ("CS0001", "m", "z", "def", "s1", 0.1), ("CS0002", "k", "y", "law", "s1,s2", 0.9))
def canonical_statements(given: Given) -> DataFrame:
    rows = (("k", "s1", 0.5, 9.0, "x", "def"), ("k", "s2", 0.9, 4.0, "y", "law"), ("m", "s1", 0.1, 1.0, "z", "def"))
    return knowledge.canonical_statements(given("key string, source_id string, confidence double, start double, text string, kind string", *rows))


@case("a07_entities", "key string, name string, kind string, aliases string", ("strasse", "STRASSE ", "way", "a,b"))
def entities(given: Given) -> DataFrame:
    return knowledge.entities(given("name string, kind string, confidence double, aliases array<string>", ("Straße", "road", 0.2, ["a"]), ("STRASSE ", "way", 0.8, ["b", "a"])))


EVIDENCE = "item_id string, source_id string, chunk_id string, segment_id long, start double, end double, kind string, relation string, confidence double, ordinal long"
EVIDENCES = (
    ("1", "s", "c", 1, 0.0, 1.0, "t", "support", 0.4, 1), ("1", "s", "c", 1, 0.0, 1.0, "t", "support", 0.9, 2), ("2", "s", "c", 1, 0.0, 1.0, "t", "oppose", 0.9, 3),
    ("3", "s", None, 1, 0.0, 1.0, "t", "support", 0.2, 4), ("3", "s", None, 1, 0.0, 1.0, "t", "support", 0.3, 5),
)


@case("a09_evidence_dedup", "item_id string, ordinal long", ("1", 1), ("2", 3), ("3", 4))
def evidence_dedup(given: Given) -> DataFrame:
    return knowledge.evidence_dedup(given(EVIDENCE, *EVIDENCES), "ordinal")


@case("a10_confidence", "item_id string, confidence double", ("1", 0.9), ("2", None), ("3", 0.3))
def confidence(given: Given) -> DataFrame:
    return knowledge.confidence(given(EVIDENCE, *EVIDENCES))


@case("a08_evidence_range", "item_id string, start double, end double", ("a", 1.0, 9.0), ("b", None, None))
def evidence_range(given: Given) -> DataFrame:
    start, end = filters.evidence_times("e")
    items = given("item_id string, e array<struct<start:double,end:double>>", ("a", [(4.0, 9.0), (1.0, 2.0)]), ("b", []))
    return items.select("item_id", start.alias("start"), end.alias("end"))


@case("a24_visual_inventory", "kind string, n long, complete long, first_incomplete string", ("image", 2, 1, "b"), ("video", 1, 1, None))
def visual_inventory(given: Given) -> DataFrame:
    rows = ("a", "image", "x", "y"), ("b", "image", None, "y"), ("c", "video", "x", "y")
    return materials.validation_report(given("resource_id string, kind string, url string, title string", *rows), ["url", "title"])


@case("a27_merged_resources", "url string, blocks string", ("u", "1,2,3"), (None, "9"), (None, "9"))
def merged_resources(given: Given) -> DataFrame:
    return aggregates.merged_resources(given("url string, blocks array<int>", ("u", [1, 2]), ("u", [2, 3]), (None, [9]), (None, [9])), "url", "blocks")


@case("a33_findings", "k long, conflicting string", (1, "p"), (3, "p,q"))
def findings(given: Given) -> DataFrame:
    return aggregates.conflicts(given("k int, p string, q string", (1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (3, "a", "x"), (3, "b", "y")), "k", ["p", "q"])


@case("a35_distinct_names", "name string, n long", ("a", 2), ("b", 1), (None, 1))
def distinct_names(given: Given) -> DataFrame:
    return materials.distinct_names(given("name string", ("a",), ("b",), ("a",), (None,)), "name")


# --- windows and folds ------------------------------------------------------------------------------------------------------


@case("w03_merged_blocks", "d string, first long, last long, page long, tokens long", ("d", 0, 1, 1, 250), ("d", 2, 2, 1, 20), ("d", 3, 3, 2, 5))
def merged_blocks(given: Given) -> DataFrame:
    rows = (("d", 0, 1, 100, "a"), ("d", 1, 1, 150, "b"), ("d", 2, 1, 20, "c"), ("d", 3, 2, 5, "e"))
    found = folds.merged_blocks(given("d string, order long, page long, tokens long, text string", *rows), "d")
    return found.select(*found.columns[:5]).toDF("d", "first", "last", "page", "tokens")


@case("w04_sentence_chunks", "first long, last long", (0, 1), (1, 2), (2, 3), (3, 4))
def sentence_chunks(given: Given) -> DataFrame:
    found = folds.sentence_chunks(given("d string, order long, tokens long, text string", *(("d", i, 80, f"s{i}") for i in range(5))), "d", 200, 1)
    return found.select(*found.columns[2:4]).toDF("first", "last")


@case("w12_capped_windows", "k string, start double, end double, n long", ("k", 0.0, 70.0, 2), ("k", 71.0, 90.0, 1))
def capped_windows(given: Given) -> DataFrame:
    return folds.capped_windows(given("k string, start double, end double", ("k", 0.0, 40.0), ("k", 41.0, 70.0), ("k", 71.0, 90.0)), "k").toDF("k", "start", "end", "n")


@case("w15_grid", "i long, at string", (0, "1000,6000,11000"), (1, ""))
def grid(given: Given) -> DataFrame:
    return each(given, "a long, b long", [(0, 12_000), (0, 1500)], at=windows.grid(F.col("a"), F.col("b"), 5000, 1000))


@case("w16_distinct_frames", "v string, frame long", ("v", 0), ("v", 2), ("v", 3))
def distinct_frames(given: Given) -> DataFrame:
    return folds.distinct_frames(given("v string, frame long, at double, hash long", ("v", 0, 0.0, 0), ("v", 1, 1.0, 1), ("v", 2, 2.0, -1), ("v", 3, 20.0, -1)), "v")


WORDS = "page int, x double, y double, x_end double"
PLACED = ((1, 0.0, 0.0, 9.0), (1, 10.0, 0.4, 19.0), (1, 60.0, 0.2, 69.0), (1, 0.0, 12.0, 9.0), (1, 61.0, 12.0, 70.0))


@case("w18_text_lines", "x double, y double, line long", (0.0, 0.0, 1), (10.0, 0.4, 1), (60.0, 0.2, 1), (0.0, 12.0, 2), (61.0, 12.0, 2))
def text_lines(given: Given) -> DataFrame:
    return windows.text_lines(given(WORDS, *PLACED), 5.0)


@case("w19_split_lines", "x double, y double, piece long", (0.0, 0.0, 0), (10.0, 0.4, 0), (60.0, 0.2, 1), (0.0, 12.0, 0), (61.0, 12.0, 1))
def split_lines(given: Given) -> DataFrame:
    return windows.split_lines(windows.text_lines(given(WORDS, *PLACED), 5.0), 20.0)


@case("w34_two_columns", "x double, y double, column long", (0.0, 0.0, 0), (10.0, 0.4, 0), (60.0, 0.2, 1), (0.0, 12.0, 0), (61.0, 12.0, 1))
def two_columns(given: Given) -> DataFrame:
    return windows.two_columns(given(WORDS, *PLACED))


@case("w20_paragraphs", "line long, paragraph long", (0, 1), (1, 1), (2, 2), (3, 3))
def paragraphs(given: Given) -> DataFrame:
    rows = ((1, 0, "An open line", 0.0, 10.0), (1, 1, "ends here.", 11.0, 21.0), (1, 2, "Next one.", 60.0, 70.0), (1, 3, "1. numbered", 71.0, 81.0))
    return layout.paragraphs(given("page int, line int, text string, y0 double, y1 double", *rows), 12.0)


@case("w21_joined_hyphens", "d string, line long, text string", ("d", 0, "Donaudampfer und Vor- und Nachname"), ("d", 3, "end"))
def joined_hyphens(given: Given) -> DataFrame:
    rows = (("d", 0, "Donau-"), ("d", 1, "dampfer und Vor-"), ("d", 2, "und Nachname"), ("d", 3, "end"))
    return layout.joined_hyphens(given("d string, line long, text string", *rows), "d", ("und",))


@case("w31_rows_by_mean", "page long, word long, row long", (1, 0, 0), (1, 1, 0), (1, 2, 1))
def rows_by_mean(given: Given) -> DataFrame:
    return folds.rows_by_mean(given("page long, word long, x double, y double", (1, 0, 5.0, 10.0), (1, 1, 1.0, 11.0), (1, 2, 1.0, 20.0)), 3.0).toDF("page", "word", "row")


@case("w33_padded", "i long, start double, end double", (0, 0.0, 5.0), (1, 8.0, 13.0))
def padded(given: Given) -> DataFrame:
    start, end = windows.padded(F.col("a"), F.col("b"))
    return each(given, "a double, b double", [(1.0, 3.0), (10.0, 11.0)], start=start, end=end)


@case("p26_line_classes", "line long, class string", (0, "heading"), (1, "bullet"), (2, "bullet"), (3, "margin"), (4, "body"))
def line_classes(given: Given) -> DataFrame:
    rows = ((1, 0, "Title", 5, False, False), (1, 1, "- item", 0, False, False), (1, 2, "goes on", 1, False, False), (1, 3, "12", 0, True, False), (1, 4, "Text.", 1, False, False))
    return layout.line_classes(given("page long, line long, text string, score int, margin boolean, contents boolean", *rows))


@case("p27_line_scores", "i long, heading long, contents boolean, margin boolean", (0, 5, False, False), (1, 2, True, False))
def line_scores(given: Given) -> DataFrame:
    c = F.col
    rows = [("2.1 Title", 20.0, True, 0.5), ("Intro ...... 12", 10.0, False, 0.5)]
    return each(given, "t string, s double, b boolean, y double", rows, heading=layout.heading_score(c("s"), F.lit(10.0), c("b"), c("t")), contents=layout.contents_line(c("t")), margin=layout.margin_line(c("y"), c("t")))


@case("l05_cursor_page", "rank long", (3,), (4,))
def cursor_page(given: Given) -> DataFrame:
    return materials.cursor_page(given("rank long", (1,), (2,), (3,), (4,), (5,)), "f", ("f", 2, 0.0), 1.0, 2)


@case("l13_levels", "stage_id string, level long", ("a", 0), ("b", 1), ("c", 2), ("d", 1), ("e", 2))
def levels(given: Given) -> DataFrame:
    return control.levels(given("stage_id string, after array<string>, config_hash string", ("a", [], "1"), ("b", ["a"], "1"), ("c", ["b"], "1"), ("d", ["a"], "2"), ("e", ["d"], "1")))


@case("d08_text_similarity", "i long, ratio double", (0, 0.75), (1, 0.0), (2, 1.0))
def text_similarity(given: Given) -> DataFrame:
    return each(given, "a string, b string", [("abcd", "bcde"), ("", "x"), ("same", "same")], ratio=materials.text_similarity("a", "b"))


# --- scalar functions -------------------------------------------------------------------------------------------------------


@case("f05_point_id", "i long, id string", (0, "4cd605e7-afa2-5360-b5b9-c5e9fb5c76f4"))
def point_id(given: Given) -> DataFrame:
    return each(given, "t string", [("x",)], id=T.point_id("t"))


@case("f07_signature", "i long, same boolean, other boolean", (0, True, False))
def signatures(given: Given) -> DataFrame:
    s = materials.signature
    return given("i long, same boolean, other boolean", (0, s(b"k", "a", "m") == s(b"k", "a", "m"), s(b"k", "a", "m") == s(b"k", "b", "m")))


@case("f08_exact_keys", "i long, math string, text string", (0, "a+b=c", "a + b = c"), (1, "\\frac a + b", "\\frac a + b"), (2, "é", "é"))
def exact_keys(given: Given) -> DataFrame:
    return each(given, "t string", [("a + b = c",), ("\\frac a + b",), (" é ",)], math=T.exact_math(T.exact_text(F.col("t"))), text=T.exact_text(F.col("t")))


@case("f09_loose_math", "i long, loose string", (0, "x+y=2*z"), (1, "x^2"))
def loose_math(given: Given) -> DataFrame:
    loose = F.pandas_udf(lambda texts: texts.map(formulas.loose), "string")
    return each(given, "t string", [("X plus Y ist gleich 2 mal Z.",), ("x²",)], loose=loose("t"))


@case("f11_repaired_escapes", "i long, t string", (0, "\\times \\frac"), (1, "plain"))
def repaired_escapes(given: Given) -> DataFrame:
    return each(given, "s string", [("\times \frac",), ("plain",)], t=formulas.repaired_escapes("s"))


@case("f14_clean_token", "i long, t string", (0, "fi"), (1, "x"))
def clean_token(given: Given) -> DataFrame:
    return each(given, "s string", [("﻿ ﬁ ",), (" x",)], t=materials.clean_token(F.col("s")))


@case("f15_unescaped", "i long, t string", (0, "a & b"), (1, "é<"))
def unescaped(given: Given) -> DataFrame:
    return each(given, "s string", [("a &amp; b",), ("&eacute;&#60;",)], t=T.unescaped("s"))


@case("f16_seconds", "i long, s double", (0, 3723.5), (1, 123.25), (2, None), (3, None))
def seconds(given: Given) -> DataFrame:
    return each(given, "t string", [("01:02:03.500",), ("02:03,250",), ("1:99:00.000",), ("0:1",)], s=T.seconds(F.col("t")))


@case("f18_mail_date", "i long, at string", (0, "1996-07-17 00:44:25"), (1, None))
def mail_date(given: Given) -> DataFrame:
    utc = F.to_utc_timestamp(T.mail_date(F.col("t")), F.current_timezone())
    return each(given, "t string", [("17-Jul-1996 02:44:25 +0200",), ("soon",)], at=F.date_format(utc, "yyyy-MM-dd HH:mm:ss"))


@case("f19_list_literal", "i long, x string", (0, "a,b"), (1, "a,b"), (2, "a"))
def list_literal(given: Given) -> DataFrame:
    return each(given, "t string", [("['a', 'b']",), ("a, b",), ("a",)], x=T.list_literal(F.col("t")))


@case("f21_link_cases", "i long, links string", (0, "https://e.org/a,http://f.org/b"), (1, ""))
def link_cases(given: Given) -> DataFrame:
    return each(given, "t string", [("see https://e.org/a, (http://f.org/b); https://e.org/a.",), ("none",)], links=T.plain_links(F.col("t")))


@case("f22_sender", "subject string, sender string, links string", ("Hi", "bob@e.org", "https://e.org/a"))
def sender(given: Given) -> DataFrame:
    raw = b"From: Bob <bob@e.org>\r\nSubject: Hi\r\nDate: Mon, 01 Jan 2024 10:00:00 +0100\r\nContent-Type: text/plain\r\n\r\nsee https://e.org/a. and https://e.org/a,\r\n"
    return parse.parsed(given("i long, raw binary", (0, bytearray(raw))), parse.mail, "raw", parse.MAIL, ("i",))


@case("f27_breadcrumb", "i long, t string", (0, "a > b"), (1, ""))
def breadcrumb(given: Given) -> DataFrame:
    return each(given, "c array<string>", [([" a ", "", "b"],), ([],)], t=materials.breadcrumb(F.col("c")))


FORMULAS = [("a+b", "a+b", None), ("a + b", "a+b", None), ("(a)+b", "a+b", None), ("a+b", "a-b", None), ("a+", "b", None), (None, None, "absent"), ("a", None, None), ("a", "a", "ambiguous"), (None, "a", "absent")]


@case("f29_formula_differences", "i long, found string", (0, "symbol_error,exponent_error,structure_error"), (1, ""))
def formula_differences(given: Given) -> DataFrame:
    found = F.pandas_udf(lambda a, b: a.combine(b, lambda x, y: ",".join(formulas.differences(formulas.parse(x), formulas.parse(y)))), "string")
    return each(given, "a string, b string", [("a^2", "a^3"), ("a+b", "a + b")], found=found("a", "b"))


@case("f32_status_lattice", "i long, status string", (0, "conflict"), (1, "verified"), (2, "rejected"), (3, "pending"), (4, "unverified"))
def status_lattice(given: Given) -> DataFrame:
    rows = [(["verified", "rejected"],), (["pending", "verified"],), (["rejected", "pending"],), (["pending"],), ([],)]
    return each(given, "s array<string>", rows, status=T.status_lattice(F.col("s")))


@case("f33_title_parts", "i long, number string, title string", (0, "3.2", "Linear Maps"), (1, None, "Maps"))
def title_parts(given: Given) -> DataFrame:
    p = materials.title_parts(F.col("t"))
    return each(given, "t string", [("3.2_Linear_Maps",), ("Maps",)], number=p["number"], title=p["title"])


@case("f34_video_id", "i long, id string", (0, "abc_DEF-123"), (1, "abcdef"), (2, None))
def video_id(given: Given) -> DataFrame:
    return each(given, "u string", [("https://youtu.be/abc_DEF-123",), ("https://e.org/watch?a=1&v=abcdef",), ("https://e.org",)], id=T.video_id(F.col("u")))


# --- retrieval, evaluation, control -----------------------------------------------------------------------------------------


@case("r10_token_windows", "id long, chunk long, start long, end long", (1, 0, 0, 8), (1, 1, 8, 24), (1, 2, 24, 35), (2, 0, 0, 3), (3, 0, 0, 1))
def token_windows(given: Given) -> DataFrame:
    return materials.token_windows(given("id int, text string", (1, "one two, three four five. six seven"), (2, "..."), (3, " ")), "text", 5)


@case("r15_merged_clusters", "leader long, id long, text string", (1, 2, "bb"), (3, 3, "c"))
def merged_clusters(given: Given) -> DataFrame:
    return materials.merged_clusters(given("id int, leader int", (1, 1), (2, 1), (3, 3)), given("id int, text string", (1, "a"), (2, "bb"), (3, "c")))


@case("r14_leaders", "t string, id long, leader long", ("t", 1, 1), ("t", 2, 1), ("t", 3, 3), ("t", 4, 4))
def leaders(given: Given) -> DataFrame:
    return folds.leaders(given("t string, id long, vector array<double>", ("t", 1, [1.0, 0.0]), ("t", 2, [0.99, 0.1]), ("t", 3, [0.0, 1.0]), ("t", 4, [0.0, 0.0])), "t").toDF("t", "id", "leader")


@case("r16_index_items", "item_id string, records long, complete boolean", ("i", 1, True), ("j", 1, False))
def index_items(given: Given) -> DataFrame:
    items = given("item_id string, evidence array<struct<record_id:string,sha:string>>", ("i", [("r", "s")]), ("j", [("r", "x"), ("q", "s")]))
    return materials.index_items(items, given("record_id string, sha string", ("r", "s"))).toDF("item_id", "records", "complete")


@case("e10_item_findings", "item_id string, codes string", ("i", "no_text,no_evidence,confidence_range,status"), ("j", ""))
def item_findings(given: Given) -> DataFrame:
    return knowledge.item_findings(given("item_id string, text string, confidence double, evidence_count long, status string", ("i", " ", 1.5, 0, "odd"), ("j", "t", 0.5, 1, "verified")))


@case("e11_canonical_items", "item_id string, status string, confidence double, evidence_count long, codes string", ("1", "verified", 0.4, 1, ""), ("2", "pending", None, 1, "no_text,confidence_range"), ("4", "pending", None, 0, "no_text,no_evidence,confidence_range"))
def canonical_items(given: Given) -> DataFrame:
    items = given("item_id string, text string, status string, expressions array<string>", ("1", "t", "pending", ["e"]), ("2", "", "pending", []), ("4", "", "pending", []))
    return pipelines.canonical_items(items, given(EVIDENCE, *EVIDENCES[:3]), given("expression_id string, status string, ordinal long", ("e", "verified", 1)))


@case("e09_projection_audit", "page_id long, code string", (1, "link_target"), (2, "coverage"), (2, "empty_heading"))
def projection_audit(given: Given) -> DataFrame:
    blocks = given("page_id long, kind string, level long, text string, href string", (1, "link", 0, "x", None), (1, "list_item", 1, "y", None), (2, "heading", 1, " ", None))
    return pipelines.projection_audit(blocks, given("page_id long, start int, end int, length int", (1, 0, 5, 10), (1, 5, 10, 10), (2, 0, 5, 10)))


@case("e16_handoff", "lecture_id string", ("l",))
def handoff(given: Given) -> DataFrame:
    audits = given("lecture_id string, status string", ("l", "passed"), ("m", "failed"), ("n", "passed"))
    return materials.handoff(given("lecture_id string", ("l",), ("m",), ("n",)), audits, given("lecture_id string", ("l",)))


@case("e17_plan_coverage", "fact_id string, state string", ("1", "assigned"), ("2", "repeated"), ("3", "unassigned"), ("9", "unknown"))
def plan_coverage(given: Given) -> DataFrame:
    plan = given("topic string, fact_ids array<string>", ("p", ["1", "2"]), ("q", ["2", "9"]))
    return knowledge.plan_coverage(plan, given("fact_id string", ("1",), ("2",), ("3",)))


@case("t01_state_cases", "j string, state string, accepted long, refused long", ("j", "done", 2, 1), ("k", "new", 0, 1))
def state_cases(given: Given) -> DataFrame:
    events = given("j string, seq long, state string", ("j", 1, "run"), ("j", 2, "done"), ("j", 3, "run"), ("k", 1, "done"))
    return folds.job_states(events, "j", {"new": ("run",), "run": ("done",)}, "new", ("done",)).toDF("j", "state", "accepted", "refused")


@case("t02_available", "worker_id string, available boolean", ("w", True), ("x", False))
def available(given: Given) -> DataFrame:
    beats = given("worker_id string, at string", ("w", "2024-01-01 00:00:00"), ("w", "2024-01-01 00:01:00"), ("x", "2024-01-01 00:00:00"))
    return control.available(beats.withColumn("at", F.col("at").cast("timestamp")), F.lit("2024-01-01 00:01:30").cast("timestamp"), 60)


STAGES = "stage_id string, after array<string>, config_hash string"


@case("t04_key_conflicts", "owner string, key string, intent string", ("a", "1", "y"))
def key_conflicts(given: Given) -> DataFrame:
    schema = "owner string, key string, intent string"
    return sinks.key_conflicts(given(schema, ("a", "1", "y"), ("a", "2", "x"), ("b", "1", "x")), given(schema, ("a", "1", "x"), ("b", "1", "x")), ["owner", "key"], "intent")


@case("t05_preview", "stage_id string, state string", ("a", "skipped"), ("b", "skipped"), ("c", "ready"), ("d", "stale"), ("e", "stale"))
def preview(given: Given) -> DataFrame:
    stages = given(STAGES, ("a", [], "1"), ("b", ["a"], "1"), ("c", ["b"], "1"), ("d", ["a"], "2"), ("e", ["d"], "1"))
    return control.preview(stages, given("stage_id string, config_hash string", ("a", "1"), ("b", "1"), ("d", "1"), ("e", "1")))


@case("t06_run_to_end", "stage_id string, config_hash string", ("a", "1"), ("b", "2"), ("c", "1"))
def run_to_end(given: Given) -> DataFrame:
    stages = given(STAGES, ("a", [], "1"), ("b", ["a"], "2"), ("c", [], "1"))
    return pipelines.run_to_end(stages, given("stage_id string, config_hash string", ("a", "0"), ("b", "2"), ("c", "1")), lambda stage: None)


@case("t07_pending", "lecture_id string", ("m",), ("n",))
def pending(given: Given) -> DataFrame:
    return control.pending(given("lecture_id string", ("l",), ("m",), ("n",)), given("lecture_id string, status string", ("l", "done"), ("m", "failed")), "lecture_id")


@case("t09_schedule", "lecture_id string, chunks long, done long, state string", ("l", 2, 1, "partial"), ("m", 1, 1, "complete"), ("n", 1, 0, "pending"))
def schedule(given: Given) -> DataFrame:
    return control.schedule(given("lecture_id string, status string", ("l", "done"), ("l", "failed"), ("m", "done"), ("n", "new")))


@case("t10_appended", "entity string, request string, state string", ("e", "q1", "replayed"), ("e", "q2", "accepted"), ("e", "q3", "conflict"), ("f", "q1", "accepted"))
def appended(given: Given) -> DataFrame:
    schema = "entity string, revision int, request string, value string"
    return materials.appended(given(schema, ("e", 1, "q1", "v")), given(schema, ("e", 2, "q2", "w"), ("e", 1, "q1", "v"), ("e", 5, "q3", "x"), ("f", 1, "q1", "z")))


@case("t11_recovery", "run_id string, action string", ("a", "resume"), ("b", "abandon"), ("c", "wait"), ("d", "none"))
def recovery(given: Given) -> DataFrame:
    rows = (("a", "running", "2024-01-01 00:00:00", "g"), ("b", "running", "2024-01-01 00:00:00", None), ("c", "running", "2024-01-01 00:59:59", None), ("d", "done", "2024-01-01 00:00:00", None))
    runs = given("run_id string, state string, heartbeat string, generation string", *rows)
    return materials.recovery(runs.withColumn("heartbeat", F.col("heartbeat").cast("timestamp")), F.lit("2024-01-01 01:00:00").cast("timestamp"), 60)


@case("t14_until_stable", "n long", (0,), (0,))
def until_stable(given: Given) -> DataFrame:
    return pipelines.until_stable(given("n int", (5,), (3,)), lambda df: df.select(F.greatest(F.col("n") - 1, F.lit(0)).cast("int").alias("n")))


@case("t15_planned_within", "course_id string, n long, planned boolean", ("c", 1, True), ("c", 2, False), ("d", 1, True))
def planned_within(given: Given) -> DataFrame:
    return materials.planned_within(given("course_id string, n int, size double", ("c", 1, 6.0), ("c", 2, 5.0), ("d", 1, 9.0)), "n", "size", 10.0)


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    function, schema, want = CASES[name]
    df = function(lambda given, *data: spark.createDataFrame(list(data), given))
    fields = [x.strip().split(" ") for x in schema.split(",")]
    flat = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") if isinstance(df.schema[c].dataType, ArrayType) else F.col(c) for c, _ in fields}
    got = df.select(*(flat[c].cast(t).alias(c) for c, t in fields)).collect()
    assert sorted(repr(tuple(map(value, r))) for r in got) == sorted(repr(tuple(map(value, r))) for r in want)
