"""Operators on small tables: folds, joins, knowledge, control, evaluation."""

import hashlib
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.base import numbered, read
from docloom.operators import aggregates, control, evaluation, filters, folds, knowledge, profile, relational, retrieval, windows, materials
from docloom.plans import files


def collect(df):
    return sorted(tuple(r) for r in df.collect())


def test_acl_owner_or_grant(spark):
    rows = spark.createDataFrame([("s1", "me"), ("s2", "you"), ("s3", None), ("s4", "you")], "id string, owner string")
    grants = spark.createDataFrame([("s2", "me", "read"), ("s3", "me", "read"), ("s4", "me", "write"), ("s2", "me", "read")], "id string, subject string, permission string")
    assert collect(relational.visible(rows, grants, "me", "id", "owner").select("id")) == [("s1",), ("s2",), ("s3",)]


def test_join_all_suffixes_clashes(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y")], "k int, v string")
    assert relational.join_all([a, b], ["k"]).columns == ["k", "v", "v_right"]


def test_companion(spark):
    resources = spark.createDataFrame([("r1", "l1", ["s9"]), ("r2", None, ["s1"]), ("r3", None, ["s2"]), ("r4", None, [])], "resource_id string, parent_id string, sections array<string>")
    lectures = spark.createDataFrame([("l1", ["s1", "s2"]), ("l2", ["s2"])], "lecture_id string, sections array<string>")
    got = {r.resource_id: (r.lecture_id, r.status) for r in relational.companion(resources, lectures).collect()}
    assert got == {"r1": ("l1", "parent"), "r2": ("l1", "section"), "r3": (None, "ambiguous"), "r4": (None, "none")}


def test_companion_of_large_sections(spark):
    """A section's lectures aren't multiplied out by its resources: 2,000 by 2,000 would be 4 million rows."""
    resources = spark.range(2000).selectExpr("id AS resource_id", "CAST(NULL AS long) AS parent_id", "array('s', IF(id = 7, 't', NULL)) AS sections")
    lectures = spark.range(2000).selectExpr("id AS lecture_id", "array('s') AS sections").unionByName(spark.sql("SELECT 5L AS lecture_id, array('u') AS sections"))
    assert [r.asDict()["n"] for r in relational.companion(resources, lectures).groupBy("status").agg(F.count("*").alias("n")).collect()] == [2000]
    plan = relational.companion(resources, lectures)._jdf.queryExecution().optimizedPlan().toString()
    left = plan[plan.index("Join LeftOuter") :]
    assert "Aggregate [section" in left  # lectures are gathered by section before they meet resources
    only = relational.companion(resources.where("resource_id = 7").withColumn("sections", F.array(F.lit("u"), F.lit("v"))), lectures)
    assert [(r.lecture_id, r.status) for r in only.collect()] == [(5, "section")]


def test_material_plan_of_sets(spark):
    resources = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a", None]), (3, ["b"]), (4, []), (5, None), (6, ["z"]), (1, ["c"])], "resource_id long, sections array<string>")
    lectures = spark.createDataFrame([(10, ["a", "c"]), (9, ["b"]), (11, ["b", "b"]), (12, None)], "lecture_id long, sections array<string>")
    want = {1: [9, 10, 11], 2: [9, 10, 11], 3: [9, 11], 4: [], 5: [], 6: []}
    assert {r.resource_id: r.lectures for r in materials.material_plan(resources, lectures).collect()} == want
    assert {r.resource_id: r.lectures for r in materials.material_plan(resources, lectures, ",").collect()} == {k: ",".join(map(str, v)) for k, v in want.items()}
    plan = materials.material_plan(resources, lectures)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "Generate explode" not in plan  # resources only look their set up


def test_numbered_is_a_total_order(spark):
    rows = spark.range(1000).withColumn("x", (F.col("id") * 7919) % 1000)
    got = {r.x: r.number for r in numbered(rows, "x").collect()}
    assert got == {x: x + 1 for x in range(1000)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 10)), min_size=1, max_size=30))
def test_islands_match_a_plain_loop(spark, intervals):
    data = [("k", float(s), float(s + n)) for s, n in intervals]
    want, reach = [], None
    for _, s, e in sorted(data):
        if reach is None or s > reach + 2:
            want.append([s, e])
        want[-1][1] = max(want[-1][1], e)
        reach = want[-1][1]
    got = windows.islands(spark.createDataFrame(data, "k string, start double, end double"), ["k"], 2.0)
    assert sorted((r.start, r.end) for r in got.collect()) == sorted(map(tuple, want))


def test_timed_chunks_overlap_and_tail(spark):
    segments = spark.createDataFrame([("d", i, float(i * 10), float(i * 10 + 10)) for i in range(7)], "doc string, seg_id long, start double, end double")
    got = collect(folds.timed_chunks(segments, "doc", 30, 1))
    assert got == [("d", 0, 0, 2, 3), ("d", 1, 2, 4, 3), ("d", 2, 4, 6, 3)]
    assert collect(folds.timed_chunks(segments, "doc", 30, 0)) == [("d", 0, 0, 2, 3), ("d", 1, 3, 5, 3), ("d", 2, 6, 6, 1)]


def test_capped_windows_and_frames(spark):
    w = spark.createDataFrame([("k", 0.0, 40.0), ("k", 41.0, 70.0), ("k", 71.0, 90.0)], "k string, start double, end double")
    assert collect(folds.capped_windows(w, "k")) == [("k", 0.0, 70.0, 2), ("k", 71.0, 90.0, 1)]
    frames = spark.createDataFrame([("v", 0, 0.0, 0), ("v", 1, 1.0, 1), ("v", 2, 2.0, -1), ("v", 3, 20.0, -1)], "v string, frame long, at double, hash long")
    assert collect(folds.distinct_frames(frames, "v")) == [("v", 0), ("v", 2), ("v", 3)]


def test_blocks_sentences_rows_jobs(spark):
    blocks = spark.createDataFrame([("d", 0, 1, 100, "a"), ("d", 1, 1, 150, "b"), ("d", 2, 1, 20, "c"), ("d", 3, 2, 5, "e")], "d string, order long, page long, tokens long, text string")
    assert [r[1:5] for r in collect(folds.merged_blocks(blocks, "d"))] == [(0, 1, 1, 250), (2, 2, 1, 20), (3, 3, 2, 5)]
    sentences = spark.createDataFrame([("d", i, 80, f"s{i}") for i in range(5)], "d string, order long, tokens long, text string")
    assert [r[2:4] for r in collect(folds.sentence_chunks(sentences, "d", 200, 1))] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    words = spark.createDataFrame([(1, 0, 5.0, 10.0), (1, 1, 1.0, 11.0), (1, 2, 1.0, 20.0)], "page long, word long, x double, y double")
    assert collect(folds.rows_by_mean(words, 3.0)) == [(1, 0, 0), (1, 1, 0), (1, 2, 1)]
    events = spark.createDataFrame([("j", 1, "run"), ("j", 2, "done"), ("j", 3, "run"), ("k", 1, "done")], "j string, seq long, state string")
    assert collect(folds.job_states(events, "j", {"new": ("run",), "run": ("done",)}, "new", ("done",))) == [("j", "done", 2, 1), ("k", "new", 0, 1)]


def test_layout(spark):
    words = spark.createDataFrame([(1, 0.0, 0.0, 9.0), (1, 10.0, 0.4, 19.0), (1, 60.0, 0.2, 69.0), (1, 0.0, 12.0, 9.0), (1, 61.0, 12.0, 70.0)], "page int, x double, y double, x_end double")
    lines = windows.text_lines(words, 5.0)
    assert sorted(r.line for r in lines.collect()) == [1, 1, 1, 2, 2]
    assert max(r.piece for r in windows.split_lines(lines, 20.0).collect()) == 1
    assert sorted(r.column for r in windows.two_columns(words).collect()) == [0, 0, 0, 1, 1]


def test_knowledge(spark):
    formulas = spark.createDataFrame([("f1", "a + b", None, "sum", "pending", 2), ("f2", "a+b", None, "sum", "verified", 1), ("f3", "a-b", None, "sum", "rejected", 3)], "formula_id string, plain string, latex string, kind string, status string, ordinal long")
    got = {r.plain_key: (r.representative, r.status, r.group_id) for r in knowledge.formula_groups(formulas).collect()}
    assert got == {"a+b": ("f2", "verified", "KE0001"), "a-b": ("f3", "rejected", "KE0002")}
    statements = spark.createDataFrame([("k", "s1", 0.5, 9.0, "x", "def"), ("k", "s2", 0.9, 4.0, "y", "law"), ("m", "s1", 0.1, 1.0, "z", "def")], "key string, source_id string, confidence double, start double, text string, kind string")
    assert [(r.id, r.key, r.text, list(r.sources)) for r in knowledge.canonical_statements(statements).orderBy("id").collect()] == [("CS0001", "m", "z", ["s1"]), ("CS0002", "k", "y", ["s1", "s2"])]
    names = spark.createDataFrame([("Straße", "road", 0.2, ["a"]), ("STRASSE ", "way", 0.8, ["b", "a"])], "name string, kind string, confidence double, aliases array<string>")
    assert [(r.kind, r.aliases) for r in knowledge.entities(names).collect()] == [("way", ["a", "b"])]
    evidence = spark.createDataFrame([(1, "s", "c", 1, 0.0, 1.0, "t", "support", 0.4, 1), (1, "s", "c", 1, 0.0, 1.0, "t", "support", 0.9, 2), (2, "s", "c", 1, 0.0, 1.0, "t", "oppose", 0.9, 3)], "item_id long, source_id string, chunk_id string, segment_id long, start double, end double, kind string, relation string, confidence double, ordinal long")
    kept = knowledge.evidence_dedup(evidence, "ordinal")
    assert collect(knowledge.confidence(kept)) == [(1, 0.4), (2, None)]
    segments = spark.createDataFrame([("c", 1, 0.0, 2.0), ("c", 2, 2.0, 5.0)], "chunk_id string, segment_id long, start double, end double")
    candidates = spark.createDataFrame([("a", "c", [2, 1, 2]), ("b", "c", [1, 9]), ("d", "c", [])], "candidate_id string, chunk_id string, segment_ids array<long>")
    got = {r.candidate_id: (list(r.segment_ids), r.start, r.end, r.valid) for r in knowledge.evidence_gate(candidates, segments).collect()}
    assert got["a"] == ([1, 2], 0.0, 5.0, True) and not got["b"][3] and not got["d"][3]
    frames = spark.createDataFrame([("x", ["a", "b"]), ("y", ["b"])], "frame_id string, variants array<string>")
    assert collect(knowledge.frame_matches(spark.createDataFrame([("f", ["a", "b"]), ("g", ["a"])], "formula_id string, variants array<string>"), frames, 2)) == [("f", 2)]
    plan = spark.createDataFrame([("p", ["1", "2"]), ("q", ["2", "9"])], "topic string, fact_ids array<string>")
    assert collect(knowledge.plan_coverage(plan, spark.createDataFrame([("1",), ("2",), ("3",)], "fact_id string"))) == [("1", "assigned"), ("2", "repeated"), ("3", "unassigned"), ("9", "unknown")]
    claims = spark.createDataFrame([("r", "b c"), ("r", "x"), ("q", "a")], "ref_id string, text string")
    assert sorted(r.verbatim for r in knowledge.verbatim_gate(claims, spark.createDataFrame([("r", "a b c")], "ref_id string, text string")).collect()) == [False, False, True]
    e = spark.createDataFrame([("s", 1, [1], 0.0, 1.0), ("s", 2, [7], 50.0, 51.0)], "source_id string, evidence_id long, segments array<long>, start double, end double")
    w = spark.createDataFrame([("s", 10, [1], 90.0, 91.0), ("s", 11, [5], 1.0, 3.0)], "source_id string, window_id long, segments array<long>, start double, end double")
    assert collect(knowledge.overlapping(e, w)) == [("s", 1, 10), ("s", 1, 11)]
    items = spark.createDataFrame([("i", "pending", ["e1", "e2"]), ("j", "pending", [])], "item_id string, status string, expressions array<string>")
    checks = spark.createDataFrame([("e1", "rejected", 1), ("e1", "verified", 2)], "expression_id string, status string, ordinal long")
    assert collect(knowledge.verified_items(items, checks).select("item_id", "status")) == [("i", "verified"), ("j", "pending")]
    bad = spark.createDataFrame([("i", " ", 1.5, 0, "odd"), ("j", "t", 0.5, 1, "verified")], "item_id string, text string, confidence double, evidence_count long, status string")
    assert {r.item_id: r.codes for r in knowledge.item_findings(bad).collect()} == {"i": ["no_text", "no_evidence", "confidence_range", "status"], "j": []}


def test_control(spark):
    stages = spark.createDataFrame([("a", [], "1"), ("b", ["a"], "1"), ("c", ["b"], "1"), ("d", ["a"], "2"), ("e", ["d"], "1")], "stage_id string, after array<string>, config_hash string")
    assert dict(collect(control.levels(stages))) == {"a": 0, "b": 1, "c": 2, "d": 1, "e": 2}
    done = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", "1"), ("e", "1")], "stage_id string, config_hash string")
    assert dict(collect(control.preview(stages, done))) == {"a": "skipped", "b": "skipped", "c": "ready", "d": "stale", "e": "stale"}
    cycle = spark.createDataFrame([("a", ["b"], "1"), ("b", ["a"], "1")], "stage_id string, after array<string>, config_hash string")
    with pytest.raises(ValueError):
        control.levels(cycle)
    chunks = spark.createDataFrame([("l", "done"), ("l", "failed"), ("m", "done"), ("n", "new")], "lecture_id string, status string")
    assert {r.lecture_id: r.state for r in control.schedule(chunks).collect()} == {"l": "partial", "m": "complete", "n": "pending"}
    beats = spark.createDataFrame([("w", "2024-01-01 00:00:00"), ("w", "2024-01-01 00:01:00"), ("x", "2024-01-01 00:00:00")], "worker_id string, at string").withColumn("at", F.col("at").cast("timestamp"))
    now = F.lit("2024-01-01 00:01:30").cast("timestamp")
    assert {r.worker_id: r.available for r in control.available(beats, now, 60).collect()} == {"w": True, "x": False}
    receipts = spark.createDataFrame([("l", "done"), ("m", "failed")], "lecture_id string, status string")
    assert collect(control.pending(chunks.select("lecture_id").distinct(), receipts, "lecture_id")) == [("m",), ("n",)]


def test_ranking_metrics_of_ties_and_gaps(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "x")], "query_id int, rank int, target string")
    gold = spark.createDataFrame([(1, "a", 2), (1, "c", 1), (2, "y", 0), (3, "z", 1)], "query_id int, target string, grade int")
    got = {r.query_id: r for r in evaluation.ranking_metrics(hits, gold, 3).collect()}
    assert got[1].precision == pytest.approx(1 / 3) and got[1].recall == 0.5 and got[1].rr == 1.0
    assert got[1].ndcg == pytest.approx(3 / (3 + 1 / 1.584962500721156))
    assert got[2].recall is None and got[2].ndcg is None and got[3].rr == 0.0 and got[3].ndcg == 0.0


def test_functions(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(T.seconds(F.lit("01:02:03.500"))) == 3723.5 and pick(T.seconds(F.lit("02:03,250"))) == 123.25 and pick(T.seconds(F.lit("1:99:00.000"))) is None
    assert pick(T.exact_math(F.lit("a + b = c"))) == "a+b=c" and pick(T.exact_math(F.lit(r"\frac a + b"))) == r"\frac a + b"
    assert pick(T.list_literal(F.lit("['a', 'b']"))) == ["a", "b"] and pick(T.list_literal(F.lit("a, b"))) == ["a", "b"]
    assert pick(T.mail_date(F.lit("17-Jul-1996 02:44:25 +0200"))).isoformat() == "1996-07-17T00:44:25"
    assert pick(T.video_id(F.lit("https://youtu.be/abc_DEF-123"))) == "abc_DEF-123" and pick(T.video_id(F.lit("https://e.org/watch?a=1&v=abcdef"))) == "abcdef"
    assert pick(T.point_id(F.lit("x"))) == "f9f2f5b5-96a5-5bd7-8b3c-7f2d4ac22c0c" or len(pick(T.point_id(F.lit("x")))) == 36
    assert pick(T.unescaped(F.lit("a &amp; b&nbsp;c"))) == "a & b\xa0c" and pick(T.casefold(F.lit("Straße"))) == "strasse"
    assert pick(T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert pick(T.status_lattice(F.array(F.lit("verified"), F.lit("rejected")))) == "conflict"
    assert pick(T.latex_issues(F.lit("{a(b"))) == ["braces", "parentheses"]
    assert pick(filters.file_class(F.lit("a.SRT"))) == "subtitle" and pick(filters.lecture_number(F.lit("3.1_intro.pdf"))) == "3.1"
    assert pick(filters.link_relation(F.lit("mailto:a@b"), "e.org")) == "other_scheme" and pick(filters.link_relation(F.lit("#x"), "e.org")) == "anchor"
    assert pick(filters.parser_of(F.lit("pdf"), F.lit("primary")))["status"] == "unsupported"
    assert pick(filters.exclusion(F.lit(False), F.lit(False), F.lit(" "), F.lit(True), F.lit(False))) == "empty_list"
    assert pick(filters.needs_visual(F.lit("pending"), F.lit("Figure missing"), ("figure",)))
    assert pick(windows.grid(F.lit(0).cast("long"), F.lit(12_000).cast("long"), 5000, 1000)) == [1000, 6000, 11000]
    assert pick(F.struct(*windows.padded(F.lit(1.0), F.lit(3.0))))[0] == 0.0


def test_queries_are_checked():
    for bad in ("", "x" * 513, "a " * 9, "y" * 65):
        with pytest.raises(retrieval.QueryError):
            retrieval.query_terms(bad)
    with pytest.raises(retrieval.QueryError):
        retrieval.check_page(10, [str(i) for i in range(33)])


def test_bm25_phrases_and_empty_results(spark):
    docs = spark.createDataFrame([("s", 1, "x-ray of x ray"), ("s", 2, "ray x"), ("s", 3, "")], "source string, record long, text string")
    assert [r.record for r in retrieval.bm25(docs, "x-ray", "source", "record", "text").collect()] == [1]
    assert retrieval.bm25(docs, "absent", "source", "record", "text").count() == 0


def test_aggregates(spark):
    found = aggregates.conflicts(spark.createDataFrame([(1, "a", "x"), (1, "b", "x")], "k int, p string, q string"), "k", ["p", "q"])
    assert collect(found) == [(1, ["p"])]
    videos = spark.createDataFrame([("u", [1, 2]), ("u", [2, 3]), (None, [9]), (None, [9])], "url string, blocks array<int>")
    assert sorted(map(str, aggregates.merged_resources(videos, "url", "blocks").collect())) == sorted(map(str, spark.createDataFrame([("u", [1, 2, 3]), (None, [9]), (None, [9])], "url string, blocks array<int>").collect()))
    spectra = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [3.0, 5.0, 7.0])], "id int, v array<double>")
    got = {(r.id, r.i): r.x for r in profile.scatter_corrected(spectra, "id", "v").collect()}
    assert got[1, 0] == pytest.approx(got[2, 0]) and got[1, 2] == pytest.approx(got[2, 2])


def test_variates_of_short_and_long_spectra(spark):
    long = [float(i % 7) for i in range(300)]
    rows = spark.createDataFrame([(1, [5.0]), (2, []), (3, [1.0, 3.0]), (4, long)], "id int, v array<double>")
    found = dict(collect(rows.select("id", profile.normal_variate(F.col("v")).alias("x"))))
    mean, deviation = statistics.mean(long), statistics.stdev(long)
    assert found[1] == [None] and found[2] == [] and found[3] == pytest.approx([-(0.5**0.5), 0.5**0.5])
    assert found[4] == pytest.approx([(x - mean) / deviation for x in long])


def test_frames_go_to_a_formula_as_sets(spark):
    """Both formulas share all of 200 frames by each of three variants: 1,200 pairs, but six rows of the join."""
    formulas = spark.createDataFrame([("f", ["a", "b", "c"]), ("g", ["a", "b", "c"]), ("h", ["d"]), ("i", None)], "formula_id string, variants array<string>")
    frames = spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(200)] + [(None, ["d"])], "frame_id long, variants array<string>")
    found = knowledge.frame_matches(formulas, frames, 1)
    assert collect(found) == [("f", 200), ("g", 200)]
    assert "partial_collect_list(held" in found._jdf.queryExecution().toString()


def test_single_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    docs = [(i, f"text {i}") for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(files, "fresh", lambda _: f"{tmp_path}/blobs")
    monkeypatch.setattr(files, "read", lambda *a: read(*a).repartition(4))
    found = collect(files.verified_blobs(spark, str(tmp_path)))
    hashes = [(hashlib.sha256(f"text {i}\n".encode()).hexdigest(), len(f"text {i}\n")) for i in range(0, 400, 20)]
    assert found == sorted(x for x in hashes if x[0][0] in "13579")
    assert len({p.name[:10] for p in (tmp_path / "blobs").glob("part-*")}) > 1
