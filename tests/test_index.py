"""The stored index: equal to the scan, right after changes, refused where stale or too broad, and read no farther than needed."""

import random
import re

import pytest
from tests.compare import same

from docloom.operators import index, retrieval
from docloom.plans import catalog

COLUMNS = ("source", "record", "text")
SCHEMA = "source string, record long, text string"


def collect(df):
    return sorted(map(tuple, df.collect()), key=repr)


def live(docs):
    return index.contents(index.leaves(docs, *COLUMNS))


def built(docs, path):
    names = live(docs)
    return index.update(docs, path, *COLUMNS, names), names


def scan(docs, query):
    return collect(retrieval.bm25(docs, query, *COLUMNS))


def folders(path):
    return {p.name: {f.name for f in p.iterdir()} for p in (path / "postings").iterdir() if p.is_dir()}


@pytest.fixture(scope="module")
def prose(spark):
    """Records of four sources whose lengths differ, one source with most of them."""
    draw = random.Random(1)
    words = ["of"] * 30 + ["the"] * 20 + ["ray"] * 3 + [f"w{i}" for i in range(60)]
    rows = [(draw.choice("aaaaabcd"), i, " ".join(draw.choices(words, k=draw.choice([3, 20, 20, 20, 200, 900])))) for i in range(3000)]
    return spark.createDataFrame(rows, SCHEMA)


def test_answers_as_the_scan_does(spark, tmp_path, capsys):
    texts = [("s", 1, "x-ray of x ray x"), ("s", 2, "ray x"), ("t", 3, ""), ("t", 4, "x ray of of the x-ray"), ("u", 5, None), (None, 6, "x of nowhere"), ("a/b=c", 7, "x ray")]
    docs = spark.createDataFrame(texts, SCHEMA)
    _, names = built(docs, str(tmp_path))
    for query in ("x-ray", "x", "x of", "of x-ray", "ray-of-x ray", "absent", "x x", "x absent"):
        search = index.Search(spark, str(tmp_path), names, query)
        want = [h for h in scan(docs, query) if h[0] is not None]
        assert [h for h in collect(search.scored().drop("content")) if h[0] is not None] == want
        assert [h[:3] for h in collect(search.top(100)) if h[0] is not None] == want
    assert [r.record for r in index.Search(spark, str(tmp_path), names, "x", ["t", "v"]).scored().collect()] == [4]
    assert [r.record for r in index.Search(spark, str(tmp_path), names, "nowhere").scored().collect()] == [6]
    index.Search(spark, str(tmp_path), names, "ray").scored().explain("formatted")
    plan = capsys.readouterr().out
    assert re.search(r"PartitionFilters: \[[^\n]*content", plan) and re.search(r"PushedFilters: \[[^\n]*term,ray", plan)


def test_only_a_changed_source_is_written_again(spark, tmp_path):
    rows = [(s, i, f"{s} word{i % 7} the of") for i, s in enumerate("abcd" * 40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path)
    assert built(docs, path)[0] == 4 and built(docs.repartition(3), path)[0] == 0
    before = folders(tmp_path)
    edited = [("b", 1, "quite another text of the end") if r[1] == 1 else r for r in rows if r[0] != "d"]
    changed = spark.createDataFrame(edited, SCHEMA)
    n, names = built(changed, path)
    after = folders(tmp_path)
    assert n == 1 and len(set(after) - set(before)) == 1 and all(after[k] == before[k] for k in before)
    for query in ("the of", "end", "word3"):
        assert collect(index.Search(spark, path, names, query).scored().drop("content")) == scan(changed, query)
    back, names = built(docs, path)
    assert back == 0 and collect(index.Search(spark, path, names, "the of").scored().drop("content")) == scan(docs, "the of")


def test_a_stale_index_is_refused(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x y")], SCHEMA)
    with pytest.raises(retrieval.QueryError, match="stale_index"):
        index.Search(spark, str(tmp_path), live(docs), "x")
    built(docs, str(tmp_path))
    more = docs.union(spark.createDataFrame([("b", 3, "x")], SCHEMA))
    with pytest.raises(retrieval.QueryError, match="stale_index"):
        index.Search(spark, str(tmp_path), live(more), "x")
    assert index.Search(spark, str(tmp_path), live(more), "x", ["a"]).scored().count() == 1  # its part is current


def test_building_twice_at_once_harms_nothing(spark, tmp_path):
    """Both builders saw no part; the second writes what the first has."""
    docs = spark.createDataFrame([("a", i, "x y z") for i in range(300)], SCHEMA)
    names = live(docs)
    for _ in range(2):
        index.update(docs, str(tmp_path), *COLUMNS, names)
        (tmp_path / "parts").rename(tmp_path / f"parts-{_}")
    (tmp_path / "parts-1").rename(tmp_path / "parts")
    assert collect(index.Search(spark, str(tmp_path), names, "x z").scored().drop("content")) == scan(docs, "x z")


@pytest.mark.parametrize("query", ["ray", "of ray", "w1 w2", "of the ray"])
def test_top_k_reads_few_blocks_and_loses_none(spark, tmp_path_factory, prose, query):
    path = str(tmp_path_factory.getbasetemp() / "prose-index")
    _, names = built(prose, path)
    search = index.Search(spark, path, names, query)
    want = sorted(collect(retrieval.fused(retrieval.bm25(prose, query, *COLUMNS)).where("rank <= 5").select("source", "record", "score", "rank")), key=repr)
    assert collect(search.top(5)) == want
    blocks = search.bounds()
    first = blocks.where("bound IS NOT NULL").orderBy("content", "bound").groupBy("content").count()
    assert first.count() == 4


def test_pruning_skips_blocks(spark, tmp_path):
    """One record in a hundred blocks says the term often; the others say it once."""
    rows = [("a", i, "ray " * 50 if i == 777 else "ray " + "filler " * 30) for i in range(128 * 20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    _, names = built(docs, str(tmp_path))
    search = index.Search(spark, str(tmp_path), names, "ray")
    blocks = search.bounds()
    first = blocks.orderBy("bound", ascending=False).limit(2).select("content", "block")
    assert blocks.count() == 20
    assert search.open(blocks, first, search.scored(first), 1).count() == 0
    assert [r.record for r in search.top(1).collect()] == [777]
    assert search.open(blocks, first, search.scored(first), 5).count() == 18  # equal scores: ties are settled by record


def test_broad_queries_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([("ab"[i % 2], i, "x y" if i % 3 else "x") for i in range(30)], SCHEMA)
    _, names = built(docs, str(tmp_path))
    search = lambda q, sources=None: index.Search(spark, str(tmp_path), names, q, sources)
    assert search("x").guarded(30).count() == 30 and search("x y").guarded(20).count() == 20
    for query, most in (("x", 29), ("x y", 19)):
        with pytest.raises(retrieval.QueryError, match="query_too_broad"):
            search(query).guarded(most)
    assert search("x", ["a"]).guarded(15).count() == 15
    with pytest.raises(retrieval.QueryError, match="scope_required"):
        search("x", [str(i) for i in range(33)])


def test_a_search_sees_a_table_that_changes(spark, sf_dir, tmp_path):
    """The same folder and session, another table: the registered queries answer from what is there now."""
    for n in (150, 20):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(f"doc_id < {n}")
        docs.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        found = collect(catalog.QUERIES["r02_bm25"](spark, str(tmp_path)).select("source", "record", "score"))
        assert found == collect(catalog.QUERIES["r02_scan"](spark, str(tmp_path)))


def shuffled_rows(spark):
    """Rows that all stages so far have written for a shuffle."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_build_moves_records_and_not_tokens(spark, tmp_path):
    draw = random.Random(3)
    rows = [("ab"[i % 2], i, " ".join(f"w{draw.randrange(500)}" for _ in range(300))) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = index.materialized(live(docs))
    before = shuffled_rows(spark)
    index.update(docs, str(tmp_path), *COLUMNS, names)
    assert shuffled_rows(spark) - before < 2 * len(rows)


def test_postings_of_repeated_and_nameless_records(spark, tmp_path):
    docs = spark.createDataFrame([("s", 1, "b a b"), ("s", 1, "a c a"), ("s", None, "B"), ("s", 2, None), ("s", 3, "--")], SCHEMA)
    built(docs, str(tmp_path))
    found = spark.read.parquet(f"{tmp_path}/postings").orderBy("term").collect()
    entries = {r.term: [tuple(e) for e in r.entries] for r in found}
    assert entries == {"a": [(1, 3, [0, 1, 2])], "b": [(None, 1, [0]), (1, 3, [0, 2])], "c": [(1, 3, [1])]}
    assert [(r.n, r.block) for r in found] == [(1, 0), (2, 0), (1, 0)]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    assert built(docs, str(tmp_path))[0] == 0
    assert index.Search(spark, str(tmp_path), live(docs), "x").guarded().count() == 0


@pytest.mark.parametrize("name", ["r02_bm25", "r02_top", "r05_guarded", "k07_parts", "r06_changed_ranges"])
def test_queries(spark, sf_dir, name):
    same(spark, sf_dir, catalog.QUERIES[name], catalog.ORACLES[name])
