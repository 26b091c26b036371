"""Queries of retrieval, evaluation and profiles."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.base import materialized, r6, read, shared_folder
from docloom.operators import evaluation, folds, index, profile, relational, retrieval
from docloom.plans.registry import query

LEXICAL = "the of"
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
BM25 = f"""t AS (SELECT source, doc_id AS record, {TOKENS} AS tok FROM documents), c AS (SELECT source, record, len(tok) AS length, len(list_filter(tok, lambda x: x = 'the')) AS a, len(list_filter(tok, lambda x: x = 'of')) AS b FROM t),
m AS (SELECT source, count(*) AS n, avg(length) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c GROUP BY source),
h AS (SELECT source, record, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / mean)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score
FROM c JOIN m USING (source) WHERE a > 0 AND b > 0), f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, record) AS rank FROM h)"""


DOCUMENTS = ("source", "doc_id", "text")


def _index(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The stored index in the shared folder with the parts that the documents need now, and the names of these; a session's searches share it."""
    docs = read(spark, sf_dir, "documents", *DOCUMENTS)
    path = f"{shared_folder(spark)}/index-{spark.sparkContext.applicationId}"
    live = materialized(index.contents(index.leaves(docs, *DOCUMENTS)))
    index.update(docs, path, *DOCUMENTS, live)
    return path, live


def _search(spark: SparkSession, sf_dir: str, text: str, sources: list[str] | None = None) -> index.Search:
    return index.Search(spark, *_index(spark, sf_dir), text, sources)


@query("k06_stored_index", f"WITH t AS (SELECT source, {TOKENS} AS tok FROM documents), u AS (SELECT source, unnest(tok) AS term FROM t) SELECT source, term, count(*) AS n FROM u GROUP BY ALL")
def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, live = _index(spark, sf_dir)
    found = spark.read.parquet(f"{path}/postings").join(live.select("content", "source"), "content")
    times = F.aggregate("entries.at", F.lit(0).cast("long"), lambda n, at: n + F.size(at))
    return found.groupBy("source", "term").agg(F.sum(times).alias("n"))


@query("k07_parts", f"""WITH t AS (SELECT source, count(*) AS records, round(avg(len({TOKENS})), 6) AS mean FROM documents GROUP BY source) SELECT source, records, mean, ceil(records / 128)::INTEGER AS blocks FROM t""")
def index_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, live = _index(spark, sf_dir)
    return index.parts(spark, path).join(live.select("content"), "content", "left_semi").select("source", "records", r6(F.col("mean")).alias("mean"), "blocks")


@query("r02_scan", f"WITH {BM25} SELECT source, record, score FROM f")
def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(read(spark, sf_dir, "documents", "doc_id", "source", "text"), LEXICAL, "source", "doc_id", "text")


@query("r05_scoped_search", f"WITH {BM25} SELECT source, record, score FROM f WHERE source IN ('src1', 'src2')")
def scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, LEXICAL, ["src1", "src2", "absent"]).scored().drop("content")


@query("r02_bm25", f"WITH {BM25} SELECT source, record, score, rank::INTEGER AS rank, round(1 / (60 + rank), 9) AS rrf FROM f")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _search(spark, sf_dir, LEXICAL).scored().drop("content")
    return retrieval.fused(hits).withColumn("rrf", F.round("rrf", 9))


@query("r02_top", f"WITH {BM25} SELECT source, record, score, rank::INTEGER AS rank FROM f WHERE rank <= 10")
def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, LEXICAL).top(10)


@query("l03_merged_page", f"WITH {BM25} SELECT source, record, score, rank::INTEGER AS rank, round(1 / (60 + rank), 9) AS rrf FROM f ORDER BY rank, source, record LIMIT 20")
def merged_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No source has more hits on a page than the page has places."""
    hits = _search(spark, sf_dir, LEXICAL).top(20).drop("rank")
    return retrieval.page(hits, 20).withColumn("rrf", F.round("rrf", 9))


#: Queries of all widths, from a term of nearly all documents to one that none holds.
WIDTHS = ("the", "of the", "der die", "que", "stella", "zzzz")


@query("r05_guarded", " UNION ALL ".join(f"""SELECT '{q}' AS query, count(*) > 1000 AS refused, CASE WHEN count(*) <= 1000 THEN count(*) END AS hits FROM (SELECT {TOKENS} AS tok FROM documents) WHERE {" AND ".join(f"list_contains(tok, '{t}')" for t in q.split())}""" for q in WIDTHS))
def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broad queries are refused over the whole table; the others give all their hits."""
    path, live = _index(spark, sf_dir)

    def answer(text: str) -> DataFrame:
        try:
            hits = index.Search(spark, path, live, text).guarded()
        except retrieval.QueryError:
            return live.limit(1).select(F.lit(text).alias("query"), F.lit(True).alias("refused"), F.lit(None).cast("long").alias("hits"))
        return hits.agg(F.lit(text).alias("query"), F.lit(False).alias("refused"), F.count("*").alias("hits"))

    return functools.reduce(DataFrame.unionByName, map(answer, WIDTHS))


@query("r06_changed_ranges", """WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, true AS changed FROM s WHERE source IN (SELECT source FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)) UNION ALL SELECT source, false FROM s WHERE source NOT IN (SELECT source FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents))""")
def changed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last document is edited: of its source one range gets another digest, and no other source changes."""
    docs = read(spark, sf_dir, "documents", *DOCUMENTS)
    last = F.broadcast(docs.agg(F.max("doc_id").alias("last")))
    edited = docs.join(last).withColumn("text", F.when(F.col("doc_id") == F.col("last"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))).drop("last")
    kept, live = (index.leaves(x, *DOCUMENTS).select("source", "range", "digest") for x in (docs, edited))
    both = kept.join(live.withColumnRenamed("digest", "now"), ["source", "range"], "full")
    n = F.count_if(~F.col("digest").eqNullSafe(F.col("now")))
    return both.groupBy("source").agg(n.alias("n")).select("source", F.when(F.col("n") <= 1, F.col("n") == 1).alias("changed"))


@query("r01_postings", f"WITH t AS (SELECT source, {TOKENS} AS tok FROM documents), u AS (SELECT source, unnest(tok) AS term FROM t) SELECT source, term, count(*) AS n FROM u GROUP BY ALL")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.postings(read(spark, sf_dir, "documents", "doc_id", "source", "text"), "source", "doc_id", "text")
    return found.groupBy("source", "term").agg(F.count("*").alias("n"))


@query("r07_excerpt", """SELECT doc_id, greatest(position('the' IN lower(text)) - 1 - 128, 0)::INTEGER AS start, sha256(substring(text, greatest(position('the' IN lower(text)) - 1 - 128, 0) + 1, 512)) AS sha FROM documents""")
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, part = retrieval.excerpt(F.col("text"), "the")
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", start.alias("start"), F.sha2(part, 256).alias("sha"))


@query("r08_vector_topk", """SELECT 0::BIGINT AS query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT e.vec_id, round(list_inner_product(e.embedding::double[], q.embedding::double[]), 6) AS score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)) WHERE rank <= 20""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    one = vectors.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.vector_hits(vectors, F.broadcast(one), 20)


@query("r09_best_child", """SELECT label, vec_id, score FROM (SELECT e.label, e.vec_id, round(list_inner_product(e.embedding::double[], q.embedding::double[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1""")
def best_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    one = vectors.where("vec_id = 0").select(F.col("embedding").alias("query"))
    scored = vectors.crossJoin(F.broadcast(one)).withColumn("score", r6(T.dot(F.col("embedding"), F.col("query"))))
    return retrieval.best_child(scored.select("label", "vec_id", "score"), "label", "vec_id")


@query("r14_leader_clusters", """WITH RECURSIVE t AS (SELECT label, vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings)),
r AS (SELECT label, i, vec_id AS id, vec_id AS leader, [{'id': vec_id, 'v': v}] AS kept FROM t WHERE i = 1
UNION ALL SELECT t.label, t.i, t.vec_id, coalesce(hit, t.vec_id), CASE WHEN hit IS NULL THEN list_append(r.kept, {'id': t.vec_id, 'v': t.v}) ELSE r.kept END
FROM r JOIN t ON t.label = r.label AND t.i = r.i + 1, LATERAL (SELECT list_filter(r.kept, lambda k: list_inner_product(k.v, t.v) >= 0.9)[1].id AS hit)) SELECT label, id, leader FROM r""")
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return folds.leaders(vectors, "label", 0.9)


EVALUATED = """q AS (SELECT min(vec_id) AS query_id, label FROM embeddings GROUP BY label), s AS (SELECT q.query_id, e.vec_id AS target, round(list_inner_product(e.embedding::double[], v.embedding::double[]), 6) AS score, e.label = q.label AS good FROM q JOIN embeddings v ON v.vec_id = q.query_id, embeddings e),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target) AS rank FROM s), f AS (SELECT query_id, count(*) FILTER (good AND rank <= 10) AS rel, min(rank) FILTER (good AND rank <= 10) AS first, sum(CASE WHEN good AND rank <= 10 THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg, count(*) FILTER (good) AS wanted FROM h GROUP BY query_id),
i AS (SELECT query_id, sum(1 / log2(r + 1.0)) AS idcg FROM (SELECT query_id, unnest(range(1, least(wanted, 10) + 1)) AS r FROM f) GROUP BY query_id),
e AS (SELECT query_id, round(rel / 10, 6) AS precision, round(rel / wanted, 6) AS recall, round(coalesce(1 / first, 0), 6) AS rr, round(dcg / idcg, 6) AS ndcg FROM f JOIN i USING (query_id))"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    chosen = vectors.groupBy("label").agg(F.min("vec_id").alias("query_id"))
    queries = vectors.join(chosen.select(F.col("query_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    hits = retrieval.vector_hits(vectors, queries, 10).withColumnRenamed("vec_id", "target")
    gold = vectors.join(chosen, "label").select("query_id", F.col("vec_id").alias("target"), F.lit(1).alias("grade"))
    found = evaluation.ranking_metrics(hits, gold, 10)
    return found.select("query_id", *(r6(F.col(c)).alias(c) for c in ("precision", "recall", "rr", "ndcg")))


@query("e01_ranking_metrics", f"WITH {EVALUATED} SELECT * FROM e")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)


@query("e03_macro", f"WITH {EVALUATED}, l AS (UNPIVOT e ON precision, recall, rr, ndcg INTO NAME metric VALUE v) SELECT metric, round(avg(v), 5) AS mean, count(v) AS used, count(*) - count(v) AS excluded FROM l GROUP BY metric")
def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.macro(_evaluated(spark, sf_dir), ["precision", "recall", "rr", "ndcg"]).withColumn("mean", F.round("mean", 5))


@query("e15_contradictions", r"""WITH l AS (SELECT doc_id, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '\s+', ' ', 'g')) AS f FROM documents), b AS (SELECT *, trim(regexp_replace(regexp_replace(f, '\b(the|der)\b', '', 'g'), '\s+', ' ', 'g')) AS bare FROM l)
SELECT sha256(bare) AS sha, count(*) FILTER (f <> bare) AS n_negated, count(*) FILTER (f = bare) AS n_plain, min(doc_id) FILTER (f <> bare) AS first_negated, min(doc_id) FILTER (f = bare) AS first_plain FROM b WHERE bare <> '' GROUP BY bare HAVING count(*) FILTER (f <> bare) > 0 AND count(*) FILTER (f = bare) > 0""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts hold no negations, so two frequent articles stand in for them."""
    lines = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    found = evaluation.contradictions(lines, "doc_id", "line", r"\b(the|der)\b")
    return found.select(F.sha2("bare", 256).alias("sha"), "n_negated", "n_plain", "first_negated", "first_plain")


@query("e08_findings", """SELECT doc_id, 'short' AS code, 'warning' AS severity FROM documents WHERE n_chars < 50 UNION ALL SELECT doc_id, 'length', 'error' FROM documents WHERE length(text) <> n_chars UNION ALL SELECT doc_id, 'table', 'warning' FROM documents WHERE contains(text, ' | ')""")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    rules = {"short": ("warning", F.col("n_chars") < 50), "length": ("error", F.length("text") != F.col("n_chars")), "table": ("warning", F.contains("text", F.lit(" | ")))}
    return evaluation.findings(docs, "doc_id", rules)


@query("e08_status", """SELECT doc_id, 0::BIGINT AS errors, (n_chars < 50)::BIGINT + contains(text, ' | ')::BIGINT AS warnings, CASE WHEN n_chars < 50 OR contains(text, ' | ') THEN 'passed_with_warnings' ELSE 'passed' END AS status FROM documents""")
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.audit_status(findings(spark, sf_dir), read(spark, sf_dir, "documents", "doc_id"), "doc_id")


@query("e07_compared", "SELECT c_custkey, s_suppkey IS NOT NULL AND c_nationkey = s_nationkey AS same_nation FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey").withColumnRenamed("c_nationkey", "nation")
    right = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").toDF("c_custkey", "nation")
    return evaluation.compared(left, right, "c_custkey", ["nation"])


@query("e12_integrity", "SELECT l_orderkey, count(*) AS \"references\" FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.integrity(read(spark, sf_dir, "lineitem", "l_orderkey"), read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey")


@query("e18_coverage", """WITH d AS (SELECT doc_id, count(*) AS times, sum(1) AS done FROM labels GROUP BY doc_id) SELECT count(*) FILTER (p.doc_id IS NOT NULL AND times = 1) AS once, count(*) FILTER (p.doc_id IS NOT NULL AND times > 1) AS repeated, count(*) FILTER (times IS NULL) AS missing, count(*) FILTER (p.doc_id IS NULL) AS unknown,
count(p.doc_id) = coalesce(sum(done), 0) AS sizes_agree FROM documents p FULL JOIN d USING (doc_id)""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = read(spark, sf_dir, "documents", "doc_id").withColumn("size", F.lit(1))
    return evaluation.coverage(planned, read(spark, sf_dir, "labels", "doc_id").withColumn("size", F.lit(1)), "doc_id", "size")


@query("l07_flatten_first", """WITH h AS (SELECT 1 AS q, doc_id, length(text) AS d FROM documents WHERE contains(text, 'the ') UNION ALL SELECT 2, doc_id, length(text) + 1 FROM documents WHERE contains(text, 'of ')) SELECT q, doc_id, d FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY q, d) = 1""")
def flatten_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    one = docs.where(F.contains("text", F.lit("the "))).select(F.lit(1).alias("q"), "doc_id", F.length("text").alias("d"))
    two = docs.where(F.contains("text", F.lit("of "))).select(F.lit(2).alias("q"), "doc_id", (F.length("text") + 1).alias("d"))
    return relational.first_per_key(one.unionByName(two), ["doc_id"], "q", "d")


@query("l08_keyword_topk", """SELECT doc_id, s AS score FROM (SELECT doc_id, (contains(lower(text), 'thing')::INTEGER + contains(lower(text), 'heit')::INTEGER + contains(lower(text), 'eaux')::INTEGER + contains(lower(text), 'thing')::INTEGER) AS s FROM documents) WHERE s > 0 ORDER BY s DESC, doc_id LIMIT 50""")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", retrieval.keyword_score(F.col("text"), "thing heit eaux thing").alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(50)


@query("r12_hybrid", """WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part)
SELECT p_partkey, round(coalesce(1 / (60 + a.r), 0) + coalesce(1 / (60 + b.r), 0), 9) AS rrf FROM (SELECT * FROM a WHERE r <= 100) a FULL JOIN (SELECT * FROM b WHERE r <= 100) b USING (p_partkey)""")
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.functions.base import numbered

    parts = read(spark, sf_dir, "part", "p_partkey", "p_retailprice", "p_size")
    a = numbered(parts.orderBy(F.desc("p_retailprice"), "p_partkey").limit(100), F.desc("p_retailprice"), F.col("p_partkey"), name="rank")
    b = numbered(parts.orderBy(F.desc("p_size"), "p_partkey").limit(100), F.desc("p_size"), F.col("p_partkey"), name="rank")
    return retrieval.hybrid(a, b, "p_partkey").withColumn("rrf", F.round("rrf", 9))


@query("r18_expanded", "WITH n AS (SELECT conv_id, turn, role, lag(turn) OVER w AS b, lead(turn) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT DISTINCT conv_id * 100 + unnest(list_filter([b, turn, a], lambda x: x IS NOT NULL)) AS id FROM n WHERE role = 'system'")
def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    return retrieval.expanded(turns.where("role = 'system'"), turns, "id", "conv_id", "turn")


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("m01_numeric_profile", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS n, count(*) FILTER (isnan({c}::DOUBLE)) AS nan, count(*) FILTER (isinf({c}::DOUBLE)) AS infinite, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, {', '.join(f"round(quantile_cont({c}, {q}), 6) AS q{int(q * 100):02d}" for q in profile.QUANTILES)}, round(skewness({c}), 5) AS skew, round(kurtosis({c}), 5) AS kurtosis FROM lineitem""" for c in NUMERIC))
def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.numeric(read(spark, sf_dir, "lineitem", *NUMERIC), NUMERIC)


@query("m02_categorical_profile", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS n_unique, 0::BIGINT AS nulls, string_agg(v || '=' || n, ', ' ORDER BY r) FILTER (r <= 10) AS top_values FROM (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r FROM orders GROUP BY {c})""" for c in ("o_orderstatus", "o_orderpriority")))
def categorical_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.categorical(read(spark, sf_dir, "orders", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"])


@query("m03_summary", " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) AS "unique", (SELECT count(*) FROM part) - (SELECT count(*) FROM (SELECT DISTINCT * FROM part)) AS repeated FROM part""" for c, t in (("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double"))))
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.summary(read(spark, sf_dir, "part"))


@query("m04_outliers", " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(l, 6) AS low, round(h, 6) AS high, (SELECT count(*) FROM events WHERE value < l OR value > h) AS outside FROM (SELECT a - 1.5 * (b - a) AS l, b + 1.5 * (b - a) AS h FROM (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events))""" for c in ("value",)))
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.outliers(read(spark, sf_dir, "events", "value"), ["value"])


@query("m05_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]))
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.correlations(read(spark, sf_dir, "lineitem", *NUMERIC), NUMERIC)


@query("m06_pca", None)
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, shares = profile.principal_components(read(spark, sf_dir, "lineitem", *NUMERIC), NUMERIC, 3)
    return spark.createDataFrame([(i + 1, round(s, 6), round(sum(shares[: i + 1]), 6)) for i, s in enumerate(shares)], "component int, share double, cumulative double")


@query("m09_normal_variate", """WITH v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings), u AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e)))::INTEGER AS i FROM v) SELECT vec_id, i, round((x - avg(x) OVER (PARTITION BY vec_id)) / stddev_samp(x) OVER (PARTITION BY vec_id), 5) + 0.0 AS x FROM u""")
def normal_variate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return v.select("vec_id", F.posexplode(profile.normal_variate(F.col("e"))).alias("i", "x")).withColumn("x", F.round("x", 5) + 0.0)


@query("m09_scatter", """WITH u AS (SELECT vec_id, unnest(embedding::double[]) AS x, unnest(range(64))::INTEGER AS i FROM embeddings), m AS (SELECT i, avg(x) AS m FROM u GROUP BY i), j AS (SELECT * FROM u JOIN m USING (i)), l AS (SELECT vec_id, regr_slope(x, m) AS s, regr_intercept(x, m) AS o FROM j GROUP BY vec_id) SELECT vec_id, i, round((x - o) / s, 3) + 0.0 AS x FROM j JOIN l USING (vec_id) WHERE abs(s) > 0.01""")
def scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    parts = v.select("vec_id", F.posexplode("e").alias("i", "x"))
    mean = parts.groupBy("i").agg(F.avg("x").alias("m"))
    steep = parts.join(mean, "i").groupBy("vec_id").agg(F.regr_slope("x", "m").alias("s")).where("abs(s) > 0.01")
    return profile.scatter_corrected(v, "vec_id", "e").join(steep, "vec_id", "left_semi").withColumn("x", F.round("x", 3) + 0.0)


@query("m10_identities", None)
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.verified_identities(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), "vec_id", "label", "embedding")
    return found.select("vec_id", "label", r6(F.col("q")).alias("q"), r6(F.col("t2")).alias("t2"), "accepted", "accepting")

