"""Queries of planning, layout, formulas and evaluation gates."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import formulas
from docloom.functions.base import r6, read
from docloom.operators import evaluation, layout, materials
from docloom.plans.registry import query


@query("p24_problems", "SELECT batch_id, item_id, issue FROM (SELECT o_custkey AS batch_id, o_orderkey AS item_id, unnest(list_filter([CASE WHEN o_totalprice > 400000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'open' END], lambda x: x IS NOT NULL)) AS issue FROM orders)")
def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    issues = F.array_compact(F.array(F.when(F.col("o_totalprice") > 400000, "large"), F.when(F.col("o_orderstatus") == "P", "open")))
    return materials.problems(orders.groupBy(F.col("o_custkey").alias("batch_id")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), issues.alias("issues"))).alias("items")))


@query("p06_unsafe", "SELECT doc_id, NOT (regexp_matches(source || ':' || lang, '^[A-Za-z0-9._:-]{1,128}$') AND regexp_matches(lang, '^[a-z][a-z_]{0,31}$')) AS unsafe FROM documents")
def unsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "lang")
    return docs.select("doc_id", materials.unsafe_metadata(F.concat_ws(":", "source", "lang"), F.col("lang")).alias("unsafe"))


@query("p28_url_policy", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN NULL ELSE 'scheme' END AS problem FROM pages")
def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", materials.url_policy("url").alias("problem"))


@query("j09_batch_context", """WITH s AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e, length(text) AS n FROM conversations)
SELECT b.conv_id * 100 + b.turn AS batch_id, string_agg(s.turn, ',' ORDER BY s.turn) AS segments FROM s b JOIN s ON s.conv_id = b.conv_id AND s.e - s.n <= b.e + 100 AND s.e >= greatest(0, b.e - b.n - 100) GROUP BY 1""")
def batch_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("n", F.length("text").cast("double"))
    end = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    segments = turns.withColumn("end", end).select(F.col("conv_id").alias("source_id"), F.col("turn").alias("seg_id"), (F.col("end") - F.col("n")).alias("start"), "end")
    batches = segments.select("source_id", (F.col("source_id") * 100 + F.col("seg_id")).alias("batch_id"), "start", "end")
    return materials.batch_context(batches, segments, 100).select("batch_id", F.array_join("segments", ",").alias("segments"))


@query("j04_committed", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").withColumnRenamed("l_orderkey", "run_id")
    runs = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "committed").alias("state"))
    return materials.committed(lines, runs).withColumnRenamed("run_id", "l_orderkey")


@query("j23_material_plan", """WITH l AS (SELECT DISTINCT s_suppkey, s_nationkey FROM supplier), c AS (SELECT c_custkey, c_nationkey FROM customer) SELECT c_custkey, coalesce(string_agg(s_suppkey, ',' ORDER BY s_suppkey), '') AS lectures FROM c LEFT JOIN l ON c_nationkey = s_nationkey GROUP BY c_custkey""")
def material_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    resources = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select(F.col("c_custkey").alias("resource_id"), F.array("c_nationkey").alias("sections"))
    lectures = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_suppkey").alias("lecture_id"), F.array("s_nationkey").alias("sections"))
    return materials.material_plan(resources, lectures, ",").withColumnRenamed("resource_id", "c_custkey")


@query("j17_lecture_tasks", """WITH d AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS k FROM orders GROUP BY o_custkey) SELECT coalesce(c_custkey, o_custkey) AS lecture_id, CASE WHEN n = 1 AND s_suppkey IS NOT NULL THEN k END AS resource_id,
CASE WHEN n IS NULL THEN 'undecided' WHEN n > 1 THEN 'ambiguous' WHEN s_suppkey IS NULL THEN 'missing_resource' ELSE 'ready' END AS status FROM customer FULL JOIN d ON c_custkey = o_custkey LEFT JOIN supplier ON k = s_suppkey""")
def lecture_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lectures = read(spark, sf_dir, "customer", "c_custkey").toDF("lecture_id")
    decisions = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey").toDF("lecture_id", "resource_id")
    return materials.lecture_tasks(lectures, decisions, read(spark, sf_dir, "supplier", "s_suppkey").toDF("resource_id"))


@query("a18_axis_counts", "SELECT axis, value, count(*) AS n, value <> 'unknown' AS reviewed FROM (UNPIVOT (SELECT o_orderstatus, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown' ELSE o_orderpriority END AS o_orderpriority FROM orders) ON o_orderstatus, o_orderpriority INTO NAME axis VALUE value) GROUP BY axis, value")
def axis_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders", "o_orderstatus", "o_orderpriority")
    orders = orders.withColumn("o_orderpriority", F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "unknown").otherwise(F.col("o_orderpriority")))
    return materials.axis_counts(orders, ["o_orderstatus", "o_orderpriority"])


@query("a25_validation_report", "SELECT lang AS kind, count(*) AS n, count(quality) AS complete, min(doc_id) FILTER (quality IS NULL) AS first_incomplete FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materials.validation_report(_labelled(spark, sf_dir), ["quality"])


@query("a25_incomplete", "SELECT lang AS kind, doc_id AS resource_id, 'quality' AS lacks FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materials.incomplete(_labelled(spark, sf_dir), ["quality"]).withColumn("lacks", F.array_join("lacks", ","))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "lang").join(read(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    return docs.withColumnsRenamed({"lang": "kind", "doc_id": "resource_id"})


@query("a32_first_outputs", "SELECT event_type AS kind, user_id AS identity, event_id AS ordinal FROM events WHERE value > 1 QUALIFY row_number() OVER (PARTITION BY event_type, user_id, props ORDER BY event_id) = 1")
def first_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", "event_id", "event_type", "user_id", "props", "value").withColumn("valid", F.col("value") > 1)
    return materials.first_outputs(events.withColumnsRenamed({"event_type": "kind", "user_id": "identity", "props": "sha", "event_id": "ordinal"})).select("kind", "identity", "ordinal")


@query("a39_overview", "SELECT o_custkey AS course_id, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY o_custkey")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materials.overview(read(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").toDF("course_id", "format"), ["F", "O"])


@query("a37_histograms", """SELECT "column", value, count(*) AS n FROM (UNPIVOT (SELECT lang, source FROM documents) ON lang, source INTO NAME "column" VALUE value) GROUP BY ALL""")
def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materials.histograms(read(spark, sf_dir, "documents", "lang", "source"), ["lang", "source"])


@query("a38_schedule_totals", "SELECT key, total, have = n AS complete FROM (SELECT key, sum(value)::BIGINT AS total, count(*) AS have FROM (SELECT 'chars' AS key, n_chars AS value FROM documents WHERE lang <> 'en' UNION ALL SELECT 'quality', quality FROM documents JOIN labels USING (doc_id) WHERE lang <> 'en') GROUP BY key), (SELECT count(*) AS n FROM documents WHERE lang <> 'en')")
def schedule_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    metrics = F.map_filter(F.create_map(F.lit("chars"), F.col("n_chars"), F.lit("quality"), F.col("quality").cast("long")), lambda k, v: v.isNotNull())
    return materials.schedule_totals(docs.select(F.when(F.col("lang") != "en", "complete").alias("status"), metrics.alias("metrics")))


@query("l06_normalized_hits", "SELECT 'a' AS collection, event_id AS id, round(1 - value, 6) AS similarity FROM events WHERE trim(event_type) <> '' ORDER BY value, event_id LIMIT 40")
def normalized_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read(spark, sf_dir, "events", "event_id", "event_type", "value").toDF("id", "text", "distance").withColumn("collection", F.lit("a"))
    return materials.normalized_hits(hits, 40).select("collection", "id", r6(F.col("similarity")).alias("similarity"))


@query("l10_history", "SELECT o_orderkey AS job_id FROM orders WHERE o_custkey = 5 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5 OFFSET 2")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").toDF("job_id", "owner", "started_at")
    return materials.history(jobs, 5, 5, 2).select("job_id")


@query("w09_token_windows", r"""WITH b AS (SELECT item_id, length(text) AS n, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS t, regexp_split_to_array(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS g FROM benchmark),
e AS (SELECT item_id, n, list_transform(range(1, len(t) + 1), lambda i: (list_sum(list_transform(t[1:i], lambda x: length(x))) + list_sum(list_transform(g[1:i], lambda x: length(x))))::BIGINT) AS e FROM b),
c AS (SELECT item_id, list_concat([0], list_filter(list_transform(range(32, len(e) + 1, 32), lambda i: e[i]), lambda x: x < n AND x < e[-1]), [n]) AS c FROM e)
SELECT item_id, (k - 1)::INTEGER AS chunk, c[k]::INTEGER AS start, c[k + 1]::INTEGER AS "end" FROM (SELECT *, unnest(range(1, len(c))) AS k FROM c)""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materials.token_windows(read(spark, sf_dir, "benchmark"), "text", 34).select("item_id", "chunk", "start", "end")


@query("r06_stale", "SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) FILTER (c_acctbal < -990) > 0")
def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    digest = lambda df: df.groupBy("c_nationkey").agg(F.sum(F.xxhash64("c_custkey").cast("decimal(38,0)")).cast("string").alias("digest"))
    return materials.stale(digest(customers), digest(customers.where("c_acctbal >= -990")), "c_nationkey")


@query("e02_evaluability", """WITH o AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS n FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS query_id, array_to_string(list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'not_reviewed' END, CASE WHEN o_totalprice <= 100000 THEN 'pool_incomplete' END, CASE WHEN n > 0 THEN 'unjudged_hits' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders LEFT JOIN o ON o_orderkey = l_orderkey""")
def evaluability(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    queries = orders.select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderstatus") == "F", "reviewed").otherwise("open").alias("review_status"), (F.col("o_totalprice") > 100000).alias("pool_complete"))
    hits = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").withColumn("target", F.concat_ws("-", "l_linenumber", "l_partkey", "l_returnflag")).withColumnRenamed("l_orderkey", "query_id")
    return materials.evaluability(queries, hits.where("l_returnflag <> 'N'"), hits).withColumn("reasons", F.array_join("reasons", ","))


@query("e04_cue_template", "SELECT o_orderkey AS query_id, min(l_quantity) AS start, max(l_quantity + 1) AS \"end\", count(*) AS cues FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def cue_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = read(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("query_id"), F.array("o_orderkey").alias("cue_ids"))
    cues = read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").select(F.col("l_orderkey").alias("cue_id"), F.col("l_quantity").alias("start"), (F.col("l_quantity") + 1).alias("end"))
    return materials.cue_template(queries, cues)


@query("e06_bound", "WITH g AS (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS k FROM supplier GROUP BY s_nationkey) SELECT c_custkey, CASE WHEN n = 1 THEN k END AS case_id, CASE WHEN n = 1 THEN 'bound' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS binding FROM customer LEFT JOIN g ON c_nationkey = s_nationkey")
def bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey").toDF("c_custkey", "nation")
    return materials.bound_predictions(predictions, read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").toDF("case_id", "nation"), ["nation"]).drop("nation")


@query("a29_line_boxes", "SELECT user_id AS page, event_type AS line, min(value) AS x0, min(value) AS y0, max(value + 2) AS x1, max(value + 1) AS y1, count(*) AS words FROM events GROUP BY user_id, event_type")
def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "events", "user_id", "event_type", "value").select(F.col("user_id").alias("page"), F.col("event_type").alias("line"), F.col("value").alias("x0"), F.col("value").alias("y0"), (F.col("value") + 2).alias("x1"), (F.col("value") + 1).alias("y1"))
    return layout.line_boxes(words).drop("height", "place")


@query("j19_near_groups", """WITH RECURSIVE b AS (SELECT p_brand AS page, p_partkey AS id, p_size * 20.0 AS x, p_retailprice AS y FROM part),
e AS (SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.page = b.page AND a.x - 3 <= b.x + 5 AND b.x - 3 <= a.x + 5 AND a.y - 3 <= b.y + 5 AND b.y - 3 <= a.y + 5),
r AS (SELECT id, id AS label FROM b UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.id) SELECT page, b.id AS path_id, min(label) AS "group" FROM b JOIN r USING (id) GROUP BY page, b.id""")
def near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice", "p_brand")
    boxes = parts.select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("path_id"), (F.col("p_size") * 20.0).alias("x0"), (F.col("p_size") * 20.0 + 5).alias("x1"), F.col("p_retailprice").alias("y0"), (F.col("p_retailprice") + 5).alias("y1"), F.lit(False).alias("background"))
    return layout.near_groups(boxes, 3.0)


@query("f28_formula_trees", None)
def formula_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").withColumn("text", F.format_string("%d^2 + \\frac{%d}{x} = y_1", F.col("p_size"), F.col("p_partkey")))
    return parts.select("p_partkey", formulas.formula_tree("text").alias("t")).select("p_partkey", "t.*")


#: A formula of each order line, and what is predicted for it, by the order's number: the same text, other spaces, other brackets, the declared part,
#: another sign, another index, nothing, no formula, and letters for commands.
REFERENCE = "\\frac{%d}{x_%d} + \\alpha^{%d}"
PREDICTED = (REFERENCE, "\\frac {%d} {x_%d}+\\alpha ^{%d}", "(\\frac{(%d)}{x_{%d}}) + \\alpha^%d", "\\frac{%d}{x_{%d}}", "\\frac{%d}{x_%d} - \\alpha^{%d}", "\\frac{%d}{x_{%d0}} + \\alpha^{%d}", None, "\\frac{%d}{x_%d", "\\frac{%d}{x_%d} + α^{%d}")
VERDICTS = ("exact", "normalized", "structural", "partial", "different", "different", "missing", "not_evaluable", "normalized")
UNLIKE = ("", "", "", "symbol_error,operator_error,exponent_error,structure_error", "operator_error,structure_error", "symbol_error,subscript_error,fraction_error,structure_error", "", "", "")


def _formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    values = [F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int")]
    written = lambda form: F.lit(None).cast("string") if form is None else F.format_string(form, *values[: form.count("%d")])
    kind = F.col("l_orderkey") % len(PREDICTED)
    predicted = functools.reduce(lambda c, i: F.when(kind == i, written(PREDICTED[i])).otherwise(c), range(len(PREDICTED)), F.lit(None).cast("string"))
    part = F.format_string(PREDICTED[3], *values[:2])
    return lines.select("l_orderkey", "l_linenumber", F.lit("confirmed").alias("status"), written(REFERENCE).alias("reference"), predicted.alias("prediction"), F.array(part).alias("parts"))


@query("e05_verdicts", f"""SELECT l_orderkey, l_linenumber, list_extract({list(VERDICTS)}, 1 + l_orderkey % {len(VERDICTS)}) AS verdict, list_extract({list(UNLIKE)}, 1 + l_orderkey % {len(UNLIKE)}) AS differences, true AS sound FROM lineitem""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.formula_verdicts(_formulas(spark, sf_dir))
    return found.select("l_orderkey", "l_linenumber", "verdict", F.array_join("differences", ",").alias("differences"), "sound")


@query("e05_containing", """WITH r AS (SELECT l_partkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT p_partkey, sum(n)::BIGINT AS holders FROM part JOIN r ON l_partkey = p_partkey AND l_linenumber = 1 + p_partkey % 3 GROUP BY p_partkey""")
def containing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a fraction of each part, how many lines' formulas hold it."""
    lines = _formulas(spark, sf_dir).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), F.col("reference").alias("formula"))
    asked = read(spark, sf_dir, "part", "p_partkey").withColumn("formula", F.format_string("\\frac{%d}{x_{%d}}", F.col("p_partkey"), F.col("p_partkey") % 3 + 1))
    return evaluation.containing(lines, asked, "line", "p_partkey", "formula").groupBy("p_partkey").agg(F.count("*").alias("holders"))
