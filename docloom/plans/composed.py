"""Queries of composed operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.base import r6, read
from docloom.operators import layout, materials, pipelines
from docloom.plans.registry import query
from docloom.sources import office


@query("s30_discovered", "SELECT page_id, len(regexp_extract_all(html, '<a href'))::BIGINT AS links, 0::BIGINT AS below_heading FROM pages WHERE contains(html, '<a href')")
def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = office.discovered(read(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html")
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count("section").alias("below_heading"))


@query("s30_sections", """WITH s AS (SELECT conv_id, turn, role, max(CASE WHEN turn % 3 = 1 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations)
SELECT conv_id, CASE WHEN h IS NOT NULL THEN 'Part ' || h END AS section, role AS title, 'w' || conv_id || '/' || turn || '.html' AS url FROM s""")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as saved pages: a link per turn, a heading before every third; links before the first heading have no section."""
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    heading = F.when(F.col("turn") % 3 == 1, F.format_string("<h2>Part <i>%d</i></h2>", "turn")).otherwise("")
    line = F.concat(heading, F.format_string('<p>see <a class=x href="w%d/%d.html"> %s </a>.', "conv_id", "turn", "role"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    pages = turns.groupBy("conv_id").agg(F.array_join(parts, "\n").alias("html"))
    return office.discovered(pages, "conv_id", "html").select("conv_id", "section", "title", "url")


@query("m11_embedded", r"""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS t FROM conversations),
c AS (SELECT conv_id, turn, ('0x' || sha256(t)[64:64])::INTEGER AS i, count(*) AS n FROM t GROUP BY ALL), l AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS len FROM c GROUP BY ALL)
SELECT conv_id, turn, i, round(n / len, 6) AS v FROM c JOIN l USING (conv_id, turn)""")
def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("key", F.struct("conv_id", "turn"))
    vectors = pipelines.embedded(turns, "key", "text").select("key.conv_id", "key.turn", F.posexplode("vector").alias("i", "v"))
    return vectors.where("v > 0").withColumn("v", r6(F.col("v")))


@query("k10_chunk_store", "SELECT doc_id::varchar AS id, n_chars::varchar AS n, lang FROM documents")
def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = pipelines.chunk_store(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "n_chars"), "doc_id", "text", ["lang", "n_chars"])
    return stored.select("id", F.col("metadata")["n_chars"].alias("n"), F.col("metadata")["lang"].alias("lang"))


@query("k11_over_capacity", "SELECT label, n FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) > 50 UNION ALL SELECT NULL, count(*) FROM embeddings HAVING count(*) > 100)")
def over_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.over_capacity(read(spark, sf_dir, "embeddings", "label"), "label", 50, 100)


@query("f17_parsed_times", "SELECT o_orderkey, epoch_us(o_orderdate) AS at FROM orders")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.unix_micros(pipelines.parsed_times(text)).alias("at"))


@query("d01_union", "SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL FROM supplier")
def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment").toDF("id", "nation", "segment")
    return pipelines.all_of([customers, read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").toDF("id", "nation")])


@query("d02_ordered_distinct", "WITH r AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM r GROUP BY conv_id")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return turns.select("conv_id", F.array_join(F.array_distinct(F.transform("x", lambda r: r["role"])), ",").alias("roles"))


@query("a28_page_metadata", """SELECT l_orderkey AS page, median(l_quantity) AS median_size, max(l_quantity) AS max_size, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS fonts,
round(avg((l_linestatus = 'O')::INTEGER), 6) AS bold_share, min(l_discount) AS left_indent, max(l_tax) AS right_indent FROM lineitem GROUP BY l_orderkey""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_returnflag", "l_linestatus", "l_discount", "l_tax")
    words = words.select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("size"), F.col("l_returnflag").alias("font"), (F.col("l_linestatus") == "O").alias("is_bold"), F.col("l_discount").alias("x_start"), F.col("l_tax").alias("x_end"))
    return layout.page_metadata(words).withColumn("fonts", F.array_join("fonts", ",")).withColumn("bold_share", r6(F.col("bold_share")))


@query("a36_reference_coverage", """SELECT user_id, count_if(event_type = 'view') AS "view", count_if(event_type = 'click') AS click, count_if(value > 50) AS supported,
round(count_if(value > 50) / count(*), 6) AS supported_share FROM events GROUP BY user_id""")
def reference_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", "user_id", "event_type", "value")
    found = materials.reference_coverage(events, "user_id", "event_type", ["view", "click"], F.col("value") > 50)
    return found.withColumn("supported_share", r6(F.col("supported_share")))
