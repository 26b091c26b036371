"""Queries of scalar functions, predicates and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.base import r6, read
from docloom.operators import filters
from docloom.plans.registry import query


@query("f01_deterministic_id", "SELECT item_id, 'item:' || sha256(to_json(['item', item_id::varchar, text])::varchar) AS id FROM benchmark")
def deterministic_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", T.deterministic_id("item", F.col("item_id").cast("string"), F.col("text")).alias("id"))


@query("f02_canonical_json", "SELECT c_custkey, to_json({c_mktsegment: c_mktsegment, c_name: c_name, c_nationkey: c_nationkey})::varchar AS js FROM customer")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return c.select("c_custkey", T.canonical_json({n: F.col(n) for n in ("c_name", "c_nationkey", "c_mktsegment")}).alias("js"))


@query("f03_f04_hashes", "SELECT doc_id, sha256(text) AS sha, sha256(trim(text))[1:16] AS short FROM documents")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.sha(F.col("text")).alias("sha"), T.short_hash(F.col("text")).alias("short"))


@query("f06_knowledge_id", "SELECT doc_id, 'K_' || sha256(concat_ws('|', source, doc_id, lang))[1:12] AS id FROM documents")
def knowledge_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "source", "lang").select("doc_id", T.knowledge_id(F.col("source"), F.col("doc_id").cast("string"), F.col("lang")).alias("id"))


@query("f12_without_controls", r"SELECT doc_id, sha256(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) AS sha FROM documents")
def without_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2(T.without_controls(F.col("text")), 256).alias("sha"))


@query("f13_normalized", r"""SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS folded, sha256(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))) AS dup FROM documents""")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.sha2(T.folded_blanks(F.col("text")), 256).alias("folded"), F.sha2(T.duplicate_key(F.col("text")), 256).alias("dup"))


@query("f10_latex_issues", """SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN len(replace(text, '{', '')) <> len(replace(text, '}', '')) THEN 'braces' END,
CASE WHEN len(replace(text, '(', '')) <> len(replace(text, ')', '')) THEN 'parentheses' END, CASE WHEN len(replace(text, '[', '')) <> len(replace(text, ']', '')) THEN 'brackets' END], lambda x: x IS NOT NULL), ',') AS issues FROM documents""")
def latex_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.array_join(T.latex_issues(F.col("text")), ",").alias("issues"))


@query("f20_features", r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INTEGER AS n_words, length(text)::INTEGER AS n_chars, regexp_matches(text, '\p{L}-\s*$') AS end_hyphen,
regexp_matches(text, '[.!?][''")\]]?\s*$') AS sentence_end, len(regexp_extract_all(text, '[.,;:!?]'))::INTEGER AS punctuation FROM documents""")
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.features(F.col("text")).alias("f")).select("doc_id", "f.*")


@query("f21_plain_links", r"""WITH l AS (SELECT doc_id, regexp_extract_all(text, 'https?://[^\s<>"'']+') AS x FROM documents), u AS (SELECT doc_id, rtrim(unnest(x), '.,);]') AS u, unnest(range(len(x))) AS i FROM l)
SELECT doc_id, string_agg(u, ' ' ORDER BY i) AS links FROM (SELECT doc_id, u, min(i) AS i FROM u GROUP BY doc_id, u) GROUP BY doc_id""")
def plain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.plain_links(F.col("text")).alias("x"))
    return found.where(F.size("x") > 0).select("doc_id", F.array_join("x", " ").alias("links"))


@query("f21_html_links", r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS x FROM pages), u AS (SELECT page_id, unnest(x) AS u, unnest(range(len(x))) AS i FROM l)
SELECT page_id, string_agg(u, ' ' ORDER BY i) AS links FROM (SELECT page_id, u, min(i) AS i FROM u GROUP BY page_id, u) GROUP BY page_id""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "pages", "page_id", "html").select("page_id", T.html_links(F.col("html")).alias("x"))
    return found.where(F.size("x") > 0).select("page_id", F.array_join("x", " ").alias("links"))


@query("f23_vector_check", """SELECT vec_id, len(embedding) = 64 AND abs(sqrt(list_inner_product(embedding::double[], embedding::double[])) - 1) <= 1e-5 AS ok FROM embeddings""")
def vector_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", T.unit_vector_ok(F.col("embedding"), 64).alias("ok"))


@query("f25_hash_embedding", r"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS t FROM benchmark),
c AS (SELECT item_id, ('0x' || sha256(t)[64:64])::INTEGER AS i, count(*) AS n FROM t GROUP BY ALL), l AS (SELECT item_id, sqrt(sum(n * n)) AS len FROM c GROUP BY item_id)
SELECT item_id, i, round(n / len, 6) AS v FROM c JOIN l USING (item_id)""")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.hash_embedding(F.col("text"))).alias("i", "v"))
    return items.where("v > 0").withColumn("v", r6(F.col("v")))


@query("f26_token_count", r"SELECT doc_id, (len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) + 2)::INTEGER AS n FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.token_count(F.col("text")).alias("n"))


@query("f35_similarity", "SELECT event_id, round(1 / (1 + value), 6) AS s FROM events")
def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events", "event_id", "value").select("event_id", r6(T.similarity(F.col("value"))).alias("s"))


@query("f36_safe_json", "SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def safe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events", "event_id", "props").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("p01_blocks", "SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.blocks_of(read(spark, sf_dir, "conversations"), ("user", "assistant"), "role", "text").select("conv_id", "turn")


@query("p07_mail_filter", "SELECT doc_id FROM documents WHERE contains(lower(text), lower('License'))")
def mail_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").where(filters.matches_text("text", "License")).select("doc_id")


@query("p08_facts", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS l FROM documents) WHERE length(l) >= 20 AND NOT regexp_matches(lower(l), '^(kommentar|leitlinie)') GROUP BY doc_id")
def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.where(filters.is_fact(F.col("l"))).groupBy("doc_id").agg(F.count("*").alias("n"))


CUES = {"license": "(?i)licen[sc]e", "mail": r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", "phone": r"\(\d{3}\)", "shout": r"[A-Z]{4,}!!"}


@query("p10_cues", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in CUES.items()) + "], lambda x: x IS NOT NULL), ',') AS cues FROM documents")
def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.array_join(filters.cues(F.col("text"), CUES), ",").alias("cues"))


@query("p13_url_class", r"""SELECT page_id, CASE WHEN regexp_matches(lower(url), 'youtube\.|youtu\.be|vimeo\.|\.mp4([?#]|$)') THEN 'video' WHEN regexp_matches(lower(url), '\.pdf([?#]|$)') OR regexp_matches(lower(t), 'script|skript') THEN 'script'
WHEN regexp_matches(lower(url), '\.(html?|zip|docx?|pptx?)([?#]|$)') THEN 'material' ELSE 'other' END AS class, CASE WHEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) <> 'example.org' AND NOT ends_with(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.example.org') THEN 'external'
WHEN regexp_matches(url, '(?i)\.(pdf|docx?|zip|ipynb|csv)([?#]|$)') THEN 'document' ELSE 'page' END AS relation, nullif(regexp_extract(url, '^[a-z]+://[^/]+/(en|de|fr|es)/', 1), '') AS lang
FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)""")
def url_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    title, url = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.col("url")
    return pages.select("page_id", filters.link_class(url, title).alias("class"), filters.link_relation(url, "example.org").alias("relation"), filters.url_language(url, ("en", "de", "fr", "es")).alias("lang"))


@query("p19_file_class", "SELECT page_id, CASE WHEN regexp_matches(url, '(?i)\\.html?$') THEN 'document' ELSE 'other' END AS class FROM pages")
def file_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", filters.file_class(F.element_at(F.split("url", "/"), -1)).alias("class"))


@query("p25_line_class", r"""SELECT doc_id, class, count(*) AS n FROM (SELECT doc_id, CASE WHEN trim(l) = '' THEN 'other' WHEN regexp_matches(l, '^\s*([-*•]|\d+[.)])\s') THEN 'bullet' WHEN len(list_filter(regexp_split_to_array(l, '\s+'), lambda w: w <> '')) < 10 AND NOT regexp_matches(l, '[.!?]\s*$') THEN 'heading'
WHEN regexp_matches(l, '[.!?]\s*$') THEN 'body' ELSE 'other' END AS class FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) GROUP BY ALL""")
def line_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.groupBy("doc_id", filters.line_class(F.col("l")).alias("class")).agg(F.count("*").alias("n"))


@query("p31_payload", "SELECT o_orderkey, cardinality(MAP {'status': o_orderstatus, 'priority': o_orderpriority})::INTEGER AS n, o_orderstatus AS status FROM orders")
def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").withColumnsRenamed({"o_orderstatus": "status", "o_orderpriority": "priority"})
    return orders.select("o_orderkey", filters.payload(orders, ["status", "priority"]).alias("m")).select("o_orderkey", F.size("m").alias("n"), F.col("m")["status"].alias("status"))


@query("p34_queries", """WITH c AS (SELECT source, list_sort(list_distinct(list(lang))) AS l FROM documents GROUP BY source) SELECT source, unnest(list_concat([source], list_transform(l, lambda x: source || ': ' || x))) AS q FROM c""")
def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = read(spark, sf_dir, "documents", "source", "lang").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("l"))
    return topics.select("source", F.explode(filters.expanded_queries("source", "l")).alias("q"))


@query("p39_subtitle_choice", """WITH o AS (SELECT source, lang, CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 2 END AS r FROM documents) SELECT source, min_by(lang, r) AS lang FROM o GROUP BY source""")
def subtitle_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = read(spark, sf_dir, "documents", "source", "lang").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    return filters.subtitle_choice(offers, "source", "langs", ("de", "fr"))
