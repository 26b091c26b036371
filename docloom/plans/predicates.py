"""Predicates, classifiers, look-ups and scalar functions over columns of pages, documents, orders, parts and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import formulas
from docloom.functions import text as T
from docloom.functions.base import numbered, r6, read
from docloom.operators import aggregates, filters, materials, pipelines, relational
from docloom.plans.registry import query
from docloom.sources import sinks

LINES = "l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def _picked(number: Column, *values: object) -> Column:
    """The value at number modulo their count."""
    return reduce(lambda c, i: F.when(F.pmod(number, F.lit(len(values))) == i, F.lit(values[i])).otherwise(c), range(len(values)), F.lit(None).cast("string"))


def _sql_picked(number: str, *values: object) -> str:
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


@query("p03_source_page", "SELECT 'src:' || doc_id AS source_id FROM documents WHERE lang = 'de' AND contains('src:' || doc_id, '7')")
def source_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "lang", "n_chars")
    data = F.to_json(F.struct(F.col("lang").alias("source_type"), "n_chars"))
    return materials.source_page(docs.select(F.concat(F.lit("src:"), "doc_id").alias("source_id"), data.alias("data")), "de", "7").select("source_id")


@query("p04_exclusion", f"""WITH {LINES} SELECT doc_id, line, CASE WHEN line % 11 = 0 THEN 'toc' WHEN line % 7 = 1 THEN 'reference' WHEN line % 3 = 1 AND trim(text) = '' THEN 'empty_list' WHEN contains(text, ' | ') THEN 'table' WHEN trim(text) = '' THEN 'non_text' END AS reason FROM l""")
def exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("line")
    reason = filters.exclusion(n % 11 == 0, n % 7 == 1, F.col("text"), n % 3 == 1, F.contains("text", F.lit(" | ")))
    return _lines(spark, sf_dir).select("doc_id", "line", reason.alias("reason"))


@query("p05_primary_intervals", f"""WITH b AS (SELECT doc_id, {_sql_picked("doc_id", "paragraph", "link", "code", "table", "heading")} AS type, length(text) AS n FROM documents),
s AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'selected' WHEN type IN ('paragraph', 'heading', 'code') THEN 'primary' ELSE 'reference' END AS role FROM b)
SELECT doc_id, role, CASE role WHEN 'selected' THEN '0-' || n // 2 || ',' || n // 2 || '-' || n WHEN 'primary' THEN '0-' || n END AS intervals FROM s""")
def primary_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    half = F.floor(F.length("text") / 2)
    of = lambda a, b: F.struct(F.lit(a).cast("long").alias("start") if isinstance(a, int) else a.cast("long").alias("start"), b.cast("long").alias("end"))
    chosen = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("block_id"), F.inline(F.array(of(half, F.length("text")), of(0, half))))
    blocks = docs.select(F.col("doc_id").alias("block_id"), "text", _picked(F.col("doc_id"), "paragraph", "link", "code", "table", "heading").alias("type"))
    shown = F.array_join(F.transform("intervals", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return materials.primary_intervals(blocks, chosen).select(F.col("block_id").alias("doc_id"), "role", shown.alias("intervals"))


@query("p09_kept_statements", f"""WITH {LINES} SELECT doc_id, line, CASE WHEN line % 4 = 2 THEN 'pending' ELSE 'verified' END AS status FROM l WHERE trim(text) <> ''""")
def kept_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("doc_id", "line", "text", (F.col("line") % 4 == 2).alias("visual"), F.lit("verified").alias("status"))
    return materials.kept_statements(rows).select("doc_id", "line", "status")


@query("p11_of_block", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7)")
def of_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("lecture_blocks"))
    return materials.of_block(held, 7).select("o_orderkey")


@query("p15_nearest_role", "SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN c_mktsegment WHEN c_nationkey % 4 = 1 THEN 'MACHINERY' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS role FROM customer WHERE c_nationkey % 4 <> 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY')")
def nearest_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    context = F.when(F.col("c_nationkey") % 4 == 1, F.array("c_mktsegment", F.lit("x"), F.lit("MACHINERY"), F.lit("y"))).otherwise(F.array(F.lit("x"), "c_mktsegment", F.lit("y")))
    found = c.select("c_custkey", "c_nationkey", materials.nearest_role(context, ("BUILDING", "MACHINERY")).alias("role"))
    return found.where("c_nationkey % 4 <> 0 OR role IS NOT NULL").select("c_custkey", "role")


@query("p16_url_language", r"""SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://[^/]+/(de|en|fr)/', 1), '') AS lang, file_class AS class, CASE WHEN page_id % 4 = 0 THEN NULL WHEN suffix IN ('html', 'htm') THEN 'html' WHEN suffix IN ('srt', 'vtt', 'txt') THEN 'transcript' WHEN suffix = 'md' THEN 'markdown' END AS parser,
CASE WHEN page_id % 4 = 0 THEN 'skipped' WHEN suffix IN ('html', 'htm', 'srt', 'vtt', 'txt', 'md') THEN 'ready' ELSE 'unsupported' END AS status FROM (SELECT page_id, url, suffix, CASE WHEN suffix IN ('srt', 'vtt') THEN 'subtitle' WHEN suffix = 'txt' THEN 'transcript' WHEN suffix IN ('html', 'htm', 'md', 'pdf') THEN 'document' ELSE 'other' END AS file_class
FROM (SELECT page_id, url, lower(regexp_extract(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[?#].*$', '') || CASE page_id % 5 WHEN 0 THEN '.VTT' WHEN 1 THEN '.txt' WHEN 2 THEN '.md' WHEN 3 THEN '.pdf' ELSE '' END, '\.([A-Za-z0-9]+)$', 1)) AS suffix FROM pages))""")
def url_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of a path, class of its file, and the parser for it."""
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    name = F.concat(F.regexp_replace(F.regexp_extract("url", "([^/]*)$", 1), "[?#].*$", ""), _picked(F.col("page_id"), ".VTT", ".txt", ".md", ".pdf", ""))
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    parser = filters.parser_of(suffix, F.when(F.col("page_id") % 4 == 0, "extra").otherwise("primary"))
    return pages.select("page_id", filters.url_language(F.col("url"), ("de", "en", "fr")).alias("lang"), filters.file_class(name).alias("class"), parser["parser"].alias("parser"), parser["status"].alias("status"))


@query("p18_video_kind", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'foundation' ELSE 'supplement' END AS kind, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END AS block FROM part")
def video_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    title = F.concat_ws(" ", "p_name", F.when(size % 3 == 0, "GRUNDLAGEN"), F.when(size % 2 == 0, F.concat(F.lit("Teil "), size)))
    return read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").select("p_partkey", materials.video_kind(title).alias("v")).select("p_partkey", "v.*")


@query("p20_official_subtitle", "SELECT page_id, starts_with(url, 'https://') AND NOT contains(url, '?') AND NOT contains(url, '#') AND page_id % 5 <> 0 AND page_id % 3 <> 2 AS official FROM pages")
def official_subtitle(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    texts = lambda *x: F.array(*map(F.lit, x))
    found = materials.official_subtitle(F.concat("url", F.lit(".vtt")), F.when(n % 5 == 0, texts("a", "z")).otherwise(texts("a", "b")), texts("a", "b", "c"), _picked(n, "p", "q", "r"), texts("p", "q"))
    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", found.alias("official"))


@query("p21_needs_visual", "SELECT o_orderkey, o_orderstatus <> 'F' AND (starts_with(o_orderpriority, '1') OR starts_with(o_orderpriority, '5')) AS visual FROM orders")
def needs_visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "verified").otherwise("open")
    seen = filters.needs_visual(status, F.concat(F.lit("See "), "o_orderpriority"), ("see 1", "see 5"))
    return read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").select("o_orderkey", seen.alias("visual"))


#: A word by itself, whatever its alphabet.
ALONE = r"(?i)(^|[^\p{L}\p{N}])(%s)([^\p{L}\p{N}]|$)"
EVIDENCE = {"english": ALONE % "the", "german": ALONE % "der|die|das", "number": "[0-9]{2,}"}


@query("p22_evidence_types", f"""WITH {LINES} SELECT doc_id, line, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in EVIDENCE.items())}], lambda x: x IS NOT NULL), ',') AS types FROM l""")
def evidence_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line", F.array_join(filters.cues(F.col("text"), EVIDENCE), ",").alias("types"))


@query("p23_expression_verdict", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'rejected' WHEN l_linestatus = 'F' AND l_quantity >= 40 THEN 'accepted' WHEN l_quantity < 15 THEN 'rejected' ELSE 'review' END AS verdict FROM lineitem")
def expression_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", materials.expression_verdict(F.col("l_returnflag") != "R", F.col("l_linestatus") == "F", F.col("l_quantity") / 50).alias("verdict"))


@query("p29_image_safety", f"""SELECT page_id, {_sql_picked("page_id", "rejected", "rejected", "rejected", "rejected", "external", "ok")} AS status, {_sql_picked("page_id", "missing", "inline", "scheme", "path", "remote", "local")} AS code FROM pages""")
def image_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://", "")
    n = F.col("page_id") % 6
    source = F.when(n == 0, " ").when(n == 1, F.concat(F.lit("DATA:"), path)).when(n == 2, F.concat(F.lit("JavaScript:"), path)).when(n == 3, F.concat(F.lit("../"), path)).when(n == 4, F.col("url")).otherwise(path)
    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", materials.image_safety(source).alias("s")).select("page_id", "s.*")


CODES = ("latex_braces", "time_gap", "window_order", "ref_missing", "binding_lost", "text_empty")


@query("p30_issue_categories", f"""SELECT o_orderpriority, {_sql_picked("o_orderkey", "formula", "timing", "timing", "identity", "identity", "content")} AS category, count(*) AS n FROM orders GROUP BY ALL""")
def issue_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    return orders.groupBy("o_orderpriority", materials.issue_category(_picked(F.col("o_orderkey"), *CODES)).alias("category")).agg(F.count("*").alias("n"))


@query("p37_eligible", """SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND trim(text) <> '' AND doc_id % 7 <> 3""")
def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "lang", "text")
    good = read(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1").select("doc_id", F.lit(True).alias("_v")).distinct()
    rows = docs.join(good, "doc_id", "left").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 5 != 0).alias("available"), F.when(F.col("lang") == "en", "completed").otherwise("open").alias("status"), F.coalesce("_v", F.lit(False)).alias("verified"))
    blocks = docs.select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 7 == 3, "reference").otherwise("primary").alias("role"), "text")
    return materials.eligible(rows, blocks).select(F.col("document_id").alias("doc_id"))


@query("p40_lecture_number", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN p_size || '.' || p_partkey ELSE p_size::VARCHAR END AS number, CASE WHEN p_size % 4 = 0 THEN 'L' || p_size || ' ' || replace(p_name, '_', ' ') ELSE replace(p_name, '_', ' ') END AS title FROM part")
def lecture_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number before a file name's first underscore, and the title after it."""
    size = F.col("p_size")
    number = F.when(size % 4 == 0, F.concat(F.lit("L"), size)).when(size % 4 == 1, F.concat_ws(".", size, "p_partkey")).otherwise(size.cast("string"))
    name = F.concat_ws("_", number, "p_name")
    parts = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").select("p_partkey", filters.lecture_number(name).alias("number"), materials.title_parts(name)["title"].alias("title"))
    return parts


@query("p41_unresolved_formulas", f"WITH {LINES} SELECT doc_id, line FROM l WHERE line % 3 = 0 AND (line % 6 = 0 OR trim(text) = '')")
def unresolved_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line is a formula, every sixth one is blanked."""
    rows = _lines(spark, sf_dir).withColumn("type", F.when(F.col("line") % 3 == 0, "formula").otherwise("paragraph")).withColumn("text", F.when(F.col("line") % 6 == 0, " ").otherwise(F.col("text")))
    return materials.unresolved_formulas(rows).select("doc_id", "line")


@query("p42_published", """WITH c AS (SELECT page_id, url, CASE WHEN NOT starts_with(url, 'https://') THEN 'scheme' WHEN page_id % 3 = 0 THEN 'not_approved' END AS bad FROM pages) SELECT page_id AS claim_id, CASE WHEN bad IS NULL THEN url END AS url, bad AS withheld FROM c""")
def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of claims are shown where they are harmless and approved."""
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    claims = pages.select(F.col("page_id").alias("claim_id"), F.lit("t").alias("text"), "url", F.lit("private").alias("note"))
    approved = pages.groupBy("url").agg(F.min(F.col("page_id") % 3).alias("m")).where("m > 0").select("url")
    return materials.published(claims, approved).select("claim_id", "url", "withheld")


@query("p31_payloads", """SELECT c_custkey, to_json(map_from_entries(list_filter([('c_name', c_name), ('nation', CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey::VARCHAR END), ('segment', CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END)], lambda e: e[2] IS NOT NULL)))::VARCHAR AS payload FROM customer""")
def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole payloads, without the fields that are null."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows = c.select("c_custkey", "c_name", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("nation"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    return rows.select("c_custkey", F.to_json(filters.payload(rows, ["c_name", "nation", "segment"])).alias("payload"))


# --- look-ups and reports ---------------------------------------------------------------------------------------------------


@query("j16_hit_problems", """SELECT l_orderkey || '-' || l_linenumber AS hit_id, CASE WHEN l_partkey % 10 = 0 THEN 'missing' ELSE concat_ws(',', CASE WHEN l_suppkey % 2 <> p_size % 2 THEN 'version' END, CASE WHEN l_quantity > 45 THEN 'window' END) END AS problems FROM lineitem JOIN part ON p_partkey = l_partkey""")
def hit_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")  # noqa: E741
    hits = l.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("hit_id"), F.col("l_partkey").alias("record_id"), (F.col("l_suppkey") % 2).alias("version"), F.lit(0).alias("start"), F.col("l_quantity").alias("end"))
    records = read(spark, sf_dir, "part", "p_partkey", "p_size").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("record_id"), (F.col("p_size") % 2).alias("version"), F.lit(0).alias("start"), F.lit(45).alias("end"))
    return materials.hit_problems(hits, records).select("hit_id", F.array_join("problems", ",").alias("problems"))


@query("j20_required_actions", """SELECT p_partkey::VARCHAR AS resource_id, CASE WHEN bool_or(l_linenumber % 4 = 0) THEN 'none' WHEN bool_or(l_linenumber % 4 = 1) THEN 'transcribe' WHEN bool_or(l_linenumber % 4 = 2) THEN 'extract_audio' ELSE 'download' END AS action FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 47 GROUP BY p_partkey""")
def required_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem", "l_partkey", "l_linenumber", "l_quantity").where("l_quantity > 47")  # noqa: E741
    files = l.select(F.concat("l_partkey", _picked(F.col("l_linenumber"), ".vtt", ".mp3", ".mp4", ".bin")).alias("name"), _picked(F.col("l_linenumber"), "transcript", "audio", "video", "other").alias("kind"))
    return materials.required_actions(read(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").cast("string").alias("resource_id")), files)


@query("j22_companion", """WITH s AS (SELECT s_nationkey AS n, count(DISTINCT s_suppkey) AS k, min(s_suppkey) AS one FROM supplier GROUP BY ALL), p AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN c_custkey // 4 END AS parent FROM customer)
SELECT c_custkey AS resource_id, coalesce(s_suppkey, CASE WHEN k = 1 THEN one END) AS lecture_id, CASE WHEN s_suppkey IS NOT NULL THEN 'parent' WHEN k = 1 THEN 'section' WHEN k > 1 THEN 'ambiguous' ELSE 'none' END AS status FROM p LEFT JOIN supplier ON s_suppkey = parent LEFT JOIN s ON n = c_nationkey""")
def companion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as resources with their nation as section; suppliers as lectures, the parents of some."""
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    parent = F.when(F.col("c_custkey") % 4 == 0, F.floor(F.col("c_custkey") / 4))
    resources = c.select(F.col("c_custkey").alias("resource_id"), parent.alias("parent_id"), F.array("c_nationkey").alias("sections"))
    lectures = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_suppkey").alias("lecture_id"), F.array("s_nationkey").alias("sections"))
    return relational.companion(resources, lectures).select("resource_id", "lecture_id", "status")


@query("j24_urls_by_index", """WITH f AS (SELECT page_id, lpad((page_id % 1000)::VARCHAR, 3, '0') AS i, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'old' END AS u FROM pages), n AS (SELECT lpad(page_id::VARCHAR, 3, '0') AS i, url AS fresh FROM pages WHERE page_id < 1000 AND page_id % 4 <> 1)
SELECT page_id, CASE WHEN u IS NULL THEN fresh ELSE u END AS url, CASE WHEN fresh IS NULL THEN 'missing' WHEN u IS NULL THEN 'new' WHEN u = fresh THEN 'same' ELSE 'kept' END AS state FROM f LEFT JOIN n USING (i)""")
def urls_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    index = lambda c: F.lpad(c.cast("string"), 3, "0")
    have = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, "old")
    files = pages.select(F.concat(F.lit("part "), index(F.col("page_id") % 1000), F.format_string(" of page %d.5x", "page_id")).alias("name"), have.alias("url"))
    urls = pages.where("page_id < 1000 AND page_id % 4 <> 1").select(index(F.col("page_id")).alias("index"), "url")
    found = materials.urls_by_index(files, urls)
    return found.select(F.regexp_extract("name", r"page (\d+)", 1).cast("long").alias("page_id"), "url", "state")


@query("a24_visual_inventory", "SELECT o_orderstatus AS kind, count(*) AS n, count(*) FILTER (o_custkey % 3 <> 0 AND o_orderkey % 5 <> 0) AS complete, min(o_orderkey) FILTER (o_custkey % 3 = 0 OR o_orderkey % 5 = 0) AS first_incomplete FROM orders GROUP BY o_orderstatus")
def visual_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    rows = orders.select(F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("resource_id"), F.when(F.col("o_custkey") % 3 != 0, 1).alias("file"), F.when(F.col("o_orderkey") % 5 != 0, 1).alias("frame"))
    return materials.validation_report(rows, ["file", "frame"])


@query("a27_merged_resources", "SELECT p_type AS url, array_to_string(list_sort(list_distinct(flatten(list([p_size, p_size % 7])))), ',') AS blocks FROM part WHERE p_partkey % 9 <> 0 GROUP BY p_type UNION ALL SELECT NULL, array_to_string(list_sort(list_distinct([p_size, p_size % 7])), ',') FROM part WHERE p_partkey % 9 = 0")
def merged_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part", "p_partkey", "p_type", "p_size")
    rows = part.select(F.when(F.col("p_partkey") % 9 != 0, F.col("p_type")).alias("url"), F.array("p_size", F.col("p_size") % 7).alias("blocks"))
    return aggregates.merged_resources(rows, "url", "blocks").select("url", F.array_join(F.array_sort(F.array_distinct("blocks")), ",").alias("blocks"))


@query("a33_identity_conflicts", "SELECT l_partkey, concat_ws(',', CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'l_returnflag' END, CASE WHEN count(DISTINCT l_suppkey % 3) > 1 THEN 'origin' END) AS conflicting FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_suppkey % 3) > 1")
def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag", "l_suppkey").withColumn("origin", F.col("l_suppkey") % 3)  # noqa: E741
    return aggregates.conflicts(l, "l_partkey", ["l_returnflag", "origin"]).select("l_partkey", F.array_join("conflicting", ",").alias("conflicting"))


@query("a34_evidence_preserved", "WITH a AS (SELECT l_orderkey AS o, l_partkey AS p, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey AS o, l_partkey AS p, count(*) AS n FROM lineitem WHERE l_linenumber <> 7 GROUP BY ALL) SELECT a.o AS l_orderkey, a.p AS l_partkey, 'left' AS side, unnest(range(a.n - coalesce(b.n, 0)))::BIGINT * 0 AS zero FROM a LEFT JOIN b USING (o, p)")
def evidence_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an output that lost every seventh line lacks, as often as it lacks it."""
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")  # noqa: E741
    return relational.sets_differ(l.select("l_orderkey", "l_partkey"), l.where("l_linenumber <> 7").select("l_orderkey", "l_partkey")).withColumn("zero", F.lit(0).cast("long"))


@query("a35_distinct_names", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materials.distinct_names(read(spark, sf_dir, "documents", "lang"), "lang")


@query("l05_cursor_page", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part ORDER BY rank LIMIT 25 OFFSET 50")
def cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after rank 50 of a result whose fingerprint is that of its ranked ids."""
    ranked = numbered(read(spark, sf_dir, "part", "p_partkey", "p_retailprice"), F.desc("p_retailprice"), "p_partkey", name="rank")
    mark = aggregates.digest(ranked.withColumn("all", F.lit(1)), ["all"], "rank", F.col("p_partkey").cast("string")).first()["digest"]
    return materials.cursor_page(ranked, mark, (mark, 50, 100.0), 120.0, 25).select("p_partkey", "rank")


@query("m12_folder_sizes", "SELECT source || '/' || coalesce(lang, '-') AS folder, sum(n_chars)::BIGINT AS size FROM documents GROUP BY ALL ORDER BY size DESC, folder LIMIT 10")
def folder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "source", "lang", "n_chars").select(F.concat_ws("/", "source", F.coalesce("lang", F.lit("-"))).alias("folder"), "n_chars")
    return docs.groupBy("folder").agg(F.sum("n_chars").alias("size")).orderBy(F.desc("size"), "folder").limit(10)


@query("k09_vector_upserts", "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'insert' WHEN vec_id % 4 = 1 THEN 'replace' ELSE 'keep' END AS action FROM embeddings")
def vector_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that lacks a quarter of the vectors and has another quarter changed in one part, or by less than the tolerance."""
    v = read(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    step = F.when(F.col("vec_id") % 4 == 1, 0.01).when(F.col("vec_id") % 4 == 2, 1e-9).otherwise(0.0)
    stored = v.where("vec_id % 4 <> 0").select("vec_id", F.transform("v", lambda x, i: F.when(i == 3, x + step).otherwise(x)).alias("v"))
    return sinks.vector_upserts(v, stored, "vec_id", "v")


@query("k12_exposition", """SELECT 'events_total{kind="' || event_type || '",user="' || user_id || '"} ' || count(*) AS line FROM events GROUP BY event_type, user_id""")
def exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "events", "event_type", "user_id").groupBy("event_type", "user_id").agg(F.count("*").alias("value"))
    labels = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"))
    return counts.select(F.lit("events_total").alias("name"), labels.alias("labels"), "value").select(sinks.exposition(counts).alias("line"))


@query("k15_markdown", """WITH b AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '## ' || role WHEN 1 THEN '- ' || role WHEN 2 THEN '```' || chr(10) || role || chr(10) || '```' ELSE '> ' || role END AS t FROM conversations) SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS text FROM b GROUP BY conv_id""")
def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    kind = _picked(F.col("turn"), "heading", "list_item", "code", "quote")
    blocks = turns.select("conv_id", "turn", sinks.markdown(kind, F.lit(2), F.col("role")).alias("text"))
    return sinks.assembled(blocks, "conv_id", "turn", "text")


# --- scalar functions -------------------------------------------------------------------------------------------------------


@query("f08_exact_keys", r"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'a +  ' || l_partkey || ' \ b' ELSE 'a+' || l_partkey || '/(b,' || l_suppkey || ')' END AS math, 'Äa' || l_partkey AS text, 'a*' || l_partkey || '^2=b' AS loose FROM lineitem""")
def exact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact keys of formulas and texts, and the loose key of a spoken formula."""
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")  # noqa: E741
    plain = F.when(F.col("l_linenumber") % 3 == 0, F.format_string("a +  %d \\ b", "l_partkey")).otherwise(F.format_string("a +  %d / ( b ,%d )", "l_partkey", "l_suppkey"))
    text = F.concat(F.lit(" Äa"), "l_partkey", F.lit("  "))
    spoken = F.format_string("A mal %d² ist gleich B.", "l_partkey")
    return l.select("l_orderkey", "l_linenumber", T.exact_math(plain).alias("math"), T.exact_text(text).alias("text"), formulas.loose_key(spoken).alias("loose"))


@query("f16_seconds", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE round((epoch_us(ts) % 86400000000) // 1000 / 1000.0, 3) END AS seconds FROM events")
def seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day as subtitle times, by either sign; every ninth has a minute too many."""
    minute = F.when(F.col("event_id") % 9 == 0, F.lit("75")).otherwise(F.date_format("ts", "mm"))
    sign = F.when(F.col("event_id") % 2 == 0, ".").otherwise(",")
    text = F.concat(F.date_format("ts", "H"), F.lit(":"), minute, F.lit(":"), F.date_format("ts", "ss"), sign, F.date_format("ts", "SSS"))
    return read(spark, sf_dir, "events", "event_id", "ts").select("event_id", F.round(T.seconds(text), 3).alias("seconds"))


@query("f17_times", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 0 THEN epoch_us(date_trunc('second', o_orderdate)) WHEN 1 THEN epoch_us(date_trunc('second', o_orderdate)) ELSE epoch_us(date_trunc('day', o_orderdate)) END AS us FROM orders")
def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in four ways, or not at all."""
    formats = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy", "yyyy-MM-dd")
    n = F.col("o_orderkey") % 5
    written = reduce(lambda c, i: F.when(n == i, F.date_format("o_orderdate", formats[i])).otherwise(c), range(4), F.lit(None).cast("string"))
    return read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.unix_micros(pipelines.parsed_times(written)).alias("us"))


@query("f19_list_literals", "SELECT o_orderkey, array_to_string(list(l_partkey ORDER BY l_partkey), '|') AS parts FROM (SELECT DISTINCT o_orderkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY o_orderkey")
def list_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's parts written as a list in Python's or JSON's way, or with commas, and read again."""
    held = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    rows = read(spark, sf_dir, "orders", "o_orderkey").join(held, "o_orderkey")
    joined = lambda quote, sep: F.array_join(F.transform("p", lambda x: F.concat(F.lit(quote), x.cast("string"), F.lit(quote))), sep)
    n = F.col("o_orderkey") % 3
    text = F.when(n == 0, F.concat(F.lit("["), joined("'", ", "), F.lit("]"))).when(n == 1, F.concat(F.lit("["), joined('"', ","), F.lit("]"))).otherwise(joined("", " , "))
    return rows.select("o_orderkey", F.array_join(T.list_literal(text), "|").alias("parts"))


@query("f21_links", """SELECT page_id, url || '|' || 'https://e.org/' || page_id AS links FROM pages""")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in running text, with the signs of the sentence around them, one of them twice."""
    text = F.concat(F.lit("see ("), "url", F.lit("), "), "url", F.lit(". And <https://e.org/"), "page_id", F.lit(">; done"))
    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", F.array_join(T.plain_links(text), "|").alias("links"))


@query("f27_breadcrumbs", "SELECT c_custkey, concat_ws(' > ', c_mktsegment, CASE WHEN c_custkey % 3 <> 0 THEN c_name END, 'n' || c_nationkey) AS crumb FROM customer")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    parts = F.array(F.concat(F.lit("  "), "c_mktsegment"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("  "), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(" ")))
    return c.select("c_custkey", materials.breadcrumb(parts).alias("crumb"))


@query("f34_video_ids", "SELECT page_id, CASE page_id % 5 WHEN 4 THEN NULL ELSE 'v-' || lpad(page_id::VARCHAR, 9, '0') END AS video FROM pages")
def video_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in four forms of addresses, and in none."""
    code, n = F.concat(F.lit("v-"), F.lpad(F.col("page_id").cast("string"), 9, "0")), F.col("page_id") % 5
    url = (
        F.when(n == 0, F.concat(F.lit("https://youtube.com/watch?t=1&v="), code)).when(n == 1, F.concat(F.lit("https://youtu.be/"), code, F.lit("?t=3"))).when(n == 2, F.concat(F.lit("https://x.org/embed/"), code))
        .when(n == 3, F.concat(F.lit("https://youtube.com/shorts/"), code)).otherwise(F.col("url"))
    )
    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", T.video_id(url).alias("video"))


@query("a20_broken_histograms", """WITH b AS (SELECT user_id, count(*) FILTER (value <= 10) AS a, count(*) FILTER (value <= 30) AS b, count(*) AS c FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN user_id % 3 = 0 THEN b <= a AND a <= c ELSE true END AS monotonic, user_id % 4 <> 1 AS closed FROM b""")
def broken_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of which every third has two buckets exchanged, and every fourth another total."""
    events = read(spark, sf_dir, "events", "user_id", "value")
    wide = events.groupBy("user_id").agg(F.count_if(F.col("value") <= 10).alias("a"), F.count_if(F.col("value") <= 30).alias("b"), F.count("value").alias("c"))
    odd = F.col("user_id") % 3 == 0
    pairs = F.array(*(F.struct(F.lit(float(i)).alias("place"), v.alias("n")) for i, v in enumerate((F.when(odd, F.col("b")).otherwise(F.col("a")), F.when(odd, F.col("a")).otherwise(F.col("b")), F.col("c")))))
    rows = wide.select("user_id", F.when(F.col("user_id") % 4 == 1, F.col("c") + 1).otherwise(F.col("c")).alias("total"), F.inline(pairs))
    return aggregates.histogram_audit(rows, ["user_id"], "place", "total")


@query("e16_handoff", "SELECT o_orderkey AS lecture_id FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)")
def handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that aren't closed and have a line with a large discount."""
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    audits = orders.select(F.col("o_orderkey").alias("lecture_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("passed").alias("status"))
    units = read(spark, sf_dir, "lineitem", "l_orderkey", "l_discount").where("l_discount > 0.09").select(F.col("l_orderkey").alias("lecture_id"))
    return materials.handoff(orders.select(F.col("o_orderkey").alias("lecture_id")), audits, units)


@query("r15_cluster_texts", """WITH c AS (SELECT p_partkey AS id, p_size AS leader, p_name AS text FROM part) SELECT leader, id, text FROM c QUALIFY row_number() OVER (PARTITION BY leader ORDER BY length(text) DESC, id) = 1""")
def cluster_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_name")
    return materials.merged_clusters(part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("leader")), part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")))


@query("r16_index_items", """WITH e AS (SELECT l_orderkey, l_partkey, p_partkey, l_linenumber <> 6 AS same FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 50 <> 0)
SELECT o_orderkey AS item_id, count(p_partkey) AS records, coalesce(bool_and(p_partkey IS NOT NULL AND same), false) AS valid FROM orders LEFT JOIN e ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def index_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items, lines as evidence with the hash of their part, which is another one in a sixth line."""
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")  # noqa: E741
    sha = F.sha2(F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") == 6, "x").otherwise("")), 256)
    held = l.groupBy(F.col("l_orderkey").alias("item_id")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("record_id"), sha.alias("sha"))).alias("evidence"))
    items = read(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("item_id")).join(held, "item_id", "left")
    records = read(spark, sf_dir, "part", "p_partkey").where("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("record_id"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("sha"))
    return materials.index_items(items, records)


@query("r11_filtered_search", """WITH q AS (SELECT vec_id AS query_id, label AS l, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.v), 6) AS score FROM q JOIN embeddings e ON e.label = q.l AND e.vec_id <> q.query_id)
SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.2) WHERE rank <= 5""")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries against the vectors of their own label only, above a least score."""
    v = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    asks = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label")
    scored = v.join(asks, "label").where("vec_id <> query_id").select("query_id", "vec_id", r6(T.dot(F.col("embedding"), F.col("query"))).alias("score")).where("score >= 0.2")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where("rank <= 5")


@query("a40_flattened", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of findings within arrays of dependencies, as rows."""
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")  # noqa: E741
    one = l.groupBy("l_orderkey", "l_linenumber").agg(F.collect_list(F.when(F.col("l_returnflag") == "R", F.struct("l_partkey"))).alias("vulns"))
    report = one.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "vulns")).alias("dependencies"))
    return aggregates.flattened(report, "dependencies", "vulns")

