"""The material audit over documents whose lines are blocks; flaws come by the numbers of documents and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.base import materialized, read
from docloom.operators import audit
from docloom.plans.registry import query


def _materials(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Documents, blocks, contexts, receipts, images and plan."""
    d, n, e = F.col("doc_id"), lambda k, r=0: F.col("doc_id") % k == r, F.expr
    base = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").withColumn("lines", F.split("text", "\n"))
    named = lambda prefix: F.concat(F.lit(prefix), d.cast("string"))
    pages = F.floor((F.size("lines") - 1) / 3) + 1
    claims = F.create_map(
        F.lit("course_id"), F.when(n(17), "other").otherwise(F.col("source")), F.lit("material_id"), named("m"), F.lit("lecture_ids"), F.concat(F.lit("l"), F.when(n(33), 99).otherwise(d % 10).cast("string")),
        F.lit("page_count"), F.when(n(19), "x").when(n(23), (pages + 1).cast("string")).otherwise(pages.cast("string")),
    )
    parser = F.when(n(2), "pdf").otherwise("html")
    sha = lambda c: F.sha2(c, 256)
    docs = base.select(
        named("doc:").alias("document_id"), F.when(n(11), None).when(n(11, 1), "  ").otherwise(named("Title ")).alias("title"), F.when(n(13), e("cast(map() as map<string,string>)")).otherwise(claims).alias("metadata"),
        F.when(n(29), "").otherwise("crawl").alias("provenance"), parser.alias("parser"), F.when(n(7), "1").otherwise("2").alias("parser_version"),
        F.when(n(31), F.when(n(2), "html").otherwise("pdf")).otherwise(parser).alias("format"), F.when(n(3), "source_code").otherwise("script").alias("role"), F.col("source").alias("course_id"),
        named("s").alias("source_id"), named("m").alias("material_id"), F.when(n(37), e("cast(array() as array<string>)")).otherwise(F.array(F.coalesce("lang", F.lit("?")))).alias("section_keys"),
        F.array(F.concat(F.lit("l"), (d % 10).cast("string"))).alias("lecture_ids"), sha("text").alias("raw_sha256"), F.when(n(41), sha(F.concat("text", F.lit("!")))).otherwise(sha("text")).alias("observed_raw_sha256"),
        F.lit(100).alias("max_pages"), F.when(n(43), F.array(F.lit("Page 2: skew"), F.lit("odd"))).otherwise(e("cast(array() as array<string>)")).alias("warnings"), "doc_id",
    )
    lines = materialized(base.select("doc_id", F.posexplode("lines").alias("i", "line")))
    i, kind = F.col("i"), F.col("i") % 6
    at = lambda c: F.concat(F.lit("/body/x["), c.cast("string"), F.lit("]"))
    item = lambda c, k: F.concat(at(c), F.lit(f"/li[{k}]"))
    type_ = F.element_at(F.array(*map(F.lit, ("heading", "paragraph", "link", "list", "math", "image_reference"))), (kind + 1).cast("int"))
    page = F.when(n(61) & (i == 6), 1).otherwise(F.floor(i / 3) + 1).cast("int")
    two = lambda start, text: F.struct(F.lit(start).alias("start"), F.lit(start + 2).alias("end"), text.alias("text"))
    code = F.array(two(0, F.substring("line", 1, 2)), two(2, F.when(n(97), "??").otherwise(F.substring("line", 3, 2))))
    of = lambda k, c: F.when(kind == k, c)
    blocks = lines.select(
        named("doc:").alias("document_id"), F.concat(d.cast("string"), F.lit(":"), F.when(n(47) & (i == 1), 0).otherwise(i).cast("string")).alias("block_id"), i.alias("position"),
        F.when(n(53) & (i == 2), 7).otherwise(i).alias("at"), F.when(n(39) & (kind == 4), "table").otherwise(type_).alias("type"), F.when((kind == 3) & ~n(59), "").otherwise(F.col("line")).alias("text"),
        F.when(kind == 4, F.concat(item(i - 1, 1), F.lit("/p"))).otherwise(at(i)).alias("dom"), page.alias("page"), F.when(i % 10 == 9, F.array(F.lit("glyph"))).otherwise(e("cast(array() as array<string>)")).alias("uncertainty"),
        of(2, F.when(~n(67), True)).alias("reference_only"), F.when((kind == 3) & n(14, 3), "table_of_contents").when((i == 4) & n(73), "odd").alias("content_role"),
        of(2, F.when(n(79), "").otherwise(F.concat(F.lit("https://e.org/"), i.cast("string")))).alias("original_url"), of(3, F.when(~n(83), True)).alias("ordered"),
        of(3, F.array(item(i, 1), F.when(n(89), item(i, 1)).otherwise(item(i, 2)))).alias("item_doms"), F.when((kind <= 1) & (F.length("line") >= 4), code).alias("inline_code"),
        of(5, F.concat(F.lit("i"), i.cast("string"))).alias("image_id"), "doc_id",
    )
    blocks = materialized(blocks)
    contexts = blocks.where("position % 6 = 4").select("document_id", "block_id", at(F.col("position") - 1).alias("list_dom"), item(F.col("position") - 1, 1).alias("item_dom"), F.when(n(5), 1).otherwise(0).alias("item_index"), F.lit(True).alias("ordered"))
    path = F.when(~n(3, 1), F.concat(F.lit("img/"), "image_id"))
    own = sha(F.col("image_id"))
    images = blocks.where("image_id IS NOT NULL").select(
        "document_id", "image_id", path.alias("artifact_path"), F.when(path.isNotNull() | n(9, 1), own).alias("sha256"),
        F.when(path.isNotNull() & ~n(24), F.when(n(25), sha(F.lit("other"))).otherwise(own)).alias("observed_sha256"), (F.col("page") + F.when(n(26), 1).otherwise(0)).alias("page"), "doc_id",
    )
    extra = docs.where(n(27)).select("document_id", F.lit("extra").alias("image_id"), *(F.lit(None).cast("string").alias(c) for c in ("artifact_path", "sha256", "observed_sha256")), F.lit(1).alias("page"), "doc_id")
    images = images.unionByName(extra)
    hashes = images.where("artifact_path IS NOT NULL").groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("artifact_path", "sha256"))).alias("hashes"))
    receipts = docs.where(~n(4, 3)).join(hashes, "document_id", "left").select(
        "document_id", F.when(n(15), "mx").otherwise(F.col("material_id")).alias("material_id"), "parser", F.lit("2").alias("parser_version"), "raw_sha256", F.when(n(16), "failed").otherwise("completed").alias("status"),
        F.when(n(18), "oops").alias("error"), sha("document_id").alias("normalized_sha256"), F.when(n(20), "other").when(~n(21), sha("document_id")).alias("observed_normalized_sha256"), F.when(~n(22), F.col("hashes")).alias("image_hashes"),
    )
    twice = F.when(n(30), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    lectures = F.when(n(32), F.array(F.lit("l99"))).otherwise(F.col("lecture_ids"))
    plan = docs.where(~n(28)).withColumn("_twice", F.explode(twice)).select("material_id", "course_id", "source_id", "section_keys", lectures.alias("lecture_ids"))
    return docs, blocks, contexts, receipts, images, plan


def _if(*tests: str) -> str:
    return " AND ".join(tests)


def _rule(code: str, test: str, rows: str, severity: str = "error", place: str = "NULL") -> str:
    return f"SELECT d, '{code}' AS code, '{severity}' AS severity, {place}::VARCHAR AS place FROM {rows} WHERE {test}"


PDF = "d % 2 = 0"
PATH = "d % 3 <> 1"
RULES = (
    _rule("title_missing", "d % 11 <= 1", "t", "warning"), _rule("metadata_missing", "d % 13 = 0", "t", "warning"), _rule("provenance_missing", "d % 29 = 0", "t"), _rule("parser_legacy", "d % 7 = 0", "t"),
    _rule("parser_conflict", _if("d % 31 = 0", "(d % 2 = 1 OR d % 3 <> 0)"), "t"), _rule("raw_hash_mismatch", "d % 41 = 0", "t"), _rule("lecture_binding_missing", "d % 37 = 0", "t"),
    _rule("page_count_invalid", _if(PDF, "(d % 13 = 0 OR d % 19 = 0 OR pages + (d % 23 = 0)::INT > 100)"), "t"), _rule("metadata_conflict", _if("d % 13 <> 0", "d % 17 = 0", "source <> 'other'"), "t", place="'metadata.course_id'"),
    _rule("metadata_conflict", _if("d % 13 <> 0", "d % 33 = 0"), "t", place="'metadata.lecture_ids'"), _rule("parser_warning", "d % 43 = 0", "t", "warning", "'2'"), _rule("parser_warning", "d % 43 = 0", "t", "warning"),
    _rule("page_uncovered", _if(PDF, "d % 13 <> 0", "d % 19 <> 0", "pages + (d % 23 = 0)::INT <= 100", "p NOT IN (SELECT page FROM b WHERE b.d = u.d)"), "(SELECT *, unnest(range(1, pages + (d % 23 = 0)::INT + 1)) AS p FROM t) u", "warning", "p"),
    _rule("block_identity", "(d % 47 = 0 AND i = 1) OR (d % 53 = 0 AND i = 2)", "b", place="id"), _rule("page_order", _if("d % 61 = 0", "i = 6"), "b", place="id"),
    _rule("projection_invalid", _if("i = 4", "d % 73 = 0"), "b", place="id"), _rule("link_projection_invalid", _if("k = 2", "(d % 67 = 0 OR d % 79 = 0)"), "b", place="id"),
    _rule("reference_projection", "(k = 2 AND d % 67 <> 0) OR (k = 3 AND d % 14 = 3)", "b", "info", "id"), _rule("list_invalid", _if("k = 3", "((d % 59 = 0 AND line <> '') OR d % 83 = 0 OR d % 89 = 0)"), "b", place="id"),
    _rule("inline_code_invalid", _if("k <= 1", "length(line) >= 4", "d % 97 = 0", "substring(line, 3, 2) <> '??'"), "b", place="id"), _rule("semantic_review", _if("k = 4", "d % 39 <> 0"), "b", "warning", "id"),
    _rule("table_overlap", _if("k = 4", "d % 39 = 0", PDF), "b", "warning", "id"), _rule("parser_uncertainty", "i % 10 = 9", "b", "warning", "id"),
    _rule("list_context_invalid", _if("k = 4", "((d % 5 = 0 AND d % 89 <> 0) OR d % 83 = 0)"), "b", place="id"), _rule("toc_projection_invalid", _if("k = 4", "(d % 5 <> 0 OR d % 89 = 0)", "d % 83 <> 0", "d % 14 = 3"), "b", place="id"),
    _rule("plan_binding_conflict", "d % 28 = 0 OR d % 30 = 0 OR d % 32 = 0", "t"), _rule("receipt_binding_conflict", _if("d % 4 <> 3", "(d % 15 = 0 OR d % 7 = 0)"), "t"),
    _rule("receipt_incomplete", _if("d % 4 <> 3", "(d % 16 = 0 OR d % 18 = 0)"), "t"), _rule("normalized_hash_mismatch", _if("d % 4 <> 3", "(d % 20 = 0 OR d % 21 = 0)"), "t"),
    _rule("image_manifest_conflict", _if("d % 4 <> 3", "d % 22 = 0", PATH, "n > 5"), "t"), _rule("image_reference_only", _if("k = 5", "d % 3 = 1"), "b", "warning", "'i' || i"),
    _rule("image_reference_only", "d % 27 = 0", "t", "warning", "'extra'"), _rule("image_unreferenced", "d % 27 = 0", "t", "warning", "'extra'"), _rule("image_metadata_conflict", _if("k = 5", "d % 3 = 1", "d % 9 = 1"), "b", place="'i' || i"),
    _rule("image_artifact_missing", _if("k = 5", PATH, "d % 24 = 0"), "b", place="'i' || i"), _rule("image_hash_mismatch", _if("k = 5", PATH, "d % 24 <> 0", "d % 25 = 0"), "b", place="'i' || i"),
    _rule("image_location_conflict", _if("k = 5", "d % 26 = 0"), "b", place="id"),
)
TABLES = """t AS (SELECT doc_id AS d, source, len(string_split(text, chr(10))) AS n, (len(string_split(text, chr(10))) - 1) // 3 + 1 AS pages FROM documents),
l AS (SELECT doc_id AS d, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
b AS (SELECT d, i, i % 6 AS k, line, CASE WHEN d % 61 = 0 AND i = 6 THEN 1 ELSE i // 3 + 1 END AS page, d || ':' || CASE WHEN d % 47 = 0 AND i = 1 THEN 0 ELSE i END AS id FROM l),
f AS (""" + "\nUNION ALL ".join(RULES) + ")"


@query("e08_audit", f"WITH {TABLES} SELECT 'doc:' || d AS document_id, code, severity, place FROM f")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    named: Column = F.when(F.col("field").startswith("metadata.") & (F.col("code") == "metadata_conflict"), F.col("field"))
    found = audit.audited(*_materials(spark, sf_dir))
    return found.select("document_id", "code", "severity", F.coalesce("block_id", "image_id", named, F.col("page").cast("string")).alias("place"))


@query("e08_states", f"""WITH {TABLES}, c AS (SELECT d, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM f GROUP BY d)
SELECT 'doc:' || d AS document_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, CASE WHEN errors > 0 THEN 'failed' WHEN warnings > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status FROM t LEFT JOIN c USING (d)""")
def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _materials(spark, sf_dir)
    return audit.audit_states(tables[0], audit.audited(*tables))
