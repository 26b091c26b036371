"""Audit of normalized materials: documents, their blocks, list contexts, receipts, images and the reviewed plan.

Each table is a DataFrame; each rule is an expression over one of them, a window over a document's blocks, or a join of two. A finding is a row
(document_id, code, severity, category, block_id, image_id, field, page), and a document's status follows from its findings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TECHNICAL, REVIEW = "technical", "semantic_review"
#: Claims of a document's metadata that must agree with its binding, by the column that they claim.
IDENTITIES = {"course_id": "course_id", "resource_id": "source_id", "material_id": "material_id", "document_id": "document_id"}
#: Columns that each table must have.
DOCUMENTS = (
    "document_id string, title string, metadata map<string,string>, provenance string, parser string, parser_version string, format string, role string, course_id string, "
    "source_id string, material_id string, section_keys array<string>, lecture_ids array<string>, raw_sha256 string, observed_raw_sha256 string, max_pages int, warnings array<string>"
)
BLOCKS = (
    "document_id string, block_id string, position int, at int, type string, text string, dom string, page int, uncertainty array<string>, reference_only boolean, content_role string, "
    "original_url string, ordered boolean, item_doms array<string>, inline_code array<struct<start:int,end:int,text:string>>, image_id string"
)
CONTEXTS = "document_id string, block_id string, list_dom string, item_dom string, item_index int, ordered boolean"
RECEIPTS = (
    "document_id string, material_id string, parser string, parser_version string, raw_sha256 string, status string, error string, normalized_sha256 string, "
    "observed_normalized_sha256 string, image_hashes map<string,string>"
)
IMAGES = "document_id string, image_id string, artifact_path string, sha256 string, observed_sha256 string, page int"
PLAN = "material_id string, course_id string, source_id string, section_keys array<string>, lecture_ids array<string>"
FINDING = "document_id string, code string, severity string, category string, block_id string, image_id string, field string, page int"


def _finding(code: str, test: Column, severity: str = "error", category: str = TECHNICAL, **places: Column | str | None) -> Column:
    """A finding where the test holds, else null."""
    where = [(F.lit(places.get(c)) if not isinstance(places.get(c), Column) else places[c]).cast(t).alias(c) for c, t in (("block_id", "string"), ("image_id", "string"), ("field", "string"), ("page", "int"))]
    return F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), *where))


def _found(rows: DataFrame, *rules: Column) -> DataFrame:
    return rows.select("document_id", F.inline(F.array_compact(F.array(*rules))))


def _blank(column: str) -> Column:
    return F.coalesce(F.trim(column) == "", F.lit(True))


def document_findings(docs: DataFrame) -> DataFrame:
    """Rules of a document alone."""
    html, pdf = (F.col("format") == "html") & (F.col("role") != "source_code"), F.col("format") == "pdf"
    expected = F.when(pdf, "pdf").when(html, "html")
    count = F.expr("try_cast(metadata['page_count'] AS INT)")
    claims = [_finding("metadata_conflict", F.col("metadata")[k] != F.col(c), field=f"metadata.{k}") for k, c in IDENTITIES.items()]
    lists = [_finding("metadata_conflict", F.col("metadata")[c] != F.array_join(c, ","), field=f"metadata.{c}") for c in ("section_keys", "lecture_ids")]
    found = _found(
        docs,
        _finding("title_missing", _blank("title"), "warning", field="title"),
        _finding("metadata_missing", F.coalesce(F.size("metadata") <= 0, F.lit(True)), "warning", field="metadata"),
        _finding("provenance_missing", _blank("provenance"), field="binding.resource.provenance"),
        _finding("parser_legacy", F.col("parser").isin("html", "pdf") & (F.col("parser_version") != "2"), field="parser.version"),
        _finding("parser_conflict", F.col("parser") != expected, field="parser.name"),
        _finding("raw_hash_mismatch", ~F.col("raw_sha256").eqNullSafe(F.col("observed_raw_sha256"))),
        _finding("lecture_binding_missing", F.coalesce((F.size("section_keys") <= 0) | (F.size("lecture_ids") <= 0), F.lit(True)), field="binding.lecture_ids"),
        _finding("page_count_invalid", (F.col("parser") == "pdf") & ~F.coalesce(count.between(1, F.col("max_pages")), F.lit(False)), field="metadata.page_count"),
        *claims, *lists,
    )
    page = F.expr(r"try_cast(nullif(regexp_extract(warning, '^Page ([0-9]{1,6}):', 1), '') AS INT)")
    warned = docs.select("document_id", F.explode("warnings").alias("warning"))
    return found.unionByName(_found(warned, _finding("parser_warning", F.lit(True), "warning", REVIEW, page=F.when(page > 0, page))))


def coverage_findings(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents without blocks, and pages of a PDF document that no block covers."""
    empty = _found(docs.join(blocks, "document_id", "left_anti"), _finding("blocks_empty", F.lit(True), field="blocks"))
    count = F.expr("try_cast(metadata['page_count'] AS INT)")
    pages = docs.where((F.col("parser") == "pdf") & count.between(1, F.col("max_pages"))).select("document_id", F.explode(F.sequence(F.lit(1), count)).alias("page"))
    bare = pages.join(blocks.select("document_id", "page").distinct(), ["document_id", "page"], "left_anti")
    return empty.unionByName(_found(bare, _finding("page_uncovered", F.lit(True), "warning", REVIEW, page=F.col("page"))))


def block_findings(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rules of a block, and of its place among the blocks of its document."""
    before = Window.partitionBy("document_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("document_id", "block_id").orderBy("position")
    rows = blocks.join(docs.select("document_id", "parser"), "document_id").withColumn("_page", F.last("page", ignorenulls=True).over(before)).withColumn("_copy", F.row_number().over(same))
    me, toc = {"block_id": F.col("block_id")}, F.col("content_role") == "table_of_contents"
    direct = F.forall("item_doms", lambda p: p.isNotNull() & F.startswith(p, F.concat(F.coalesce("dom", F.lit("")), F.lit("/li["))))
    listed = F.coalesce(direct & (F.size("item_doms") == F.size(F.array_distinct("item_doms"))), F.lit(False))
    spans = F.aggregate(
        "inline_code", F.lit(0),
        lambda end, s: F.when((end >= 0) & (s["start"] >= end) & (s["end"] >= s["start"]) & (s["end"] <= F.length("text")) & (F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]) == s["text"]), s["end"]).otherwise(-1),
    )
    found = _found(
        rows,
        _finding("block_identity", (F.col("_copy") > 1) | ~F.col("at").eqNullSafe(F.col("position")), **me),
        _finding("page_order", F.col("page") < F.col("_page"), page=F.col("page"), **me),
        _finding("projection_invalid", F.col("content_role").isNotNull() & ~toc, **me),
        _finding("link_projection_invalid", (F.col("type") == "link") & (~F.coalesce("reference_only", F.lit(False)) | (F.coalesce("original_url", F.lit("")) == "")), **me),
        _finding("reference_projection", F.col("reference_only") | toc, "info", **me),
        _finding("list_invalid", (F.col("type") == "list") & ((F.coalesce("text", F.lit("")) != "") | F.col("ordered").isNull() | ~listed), **me),
        _finding("inline_code_invalid", F.coalesce(spans, F.lit(0)) < 0, **me),
        _finding("semantic_review", F.col("type").isin("math", "unknown_block"), "warning", REVIEW, **me),
        _finding("table_overlap", (F.col("parser") == "pdf") & (F.col("type") == "table"), "warning", REVIEW, **me),
    )
    unsure = blocks.select("document_id", "block_id", F.explode("uncertainty"))
    return found.unionByName(_found(unsure, _finding("parser_uncertainty", F.lit(True), "warning", REVIEW, **me)))


def context_findings(blocks: DataFrame, contexts: DataFrame) -> DataFrame:
    """A block's place in a list must resolve to that list and item, and a child of a table of contents must say that it is one."""
    lists = blocks.where("type = 'list'").select("document_id", F.col("dom").alias("list_dom"), F.col("ordered").alias("_ordered"), "item_doms", F.col("content_role").alias("_role"))
    mine = blocks.select("document_id", "block_id", "dom", "content_role")
    rows = contexts.join(mine, ["document_id", "block_id"]).join(lists, ["document_id", "list_dom"], "left")
    item = F.get("item_doms", F.col("item_index"))
    sound = (item == F.col("item_dom")) & (F.col("ordered") == F.col("_ordered")) & F.startswith("dom", F.col("item_dom"))
    sound = F.coalesce(sound & (F.col("item_index") >= 0), F.lit(False))
    lost = (F.col("_role") == "table_of_contents") & (F.coalesce("content_role", F.lit("")) != "table_of_contents")
    me = {"block_id": F.col("block_id")}
    return _found(rows, _finding("list_context_invalid", ~sound, **me), _finding("toc_projection_invalid", sound & lost, **me))


def binding_findings(docs: DataFrame, receipts: DataFrame, plan: DataFrame, images: DataFrame) -> DataFrame:
    """A document against the reviewed plan and its receipt. The plan must bind its material exactly once and alike."""
    bound = ["course_id", "source_id", "section_keys", "lecture_ids"]
    planned = plan.groupBy("material_id").agg(F.count("*").alias("_n"), F.first(F.struct(*bound)).alias("_bound"))
    alike = (F.col("_n") == 1) & F.struct(*bound).eqNullSafe(F.col("_bound"))
    found = _found(docs.join(planned, "material_id", "left"), _finding("plan_binding_conflict", ~F.coalesce(alike, F.lit(False))))
    kept = images.where("artifact_path IS NOT NULL").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.col("artifact_path").alias("key"), F.col("sha256").alias("value")))).alias("_images"))
    r = receipts.select("document_id", *(F.col(c).alias(f"r_{c}") for c in receipts.columns if c != "document_id"))
    rows = docs.join(r, "document_id").join(kept, "document_id", "left")
    same = reduce(lambda a, b: a & b, (F.col(f"r_{c}").eqNullSafe(F.col(c)) for c in ("material_id", "parser", "parser_version", "raw_sha256")))
    listed = F.array_sort(F.map_entries(F.coalesce("r_image_hashes", F.create_map().cast("map<string,string>"))))
    manifest = listed.eqNullSafe(F.coalesce("_images", F.array().cast("array<struct<key:string,value:string>>")))
    return found.unionByName(_found(
        rows,
        _finding("receipt_binding_conflict", ~same),
        _finding("receipt_incomplete", ~F.col("r_status").eqNullSafe("completed") | (F.coalesce("r_error", F.lit("")) != ""), field="status"),
        _finding("normalized_hash_mismatch", ~F.coalesce(F.col("r_normalized_sha256") == F.col("r_observed_normalized_sha256"), F.lit(False)), field="normalized_sha256"),
        _finding("image_manifest_conflict", ~manifest, field="image_hashes"),
    ))


def image_findings(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """Images that no block refers to, that lie elsewhere than their block, or whose bytes aren't there or aren't the declared ones."""
    uses = blocks.where("type = 'image_reference' AND image_id IS NOT NULL").select("document_id", "image_id", "block_id", F.col("page").alias("_page"))
    here = {"image_id": F.col("image_id"), "page": F.col("page")}
    bare = images.join(uses, ["document_id", "image_id"], "left_anti")
    elsewhere = images.join(uses, ["document_id", "image_id"]).where(~F.col("page").eqNullSafe(F.col("_page")))
    stored = F.col("artifact_path").isNotNull()
    found = _found(
        images,
        _finding("image_reference_only", ~stored, "warning", REVIEW, **here), _finding("image_metadata_conflict", ~stored & F.col("sha256").isNotNull(), **here),
        _finding("image_artifact_missing", stored & F.col("observed_sha256").isNull(), **here),
        _finding("image_hash_mismatch", stored & F.col("observed_sha256").isNotNull() & ~F.col("sha256").eqNullSafe(F.col("observed_sha256")), **here),
    )
    found = found.unionByName(_found(bare, _finding("image_unreferenced", F.lit(True), "warning", **here)))
    return found.unionByName(_found(elsewhere, _finding("image_location_conflict", F.lit(True), block_id=F.col("block_id"), **here)))


def audited(docs: DataFrame, blocks: DataFrame, contexts: DataFrame, receipts: DataFrame, images: DataFrame, plan: DataFrame) -> DataFrame:
    """All findings. Rows of the other tables whose document isn't there are left out."""
    known = lambda df: df.join(docs.select("document_id"), "document_id", "left_semi")
    blocks, images = known(blocks), known(images)
    parts = [
        document_findings(docs), coverage_findings(docs, blocks), block_findings(docs, blocks), context_findings(blocks, known(contexts)),
        binding_findings(docs, receipts, plan, images), image_findings(blocks, images),
    ]
    return reduce(DataFrame.unionByName, parts)


def audit_states(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(document_id, errors, warnings, status) of each document: failed, passed_with_warnings or passed."""
    n = found.groupBy("document_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = docs.select("document_id").join(n, "document_id", "left").na.fill(0, ["errors", "warnings"])
    return rows.withColumn("status", F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "passed_with_warnings").otherwise("passed"))
