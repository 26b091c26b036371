"""Courses and their materials: planning, look-ups, eligibility, reports, exports, and evaluation gates."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from difflib import SequenceMatcher
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from docloom.functions import text as T
from docloom.functions.base import materialized


def source_page(sources: DataFrame, kind: str, part: str) -> DataFrame:
    """Sources of a type (in their JSON data) whose id contains a text, in order."""
    return sources.where((F.get_json_object("data", "$.source_type") == kind) & F.contains("source_id", F.lit(part))).orderBy("source_id")


def primary_intervals(blocks: DataFrame, intervals: DataFrame) -> DataFrame:
    """Blocks with the intervals of their text that count as primary; a text block without any counts whole, other kinds not at all."""
    joined = blocks.join(intervals.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("intervals")), "block_id", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end")))
    role = F.when(F.col("intervals").isNotNull(), "selected").when(F.col("type").isin("paragraph", "heading", "code", "formula"), "primary").otherwise("reference")
    kept = F.when(role == "primary", whole).when(role == "selected", F.col("intervals"))
    return joined.withColumn("role", role).withColumn("intervals", kept)


def unsafe_metadata(identifier: Column, kind: Column) -> Column:
    """Ids or kinds outside of their characters."""
    return ~(F.regexp_like(identifier, F.lit(r"^[A-Za-z0-9._:-]{1,128}$")) & F.regexp_like(kind, F.lit(r"^[a-z][a-z_]{0,31}$")))


def kept_statements(df: DataFrame) -> DataFrame:
    """Statements with text; those that need a picture wait for it."""
    return df.where(F.trim("text") != "").withColumn("status", F.when(F.col("visual"), "pending").otherwise(F.col("status")))


def of_block(resources: DataFrame, block: str) -> DataFrame:
    """Resources of one lecture block."""
    return resources.where(F.array_contains("lecture_blocks", block))


def nearest_role(context: Column, roles: tuple[str, ...]) -> Column:
    """The role that the nearest labelled ancestor names; the context runs from the root."""
    return F.get(F.filter(F.reverse(context), lambda x: x.isin(*roles)), F.lit(0))


def video_kind(title: Column) -> Column:
    """(kind, block) of a video by its title."""
    kind = F.when(F.regexp_like(title, F.lit("(?i)grundlagen|foundation|basics")), "foundation").otherwise("supplement")
    block = F.nullif(F.regexp_extract(title, r"(?i)(?:block|teil|part)\s*(\d+)", 1), F.lit(""))
    return F.struct(kind.alias("kind"), block.alias("block"))


def official_subtitle(url: Column, sections: Column, allowed: Column, page: Column, pages: Column) -> Column:
    """P20: a subtitle file whose sections are all allowed and whose page is among those of its source."""
    return F.regexp_like(url, F.lit(r"^https://[^\s?#]+\.(srt|vtt)$")) & (F.size(F.array_except(sections, allowed)) == 0) & F.arrays_overlap(F.array(page), pages)


def expression_verdict(valid: Column, matches: Column, confidence: Column) -> Column:
    """Accepted, review or rejected."""
    return F.when(~valid, "rejected").when(matches & (confidence >= 0.8), "accepted").when(confidence < 0.3, "rejected").otherwise("review")


def problems(batches: DataFrame) -> DataFrame:
    """Items (of arrays of id and issues) that have issues, one row per issue."""
    items = batches.select("batch_id", F.explode("items").alias("i")).where(F.size("i.issues") > 0)
    return items.select("batch_id", F.col("i.id").alias("item_id"), F.explode("i.issues").alias("issue"))


def issue_category(code: Column) -> Column:
    """The category that an issue's code belongs to."""
    return F.when(code.rlike("^(latex|formula|math)"), "formula").when(code.rlike("^(time|segment|window)"), "timing").when(code.rlike("^(id|ref|binding)"), "identity").otherwise("content")


def unresolved_formulas(blocks: DataFrame) -> DataFrame:
    """Formula blocks without text."""
    return blocks.where((F.col("type") == "formula") & (F.trim(F.coalesce("text", F.lit(""))) == ""))


def url_problem(url: str | None) -> str | None:
    """Why an address may not be published, or nothing."""
    if not url:
        return "missing"
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return "malformed"
    if parts.scheme != "https":
        return "scheme"
    if parts.username or parts.password or re.search(r"(?i)[?&](token|key|signature|sig|auth|password)=", url):
        return "credentials"
    try:
        if not ipaddress.ip_address(host).is_global:
            return "host"
    except ValueError:
        if "." not in host or host.endswith((".local", ".internal", ".localhost")):
            return "host"
    if port not in (None, 443):
        return "port"
    return "path" if ".." in parts.path.split("/") or "\\" in url or re.search(r"%2e|%5c|%00", url, re.I) else None


@F.pandas_udf(StringType())
def url_policy(urls: pd.Series) -> pd.Series:
    return urls.map(url_problem)


def published(claims: DataFrame, approved: DataFrame) -> DataFrame:
    """Claims as they may be shown: their address only where it is harmless and approved, private columns left out."""
    checked = claims.withColumn("_bad", url_policy("url")).join(approved.select("url", F.lit(True).alias("_ok")).distinct(), "url", "left")
    shown = F.col("_bad").isNull() & F.coalesce("_ok", F.lit(False))
    return checked.select("claim_id", "text", F.when(shown, F.col("url")).alias("url"), F.when(~shown, F.coalesce("_bad", F.lit("not_approved"))).alias("withheld"))


def image_safety(source: Column) -> Column:
    """(status, code) of an image's address."""
    out = lambda status, code: F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"))
    return (
        F.when(source.isNull() | (F.trim(source) == ""), out("rejected", "missing")).when(F.regexp_like(source, F.lit("(?i)^data:")), out("rejected", "inline"))
        .when(F.regexp_like(source, F.lit("(?i)^(javascript|file|vbscript):")), out("rejected", "scheme")).when(F.contains(source, F.lit("..")), out("rejected", "path"))
        .when(F.regexp_like(source, F.lit("(?i)^https?://")), out("external", "remote")).otherwise(out("ok", "local"))
    )


def eligible(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents that are available, completed and verified, and have primary text."""
    ready = documents.where("available AND status = 'completed' AND verified")
    return ready.join(blocks.where((F.col("role") == "primary") & (F.trim("text") != "")), "document_id", "left_semi")


def committed(references: DataFrame, runs: DataFrame) -> DataFrame:
    """References of runs that were committed."""
    return references.join(runs.where("state = 'committed'").select("run_id"), "run_id")


def batch_context(batches: DataFrame, segments: DataFrame, margin: float) -> DataFrame:
    """The segments of each batch's source within its times and a margin, in order, each once."""
    low, high = F.greatest(F.lit(0.0), F.col("start") - margin), F.col("end") + margin
    pairs = batches.join(segments.select("source_id", "seg_id", F.col("start").alias("_s"), F.col("end").alias("_e")), "source_id").where((F.col("_s") <= high) & (F.col("_e") >= low))
    return pairs.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("_s", "seg_id"))), lambda x: x["seg_id"]).alias("segments"))


def hit_problems(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits with what doesn't fit the record that they name: missing, version or window."""
    r = records.select("record_id", F.col("version").alias("_v"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    joined = hits.join(r, "record_id", "left")
    codes = F.array(F.when(F.col("_v").isNull(), "missing"), F.when(F.col("version") != F.col("_v"), "version"), F.when((F.col("start") < F.col("_s")) | (F.col("end") > F.col("_e")), "window"))
    return joined.select("hit_id", F.array_compact(codes).alias("problems"))


def lecture_tasks(lectures: DataFrame, decisions: DataFrame, resources: DataFrame) -> DataFrame:
    """(lecture_id, resource_id, status): a lecture needs exactly one decision, and the resource must be there."""
    n = decisions.groupBy("lecture_id").agg(F.count("*").alias("_n"), F.min("resource_id").alias("resource_id"))
    known = resources.select("resource_id", F.lit(True).alias("_known")).distinct()
    both = lectures.select("lecture_id").distinct().join(n, "lecture_id", "full").join(known, "resource_id", "left")
    status = F.when(F.col("_n").isNull(), "undecided").when(F.col("_n") > 1, "ambiguous").when(F.col("_known").isNull(), "missing_resource").otherwise("ready")
    return both.select("lecture_id", F.when(status == "ready", F.col("resource_id")).alias("resource_id"), status.alias("status"))


def required_actions(resources: DataFrame, files: DataFrame) -> DataFrame:
    """What is left to do for each resource, by the kinds of files that carry its name."""
    have = files.select(F.regexp_replace("name", r"\.[A-Za-z0-9]+$", "").alias("resource_id"), "kind").groupBy("resource_id").agg(F.collect_set("kind").alias("kinds"))
    kinds = F.coalesce("kinds", F.array().cast("array<string>"))
    action = F.when(F.array_contains(kinds, "transcript"), "none").when(F.array_contains(kinds, "audio"), "transcribe").when(F.array_contains(kinds, "video"), "extract_audio").otherwise("download")
    return resources.join(have, "resource_id", "left").select("resource_id", action.alias("action"))


#: Lectures in all plans up to which these are sent to all executors.
SENT_LECTURES = 4_000_000


def material_plan(resources: DataFrame, lectures: DataFrame, separator: str | None = None) -> DataFrame:
    """Each resource with the sorted lectures that share a section with it, as an array or, with a separator, as one text.

    Lectures are gathered once for each set of sections that resources have, and resources look their set up; nothing is multiplied out by resource.
    """
    wanted = resources.select("resource_id", F.coalesce(F.array_sort(F.array_distinct(F.array_compact("sections"))), F.array().cast(resources.schema["sections"].dataType)).alias("_set"))
    wanted = wanted.groupBy("resource_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_set")))).alias("_set"))
    pairs = wanted.select("_set").distinct().select("_set", F.explode("_set").alias("s")).join(lectures.select("lecture_id", F.explode("sections").alias("s")), "s")
    plans = materialized(pairs.groupBy("_set").agg(F.sort_array(F.collect_set("lecture_id")).alias("lectures")))
    named = plans.agg(F.count("*"), F.sum(F.size("lectures"))).first()
    none = F.array().cast(plans.schema["lectures"].dataType)
    if separator is not None:
        plans, none = plans.withColumn("lectures", F.array_join("lectures", separator)), F.lit("")
    found = wanted.join(F.broadcast(plans) if max(named[0], named[1] or 0) <= SENT_LECTURES else plans, "_set", "left")
    return found.select("resource_id", F.coalesce("lectures", none).alias("lectures"))


def urls_by_index(files: DataFrame, urls: DataFrame, overwrite: bool = False) -> DataFrame:
    """Files with the address of the three-digit index in their name, and whether it is new, kept, replaced or missing."""
    index = F.nullif(F.regexp_extract("name", r"(?:^|\D)(\d{3})(?:\D|$)", 1), F.lit(""))
    joined = files.withColumn("index", index).join(urls.select("index", F.col("url").alias("_new")), "index", "left")
    state = F.when(F.col("_new").isNull(), "missing").when(F.col("url").isNull(), "new").when(F.col("url") == F.col("_new"), "same").when(F.lit(overwrite), "replaced").otherwise("kept")
    url = F.when(state.isin("new", "replaced"), F.col("_new")).otherwise(F.col("url"))
    return joined.select("name", url.alias("url"), state.alias("state"))


def axis_counts(reviews: DataFrame, axes: list[str]) -> DataFrame:
    """Per axis how many rows are reviewed, unknown, and have each value."""
    long = reviews.unpivot([], axes, "axis", "value")
    return long.groupBy("axis", "value").agg(F.count("*").alias("n")).withColumn("reviewed", F.coalesce(F.col("value") != "unknown", F.lit(False)))


def validation_report(resources: DataFrame, required: list[str]) -> DataFrame:
    """Per kind the number of resources, how many are complete, and the first that isn't."""
    missing = _lacking(required)
    return resources.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(~missing).alias("complete"), F.min(F.when(missing, F.col("resource_id"))).alias("first_incomplete"))


def incomplete(resources: DataFrame, required: list[str]) -> DataFrame:
    """The resources that lack something, one row each, with what they lack."""
    lacks = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)))
    return resources.select("kind", "resource_id", lacks.alias("lacks")).where(F.size("lacks") > 0)


def _lacking(required: list[str]) -> Column:
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    return missing


def first_outputs(outputs: DataFrame) -> DataFrame:
    """The first output of each kind, identity and hash, of stages that are valid."""
    by = Window.partitionBy("kind", "identity", "sha").orderBy("ordinal")
    return outputs.where("valid").withColumn("_p", F.row_number().over(by)).where("_p = 1").drop("_p")


def schedule_totals(lectures: DataFrame) -> DataFrame:
    """Integer metrics (a map) of completed lectures, summed by name; a metric that a lecture lacks makes its total unknown."""
    done = lectures.where("status = 'complete'")
    total = done.agg(F.count("*").alias("_n"))
    sums = done.select(F.explode("metrics")).groupBy("key").agg(F.sum("value").alias("total"), F.count("*").alias("_have"))
    return sums.crossJoin(F.broadcast(total)).select("key", "total", (F.col("_have") == F.col("_n")).alias("complete"))


def overview(offers: DataFrame, formats: list[str]) -> DataFrame:
    """Offers of each course by format."""
    return offers.groupBy("course_id").pivot("format", formats).count().na.fill(0)


def histograms(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of the values of several columns, in one table."""
    return df.unpivot([], columns, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))


def distinct_names(df: DataFrame, column: str) -> DataFrame:
    """The distinct names, and how many rows have none."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def cursor_page(hits: DataFrame, fingerprint: str, cursor: tuple[str, int, float] | None, now: float, limit: int, life: float = 300.0) -> DataFrame:
    """Hits (rank, ...) after the cursor (fingerprint of the result, last rank, time), refused when it is old or of another result."""
    if cursor is not None and (cursor[0] != fingerprint or now - cursor[2] > life):
        raise ValueError("the cursor has expired, or belongs to another result")
    return hits.where(F.col("rank") > (cursor[1] if cursor else 0)).orderBy("rank").limit(limit)


def signature(secret: bytes, domain: str, message: str) -> str:
    """HMAC of a message within its domain, for cursors and tokens on the driver."""
    return hmac.new(secret, f"{domain}\0{message}".encode(), hashlib.sha256).hexdigest()


def normalized_hits(hits: DataFrame, top: int) -> DataFrame:
    """Hits of several collections: blank ones out, similarity from distance, the nearest first, unknown distances last."""
    kept = hits.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("similarity", 1 - F.col("distance"))
    return kept.orderBy(F.asc_nulls_last("distance"), "collection", "id").limit(top)


def history(jobs: DataFrame, actor: str, limit: int, offset: int = 0) -> DataFrame:
    """An actor's jobs, the newest first."""
    return jobs.where(F.col("owner") == actor).orderBy(F.desc("started_at"), F.desc("job_id")).offset(offset).limit(limit)


@F.pandas_udf(DoubleType())
def text_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, 0 for an empty side. For pairs that something cheaper has found."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right, strict=True)])


def matching_key(c: Column) -> Column:
    """The form in which texts are compared."""
    return T.folded_blanks(F.regexp_replace(T.casefold(T.nfkc(c)), r"[^\p{L}\p{N}_\s]", " "))


def clean_token(c: Column) -> Column:
    """compatibility form, no byte-order mark, ends trimmed."""
    return F.trim(F.replace(T.nfkc(c), F.lit("\ufeff"), F.lit("")))


def title_parts(c: Column) -> Column:
    """(number, title) of a lecture's name, with blanks for underscores."""
    number = F.nullif(F.regexp_extract(c, r"^(\d+(?:\.\d+)*)_", 1), F.lit(""))
    return F.struct(number.alias("number"), F.replace(F.regexp_replace(c, r"^\d+(\.\d+)*_", ""), F.lit("_"), F.lit(" ")).alias("title"))


def breadcrumb(c: Column) -> Column:
    """the parts of a nested name, trimmed, blank ones out, joined."""
    return F.array_join(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""), " > ")


def token_windows(df: DataFrame, text: str, most: int) -> DataFrame:
    """Windows of at most `most` tokens, two of which mark the ends, as parts (chunk, start, end) that cover the whole text.

    A window ends where its last token does, the last window with the text. A text without tokens is one window.
    """
    body = most - 2
    tokens = F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), F.lit(1))
    gaps = F.split(F.col(text), r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]", -1)
    sizes = F.zip_with(tokens, F.slice(gaps, 1, F.size(tokens)), lambda t, g: F.length(t) + F.length(g))
    ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + n)))
    cut = F.filter(F.transform(ends, lambda e, i: F.when((i + 1) % body == 0, e)), lambda e: e.isNotNull() & (e < F.length(text)))
    bounds = F.concat(F.array(F.lit(0)), F.filter(cut, lambda e: e < F.element_at(ends, -1)), F.array(F.length(text)))
    rows = df.withColumn("_b", bounds).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.size("_b") - 2)))
    return rows.select("*", F.get("_b", F.col("chunk")).alias("start"), F.get("_b", F.col("chunk") + 1).alias("end")).drop("_b")


def stale(live: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Sources whose live digest isn't the manifest's, or that only one side has."""
    both = live.select(key, F.col("digest").alias("_live")).join(manifest.select(key, F.col("digest").alias("_kept")), key, "full")
    return both.where(~F.col("_live").eqNullSafe(F.col("_kept"))).select(key)


def merged_clusters(clusters: DataFrame, facts: DataFrame) -> DataFrame:
    """The fact that stands for each cluster: the longest of its members, ties to the smaller id; a model may be put here instead."""
    by = Window.partitionBy("leader").orderBy(F.desc(F.length("text")), "id")
    return clusters.join(facts, "id").withColumn("_p", F.row_number().over(by)).where("_p = 1").select("leader", "id", "text")


def index_items(items: DataFrame, records: DataFrame) -> DataFrame:
    """Items with the records of their evidence (arrays of record ids), and whether all of them are there with the hash that the item has."""
    e = items.select("item_id", F.explode_outer("evidence").alias("e")).select("item_id", "e.record_id", "e.sha")
    r = records.select("record_id", F.col("sha").alias("_sha"))
    return e.join(r, "record_id", "left").groupBy("item_id").agg(F.count("_sha").alias("records"), F.bool_and(F.coalesce(F.col("sha") == F.col("_sha"), F.lit(False))).alias("valid"))


def evaluability(queries: DataFrame, pool: DataFrame, hits: DataFrame) -> DataFrame:
    """Why a query can't be evaluated: not reviewed, an incomplete pool, hits without judgement; none for those that can."""
    judged = pool.select("query_id", "target", F.lit(True).alias("_j")).distinct()
    open_ = hits.join(judged, ["query_id", "target"], "left").groupBy("query_id").agg(F.count_if(F.col("_j").isNull()).alias("_open"))
    joined = queries.join(open_, "query_id", "left")
    codes = F.array(F.when(F.col("review_status") != "reviewed", "not_reviewed"), F.when(~F.col("pool_complete"), "pool_incomplete"), F.when(F.col("_open") > 0, "unjudged_hits"))
    return joined.select("query_id", F.array_compact(codes).alias("reasons"))


def cue_template(queries: DataFrame, cues: DataFrame) -> DataFrame:
    """The window of each query's cues: its first start and last end."""
    pairs = queries.select("query_id", F.explode("cue_ids").alias("cue_id")).join(cues, "cue_id")
    return pairs.groupBy("query_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("cues"))


def bound_predictions(predictions: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions with the one gold case that agrees in the keys; several or none leave it open."""
    n = gold.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("case_id").alias("_case"))
    joined = predictions.join(n, keys, "left")
    return joined.withColumn("case_id", F.when(F.col("_n") == 1, F.col("_case"))).withColumn("binding", F.when(F.col("_n") == 1, "bound").when(F.col("_n") > 1, "ambiguous").otherwise("none")).drop("_n", "_case")


def handoff(lectures: DataFrame, audits: DataFrame, units: DataFrame) -> DataFrame:
    """Lectures whose audit passed and that have units."""
    passed = audits.where(F.col("status") != "failed").select("lecture_id")
    return lectures.join(passed, "lecture_id", "left_semi").join(units.select("lecture_id").distinct(), "lecture_id", "left_semi")


def appended(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries (entity, revision, request, value) as accepted, replayed or in conflict with the ledger's last revision of the entity."""
    head = ledger.groupBy("entity").agg(F.max("revision").alias("_head"))
    seen = ledger.select("entity", "request", F.col("value").alias("_value"))
    joined = entries.join(head, "entity", "left").join(seen, ["entity", "request"], "left")
    state = F.when(F.col("_value") == F.col("value"), "replayed").when(F.col("_value").isNotNull(), "conflict").when(F.col("revision") == F.coalesce("_head", F.lit(0)) + 1, "accepted").otherwise("conflict")
    return joined.select("entity", "revision", "request", "value", state.alias("state"))


def recovery(runs: DataFrame, now: Column, ttl_seconds: float) -> DataFrame:
    """What becomes of runs that were cut off: resumed if their generation is there, else abandoned."""
    late = F.col("heartbeat") < now - F.make_interval(secs=F.lit(ttl_seconds))
    action = F.when(F.col("state") != "running", "none").when(~late, "wait").when(F.col("generation").isNotNull(), "resume").otherwise("abandon")
    return runs.select("run_id", action.alias("action"))


def planned_within(resources: DataFrame, order: str, size: str, cap: float) -> DataFrame:
    """Resources in order while their sizes together stay within the cap; the others are named as left out."""
    by = Window.partitionBy("course_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return resources.withColumn("planned", F.sum(size).over(by) <= cap)


def reference_coverage(references: DataFrame, course: str, kind: str, kinds: list[str], supported: Column) -> DataFrame:
    """References of each course by kind, how many of them can be fetched, and their share."""
    fetched = F.count_if(supported)
    return references.groupBy(course).agg(*(F.count_if(F.col(kind) == k).alias(k) for k in kinds), fetched.alias("supported"), (fetched / F.count("*")).alias("supported_share"))
