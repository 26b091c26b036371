"""Knowledge from orders, parts, documents and conversations: merging, evidence, gates, and folds whose SQL is recursive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.base import micros, r6, read
from docloom.operators import filters, folds, knowledge, layout, relational, windows
from docloom.plans.registry import query

STATES = "['verified', 'rejected', 'pending', 'unverified']"


@query("a05_formula_groups", f"""WITH f AS (SELECT p_partkey AS id, 'x+' || p_size AS plain, p_brand AS latex, p_partkey % 2 AS kind, list_extract({STATES}, 1 + (p_partkey % 7 % 4)) AS status FROM part),
g AS (SELECT plain, latex, kind, min(id) AS first, list(DISTINCT status) AS s, count(*) AS variants FROM f GROUP BY ALL)
SELECT plain AS plain_key, latex, kind::VARCHAR AS kind, first, first AS representative, variants::INTEGER AS variants, CASE WHEN list_has_all(s, ['verified', 'rejected']) THEN 'conflict' WHEN list_contains(s, 'verified') THEN 'verified' WHEN list_contains(s, 'rejected') THEN 'rejected' WHEN list_contains(s, 'pending') THEN 'pending' ELSE 'unverified' END AS status,
printf('KE%04d', row_number() OVER (ORDER BY first)) AS group_id FROM g""")
def formula_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of parts, every other one with blanks around its sign."""
    part = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand")
    sign = F.when(F.col("p_partkey") % 3 == 0, "+").otherwise(" +  ")
    status = F.element_at(F.array(*map(F.lit, ("verified", "rejected", "pending", "unverified"))), (F.col("p_partkey") % 7 % 4 + 1).cast("int"))
    rows = part.select(F.col("p_partkey").alias("formula_id"), F.concat(F.lit("x"), sign, F.col("p_size")).alias("plain"), F.col("p_brand").alias("latex"), (F.col("p_partkey") % 2).cast("string").alias("kind"), status.alias("status"), F.col("p_partkey").alias("ordinal"))
    return knowledge.formula_groups(rows).withColumn("variants", F.size("variants"))


@query("a06_canonical_statements", """WITH s AS (SELECT o_custkey AS k, o_orderpriority AS source, o_totalprice AS confidence, epoch_us(o_orderdate) AS start, o_orderstatus || o_orderkey AS text, o_orderpriority AS kind FROM orders),
g AS (SELECT k, arg_max({'t': text, 'k': kind}, (confidence, -start)) AS b, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, max(confidence) AS confidence, min(start) AS start FROM s GROUP BY k)
SELECT printf('CS%04d', row_number() OVER (ORDER BY start, k)) AS id, k AS key, b.t AS text, b.k AS kind, sources, confidence, start FROM g""")
def canonical_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    rows = orders.select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("source_id"), F.col("o_totalprice").alias("confidence"), micros("o_orderdate").alias("start"), F.concat("o_orderstatus", "o_orderkey").alias("text"), F.col("o_orderpriority").alias("kind"))
    return knowledge.canonical_statements(rows).withColumn("sources", F.array_join("sources", ","))


@query("a07_entities", """WITH n AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END || c_custkey % 50 AS name, 'k' || c_nationkey AS kind, c_acctbal AS confidence, [c_mktsegment, 'n' || c_nationkey % 3] AS aliases FROM customer)
SELECT lower(name) AS key, min(name) AS name, arg_max(kind, (confidence, kind)) AS kind, array_to_string(list_sort(list_distinct(flatten(list(aliases)))), ',') AS aliases FROM n GROUP BY lower(name)""")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    cased = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    aliases = F.array("c_mktsegment", F.concat(F.lit("n"), (F.col("c_nationkey") % 3).cast("string")))
    rows = c.select(F.concat(cased, (F.col("c_custkey") % 50).cast("string")).alias("name"), F.concat(F.lit("k"), F.col("c_nationkey").cast("string")).alias("kind"), F.col("c_acctbal").alias("confidence"), aliases.alias("aliases"))
    return knowledge.entities(rows).select("key", "name", "kind", F.array_join("aliases", ",").alias("aliases"))


@query("a09_evidence_dedup", """SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2, l_returnflag, l_linenumber % 2, l_tax, l_linestatus, l_discount > 0.05 ORDER BY l_linenumber) = 1""")
def evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_tax", "l_discount")  # noqa: E741
    rows = l.select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("item_id"), (F.col("l_suppkey") % 2).alias("source_id"), F.col("l_returnflag").alias("chunk_id"), (F.col("l_linenumber") % 2).alias("segment_id"), F.col("l_tax").alias("start"), F.lit(None).cast("double").alias("end"), F.col("l_linestatus").alias("kind"), (F.col("l_discount") > 0.05).alias("relation"))
    return knowledge.evidence_dedup(rows, "l_linenumber").select("l_orderkey", "l_linenumber")


@query("a10_confidence", "SELECT l_partkey AS item_id, max(l_discount) FILTER (l_returnflag = 'A') AS confidence FROM lineitem GROUP BY l_partkey")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag", "l_discount")  # noqa: E741
    return knowledge.confidence(l.select(F.col("l_partkey").alias("item_id"), F.when(F.col("l_returnflag") == "A", "support").otherwise("contradict").alias("relation"), F.col("l_discount").alias("confidence")))


@query("a08_evidence_range", "SELECT o_orderkey, min(l_quantity) AS start, max(l_extendedprice) AS \"end\" FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey")
def evidence_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without returned lines have no evidence and no range."""
    held = read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice").where("l_returnflag = 'R'")
    held = held.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_quantity").alias("start"), F.col("l_extendedprice").alias("end"))).alias("evidence"))
    start, end = filters.evidence_times("evidence")
    return read(spark, sf_dir, "orders", "o_orderkey").join(held, "o_orderkey", "left").select("o_orderkey", start.alias("start"), end.alias("end"))


@query("j08_overlapping", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000 AS s, event_type FROM events), a AS (SELECT * FROM e WHERE event_type = 'error'), w AS (SELECT * FROM e WHERE event_type = 'purchase')
SELECT DISTINCT a.event_id AS evidence_id, w.event_id AS window_id FROM a JOIN w USING (user_id) WHERE (a.s <= w.s + 3600 AND w.s <= a.s + 600) OR a.event_id % 10 = w.event_id % 10""")
def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as evidence and purchases as windows of one user: ten minutes against an hour, or the same last digit as a shared segment."""
    events = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    of = lambda kind, name, length: events.where(F.col("event_type") == kind).select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias(name), F.array(F.col("event_id") % 10).alias("segments"), (micros("ts") / 1e6).alias("start"), (micros("ts") / 1e6 + length).alias("end")
    )
    return knowledge.overlapping(of("error", "evidence_id", 600), of("purchase", "window_id", 3600), 3600.0).select("evidence_id", "window_id")


@query("j10_verified_items", """WITH c AS (SELECT l_partkey, arg_max(l_returnflag, l_shipdate_n) AS checked, max(l_shipdate_n) AS ordinal FROM (SELECT *, epoch_us(l_shipdate) // 1000000 * 1000000000 + round(l_extendedprice * 100)::BIGINT AS l_shipdate_n FROM lineitem WHERE l_suppkey % 2 = 0) GROUP BY l_partkey),
h AS (SELECT l_orderkey AS item_id, arg_max(checked, ordinal) AS checked FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN c USING (l_partkey) GROUP BY l_orderkey)
SELECT o_orderkey AS item_id, coalesce(checked, o_orderstatus) AS status FROM orders LEFT JOIN h ON item_id = o_orderkey""")
def verified_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items, their parts as expressions; the lines of every other supplier as checks, the last of a part counting."""
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_extendedprice")  # noqa: E741
    ordinal = F.floor(micros("l_shipdate") / 1_000_000) * 1_000_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long")
    checks = l.where("l_suppkey % 2 = 0").select(F.col("l_partkey").alias("expression_id"), F.col("l_returnflag").alias("status"), ordinal.alias("ordinal"))
    held = l.groupBy(F.col("l_orderkey").alias("item_id")).agg(F.collect_set("l_partkey").alias("expressions"))
    items = read(spark, sf_dir, "orders", F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("status")).join(held, "item_id", "left")
    return knowledge.verified_items(items, checks).select("item_id", "status")


@query("j11_unverified", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08)")
def unverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag", "l_discount").where("l_returnflag = 'R' AND l_discount > 0.08").select(F.col("l_partkey").alias("p_partkey"))
    return relational.without(read(spark, sf_dir, "part", "p_partkey"), seen, "p_partkey")


@query("j12_frame_matches", """WITH v AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), f AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 40)
SELECT l_orderkey AS formula_id, count(DISTINCT l_suppkey) AS frames FROM v JOIN f USING (l_partkey) GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) >= 5""")
def frame_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose parts occur in at least five suppliers' large lines."""
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")  # noqa: E741
    formulas = l.groupBy(F.col("l_orderkey").alias("formula_id")).agg(F.collect_set("l_partkey").alias("variants"))
    frames = l.where("l_quantity > 40").groupBy(F.col("l_suppkey").alias("frame_id")).agg(F.collect_set("l_partkey").alias("variants"))
    return knowledge.frame_matches(formulas, frames, 5)


@query("p35_evidence_gate", """WITH s AS (SELECT o_orderkey AS c, unnest(CASE WHEN o_orderkey % 5 = 0 THEN [1, 2, 2, 9] WHEN o_orderkey % 5 = 1 THEN [1, 1] WHEN o_orderkey % 5 = 2 THEN [3, 2] ELSE [] END) AS n FROM orders),
j AS (SELECT DISTINCT c, n, l_quantity, l_extendedprice FROM s LEFT JOIN lineitem ON l_orderkey = c AND l_linenumber = n)
SELECT o_orderkey AS candidate_id, coalesce(array_to_string(list_sort(list(DISTINCT n) FILTER (n IS NOT NULL)), ','), '') AS segments, min(l_quantity) AS start, max(l_extendedprice) AS "end", coalesce(bool_and(l_quantity IS NOT NULL), false) AS valid FROM orders LEFT JOIN j ON c = o_orderkey GROUP BY o_orderkey""")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders cite lines of theirs, some of which aren't there; those that cite none fail."""
    kind = F.col("o_orderkey") % 5
    cited = F.when(kind == 0, F.array(*map(F.lit, (1, 2, 2, 9)))).when(kind == 1, F.array(F.lit(1), F.lit(1))).when(kind == 2, F.array(F.lit(3), F.lit(2))).otherwise(F.array().cast("array<int>"))
    candidates = read(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("candidate_id"), F.col("o_orderkey").alias("chunk_id"), cited.alias("segment_ids"))
    segments = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").toDF("chunk_id", "segment_id", "start", "end")
    return knowledge.evidence_gate(candidates, segments).select("candidate_id", F.array_join("segment_ids", ",").alias("segments"), "start", "end", "valid")


@query("p36_verbatim_gate", """SELECT c.doc_id AS claim_id, coalesce(contains(r.text, substring(c.text, 11, 60)), false) AS verbatim FROM documents c LEFT JOIN documents r ON r.doc_id = CASE WHEN c.doc_id % 3 = 0 THEN c.doc_id + 1 ELSE c.doc_id END""")
def verbatim_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims quote their document; every third one cites the next document instead."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    cited = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    claims = docs.select(F.col("doc_id").alias("claim_id"), F.substring("text", 11, 60).alias("text"), cited.alias("ref_id"))
    return knowledge.verbatim_gate(claims, docs.select(F.col("doc_id").alias("ref_id"), "text")).select("claim_id", "verbatim")


@query("e10_item_findings", """SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_linenumber % 4 = 0 THEN 'no_text' END, CASE WHEN l_orderkey % 6 = 0 THEN 'no_evidence' END, CASE WHEN l_quantity > 40 OR l_linenumber = 7 THEN 'confidence_range' END, CASE WHEN l_returnflag = 'N' THEN 'status' END], lambda x: x IS NOT NULL), ',') AS codes FROM lineitem""")
def item_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")  # noqa: E741
    status = F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "R", "rejected").otherwise("unknown")
    rows = l.select(F.struct("l_orderkey", "l_linenumber").alias("item_id"), F.when(F.col("l_linenumber") % 4 == 0, " ").otherwise("t").alias("text"), (F.col("l_orderkey") % 6).alias("evidence_count"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 40).alias("confidence"), status.alias("status"))
    return knowledge.item_findings(rows).select("item_id.*", F.array_join("codes", ",").alias("codes"))


@query("e17_plan_coverage", """WITH u AS (SELECT l_partkey AS f, count(*) AS n FROM lineitem WHERE l_discount > 0.08 GROUP BY ALL UNION ALL SELECT -1 - o_orderkey, 1 FROM orders WHERE o_orderstatus = 'P')
SELECT coalesce(p_partkey, f) AS fact_id, CASE WHEN p_partkey IS NULL THEN 'unknown' WHEN n IS NULL THEN 'unassigned' WHEN n > 1 THEN 'repeated' ELSE 'assigned' END AS state FROM part FULL JOIN u ON f = p_partkey""")
def plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as facts, heavily reduced lines and open orders as chapters that claim them."""
    plan = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_discount").where("l_discount > 0.08").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("fact_ids"))
    other = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'P'").select("o_orderkey", F.array(-1 - F.col("o_orderkey")).alias("fact_ids"))
    return knowledge.plan_coverage(plan.union(other), read(spark, sf_dir, "part", F.col("p_partkey").alias("fact_id")))


# --- folds ------------------------------------------------------------------------------------------------------------------

TURNS = r"""t AS (SELECT conv_id, turn, turn // 3 AS page, len(regexp_split_to_array(trim(text), '\s+')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    words = F.size(F.split(F.trim("text"), r"\s+")).cast("long")
    return rows.select("conv_id", F.col("turn").alias("order"), F.floor(F.col("turn") / 3).alias("page"), words.alias("tokens"), "text")


@query("w03_merged_blocks", f"""WITH RECURSIVE {TURNS}, r AS (SELECT conv_id, i, turn AS first, page, n AS tokens FROM t WHERE i = 1
UNION ALL SELECT t.conv_id, t.i, CASE WHEN r.page = t.page AND r.tokens + t.n <= 40 THEN r.first ELSE t.turn END, t.page, CASE WHEN r.page = t.page AND r.tokens + t.n <= 40 THEN r.tokens + t.n ELSE t.n END FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
SELECT r.conv_id, r.first, max(t.turn) AS last, max(r.page) AS page, max(r.tokens) AS tokens, sha256(string_agg(c.text, chr(10) ORDER BY t.turn)) AS sha FROM r JOIN t USING (conv_id, i) JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn GROUP BY r.conv_id, r.first""")
def merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.merged_blocks(_turns(spark, sf_dir), "conv_id", 40).select("conv_id", "first", "last", "page", "tokens", F.sha2("text", 256).alias("sha"))


@query("w04_sentence_chunks", f"""WITH RECURSIVE {TURNS}, r AS (SELECT conv_id, i, 0 AS chunk, turn AS first, n AS held, n AS before, turn AS place FROM t WHERE i = 1
UNION ALL SELECT t.conv_id, t.i, CASE WHEN r.held + t.n > 60 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.held + t.n > 60 THEN r.place ELSE r.first END, CASE WHEN r.held + t.n > 60 THEN r.before ELSE r.held END + t.n, t.n, t.turn FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1),
c AS (SELECT conv_id, chunk, min(first) AS first, max(place) AS last FROM r GROUP BY conv_id, chunk)
SELECT c.conv_id, c.chunk::BIGINT AS chunk, c.first, c.last, sha256(string_agg(v.text, ' ' ORDER BY v.turn)) AS sha FROM c JOIN conversations v ON v.conv_id = c.conv_id AND v.turn BETWEEN c.first AND c.last GROUP BY ALL""")
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sentences, up to 60 words a chunk, the last turn of a chunk opening the next."""
    return folds.sentence_chunks(_turns(spark, sf_dir), "conv_id", 60, 1).select("conv_id", "chunk", "first", "last", F.sha2("text", 256).alias("sha"))


SPANS = """t AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS s, epoch_us(ts) / 1000000.0 + 600 + value * 10 AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, value, event_id) AS i FROM events)"""


@query("w12_capped_windows", f"""WITH RECURSIVE {SPANS}, r AS (SELECT user_id, i, s AS start, e AS finish, 1 AS w FROM t WHERE i = 1
UNION ALL SELECT t.user_id, t.i, CASE WHEN ok THEN r.start ELSE t.s END, CASE WHEN ok THEN greatest(r.finish, t.e) ELSE t.e END, CASE WHEN ok THEN r.w ELSE r.w + 1 END
FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i + 1, LATERAL (SELECT t.s - r.finish <= 1800 AND greatest(r.finish, t.e) - r.start <= 14400 AS ok))
SELECT user_id, round(min(start), 6) AS start, round(max(finish), 6) AS "end", count(*) AS n FROM r GROUP BY user_id, w""")
def capped_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that last ten minutes or more, joined over half an hour, up to four hours."""
    events = read(spark, sf_dir, "events", "ts", "user_id", "value")
    rows = events.select("user_id", (micros("ts") / 1e6).alias("start"), (micros("ts") / 1e6 + 600 + F.col("value") * 10).alias("end"))
    return folds.capped_windows(rows, "user_id", 1800.0, 14400.0).select("user_id", r6(F.col("start")).alias("start"), r6(F.col("end")).alias("end"), "n")


@query("w16_distinct_frames", """WITH RECURSIVE t AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS s, (event_id * 2654435761) % 4294967296 AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, event_id, s, h, true AS kept FROM t WHERE i = 1 UNION ALL SELECT t.user_id, t.i, CASE WHEN ok THEN t.event_id ELSE r.event_id END, CASE WHEN ok THEN t.s ELSE r.s END, CASE WHEN ok THEN t.h ELSE r.h END, ok
FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i + 1, LATERAL (SELECT bit_count(xor(t.h, r.h)) >= 17 OR t.s - r.s >= 86400 AS ok))
SELECT user_id, event_id AS frame FROM r WHERE kept""")
def distinct_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames with a hash of 32 bits, of which 17 must differ, or a day must have passed."""
    events = read(spark, sf_dir, "events", "event_id", "ts", "user_id")
    rows = events.select("user_id", F.col("event_id").alias("frame"), (micros("ts") / 1e6).alias("at"), ((F.col("event_id") * 2654435761) % 4294967296).alias("hash"))
    return folds.distinct_frames(rows, "user_id", 17, 86400.0)


@query("w31_rows_by_mean", """WITH RECURSIVE t AS (SELECT user_id, event_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY value, ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, event_id, y AS total, 1 AS n, 0 AS row FROM t WHERE i = 1 UNION ALL SELECT t.user_id, t.i, t.event_id, CASE WHEN ok THEN r.total + t.y ELSE t.y END, CASE WHEN ok THEN r.n + 1 ELSE 1 END, CASE WHEN ok THEN r.row ELSE r.row + 1 END
FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i + 1, LATERAL (SELECT abs(t.y - r.total / r.n) <= 3 AS ok)) SELECT user_id AS page, event_id AS word, row::BIGINT AS row FROM r""")
def rows_by_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as words of a user's page, their value as height."""
    events = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    return folds.rows_by_mean(events.select(F.col("user_id").alias("page"), F.col("event_id").alias("word"), micros("ts").alias("x"), F.col("value").alias("y")), 3.0)


# --- lines of documents -----------------------------------------------------------------------------------------------------

LINES = r"""l AS (SELECT doc_id AS page, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS text FROM documents),
h AS (SELECT page, line, CASE WHEN line % 5 = 3 THEN line || '. ' ELSE '' END || CASE WHEN line % 4 = 1 THEN rtrim(text) || 'ab-' ELSE text END AS text, line * 14 + CASE WHEN line % 6 = 0 THEN 30 ELSE 0 END AS y0 FROM l)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with their heights; some are numbered, some end in a hyphen, some stand apart."""
    lines = read(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    text = F.concat(F.when(F.col("line") % 5 == 3, F.format_string("%d. ", "line")).otherwise(""), F.when(F.col("line") % 4 == 1, F.concat(F.rtrim("text"), F.lit("ab-"))).otherwise(F.col("text")))
    return lines.select("page", F.col("line").cast("long").alias("line"), text.alias("text"), (F.col("line") * 14 + F.when(F.col("line") % 6 == 0, 30).otherwise(0)).cast("double").alias("y0")).withColumn("y1", F.col("y0") + 12)


@query("w20_paragraphs", rf"""WITH {LINES}, s AS (SELECT *, lag(text) OVER w AS b, y0 - (lag(y0) OVER w + 12) AS gap FROM h WINDOW w AS (PARTITION BY page ORDER BY line)),
c AS (SELECT *, b IS NULL OR regexp_matches(text, '^\s*\d+[.)]\s') OR NOT (regexp_matches(b, '\p{{L}}-\s*$') OR NOT regexp_matches(b, '[.!?:]\s*$') OR gap < 10) AS starts FROM s)
SELECT page, line, sum(starts::INTEGER) OVER (PARTITION BY page ORDER BY line)::BIGINT AS paragraph FROM c""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.paragraphs(_lines(spark, sf_dir), 10.0).select("page", "line", "paragraph")


@query("w21_joined_hyphens", rf"""WITH {LINES}, s AS (SELECT *, lag(text) OVER w AS b, lead(text) OVER w AS a FROM h WINDOW w AS (PARTITION BY page ORDER BY line)),
c AS (SELECT *, coalesce(regexp_matches(rtrim(b), '[\p{{L}}\p{{N}}]-$') AND regexp_matches(text, '^\s*[\p{{L}}\p{{N}}]'), false) AS joined, coalesce(regexp_matches(rtrim(text), '[\p{{L}}\p{{N}}]-$') AND regexp_matches(a, '^\s*[\p{{L}}\p{{N}}]'), false) AS open, regexp_matches(lower(a), '^\s*(the|der),*(\s|$)') AS stop FROM s),
p AS (SELECT page, line, sum((NOT joined)::INTEGER) OVER (PARTITION BY page ORDER BY line) AS g, CASE WHEN joined THEN ltrim(text) ELSE text END AS t, open, stop FROM c)
SELECT page, min(line) AS line, sha256(string_agg(CASE WHEN NOT open THEN t WHEN stop THEN rtrim(t) || ' ' ELSE left(rtrim(t), length(rtrim(t)) - 1) END, '' ORDER BY line)) AS sha FROM p GROUP BY page, g""")
def joined_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.joined_hyphens(_lines(spark, sf_dir).select("page", "line", "text"), "page", ("the", "der"))
    return found.select("page", "line", F.sha2("text", 256).alias("sha"))


@query("p26_line_classes", rf"""WITH {LINES}, s AS (SELECT page, line, trim(text, chr(32) || chr(9) || chr(13)) AS x, (line % 17 = 0) AS margin, (line % 13 = 5) AS contents, line % 5 AS score FROM h),
k AS (SELECT *, CASE WHEN margin THEN 'margin' WHEN contents THEN 'contents' WHEN regexp_matches(x, '^[-*•]\s') THEN 'bullet' WHEN score >= 4 THEN 'heading' WHEN regexp_matches(x, '^\p{{Ll}}') THEN NULL WHEN score = 0 AND regexp_matches(x, '^\d') AND length(x) > 60 THEN 'footnote' ELSE 'body' END AS own FROM s),
b AS (SELECT *, last_value(CASE WHEN own <> 'margin' THEN own END IGNORE NULLS) OVER (PARTITION BY page ORDER BY line) AS prior FROM k)
SELECT page, line, coalesce(own, CASE WHEN prior IN ('bullet', 'footnote') THEN prior ELSE 'body' END) AS class FROM b""")
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("line")
    return layout.line_classes(_lines(spark, sf_dir).select("page", "line", "text", (n % 5).alias("score"), (n % 17 == 0).alias("margin"), (n % 13 == 5).alias("contents")))


@query("p27_line_scores", rf"""WITH {LINES} SELECT page, line, (12 + line % 7 > 14.4)::INTEGER + (line % 3 = 0)::INTEGER + (len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) < 10)::INTEGER + (NOT regexp_matches(text, '[.!?]\s*$'))::INTEGER + regexp_matches(text, '^\d+(\.\d+)*\s')::INTEGER AS score,
((line % 20) / 20.0 <= 0.06 OR (line % 20) / 20.0 >= 0.94) AND (length(text) < 60 OR regexp_matches(text, '^\s*\d+\s*$')) AS margin, regexp_matches(text || ' . . . 7', '(\.\s?){{3,}}\s*\d+\s*$') AS contents FROM h""")
def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, text = F.col("line"), F.col("text")
    score = layout.heading_score(12 + n % 7, F.lit(12.0), n % 3 == 0, text)
    return _lines(spark, sf_dir).select("page", "line", score.alias("score"), layout.margin_line(n % 20 / 20, text).alias("margin"), layout.contents_line(F.concat(text, F.lit(" . . . 7"))).alias("contents"))


PLACED = rf"""WITH RECURSIVE {LINES}, p AS (SELECT page, line, CASE line % 9 WHEN 0 THEN '1.2 ' WHEN 2 THEN '• ' WHEN 3 THEN 'b) ' WHEN 5 THEN 'iv ' ELSE '' END || text AS text, CASE WHEN line % 4 = 3 THEN 90.0 WHEN line % 11 = 5 THEN 72.0 ELSE 50.0 END AS x0, y0 + CASE WHEN line % 8 = 7 THEN 20 ELSE 0 END AS y0 FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY line) AS i, CASE WHEN regexp_matches(text, '^\s*\d+\.\d+\s') THEN 'body' WHEN regexp_matches(text, '^\s*([-–•▪●]|[a-z]\)|\([ivxlcdm]+\))\s+\S', 'i') OR (regexp_matches(text, '^\s*[ivxlcdm]+\s+\S', 'i') AND x0 > 65) THEN 'bullet' END AS alone,
CASE WHEN line % 13 = 7 THEN 'heading' WHEN line % 17 = 4 THEN 'contents' WHEN regexp_matches(text, '[.!?]\s*$') THEN 'body' WHEN line % 19 = 1 THEN 'margin' WHEN line % 23 = 6 THEN 'footnote' WHEN x0 - 50 >= 5 THEN 'other' WHEN length(text) / 100.0 > 0.6 THEN 'body' WHEN regexp_matches(text, '^[\p{{Ll}}\p{{Nd}}]') THEN 'open' ELSE 'other' END AS later FROM p)"""


@query("p26_page_lines", rf"""{PLACED}, r AS (SELECT page, i, line, x0, y0, CASE WHEN alone = 'bullet' THEN 'bullet_1' WHEN alone IS NOT NULL THEN alone WHEN later = 'open' THEN 'other' ELSE later END AS class, CASE WHEN alone = 'bullet' THEN x0 END AS bx FROM f WHERE i = 1
UNION ALL SELECT f.page, f.i, f.line, f.x0, f.y0, CASE WHEN f.alone = 'bullet' THEN CASE WHEN f.x0 > r.bx + 10 THEN 'bullet_2' ELSE 'bullet_1' END WHEN f.alone IS NOT NULL THEN f.alone WHEN r.class IN ('body', 'bullet_1', 'bullet_2') AND abs(f.y0 - r.y0) < 22.5 AND f.x0 >= r.x0 - 5 THEN r.class
WHEN f.later = 'open' THEN CASE WHEN r.class = 'body' AND abs(f.y0 - r.y0) < 15 THEN 'body' ELSE 'other' END ELSE f.later END, CASE WHEN f.alone = 'bullet' THEN f.x0 ELSE r.bx END FROM r JOIN f ON f.page = r.page AND f.i = r.i + 1) SELECT page, line, class FROM r""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents at places of their own, some with the starts of numbered paragraphs and bullets."""
    n = F.col("line")
    start = F.when(n % 9 == 0, "1.2 ").when(n % 9 == 2, "• ").when(n % 9 == 3, "b) ").when(n % 9 == 5, "iv ").otherwise("")
    lines = _lines(spark, sf_dir).withColumn("text", F.concat(start, "text")).withColumn("x0", F.when(n % 4 == 3, 90.0).when(n % 11 == 5, 72.0).otherwise(50.0))
    rows = lines.select(
        "page", "line", "text", "x0", (F.col("y0") + F.when(n % 8 == 7, 20).otherwise(0)).alias("y0"), F.lit(50.0).alias("left"), (F.length("text") / 100).alias("rel_width"),
        F.when(n % 13 == 7, 2).otherwise(1).alias("score"), (n % 17 == 4).alias("contents"), (n % 19 == 1).alias("margin"), (n % 23 == 6).alias("footnote"),
    )
    return layout.page_line_classes(rows)


# --- words of pages ---------------------------------------------------------------------------------------------------------

WORDS = "w AS (SELECT user_id AS page, event_id, round(value * 7, 3) AS x, round(value * 7 + 3, 3) AS x_end, event_id % 40 AS y FROM events)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", "event_id", "user_id", "value")
    return events.select(F.col("user_id").alias("page"), "event_id", F.round(F.col("value") * 7, 3).alias("x"), F.round(F.col("value") * 7 + 3, 3).alias("x_end"), (F.col("event_id") % 40).alias("y"))


@query("w18_text_lines", f"""WITH {WORDS}, s AS (SELECT *, coalesce(abs(y - lag(y) OVER (PARTITION BY page ORDER BY y, x)) >= 2, true) AS step FROM w), l AS (SELECT *, sum(step::INTEGER) OVER (PARTITION BY page ORDER BY y, x ROWS UNBOUNDED PRECEDING) AS line FROM s),
g AS (SELECT *, coalesce(x - lag(x_end) OVER (PARTITION BY page, line ORDER BY x) > 40, false) AS gap FROM l) SELECT page, line::BIGINT AS line, sum(gap::INTEGER) OVER (PARTITION BY page, line ORDER BY x ROWS UNBOUNDED PRECEDING)::BIGINT AS piece, x FROM g""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in lines, and lines cut at wide gaps."""
    return windows.split_lines(windows.text_lines(_words(spark, sf_dir), 2), 40).select("page", "line", "piece", "x")


@query("w34_two_columns", f"""WITH {WORDS}, s AS (SELECT DISTINCT page, round(x) AS s FROM w), g AS (SELECT *, lead(s) OVER (PARTITION BY page ORDER BY s) - s AS gap FROM s),
c AS (SELECT page, s + gap / 2 AS cut FROM g WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page ORDER BY gap DESC, s) = 1) SELECT w.event_id, CASE WHEN x > cut THEN 1 ELSE 0 END AS "column" FROM w LEFT JOIN c USING (page)""")
def two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.two_columns(_words(spark, sf_dir)).select("event_id", "column")


@query("w15_grid", "SELECT event_id, unnest(range(greatest(100, 100), (value * 100)::BIGINT - 100 + 1, 2000)) AS at FROM events WHERE (value * 100)::BIGINT - 100 >= 100")
def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample times of each event, whose value is its length in tenths of a second."""
    times = windows.grid(F.lit(0).cast("long"), F.round(F.col("value") * 100).cast("long"), 2000, 100)
    return read(spark, sf_dir, "events", "event_id", "value").select("event_id", F.explode(times).alias("at"))


@query("w33_padded", "SELECT event_id, greatest(0, value - 2) AS start, value * 2 + 2 AS \"end\" FROM events")
def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = windows.padded(F.col("value"), F.col("value") * 2)
    return read(spark, sf_dir, "events", "event_id", "value").select("event_id", start.alias("start"), end.alias("end"))
