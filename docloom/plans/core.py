"""Queries of the relational kernel: joins, aggregates, windows, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.base import micros, r6, read
from docloom.operators import aggregates, folds, relational, windows
from docloom.plans.registry import query

DAY = "CAST(epoch_us(ts) // 86400000000 AS BIGINT)"
#: Grants of the access-control query: sources that the subject may read.
GRANTS = (("src0", "reader", "read"), ("src3", "reader", "read"), ("src7", "reader", "write"), ("src9", "other", "read"))


@query("s06_pruned_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'")
def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return lines.where("l_shipdate >= timestamp'1998-01-01' and l_shipdate < timestamp'1999-01-01'").drop("l_shipdate")


@query("j01_nway_join", """SELECT n_name, o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def nway_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_totalprice").withColumnRenamed("o_custkey", "custkey")
    customers = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey").withColumnRenamed("c_custkey", "custkey")
    nations = read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    joined = relational.join_all([orders, customers], ["custkey"]).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j02_merge_on_key", "SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)")
def merge_on_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.natural_join([read(spark, sf_dir, "documents", "doc_id", "lang", "source"), read(spark, sf_dir, "labels")])


@query("j05_acl_semi", "SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src3')")
def acl_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    grants = spark.createDataFrame(GRANTS, "source string, subject string, permission string")
    return relational.visible(read(spark, sf_dir, "documents", "doc_id", "source"), grants, "reader", "source")


@query("j06_quarantine_anti", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def quarantine_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.without(read(spark, sf_dir, "documents", "doc_id", "lang"), read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("j07_interval_overlap", """WITH i AS (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + 900000000 AS e FROM events)
SELECT a.event_id, count(*) AS overlaps FROM i a JOIN i b ON a.user_id = b.user_id AND a.s <= b.e AND b.s <= a.e AND a.event_id <> b.event_id GROUP BY a.event_id""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", "event_id", "user_id", "ts").withColumn("start", micros("ts")).withColumn("end", micros("ts") + 900_000_000).drop("ts")
    pairs = relational.interval_join(events, events, ["user_id"], 900_000_000).where("event_id <> r_event_id")
    return pairs.groupBy("event_id").agg(F.count("*").alias("overlaps"))


@query("j15_containment", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").withColumnRenamed("text", "passage")
    return relational.contained(items, read(spark, sf_dir, "documents", "doc_id", "text"), "passage", "text", "item_id", "doc_id")


@query("a01_cell_period_count", f"SELECT event_type, {DAY} AS day, count(*) AS n FROM events GROUP BY ALL")
def cell_period_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", "event_type", "ts").withColumn("day", F.floor(micros("ts") / 86_400_000_000))
    return aggregates.cell_counts(events, ["event_type", "day"])


@query("a02_state_histogram", """SELECT *, CASE WHEN n_P > 0 THEN 'pending' WHEN n_O > 0 THEN 'open' ELSE 'filled' END AS state FROM (
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'P') AS n_P FROM orders GROUP BY o_custkey)""")
def state_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = aggregates.state_histogram(read(spark, sf_dir, "orders", "o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus", ["F", "O", "P"])
    return counts.withColumn("state", aggregates.ladder([("n_P", "pending"), ("n_O", "open")], "filled"))


@query("a04_exact_groups", """WITH g AS (SELECT trim(text) AS t, lang, count(*) AS n, min(doc_id) AS first, min(doc_id) FILTER (n_chars = m) AS representative
FROM (SELECT *, max(n_chars) OVER (PARTITION BY trim(text), lang) AS m FROM documents) GROUP BY trim(text), lang)
SELECT lang, n, first, representative, printf('KS%04d', row_number() OVER (ORDER BY first)) AS group_id, sha256(t) AS text_sha FROM g""")
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "n_chars").withColumn("text_sha", F.sha2(F.trim("text"), 256)).drop("text")
    return aggregates.exact_groups(docs, ["text_sha", "lang"], "doc_id", F.col("n_chars"))


FACT_KEY = "rtrim(regexp_replace(trim(lower(line)), '\\s+', ' ', 'g'), '.;:')"


@query("a11_fact_dedup", f"""WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT *, {FACT_KEY} AS fact FROM lines) SELECT sha256(fact) AS fact_sha, min(doc_id) AS first, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM k WHERE fact <> '' GROUP BY fact""")
def fact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents", "doc_id", "source", "text").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line"))
    fact = F.rtrim(F.regexp_replace(F.trim(F.lower("line")), r"\s+", " "), F.lit(".;:"))
    facts = lines.withColumn("fact", fact).where("fact <> ''").withColumn("fact_sha", F.sha2("fact", 256))
    return aggregates.fact_dedup(facts, ["fact_sha"], "source", "doc_id", "fact").select("fact_sha", "first", F.array_join("sources", ",").alias("sources"))


@query("a13_claims", """WITH s AS (SELECT lang, quality, list_sort(list_distinct(list(source))) AS all_s FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality),
p AS (SELECT *, unnest(range(0, (len(all_s) - 1) // 8 + 1)) AS part FROM s) SELECT lang, quality, CAST(part AS INTEGER) AS part, array_to_string(all_s[part * 8 + 1 : part * 8 + 8], ',') AS sources FROM p""")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "lang", "source").join(read(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id")
    return aggregates.merged_values(docs, ["lang", "quality"], "source", 8).withColumn("sources", F.array_join("values", ",")).drop("values")


@query("a14_quality_report", """SELECT lang, count(*) AS n, count(*) FILTER (trim(text) = '') AS blank, count(*) FILTER (n_chars < 100) AS short, count(*) - count(DISTINCT text) AS excess,
round(avg(quality), 6) AS quality, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    docs = docs.withColumn("key", F.sha2("text", 256)).withColumn("is_blank", F.trim("text") == "")
    return docs.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if("is_blank").alias("blank"), F.count_if(F.col("n_chars") < 100).alias("short"),
        aggregates.duplicate_excess(["key"]).alias("excess"), r6(F.avg("quality")).alias("quality"), F.count_if(F.col("toxic") == 1).alias("toxic"),
    )


BOUNDS = (1.0, 5.0, 15.0, 60.0, 300.0, 900.0, 1800.0, 3600.0)


@query("a19_cumulative_histogram", "SELECT event_type, le, count(*) FILTER (value <= b) AS n FROM events, (VALUES ('1', 1.0), ('5', 5), ('15', 15), ('60', 60), ('300', 300), ('900', 900), ('1800', 1800), ('3600', 3600), ('+Inf', 'inf'::double)) t(le, b) GROUP BY event_type, le")
def cumulative_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.cumulative_histogram(read(spark, sf_dir, "events", "event_type", "value"), ["event_type"], "value", BOUNDS)


@query("a20_histogram_audit", "SELECT event_type, true AS monotonic, true AS closed FROM events GROUP BY event_type")
def histogram_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", "event_type", "value")
    buckets = aggregates.cumulative_histogram(events, ["event_type"], "value", BOUNDS)
    place = F.when(F.col("le") == "+Inf", float("inf")).otherwise(F.expr("try_cast(le as double)"))
    counted = buckets.withColumn("place", place).join(events.groupBy("event_type").agg(F.count("value").alias("total")), "event_type")
    return aggregates.histogram_audit(counted, ["event_type"], "place", "total")


TREE = f"""n0 AS (SELECT c_nationkey AS k, c_custkey AS pos, sha256(c_name || '|' || c_mktsegment) AS d, 1 AS n FROM customer),
{", ".join(f"n{i + 1} AS (SELECT k, pos // 1024 AS pos, sha256(string_agg(pos || ':' || d, ';' ORDER BY pos, d)) AS d, sum(n) AS n FROM n{i} GROUP BY k, pos // 1024)" for i in range(aggregates.NODE_LEVELS))}"""


@query("a21_digest", f"WITH {TREE} SELECT k AS c_nationkey, sha256(string_agg(pos || ':' || d, ';' ORDER BY pos, d)) AS digest, sum(n)::BIGINT AS n FROM n{aggregates.NODE_LEVELS} GROUP BY k")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.digest(read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey"), ["c_nationkey"], "c_custkey", F.concat_ws("|", "c_name", "c_mktsegment"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("a22_inventory", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.inventory({t: read(spark, sf_dir, t) for t in TABLES})


@query("a23_totals", "SELECT count(*) AS n, coalesce(sum(n_chars), 0)::BIGINT AS size FROM documents")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.totals(read(spark, sf_dir, "documents", "n_chars"), "n_chars")


@query("a26_conflicts", "SELECT p_brand, 'p_type' AS conflicting FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1 AND count(DISTINCT left(p_brand, 5)) <= 1")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part", "p_brand", "p_type").withColumn("maker", F.substring("p_brand", 1, 5))
    return aggregates.conflicts(parts, "p_brand", ["p_type", "maker"]).withColumn("conflicting", F.array_join("conflicting", ","))


@query("a31_statistics", "SELECT event_type, count(value) AS n, min(value) AS min, median(value) AS median, round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY event_type")
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.statistics(read(spark, sf_dir, "events", "event_type", "value"), ["event_type"], "value").withColumn("mean", r6(F.col("mean")))


@query("a30_budget", """SELECT conv_id, turn, spent::BIGINT AS spent, spent > 2000 AS over FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spent FROM conversations)""")
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.length("text").cast("long").alias("cost"))
    return aggregates.running_budget(turns, ["conv_id"], "turn", "cost", 2000).drop("cost")


@query("a16_grid_rates", """WITH d AS (SELECT lang, quality, toxic FROM documents JOIN labels USING (doc_id)) SELECT lang, 'good' AS metric, count(*) FILTER (quality = 1) AS numerator, count(*) AS denominator, round(count(*) FILTER (quality = 1) / count(*), 6) AS rate FROM d GROUP BY lang
UNION ALL SELECT lang, 'toxic_good', count(*) FILTER (quality = 1 AND toxic = 1), count(*) FILTER (quality = 1), round(CASE WHEN count(*) FILTER (quality = 1) > 0 THEN count(*) FILTER (quality = 1 AND toxic = 1) / count(*) FILTER (quality = 1) END, 6) FROM d GROUP BY lang""")
def grid_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return aggregates.grid_rates(docs, ["lang"], {"good": (good, F.lit(True)), "toxic_good": (good & toxic, good)}).withColumn("rate", r6(F.col("rate")))


@query("d03_duplicate_ratio", "SELECT count(*) AS n, count(*) - count(DISTINCT (text, lang)) AS excess, round((count(*) - count(DISTINCT (text, lang))) / count(*), 6) AS ratio FROM documents")
def duplicate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "text", "lang").select(F.sha2("text", 256).alias("t"), "lang")
    return docs.agg(F.count("*").alias("n"), aggregates.duplicate_excess(["t", "lang"]).alias("excess")).withColumn("ratio", r6(F.col("excess") / F.col("n")))


@query("d04_complete_grid", f"""WITH c AS (SELECT user_id, {DAY} AS day, count(*) AS n FROM events GROUP BY ALL), a AS (SELECT user_id FROM c GROUP BY user_id HAVING sum(n) >= 5)
SELECT user_id, day, coalesce(n, 0) AS n FROM (SELECT user_id, day FROM a, (SELECT DISTINCT day FROM c)) LEFT JOIN c USING (user_id, day)""")
def complete_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", "user_id", "ts").withColumn("day", F.floor(micros("ts") / 86_400_000_000))
    return relational.complete_grid(aggregates.cell_counts(events, ["user_id", "day"]), "user_id", "day", "n", 5)


@query("d05_unpivot", "UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME variable VALUE value")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ["l_quantity", "l_extendedprice", "l_discount"]
    return relational.long_form(read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", *values), ["l_orderkey", "l_linenumber"], values)


@query("d06_symmetric_difference", """(SELECT c_nationkey AS nation, 'left' AS side FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)) UNION ALL
SELECT s_nationkey, 'right' FROM (SELECT s_nationkey FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)""")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "customer", "c_nationkey").withColumnRenamed("c_nationkey", "nation")
    return relational.sets_differ(left, read(spark, sf_dir, "supplier", "s_nationkey").withColumnRenamed("s_nationkey", "nation"))


@query("d07_containment_gate", """SELECT conv_id, count(*) FILTER (role NOT IN ('user', 'assistant')) = 0 AS plain FROM conversations GROUP BY conv_id""")
def containment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = read(spark, sf_dir, "conversations", "conv_id", "role").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return roles.withColumn("whole", F.array(F.lit("user"), F.lit("assistant"))).select("conv_id", relational.all_in("roles", "whole").alias("plain"))


@query("w02_neighbour_context", """SELECT conv_id, turn, array_to_string(CASE WHEN len(p) < 3 THEN p ELSE p[-3:] END, chr(10)) AS before, array_to_string(n[1:3], chr(10)) AS after FROM (
SELECT conv_id, turn, string_split(lag(text) OVER w, chr(10)) AS p, string_split(lead(text) OVER w, chr(10)) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.neighbours(read(spark, sf_dir, "conversations", "conv_id", "turn", "text"), ["conv_id"], "turn", "text").drop("text")


@query("w05_overlap_windows", """WITH w AS (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 1872)) AS s, text FROM documents)
SELECT doc_id, CAST(s // 1872 AS INTEGER) AS win, CAST(s AS INTEGER) AS start, CAST(least(s + 2000, n) AS INTEGER) AS "end", sha256(substring(text, s + 1, 2000)) AS sha FROM w WHERE s = 0 OR s + 128 < n""")
def overlap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.char_windows(read(spark, sf_dir, "documents", "doc_id", "text"), "text", 2000, 128).where("not blank")
    return found.select("doc_id", F.col("window").alias("win"), "start", "end", F.sha2("part", 256).alias("sha"))


@query("w07_char_windows", """WITH w AS (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 2000)) AS s, text FROM documents)
SELECT doc_id, CAST(s // 2000 AS INTEGER) AS win, CAST(s AS INTEGER) AS start, CAST(least(s + 2000, n) AS INTEGER) AS "end", sha256(substring(text, s + 1, 2000)) AS sha FROM w""")
def char_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.char_windows(read(spark, sf_dir, "documents", "doc_id", "text"), "text")
    return found.select("doc_id", F.col("window").alias("win"), "start", "end", F.sha2("part", 256).alias("sha"))


def _islands(gap: int) -> str:
    return f"""WITH i AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 600000000 AS e, event_id FROM events),
r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
m AS (SELECT *, sum(CASE WHEN s <= reach + {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT user_id, island::BIGINT AS island, min(s) AS start, max(e) AS "end", count(*) AS n FROM m GROUP BY user_id, island"""


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", "event_id", "user_id", "ts")
    return events.withColumn("start", micros("ts")).withColumn("end", micros("ts") + 600_000_000).drop("ts")


@query("w11_merge_windows", _islands(2_000_000))
def merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.islands(_intervals(spark, sf_dir), ["user_id"], 2_000_000, "event_id").withColumn("island", F.col("island").cast("long"))


@query("w06_adjacent_merge", _islands(900_000_000))
def adjacent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.islands(_intervals(spark, sf_dir), ["user_id"], 900_000_000, "event_id").withColumn("island", F.col("island").cast("long"))


@query("w13_frame_batches", "WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), b AS (SELECT user_id, n, unnest(range(0, n, 12)) AS start FROM u) SELECT user_id, start, least(start + 16, n) AS stop FROM b WHERE start = 0 OR start + 4 < n")
def frame_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "events", "user_id").groupBy("user_id").agg(F.count("*").alias("n"))
    starts = users.select("user_id", "n", F.explode(windows.batches(16, 4, F.col("n"))).alias("start"))
    return starts.select("user_id", "start", F.least(F.col("start") + 16, "n").alias("stop"))


@query("w17_inherit_block", """SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'system' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING),
first_value(CASE WHEN role = 'system' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS block FROM conversations""")
def inherit_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    value = F.when(F.col("role") == "system", F.col("turn"))
    return turns.select("conv_id", "turn", windows.inherited(turns, ["conv_id"], "turn", value).alias("block"))


@query("w22_levels", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY floor(p_retailprice) DESC)::INTEGER AS level FROM part")
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.levels(read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_retailprice"), ["p_brand"], "p_retailprice").select("p_partkey", "level")


@query("w23_order_audit", """SELECT conv_id, count(*) FILTER (back) AS steps_back, bool_and(rn - 1 = turn) AS dense FROM (SELECT conv_id, turn, coalesce(lag(length(text)) OVER w > length(text), false) AS back, row_number() OVER w AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id""")
def order_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("page", F.length("text")).drop("text")
    return windows.order_audit(turns, ["conv_id"], "turn", "page")


@query("w24_coverage_audit", "SELECT doc_id, CAST((length(text) + 1999) // 2000 AS BIGINT) AS windows, true AS complete FROM documents WHERE length(text) > 0")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    return windows.coverage_audit(windows.char_windows(docs, "text").select("doc_id", "n_chars", "start", "end"), "doc_id", "n_chars")


@query("w25_hash_chain", """WITH d AS (SELECT user_id, event_id, sha256(event_id || '|' || event_type) AS digest FROM events), l AS (SELECT *, lag(digest) OVER (PARTITION BY user_id ORDER BY event_id) AS link FROM d),
p AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'lost' ELSE link END AS previous FROM l)
SELECT event_id, previous IS DISTINCT FROM link AS broken_link, NOT coalesce(event_id = lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) + 1, true) AS gap FROM p""")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").withColumn("digest", F.sha2(F.concat_ws("|", "event_id", "event_type"), 256))
    link = F.lag("digest").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = rows.withColumn("previous", F.when(F.col("event_id") % 97 == 0, "lost").otherwise(link))
    return windows.chain_audit(rows, "event_id", "digest", "previous", ["user_id"]).select("event_id", "broken_link", "gap")


@query("w26_latest_head", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", "user_id", "event_id", "event_type", "value", "ts")
    return relational.first_per_key(events, ["user_id"], F.desc("ts"), F.desc("event_id")).drop("ts")


@query("w27_sequential_ids", "SELECT o_orderkey, printf('fact_%04d', row_number() OVER (ORDER BY o_orderdate, o_orderkey)) AS fact_id FROM orders")
def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.functions.base import numbered

    orders = numbered(read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")
    return orders.select("o_orderkey", F.format_string("fact_%04d", "number").alias("fact_id"))


@query("w28_review_windows", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM r WHERE n <= 8 OR i IN (0, (n-1)//7, 2*(n-1)//7, 3*(n-1)//7, 4*(n-1)//7, 5*(n-1)//7, 6*(n-1)//7, n-1)""")
def review_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.evenly_spaced(read(spark, sf_dir, "events", "user_id", "event_id"), ["user_id"], 8, "event_id")


@query("w29_repeated", "SELECT line, count(DISTINCT doc_id) AS pages FROM (SELECT doc_id, sha256(unnest(string_split(text, chr(10)))) AS line FROM documents) GROUP BY line HAVING count(DISTINCT doc_id) > 1")
def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("t")).select("doc_id", F.sha2("t", 256).alias("line"))
    return windows.repeated(lines, ["line"], "doc_id")


@query("w30_reciprocal_rank", "SELECT l_orderkey, l_linenumber, round(1 / (60 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey)), 9) AS rrf FROM lineitem")
def reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey")
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    return lines.select("l_orderkey", "l_linenumber", F.round(1 / (60 + F.row_number().over(by)), 9).alias("rrf"))


@query("w32_batch_plan", "SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS BIGINT) AS batch FROM conversations")
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.fixed_batches(read(spark, sf_dir, "conversations", "conv_id", "turn"), ["conv_id"], 3, "turn")


@query("w10_window_times", """WITH c AS (SELECT conv_id, turn, length(text) AS n FROM conversations), s AS (SELECT *, sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS e FROM c),
w AS (SELECT conv_id, unnest(range(0, max(e)::BIGINT, 1000)) AS start FROM s GROUP BY conv_id)
SELECT w.conv_id, w.start, min(s.turn) AS from_time, max(s.turn) AS to_time FROM w JOIN s ON w.conv_id = s.conv_id AND w.start < s.e AND s.e - s.n < w.start + 1000 GROUP BY w.conv_id, w.start""")
def window_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = windows.cue_spans(read(spark, sf_dir, "conversations", "conv_id", "turn", "text"), ["conv_id"], "turn", "text").drop("text")
    spans = cues.select("conv_id", "span_start", "span_end", F.col("turn").alias("cue_start"), F.col("turn").alias("cue_end"))
    ends = cues.groupBy("conv_id").agg(F.max("span_end").alias("n"))
    starts = ends.select("conv_id", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(1000).cast("long")))).alias("start"))
    return windows.window_times(starts.withColumn("end", F.col("start") + 1000), spans, "conv_id").drop("end")


FOLD_TURNS = "SELECT conv_id, turn, length(text) / 15.0 AS d FROM conversations"


@query("w01_timed_chunks", """WITH RECURSIVE s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e, length(text) AS n FROM conversations),
f AS (SELECT conv_id, i, turn, (e - n) AS a, i AS first_i, e - n AS t0, e - (e - n) >= 600 AS emit, 0 AS chunk, e FROM s WHERE i = 1
UNION ALL SELECT s.conv_id, s.i, s.turn, s.e - s.n, CASE WHEN f.emit THEN s.i - 1 ELSE f.first_i END,
 CASE WHEN f.emit THEN f.a ELSE f.t0 END, s.e - CASE WHEN f.emit THEN f.a ELSE f.t0 END >= 600, f.chunk + CASE WHEN f.emit THEN 1 ELSE 0 END, s.e FROM f JOIN s ON s.conv_id = f.conv_id AND s.i = f.i + 1),
x AS (SELECT *, max(i) OVER (PARTITION BY conv_id) AS m FROM f)
SELECT x.conv_id, x.chunk::BIGINT AS chunk, o.turn AS first_seg, x.turn AS last_seg, (x.i - x.first_i + 1)::BIGINT AS n_segments FROM x JOIN s o ON o.conv_id = x.conv_id AND o.i = x.first_i WHERE x.emit OR x.i = x.m""")
def timed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("n", F.length("text"))
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    segments = turns.withColumn("end", F.sum("n").over(by)).select("conv_id", F.col("turn").alias("seg_id"), (F.col("end") - F.col("n")).alias("start"), "end")
    return folds.timed_chunks(segments, "conv_id", 600, 1)


@query("w14_bounded_batches", """WITH RECURSIVE s AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, event_id, i, t AS t0, 1 AS n, 0 AS batch FROM s WHERE i = 1 UNION ALL
SELECT s.user_id, s.event_id, s.i, CASE WHEN f.n >= 16 OR s.t - f.t0 > 21600000000 THEN s.t ELSE f.t0 END, CASE WHEN f.n >= 16 OR s.t - f.t0 > 21600000000 THEN 1 ELSE f.n + 1 END,
f.batch + CASE WHEN f.n >= 16 OR s.t - f.t0 > 21600000000 THEN 1 ELSE 0 END FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1) SELECT user_id, event_id AS id, batch::BIGINT AS batch FROM f""")
def bounded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", "user_id", "event_id", "ts").select("user_id", F.col("event_id").alias("id"), micros("ts").alias("at"))
    return folds.bounded_batches(events, "user_id", ["at", "id"], 16, 21_600_000_000)


@query("l01_top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(25)


@query("l04_keyset_page", "SELECT o_orderkey, epoch_us(o_orderdate) AS at FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1996-06-01', 100) ORDER BY o_orderdate, o_orderkey LIMIT 51")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(micros("o_orderdate").alias("at"), "o_orderkey")
    return relational.keyset_page(orders, ["at", "o_orderkey"], (833_587_200_000_000, 100), 50)


@query("l09_best_or_ambiguous", """WITH t AS (SELECT *, min(p_size) OVER (PARTITION BY p_brand) AS m FROM part) SELECT p_brand, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS p_type, count(DISTINCT p_type) > 1 AS ambiguous, m AS p_size FROM t WHERE p_size = m GROUP BY p_brand, m""")
def best_or_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.best_or_none(read(spark, sf_dir, "part", "p_brand", "p_size", "p_type"), "p_brand", "p_size", "p_type")


@query("l11_log_tail", "SELECT event_id, event_type FROM events WHERE event_id > 500 AND contains(event_type, 'ur') ORDER BY event_id LIMIT 100")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", "event_id", "event_type").where((F.col("event_id") > 500) & F.contains("event_type", F.lit("ur")))
    return events.orderBy("event_id").limit(100)


@query("l12_text_window", "SELECT doc_id, sha256(substring(text, 101, 400)) AS part FROM documents")
def text_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2(F.substring("text", 101, 400), 256).alias("part"))


@query("t01_job_states", """WITH RECURSIVE t AS (SELECT user_id, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'new' AS state, 0::BIGINT AS taken FROM t UNION ALL SELECT t.user_id, t.i, CASE WHEN ok THEN t.e ELSE r.state END, r.taken + ok::BIGINT
FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i + 1, LATERAL (SELECT list_contains(['new signup', 'new view', 'signup view', 'signup click', 'view click', 'view purchase', 'click purchase', 'click view', 'click error'], r.state || ' ' || t.e) AS ok))
SELECT user_id, arg_max(state, i) AS state, max(taken) AS taken, max(i) - max(taken) AS refused FROM r GROUP BY user_id""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = {"new": ("signup", "view"), "signup": ("view", "click"), "view": ("click", "purchase"), "click": ("purchase", "view", "error")}
    events = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").withColumnsRenamed({"event_id": "seq", "event_type": "state"})
    return folds.job_states(events, "user_id", moves, "new", ("purchase", "error"))


@query("j18_supporting_chunks", "SELECT f.l_orderkey, count(DISTINCT o_orderkey) AS known, count(DISTINCT CASE WHEN o_orderkey IS NULL THEN l_partkey END) AS unknown FROM lineitem f LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON f.l_orderkey = o.o_orderkey GROUP BY f.l_orderkey")
def supporting_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus <> 'P'")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left")
    return joined.groupBy("l_orderkey").agg(F.count_distinct("o_orderkey").alias("known"), F.count_distinct(F.when(F.col("o_orderkey").isNull(), F.col("l_partkey"))).alias("unknown"))
