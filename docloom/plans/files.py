"""Scans, sinks and stores over the tables: each query writes to a folder of its own in the shared one and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.base import r6, read, shared_folder
from docloom.operators import aggregates, filters, pipelines, profile, retrieval, windows
from docloom.plans.registry import query
from docloom.sources import parse, sinks, tables


def fresh(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("s01_csv_files", "SELECT 'nation' AS file, n_name AS name, n_nationkey AS key FROM nation UNION ALL SELECT 'region', r_name, r_regionkey FROM region")
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh(spark)
    for name, key in (("nation", "n_nationkey"), ("region", "r_regionkey")):
        read(spark, sf_dir, name, f"{name[0]}_name", key).toDF("name", "key").write.csv(f"{root}/{name}.csv", header=True)
    frames = tables.csv_files(spark, [f"{root}/nation.csv", f"{root}/region.csv"])
    parts = [df.select(F.lit(name).alias("file"), "name", F.col("key").cast("int")) for name, df in sorted(frames.items())]
    return parts[0].union(parts[1])


@query("s03_french_csv", "SELECT s_suppkey, s_name || ' é' AS s_name, s_acctbal FROM supplier")
def french_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh(spark)
    rows = read(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_acctbal")
    comma = F.replace(F.col("s_acctbal").cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(","))
    rows.select("s_suppkey", F.concat("s_name", F.lit(" é")).alias("s_name"), comma.alias("s_acctbal")).write.csv(root, header=True, sep=";", encoding="ISO-8859-1")
    return tables.french_csv(spark, root, "s_suppkey long, s_name string, s_acctbal string", ["s_acctbal"])


@query("s05_folder", "SELECT n_nationkey, n_name, '2024_01' AS file_name FROM nation UNION ALL SELECT n_nationkey, n_name, '2024_02' FROM nation")
def folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder by the start and the end of their names; here Hadoop's file system gives the part files such names."""
    root, rows = fresh(spark), read(spark, sf_dir, "nation", "n_nationkey", "n_name").coalesce(1)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(f"{root}/all"))
    for name in ("2024-01.parquet", "2024-02.parquet", "2023-01.parquet"):
        rows.write.parquet(f"{root}/{name}-made")
        part = next(f.getPath() for f in system.listStatus(path(f"{root}/{name}-made")) if f.getPath().getName().startswith("part-"))
        system.rename(part, path(f"{root}/all/{name}"))
    return tables.folder(spark, f"{root}/all", ".parquet", "2024-")


@query("s08_json_lines", "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh(spark)
    sinks.write_json(read(spark, sf_dir, "nation", "n_nationkey", "n_name"), root)
    good = tables.json_lines(spark, f"{root}/part-*").where("error is null")
    return good.select(F.get_json_object("value", "$.n_nationkey").cast("long").alias("key"), F.get_json_object("value", "$.n_name").alias("name"))


@query("s24_notebook_cells", """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cell,
CASE WHEN role = 'assistant' THEN 'code' ELSE 'markdown' END AS kind, CASE WHEN role = 'assistant' THEN 'python' END AS language, text FROM conversations""")
def notebook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as notebooks, the assistant's turns as code, and their cells read again."""
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    cell = F.struct(F.when(F.col("role") == "assistant", "code").otherwise("markdown").alias("cell_type"), F.array("text").alias("source"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("turn", cell.alias("c")))), lambda x: x["c"])
    kernel = F.struct(F.struct(F.lit("python").alias("language")).alias("kernelspec"))
    books = turns.groupBy("conv_id").agg(F.to_json(F.struct(kernel.alias("metadata"), cells.alias("cells"))).alias("book"))
    return parse.parsed(books, parse.notebook_cells, "book", parse.CELLS, ("conv_id",))


@query("s31_verified_blobs", "SELECT DISTINCT sha256(text || chr(10)) AS sha256, strlen(text) + 1 AS size FROM documents WHERE doc_id % 20 = 0 AND left(sha256(text || chr(10)), 1) IN ('1', '3', '5', '7', '9')")
def verified_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth document as a file; of some files the expected hash is another one, and these aren't read."""
    root = fresh(spark)
    read(spark, sf_dir, "documents", "doc_id", "text").where("doc_id % 20 = 0").select("text").write.option("maxRecordsPerFile", 1).text(root)
    files = spark.read.format("binaryFile").load(root).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    right = F.substring("sha256", 1, 1).isin("1", "3", "5", "7", "9")
    expected = files.select("name", F.col("length").alias("size"), F.when(right, F.col("sha256")).otherwise("0").alias("sha256"))
    found = tables.blobs(spark, root, expected)
    return found.select(F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size")).distinct()


@query("k01_parquet_chunks", "SELECT doc_id, lang FROM documents")
def parquet_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh(spark)
    sinks.write_parquet(read(spark, sf_dir, "documents", "doc_id", "lang"), root, 200)
    return spark.read.parquet(root)


@query("k02_json", "SELECT n_nationkey, n_name FROM nation")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh(spark)
    sinks.write_json(read(spark, sf_dir, "nation", "n_nationkey", "n_name"), root)
    return spark.read.schema("n_nationkey int, n_name string").json(root)


@query("k03_installed", "SELECT sha256(text) AS sha256, strlen(text) AS size FROM (SELECT DISTINCT text FROM documents)")
def installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents installed twice stand in the store once."""
    root, blobs = fresh(spark), read(spark, sf_dir, "documents", "text").select(F.col("text").cast("binary").alias("content"))
    sinks.install(blobs, root)
    sinks.install(blobs, root)
    return spark.read.parquet(root).select("sha256", F.length("content").cast("long").alias("size"))


@query("k04_registered", "SELECT DISTINCT source, lang FROM documents")
def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, rows = fresh(spark), read(spark, sf_dir, "documents", "source", "lang", "doc_id")
    sinks.register(rows.where("doc_id % 2 = 0").drop("doc_id"), root, ["source", "lang"])
    sinks.register(rows.drop("doc_id"), root, ["source", "lang"])
    return spark.read.parquet(root)


@query("k05_publication", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 1")
def publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations; the one that is active is the later."""
    root, rows = fresh(spark), read(spark, sf_dir, "customer", "c_custkey", "c_name")
    sinks.build_generation(rows, root)
    sinks.build_generation(rows.where("c_custkey % 2 = 1"), root)
    return sinks.active_generation(spark, root)


@query("k14_restored", "SELECT o_orderkey, o_totalprice FROM orders")
def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh(spark)
    sinks.snapshot({"orders": read(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), "nation": read(spark, sf_dir, "nation", "n_name")}, root)
    return sinks.restored(spark, root, "orders")


@query("k17_cached", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second build, which would count nothing, isn't made."""
    root, parts = fresh(spark), read(spark, sf_dir, "part", "p_brand")
    count = lambda df: df.groupBy("p_brand").agg(F.count("*").alias("n"))
    sinks.cached(spark, root, {"a": 1, "b": [2]}, lambda: count(parts))
    return sinks.cached(spark, root, {"b": [2], "a": 1}, lambda: count(parts.limit(0)))


@query("a12_grouped_facts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def grouped_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.cell_counts(read(spark, sf_dir, "documents", "source", "lang"), ["source", "lang"])


@query("a15_match_rates", """SELECT role, 'long' AS metric, count(*) FILTER (length(text) > 200) AS numerator, count(*) AS denominator,
round(count(*) FILTER (length(text) > 200) / count(*), 6) AS rate FROM conversations GROUP BY role""")
def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "role", "text").select("role", (F.length("text") > 200).alias("long"))
    return aggregates.grid_rates(turns, ["role"], {"long": (F.col("long"), F.lit(True))}).withColumn("rate", r6(F.col("rate")))


@query("p17_url_formats", """SELECT page_id, nullif(regexp_extract(url, '[?&]v=([A-Za-z0-9_-]{6,})', 1), '') AS video FROM pages""")
def url_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.functions import text as T

    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", T.video_id(F.col("url")).alias("video"))


@query("p12_number_matches", """SELECT p_partkey, CASE WHEN regexp_matches(split_part(p_size || '_' || p_name, '_', 1), '^\\d+(\\.\\d+)*$') THEN split_part(p_size || '_' || p_name, '_', 1) END AS number FROM part""")
def number_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_name")
    return parts.select("p_partkey", filters.lecture_number(F.concat_ws("_", "p_size", "p_name")).alias("number"))


@query("w08_summary_slices", """WITH w AS (SELECT conv_id, turn, length(text) AS n, unnest(range(0, length(text), 300)) AS s, text FROM conversations)
SELECT conv_id, turn, CAST(s AS INTEGER) AS start, substring(text, s + 1, 300) AS part FROM w""")
def summary_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.char_windows(read(spark, sf_dir, "conversations", "conv_id", "turn", "text"), "text", 300, 0).select("conv_id", "turn", "start", "part")


@query("m08_absorbance", "SELECT p_partkey AS id, round(ln(1 / (p_retailprice / 10000)), 6) AS absorbance FROM part WHERE p_retailprice > 0")
def absorbance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part", "p_partkey", "p_retailprice").where("p_retailprice > 0")
    return parts.select(F.col("p_partkey").alias("id"), r6(F.element_at(profile.absorbance(F.array(F.col("p_retailprice") / 10000)), 1)).alias("absorbance"))


SCOPE = "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2')"


@query("r05_scoped_hits", SCOPE)
def scoped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are granted, asked for and in the index."""
    from docloom.operators import relational

    retrieval.check_page(10, ["src1", "src2", "src5"])
    grants = spark.createDataFrame([("src1", "me", "read"), ("src2", "me", "read"), ("src3", "me", "read"), ("src5", "me", "write")], "source string, subject string, permission string")
    docs = read(spark, sf_dir, "documents", "doc_id", "source").where(F.col("source").isin("src1", "src2", "src5"))
    return relational.visible(docs, grants, "me", "source")


@query("k13_report", """WITH m AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT '| ' || l_suppkey || ' | ' || l_returnflag || ' | ' || n || ' |' AS line FROM m UNION ALL SELECT unnest(['# Lines', '', '| l_suppkey | l_returnflag | n |', '|-|-|-|'])""")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report bundle of all suppliers' lines, written and read again."""
    root = fresh(spark)
    metrics = read(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    pipelines.write_report(metrics, f"{root}/bundle", "Lines")
    return spark.read.text(f"{root}/bundle/report").withColumnRenamed("value", "line")
