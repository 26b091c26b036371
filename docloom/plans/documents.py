"""Queries that parse documents."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.base import materialized, read
from docloom.operators import structure
from docloom.plans.registry import query
from docloom.sources import parse


@query("s12_html_blocks", """SELECT page_id, kind, count(*) AS n FROM (SELECT page_id, unnest(list_concat(list_transform(regexp_extract_all(html, '<p>'), lambda x: 'paragraph'), list_transform(regexp_extract_all(html, '<li>'), lambda x: 'list_item'),
list_transform(regexp_extract_all(html, '<h1>'), lambda x: 'heading'), list_transform(regexp_extract_all(html, '<a href'), lambda x: 'link'), list_transform(regexp_extract_all(html, '<title>'), lambda x: 'title'))) AS kind FROM pages) GROUP BY ALL""")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = parse.parsed(read(spark, sf_dir, "pages", "page_id", "html"), parse.html_blocks, "html", parse.BLOCKS, ("page_id",))
    return blocks.groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@query("s16_code_lines", "SELECT doc_id, count(*) AS lines, sum(length(l))::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split(rtrim(text, chr(10)), chr(10))) AS l FROM documents WHERE text <> '') GROUP BY doc_id")
def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parse.parsed(read(spark, sf_dir, "documents", "doc_id", "text"), parse.code_lines, "text", parse.LINES, ("doc_id",))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length(F.regexp_replace("text", "\n$", ""))).alias("chars"))


@query("s19_text_blocks", r"SELECT doc_id, count(*) AS blocks FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n{2,}')) AS b FROM documents) WHERE trim(b, chr(10) || ' ') <> '' GROUP BY doc_id")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = parse.parsed(read(spark, sf_dir, "documents", "doc_id", "text"), parse.text_blocks, "text", parse.BLOCKS, ("doc_id",))
    return blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))


@query("s20_markdown_blocks", None)
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = parse.parsed(read(spark, sf_dir, "conversations", "conv_id", "turn", "text"), parse.markdown_blocks, "text", parse.BLOCKS, ("conv_id", "turn"))
    return blocks.groupBy("conv_id", "turn", "kind").agg(F.count("*").alias("n"))


def _as_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, html): each conversation as a page of one numbered list with a list inside each turn's item.

    Every second list has a start, every third is reversed; a fourth turn sets its number, a sixth one to no number. A turn's link stands in an item of the inner
    list, in a quoted paragraph, or in the turn's item itself.
    """
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    value = F.when(F.col("turn") % 4 == 3, F.format_string(' value="%d"', F.col("turn") * 10)).when(F.col("turn") == 5, F.lit(' value="x"')).otherwise("")
    link = F.format_string('<a href="#%d">%s</a>', "turn", "role")
    inner = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<li>"), link)).when(F.col("turn") % 3 == 1, F.concat(F.lit("<li>said<blockquote><p>"), link, F.lit("</blockquote>")))
    around = F.when(F.col("turn") % 3 == 2, link).otherwise("")
    plain = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(F.lit("<li"), value, F.lit(">turn"), around, F.lit("<ul>"), F.coalesce(inner, F.lit("")), F.lit("<li>"), plain, F.lit("</ul>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))), lambda x: x["item"]), "\n")
    head = F.concat(F.lit("<ol"), F.when(F.col("conv_id") % 2 == 0, F.format_string(' start="%d"', F.col("conv_id") % 5 + 1)).otherwise(""), F.when(F.col("conv_id") % 3 == 0, " reversed").otherwise(""), F.lit(">"))
    return turns.groupBy("conv_id").agg(body.alias("body")).select("conv_id", F.concat(head, "body", F.lit("</ol>")).alias("html"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(parse.parsed(_as_html(spark, sf_dir), parse.html_nodes, "html", parse.NODES, ("conv_id",)))


@query("j14_list_contexts", r"""WITH t AS (SELECT conv_id, turn, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN conv_id % 5 + 1 WHEN conv_id % 3 = 0 THEN n ELSE 1 END AS begins, CASE WHEN turn % 4 = 3 OR turn = 5 OR i = 1 THEN i END AS mark FROM t),
m AS (SELECT *, max(mark) OVER (PARTITION BY conv_id ORDER BY i) AS at FROM s),
o AS (SELECT m.conv_id, m.i, m.turn, CASE WHEN b.turn % 4 = 3 THEN b.turn * 10 WHEN b.turn = 5 THEN NULL ELSE m.begins END + (CASE WHEN m.conv_id % 3 = 0 THEN -1 ELSE 1 END) * (m.i - m.at) AS ordinal FROM m JOIN s b ON m.conv_id = b.conv_id AND m.at = b.i)
SELECT conv_id, 1::BIGINT AS depth, true AS ordered, i::INTEGER AS item_index, ordinal::BIGINT AS ordinal, NULL::INTEGER AS parent_index, 'turn' AS text FROM o
UNION ALL SELECT conv_id, 2, false, unnest(CASE WHEN turn % 3 = 2 THEN [1] ELSE [1, 2] END)::INTEGER, NULL, i::INTEGER, unnest(CASE turn % 3 WHEN 0 THEN ['', p] WHEN 1 THEN ['said', p] ELSE [p] END)
FROM (SELECT o.*, trim(regexp_replace(text, '[\s]+', ' ', 'g')) AS p FROM o JOIN conversations USING (conv_id, turn))""")
def list_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    found = materialized(structure.list_contexts(nodes, "conv_id"))
    parents = found.select("conv_id", F.col("pre").alias("parent"), F.col("item_index").alias("parent_index"))
    placed = found.join(parents, ["conv_id", "parent"], "left").join(nodes.select("conv_id", "pre", "text"), ["conv_id", "pre"])
    return placed.select("conv_id", "depth", "ordered", "item_index", "ordinal", "parent_index", "text")


@query("j13_nearest_block", "SELECT conv_id, turn, CASE turn % 3 WHEN 1 THEN 'p' ELSE 'li' END AS owner, CASE turn % 3 WHEN 2 THEN 'turn' ELSE '' END AS text, CASE turn % 3 WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 2 END::BIGINT AS around FROM conversations")
def nearest_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost block around each link, its own text, and how many elements surround the link."""
    nodes = _nodes(spark, sf_dir)
    links = nodes.where("href IS NOT NULL")
    blocks = nodes.where(F.col("tag").isin("li", "p", "blockquote", "td", "h1", "h2", "h3"))
    owners = structure.nearest(links, blocks, "conv_id")
    depth = structure.ancestors(links, nodes, "conv_id").groupBy("conv_id", "pre").agg(F.count("*").alias("around"))
    turns = links.select("conv_id", "pre", F.substring("href", 2, 9).cast("long").alias("turn"))
    own = nodes.select("conv_id", F.col("pre").alias("owner"), "text")
    found = turns.join(owners, ["conv_id", "pre"]).join(depth, ["conv_id", "pre"]).join(own, ["conv_id", "owner"])
    return found.select("conv_id", "turn", F.col("tag").alias("owner"), "text", "around")


def _order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, html): each order as a page: its status and priority as headings, its lines as a table, a quote, and code in two forms."""
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag").repartition("l_orderkey")  # lines move as they are, not as collected rows

    def row(line: Column) -> Column:
        part, quantity = (F.coalesce(c.cast("string"), F.lit("null")) for c in (line["l_partkey"], line["l_quantity"].cast("int")))
        return F.concat(F.lit("<tr><td>"), part, F.lit("<td>"), quantity, F.lit("</td><td><b>"), line["flag"])

    flag = F.concat(F.coalesce("l_returnflag", F.lit("null")), F.lit("</b> &amp; more")).alias("flag")
    held = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", flag)))
    tables = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(held, row), "").alias("rows"))
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").join(tables, "o_orderkey")
    head = F.concat(F.lit("<!DOCTYPE html><title>Order</title><h1>Order "), "o_orderkey", F.lit("</h1><h3>"), "o_orderpriority", F.lit("</h3><table><thead><tr><th>part<th>quantity<th>flag</thead>"))
    tail = F.concat(F.lit("</table><blockquote>of "), "o_orderstatus", F.lit("</blockquote><pre><code class='language-sql'>SELECT\n  "), "o_orderkey", F.lit("</code></pre><p>see <code>x</code> and"))
    return orders.select("o_orderkey", F.concat(head, "rows", tail).alias("html"))


@query("s12_tables", """SELECT l_orderkey AS o_orderkey, r::INTEGER AS "row", unnest([0, 1, 2])::INTEGER AS "column", false AS header, unnest([l_partkey::VARCHAR, l_quantity::INTEGER::VARCHAR, '& more']) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS r FROM lineitem) WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT o_orderkey, 0, unnest([0, 1, 2])::INTEGER, true, unnest(['part', 'quantity', 'flag']) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = parse.table_cells(_order_pages(spark, sf_dir), "html", ("o_orderkey",))
    return cells.select("o_orderkey", "row", "column", "header", "text")


@query("s12_typed_blocks", """SELECT o_orderkey, unnest(['title', 'heading', 'heading', 'quote', 'code', 'paragraph']) AS kind, unnest([0, 1, 3, 0, 0, 0])::BIGINT AS level, unnest(['Order', 'Order ' || o_orderkey, o_orderpriority, 'of ' || o_orderstatus, 'SELECT' || chr(10) || '  ' || o_orderkey, 'see x and']) AS text FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def typed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, headings with their level, quotes, code with its line ends, and paragraphs, of pages that have all of them."""

    def typed(page: str) -> Iterator[tuple]:
        return ((kind, level, text) for _, kind, level, _, text, _ in parse.html_blocks(page) if kind != "cell")

    return parse.parsed(_order_pages(spark, sf_dir), typed, "html", "kind string, level long, text string", ("o_orderkey",))
