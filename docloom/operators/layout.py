"""Words, lines and paths of laid-out pages: boxes, overlaps, groups, paragraphs, line classes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.base import materialized
from docloom.operators.folds import fold
from docloom.operators.relational import dyadic_pairs


def line_boxes(words: DataFrame) -> DataFrame:
    """The box of each line (page, line), its median height, and its place on the page from 0 to 1."""
    lines = words.groupBy("page", "line").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.median(F.col("y1") - F.col("y0")).alias("height"), F.count("*").alias("words"),
    )
    page = Window.partitionBy("page")
    low, high = F.min("y0").over(page), F.max("y1").over(page)
    return lines.withColumn("place", F.when(high > low, (F.col("y0") - low) / (high - low)).otherwise(0.0))


BOX = [("x0", "x1"), ("y0", "y1")]


def best_overlap(boxes: DataFrame, others: DataFrame, key: str, other: str, cell: float = 128.0) -> DataFrame:
    """For each box of a page the other source's box that it overlaps most, ties to the smaller id; they meet in cells of a grid, large ones
    in large cells."""
    b = others.select("page", F.col(other).alias("id"), "x0", "y0", "x1", "y1")
    width = F.least("x1", "r_x1") - F.greatest("x0", "r_x0")
    height = F.least("y1", "r_y1") - F.greatest("y0", "r_y0")
    pairs = dyadic_pairs(boxes.select("page", key, "x0", "y0", "x1", "y1"), b, ["page"], BOX, cell).where((width > 0) & (height > 0))
    found = pairs.withColumn("area", width * height).groupBy("page", key).agg(F.max_by(F.struct("r_id", "area"), F.struct("area", -F.col("r_id"))).alias("_best"))
    return found.select(key, F.col("_best.r_id").alias(other), "_best.area")


def near_groups(paths: DataFrame, gap: float) -> DataFrame:
    """(page, path_id, group): boxes of a page that come within `gap` of one another, directly or through others. A background stands alone.

    Boxes that begin in one small cell are all near one another, so a cell is one node. Whether two cells hold a near pair is told by the boxes at their corners
    (`_corners`), which are all that meet; labels of cells move along these pairs, and through the label's own label, until none changes.
    """
    near = paths.where(~F.col("background")).select("page", "path_id", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    side, place = gap / 2, lambda c: F.floor(F.col(c) / side).cast("double") if gap > 0 else F.col(c)
    sound = F.coalesce((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")) & ~F.isnan("x0") & ~F.isnan("y0") & F.lit(gap >= 0), F.lit(False))
    placed = near.withColumn("_x", F.when(sound, place("x0"))).withColumn("_y", F.when(sound, place("y0")))
    cell = F.min("path_id").over(Window.partitionBy("page", "_x", "_y"))
    held = placed.withColumn("_cell", F.when(F.col("_x").isNull(), F.col("path_id")).otherwise(cell))
    held = materialized(held.withColumn("_first", F.min("_cell").over(Window.partitionBy("page", "path_id"))))
    boxes, odd = held.select("page", "_cell", "x0", "y0", "x1", "y1"), held.where("_x IS NULL").select("page", "_cell", "x0", "y0", "x1", "y1")
    grown = lambda rows: rows.select("page", "_cell", *((F.col(c) + d).alias(c) for c, d in (("x0", -gap), ("y0", -gap), ("x1", gap), ("y1", gap))))
    meet = lambda left, right: dyadic_pairs(grown(left), right, ["page"], BOX, max(gap, 1.0) * 16).select("page", "_cell", "r__cell")
    ends = _corners(held.where("_x IS NOT NULL"))
    same = held.where("_first <> _cell").select("page", "_cell", F.col("_first").alias("r__cell"))  # boxes of one id
    pairs = meet(ends, ends).unionByName(same).unionByName(same.select("page", F.col("r__cell").alias("_cell"), F.col("_cell").alias("r__cell")))
    if not odd.isEmpty():  # boxes that end before they begin, and gaps below 0, go by pairs
        pairs = pairs.unionByName(meet(odd, boxes)).unionByName(meet(boxes, odd))
    edges = materialized(pairs.select("page", "_cell", F.col("r__cell").alias("_id")).distinct())
    labels = materialized(edges.groupBy("page", "_cell").agg(F.min("_id").alias("group")))
    while True:
        heard = edges.join(labels.select("page", F.col("_cell").alias("_id"), "group"), ["page", "_id"]).groupBy("page", "_cell").agg(F.min("group").alias("heard"))
        step = labels.join(heard, ["page", "_cell"]).select("page", "_cell", F.col("group").alias("old"), F.least("group", "heard").alias("group"))
        up = step.select("page", F.col("_cell").alias("group"), F.col("group").alias("top"))
        step = materialized(step.join(up, ["page", "group"]).select("page", "_cell", "old", F.col("top").alias("group")))
        labels = step.select("page", "_cell", "group")
        if step.where("group <> old").isEmpty():
            alone = paths.where("background").select("page", "path_id", F.col("path_id").alias("group"))
            return held.select("page", "path_id", "_cell").join(labels, ["page", "_cell"]).select("page", "path_id", "group").distinct().union(alone)


def _corners(boxes: DataFrame) -> DataFrame:
    """The boxes of each cell that none other of it goes beyond toward some corner; of equal boxes one.

    Two boxes of different cells are ordered by where their cells lie, so on an axis only one of the two bounds counts: the end of the first against the beginning of the second.
    If any pair of two cells is near, so is the pair of those that go farthest toward one another.
    """
    different = boxes.groupBy("page", "_cell", "_x", "_y", "x0", "y0", "x1", "y1").agg(F.count("*").alias("_n"))
    kept = F.lit(False)
    for x in ("x0", "-x1"):
        for y in ("y0", "-y1"):
            best = f"_{x}{y}"
            before = Window.partitionBy("page", "_x", "_y").orderBy(F.expr(x), F.expr(y)).rowsBetween(Window.unboundedPreceding, -1)
            different = different.withColumn(best, F.min(F.expr(y)).over(before))
            kept = kept | F.col(f"`{best}`").isNull() | (F.expr(y) < F.col(f"`{best}`"))
    return different.where(kept).select("page", "_cell", "x0", "y0", "x1", "y1")


def paragraphs(lines: DataFrame, tolerance: float) -> DataFrame:
    """Lines (page, line, text, y0, y1) with the paragraph that they belong to.

    A line goes on with the one before if that ends in a hyphen or without a sentence end, or if the gap is small; a numbered line starts anew.
    """
    by = Window.partitionBy("page").orderBy("line")
    before, gap = F.lag("text").over(by), F.col("y0") - F.lag("y1").over(by)
    small = gap < F.least(1.5 * (F.col("y1") - F.col("y0")), F.lit(tolerance))
    open_ = F.regexp_like(before, F.lit(r"\p{L}-\s*$")) | ~F.regexp_like(before, F.lit(r"[.!?:]\s*$"))
    numbered = F.regexp_like("text", F.lit(r"^\s*\d+[.)]\s"))
    starts = before.isNull() | numbered | ~(open_ | small)
    return lines.withColumn("_s", starts.cast("int")).withColumn("paragraph", F.sum("_s").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def joined_hyphens(lines: DataFrame, key: str, stop_words: tuple[str, ...]) -> DataFrame:
    """Lines (key, line, text) with words that a line's end cut joined; before a stop word the hyphen stays ("Vor- und Nachname")."""

    def step(rows: list[dict]) -> Iterator[dict]:
        held: dict | None = None
        for r in rows:
            words = r["text"].split()
            if held and words and held["text"].rstrip().endswith("-") and held["text"].rstrip()[-2:-1].isalnum() and words[0][0].isalnum():
                body = held["text"].rstrip()
                held["text"] = f"{body} {r['text'].lstrip()}" if words[0].rstrip(",").lower() in stop_words else body[:-1] + r["text"].lstrip()
                continue
            if held:
                yield held
            held = {key: r[key], "line": r["line"], "text": r["text"]}
        if held:
            yield held

    kind = lines.schema[key].dataType.simpleString()
    return fold(lines, [key], ["line"], step, f"{key} {kind}, line long, text string")


def heading_score(size: Column, typical: Column, bold: Column, text: Column) -> Column:
    """Points for what speaks for a heading: larger type, bold, few words, no sentence end, a number at the start."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    points = (size > 1.2 * typical, bold, words < 10, ~F.regexp_like(text, F.lit(r"[.!?]\s*$")), F.regexp_like(text, F.lit(r"^\d+(\.\d+)*\s")))
    return sum((F.when(p, 1).otherwise(0) for p in points), F.lit(0))


def margin_line(place: Column, text: Column, share: float = 0.06) -> Column:
    """Headers and footers: in the margin of the page, and short or a page number."""
    inside = (place <= share) | (place >= 1 - share)
    return inside & ((F.length(text) < 60) | F.regexp_like(text, F.lit(r"^\s*\d+\s*$")))


def contents_line(text: Column) -> Column:
    """A line of a table of contents: leaders and a page number at its end."""
    return F.regexp_like(text, F.lit(r"(\.\s?){3,}\s*\d+\s*$"))


def line_classes(lines: DataFrame) -> DataFrame:
    """Class of each line (page, line, text, score, margin, contents); an indented or open line takes that of the line before."""

    def step(rows: list[dict]) -> Iterator[dict]:
        last = "body"
        for r in rows:
            text = r["text"].strip()
            if r["margin"]:
                now = "margin"
            elif r["contents"]:
                now = "contents"
            elif text[:1] in "-*•" and text[1:2].isspace():
                now = "bullet"
            elif r["score"] >= 4:
                now = "heading"
            elif last in ("bullet", "footnote") and text[:1].islower():
                now = last
            elif r["score"] == 0 and text[:1].isdigit() and len(text) > 60:
                now = "footnote"
            else:
                now = "body"
            yield {"page": r["page"], "line": r["line"], "class": now}
            last = now if now != "margin" else last

    return fold(lines, ["page"], ["line"], step, "page long, line long, class string")


#: Starts of numbered paragraphs, of bullets, and of bullets by a Roman number alone, which must be indented.
NUMBERED, BULLET, ROMAN = r"^\s*\d+\.\d+\s", r"(?i)^\s*([-–•▪●]|[a-z]\)|\([ivxlcdm]+\))\s+\S", r"(?i)^\s*[ivxlcdm]+\s+\S"
#: Tolerances in points: of a left edge, of a level's indent, of an indent that goes on, between lines of a paragraph; the least points of a heading; a full line's share.
EDGE, LEVEL, DEEPER, LEADING, HEADING, FULL = 5.0, 10.0, 5.0, 15.0, 2, 0.6


def page_line_classes(lines: DataFrame) -> DataFrame:
    """(page, line, class) by ordered rules, from lines (page, line, text, x0, y0, left, rel_width, score, contents, margin, footnote).

    The first rule that holds counts: a numbered paragraph is body; a bullet has level 1 or 2 by its indent against the bullet before; a line that goes on from a
    body or bullet line (near below, no shallower) has its class; then heading by score, line of contents, sentence end (body), margin, footnote; of the others
    a left-aligned line is body if it fills the column, or goes on in small letters or digits close below a body line. What is left is other. left is the page's
    indent; score, contents, margin and footnote are the predicates of a line alone. Lines with a null text are other.
    """
    text = F.col("text")
    bullet = F.regexp_like(text, F.lit(BULLET)) | (F.regexp_like(text, F.lit(ROMAN)) & (F.col("x0") > F.col("left") + 15))
    alone = F.when(F.regexp_like(text, F.lit(NUMBERED)), "body").when(bullet, "bullet")
    after = (
        F.when(text.isNull(), "other").when(F.col("score") >= HEADING, "heading").when(F.col("contents"), "contents").when(F.regexp_like(text, F.lit(r"[.!?]\s*$")), "body")
        .when(F.col("margin"), "margin").when(F.col("footnote"), "footnote").when(F.abs(F.col("x0") - F.col("left")) >= EDGE, "other").when(F.col("rel_width") > FULL, "body")
        .when(F.regexp_like(text, F.lit(r"^[\p{Ll}\p{Nd}]")), "open").otherwise("other")
    )
    rows = lines.select("page", "line", F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0"), alone.alias("alone"), after.alias("after"))

    def step(group: list[dict]) -> Iterator[dict]:
        last, indent = None, None  # the line before with its class; where the last bullet stood
        for r in group:
            gap = abs(r["y0"] - last["y0"]) if last else None
            if r["alone"] == "bullet":
                now = "bullet_2" if indent is not None and r["x0"] > indent + LEVEL else "bullet_1"
                indent = r["x0"]
            elif r["alone"]:
                now = r["alone"]
            elif last and last["class"] in ("body", "bullet_1", "bullet_2") and gap < 1.5 * LEADING and r["x0"] >= last["x0"] - DEEPER:
                now = last["class"]
            elif r["after"] == "open":
                now = "body" if last and last["class"] == "body" and gap < LEADING else "other"
            else:
                now = r["after"]
            last = {**r, "class": now}
            yield {"page": r["page"], "line": r["line"], "class": now}

    return fold(rows, ["page"], ["line"], step, "page long, line long, class string")


def page_metadata(words: DataFrame, key: str = "page") -> DataFrame:
    """Type sizes, fonts, share of bold words and outer indents of each page, from words (x_start, x_end, size, font, is_bold)."""
    return words.groupBy(key).agg(
        F.median("size").alias("median_size"), F.max("size").alias("max_size"), F.array_sort(F.collect_set("font")).alias("fonts"),
        F.avg(F.col("is_bold").cast("int")).alias("bold_share"), F.min("x_start").alias("left_indent"), F.max("x_end").alias("right_indent"),
    )
