"""Word-processor files, saved course pages, and configuration."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources import parse

#: Fixed value: the namespace of word-processor markup.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(data: bytes, most: int = 64 << 20) -> Iterator[tuple]:
    """Headings, list items, paragraphs and tables of a word-processor file, in order, as blocks. Larger or unreadable files are one error block."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        if archive.getinfo("word/document.xml").file_size > most:
            raise ValueError("too large")
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
    except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as error:
        yield 0, "error", 0, "", type(error).__name__, None
        return
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{W}t"))
    n = 0
    for node in body if body is not None else ():
        if node.tag == f"{W}tbl":
            rows = [" | ".join(text(c).strip() for c in row.iter(f"{W}tc")) for row in node.iter(f"{W}tr")]
            block = ("table", 0, "\n".join(rows))
        elif node.tag == f"{W}p" and text(node).strip():
            style = node.find(f"{W}pPr/{W}pStyle")
            name = style.get(f"{W}val", "") if style is not None else ""
            level = re.search(r"(?i)(?:heading|berschrift)\s*(\d)", name)
            kind = "heading" if level else "list_item" if node.find(f"{W}pPr/{W}numPr") is not None else "quote" if "quote" in name.lower() else "paragraph"
            block = (kind, int(level[1]) if level else 0, text(node).strip())
        else:
            continue
        yield n, block[0], block[1], "", block[2], None
        n += 1


def discovered(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Links of saved course pages: (key, ordinal, section, title, url), the section being the last heading before the link."""
    blocks = parse.parsed(pages, parse.html_blocks, html, parse.BLOCKS, (key,))
    by = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(by)
    return blocks.withColumn("section", section).where("kind = 'link'").select(key, "ordinal", "section", F.col("text").alias("title"), F.col("href").alias("url"))


def text_kind(text: Column, mono_ratio: Column, size: Column, typical: Column) -> Column:
    """Code, math, heading or paragraph, by the share of fixed-width type, signs of code and of formulas, and size."""
    code = F.regexp_like(text, F.lit(r"(?m)[{};]\s*$|^\s*(def|class|import|return|for|while|if)\b.*[:;{]\s*$|\w+\(.*\)\s*;"))
    math = F.regexp_like(text, F.lit(r"[=∑∫√≤≥≠∂∞]|\\(frac|sum|int)")) & (F.regexp_count(text, F.lit(r"\p{L}{4,}")) <= 2)
    return F.when((mono_ratio >= 0.6) | (code & (mono_ratio >= 0.3)), "code").when(math, "math").when((size > 1.2 * typical) & (F.length(text) < 120), "heading").otherwise("paragraph")


def config(text: str) -> dict:
    """A configuration in JSON, or in the flat YAML of names and plain values. For the driver."""
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        value = {}
        for line in text.splitlines():
            line = line.split(" #")[0].rstrip()
            if line and not line.startswith("#"):
                name, mark, rest = line.partition(":")
                if not mark or name != name.strip():
                    raise ValueError(f"not a flat configuration: {line}") from None
                rest = rest.strip()
                value[name] = {"true": True, "false": False, "null": None, "": None}.get(rest, int(rest) if re.fullmatch(r"-?\d+", rest) else float(rest) if re.fullmatch(r"-?\d+\.\d+", rest) else rest.strip("'\""))
    if not isinstance(value, dict):
        raise ValueError("a configuration is an object")
    return value
