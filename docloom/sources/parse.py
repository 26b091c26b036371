"""Parsers of documents: pages, transcripts, code, Markdown, notebooks, archives, mails. Each is a table function over a text column.

The helpers below take one document and yield tuples; parsed() runs one of them over a column in Arrow batches, so rows stay
where they are and a document is the unit of memory.
"""

from __future__ import annotations

import ast
import email
import email.policy
import html
import io
import json
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = "ordinal long, kind string, level long, path string, text string, href string"
NODES = "pre long, end long, tag string, level long, start string, value string, reversed boolean, href string, text string"
SEGMENTS = "seg_id long, start double, end double, text string"
LINES = "line long, text string"
CELLS = "cell long, kind string, language string, text string"
SYMBOLS = "ordinal long, kind string, name string, line long, doc string"
MEMBERS = "ordinal long, name string, size long, status string"
TABLE_CELLS = "table long, row int, column int, header boolean, text string"
MAIL = "subject string, sender string, date string, plain string, links array<string>"

#: Rows, and characters, that a task makes before it hands them on.
BATCH_ROWS, BATCH_CHARACTERS = 4096, 1 << 20


def parsed(df: DataFrame, parser: Callable[[object], Iterator[tuple]], column: str, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows that a parser yields for each value of a column, with the kept columns; a null value yields none."""
    names = [c.strip().split()[0] for c in schema.split(", ")]
    kept = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batched(_rows(batches, parser)):
            yield pd.DataFrame(rows, columns=[*keep, *names])

    return df.select(*keep, column).mapInPandas(run, ", ".join([*kept, schema]))


def _rows(batches: Iterator[pd.DataFrame], parser: Callable[[object], Iterator[tuple]]) -> Iterator[tuple]:
    for batch in batches:
        for values in batch.itertuples(index=False, name=None):
            if values[-1] is not None:
                for row in parser(values[-1]):
                    yield *values[:-1], *row


def batched(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows in lists of at most BATCH_ROWS, which end early where their texts have BATCH_CHARACTERS together."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) == BATCH_ROWS or size >= BATCH_CHARACTERS:
            yield held
            held, size = [], 0
    if held:
        yield held


class _Page(HTMLParser):
    """Blocks of a page in document order; text outside of block elements belongs to the enclosing one."""

    KINDS = {"p": "paragraph", "li": "list_item", "pre": "code", "blockquote": "quote", "td": "cell", "th": "cell", "figcaption": "caption", "title": "title"}
    HIDDEN = frozenset(("script", "style", "template", "noscript"))
    VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[list] = []  # tag, index among its siblings, counters of children
        self.counts: list[dict[str, int]] = [{}]
        self.blocks: list[list] = []
        self.open: list[int] = []
        self.hidden = 0

    def path(self) -> str:
        return "/".join(f"{tag}[{i}]" for tag, i in self.stack)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        n = self.counts[-1][tag] = self.counts[-1].get(tag, 0) + 1
        if tag == "br":
            self.handle_data("\n")
        if tag == "img":
            self.blocks.append(["image", 0, f"{self.path()}/img[{n}]", [dict(attrs).get("alt") or ""], dict(attrs).get("src")])
        if tag in self.VOID:
            return
        if tag in ("p", "li") and self.stack and self.stack[-1][0] == tag:
            self.handle_endtag(tag)
        self.stack.append((tag, n))
        self.counts.append({})
        self.hidden += tag in self.HIDDEN
        kind = "heading" if re.fullmatch("h[1-6]", tag) else "link" if tag == "a" and dict(attrs).get("href") else self.KINDS.get(tag)
        if kind:
            level = int(tag[1]) if kind == "heading" else sum(t in ("ul", "ol") for t, _ in self.stack) if kind == "list_item" else 0
            self.open.append(len(self.blocks))
            self.blocks.append([kind, level, self.path(), [], dict(attrs).get("href")])
        else:
            self.open.append(-1)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.VOID or tag not in (t for t, _ in self.stack):
            return
        while self.stack:
            last, _ = self.stack.pop()
            self.counts.pop()
            self.open.pop()
            self.hidden -= last in self.HIDDEN
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        for i in reversed([i for i in self.open if i >= 0]):
            self.blocks[i][3].append(data)
            if self.blocks[i][0] != "link":
                return


#: Tags in plain spelling, and elements whose text is read by other rules. Pages with others are parsed each by itself.
PLAIN_TAG = re.compile(r"""(<(?:/[a-zA-Z][a-zA-Z0-9]*|[a-zA-Z][a-zA-Z0-9]*(?:[ \n]+[a-zA-Z-]+(?:=(?:'[^'<>]*'|"[^"<>]*"))?)*|!DOCTYPE html)>)""")
RAW = re.compile("<(?:script|style|textarea|xmp|iframe|noembed|noframes|plaintext)", re.IGNORECASE)
#: Pages in which brackets stand around tags only.
PAIRED = re.compile("[^<>]*+(?:<[^<>]*+>[^<>]*+)*+")
#: Forms of pages that a task keeps, and the characters of the longest.
FORMS, FORM_CHARACTERS = 4096, 1 << 14
_block_forms: dict[str, list | tuple | None] = {}
_cell_forms: dict[str, list | tuple | None] = {}


def _page_blocks(text: str) -> list[list]:
    page = _Page()
    page.feed(text)
    page.close()
    return page.blocks


def _pieces(text: str) -> tuple[list[str], list[str]] | None:
    """The texts between a page's tags, and the tags without their brackets; None where it takes a parser to tell them, or there are too many for a form."""
    if "\0" in text or "\ue000" in text or text.count("<") > FORM_CHARACTERS // 2:
        return None
    if PAIRED.fullmatch(text):
        pieces = text.replace(">", "<").split("<")
        return pieces[::2], pieces[1::2]
    pieces = PLAIN_TAG.split(text)
    return None if any("<" in x for x in pieces[::2]) else (pieces[::2], [tag[1:-1] for tag in pieces[1::2]])


def _form(tags: list[str], read: Callable[[str], Iterable], parts: int) -> list | None:
    """The rows that read() gives for all pages with these tags, with the places of their parts among the texts between tags; None where tags don't settle it."""
    tags = [f"<{tag}>" for tag in tags]
    marked = "".join(f"\ue000{i}\ue001{tag}" for i, tag in enumerate(tags)) + f"\ue000{len(tags)}\ue001"
    if RAW.search(marked) or not all(map(PLAIN_TAG.fullmatch, tags)):
        return None
    found = []
    for row in read(marked):
        places = [int(x[1:-1]) if re.fullmatch("\ue000[0-9]+\ue001", x) else x for x in row[parts]]
        if any(isinstance(x, str) and "\ue000" in x for x in places):
            return None
        found.append((*row[:parts], places, *row[parts + 1 :]))
    return found


def _known_form(forms: dict[str, list | tuple | None], tags: list[str], form: Callable[[list[str]], list | None]) -> list | None:
    """The form of pages with these tags, where one was met before."""
    name = "<".join(tags)
    if len(name) > FORM_CHARACTERS:
        return None
    if name not in forms:
        if len(forms) >= FORMS:
            forms.clear()
        forms[name] = ()  # read at the second page
        return None
    if forms[name] == ():
        forms[name] = form(tags)
    return forms[name]


def _formed_blocks(text: str) -> list | None:
    """The blocks of a page whose tags were met before, as _page_blocks() gives them; None for others."""
    texts, tags = _pieces(text) or ((), ())
    form = _known_form(_block_forms, tags, lambda tags: _form(tags, _page_blocks, 3)) if texts else None
    if not form:
        return None
    if "&" in text:
        texts = [html.unescape(x) for x in texts]
    return [(kind, level, path, [texts[x] if isinstance(x, int) else x for x in places], href) for kind, level, path, places, href in form]


def html_blocks(text: str) -> Iterator[tuple]:
    """Blocks of a page with their element path; lists have their depth, headings their level, links their target.

    Pages that differ in their texts only share a parsed form.
    """
    n = 0
    for kind, level, path, parts, href in _formed_blocks(text) or _page_blocks(text):
        body = "".join(parts) if kind == "code" else " ".join("".join(parts).split())
        if body or href:
            yield n, kind, level, path, body, href
            n += 1


class _Tree(HTMLParser):
    """Elements of a page in document order, each with the place of its last descendant and the text that it holds itself."""

    #: Start tags that end an open element of the first kind, as far out as the nearest of the others.
    ENDS = {"li": ("li", ("ul", "ol")), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "tr": ("tr", ("table",)), "p": ("p", ("body", "li", "td", "div", "blockquote"))}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []

    def close_to(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.nodes[i][1] = len(self.nodes) - 1
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.ENDS:
            kind, walls = self.ENDS[tag]
            for depth in range(len(self.open) - 1, -1, -1):
                at = self.nodes[self.open[depth]][2]
                if at == kind:
                    self.close_to(depth)
                if at == kind or at in walls:
                    break
        named, pre = dict(attrs), len(self.nodes)
        self.nodes.append([pre, pre, tag, len(self.open), named.get("start"), named.get("value"), "reversed" in named, named.get("href"), []])
        if tag not in _Page.VOID:
            self.open.append(pre)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[depth]][2] == tag:
                self.close_to(depth)
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.nodes[self.open[-1]][8].append(data)


def _page_nodes(text: str) -> list[list]:
    tree = _Tree()
    tree.feed(text)
    tree.close()
    tree.close_to(0)
    return tree.nodes


def html_nodes(text: str) -> Iterator[tuple]:
    """The elements of a page as NODES; an element without an end tag ends with what surrounds it."""
    for *node, parts in _page_nodes(text):
        yield *node, " ".join("".join(parts).split())


def _page_cells(text: str) -> Iterator[tuple]:
    tables: list[list[int]] = []  # place, end, rows so far
    rows: list[list[int]] = []  # the table's place, end, place in the table, cells so far
    for pre, end, tag, *_, parts in _page_nodes(text):
        for around in (tables, rows):
            while around and around[-1][1] < pre:
                around.pop()
        if tag == "table":
            tables.append([pre, end, 0])
        elif tag == "tr":
            rows.append([tables[-1][0] if tables else -1, end, tables[-1][2] if tables else 0, 0])
            if tables:
                tables[-1][2] += 1
        elif tag in ("td", "th") and rows:
            table, _, at, cells = rows[-1]
            rows[-1][3] += 1
            if table >= 0:
                yield table, at, cells, tag == "th", parts


def _cell_form(tags: list[str]) -> list | None:
    """The cells of all pages with these tags in columns."""
    rows = _form(tags, _page_cells, 4)
    return None if rows is None else [*map(list, zip(*rows, strict=True))] or [[]] * 5


def _cell_columns(text: str) -> Iterator[Sequence[Sequence]]:
    """The cells of a page in columns, those of a page whose tags weren't met before in several pieces."""
    texts, tags = _pieces(text) or ((), ())
    form = _known_form(_cell_forms, tags, _cell_form) if texts else None
    if form is None:
        for rows in batched((*cell, " ".join("".join(parts).split())) for *cell, parts in _page_cells(text)):
            yield [*zip(*rows, strict=True)]
        return
    *columns, places = form
    if "&" in text:
        texts = [html.unescape(x) if "&" in x else x for x in texts]
    bodies = [texts[x[0]] if len(x) == 1 else "".join([texts[i] for i in x]) for x in places]
    yield [*columns, [body if body.isalnum() else " ".join(body.split()) for body in bodies]]


def html_cells(text: str) -> Iterator[tuple]:
    """The cells of a page as TABLE_CELLS, each with its place among the rows of the innermost table and the cells of its row, from 0; rows outside of tables have none.

    Pages that differ in their texts only share a parsed form.
    """
    for columns in _cell_columns(text):
        yield from zip(*columns, strict=True)


def _held_cells(pages: Iterable[pa.Scalar]) -> Iterator[tuple[list[int], list[list]]]:
    """Cells of pages in columns, and the place of each one's page, in batches that end like those of batched() but with a whole page or piece of one."""
    at, held, size = [], [[] for _ in range(5)], 0
    for i, page in enumerate(pages):
        for columns in _cell_columns(page.as_py()) if page.is_valid else ():
            at += [i] * len(columns[0])
            for values, more in zip(held, columns, strict=True):
                values += more
            size += sum(map(len, columns[-1]))
            if len(at) >= BATCH_ROWS or size >= BATCH_CHARACTERS:
                yield at, held
                at, held, size = [], [[] for _ in range(5)], 0
    if at:
        yield at, held


def table_cells(df: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of html_cells() for each page of a column, with the kept columns; a null value yields none. Cells leave a task in columns, not one by one."""
    names = [c.split()[0] for c in TABLE_CELLS.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
    kept = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, cells in _held_cells(batch.column(column)):
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in keep), *map(pa.array, cells, kinds)], names=[*keep, *names])

    return df.select(*keep, column).mapInArrow(run, ", ".join([*kept, TABLE_CELLS]))


TIME = re.compile(r"(?:(\d{1,2}):)?(\d{2}):(\d{2})[.,](\d{3})")
ARROW = re.compile(rf"({TIME.pattern})\s+-->\s+({TIME.pattern})(?:\s.*)?")


def _seconds(text: str) -> float:
    h, m, s, ms = TIME.fullmatch(text).groups()
    if int(m) > 59 or int(s) > 59:
        raise ValueError(f"no time: {text}")
    return int(h or 0) * 3600 + int(m) * 60 + int(s) + int(ms) / 1000


def subtitles(text: str) -> Iterator[tuple]:
    """Cues of an SRT or VTT text, in order; notes and styles are skipped, tags and entities resolved. Overlaps are kept.

    A cue that ends before it starts, or whose times aren't times, is an error.
    """
    n = 0
    for block in re.split(r"\n[ \t]*\n", text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")):
        lines = block.strip("\n").split("\n")
        at = next((i for i, line in enumerate(lines[:2]) if "-->" in line), None)
        if at is None or lines[0].split(" ")[0] in ("NOTE", "STYLE", "REGION"):
            continue
        match = ARROW.fullmatch(lines[at].strip())
        if not match:
            raise ValueError(f"no times: {lines[at]}")
        start, end = _seconds(match[1]), _seconds(match[6])
        if end < start:
            raise ValueError(f"a cue ends before it starts: {lines[at]}")
        body = html.unescape(re.sub(r"<[^>]*>", "", "\n".join(lines[at + 1 :]))).strip()
        if body:
            yield n, start, end, body
            n += 1


def rolling_subtitles(text: str) -> Iterator[tuple]:
    """Cues without the words that repeat the end of the cue before, as rolling captions do; a cue with nothing new goes."""
    before: list[str] = []
    n = 0
    for _, start, end, body in subtitles(text):
        words = body.split()
        overlap = next((k for k in range(min(len(before), len(words)), 0, -1) if before[-k:] == words[:k]), 0)
        before = words
        if words[overlap:]:
            yield n, start, end, " ".join(words[overlap:])
            n += 1


def plain_transcript(text: str) -> Iterator[tuple]:
    """Lines of a plain transcript; their times are unknown, not 0."""
    for n, line in enumerate(x for x in text.splitlines() if x.strip()):
        yield n, None, None, line.strip()


def code_lines(text: str) -> Iterator[tuple]:
    """Lines with their ends, wherever the language's own rules for lines cut."""
    yield from enumerate(text.splitlines(True))


def python_symbols(text: str) -> Iterator[tuple]:
    """Imports, functions and classes of a Python text, read and never run; a text that doesn't parse is one error row."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as error:
        yield 0, "error", type(error).__name__, getattr(error, "lineno", None), None
        return
    n = 0
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            yield n, kind, node.name, node.lineno, ast.get_docstring(node)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            base = f"{node.module or ''}." if isinstance(node, ast.ImportFrom) else ""
            for name in node.names:
                yield n, "import", base + name.name, node.lineno, None
                n += 1
            continue
        else:
            continue
        n += 1


def markdown_blocks(text: str) -> Iterator[tuple]:
    """Headings, list items, quotes, fenced code and paragraphs of a Markdown text."""
    lines, i, n = text.split("\n"), 0, 0
    special = re.compile(r"(#{1,6})\s+(.*)|(\s*)([-*+]|\d+[.)])\s+(.*)|>\s?(.*)")
    while i < len(lines):
        line = lines[i]
        fence = re.match(r"(`{3,}|~{3,})(.*)", line)
        if fence:
            body = []
            while (i := i + 1) < len(lines) and not lines[i].startswith(fence[1]):
                body.append(lines[i])
            block = ("code", 0, fence[2].strip(), "\n".join(body))
        elif match := special.fullmatch(line):
            if match[1]:
                block = ("heading", len(match[1]), "", match[2].strip())
            elif match[4]:
                block = ("list_item", len(match[3]) // 2 + 1, "", match[5].strip())
            else:
                block = ("quote", 0, "", match[6].strip())
        elif line.strip():
            body = [line.strip()]
            while i + 1 < len(lines) and lines[i + 1].strip() and not special.fullmatch(lines[i + 1]) and not lines[i + 1].startswith(("```", "~~~")):
                body.append(lines[i := i + 1].strip())
            block = ("paragraph", 0, "", " ".join(body))
        else:
            i += 1
            continue
        i += 1
        yield n, block[0], block[1], block[2], block[3], None
        n += 1


def text_blocks(text: str) -> Iterator[tuple]:
    """Blocks of a plain text, parted by blank lines."""
    for n, block in enumerate(b for b in re.split(r"\n{2,}", text) if b.strip()):
        yield n, "paragraph", 0, "", block, None


def notebook_cells(text: str) -> Iterator[tuple]:
    """Cells of a notebook with the kernel's language."""
    book = json.loads(text)
    language = book.get("metadata", {}).get("kernelspec", {}).get("language") or book.get("metadata", {}).get("language_info", {}).get("name")
    for n, cell in enumerate(book.get("cells", [])):
        source = cell.get("source", "")
        yield n, cell.get("cell_type"), language if cell.get("cell_type") == "code" else None, source if isinstance(source, str) else "".join(source)


def zip_members(data: bytes, members: int = 64, size: int = 1 << 20, total: int = 8 << 20, ratio: int = 100) -> Iterator[tuple]:
    """Members of an archive with what speaks against reading them; nothing is unpacked to disk."""
    try:
        infos = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except zipfile.BadZipFile:
        yield 0, None, None, "not_an_archive"
        return
    seen, sum_ = set(), 0
    for n, info in enumerate(infos):
        key = unicodedata.normalize("NFC", info.filename).casefold()
        sum_ += info.file_size
        parts = info.filename.split("/")
        problems = {
            "too_many": n >= members, "unsafe_path": info.filename.startswith("/") or ".." in parts or "\\" in info.filename, "collision": key in seen, "encrypted": bool(info.flag_bits & 1),
            "too_large": info.file_size > size, "total_too_large": sum_ > total, "ratio": info.file_size > ratio * max(info.compress_size, 1),
        }
        seen.add(key)
        yield n, info.filename, info.file_size, next((k for k, bad in problems.items() if bad), "ok")


def mail(data: bytes) -> Iterator[tuple]:
    """Subject, sender's address, date, plain text and links of one message."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    body = message.get_body(preferencelist=("plain", "html"))
    text = body.get_content() if body else ""
    plain = html.unescape(re.sub(r"<[^>]*>", "", text)) if body and body.get_content_type() == "text/html" else text
    links = list(dict.fromkeys(x.rstrip(".,);]") for x in re.findall(r"https?://[^\s<>\"']+", text)))
    date = message["date"].datetime.isoformat() if message["date"] and message["date"].datetime else None
    yield str(message["subject"] or ""), email.utils.parseaddr(str(message["from"] or ""))[1], date, plain.strip(), links


def mailbox(line: str) -> tuple[str, str]:
    """(name, type) of a line of a mailbox listing."""
    match = re.fullmatch(r'\(([^)]*)\)\s+(?:"[^"]*"|NIL)\s+"?([^"]*)"?', line.strip())
    if not match:
        raise ValueError(f"no mailbox: {line}")
    flags = match[1].lower()
    kinds = {"\\sent": "sent", "\\trash": "trash", "\\junk": "junk", "\\drafts": "drafts", "\\archive": "archive", "\\all": "all"}
    return match[2], next((k for f, k in kinds.items() if f in flags), "inbox" if match[2].upper() == "INBOX" else "folder")


def gutter(text: str) -> bool:
    """Whether each of at least three lines starts with the next number, right-aligned in one width."""
    rows = [re.match(r"(\s*)(\d+)(?:\s|$)", line) for line in text.split("\n") if line.strip()]
    if len(rows) < 3 or not all(rows):
        return False
    numbers, widths = [int(r[2]) for r in rows], {len(r[1]) + len(r[2]) for r in rows}
    return len(widths) == 1 and all(b == a + 1 for a, b in zip(numbers, numbers[1:], strict=False))
