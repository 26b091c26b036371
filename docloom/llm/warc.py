"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Records are rows: type, id, target, date, content type, refers-to, block digest, headers and block. Ids are name-based, so a
repeated run gives the same ones. A page is read once from left to right, in time that grows with its length alone.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from docloom.llm.common import slices

#: Elements whose content is no text. The first three go on to the end of the page where they aren't closed; of the others, a tag
#: that isn't closed hides nothing.
RAW, HIDDEN = ("script", "style", "title"), ("script", "style", "title", "head", "template", "noscript")
BREAKING = frozenset(
    "address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()
)
#: A comment's start, an element's tag, or another tag. Only that part of a page is searched after which a ">" still comes.
TAG = re.compile(r"<(?:!--|(/?)([A-Za-z][A-Za-z0-9:-]*)[^>]*>|[!?/][^>]*>)")
TITLE, HREF = re.compile(r"<title\b[^>]*>", re.IGNORECASE), re.compile(r"\bhref\s*=", re.IGNORECASE)
CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in HIDDEN}


def record_id(kind: str, *parts: Column) -> Column:
    """<urn:uuid:...> made of a digest of the parts, in the layout of version 8."""
    h = F.sha2(F.concat_ws("\u0001", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts)), 256)
    at = lambda start, n: F.substring(h, start, n)
    return F.concat(F.lit("<urn:uuid:"), at(1, 8), F.lit("-"), at(9, 4), F.lit("-8"), at(14, 3), F.lit("-a"), at(18, 3), F.lit("-"), at(21, 12), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def read_page(html: str) -> tuple[str, str, int]:
    """(text, title, links) of a page.

    Hidden elements and comments turn into a blank, tags of blocks into line ends, other tags into nothing; then character
    references are decoded and blanks folded. A comment that isn't closed, or a tag that the page's end cuts off, hides the rest.
    """
    end, at, links = html.rfind(">") + 1, 0, 0
    out, unclosed = [], set()
    while m := TAG.search(html, at, end):
        out.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                closed = html.find("-->", at)
                at = closed + 3 if closed >= 0 else len(html)
                out.append(" ")
            continue
        name = m[2].lower()
        if name in CLOSERS and not m[1] and name not in unclosed:
            closer = CLOSERS[name].search(html, at, end)
            if closer or name in RAW:
                at = closer.end() if closer else len(html)
                out.append(" ")
            else:
                unclosed.add(name)
        elif name in BREAKING:
            out.append("\n")
        elif name == "a" and not m[1]:
            links += HREF.search(m[0]) is not None
    rest = html[at:]
    cut = re.search(r"<[A-Za-z/!?]", rest)
    out.append(rest[: cut.start()] if cut else rest)
    text = re.sub(r"[ \t\r\f]+", " ", unescape("".join(out)))
    opened = TITLE.search(html, 0, end)
    closed = CLOSERS["title"].search(html, opened.end(), end) if opened else None
    title = re.sub(r"\s+", " ", unescape(html[opened.end() : closed.start()])).strip() if closed else ""
    return re.sub(r" ?\n[ \n]*", "\n", text).strip(" \n"), title, links


def with_text(records: DataFrame, html_col: str = "html") -> DataFrame:
    """The rows with text, title and links of the page in html_col, which isn't null."""
    schema = StructType(list(records.schema.fields)).add("text", "string").add("title", "string").add("links", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, html_col):
            text, title, links = zip(*map(read_page, part.column(html_col).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text), pa.array(title), pa.array(links)], schema.names)

    return records.mapInArrow(run, schema)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages, one per row: the form in which derive() takes its input. A null page counts as empty."""
    url, html = F.col(url_col), F.col(html_col)
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    length = F.coalesce(F.octet_length(html), F.lit(0))
    return pages.select(
        F.col(id_col).alias("source_id"), record_id("response", F.col(id_col), url, F.md5(html)).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"),
        F.array(header("Content-Type", F.lit("text/html; charset=utf-8")), header("Content-Length", length)).alias("headers"), html.alias("block"),
    )


#: Digests that a source states of itself.
GIVEN = ("given_block_digest", "given_payload_digest")


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response: its metadata record and its conversion record, both with refers_to set to the response's id.

    records: source_id, record_id, target_uri, date, headers (array of name and value) and block (HTML), as responses() and
    read_archives() give them; other columns are left out. Of archives these come too, and are used where they are: raw_digest, the digest of the
    payload as it lies in the archive, in place of the block's; given_block_digest and given_payload_digest, which the source states and which are kept;
    form: of "other" no text is made, so it has its metadata record alone, and "plain" is text as it stands. source_digest is the digest of the response's block, source_headers
    its headers, one "name: value" per line; both are kept in either record. A null block counts as empty, a null target stays
    null. Pages of any length and brokenness take time in proportion to their length. Rows stand alone: equal responses give
    equal derivatives, and an empty table gives none.
    """
    block = F.coalesce("block", F.lit(""))
    there = [c for c in GIVEN if c in records.columns]
    form = F.col("form") if "form" in records.columns else F.lit("html")
    own = F.coalesce("raw_digest", digest(block)) if "raw_digest" in records.columns else digest(block)
    base = with_text(records.select(
        "source_id", F.col("record_id").alias("refers_to"), "target_uri", "date", own.alias("source_digest"), block.alias("body"), form.alias("form"), *there,
        F.when(form == "html", block).otherwise("").alias("html"), F.array_join(F.transform(F.coalesce("headers", F.array()), lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n").alias("source_headers"),
    ))
    base = base.withColumn("text", F.when(F.col("form") == "plain", F.col("body")).otherwise(F.col("text")))
    fields = (
        ("title", F.col("title")), ("source-length", F.octet_length("body")), ("text-length", F.octet_length("text")),
        ("links", F.col("links")), ("source-digest", F.col("source_digest")),
    )
    described = F.concat_ws("\r\n", *(F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in fields))
    record = lambda kind, content, block: F.struct(F.lit(kind).alias("type"), F.lit(content).alias("content_type"), block.alias("block"))
    alone, text = record("metadata", "application/warc-fields", described), record("conversion", "text/plain", F.col("text"))
    both = F.when(F.col("form") == "other", F.array(alone)).otherwise(F.array(alone, text))
    rows = base.select("source_id", "refers_to", "target_uri", "date", "source_digest", "source_headers", *there, F.explode(both).alias("r"))
    kind, block = F.col("r.type"), F.col("r.block")
    return rows.select(
        "source_id", kind.alias("warc_type"), record_id("derivative", F.col("refers_to"), kind).alias("record_id"), "refers_to", "target_uri", "date",
        F.col("r.content_type").alias("content_type"), F.octet_length(block).cast("long").alias("content_length"), digest(block).alias("block_digest"),
        "source_digest", "source_headers", block.alias("block"), *there,
    )


#: Header of a record and column that it comes from. The last two keep what the source said of itself.
LINES = (
    ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"),
    ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"), ("X-Source-Digest", "source_digest"),
)


def serialized(derived: DataFrame) -> DataFrame:
    """(source_id, warc_type, record): each record as the text of a WARC/1.1 file, for a sink; a null header is left out.

    The source's digest stands in X-Source-Digest, and each of its headers in a line X-Source-Header.
    """
    stated = [F.concat(F.lit(f"X-{c.replace('_', '-').title()}: "), F.col(c)) for c in GIVEN if c in derived.columns]
    sources = F.transform(F.filter(F.split("source_headers", "\n"), lambda h: h != ""), lambda h: F.concat(F.lit("X-Source-Header: "), h))
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *(F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in LINES), *stated, sources)
    return derived.select("source_id", "warc_type", F.concat(head, F.lit("\r\n\r\n"), "block", F.lit("\r\n\r\n")).alias("record"))


def _fields(head: bytes) -> list[tuple[str, str]]:
    """Header lines after the first one."""
    lines = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return [(name.strip().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace")) for name, mark, value in lines if mark]


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-cased name, block) of each record of a WARC file, gzipped or not; a record that is cut off ends the file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = {name.lower(): value for name, value in _fields(data[at:end])}
        length = fields.get("content-length", "")
        start = end + 4
        if not length.isdecimal() or start + int(length) > len(data):
            return
        at = start + int(length)
        yield fields, data[start:at]


#: Media types beside text/* whose payload is text.
TEXTUAL = ("application/xhtml+xml", "application/xml", "application/json", "application/javascript")
CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9._:-]+)", re.IGNORECASE)


def _unchunked(body: bytes) -> bytes:
    """The payload of a chunked message; what isn't chunked after all stays as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(b"[0-9A-Fa-f]{1,15}", size):
            return body
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if end + 2 + n > len(body):
            return body
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return body


def payload_of(headers: dict[str, str], body: bytes) -> tuple[bytes, str, str]:
    """(payload, form, text) of an HTTP message, by its headers (names in lower case): transfer and content codings undone, the text in its charset.

    form is html, plain, or other, which has no text. Without a Content-Type, a payload with a NUL is other, one with a "<" is html. A coding that the payload
    doesn't have is not undone. The charset is that of the header, else of a meta tag at the start, else UTF-8; bytes that are wrong in it turn into U+FFFD.
    """
    if "chunked" in headers.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    for coding in reversed(headers.get("content-encoding", "").lower().replace(" ", "").split(",")):
        try:
            body = gzip.decompress(body) if coding in ("gzip", "x-gzip") else zlib.decompress(body) if coding == "deflate" else body
        except (OSError, EOFError, zlib.error):
            break
    kind, _, parameters = headers.get("content-type", "").partition(";")
    kind = kind.strip().lower()
    if kind in ("text/html", "application/xhtml+xml"):
        form = "html"
    elif kind:
        form = "plain" if kind.startswith("text/") or kind in TEXTUAL or kind.endswith(("+xml", "+json")) else "other"
    else:
        form = "other" if b"\0" in body[:1024] else "html" if b"<" in body[:1024] else "plain"
    if form == "other":
        return body, form, ""
    named = CHARSET.search(parameters) or CHARSET.search(body[:1024].decode("latin-1") if form == "html" else "")
    try:
        text = body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    return body, form, text


def read_archives(files: DataFrame) -> DataFrame:
    """Response records of WARC files, a table with a column `content` as spark.read.format("binaryFile") gives it.

    A row per record of type response, with the header of the HTTP message taken off and its codings undone (payload_of()); source_id is its record id.
    raw_digest is that of the message's body as it lies in the archive; the digests that the record states are kept beside it. A file is held by
    one task, so files should be of the usual size, about a gigabyte at most.
    """
    schema = StructType.fromDDL(
        "source_id string, record_id string, target_uri string, date string, headers array<struct<name: string, value: string>>, block string, "
        "raw_digest string, given_block_digest string, given_payload_digest string, form string"
    )
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for fields, block in parsed(content.as_py() or b""):
                    if fields.get("warc-type") != "response":
                        continue
                    head, _, body = block.partition(b"\r\n\r\n")
                    headers = [{"name": name, "value": value} for name, value in _fields(head)]
                    _, form, text = payload_of({h["name"].lower(): h["value"] for h in headers}, body)
                    known = [fields.get(x) for x in ("warc-record-id", "warc-record-id", "warc-target-uri", "warc-date")]
                    row = (*known, headers, text, f"sha256:{hashlib.sha256(body).hexdigest()}", fields.get("warc-block-digest"), fields.get("warc-payload-digest"), form)
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], schema.names)

    return files.select("content").mapInArrow(run, schema)
