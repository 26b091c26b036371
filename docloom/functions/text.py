"""Scalar functions over texts, ids and times, as column expressions; Python only where Spark has no such function."""

from __future__ import annotations

import html
import unicodedata
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNICODE_BLANKS = r"(?U)\s+"


def sha(c: Column) -> Column:
    """sha256 hex of the UTF-8 text."""
    return F.sha2(c.cast("binary"), 256)


def deterministic_id(kind: str, *parts: Column) -> Column:
    """kind, a colon, and the sha256 of the compact JSON array of kind and parts."""
    return F.concat(F.lit(f"{kind}:"), F.sha2(F.to_json(F.array(F.lit(kind), *parts)), 256))


def canonical_json(struct: dict[str, Column]) -> Column:
    """compact JSON with sorted keys."""
    return F.to_json(F.struct(*(struct[k].alias(k) for k in sorted(struct))), {"ignoreNullFields": "false"})


def short_hash(c: Column, n: int = 16) -> Column:
    """the first digits of the hash of the stripped text."""
    return F.substring(F.sha2(F.trim(c), 256), 1, n)


def knowledge_id(source: Column, obj: Column, kind: Column) -> Column:
    """K_ and twelve digits of the hash of the three, joined by bars."""
    return F.concat(F.lit("K_"), F.substring(F.sha2(F.concat_ws("|", source, obj, kind), 256), 1, 12))


@F.pandas_udf(StringType())
def point_id(values: pd.Series) -> pd.Series:
    """name-based UUID (version 5) of a fingerprint."""
    return values.map(lambda x: None if x is None else str(uuid.uuid5(uuid.NAMESPACE_URL, x)))


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(StringType())
def unescaped(values: pd.Series) -> pd.Series:
    """HTML entities spelled out."""
    return values.map(lambda x: None if x is None else html.unescape(x))


def exact_text(c: Column) -> Column:
    """the text key of exact grouping: NFC, stripped."""
    return F.trim(nfc(c))


def exact_math(c: Column) -> Column:
    """the formula key: blanks around operators dropped, unless there is TeX in it."""
    plain = F.regexp_replace(c, r" *([-+*/=<>^(),]) *", "$1")
    return F.when(F.contains(c, F.lit("\\")), c).otherwise(plain)


def balanced(c: Column, opening: str, closing: str) -> Column:
    """as many closing as opening brackets."""
    count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return count(opening) == count(closing)


def latex_issues(c: Column) -> Column:
    """names of the structural findings in a formula."""
    rules = (
        ("empty", F.trim(c) == ""), ("braces", ~balanced(c, "{", "}")), ("parentheses", ~balanced(c, "(", ")")), ("brackets", ~balanced(c, "[", "]")),
        ("control", F.regexp_like(c, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))), ("replacement", F.contains(c, F.lit("�"))),
    )
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules)))


def without_controls(c: Column) -> Column:
    """control characters out, but for line ends and tabs."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def folded_blanks(c: Column) -> Column:
    """runs of blanks, Unicode ones too, as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, UNICODE_BLANKS, " "))


def duplicate_key(c: Column) -> Column:
    """lower case, no punctuation, folded blanks."""
    return folded_blanks(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""))


def seconds(c: Column) -> Column:
    """F16: h:mm:ss.mmm or mm:ss,mmm as seconds, null for anything else."""
    pattern = r"^(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).cast("double"), F.lit(0.0))
    ok = F.regexp_like(c, F.lit(pattern)) & (part(2) < 60) & (part(3) < 60)
    return F.when(ok, part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000)


def mail_date(c: Column) -> Column:
    """a mail server's date with its zone."""
    return F.try_to_timestamp(F.trim(c), F.lit("dd-MMM-yyyy HH:mm:ss Z"))


def list_literal(c: Column) -> Column:
    """a list written in a cell, as an array of strings: Python's or JSON's brackets, else cut at commas."""
    bracketed = F.from_json(F.translate(c, "'", '"'), "array<string>")
    cut = F.transform(F.split(c, ","), lambda x: F.trim(x))
    return F.when(F.trim(c).startswith("["), bracketed).otherwise(cut)


def features(c: Column) -> Column:
    """words, characters, and how a text ends."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.struct(
        F.size(words).alias("n_words"), F.length(c).alias("n_chars"), F.regexp_like(c, F.lit(r"\p{L}-\s*$")).alias("end_hyphen"),
        F.regexp_like(c, F.lit(r"[.!?]['\")\]]?\s*$")).alias("sentence_end"), F.regexp_count(c, F.lit(r"[.,;:!?]")).alias("punctuation"),
    )


def plain_links(c: Column) -> Column:
    """links in a text, in order, each once, without the punctuation after them."""
    found = F.regexp_extract_all(c, F.lit(r"(https?://[^\s<>\"']+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.rtrim(x, F.lit(".,);]"))))


def html_links(c: Column) -> Column:
    """targets of the links of a page, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    """inner product in double arithmetic."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """null where a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit_vector_ok(v: Column, size: int, tolerance: float = 1e-5) -> Column:
    """the dimension, finite parts and length 1."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(v) == size) & finite & (F.abs(norm(v) - 1) <= tolerance)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def fake_tokens(c: Column) -> Column:
    """words and single signs, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), F.lit(1))


def token_count(c: Column) -> Column:
    """tokens and the two at the ends."""
    return F.size(fake_tokens(c)) + 2


def hash_embedding(c: Column, size: int = 16) -> Column:
    """token counts at the hash of each token (last hex digits; size a power of 16 or less), to length 1; without tokens all 0."""
    digits = 1 if size <= 16 else 2
    place = F.transform(fake_tokens(c), lambda t: (F.conv(F.substring(F.sha2(t, 256), 65 - digits, digits), 16, 10).cast("int") % size))
    each = lambda p: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(p, lambda x: x == i)).cast("double"))
    length = lambda counts: F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    scaled = lambda counts, n: F.when(n > 0, F.transform(counts, lambda x: x / n)).otherwise(counts)
    return once(place, lambda p: once(each(p), lambda counts: once(length(counts), lambda n: scaled(counts, n))))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where Spark computes the value once a row: inside of lambdas it would be computed again for each element."""
    return F.transform(F.array(value), use)[0]


def similarity(distance: Column) -> Column:
    """1 / (1 + d), null for no or a negative distance."""
    return F.when(distance >= 0, 1 / (1 + distance))


def status_lattice(states: Column) -> Column:
    """F32: the status of merged items: rejected and verified together are a conflict, else the strongest one."""
    has = lambda s: F.array_contains(states, s)
    return F.when(has("verified") & has("rejected"), "conflict").when(has("verified"), "verified").when(has("rejected"), "rejected").when(has("pending"), "pending").otherwise("unverified")


def video_id(url: Column) -> Column:
    """The id of a video: the v of the query, or the path of a short or embedded link."""
    query = F.nullif(F.regexp_extract(url, r"[?&]v=([A-Za-z0-9_-]{6,})", 1), F.lit(""))
    path = F.nullif(F.regexp_extract(url, r"(?:youtu\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{6,})", 1), F.lit(""))
    return F.coalesce(query, path)
