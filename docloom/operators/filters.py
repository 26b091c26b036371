"""Predicates, classifiers and projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes by class of a course file.
FILE_CLASSES = (
    ("subtitle", ("srt", "vtt")), ("transcript", ("txt",)), ("audio", ("mp3", "m4a", "wav", "ogg")), ("video", ("mp4", "webm", "mkv", "mov")),
    ("document", ("pdf", "docx", "html", "htm", "md")), ("code", ("py", "c", "h", "js", "java", "sql", "ipynb")), ("archive", ("zip",)),
    ("image", ("png", "jpg", "jpeg", "gif", "svg")), ("table", ("csv", "parquet", "json")),
)


def blocks_of(df: DataFrame, kinds: tuple[str, ...], kind: str, text: str) -> DataFrame:
    """Blocks of the wanted kinds with text in them."""
    return df.where(F.col(kind).isin(*kinds) & (F.trim(text) != ""))


def exclusion(toc: Column, link: Column, text: Column, listed: Column, table: Column) -> Column:
    """Why a block isn't aggregated, the first reason that holds; null where it is."""
    empty = F.trim(F.coalesce(text, F.lit(""))) == ""
    return F.when(toc, "toc").when(link, "reference").when(listed & empty, "empty_list").when(table, "table").when(empty, "non_text")


def matches_text(column: str, needle: str, case: bool = False) -> Column:
    """Whether a field contains a text, in any case unless asked for."""
    return F.contains(F.col(column), F.lit(needle)) if case else F.contains(F.lower(column), F.lower(F.lit(needle)))


def is_fact(c: Column) -> Column:
    """20 characters at least, and no commentary or guideline heading."""
    text = F.trim(c)
    return (F.length(text) >= 20) & ~F.regexp_like(F.lower(text), F.lit("^(kommentar|leitlinie)"))


def cues(c: Column, rules: dict[str, str]) -> Column:
    """The names of the patterns that a text matches, in the order of the rules."""
    return F.array_compact(F.array(*(F.when(F.regexp_like(c, F.lit(p)), F.lit(name)) for name, p in rules.items())))


def link_class(url: Column, title: Column) -> Column:
    """Video, script, material or other, by address and title."""
    u, t = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    video = F.regexp_like(u, F.lit(r"youtube\.|youtu\.be|vimeo\.|\.mp4([?#]|$)"))
    script = F.regexp_like(u, F.lit(r"\.pdf([?#]|$)")) | F.regexp_like(t, F.lit("script|skript"))
    return F.when(video, "video").when(script, "script").when(F.regexp_like(u, F.lit(r"\.(html?|zip|docx?|pptx?)([?#]|$)")), "material").otherwise("other")


def link_relation(url: Column, host: str) -> Column:
    """Anchor, external, document, page, or another scheme."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    target = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    document = F.regexp_like(url, F.lit(r"(?i)\.(pdf|docx?|zip|ipynb|csv)([?#]|$)"))
    return (
        F.when(url.startswith("#"), "anchor").when((scheme != "") & ~scheme.isin("http", "https"), "other_scheme")
        .when((target != "") & (target != host) & ~target.endswith(f".{host}"), "external").when(document, "document").otherwise("page")
    )


def url_language(url: Column, languages: tuple[str, ...]) -> Column:
    """The language that the path names."""
    return F.nullif(F.regexp_extract(url, rf"^[a-z]+://[^/]+/({'|'.join(languages)})/", 1), F.lit(""))


def file_class(name: Column) -> Column:
    """Class of a file by its suffix."""
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("other")
    for kind, suffixes in reversed(FILE_CLASSES):
        out = F.when(suffix.isin(*suffixes), kind).otherwise(out)
    return out


def lecture_number(name: Column) -> Column:
    """The dotted index before the first underscore, null where there is none."""
    first = F.split(name, "_")[0]
    return F.when(F.regexp_like(first, F.lit(r"^\d+(\.\d+)*$")), first)


def needs_visual(status: Column, reason: Column, terms: tuple[str, ...]) -> Column:
    """Not verified, and the reason names one of the terms."""
    named = F.lit(False)
    for t in terms:
        named = named | F.contains(F.lower(reason), F.lit(t))
    return (status != "verified") & named


def line_class(text: Column) -> Column:
    """P25: bullet, heading (under ten words, no sentence end), body or other."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    ends = F.regexp_like(text, F.lit(r"[.!?]\s*$"))
    return F.when(F.trim(text) == "", "other").when(F.regexp_like(text, F.lit(r"^\s*([-*•]|\d+[.)])\s")), "bullet").when((words < 10) & ~ends, "heading").when(ends, "body").otherwise("other")


def payload(df: DataFrame, fields: list[str]) -> Column:
    """The fields that are there, as a map of strings."""
    pairs = F.map_from_arrays(F.array(*(F.lit(f) for f in fields)), F.array(*(F.col(f).cast("string") for f in fields)))
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def evidence_times(evidence: str) -> tuple[Column, Column]:
    """The smallest start and the largest end of an array of (start, end), null where it is empty."""
    return F.array_min(F.transform(evidence, lambda e: e["start"])), F.array_max(F.transform(evidence, lambda e: e["end"]))


def expanded_queries(title: str, topics: str) -> Column:
    """The title, then the title with each topic."""
    return F.concat(F.array(F.col(title)), F.transform(topics, lambda t: F.concat(F.col(title), F.lit(": "), t)))


def renamed(df: DataFrame, separator: str) -> DataFrame:
    """Columns named by what stands before the separator."""
    return df.toDF(*(c.split(separator)[0] for c in df.columns))


def subtitle_choice(df: DataFrame, key: str, languages: str, preferred: tuple[str, ...]) -> DataFrame:
    """Per key the preferred language that is offered: exactly named before the first variant of it; null where none is."""
    offers = df.select(key, F.explode_outer(languages).alias("lang"))
    ranks = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(preferred))):
        ranks = F.when(F.col("lang") == p, 2 * i).when(F.col("lang").startswith(f"{p}-"), 2 * i + 1).otherwise(ranks)
    ranked = offers.withColumn("_rank", ranks)
    return ranked.groupBy(key).agg(F.min(F.when(F.col("_rank").isNotNull(), F.struct("_rank", "lang")))["lang"].alias("lang"))


def parser_of(suffix: Column, role: Column) -> Column:
    """(parser, status, reason) for a file."""
    def out(parser: str | None, status: str, reason: str | None) -> Column:
        return F.struct(F.lit(parser).cast("string").alias("parser"), F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))

    return (
        F.when(role != "primary", out(None, "skipped", "not_primary")).when(suffix.isin("html", "htm"), out("html", "ready", None)).when(suffix.isin("srt", "vtt", "txt"), out("transcript", "ready", None))
        .when(suffix.isin("py", "c", "js", "sql"), out("code", "ready", None)).when(suffix == "md", out("markdown", "ready", None)).when(suffix == "ipynb", out("notebook", "ready", None)).otherwise(out(None, "unsupported", "format"))
    )
