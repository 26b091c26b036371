"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: The query reads pages step by step; here regular expressions do, for whole pages and the references that the tables hold.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
HIDDEN = ("script", "style", "head", "template", "noscript")
BREAKING = "address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"


def _uuid(kind: str, *parts: str) -> str:
    h = f"sha256(concat_ws(chr(1), '{kind}', {', '.join(f"coalesce({p}::varchar, chr(0))" for p in parts)}))"
    return f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-8' || h[14:16] || '-a' || h[18:20] || '-' || h[21:32] || '>' FROM (SELECT {h} AS h))"


def _text(column: str) -> str:
    text = f"regexp_replace({column}, '<!--.*?-->', ' ', 'gs')"
    for tag in HIDDEN:
        text = f"regexp_replace({text}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'gsi')"
    text = f"regexp_replace({text}, '</?(?:{BREAKING})\\b[^>]*>', chr(10), 'gi')"
    text = f"regexp_replace({text}, '<[A-Za-z/!?][^>]*>', '', 'g')"
    for name, character in ENTITIES:
        text = f"replace({text}, '{name.replace("'", "''")}', '{character.replace("'", "''")}')"
    text = f"regexp_replace({text}, '[ \\t\\r\\f]+', ' ', 'g')"
    text = f"regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({text}, '^[ \\n]+|[ \\n]+$', '', 'g')"


def _title(column: str) -> str:
    """The first title, its references decoded as those of the text are."""
    title = f"regexp_extract({column}, '<title\\b[^>]*>(.*?)</title\\s*>', 1, 'si')"
    for name, character in ENTITIES:
        title = f"replace({title}, '{name}', '{character}')"
    return f"regexp_replace(regexp_replace({title}, '[ \\t\\r\\n\\f]+', ' ', 'g'), '^ | $', '', 'g')"


OP7 = f"""
WITH responses AS (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS html, {_uuid("response", "page_id", "url", "md5(html)")} AS refers_to FROM pages
), texts AS (
  SELECT *, {_text("html")} AS text, 'sha256:' || sha256(html) AS source_digest, 'Content-Type: text/html; charset=utf-8' || chr(10) || 'Content-Length: ' || strlen(html) AS source_headers,
    {_title("html")} AS title
  FROM responses
), records AS (
  SELECT page_id, 'conversion' AS warc_type, refers_to, target_uri, 'text/plain' AS content_type, source_digest, source_headers, text AS block FROM texts
  UNION ALL
  SELECT page_id, 'metadata', refers_to, target_uri, 'application/warc-fields', source_digest, source_headers,
    concat_ws(chr(13) || chr(10), 'title: ' || title, 'source-length: ' || strlen(html), 'text-length: ' || strlen(text),
      'links: ' || len(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=')), 'source-digest: ' || source_digest)
  FROM texts
)
SELECT page_id, warc_type, {_uuid("derivative", "refers_to", "warc_type")} AS record_id, refers_to, target_uri, '2024-01-01T00:00:00Z' AS date,
  content_type, strlen(block) AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest,
  source_headers, block
FROM records
"""


def _codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Plain Lloyd rounds: every part against every entry of its codebook."""
    away = "list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    steps = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, list_transform(embedding, lambda x: floor(x::double * 256)::bigint)) AS n, vec_id, label,
    list_transform(embedding, lambda x: floor(x::double * 256)::bigint) AS vector
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT n, p, vector[p * (len(vector) // {parts}) + 1 : (p + 1) * (len(vector) // {parts})] AS x FROM kept, range({parts}) t(p)
), b0 AS (SELECT p, n - 1 AS e, x FROM v WHERE n <= {entries})"""
    for i in range(rounds + 1):
        steps += f""", a{i} AS MATERIALIZED (
  SELECT v.n, v.p, any_value(v.x) AS x, min(({away}, b.e)) AS best FROM v JOIN b{i} b USING (p) GROUP BY v.n, v.p
)"""
        if i < rounds:
            steps += f""", m{i} AS (SELECT p, best[2] AS e, unnest(x) AS c, generate_subscripts(x, 1) AS k FROM a{i}
), s{i} AS (SELECT p, e, list(mean ORDER BY k) AS x FROM (SELECT p, e, k, (sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS mean FROM m{i} GROUP BY p, e, k) GROUP BY p, e
), b{i + 1} AS (SELECT b.p, b.e, coalesce(s.x, b.x)::bigint[] AS x FROM b{i} b LEFT JOIN s{i} s USING (p, e))"""
    return f"""{steps}, d AS (SELECT n, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::bigint AS error FROM a{rounds} GROUP BY n
), h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256 FROM kept JOIN d USING (n), h
"""


OP13 = _codes()
