"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]"


def _base32(digest: str) -> str:
    """Every 5 hexadecimal digits are 20 bits, so 4 letters."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    parts = []
    for i in range(8):
        bits = f"('0x' || substr({digest}, {5 * i + 1}, 5))::BIGINT"
        parts += [f"substr({letters}, (({bits} >> {shift}) & 31)::INT + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(parts)


WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, lower(url) AS url FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS digest,
             regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www[.]', '') AS host,
             regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
             regexp_extract(url, '[?][^#]*') AS query,
             strftime(make_timestamp((1577836800 + page_id % 315360000) * 1000000), '%Y%m%d%H%M%S') AS timestamp FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first,
             array_to_string(list_reverse(string_split(host, '.')), ',') || ')' ||
             CASE WHEN path = '' THEN '/' ELSE path END || query AS urlkey FROM d)
SELECT page_id, payload_bytes, {_base32('digest')} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       urlkey, timestamp, row_number() OVER (ORDER BY urlkey, timestamp, page_id) - 1 AS rank
FROM f
"""

# rule, share in ten-thousandths, whether zeros count, multiple of the spread, least spread
_RULES = [("symbol_share", "n_symbols", "word_chars", True, 3, 100), ("upper_share", "n_upper", "n_words", False, 16, 20),
          ("dup_line_share", "n_dup_lines", "n_lines", False, 4, 500),
          ("repeat_share", "n_repeat_words", "n_words", False, 12, 100), ("word_length", "word_chars", "n_words", True, 5, 500)]


def _fences(name: str, group: str) -> str:
    """Fence per group and rule from its bucket counts."""
    keys = f"{group}, " if group else ""
    quartile = "min(value) FILTER (upto > 0 AND upto * 4 >= whole * {})"
    return f"""
{name}_run AS (SELECT {keys}rule, value, reach, least,
    sum(n) OVER (PARTITION BY {keys}rule) AS whole, sum(n) OVER (PARTITION BY {keys}rule ORDER BY value) AS upto
  FROM (SELECT {keys}rule, value, reach, least, count(*) FILTER (zeros OR value > 0) AS n FROM buckets GROUP BY ALL)),
{name} AS (SELECT {keys}rule, max(whole) AS texts, {quartile.format(3)} + any_value(reach)
      * greatest({quartile.format(3)} - {quartile.format(1)}, any_value(least)) AS most
  FROM {name}_run GROUP BY ALL)"""


def _pooled(texts: str, most: str, coarser: str) -> str:
    return f"coalesce(({texts} * {most} + 50 * {coarser}) // ({texts} + 50), {coarser}, {most})"


QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}+') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
t AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM t),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY rid),
m AS (SELECT rid, doc_id, lang, source, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(regexp_extract_all(text, '\\p{{L}}+'), lambda x: regexp_full_match(x, '\\p{{Lu}}{{2,}}')))::BIGINT AS n_upper
  FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
s AS ({' UNION ALL '.join(f"SELECT rid, lang, source, base_failed, '{n}' AS rule, {zero} AS zeros, {k} AS reach, {f} AS least, ({a} * 10000) // greatest({z}, 1) AS share FROM b" for n, a, z, zero, k, f in _RULES)}),
buckets AS (SELECT lang, source, rule, zeros, reach, least,
    (share >> greatest(length(bin(share)) - 7, 0)) << greatest(length(bin(share)) - 7, 0) AS value
  FROM s WHERE NOT base_failed),
{_fences('own', 'lang, source')},
{_fences('by_lang', 'lang')},
{_fences('overall', '')},
chosen AS (SELECT own.lang, own.source, own.rule,
    {_pooled('own.texts', 'own.most', _pooled('by_lang.texts', 'by_lang.most', 'overall.most'))} AS most
  FROM own JOIN by_lang ON own.rule = by_lang.rule AND own.lang IS NOT DISTINCT FROM by_lang.lang
  JOIN overall ON own.rule = overall.rule),
over AS (SELECT rid, bool_or(share > most) AS failed FROM s JOIN chosen ON s.rule = chosen.rule
    AND s.lang IS NOT DISTINCT FROM chosen.lang AND s.source IS NOT DISTINCT FROM chosen.source GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(failed, false) AS kept
FROM b LEFT JOIN over USING (rid)
"""

DIGEST_INDEX = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
    row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id DESC NULLS LAST) AS place FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       place = 1 AS kept, text_sha256
FROM d
"""
