"""Queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from intervale.llm import bpe, decontaminate, near_dedup, outliers, quality, repeats, token_counts, token_store, url_reputation, web_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality.query,
    "op2_token_store": token_store.query,
    "op3_token_counts": token_counts.query,
    "op4_quality_rules": outliers.query,
    "op5_near_dedup": near_dedup.query,
    "op6_url_filters": url_reputation.query,
    "op7_bpe": bpe.query,
    "op8_decontamination": decontaminate.query,
    "op9_web_archive": web_archive.query,
    "op10_repeats": repeats.query,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SHINGLES = """list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)"""

ORACLES: dict[str, str] = {
    "op5_near_dedup": f"""
WITH RECURSIVE sets AS (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, cast(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least l ON l.a = s.doc_id""",
    "op6_url_filters": r"""
WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
    FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
outcomes AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1 OR (quality IS NOT NULL AND toxic IS NOT NULL)) GROUP BY doc_id),
named AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '\.?(:[0-9]*)?$', '') AS name FROM parts LEFT JOIN outcomes USING (page_id) GROUP BY host),
hosts AS (SELECT host, n, bad, name, string_split(name, '.') AS l, CASE WHEN regexp_matches(name, '^([0-9]+\.){3}[0-9]+$|^\[.*\]$') THEN 0
        WHEN regexp_matches(name, '(^|\.)(@GENERIC@)\.[a-z][a-z]$') THEN 2 ELSE 1 END AS k FROM named),
tree AS (SELECT host, n, bad, CASE WHEN k = 0 THEN name ELSE array_to_string(l[-k:], '.') END AS suffix, CASE WHEN k = 0 THEN name ELSE array_to_string(l[-(k + 1):], '.') END AS domain FROM hosts),
l1 AS (SELECT suffix AS id, '' AS up, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM tree GROUP BY suffix),
l2 AS (SELECT domain AS id, suffix AS up, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM tree GROUP BY domain, suffix),
l3 AS (SELECT host AS id, domain AS up, n::DOUBLE AS n, bad::DOUBLE AS bad FROM tree),
every AS (SELECT 1 AS lv, * FROM l1 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 3, * FROM l3),
sums AS (SELECT lv, count(*) AS m, sum(n) AS nn, sum(n * n) AS n2, sum(bad) AS b, sum(bad * bad / n) AS s FROM every WHERE n > 0 GROUP BY lv),
var AS (SELECT lv, m, nn, (s - b * b / nn) / nullif(m - 1, 0) AS bt, (b - s) / nullif(nn - m, 0) AS wi, (nn - n2 / nn) / nullif(m - 1, 0) AS sz FROM sums),
weights AS (SELECT lvs.lv, greatest(least(coalesce(CASE WHEN m > 1 AND nn > m AND bt > wi AND wi >= 0 THEN (bt + (sz - 1) * wi) / (bt - wi) - 1 END, 10000), 10000), 1) AS w FROM (VALUES (1), (2), (3)) lvs(lv) LEFT JOIN var USING (lv)),
root AS (SELECT (sum(bad) + 1.0) / (sum(n) + 2.0) AS mean FROM hosts),
p1 AS (SELECT id, (mean * w + bad) / (w + n) AS mean FROM l1, root, weights WHERE lv = 1),
p2 AS (SELECT l2.id, (mean * w + bad) / (w + n) AS mean FROM l2 JOIN p1 ON p1.id = l2.up, weights WHERE lv = 2),
p3 AS (SELECT l3.id, mean * w + bad AS a, (1 - mean) * w + n - bad AS b FROM l3 JOIN p2 ON p2.id = l3.up, weights WHERE lv = 3),
odds AS (SELECT *, 1 / (2 * a - 1) AS p, 1 / (2 * b - 1) AS q, 2 / (1 / (2 * a - 1) + 1 / (2 * b - 1)) AS h, (1.6448536269514722 ** 2 - 3) / 6 AS g FROM p3),
bounds AS (SELECT id, CASE WHEN a <= 1 OR b <= 1 THEN pow(0.05, 1 / a) ELSE a / (a + b * exp(2 * (1.6448536269514722 * sqrt(h + g) / h - (q - p) * (g + 5.0 / 6 - 2 / (3 * h))))) END AS bound FROM odds)
SELECT page_id, parts.host, parts.path, rule, coalesce(v, CASE WHEN bound >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits ON fits.host = parts.host AND fits.path = parts.path JOIN bounds ON bounds.id = parts.host""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
b AS (SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
items AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM b)
SELECT doc_id, item_id, count(*) AS n_shared, cast(n AS BIGINT) AS n_item
FROM (SELECT doc_id, unnest(s) AS g FROM d) JOIN items USING (g) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n""",
    "op9_web_archive": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, cast(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest, min(page_id) OVER (PARTITION BY sha256(b)) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM q""",
}
ORACLES["op6_url_filters"] = ORACLES["op6_url_filters"].replace("@GENERIC@", "|".join(url_reputation.GENERIC))
