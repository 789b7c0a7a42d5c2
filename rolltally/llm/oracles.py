"""SQL for the corpus queries that SQL can express on the test tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op7_warc": """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), last AS (
    SELECT payload_digest, payload_bytes, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY ALL
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < original THEN original END AS refers_to
FROM p LEFT JOIN last USING (payload_digest, payload_bytes)
""",
}
