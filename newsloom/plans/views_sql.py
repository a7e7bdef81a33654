"""The derived views as DuckDB SQL, for the oracles."""

from newsloom.plans.registry import CTES

CTES["articles"] = """
SELECT d.doc_id AS article_id,
  concat('https://', d.source, '.example.com/', d.lang, '/', cast(d.doc_id AS varchar)) AS url,
  coalesce(nullif(substr(split_part(d.text, chr(10), 1), 1, 80), ''), 'No Title') AS title,
  d.text AS content, d.source, d.lang,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(cast(d.doc_id % 720 AS int)) AS published_at,
  TIMESTAMP '2024-01-01 01:00:00' + to_hours(cast(d.doc_id % 720 AS int)) AS scraped_at,
  CASE WHEN e.vec_id IS NOT NULL AND d.doc_id % 10 < 8 THEN
    CASE e.label % 4 WHEN 0 THEN 'World' WHEN 1 THEN 'Sports' WHEN 2 THEN 'Business' ELSE 'Sci/Tech' END END AS topic,
  CASE WHEN e.vec_id IS NOT NULL AND d.doc_id % 10 < 8
    THEN 0.5::double + (d.doc_id % 50) / 100.0::double END AS topic_confidence,
  CASE WHEN e.vec_id IS NOT NULL AND d.doc_id % 10 < 8 THEN e.vec_id END AS embedding_id,
  CASE WHEN e.vec_id IS NOT NULL AND d.doc_id % 10 < 8 THEN 'completed'
       WHEN d.doc_id % 10 = 9 THEN 'failed' ELSE 'pending' END AS processing_status,
  CASE WHEN e.vec_id IS NOT NULL AND d.doc_id % 10 < 8
    THEN TIMESTAMP '2024-01-01 02:00:00' + to_hours(cast(d.doc_id % 720 AS int)) END AS processed_at,
  CASE WHEN NOT (e.vec_id IS NOT NULL AND d.doc_id % 10 < 8) AND d.doc_id % 10 = 9
    THEN 'content is null' END AS processing_error,
  cast(NULL AS varchar) AS author, cast(NULL AS varchar) AS image_url
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
"""

CTES["users"] = """
SELECT user_id, concat('user', cast(user_id AS varchar), '@example.com') AS email, min(ts) AS created_at
FROM events WHERE user_id >= 1 AND user_id % 10 <> 9 GROUP BY user_id
"""

CTES["interactions_raw"] = """
SELECT event_id, user_id, cast(json_extract_string(props, '$.k') AS bigint) AS article_id,
  CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'like'
                  WHEN 'error' THEN 'skip' ELSE event_type END AS interaction_type,
  ts, CASE WHEN event_type = 'view' AND event_id % 5 <> 0 THEN cast(floor(value) AS int) END AS read_time_seconds
FROM events
"""

CTES["messages"] = """
SELECT conv_id AS conversation_id, conv_id % 150 AS user_id, turn, role,
  CASE WHEN role = 'assistant' THEN concat(text, ' [', cast(turn % 7 AS varchar), '][1]') ELSE text END AS content,
  TIMESTAMP '2024-01-01 00:00:00'
    + to_hours(cast(conv_id % 700 + CASE WHEN turn >= 4 THEN 2 ELSE 0 END AS int))
    + to_minutes(cast(turn * 5 AS int)) AS created_at
FROM conversations
"""

CTES["vectors"] = """
SELECT vec_id AS article_id, vec_id AS position, embedding::double[] AS embedding FROM embeddings
"""

CTES["feedback"] = """
SELECT conversation_id, user_id, turn AS message_id, (conversation_id * 7 + turn) % 5 + 1 AS rating,
  created_at AS ts
FROM messages WHERE role = 'assistant'
"""

CTES["feed_entries"] = """
SELECT page_id, url, html, concat('feed', cast(page_id % 8 AS varchar)) AS feed,
  CASE WHEN page_id % 7 <> 0 THEN concat('Entry ', cast(page_id AS varchar)) END AS entry_title,
  CASE WHEN page_id % 3 <> 0 THEN concat('writer', cast(page_id % 5 AS varchar)) END AS first_author,
  CASE WHEN page_id % 11 <> 0 THEN make_timestamp(2024, 1, page_id % 28 + 1, page_id % 24, page_id % 60,
    (page_id % 60)::double) END AS published_at
FROM pages
"""

# Accepted and compacted interactions.
CTES["accepted"] = """
SELECT r.* FROM interactions_raw r
WHERE user_id >= 1 AND article_id >= 1 AND interaction_type IN ('click', 'read', 'like', 'skip')
  AND (read_time_seconds IS NULL OR read_time_seconds >= 0)
  AND EXISTS (SELECT 1 FROM users u WHERE u.user_id = r.user_id)
  AND EXISTS (SELECT 1 FROM articles a WHERE a.article_id = r.article_id)
"""

CTES["live_likes"] = """
SELECT event_id, user_id, article_id, interaction_type, ts, read_time_seconds FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, article_id ORDER BY ts, event_id) AS rn,
    count(*) OVER (PARTITION BY user_id, article_id) AS n
  FROM accepted WHERE interaction_type = 'like') WHERE rn = n AND n % 2 = 1
"""

CTES["live_reads"] = """
SELECT event_id, user_id, article_id, interaction_type, last_ts AS ts, last_rt AS read_time_seconds FROM (
  SELECT *, row_number() OVER w AS rn, max(ts) OVER (PARTITION BY user_id, article_id) AS last_ts,
    last_value(read_time_seconds IGNORE NULLS) OVER (PARTITION BY user_id, article_id ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_rt
  FROM accepted WHERE interaction_type = 'read' WINDOW w AS (PARTITION BY user_id, article_id ORDER BY ts, event_id))
WHERE rn = 1
"""

CTES["interactions"] = """
SELECT event_id, user_id, article_id, interaction_type, ts, read_time_seconds
FROM accepted WHERE interaction_type IN ('click', 'skip')
UNION ALL SELECT * FROM live_likes UNION ALL SELECT * FROM live_reads
"""
