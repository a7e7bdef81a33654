"""Named queries: conversations (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from newsloom.operators import chat as J
from newsloom.plans.registry import CTES, query
from newsloom.sources import views as V

COLS = "conversation_id, user_id, turn, role, content, created_at"

CTES["chat_sessions"] = """
SELECT conversation_id, user_id, cast(session_no AS int) AS session_no, min(created_at) AS started,
  max(created_at) AS ended, count(*) AS messages FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY conversation_id ORDER BY created_at, turn) AS session_no FROM (
    SELECT *, CASE WHEN epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY conversation_id
      ORDER BY created_at, turn)) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM messages)) GROUP BY 1, 2, 3
"""


@query(
    "chat_memory",
    f"""
SELECT {COLS}, cast(rn AS int) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id, conversation_id
  ORDER BY created_at DESC, turn DESC) AS rn FROM messages) WHERE rn <= 10
""",
)
def chat_memory(spark, d) -> DataFrame:
    return J.chat_memory(V.messages(spark, d))


@query("chat_live_sessions", "SELECT * FROM chat_sessions")
def chat_live_sessions(spark, d) -> DataFrame:
    return J.chat_live_sessions(V.messages(spark, d))


@query(
    "chat_context",
    """
SELECT conversation_id, turn, coalesce(string_agg(line, chr(10) ORDER BY back DESC), '') AS context FROM (
  SELECT m.conversation_id, m.turn, p.role || ': ' || p.content AS line, m.turn - p.turn AS back
  FROM messages m LEFT JOIN messages p ON p.conversation_id = m.conversation_id AND p.turn BETWEEN m.turn - 3 AND m.turn - 1)
GROUP BY 1, 2
""",
)
def chat_context(spark, d) -> DataFrame:
    return J.chat_context(V.messages(spark, d), 3)


@query(
    "chat_volume_7d",
    """
SELECT count(*) AS messages FROM messages
WHERE created_at > (SELECT max(created_at) FROM messages) - INTERVAL 7 DAYS
""",
)
def chat_volume_7d(spark, d) -> DataFrame:
    return J.chat_volume(V.messages(spark, d), 7)


@query(
    "assistant_length",
    "SELECT round(avg(length(content)), 6) AS avg_length FROM messages WHERE role = 'assistant'",
)
def assistant_length(spark, d) -> DataFrame:
    return J.assistant_length(V.messages(spark, d))


@query("chat_history", f"SELECT {COLS} FROM messages WHERE conversation_id = 7")
def chat_history(spark, d) -> DataFrame:
    return J.chat_history(V.messages(spark, d), 7)


@query(
    "chat_clear",
    f"""
SELECT {COLS} FROM messages WHERE conversation_id NOT IN (SELECT conversation_id FROM feedback WHERE rating = 1)
""",
)
def chat_clear(spark, d) -> DataFrame:
    """Clear every conversation that got the lowest rating."""
    bad = V.feedback(spark, d).where("rating = 1").select("conversation_id").distinct()
    return J.chat_clear(V.messages(spark, d), bad).select(*COLS.split(", "))


@query(
    "chat_feedback_stats",
    """
SELECT conversation_id, count(*) AS ratings, round(avg(rating), 6) AS mean_rating,
  round(avg((rating >= 4)::int), 6) AS satisfied FROM feedback GROUP BY 1
""",
)
def chat_feedback_stats(spark, d) -> DataFrame:
    return J.chat_feedback_stats(V.feedback(spark, d))


@query(
    "chat_ab",
    """
WITH t AS (SELECT a.user_id, (epoch_us(a.created_at) - epoch_us(q.created_at)) / 1e6 AS s FROM messages a
  JOIN messages q ON q.conversation_id = a.conversation_id AND q.turn = a.turn - 1
  WHERE a.role = 'assistant' AND q.role = 'user')
SELECT x.version, cast(CASE x.version WHEN 'v1' THEN 5 ELSE 10 END AS int) AS k, answers, avg_seconds, avg_rating FROM
  (SELECT CASE WHEN user_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS version, count(*) AS answers,
    round(avg(s), 6) AS avg_seconds FROM t GROUP BY 1) x
LEFT JOIN (SELECT CASE WHEN user_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS version, round(avg(rating), 6) AS avg_rating
  FROM feedback GROUP BY 1) y USING (version)
""",
)
def chat_ab(spark, d) -> DataFrame:
    return J.chat_ab(V.messages(spark, d), V.feedback(spark, d))
