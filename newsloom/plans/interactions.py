"""Named queries: interaction rules (C)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from newsloom.operators import interactions as C
from newsloom.plans.registry import query
from newsloom.sources import views as V

COLS = "event_id, user_id, article_id, interaction_type, ts, read_time_seconds"


@query(
    "interaction_validate",
    f"""
SELECT {COLS}, CASE WHEN NOT coalesce(user_id >= 1, false) THEN 'user_id'
  WHEN NOT coalesce(article_id >= 1, false) THEN 'article_id'
  WHEN NOT coalesce(interaction_type IN ('click', 'read', 'like', 'skip'), false) THEN 'interaction_type'
  WHEN read_time_seconds < 0 THEN 'read_time_seconds' END AS reason FROM interactions_raw
""",
)
def interaction_validate(spark, d) -> DataFrame:
    return C.interaction_validate(V.interactions_raw(spark, d))


@query(
    "interaction_fk_check",
    f"""
SELECT {COLS}, CASE WHEN user_id NOT IN (SELECT user_id FROM users) THEN 'user not found'
  WHEN article_id NOT IN (SELECT article_id FROM articles) THEN 'article not found' END AS reason
FROM interactions_raw
WHERE user_id >= 1 AND article_id >= 1 AND interaction_type IN ('click', 'read', 'like', 'skip')
  AND (read_time_seconds IS NULL OR read_time_seconds >= 0)
""",
)
def interaction_fk_check(spark, d) -> DataFrame:
    valid = C.valid_interactions(V.interactions_raw(spark, d))
    return C.interaction_fk_check(valid, V.users(spark, d), V.article_ids(spark, d))


def accepted(spark, d) -> DataFrame:
    return C.accepted_interactions(V.interactions_raw(spark, d), V.users(spark, d), V.article_ids(spark, d))


@query("like_toggle", f"SELECT {COLS} FROM live_likes")
def like_toggle(spark, d) -> DataFrame:
    return C.like_toggle(accepted(spark, d))


@query("read_upsert", f"SELECT {COLS} FROM live_reads")
def read_upsert(spark, d) -> DataFrame:
    return C.read_upsert(accepted(spark, d))


@query("interactions_compact", f"SELECT {COLS} FROM interactions")
def interactions_compact(spark, d) -> DataFrame:
    return C.interactions_compact(V.interactions_raw(spark, d), V.users(spark, d), V.article_ids(spark, d))
