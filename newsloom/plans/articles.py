"""Named queries: article and user surface (B)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from newsloom.operators import articles as B
from newsloom.operators.interactions import interactions_compact
from newsloom.plans.registry import query
from newsloom.sources import views as V

LIST = "article_id, title, url, source, published_at, topic"
DETAIL = LIST + ", content, scraped_at, topic_confidence, author, image_url"


def compacted(spark, d) -> DataFrame:
    return interactions_compact(V.interactions_raw(spark, d), V.users(spark, d), V.article_ids(spark, d))


@query(
    "articles_page",
    f"""
SELECT {LIST} FROM articles WHERE topic = 'Sports' AND contains(source, 'src1')
ORDER BY scraped_at DESC NULLS LAST, article_id DESC LIMIT 20 OFFSET 5
""",
)
def articles_page(spark, d) -> DataFrame:
    return B.articles_page(V.articles(spark, d), skip=5, limit=20, topic="Sports", source="src1")


@query(
    "articles_page_unfiltered",
    f"SELECT {LIST} FROM articles ORDER BY scraped_at DESC NULLS LAST, article_id DESC LIMIT 100 OFFSET 20",
)
def articles_page_unfiltered(spark, d) -> DataFrame:
    return B.articles_page(V.articles(spark, d), skip=20, limit=100, topic="", source="")


@query("articles_count", "SELECT count(*) AS count FROM articles WHERE topic = 'World'")
def articles_count(spark, d) -> DataFrame:
    return B.articles_count(V.articles(spark, d), "World")


@query(
    "articles_recent",
    f"SELECT {LIST} FROM articles ORDER BY scraped_at DESC NULLS LAST, article_id DESC LIMIT 10",
)
def articles_recent(spark, d) -> DataFrame:
    return B.articles_recent(V.articles(spark, d), 10)


@query("article_by_id", f"SELECT {DETAIL} FROM articles WHERE article_id = 42")
def article_by_id(spark, d) -> DataFrame:
    return B.article_by_id(V.articles(spark, d), 42)


@query("article_list_view", f"SELECT {LIST} FROM articles")
def article_list_view(spark, d) -> DataFrame:
    return B.list_view(V.articles(spark, d))


@query("article_projections", f"SELECT {DETAIL} FROM articles")
def article_projections(spark, d) -> DataFrame:
    return B.detail_view(V.articles(spark, d))


@query(
    "topic_distribution",
    "SELECT topic, count(*) AS articles FROM articles WHERE topic IS NOT NULL GROUP BY topic",
)
def topic_distribution(spark, d) -> DataFrame:
    return B.topic_distribution(V.articles(spark, d))


@query(
    "system_stats",
    """
SELECT 'total_articles' AS metric, count(*) AS value FROM articles
UNION ALL SELECT 'total_users', count(*) FROM users
UNION ALL SELECT 'total_interactions', count(*) FROM interactions
UNION ALL SELECT concat('topic:', topic), count(*) FROM articles WHERE topic IS NOT NULL GROUP BY topic
""",
)
def system_stats(spark, d) -> DataFrame:
    return B.system_stats(V.articles(spark, d), V.users(spark, d), compacted(spark, d))


@query(
    "confidence_by_topic",
    """
SELECT topic, round(avg(topic_confidence), 6) AS avg_confidence, count(*) AS articles
FROM articles WHERE topic IS NOT NULL GROUP BY topic
""",
)
def confidence_by_topic(spark, d) -> DataFrame:
    return B.confidence_by_topic(V.articles(spark, d))


@query(
    "recent_processed",
    """
SELECT article_id, title, topic, topic_confidence, processed_at FROM articles WHERE processing_status = 'completed'
ORDER BY processed_at DESC NULLS LAST, article_id DESC LIMIT 5
""",
)
def recent_processed(spark, d) -> DataFrame:
    return B.recent_processed(V.articles(spark, d), 5)


@query(
    "unclassified_articles",
    "SELECT article_id, title, url FROM articles WHERE topic IS NULL ORDER BY article_id LIMIT 10",
)
def unclassified_articles(spark, d) -> DataFrame:
    return B.unclassified_articles(V.articles(spark, d), 10)


@query(
    "user_history",
    """
SELECT event_id, user_id, article_id, interaction_type, ts, read_time_seconds FROM interactions WHERE user_id = 8
ORDER BY ts DESC, event_id DESC LIMIT 50
""",
)
def user_history(spark, d) -> DataFrame:
    return B.user_history(compacted(spark, d), 8, 50)


@query(
    "all_user_histories",
    """
SELECT * FROM (SELECT event_id, user_id, article_id, interaction_type, ts, read_time_seconds,
  cast(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS int) AS rn FROM interactions)
WHERE rn <= 50
""",
)
def all_user_histories(spark, d) -> DataFrame:
    return B.all_user_histories(compacted(spark, d), 50)
