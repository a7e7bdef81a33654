"""The article and user query surface: filters, pages, counts, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.functions.scale import r6

LIST_VIEW = ("article_id", "title", "url", "source", "published_at", "topic")
DETAIL_VIEW = (
    "article_id", "title", "url", "source", "published_at", "topic",
    "content", "scraped_at", "topic_confidence", "author", "image_url",
)


def check_range(name: str, value: int, low: int, high: int | None) -> None:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be at least {low}" + (f" and at most {high}" if high is not None else ""))


def newest_first(time: str, key: str) -> list[Column]:
    return [F.col(time).desc_nulls_last(), F.col(key).desc()]


def list_view(articles: DataFrame) -> DataFrame:
    return articles.select(*LIST_VIEW)


def detail_view(articles: DataFrame) -> DataFrame:
    return articles.select(*DETAIL_VIEW)


def articles_page(
    articles: DataFrame, skip: int = 0, limit: int = 20, topic: str | None = None, source: str | None = None
) -> DataFrame:
    """One page of the list view, newest first; an empty filter is no filter."""
    check_range("skip", skip, 0, None)
    check_range("limit", limit, 1, 100)
    if topic:
        articles = articles.where(F.col("topic") == topic)
    if source:
        articles = articles.where(F.col("source").contains(source))
    ordered = articles.orderBy(*newest_first("scraped_at", "article_id"))
    return list_view(ordered.offset(skip).limit(limit))


def articles_count(articles: DataFrame, topic: str | None = None) -> DataFrame:
    if topic:
        articles = articles.where(F.col("topic") == topic)
    return articles.agg(F.count(F.lit(1)).alias("count"))


def articles_recent(articles: DataFrame, limit: int = 10) -> DataFrame:
    check_range("limit", limit, 1, 50)
    return list_view(articles.orderBy(*newest_first("scraped_at", "article_id")).limit(limit))


def article_by_id(articles: DataFrame, article_id: int) -> DataFrame:
    """The detail row, or no row when there is no such article."""
    return detail_view(articles.where(F.col("article_id") == article_id))


def topic_distribution(articles: DataFrame) -> DataFrame:
    return articles.where(F.col("topic").isNotNull()).groupBy("topic").agg(F.count(F.lit(1)).alias("articles"))


def system_stats(articles: DataFrame, users: DataFrame, interactions: DataFrame) -> DataFrame:
    """Table sizes and topic counts as (metric, value)."""
    rows = F.count(F.lit(1)).alias("value")
    sizes = [
        df.agg(rows).select(F.lit(name).alias("metric"), "value")
        for name, df in (
            ("total_articles", articles), ("total_users", users), ("total_interactions", interactions)
        )
    ]
    topics = topic_distribution(articles).select(
        F.concat(F.lit("topic:"), "topic").alias("metric"), F.col("articles").alias("value")
    )
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).unionByName(topics)


def confidence_by_topic(articles: DataFrame) -> DataFrame:
    return (
        articles.where(F.col("topic").isNotNull())
        .groupBy("topic")
        .agg(r6(F.avg("topic_confidence")).alias("avg_confidence"), F.count(F.lit(1)).alias("articles"))
    )


def recent_processed(articles: DataFrame, limit: int = 5) -> DataFrame:
    return (
        articles.where(F.col("processing_status") == "completed")
        .orderBy(*newest_first("processed_at", "article_id"))
        .select("article_id", "title", "topic", "topic_confidence", "processed_at")
        .limit(limit)
    )


def unclassified_articles(articles: DataFrame, limit: int = 10) -> DataFrame:
    return (
        articles.where(F.col("topic").isNull()).orderBy("article_id").select("article_id", "title", "url").limit(limit)
    )


def user_history(interactions: DataFrame, user_id: int, limit: int = 50) -> DataFrame:
    """A user's interactions, newest first."""
    check_range("limit", limit, 1, 200)
    return (
        interactions.where(F.col("user_id") == user_id).orderBy(*newest_first("ts", "event_id")).limit(limit)
    )


def all_user_histories(interactions: DataFrame, limit: int = 50) -> DataFrame:
    """The same for every user at once; rows beyond the limit are dropped before the shuffle."""
    check_range("limit", limit, 1, 200)
    w = Window.partitionBy("user_id").orderBy(*newest_first("ts", "event_id"))
    return interactions.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
