"""Named queries: article lifecycle (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.operators import processing as D
from newsloom.plans.classify import NAME, trained_nb
from newsloom.plans.registry import CTES, query
from newsloom.sources import views as V

NOW = "2024-02-01 00:00:00"

# Articles with one null content in ten, to exercise failures: every id that ends in 3.
CTES["gappy"] = """
SELECT * REPLACE (CASE WHEN article_id % 10 = 3 THEN NULL ELSE content END AS content) FROM articles
"""
CTES["processed"] = f"""
SELECT a.article_id,
  CASE WHEN NOT todo THEN topic WHEN content IS NULL THEN NULL ELSE {NAME.format(c='predicted')} END AS topic,
  CASE WHEN NOT todo THEN topic_confidence WHEN content IS NULL THEN NULL ELSE confidence END AS topic_confidence,
  CASE WHEN NOT todo THEN embedding_id WHEN content IS NULL THEN NULL
    ELSE (SELECT max(embedding_id) FROM gappy) + (row_number() OVER (PARTITION BY todo AND content IS NOT NULL
      ORDER BY a.article_id)) END AS embedding_id,
  CASE WHEN NOT todo THEN processing_status WHEN content IS NULL THEN 'failed' ELSE 'completed' END AS processing_status,
  CASE WHEN todo AND content IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE processed_at END AS processed_at,
  CASE WHEN NOT todo THEN processing_error WHEN content IS NULL THEN 'content is null' END AS processing_error
FROM (SELECT *, processing_status = 'pending' AS todo FROM gappy) a JOIN nb_pred p ON p.article_id = a.article_id
"""
OUT = (
    "article_id", "topic", "topic_confidence", "embedding_id", "processing_status", "processed_at", "processing_error",
)


def gappy(spark, d) -> DataFrame:
    missing = F.col("article_id") % 10 == 3
    return V.articles(spark, d).withColumn("content", F.when(~missing, F.col("content")))


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def processed(spark, d) -> DataFrame:
    return D.process_batch(gappy(spark, d), D.nb_classifier(trained_nb(spark, d)), now(), limit=None).articles


@query(
    "pending_batch",
    "SELECT article_id, title, content FROM articles WHERE processing_status = 'pending' ORDER BY article_id LIMIT 50",
)
def pending_batch(spark, d) -> DataFrame:
    return D.pending_batch(V.articles(spark, d)).select("article_id", "title", "content")


@query("process_batch", "SELECT * FROM processed")
def process_batch(spark, d) -> DataFrame:
    """Every pending article in one go."""
    return processed(spark, d).select(*OUT)


@query(
    "process_batch_limited",
    f"""
WITH b AS (SELECT article_id FROM gappy WHERE processing_status = 'pending' ORDER BY article_id LIMIT 50)
SELECT p.* FROM processed p WHERE article_id IN (SELECT article_id FROM b)
  OR article_id NOT IN (SELECT article_id FROM gappy WHERE processing_status = 'pending')
UNION ALL SELECT {', '.join(OUT)} FROM gappy WHERE processing_status = 'pending'
  AND article_id NOT IN (SELECT article_id FROM b)
""",
)
def process_batch_limited(spark, d) -> DataFrame:
    """One batch of the configured size; the other pending articles stay pending."""
    done = D.process_batch(gappy(spark, d), D.nb_classifier(trained_nb(spark, d)), now())
    return done.articles.select(*OUT)


@query(
    "process_failures",
    "SELECT article_id, processing_status, processing_error FROM processed WHERE processing_status = 'failed'",
)
def process_failures(spark, d) -> DataFrame:
    return processed(spark, d).where("processing_status = 'failed'").select(
        "article_id", "processing_status", "processing_error"
    )


@query(
    "process_result_stats",
    """
SELECT count(*) FILTER (p.processing_status = 'completed') AS processed,
  count(*) FILTER (p.processing_status = 'failed') AS failed, count(*) AS total,
  round(count(*) FILTER (p.processing_status = 'completed') * 100.0::double / count(*), 6) AS success_rate
FROM processed p JOIN gappy g ON g.article_id = p.article_id WHERE g.processing_status = 'pending'
""",
)
def process_result_stats(spark, d) -> DataFrame:
    return D.process_result_stats(D.pending_batch(gappy(spark, d), None), processed(spark, d))


@query(
    "process_one",
    f"""
SELECT article_id, {NAME.format(c='predicted')} AS topic, confidence AS topic_confidence,
  (SELECT max(embedding_id) + 1 FROM articles) AS embedding_id, 'completed' AS processing_status,
  TIMESTAMP '{NOW}' AS processed_at, cast(NULL AS varchar) AS processing_error
FROM nb_pred WHERE article_id = 9
""",
)
def process_one(spark, d) -> DataFrame:
    """Reprocess a failed article."""
    classify = D.nb_classifier(trained_nb(spark, d))
    return D.process_one(V.articles(spark, d), 9, classify, now()).select(*OUT)


STATES = "article_id, processing_status, processing_error, topic, topic_confidence, embedding_id"


@query(
    "reset_failed",
    f"""
SELECT {STATES} FROM (SELECT * REPLACE (
  CASE processing_status WHEN 'failed' THEN 'pending' ELSE processing_status END AS processing_status,
  CASE processing_status WHEN 'failed' THEN NULL ELSE processing_error END AS processing_error) FROM articles)
""",
)
def reset_failed(spark, d) -> DataFrame:
    return D.reset_failed(V.articles(spark, d)).select(*STATES.split(", "))


@query("count_failed", "SELECT count(*) AS reset FROM articles WHERE processing_status = 'failed'")
def count_failed(spark, d) -> DataFrame:
    return D.count_failed(V.articles(spark, d))


@query(
    "reset_all",
    """
SELECT article_id, 'pending' AS processing_status, processing_error, cast(NULL AS varchar) AS topic,
  cast(NULL AS double) AS topic_confidence, cast(NULL AS bigint) AS embedding_id FROM articles
""",
)
def reset_all(spark, d) -> DataFrame:
    return D.reset_all(V.articles(spark, d)).select(*STATES.split(", "))


@query(
    "processing_stats",
    """
SELECT 'total' AS status, count(*) AS articles FROM articles
UNION ALL SELECT s, count(*) FILTER (processing_status = s) FROM articles,
  (SELECT unnest(['pending', 'processing', 'completed', 'failed']) AS s) GROUP BY s
""",
)
def processing_stats(spark, d) -> DataFrame:
    return D.processing_stats(V.articles(spark, d))


@query(
    "failed_report",
    "SELECT article_id, title, processing_error FROM articles WHERE processing_status = 'failed'",
)
def failed_report(spark, d) -> DataFrame:
    return D.failed_report(V.articles(spark, d))
