"""Named queries: engagement, quality and monitoring metrics (K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.operators import metrics as K
from newsloom.plans.articles import compacted
from newsloom.plans.interactions import accepted
from newsloom.plans.processing import processed
from newsloom.plans.recommend import neighbour_feed
from newsloom.plans.registry import CTES, query
from newsloom.sources import tables as S, views as V


@query(
    "ctr_by_topic",
    """
SELECT topic, clicks::bigint AS clicks, skips::bigint AS skips, round(clicks::double / (clicks + skips), 6) AS ctr FROM (
  SELECT coalesce(topic, 'all') AS topic, count(*) FILTER (interaction_type = 'click') AS clicks,
    count(*) FILTER (interaction_type = 'skip') AS skips
  FROM interactions i JOIN articles a ON a.article_id = i.article_id
  WHERE topic IS NOT NULL AND interaction_type IN ('click', 'skip') GROUP BY ROLLUP (topic))
""",
)
def ctr_by_topic(spark, d) -> DataFrame:
    return K.ctr_by_topic(compacted(spark, d), V.articles(spark, d))


@query("dau", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users FROM accepted GROUP BY 1")
def dau(spark, d) -> DataFrame:
    return K.dau(accepted(spark, d))


#: Relative error within which counts from sketches have to be: about four standard errors.
SKETCH_ERROR = 0.035


@query(
    "wau_sketch",
    """
SELECT date_trunc('week', ts)::date AS week, count(DISTINCT user_id) AS users, true AS within FROM accepted GROUP BY 1
""",
)
def wau_sketch(spark, d) -> DataFrame:
    """Weekly users from stored daily sketches, next to the exact count."""
    rows = accepted(spark, d)
    sketches = S.materialize(K.daily_user_sketches(rows), "user-sketches")
    week = F.to_date(F.date_trunc("week", F.col("day")))
    weeks = sketches.select(week.alias("span")).distinct()
    estimate = K.users_of_spans(sketches, weeks.select("span", F.col("span").alias("first"), F.date_add("span", 6).alias("last")))
    exact = rows.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("span")).agg(F.countDistinct("user_id").alias("exact"))
    near = F.abs(F.col("users") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * SKETCH_ERROR)
    return exact.join(estimate, "span", "left").select(F.col("span").alias("week"), F.col("exact").alias("users"), F.coalesce(near, F.lit(False)).alias("within"))


@query(
    "cohort_retention",
    """
WITH a AS (SELECT DISTINCT user_id, ts::date AS d FROM accepted),
  f AS (SELECT user_id, min(d) AS d FROM a GROUP BY 1)
SELECT f.d AS cohort, cast(a.d - f.d AS int) AS day_no, count(*) AS users FROM f JOIN a ON a.user_id = f.user_id
WHERE a.d - f.d BETWEEN 1 AND 30 GROUP BY 1, 2
""",
)
def cohort_retention(spark, d) -> DataFrame:
    """The whole triangle of first days and later days, by bitmaps."""
    return K.cohort_retention(accepted(spark, d))


CTES["sessions"] = """
SELECT user_id, cast(session_no AS int) AS session_no, min(ts) AS started,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds, count(*) AS events, count(DISTINCT article_id) AS articles
FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 1800000000
    THEN 0 ELSE 1 END AS fresh FROM accepted)) GROUP BY 1, 2
"""


@query("user_sessions", "SELECT * FROM sessions")
def user_sessions(spark, d) -> DataFrame:
    return K.user_sessions(accepted(spark, d))


@query("articles_per_user", "SELECT user_id, count(DISTINCT article_id) AS articles FROM accepted GROUP BY 1")
def articles_per_user(spark, d) -> DataFrame:
    return K.articles_per_user(accepted(spark, d))


@query(
    "retention_7d",
    """
WITH a AS (SELECT DISTINCT user_id, ts::date AS d FROM accepted),
  f AS (SELECT user_id, min(d) AS d FROM a GROUP BY 1)
SELECT count(*) AS users, sum(back)::bigint AS returned, round(sum(back)::double / count(*), 6) AS retention FROM (
  SELECT f.user_id, max((a.d - f.d BETWEEN 1 AND 7)::int) AS back FROM f JOIN a ON a.user_id = f.user_id GROUP BY 1)
""",
)
def retention_7d(spark, d) -> DataFrame:
    return K.retention(accepted(spark, d), 7)


@query(
    "catalog_coverage",
    """
SELECT count(DISTINCT article_id) AS recommended, (SELECT count(*) FROM articles) AS articles,
  round(count(DISTINCT article_id)::double / (SELECT count(*) FROM articles), 6) AS coverage FROM feeds
""",
)
def catalog_coverage(spark, d) -> DataFrame:
    return K.catalog_coverage(neighbour_feed(spark, d), V.articles(spark, d))


@query(
    "rec_diversity",
    """
SELECT user_id, sum(n)::bigint AS articles, round(1 - sum(n * n)::double / (sum(n) * sum(n))::double, 6) AS diversity
FROM (SELECT user_id, topic, count(*) AS n FROM feeds GROUP BY 1, 2) GROUP BY 1
""",
)
def rec_diversity(spark, d) -> DataFrame:
    return K.rec_diversity(neighbour_feed(spark, d))


@query(
    "exposure_gini",
    """
SELECT count(*) AS articles, sum(x)::bigint AS shown,
  round(2 * sum(x * r)::double / (count(*) * sum(x))::double - (count(*) + 1)::double / count(*), 6) AS gini
FROM (SELECT x, row_number() OVER (ORDER BY x) AS r FROM (SELECT count(*) AS x FROM feeds GROUP BY article_id))
""",
)
def exposure_gini(spark, d) -> DataFrame:
    return K.exposure_gini(neighbour_feed(spark, d))


@query(
    "latency_percentiles",
    """
SELECT day, count(*) AS requests, round(avg((event_type = 'error')::int), 6) AS error_rate,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
  round(quantile_cont(value, 0.99), 6) AS p99
FROM (SELECT *, unnest([strftime(ts, '%Y-%m-%d'), 'all']) AS day FROM events) GROUP BY day
""",
)
def latency_percentiles(spark, d) -> DataFrame:
    e = S.read_table(spark, d, "events")
    return K.latency_percentiles(e.select("ts", F.col("value").alias("ms"), (F.col("event_type") == "error").alias("failed")))


@query(
    "topic_drift",
    """
WITH c AS (SELECT strftime(date_trunc('week', published_at), '%Y-%m-%d') AS week, topic, count(*)::double AS n
    FROM articles WHERE topic IS NOT NULL GROUP BY 1, 2),
  s AS (SELECT w.week, t.topic, greatest(coalesce(n, 0) / (SELECT sum(n) FROM c x WHERE x.week = w.week), 0.000001) AS p
    FROM (SELECT DISTINCT week FROM c) w CROSS JOIN (SELECT DISTINCT topic FROM c) t
    LEFT JOIN c ON c.week = w.week AND c.topic = t.topic)
SELECT s.week, round(sum((s.p - b.p) * ln(s.p / b.p)), 6) AS psi FROM s
JOIN (SELECT * FROM s WHERE week = (SELECT min(week) FROM c)) b ON b.topic = s.topic GROUP BY 1
""",
)
def topic_drift(spark, d) -> DataFrame:
    return K.topic_drift(V.articles(spark, d))


@query(
    "processing_throughput",
    """
SELECT date_trunc('hour', processed_at) AS hour, count(*) AS articles FROM processed
WHERE processing_status = 'completed' GROUP BY 1
""",
)
def processing_throughput(spark, d) -> DataFrame:
    return K.processing_throughput(processed(spark, d))


@query(
    "chat_engagement",
    """
WITH a AS (SELECT DISTINCT user_id, created_at::date AS d FROM messages),
  f AS (SELECT user_id, min(d) AS d FROM a GROUP BY 1),
  b AS (SELECT f.user_id, max((a.d - f.d BETWEEN 1 AND 7)::int) AS back FROM f JOIN a ON a.user_id = f.user_id GROUP BY 1)
SELECT round((SELECT count(*) FROM users WHERE user_id IN (SELECT user_id FROM messages))::double
    / (SELECT count(*) FROM users), 6) AS adoption,
  round(count(*)::double / count(DISTINCT conversation_id), 6) AS messages_per_conversation,
  (SELECT round(sum(back)::double / count(*), 6) FROM b) AS return_rate FROM messages
""",
)
def chat_engagement(spark, d) -> DataFrame:
    return K.chat_engagement(V.messages(spark, d), V.users(spark, d))


@query(
    "chat_cost",
    r"""
SELECT conversation_id, tokens, round(tokens * 0.002::double / 1000.0, 9) AS cost FROM (
  SELECT conversation_id, sum(len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')))::bigint AS tokens
  FROM messages GROUP BY 1)
""",
)
def chat_cost(spark, d) -> DataFrame:
    return K.chat_cost(V.messages(spark, d))
