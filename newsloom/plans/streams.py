"""Named queries: end states of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.operators import processing as D
from newsloom.plans.classify import NAME, trained_nb
from newsloom.plans.processing import NOW, now
from newsloom.plans.registry import query
from newsloom.schemas import LONG
from newsloom.session import scratch_dir
from newsloom.sources import tables as S, views as V
from newsloom.streaming import streams as T


@query("ingest_stream", "SELECT * FROM ingested")
def ingest_stream(spark, d) -> DataFrame:
    store = scratch_dir(spark, "ingest")
    stored = S.read_table(spark, d, "pages").where("page_id % 4 = 0")
    T.ingest_stream(V.entries_from_pages(T.read_stream(spark, d, "pages")), store, stored)
    return T.ingested(spark, store)


@query(
    "interactions_stateful_stream",
    "SELECT event_id, user_id, article_id, interaction_type, ts, read_time_seconds FROM interactions",
)
def interactions_stateful_stream(spark, d) -> DataFrame:
    store = scratch_dir(spark, "interactions")
    events = V.interactions_from_events(T.read_stream(spark, d, "events"))
    T.interactions_stream(events, V.users(spark, d), V.article_ids(spark, d), store)
    return T.current_interactions(spark, store)


@query(
    "process_stream",
    f"""
SELECT a.article_id, {NAME.format(c='predicted')} AS topic, confidence AS topic_confidence,
  row_number() OVER (ORDER BY a.article_id) - 1 AS embedding_id, 'completed' AS processing_status,
  TIMESTAMP '{NOW}' AS processed_at
FROM articles a JOIN nb_pred p ON p.article_id = a.article_id WHERE processing_status = 'pending'
""",
)
def process_stream(spark, d) -> DataFrame:
    store = scratch_dir(spark, "processing")
    arriving = V.articles_from_documents(
        T.read_stream(spark, d, "documents"), S.read_table(spark, d, "embeddings")
    )
    T.process_stream(arriving, D.nb_classifier(trained_nb(spark, d)), store, now())
    return T.processed_articles(spark, store).select(
        "article_id", "topic", "topic_confidence", "embedding_id", "processing_status", "processed_at"
    )


@query(
    "trending_stream",
    """
SELECT until, article_id, count(*) AS clicks FROM (
  SELECT article_id, date_trunc('hour', ts) + to_hours(cast(unnest(range(1, 25)) AS int)) AS until
  FROM interactions_raw WHERE interaction_type = 'click') GROUP BY 1, 2
""",
)
def trending_stream(spark, d) -> DataFrame:
    store = scratch_dir(spark, "trending")
    clicks = V.interactions_from_events(T.read_stream(spark, d, "events")).where("interaction_type = 'click'")
    T.window_stream(clicks, "ts", "1 hour", ["article_id"], store)
    return T.rolling_24h(T.read_windows(spark, store, {"article_id": LONG}))


@query("chat_sessions_stream", "SELECT * FROM chat_sessions")
def chat_sessions_stream(spark, d) -> DataFrame:
    store = scratch_dir(spark, "sessions")
    said = V.messages_from_turns(T.read_stream(spark, d, "conversations"))
    T.window_stream(said, "created_at", "1 hour", ["conversation_id", "user_id"], store)
    windows = T.read_windows(spark, store, {"conversation_id": LONG, "user_id": LONG})
    return T.sessions_from_windows(windows, ["conversation_id", "user_id"], 3600)


@query(
    "throughput_stream",
    """
SELECT date_trunc('hour', processed_at) AS hour, count(*) AS articles FROM articles
WHERE processing_status = 'completed' GROUP BY 1
""",
)
def throughput_stream(spark, d) -> DataFrame:
    store = scratch_dir(spark, "throughput")
    done = V.articles_from_documents(
        T.read_stream(spark, d, "documents"), S.read_table(spark, d, "embeddings")
    ).where("processing_status = 'completed'")
    T.window_stream(done, "processed_at", "1 hour", [], store)
    return T.read_windows(spark, store, {}).select(
        F.col("window_start").alias("hour"), F.col("n").alias("articles")
    )
