"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


LONG, INT, DOUBLE, TEXT = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
TIME, FLOATS = T.TimestampNTZType(), T.ArrayType(T.FloatType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Input tables.
TABLES = {
    "documents": _struct(doc_id=LONG, text=TEXT, lang=TEXT, source=TEXT, n_chars=LONG),
    "embeddings": _struct(vec_id=LONG, embedding=FLOATS, label=INT),
    "events": _struct(event_id=LONG, ts=TIME, user_id=LONG, event_type=TEXT, value=DOUBLE, props=TEXT),
    "pages": _struct(page_id=LONG, url=TEXT, html=TEXT),
    "labels": _struct(doc_id=LONG, quality=INT, toxic=INT),
    "benchmark": _struct(item_id=LONG, text=TEXT),
    "conversations": _struct(conv_id=LONG, turn=LONG, role=TEXT, text=TEXT),
}

ARTICLE = _struct(
    article_id=LONG, url=TEXT, title=TEXT, content=TEXT, source=TEXT, published_at=TIME, scraped_at=TIME,
    topic=TEXT, topic_confidence=DOUBLE, embedding_id=LONG, processing_status=TEXT, processed_at=TIME,
    processing_error=TEXT, author=TEXT, image_url=TEXT,
)
USER = _struct(user_id=LONG, email=TEXT, created_at=TIME)
INTERACTION = _struct(
    event_id=LONG, user_id=LONG, article_id=LONG, interaction_type=TEXT, ts=TIME, read_time_seconds=INT,
)
VECTOR = _struct(article_id=LONG, position=LONG, embedding=FLOATS)
MESSAGE = _struct(conversation_id=LONG, user_id=LONG, turn=LONG, role=TEXT, content=TEXT, created_at=TIME)

# Class ids and names of the topic model.
TOPICS = {0: "World", 1: "Sports", 2: "Business", 3: "Sci/Tech"}
# Interaction types the log accepts.
INTERACTION_TYPES = ("click", "read", "like", "skip")
# Lifecycle states of an article.
STATUSES = ("pending", "processing", "completed", "failed")
