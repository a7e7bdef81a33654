"""Conversation memory, sessions, history and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.functions.ordered import last_before, micros, number_sessions, session_buckets
from newsloom.functions.scale import r6

MEMORY = 10
SESSION_GAP = 3600


def newest_message(messages: DataFrame) -> Column:
    return messages.agg(F.max("created_at")).scalar()


def chat_memory(messages: DataFrame, n: int = MEMORY) -> DataFrame:
    """Last n messages per user and conversation, newest first."""
    w = Window.partitionBy("user_id", "conversation_id").orderBy(F.col("created_at").desc(), F.col("turn").desc())
    return messages.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def chat_live_sessions(messages: DataFrame, gap_seconds: int = SESSION_GAP) -> DataFrame:
    """Sessions of a conversation: memory expires when nothing is said for the gap."""
    keys = ["conversation_id", "user_id"]
    numbered = number_sessions(session_buckets(messages, keys, "created_at", gap_seconds), keys, gap_seconds)
    return numbered.groupBy(*keys, "session_no").agg(
        F.min("_from").alias("started"), F.max("_to").alias("ended"), F.sum("_n").alias("messages")
    )


def chat_context(messages: DataFrame, n: int = 3) -> DataFrame:
    """Each message with the n messages before it, oldest first."""
    line = F.concat("role", F.lit(": "), "content")
    found = last_before(messages, ["conversation_id"], "turn", line, n, "_lines")
    return found.select("conversation_id", "turn", F.array_join("_lines", "\n").alias("context"))


def chat_volume(messages: DataFrame, days: int = 7) -> DataFrame:
    """Messages of the last days, counted back from the newest message."""
    recent = messages.withColumn("_now", newest_message(messages)).where(
        F.col("created_at") > F.col("_now") - F.expr(f"INTERVAL {days} DAYS")
    )
    return recent.agg(F.count(F.lit(1)).alias("messages"))


def assistant_length(messages: DataFrame) -> DataFrame:
    return messages.where("role = 'assistant'").agg(r6(F.avg(F.length("content"))).alias("avg_length"))


def chat_history(messages: DataFrame, conversation_id: int) -> DataFrame:
    return messages.where(F.col("conversation_id") == conversation_id).orderBy("created_at", "turn")


def chat_clear(messages: DataFrame, cleared: DataFrame) -> DataFrame:
    """Messages without the cleared conversations."""
    return messages.join(cleared.select("conversation_id"), "conversation_id", "left_anti")


def chat_feedback_stats(feedback: DataFrame, satisfied_from: int = 4) -> DataFrame:
    """Mean rating and share of satisfied ratings per conversation."""
    return feedback.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("ratings"),
        r6(F.avg("rating")).alias("mean_rating"),
        r6(F.avg((F.col("rating") >= satisfied_from).cast("double"))).alias("satisfied"),
    )


def chat_config(user_id: Column) -> Column:
    """Retrieval settings by user: version and number of articles."""
    even = user_id % 2 == 0
    return F.struct(
        F.when(even, "v1").otherwise("v2").alias("version"), F.when(even, 5).otherwise(10).alias("k")
    )


def response_seconds(messages: DataFrame) -> DataFrame:
    """Time from a user's message to the answer that follows it, by turn number."""
    asked = messages.where("role = 'user'").select(
        "conversation_id", (F.col("turn") + 1).alias("turn"), F.col("created_at").alias("_asked")
    )
    answers = messages.where("role = 'assistant'").select("conversation_id", "user_id", "turn", "created_at")
    took = (micros(F.col("created_at")) - micros(F.col("_asked"))) / F.lit(1e6)
    return answers.join(asked, ["conversation_id", "turn"]).select(
        "conversation_id", "user_id", "turn", took.alias("seconds")
    )


def chat_ab(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Answers, mean response time and mean rating per configuration."""
    config = chat_config(F.col("user_id"))
    times = response_seconds(messages).groupBy(config.alias("_c")).agg(
        F.count(F.lit(1)).alias("answers"), r6(F.avg("seconds")).alias("avg_seconds")
    )
    ratings = feedback.groupBy(config.alias("_c")).agg(r6(F.avg("rating")).alias("avg_rating"))
    return times.join(ratings, "_c", "left").select(
        F.col("_c.version").alias("version"), F.col("_c.k").alias("k"), "answers", "avg_seconds", "avg_rating"
    )
