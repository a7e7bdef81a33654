"""Rules of the interaction log: validation, foreign keys, like toggles, read upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.schemas import INTERACTION_TYPES

COLUMNS = ("event_id", "user_id", "article_id", "interaction_type", "ts", "read_time_seconds")


def reject_reason() -> Column:
    """First rule an event breaks, or null."""
    fails = lambda ok: ~F.coalesce(ok, F.lit(False))
    return (
        F.when(fails(F.col("user_id") >= 1), "user_id")
        .when(fails(F.col("article_id") >= 1), "article_id")
        .when(fails(F.col("interaction_type").isin(*INTERACTION_TYPES)), "interaction_type")
        .when(F.col("read_time_seconds") < 0, "read_time_seconds")
    )


def interaction_validate(events: DataFrame) -> DataFrame:
    return events.withColumn("reason", reject_reason())


def valid_interactions(events: DataFrame) -> DataFrame:
    return events.where(reject_reason().isNull())


def interaction_fk_check(events: DataFrame, users: DataFrame, articles: DataFrame) -> DataFrame:
    """Add `reason`: 'user not found', else 'article not found', else null.

    Ids only are joined; Spark broadcasts them where they are small enough and otherwise splits
    the partitions of a hot user or article.
    """
    u = users.select("user_id", F.lit(True).alias("_user"))
    a = articles.select("article_id", F.lit(True).alias("_article"))
    return (
        events.join(u, "user_id", "left")
        .join(a, "article_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("_user").isNull(), "user not found").when(F.col("_article").isNull(), "article not found"),
        )
        .drop("_user", "_article")
    )


def accepted_interactions(events: DataFrame, users: DataFrame, articles: DataFrame) -> DataFrame:
    """Valid events whose user and article exist."""
    return (
        valid_interactions(events)
        .select(*COLUMNS)
        .join(users.select("user_id"), "user_id", "left_semi")
        .join(articles.select("article_id"), "article_id", "left_semi")
        .select(*COLUMNS)
    )


PAIR = ("user_id", "article_id", "interaction_type")


def pair_state(events: DataFrame) -> DataFrame:
    """Everything toggles and upserts need, in one aggregate per (user, article, type).

    Counts, minima and maxima do not depend on arrival order and merge before the shuffle, so a
    pair with any number of events sends one row per task, and late events need no replay.
    """
    row = F.struct("ts", "event_id", "read_time_seconds")
    return events.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(row).alias("first"),
        F.max(row).alias("last"),
        F.max(F.when(F.col("read_time_seconds").isNotNull(), row)).alias("timed"),
    )


def merge_pair_states(states: DataFrame) -> DataFrame:
    """Combine states of the same pairs, such as an older one and that of a new batch."""
    return states.groupBy(*PAIR).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("timed").alias("timed")
    )


def state_rows(state: DataFrame) -> DataFrame:
    """Log rows that remain: the last of an odd number of likes, one row per read pair."""
    kind, last = F.col("interaction_type"), F.col("last")
    read = kind == "read"
    return state.where(read | ((kind == "like") & (F.col("n") % 2 == 1))).select(
        F.when(read, F.col("first.event_id")).otherwise(last["event_id"]).alias("event_id"),
        "user_id",
        "article_id",
        "interaction_type",
        last["ts"].alias("ts"),
        F.when(read, F.col("timed.read_time_seconds")).otherwise(last["read_time_seconds"]).alias("read_time_seconds"),
    )


def like_toggle(events: DataFrame) -> DataFrame:
    """Likes left after each further like removed the one before."""
    return state_rows(pair_state(events.where(F.col("interaction_type") == "like")))


def read_upsert(events: DataFrame) -> DataFrame:
    """One read per (user, article): first id, last time, last known read time."""
    return state_rows(pair_state(events.where(F.col("interaction_type") == "read")))


def compact_accepted(events: DataFrame) -> DataFrame:
    """The log after toggles and upserts; clicks and skips are kept as they are."""
    kind = F.col("interaction_type")
    merged = state_rows(pair_state(events.where(kind.isin("like", "read"))))
    return events.where(kind.isin("click", "skip")).select(*COLUMNS).unionByName(merged)


def interactions_compact(events: DataFrame, users: DataFrame, articles: DataFrame) -> DataFrame:
    """Raw events to the log a user sees: validate, check keys, toggle, upsert."""
    return compact_accepted(accepted_interactions(events, users, articles))
