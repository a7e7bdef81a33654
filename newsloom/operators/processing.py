"""Article lifecycle: pick pending articles, classify, embed, index, record the outcome."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.scale import dense_positions, ratio
from newsloom.operators import classify as E, embed as M
from newsloom.operators.vectors import next_position
from newsloom.schemas import ARTICLE, STATUSES
from newsloom.sources.tables import materialize

BATCH_SIZE = 50
NULL_CONTENT = "content is null"
# Adds topic, confidence and topic_id to (article_id, content, text).
Classifier = Callable[[DataFrame], DataFrame]


@dataclass
class Processed:
    """articles: the whole table after the batch; vectors: rows to add to the vector index."""

    articles: DataFrame
    vectors: DataFrame


def nb_classifier(model: E.NaiveBayes) -> Classifier:
    return lambda docs: E.classify_nb(docs, "article_id", "text", model).drop("scores", "probs")


def pending_batch(articles: DataFrame, limit: int | None = BATCH_SIZE) -> DataFrame:
    """Pending articles, lowest id first; without a limit all of them."""
    pending = articles.where(F.col("processing_status") == "pending")
    return pending if limit is None else pending.orderBy("article_id").limit(limit)


def content_error(content: Column) -> Column:
    return F.when(content.isNull(), NULL_CONTENT)


def process_rows(batch: DataFrame, index_size: Column, classify: Classifier, now: Column) -> Processed:
    """Outcome of the articles in `batch` only.

    A row that fails keeps its message and does not stop the others. A zero vector is not indexed,
    so such an article completes without embedding_id. Positions follow article_id. Texts are
    embedded once, into a table; numbering then reads ids only.
    """
    columns = ARTICLE.fieldNames()
    checked = batch.select(*columns).withColumn("_error", content_error(F.col("content")))
    failed = (
        checked.where(F.col("_error").isNotNull())
        .withColumns({"processing_status": F.lit("failed"), "processing_error": F.col("_error")})
        .select(*columns)
    )
    good = checked.where(F.col("_error").isNull()).drop("_error", "topic", "topic_confidence", "embedding_id")
    text = E.classification_text(F.col("title"), F.col("content"))
    scored = classify(good.select("article_id", text.alias("text"))).select("article_id", "topic", "confidence")
    embedded = M.embed_batch(good.select("article_id", "content"), "content").where(M.nonzero(F.col("embedding")))
    stored = materialize(
        embedded.select("article_id", F.col("embedding").cast("array<float>").alias("embedding")), "embedded"
    )
    placed = dense_positions(stored.select("article_id"), "article_id", "_offset").select(
        "article_id", (F.col("_offset") + index_size).alias("embedding_id")
    )
    vectors = stored.join(placed, "article_id").select(
        "article_id", F.col("embedding_id").alias("position"), "embedding"
    )
    # Topics and positions are put together first, as a narrow table; texts pass one join, or none if that table is small.
    outcome = materialize(scored.join(placed, "article_id", "left"), "outcome")
    done = (
        good.join(outcome, "article_id")
        .withColumn("topic_confidence", F.col("confidence"))
        .withColumns(
            {
                "processing_status": F.lit("completed"),
                "processed_at": now,
                "processing_error": F.lit(None).cast("string"),
            }
        )
        .select(*columns)
    )
    return Processed(done.unionByName(failed), vectors)


def process_batch(
    articles: DataFrame, classify: Classifier, now: Column, limit: int | None = BATCH_SIZE
) -> Processed:
    """The article table with one batch of pending articles processed.

    Rows outside the batch pass through untouched: without a limit they are told apart by status
    alone, with a limit by an anti join against the (bounded) batch ids. Nothing is left in
    state 'processing', because the result is written as one new version of the table.
    """
    batch = pending_batch(articles, limit)
    outcome = process_rows(batch, next_position(articles, "embedding_id"), classify, now)
    if limit is None:
        rest = articles.where(~F.coalesce(F.col("processing_status") == "pending", F.lit(False)))
    else:
        rest = articles.join(batch.select("article_id"), "article_id", "left_anti")
    return Processed(rest.select(*ARTICLE.fieldNames()).unionByName(outcome.articles), outcome.vectors)


def process_one(articles: DataFrame, article_id: int, classify: Classifier, now: Column) -> DataFrame:
    """Process one article whatever its status; an unknown id gives no row."""
    one = articles.where(F.col("article_id") == article_id)
    return process_rows(one, next_position(articles, "embedding_id"), classify, now).articles


def process_result_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """processed / failed / total / success rate of a batch: after holds its rows."""
    status = F.col("processing_status")
    return (
        before.select("article_id")
        .join(after.select("article_id", "processing_status"), "article_id")
        .agg(
            F.count_if(status == "completed").alias("processed"),
            F.count_if(status == "failed").alias("failed"),
            F.count(F.lit(1)).alias("total"),
        )
        .withColumn("success_rate", ratio(F.col("processed") * 100, F.col("total")))
    )


def reset_failed(articles: DataFrame) -> DataFrame:
    failed = F.col("processing_status") == "failed"
    return articles.withColumns(
        {
            "processing_error": F.when(~failed, F.col("processing_error")),
            "processing_status": F.when(failed, "pending").otherwise(F.col("processing_status")),
        }
    )


def count_failed(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count_if(F.col("processing_status") == "failed").alias("reset"))


def reset_all(articles: DataFrame) -> DataFrame:
    """Back to pending with no model output, for when the model changed."""
    none = F.lit(None)
    return articles.withColumns(
        {
            "processing_status": F.lit("pending"),
            "topic": none.cast("string"),
            "topic_confidence": none.cast("double"),
            "embedding_id": none.cast("bigint"),
        }
    )


def processing_stats(articles: DataFrame) -> DataFrame:
    """Total and the count of every status in one pass; a status without rows counts 0."""
    counts = articles.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("processing_status") == s).alias(s) for s in STATUSES]
    )
    return counts.unpivot([], ["total", *STATUSES], "status", "articles")


def failed_report(articles: DataFrame) -> DataFrame:
    return articles.where(F.col("processing_status") == "failed").select("article_id", "title", "processing_error")
