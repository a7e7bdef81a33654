"""From raw pages to stored articles: extract, drop known urls, gate on length, fill defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions import text as X
from newsloom.sources.tables import materialize

MIN_CONTENT_CHARS = 100


def extract_articles(pages: DataFrame) -> DataFrame:
    """Add title, content, page_author and image_url taken from the html column; html is dropped."""
    html = F.col("html")
    return pages.select(
        *[c for c in pages.columns if c != "html"],
        X.page_title(html).alias("title"),
        X.page_text(html).alias("content"),
        X.page_meta(html, "name", "author").alias("page_author"),
        X.page_meta(html, "property", "og:image").alias("image_url"),
    )


def has_enough_content(content: Column) -> Column:
    return F.coalesce(F.length(content), F.lit(0)) >= MIN_CONTENT_CHARS


def dedup_by_url(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose url is not stored yet; of several with one url, the one with the lowest key.

    Only (url, key) pairs are shuffled and reduced before the exchange, so neither wide page rows
    nor one endlessly repeated url travel; the winners are then looked up by key.
    """
    first = incoming.groupBy("url").agg(F.min(key).alias(key))
    fresh = first.join(existing.select("url"), "url", "left_anti")
    return incoming.join(fresh.select(key), key, "left_semi")


def content_gate(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) by the minimum content length; null counts as 0."""
    ok = has_enough_content(F.col("content"))
    return entries.where(ok), entries.where(~ok)


def entry_defaults(entries: DataFrame) -> DataFrame:
    """Stored columns of a feed entry: title, first author, UTC time, status."""
    p = F.col("published_parts")
    published = F.when(
        p.isNotNull(), F.make_timestamp_ntz(p[0], p[1], p[2], p[3], p[4], p[5].cast("decimal(16,6)"))
    )
    return entries.select(
        *[c for c in entries.columns if c not in ("entry_title", "title", "authors", "published_parts")],
        F.coalesce("entry_title", F.lit("No Title")).alias("title"),
        F.get("authors", F.lit(0)).alias("author"),
        published.alias("published_at"),
        F.lit("pending").alias("processing_status"),
    )


def ingest(entries: DataFrame, existing: DataFrame) -> DataFrame:
    """Feed entries with pages to new article rows. A short page never claims its url.

    Author and image are those of the page. Pages are parsed once, into a stored table that is read for the urls and
    for the winners.
    """
    long_enough, _ = content_gate(extract_articles(entries))
    new = dedup_by_url(materialize(long_enough, "extracted"), existing, "page_id")
    return entry_defaults(new).drop("author").withColumnRenamed("page_author", "author")


def ingest_outcomes(entries: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Each entry with outcome added, skipped or failed.

    In arrival order: a url stored before, or added by an earlier entry, is skipped before its
    content is looked at; then short content fails; the rest is added.
    """
    ok = has_enough_content(F.col("content"))
    stored = existing.select("url").distinct().withColumn("_stored", F.lit(True))
    added = entries.where(ok).groupBy("url").agg(F.min(key).alias("_first"))
    known = F.col("_stored").isNotNull() | F.coalesce(F.col("_first") < F.col(key), F.lit(False))
    return (
        entries.join(stored, "url", "left")
        .join(added, "url", "left")
        .withColumn("outcome", F.when(known, "skipped").when(~ok, "failed").otherwise("added"))
        .drop("_stored", "_first")
    )


def ingest_summary(outcomes: DataFrame, feed: str) -> DataFrame:
    """Counts of added, skipped and failed entries per feed."""
    return outcomes.groupBy(F.col(feed).alias("feed")).agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("added", "skipped", "failed")]
    )


def add_status_columns(articles: DataFrame) -> DataFrame:
    """Add the lifecycle columns where missing; running it again changes nothing."""
    wanted = {
        "processing_status": F.lit("pending"),
        "processed_at": F.lit(None).cast("timestamp_ntz"),
        "processing_error": F.lit(None).cast("string"),
    }
    return articles.withColumns({c: v for c, v in wanted.items() if c not in articles.columns})


def count_by_status(articles: DataFrame) -> DataFrame:
    return articles.groupBy("processing_status").agg(F.count(F.lit(1)).alias("articles"))
