"""Articles, users, interactions and messages derived from the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.schemas import TOPICS
from newsloom.sources.tables import materialize, read_table

EPOCH = "2024-01-01 00:00:00"


def _topic_name(topic_id: Column) -> Column:
    name = F.when(topic_id == 0, TOPICS[0])
    for i in (1, 2, 3):
        name = name.when(topic_id == i, TOPICS[i])
    return name


def _after_epoch(hours: Column, minutes: Column | None = None) -> Column:
    step = F.make_dt_interval(F.lit(0), hours.cast("int"), (minutes if minutes is not None else F.lit(0)).cast("int"))
    return F.lit(EPOCH).cast("timestamp_ntz") + step


#: The tables that `articles` reads.
ARTICLE_TABLES = ["documents", "embeddings"]


def articles(spark: SparkSession, folder: str) -> DataFrame:
    return articles_from_documents(
        read_table(spark, folder, "documents"), read_table(spark, folder, "embeddings")
    )


def article_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all articles, without the columns derived from vectors."""
    docs = read_table(spark, folder, "documents", spread_text=False)
    return docs.select(F.col("doc_id").alias("article_id"))


def article_texts(spark: SparkSession, folder: str) -> DataFrame:
    """article_id and content of `articles`, which has an article once for each row of its vector: texts are read where they lie.

    Only vector ids are counted; those that come more than once are stored, mostly none.
    """
    docs = read_table(spark, folder, "documents").select(F.col("doc_id").alias("article_id"), F.col("text").alias("content"))
    vectors = read_table(spark, folder, "embeddings").groupBy(F.col("vec_id").alias("article_id")).agg(F.count(F.lit(1)).alias("_n"))
    repeated = materialize(vectors.where("article_id IS NOT NULL AND _n > 1"), "repeated-vectors")
    if repeated.isEmpty():
        return docs
    times = F.explode(F.sequence(F.lit(1), F.coalesce("_n", F.lit(1)))).alias("_i")
    return docs.join(repeated, "article_id", "left").select("article_id", "content", times).drop("_i")


def articles_from_documents(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    docs, vecs = docs.drop("n_chars"), embeddings.select("vec_id", "label")
    d = docs.join(vecs, docs.doc_id == vecs.vec_id, "left")
    done = F.col("vec_id").isNotNull() & (F.col("doc_id") % 10 < 8)
    first_line = F.substring(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), 1, 80)
    none = F.lit(None).cast("string")
    return d.select(
        F.col("doc_id").alias("article_id"),
        F.concat(
            F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string")
        ).alias("url"),
        F.coalesce(F.nullif(first_line, F.lit("")), F.lit("No Title")).alias("title"),
        F.col("text").alias("content"),
        "source",
        "lang",
        _after_epoch(F.col("doc_id") % 720).alias("published_at"),
        _after_epoch(F.col("doc_id") % 720 + 1).alias("scraped_at"),
        F.when(done, _topic_name(F.col("label") % 4)).alias("topic"),
        F.when(done, F.lit(0.5) + (F.col("doc_id") % 50) / F.lit(100.0)).alias("topic_confidence"),
        F.when(done, F.col("vec_id")).alias("embedding_id"),
        F.when(done, "completed").when(F.col("doc_id") % 10 == 9, "failed").otherwise("pending").alias(
            "processing_status"
        ),
        F.when(done, _after_epoch(F.col("doc_id") % 720 + 2)).alias("processed_at"),
        F.when(~done & (F.col("doc_id") % 10 == 9), "content is null").alias("processing_error"),
        none.alias("author"),
        none.alias("image_url"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Known users; ids ending in 9 never signed up, so their events must be rejected."""
    e = read_table(spark, folder, "events").where("user_id >= 1 AND user_id % 10 <> 9")
    return e.groupBy("user_id").agg(F.min("ts").alias("created_at")).select(
        "user_id",
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
        "created_at",
    )


def interactions_from_events(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return e.select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("article_id"),
        F.when(kind == "click", "click")
        .when(kind == "view", "read")
        .when(kind == "purchase", "like")
        .when(kind == "error", "skip")
        .otherwise(kind)
        .alias("interaction_type"),
        "ts",
        F.when((kind == "view") & (F.col("event_id") % 5 != 0), F.floor("value").cast("int")).alias(
            "read_time_seconds"
        ),
    )


def interactions_raw(spark: SparkSession, folder: str) -> DataFrame:
    return interactions_from_events(read_table(spark, folder, "events"))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return messages_from_turns(read_table(spark, folder, "conversations"))


def messages_from_turns(c: DataFrame) -> DataFrame:
    cited = F.concat("text", F.lit(" ["), (F.col("turn") % 7).cast("string"), F.lit("][1]"))
    return c.select(
        F.col("conv_id").alias("conversation_id"),
        (F.col("conv_id") % 150).alias("user_id"),
        "turn",
        "role",
        F.when(F.col("role") == "assistant", cited).otherwise(F.col("text")).alias("content"),
        _after_epoch(
            F.col("conv_id") % 700 + F.when(F.col("turn") >= 4, 2).otherwise(0), F.col("turn") * 5
        ).alias("created_at"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vector index content: one live vector per article, position = article id."""
    return read_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("article_id"), F.col("vec_id").alias("position"), "embedding"
    )


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings of assistant turns, 1 to 5."""
    return messages(spark, folder).where("role = 'assistant'").select(
        "conversation_id",
        "user_id",
        F.col("turn").alias("message_id"),
        ((F.col("conversation_id") * 7 + F.col("turn")) % 5 + 1).alias("rating"),
        F.col("created_at").alias("ts"),
    )


def feed_entries(spark: SparkSession, folder: str) -> DataFrame:
    return entries_from_pages(read_table(spark, folder, "pages"))


def entries_from_pages(p: DataFrame) -> DataFrame:
    """Raw feed entries with a page each: some lack a title, an author or a date."""
    pid = F.col("page_id")
    return p.select(
        "page_id",
        "url",
        "html",
        F.concat(F.lit("feed"), (pid % 8).cast("string")).alias("feed"),
        F.when(pid % 7 != 0, F.concat(F.lit("Entry "), pid.cast("string"))).alias("entry_title"),
        F.when(pid % 3 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("writer"), (pid % 5).cast("string")), F.lit("desk")))
        .alias("authors"),
        F.when(
            pid % 11 != 0,
            F.array(
                F.lit(2024), F.lit(1), (pid % 28 + 1).cast("int"), (pid % 24).cast("int"), (pid % 60).cast("int"),
                (pid % 60).cast("int"),
            ),
        ).alias("published_parts"),
    )
