"""Streams over the same operators as the batch jobs.

Every sink is a folder of micro-batches (`batch_id=N`). A batch reads only earlier batches and
replaces its own folder, so a restart from the checkpoint, or a batch that runs twice, leaves the
same tables. Tables are read back with the functions next to each stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions.ordered import number_sessions
from newsloom.operators import ingest as I, interactions as C, processing as D
from newsloom.schemas import ARTICLE, INTERACTION, LONG, TEXT, TIME, VECTOR, TABLES
from newsloom.sources import tables as S
from newsloom.sources.runs import RunTable


#: Runs of a batch table that are merged into one.
FANOUT = 8


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A table as a stream of its files: the parts in a folder `name.parquet`, or the files `name*.parquet`."""
    stream = spark.readStream.schema(TABLES[name]).option("maxFilesPerTrigger", files_per_batch)
    path = f"{folder}/{name}.parquet"
    if S.is_folder(spark, path):
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def run(
    stream: DataFrame,
    batch: Callable[[DataFrame, int], None],
    root: str,
    every: str | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Start a stream; without an interval it takes what is there and this call waits for the end."""

    def kept(df: DataFrame, batch_id: int) -> None:
        df.persist()
        try:
            batch(df, batch_id)
        finally:
            df.unpersist()

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(kept)
    if every:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _empty(spark: SparkSession, schema: T.StructType, path: str) -> None:
    """A first, empty batch, so that a table can be read before anything arrived."""
    S.write_batch(spark.createDataFrame([], schema), path, -1)


# --- ingest ----------------------------------------------------------------------------------

INGESTED = T.StructType(
    [
        T.StructField(n, k)
        for n, k in {
            "page_id": LONG, "feed": TEXT, "url": TEXT, "title": TEXT, "author": TEXT, "published_at": TIME,
            "content": TEXT, "processing_status": TEXT, "image_url": TEXT,
        }.items()
    ]
)


URL = T.StructType([T.StructField("url", TEXT)])


def known_urls(spark: SparkSession, store: str) -> RunTable:
    """The urls of all stored articles, looked up by a batch's urls."""
    return RunTable(spark, f"{store}/urls", URL, ("url",), FANOUT)


def ingest_stream(entries: DataFrame, store: str, existing: DataFrame, every: str | None = None) -> StreamingQuery:
    """Feed entries to article rows; a url is stored once, whenever it comes again.

    Known urls are a table sorted by hash, of which a batch reads the pages that can hold its own urls, so its work does not grow
    with what was stored before. Urls of `existing` go into it once, when the store is made.
    """
    spark = entries.sparkSession
    _empty(spark, INGESTED, f"{store}/articles")
    urls = known_urls(spark, store)
    if (-1, -1) not in urls.runs():
        urls.write(existing.select("url").where("url IS NOT NULL").distinct(), -1)

    def batch(df: DataFrame, batch_id: int) -> None:
        urls.compact(batch_id)
        known = urls.lookup(df.select("url").where("url IS NOT NULL"), before=batch_id)
        new = I.ingest(df, known).select(*INGESTED.fieldNames())
        S.write_batch(new, f"{store}/articles", batch_id)
        stored = spark.read.schema(INGESTED).parquet(f"{store}/articles/batch_id={batch_id}")
        urls.write(stored.select("url").where("url IS NOT NULL"), batch_id)

    return run(entries, batch, store, every)


def ingested(spark: SparkSession, store: str) -> DataFrame:
    return S.read_batches(spark, f"{store}/articles", INGESTED).drop("batch_id")


# --- interactions ----------------------------------------------------------------------------

_ROW = T.StructType([T.StructField("ts", TIME), T.StructField("event_id", LONG), T.StructField("read_time_seconds", T.IntegerType())])
PAIR_STATE = T.StructType(
    [
        T.StructField("user_id", LONG), T.StructField("article_id", LONG), T.StructField("interaction_type", TEXT),
        T.StructField("n", LONG), T.StructField("first", _ROW), T.StructField("last", _ROW), T.StructField("timed", _ROW),
    ]
)


def pair_states(spark: SparkSession, store: str) -> RunTable:
    """What each batch saw of each pair; parts of one pair are merged when runs are, and when they are read."""
    return RunTable(spark, f"{store}/state", PAIR_STATE, C.PAIR, FANOUT)


def _merged(states: DataFrame) -> DataFrame:
    return C.merge_pair_states(states).select(*PAIR_STATE.fieldNames())


def interactions_stream(
    events: DataFrame, users: DataFrame, articles: DataFrame, store: str, every: str | None = None
) -> StreamingQuery:
    """Toggles and upserts over a stream. Clicks and skips are appended; of likes and reads a batch adds one small mergeable
    state per pair it saw. Order of arrival does not matter, so late events are exact.

    A batch reads no earlier state. Merging runs rewrites a state a logarithmic number of times, and replaced runs are removed.
    """
    spark = events.sparkSession
    _empty(spark, INTERACTION, f"{store}/log")
    states = pair_states(spark, store)

    def batch(df: DataFrame, batch_id: int) -> None:
        states.compact(batch_id, _merged)
        accepted = C.accepted_interactions(df, users, articles)
        kind = F.col("interaction_type")
        S.write_batch(accepted.where(kind.isin("click", "skip")), f"{store}/log", batch_id)
        states.write(C.pair_state(accepted.where(kind.isin("like", "read"))), batch_id)

    return run(events, batch, store, every)


def current_interactions(spark: SparkSession, store: str) -> DataFrame:
    """The compacted log as of the last batch."""
    log = S.read_batches(spark, f"{store}/log", INTERACTION).drop("batch_id")
    merged = _merged(pair_states(spark, store).read())
    return log.unionByName(C.state_rows(merged).select(*INTERACTION.fieldNames()))


def pair_history(spark: SparkSession, store: str, pairs: DataFrame) -> DataFrame:
    """The states of some pairs (user_id, article_id, interaction_type), looked up by key."""
    return _merged(pair_states(spark, store).lookup(pairs))


# --- processing ------------------------------------------------------------------------------


NEXT = T.StructType([T.StructField("position", LONG)])


def process_stream(
    articles: DataFrame, classify: D.Classifier, store: str, now: Column, first_position: int = 0,
    every: str | None = None,
) -> StreamingQuery:
    """Classify, embed and index articles as they arrive; vector positions go on from batch to batch.

    Spark retries failed tasks, and a failed batch runs again from the checkpoint.
    """
    spark = articles.sparkSession
    _empty(spark, ARTICLE, f"{store}/articles")
    _empty(spark, VECTOR, f"{store}/vectors")
    S.write_batch(spark.createDataFrame([(first_position,)], NEXT), f"{store}/next", -1)

    def batch(df: DataFrame, batch_id: int) -> None:
        # One row: where the batch before left off.
        start = S.read_batch(spark, f"{store}/next", NEXT, batch_id - 1).first()["position"]
        done = D.process_rows(D.pending_batch(df, None), F.lit(start), classify, now)
        S.write_batch(done.vectors.select(*VECTOR.fieldNames()), f"{store}/vectors", batch_id)
        S.write_batch(done.articles, f"{store}/articles", batch_id)
        placed = S.read_batch(spark, f"{store}/vectors", VECTOR, batch_id)
        last = placed.agg(F.coalesce(F.max("position") + 1, F.lit(start)).cast("bigint").alias("position"))
        S.write_batch(last, f"{store}/next", batch_id)

    return run(articles, batch, store, every)


def processed_articles(spark: SparkSession, store: str) -> DataFrame:
    return S.read_batches(spark, f"{store}/articles", ARTICLE).drop("batch_id")


def processed_vectors(spark: SparkSession, store: str) -> DataFrame:
    return S.read_batches(spark, f"{store}/vectors", VECTOR).drop("batch_id")


# --- windowed aggregates ---------------------------------------------------------------------


def window_stream(
    rows: DataFrame, ts: str, length: str, keys: list[str], store: str, every: str | None = None
) -> StreamingQuery:
    """Count, first and last time per key and tumbling window.

    A batch writes what it saw of each window; readers merge the parts. So rows count whenever they come, in any order,
    and no state is kept between batches. Windows need a timestamp with time zone, so times are cast here.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        timed = df.withColumn("_t", F.col(ts).cast("timestamp"))
        sums = (
            timed.groupBy(F.window("_t", length).alias("_w"), *keys)
            .agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("first_at"), F.max("_t").alias("last_at"))
            .select(F.col("_w.start").alias("window_start"), *keys, "n", "first_at", "last_at")
        )
        S.write_batch(sums, f"{store}/windows", batch_id)

    return run(rows, batch, store, every)


def read_windows(spark: SparkSession, store: str, keys: dict[str, T.DataType]) -> DataFrame:
    """Every window and key, from the parts that the batches wrote."""
    stamp = T.TimestampType()
    fields = {"window_start": stamp, **keys, "n": LONG, "first_at": stamp, "last_at": stamp}
    schema = T.StructType([T.StructField(n, k) for n, k in fields.items()])
    merged = S.read_batches(spark, f"{store}/windows", schema).groupBy("window_start", *keys).agg(
        F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return merged.select(ntz("window_start"), *keys, "n", ntz("first_at"), ntz("last_at"))


def rolling_24h(hourly: DataFrame) -> DataFrame:
    """Clicks per article in the 24 hours up to each full hour, from hourly counts."""
    hours = F.explode(F.sequence(F.lit(1), F.lit(24))).alias("_h")
    ends = hourly.select("window_start", "article_id", "n", hours)
    end = F.col("window_start") + F.make_dt_interval(F.lit(0), F.col("_h"))
    return ends.groupBy(end.alias("until"), "article_id").agg(F.sum("n").alias("clicks"))


def sessions_from_windows(windows: DataFrame, keys: list[str], gap_seconds: int) -> DataFrame:
    """Sessions from windows as long as the gap: two events of one window share a session."""
    buckets = windows.select(
        *keys, F.col("window_start").alias("_bucket"), F.col("first_at").alias("_from"),
        F.col("last_at").alias("_to"), F.col("n").alias("_n"),
    )
    return number_sessions(buckets, keys, gap_seconds).groupBy(*keys, "session_no").agg(
        F.min("_from").alias("started"), F.max("_to").alias("ended"), F.sum("_n").alias("messages")
    )
