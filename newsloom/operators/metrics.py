"""Engagement, recommendation quality and monitoring metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from newsloom.functions import text as X
from newsloom.functions.ordered import SKETCH_K, bracketed_quantiles, micros, number_sessions, session_buckets
from newsloom.functions.scale import r6, ratio
from newsloom.sources.tables import materialize

SESSION_GAP = 1800


def ctr_by_topic(interactions: DataFrame, articles: DataFrame) -> DataFrame:
    """Clicks over clicks and skips per topic, with an 'all' row.

    Events are counted per article first, so the join carries one row per article.
    """
    kind = F.col("interaction_type")
    per_article = interactions.where(kind.isin("click", "skip")).groupBy("article_id").agg(
        F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "skip").alias("skips")
    )
    topics = articles.where(F.col("topic").isNotNull()).select("article_id", "topic")
    sums = (
        per_article.join(topics, "article_id")
        .rollup("topic")
        .agg(F.sum("clicks").alias("clicks"), F.sum("skips").alias("skips"))
    )
    return sums.select(
        F.coalesce("topic", F.lit("all")).alias("topic"), "clicks", "skips",
        ratio(F.col("clicks"), F.col("clicks") + F.col("skips")).alias("ctr"),
    )


def day(ts: str):
    return F.date_format(ts, "yyyy-MM-dd")


def dau(interactions: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct active users per day."""
    users = F.approx_count_distinct("user_id", 0.01) if approximate else F.countDistinct("user_id")
    return interactions.groupBy(day("ts").alias("day")).agg(users.alias("users"))


SKETCH_PRECISION = 14


def daily_user_sketches(interactions: DataFrame, precision: int = SKETCH_PRECISION) -> DataFrame:
    """(day, sketch): a mergeable count of the users of each day, stored instead of its events. The standard error of what is
    read from sketches of 2^precision registers is about 1.04 / 2^(precision / 2), 0.8 % by default."""
    return interactions.groupBy(F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id", precision).alias("sketch"))


def users_of_spans(sketches: DataFrame, spans: DataFrame) -> DataFrame:
    """(span, users): distinct users of any spans of days (span, first, last), from the stored sketches alone."""
    days = spans.select("span", F.explode(F.sequence("first", "last")).alias("day"))
    return days.join(sketches, "day").groupBy("span").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"))


def _user_bitmaps(rows: DataFrame, day: str) -> DataFrame:
    """(day, bucket, bitmap): the users of each day as bits, 32,768 users a row."""
    return rows.groupBy(day, F.bitmap_bucket_number("user_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("bitmap")
    )


def cohort_retention(interactions: DataFrame, days: int = 30) -> DataFrame:
    """(cohort, day_no, users): of the users whose first day is `cohort`, how many came on each of the `days` days after; rows without
    any are left out.

    Users become bits once per day they came and once for their first day; a cell of the triangle is the number of bits that a cohort and
    a day share, so no user rows are joined with each other. Null users are left out.
    """
    active = interactions.where(F.col("user_id").isNotNull()).select("user_id", F.to_date("ts").alias("day")).distinct()
    first = active.groupBy("user_id").agg(F.min("day").alias("cohort"))
    came, began = _user_bitmaps(active, "day"), _user_bitmaps(first, "cohort")
    # Each cohort once for every later day, and each day once for every cohort it can belong to.
    steps = F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day_no")
    one = began.select("cohort", "bucket", "bitmap", steps)
    other = came.select(F.col("day"), "bucket", "bitmap", steps).select(
        F.date_sub("day", F.col("day_no")).alias("cohort"), "bucket", "bitmap", "day_no"
    )
    both = one.unionByName(other).groupBy("cohort", "day_no", "bucket").agg(
        F.bitmap_and_agg("bitmap").alias("shared"), F.count(F.lit(1)).alias("sides")
    )
    shared = both.where("sides = 2").withColumn("users", F.bitmap_count("shared")).where("users > 0")
    return shared.groupBy("cohort", "day_no").agg(F.sum("users").alias("users"))


def user_sessions(interactions: DataFrame, gap_seconds: int = SESSION_GAP) -> DataFrame:
    """Sessions of a user: start, length, events and distinct articles."""
    keys = ["user_id"]
    per_article = session_buckets(interactions, [*keys, "article_id"], "ts", gap_seconds)
    buckets = per_article.groupBy(*keys, "_bucket").agg(
        F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("_n").alias("_n")
    )
    numbered = number_sessions(buckets, keys, gap_seconds)
    spans = numbered.groupBy(*keys, "session_no").agg(
        F.min("_from").alias("started"),
        ((micros(F.max("_to")) - micros(F.min("_from"))) / F.lit(1e6)).alias("seconds"),
        F.sum("_n").alias("events"),
    )
    articles = (
        per_article.select(*keys, "_bucket", "article_id")
        .join(numbered.select(*keys, "_bucket", "session_no"), [*keys, "_bucket"])
        .groupBy(*keys, "session_no")
        .agg(F.countDistinct("article_id").alias("articles"))
    )
    return spans.join(articles, [*keys, "session_no"])


def articles_per_user(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("user_id").agg(F.countDistinct("article_id").alias("articles"))


def retention(interactions: DataFrame, days: int = 7) -> DataFrame:
    """Share of users seen again 1 to `days` days after their first day."""
    active = interactions.select("user_id", F.to_date("ts").alias("_day")).distinct()
    first = active.groupBy("user_id").agg(F.min("_day").alias("_first"))
    later = F.datediff("_day", "_first")
    back = active.join(first, "user_id").groupBy("user_id").agg(F.max(later.between(1, days).cast("int")).alias("_back"))
    return back.agg(F.count(F.lit(1)).alias("users"), F.sum("_back").alias("returned")).withColumn(
        "retention", ratio(F.col("returned"), F.col("users"))
    )


def catalog_coverage(feeds: DataFrame, articles: DataFrame) -> DataFrame:
    """Share of the articles that are in at least one feed."""
    shown = feeds.agg(F.countDistinct("article_id").alias("recommended"))
    return shown.withColumn("articles", articles.agg(F.count(F.lit(1))).scalar()).withColumn(
        "coverage", ratio(F.col("recommended"), F.col("articles"))
    )


def rec_diversity(feeds: DataFrame) -> DataFrame:
    """Gini-Simpson index of topics in each user's feed: 1 - sum of squared shares."""
    counts = feeds.groupBy("user_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    return counts.groupBy("user_id").agg(
        n.alias("articles"), r6(1 - F.sum(F.col("n") * F.col("n")) / (n * n)).alias("diversity")
    )


def exposure_gini(feeds: DataFrame) -> DataFrame:
    """Gini coefficient of how often recommended articles are shown.

    Articles with equal exposure are one row, so the ranks come from a table as long as the number
    of different exposure counts.
    """
    shown = feeds.groupBy("article_id").agg(F.count(F.lit(1)).alias("x"))
    levels = shown.groupBy("x").agg(F.count(F.lit(1)).alias("m"))
    below = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    placed = levels.withColumn("_before", F.coalesce(F.sum("m").over(below), F.lit(0)))
    m = F.col("m")
    ranks = m * F.col("_before") + m * (m + 1) / 2
    n, total = F.sum("m"), F.sum(F.col("x") * m)
    return placed.agg(
        n.alias("articles"), total.alias("shown"), r6(2 * F.sum(F.col("x") * ranks) / (n * total) - (n + 1) / n).alias("gini")
    )


QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_percentiles(requests: DataFrame, approximate: bool = False) -> DataFrame:
    """p50, p95, p99 and error rate per day and over all. requests: (ts, ms, failed).

    Exact by default; `approximate` answers from one aggregate of sketches.
    """
    both = requests.select(F.explode(F.array(day("ts"), F.lit("all"))).alias("day"), "ms", "failed")
    if approximate:
        rates = both.groupBy("day").agg(
            F.count(F.lit(1)).alias("requests"), r6(F.avg(F.col("failed").cast("double"))).alias("error_rate")
        )
        q = both.groupBy("day").agg(*[F.percentile_approx("ms", p, 10000).alias(n) for n, p in QUANTILES.items()])
        return rates.join(q, "day")
    # One pass over the requests for counts and sketches per day; the sketch of all days is merged from them.
    ms = F.col("ms").cast("double")
    days = materialize(
        requests.groupBy(day("ts").alias("day")).agg(
            F.count(F.lit(1)).alias("requests"), F.count("failed").alias("_known"), F.sum(F.col("failed").cast("double")).alias("_failed"),
            F.count(ms).alias("_n"), F.kll_sketch_agg_double(ms, SKETCH_K).alias("_sketch"),
        ),
        "latency",
    )
    sums = {c: F.sum(c).alias(c) for c in ("requests", "_known", "_failed", "_n")}
    whole = days.where("_n > 0").groupBy(F.lit("all").alias("day")).agg(*sums.values(), F.kll_merge_agg_double("_sketch", SKETCH_K).alias("_sketch"))
    counted = days.groupBy(F.lit("all").alias("day")).agg(*sums.values()).unionByName(days.select("day", *sums))
    rates = counted.select("day", "requests", r6(F.try_divide("_failed", "_known")).alias("error_rate"))
    long = bracketed_quantiles(both, days.unionByName(whole), "day", "ms", QUANTILES)
    q = long.groupBy("day").agg(*[F.max(F.when(F.col("quantile") == n, F.col("value"))).alias(n) for n in QUANTILES])
    return rates.join(q, "day")


MIN_SHARE = 1e-6


def topic_drift(articles: DataFrame, time: str = "published_at") -> DataFrame:
    """Population stability index of the topic shares of each week against the first week."""
    week = F.date_format(F.date_trunc("week", F.col(time)), "yyyy-MM-dd")
    counts = articles.where(F.col("topic").isNotNull()).groupBy(week.alias("week"), "topic").agg(
        F.count(F.lit(1)).alias("n")
    )
    wide = counts.groupBy("week").agg(F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("_m"))
    base = wide.agg(F.min_by("_m", "week")).scalar()
    topics = counts.agg(F.collect_set("topic")).scalar()
    share = lambda m, t: F.greatest(
        F.coalesce(F.try_element_at(m, t), F.lit(0))
        / F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, x: a + x),
        F.lit(MIN_SHARE),
    )
    long = wide.withColumn("_base", base).withColumn("_topics", topics).select(
        "week", "_m", "_base", F.explode("_topics").alias("topic")
    )
    p, q = share(F.col("_m"), F.col("topic")), share(F.col("_base"), F.col("topic"))
    return long.select("week", ((p - q) * F.log(p / q)).alias("_d")).groupBy("week").agg(r6(F.sum("_d")).alias("psi"))


def processing_throughput(articles: DataFrame) -> DataFrame:
    """Articles completed per hour."""
    done = articles.where((F.col("processing_status") == "completed") & F.col("processed_at").isNotNull())
    return done.groupBy(F.date_trunc("hour", "processed_at").cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("articles")
    )


def chat_engagement(messages: DataFrame, users: DataFrame, days: int = 7) -> DataFrame:
    """Share of users who chat, messages per conversation, share of chatters back within days."""
    totals = messages.agg(
        F.count(F.lit(1)).alias("messages"), F.countDistinct("conversation_id").alias("conversations")
    )
    chatters = messages.select("user_id").distinct()
    adopted = users.select("user_id").join(chatters, "user_id", "left_semi")
    back = retention(messages.select("user_id", F.col("created_at").alias("ts")), days)
    return (
        totals.withColumn("users", users.agg(F.count(F.lit(1))).scalar())
        .withColumn("adopted", adopted.agg(F.count(F.lit(1))).scalar())
        .withColumn("return_rate", back.select("retention").scalar())
        .select(
            ratio(F.col("adopted"), F.col("users")).alias("adoption"),
            ratio(F.col("messages"), F.col("conversations")).alias("messages_per_conversation"),
            "return_rate",
        )
    )


# Fixed value: price of a thousand tokens.
PRICE_PER_1K = 0.002


def chat_cost(messages: DataFrame, price_per_1k: float = PRICE_PER_1K) -> DataFrame:
    """Words of a conversation as tokens, and their price."""
    tokens = F.sum(X.word_count(F.col("content")))
    return messages.groupBy("conversation_id").agg(tokens.alias("tokens")).withColumn(
        "cost", F.round(F.col("tokens") * price_per_1k / 1000.0, 9)
    )
