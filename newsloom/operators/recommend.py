"""User profiles, candidate signals and the ensemble feed."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from newsloom.functions.cooccurrence import item_neighbours, neighbour_scores
from newsloom.functions.feedblocks import score_feeds
from newsloom.functions.scale import dense_positions, minmax, r6
from newsloom.functions.topk import to_ids, to_matrix, top_k
from newsloom.schemas import TOPICS
from newsloom.session import set_checkpoint_dir
from newsloom.sources.tables import materialize

# Weights of content, collaborative, topic and popularity signals.
WEIGHTS = (0.35, 0.35, 0.20, 0.10)
FEED_SIZE = 20
MIN_PER_TOPIC = 2
HALF_LIFE_DAYS = 7.0
SKETCH_DIM = 64
#: Neighbours that an article keeps.
NEIGHBOURS = 50


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def age_days(now: Column, ts: Column) -> Column:
    return (seconds(now) - seconds(ts)) / F.lit(86400.0)


def with_as_of(df: DataFrame, interactions: DataFrame) -> DataFrame:
    """Add `as_of`, the time of the newest interaction; never the wall clock."""
    return df.withColumn("as_of", interactions.agg(F.max("ts")).scalar())


# --- profiles --------------------------------------------------------------------------------


def _reads_by_topic(interactions: DataFrame, articles: DataFrame) -> DataFrame:
    """Reads with the topic of their article."""
    topics = articles.where(F.col("topic").isNotNull()).select("article_id", "topic")
    return interactions.where("interaction_type = 'read'").join(topics, "article_id")


def _share_of_user(amounts: DataFrame, amount: str) -> DataFrame:
    """amount / sum of the user's amounts; a user has one row per topic."""
    total = F.sum(amount).over(Window.partitionBy("user_id"))
    return amounts.withColumn("pref", r6(F.col(amount) / total))


def user_topic_prefs(interactions: DataFrame, articles: DataFrame) -> DataFrame:
    """Share of a user's reads per topic."""
    counts = _reads_by_topic(interactions, articles).groupBy("user_id", "topic").agg(F.count(F.lit(1)).alias("reads"))
    return _share_of_user(counts, "reads")


def decayed_topic_prefs(interactions: DataFrame, articles: DataFrame) -> DataFrame:
    """The same with every read halved for each week of age."""
    reads = with_as_of(_reads_by_topic(interactions, articles), interactions)
    weight = F.pow(F.lit(0.5), age_days(F.col("as_of"), F.col("ts")) / HALF_LIFE_DAYS)
    sums = reads.groupBy("user_id", "topic").agg(F.sum(weight).alias("_w"))
    return _share_of_user(sums, "_w").select("user_id", "topic", r6(F.col("_w")).alias("weight"), "pref")


def user_profile_embedding(interactions: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, profile, likes): mean vector of the liked articles. Sums merge before the shuffle."""
    liked = interactions.where("interaction_type = 'like'").select("user_id", "article_id")
    v = vectors.select("article_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("_v"))
    means = liked.join(v, "article_id").groupBy("user_id").agg(
        Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("likes")
    )
    return means.select("user_id", vector_to_array("_m").alias("profile"), "likes")


def length_bucket(content: Column) -> Column:
    n = F.length(content)
    return F.when(n < 500, "short").when(n < 2000, "medium").when(n < 5000, "long").otherwise("very long")


def reading_patterns(interactions: DataFrame, articles: DataFrame) -> DataFrame:
    """A user's reads by hour of day and article length."""
    lengths = articles.select("article_id", length_bucket(F.col("content")).alias("length"))
    reads = interactions.where("interaction_type = 'read'").join(lengths, "article_id")
    return reads.groupBy("user_id", F.hour("ts").alias("hour"), "length").agg(F.count(F.lit(1)).alias("reads"))


def user_item_matrix(interactions: DataFrame) -> DataFrame:
    """Clicks per (user, article) in long form."""
    clicks = interactions.where("interaction_type = 'click'")
    return clicks.groupBy("user_id", "article_id").agg(F.count(F.lit(1)).alias("clicks"))


# --- signals ---------------------------------------------------------------------------------


def candidate_articles(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """Completed articles that have a vector."""
    done = articles.where("processing_status = 'completed'").select("article_id", "topic", "published_at")
    return done.join(vectors.select("article_id", "embedding"), "article_id")


def content_scores(profiles: DataFrame, candidates: DataFrame, k: int = FEED_SIZE, **options) -> DataFrame:
    """Candidates closest to a user's profile by cosine."""
    queries = profiles.select(F.col("user_id").alias("query_id"), F.col("profile").alias("vector"))
    v = candidates.select("article_id", F.col("embedding").cast("array<double>").alias("vector"))
    return top_k(queries, v, k, "cosine", **options).withColumnRenamed("query_id", "user_id")


def topic_scores(pairs: DataFrame, prefs: DataFrame, articles: DataFrame) -> DataFrame:
    """Add the user's preference for the topic of each article; 0 where there is none."""
    topics = articles.select("article_id", "topic")
    return (
        pairs.join(topics, "article_id", "left")
        .join(prefs.select("user_id", "topic", "pref"), ["user_id", "topic"], "left")
        .withColumn("topic_score", F.coalesce("pref", F.lit(0.0)))
        .drop("pref")
    )


def _clicks_24h(interactions: DataFrame) -> DataFrame:
    recent = with_as_of(interactions.where("interaction_type = 'click'"), interactions)
    day = recent.where(F.col("ts") > F.col("as_of") - F.expr("INTERVAL 24 HOURS"))
    return day.groupBy("article_id").agg(F.count(F.lit(1)).alias("clicks"))


def trending_24h(interactions: DataFrame, k: int = 20) -> DataFrame:
    """Most clicked articles of the last 24 hours."""
    return _clicks_24h(interactions).orderBy(F.col("clicks").desc(), "article_id").limit(k)


def recency(now: Column, published: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.greatest(age_days(now, published), F.lit(0.0)))


def recency_scores(articles: DataFrame, interactions: DataFrame) -> DataFrame:
    dated = with_as_of(articles.select("article_id", "published_at"), interactions)
    return dated.select("article_id", r6(recency(F.col("as_of"), F.col("published_at"))).alias("recency"))


def popularity(candidates: DataFrame, interactions: DataFrame) -> DataFrame:
    """Candidates plus popularity: half scaled 24-hour clicks, half recency."""
    joined = candidates.join(_clicks_24h(interactions), "article_id", "left").fillna(0, ["clicks"])
    span = joined.agg(F.struct(F.min("clicks").alias("low"), F.max("clicks").alias("high"))).scalar()
    full = with_as_of(joined, interactions).withColumn("_s", span)
    trend = minmax(F.col("clicks"), F.col("_s.low"), F.col("_s.high"))
    score = r6(0.5 * trend + 0.5 * recency(F.col("as_of"), F.col("published_at")))
    return full.withColumn("popularity", score).drop("_s", "as_of", "clicks")


# --- collaborative factors -------------------------------------------------------------------


# Settings of the factorisation, which folding in repeats.
RANK, REGULARISATION, ALPHA = 16, 0.05, 10.0


def als_factors(matrix: DataFrame, rank: int = RANK, iterations: int = 8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(user factors, article factors) of implicit matrix factorisation on click counts.

    Ids of any size are numbered 0, 1, 2, ... first, since the factorisation wants small integers. Rows with a null are left out.
    """
    set_checkpoint_dir(matrix.sparkSession)
    clicks = matrix.select("user_id", "article_id", "clicks").dropna()
    numbers = {
        key: materialize(dense_positions(clicks.select(key).distinct(), key, "number"), f"{key}-numbers")
        for key in ("user_id", "article_id")
    }
    ratings = (
        clicks.join(numbers["user_id"].withColumnRenamed("number", "user"), "user_id")
        .join(numbers["article_id"].withColumnRenamed("number", "item"), "article_id")
        .select(F.col("user").cast("int").alias("user"), F.col("item").cast("int").alias("item"), F.col("clicks").cast("float").alias("rating"))
    )
    model = ALS(
        rank=rank, maxIter=iterations, regParam=REGULARISATION, alpha=ALPHA, implicitPrefs=True, seed=seed, userCol="user",
        itemCol="item", ratingCol="rating",
    ).fit(ratings)
    named = lambda factors, key: factors.join(numbers[key], F.col("id") == F.col("number")).select(
        key, F.col("features").cast("array<double>").alias("factor")
    )
    return named(model.userFactors, "user_id"), named(model.itemFactors, "article_id")


def fold_in_users(matrix: DataFrame, article_factors: DataFrame) -> DataFrame:
    """(user_id, factor) of the users in `matrix` (all clicks of new or changed users) for fixed article factors.

    A user's factor solves (Y'Y + sum of alpha r y y' + reg n I) x = sum of (1 + alpha r) y over the n clicked articles with counts
    r and factors y: one half-step of the factorisation. The sums merge before the shuffle, so a user with any number of
    clicks sends one row per task; Y'Y is one small matrix. Articles without a factor count nothing.
    """
    y = article_factors.select("article_id", F.col("factor").cast("array<double>").alias("factor"))
    outer = F.flatten(F.transform("factor", lambda a: F.transform("factor", lambda b: a * b)))
    gram = y.select(array_to_vector(outer).alias("_g")).groupBy(F.lit(1)).agg(Summarizer.sum(F.col("_g")).alias("g")).first()
    if gram is None:
        return matrix.sparkSession.createDataFrame([], "user_id bigint, factor array<double>")
    size = int(round(len(gram["g"]) ** 0.5))
    whole = gram["g"].toArray().reshape(size, size)
    strength = F.lit(ALPHA) * F.col("clicks").cast("double")
    rows = matrix.select("user_id", "article_id", "clicks").dropna().where("clicks > 0").join(y, "article_id").select(
        "user_id",
        array_to_vector(F.transform(outer, lambda v: v * strength)).alias("_a"),
        array_to_vector(F.transform("factor", lambda v: v * (1 + strength))).alias("_b"),
    )
    sums = rows.groupBy("user_id").agg(
        Summarizer.sum(F.col("_a")).alias("_a"), Summarizer.sum(F.col("_b")).alias("_b"), F.count(F.lit(1)).cast("double").alias("_n")
    )

    @F.arrow_udf("array<double>")
    def solve(a: pa.Array, b: pa.Array, n: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.list_(pa.float64()))
        left = to_matrix(a).reshape(-1, size, size) + whole + REGULARISATION * to_ids(n)[:, None, None] * np.eye(size)
        solved = np.linalg.solve(left, to_matrix(b)[:, :, None])[:, :, 0]
        return pa.ListArray.from_arrays(np.arange(0, solved.size + 1, size, dtype=np.int32), solved.ravel())

    return sums.select("user_id", solve(vector_to_array("_a"), vector_to_array("_b"), F.col("_n")).alias("factor"))


def sketch_factors(matrix: DataFrame, dim: int = SKETCH_DIM) -> tuple[DataFrame, DataFrame]:
    """(user factors, article factors) whose dot product estimates item-item cosine on clicks.

    An article is its set of clickers, every user hashed to one of `dim` slots with a sign and
    scaled by 1 / sqrt(clickers); a user is the sum of the clicked articles. Dot products of such
    sketches keep co-click cosines in expectation, so no pair of co-clicked articles is ever
    listed: cost is linear in the clicks even when one user or article holds most of them.
    """
    h = F.md5(F.col("user_id").cast("string").cast("binary"))
    slot = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dim
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("bigint") % 2 == 0, 1.0).otherwise(-1.0)
    one_hot = F.transform(
        F.array(F.struct(slot.alias("d"), sign.alias("s"))),
        lambda p: F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i == p["d"], p["s"]).otherwise(F.lit(0.0))
        ),
    )
    hot = matrix.select("user_id", "article_id", array_to_vector(F.get(one_hot, F.lit(0))).alias("_v"))
    sums = hot.groupBy("article_id").agg(Summarizer.sum(F.col("_v")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    items = sums.select(
        "article_id",
        F.transform(vector_to_array("_s"), lambda x: x / F.sqrt(F.col("_n").cast("double"))).alias("factor"),
    )
    joined = matrix.select("user_id", "article_id").join(items, "article_id")
    users = joined.groupBy("user_id").agg(Summarizer.sum(array_to_vector("factor")).alias("_s"))
    return users.select("user_id", vector_to_array("_s").alias("factor")), items


@dataclass(frozen=True)
class Collaborative:
    """The collaborative part of a feed: dense factors of users and articles, or values of (user, article) pairs.

    With `near` the factors are empty arrays that only say who has clicks; a pair of a user and an article with clicks that has no row
    there has the value 0.
    """

    users: DataFrame
    articles: DataFrame
    near: DataFrame | None = None


def als_collaborative(matrix: DataFrame, **als) -> Collaborative:
    return Collaborative(*als_factors(matrix, **als))


def neighbour_collaborative(matrix: DataFrame, k: int = NEIGHBOURS, **options) -> Collaborative:
    """Item-item cosine on clicks: an article's value is the sum of its cosines to the clicked articles that have it among
    their k best neighbours. Exact; see `item_neighbours`."""
    none = F.array().cast("array<double>").alias("factor")
    stored = materialize(item_neighbours(matrix, k, **options), "item-neighbours")
    return Collaborative(
        matrix.select("user_id").distinct().select("user_id", none),
        matrix.select("article_id").distinct().select("article_id", none),
        neighbour_scores(matrix, stored),
    )


# --- ensemble --------------------------------------------------------------------------------


def topic_index(topic: Column) -> Column:
    """Position of a topic among the known ones; the number of topics for any other."""
    index = F.lit(len(TOPICS))
    for i, t in enumerate(sorted(TOPICS)):
        index = F.when(topic == TOPICS[t], i).otherwise(index)
    return index.cast("int")


def read_pairs(interactions: DataFrame) -> DataFrame:
    return interactions.where("interaction_type = 'read'").select("user_id", "article_id").distinct()


def ensemble_scores(
    interactions: DataFrame,
    articles: DataFrame,
    vectors: DataFrame,
    collaborative: Collaborative,
    n: int = FEED_SIZE,
    per_topic: int = 0,
    weights: Column | None = None,
    **options,
) -> DataFrame:
    """Best unread candidates of every active user under the weighted sum of scaled signals.

    content, collab and topic_fit are min-max scaled over the user's unread candidates.
    """
    prefs = user_topic_prefs(interactions, articles).groupBy("user_id").agg(
        F.array(*[F.max(F.when(F.col("topic") == TOPICS[t], F.col("pref"))) for t in sorted(TOPICS)]).alias("prefs")
    )
    users = (
        interactions.select("user_id")
        .distinct()
        .join(user_profile_embedding(interactions, vectors).drop("likes"), "user_id", "left")
        .join(collaborative.users, "user_id", "left")
        .join(prefs, "user_id", "left")
        .withColumn("weights", F.array(*[F.lit(w) for w in WEIGHTS]) if weights is None else weights)
    )
    candidates = (
        popularity(candidate_articles(articles, vectors), interactions)
        .join(collaborative.articles, "article_id", "left")
        .select(
            "article_id",
            F.col("embedding").cast("array<double>").alias("vector"),
            "factor",
            topic_index(F.col("topic")).alias("topic_index"),
            "popularity",
        )
    )
    return score_feeds(users, candidates, read_pairs(interactions), n, per_topic, near=collaborative.near, **options)


def best_first(partition: str = "user_id") -> WindowSpec:
    return Window.partitionBy(partition).orderBy(F.col("score").desc(), "article_id")


def top_n(scored: DataFrame, n: int = FEED_SIZE) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(best_first())).where(F.col("rank") <= n)


def exclude_read(pairs: DataFrame, interactions: DataFrame) -> DataFrame:
    return pairs.join(read_pairs(interactions), ["user_id", "article_id"], "left_anti")


def diversify(scored: DataFrame, n: int = FEED_SIZE, per_topic: int = MIN_PER_TOPIC) -> DataFrame:
    """At least `per_topic` articles of every topic, the rest by score, n in all, best first."""
    in_topic = Window.partitionBy("user_id", "topic").orderBy(F.col("score").desc(), "article_id")
    must = F.col("topic").isNotNull() & (F.row_number().over(in_topic) <= per_topic)
    order = Window.partitionBy("user_id").orderBy(F.col("_must").desc(), F.col("score").desc(), "article_id")
    picked = (
        scored.withColumn("_must", must)
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= n)
        .drop("_must", "_place")
    )
    return picked.withColumn("rank", F.row_number().over(best_first()))


def feed(interactions, articles, vectors, collaborative: Collaborative, n: int = FEED_SIZE, per_topic: int = MIN_PER_TOPIC, **options):
    """Personal feed of every active user: ensemble, unread only, diversified."""
    scored = ensemble_scores(interactions, articles, vectors, collaborative, n, per_topic, **options)
    return diversify(scored, n, per_topic)


def als_scores(interactions: DataFrame, candidates: DataFrame, k: int = FEED_SIZE, **als) -> DataFrame:
    """Unread candidates with the highest factor products."""
    user_factors, article_factors = als_factors(user_item_matrix(interactions), **als)
    users = user_factors.withColumns(
        {
            "profile": F.lit(None).cast("array<double>"),
            "prefs": F.lit(None).cast("array<double>"),
            "weights": F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)),
        }
    )
    items = candidates.join(article_factors, "article_id").select(
        "article_id",
        F.col("embedding").cast("array<double>").alias("vector"),
        "factor",
        topic_index(F.col("topic")).alias("topic_index"),
        F.lit(0.0).alias("popularity"),
    )
    return top_n(score_feeds(users, items, read_pairs(interactions), k), k).select(
        "user_id", "article_id", "score", "rank"
    )


def cold_start_feed(visitors: DataFrame, interactions, articles, vectors, n: int = FEED_SIZE) -> DataFrame:
    """Popular and recent articles for everyone without history. The list is n rows, as a scalar."""
    best = (
        popularity(candidate_articles(articles, vectors), interactions)
        .orderBy(F.col("popularity").desc(), "article_id")
        .limit(n)
    )
    item = F.struct((-F.col("popularity")).alias("key"), "article_id", F.col("popularity").alias("score"))
    ranked = best.agg(F.array_sort(F.collect_list(item))).scalar()
    cold = visitors.select("user_id").distinct().join(interactions.select("user_id"), "user_id", "left_anti")
    out = cold.withColumn("_list", ranked).select("user_id", F.posexplode("_list").alias("_i", "_a"))
    return out.select(
        "user_id", F.col("_a.article_id").alias("article_id"), F.col("_a.score").alias("score"),
        (F.col("_i") + 1).alias("rank"),
    )


CACHE_MINUTES = 30


def cached_feed(feeds: DataFrame, generated_at: Column) -> DataFrame:
    """Feeds stamped with the time they were made and the time they expire."""
    return feeds.withColumn("generated_at", generated_at).withColumn(
        "expires_at", F.col("generated_at") + F.expr(f"INTERVAL {CACHE_MINUTES} MINUTES")
    )


def read_cached(cache: DataFrame, at: Column) -> DataFrame:
    """Rows that are valid at a time; where several generations are, the newest per user."""
    valid = cache.withColumn("_at", at).where((F.col("generated_at") <= F.col("_at")) & (F.col("_at") < F.col("expires_at")))
    newest = valid.groupBy("user_id").agg(F.max("generated_at").alias("generated_at"))
    return valid.drop("_at").join(newest, ["user_id", "generated_at"])


# The second set of weights of the comparison.
WEIGHTS_B = (0.25, 0.25, 0.30, 0.20)


def ab_variant(user_id: Column) -> Column:
    return F.when(user_id % 2 == 0, "A").otherwise("B")


def ab_weights() -> Column:
    """Weights by the user's variant, for `ensemble_scores`."""
    arr = lambda ws: F.array(*[F.lit(w) for w in ws])
    return F.when(ab_variant(F.col("user_id")) == "A", arr(WEIGHTS)).otherwise(arr(WEIGHTS_B))


def ensemble_ab(interactions: DataFrame) -> DataFrame:
    """Click rate per variant: clicks over clicks and skips."""
    kind = F.col("interaction_type")
    sums = interactions.groupBy(ab_variant(F.col("user_id")).alias("variant")).agg(
        F.countDistinct("user_id").alias("users"),
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "skip").alias("skips"),
    )
    return sums.withColumn("ctr", r6(F.try_divide(F.col("clicks").cast("double"), F.col("clicks") + F.col("skips"))))


def explain_top_signal(scored: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Name of the weighted part that adds most to the score; the earlier one on a tie."""
    names = ("content", "collab", "topic_fit", "popularity")
    parts = [F.round(F.col(c) * w, 8) for c, w in zip(names, weights)]
    best = F.greatest(*parts)
    signal = F.when(parts[0] == best, names[0])
    for name, part in zip(names[1:], parts[1:]):
        signal = signal.when(part == best, name)
    return scored.withColumns({"signal": signal, "share": best})
