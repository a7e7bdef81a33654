"""Retrieval over articles: semantic, keyword and hybrid search, re-ranking, context, citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.functions import text as X
from newsloom.functions.keyword_index import build_keyword_index, read_keyword_index, search_keyword_index
from newsloom.functions.keywords import bm25_top_k
from newsloom.functions.ordered import sum_before
from newsloom.functions.scale import minmax, r6, ratio
from newsloom.functions.topk import top_k
from newsloom.functions.ttlcache import cache_hits
from newsloom.operators import embed as M
from newsloom.sources.tables import materialize

# Hybrid weights of semantic, keyword and recency scores.
HYBRID = (0.6, 0.3, 0.1)
# Weighted sums of scores that are already rounded keep more places, so that rounding never meets a tie.
SCORE_PLACES = 9
CANDIDATES = 20
FINAL = 5


def semantic_topk(queries: DataFrame, articles: DataFrame, k: int = CANDIDATES, **options) -> DataFrame:
    """Articles closest in meaning. queries: (query_id, text); articles: (article_id, content)."""
    embed = lambda df, key, text: df.select(key, M.embed_text(F.col(text)).alias("vector")).where(
        M.nonzero(F.col("vector"))
    )
    return top_k(embed(queries, "query_id", "text"), embed(articles, "article_id", "content"), k, "dot", **options)


def bm25_topk(queries: DataFrame, articles: DataFrame, k: int = CANDIDATES, **options) -> DataFrame:
    """Articles that match the query's words best."""
    return bm25_top_k(articles.select("article_id", F.col("content").alias("text")), queries, k, **options)


def build_index(articles: DataFrame, path: str) -> None:
    """Write the keyword index of the articles' contents."""
    build_keyword_index(articles.select("article_id", F.col("content").alias("text")), path)


def indexed_topk(queries: DataFrame, path: str, k: int = CANDIDATES) -> DataFrame:
    """As `bm25_topk`, from the stored index: texts are not read."""
    return search_keyword_index(read_keyword_index(queries.sparkSession, path), queries, k, materialize)


def retrieval_filters(
    found: DataFrame, discussed: DataFrame, articles: DataFrame, prefs: DataFrame, oldest: Column
) -> DataFrame:
    """Drop articles the user already discussed, older ones, and topics the user never reads.

    A user without known topics keeps all topics.
    """
    dated = articles.select("article_id", "topic", "published_at")
    liked = prefs.select("user_id", "topic", F.lit(True).alias("_ok")).distinct()
    known = prefs.select("user_id", F.lit(True).alias("_known")).distinct()
    return (
        found.join(discussed.select("user_id", "article_id"), ["user_id", "article_id"], "left_anti")
        .join(dated, "article_id")
        .withColumn("_oldest", oldest)
        .where(F.col("published_at") >= F.col("_oldest"))
        .join(liked, ["user_id", "topic"], "left")
        .join(known, "user_id", "left")
        .where(F.col("_ok").isNotNull() | F.col("_known").isNull())
        .drop("_ok", "_known", "_oldest")
    )


def _scaled_in_query(found: DataFrame, name: str) -> DataFrame:
    """Min-max scores inside a query; a query has at most k rows here."""
    w = Window.partitionBy("query_id")
    return found.select(
        "query_id", "article_id", minmax(F.col("score"), F.min("score").over(w), F.max("score").over(w)).alias(name)
    )


def hybrid_search(semantic: DataFrame, keyword: DataFrame, recency: DataFrame, k: int = FINAL) -> DataFrame:
    """Weighted sum of scaled semantic and keyword scores and recency; a missing score is 0."""
    both = _scaled_in_query(semantic, "semantic").join(
        _scaled_in_query(keyword, "keyword"), ["query_id", "article_id"], "full"
    )
    # Stored, so that few found articles are sent to the recencies of all.
    both = materialize(both, "found")
    found = recency.select("article_id", "recency").join(both.select("article_id"), "article_id", "left_semi")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scored = both.join(found, "article_id", "left").select(
        "query_id", "article_id", r6(zero("semantic")).alias("semantic"), r6(zero("keyword")).alias("keyword"),
        zero("recency").alias("recency"),
        F.round(
            HYBRID[0] * zero("semantic") + HYBRID[1] * zero("keyword") + HYBRID[2] * zero("recency"), SCORE_PLACES
        ).alias("score"),
    )
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "article_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rerank_signals(
    found: DataFrame, recency: DataFrame, popularity: DataFrame, topics: DataFrame, prefs: DataFrame, key: str,
    k: int = FINAL,
) -> DataFrame:
    """Mean of similarity, recency, popularity and topic preference; best k per key.

    found: (key, user_id, article_id, similarity).
    """
    names = ("similarity", "recency", "popularity", "pref")
    joined = (
        found.join(recency.select("article_id", "recency"), "article_id", "left")
        .join(popularity.select("article_id", "popularity"), "article_id", "left")
        .join(topics.select("article_id", "topic"), "article_id", "left")
        .join(prefs.select("user_id", "topic", "pref"), ["user_id", "topic"], "left")
        .fillna(0.0, list(names))
    )
    total = F.col(names[0])
    for n in names[1:]:
        total = total + F.col(n)
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "article_id")
    return (
        joined.withColumn("score", F.round(total / len(names), SCORE_PLACES))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text holds: the default pair scorer."""
    q = F.array_distinct(X.tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, X.tokens(text))).cast("double"), F.size(q)), F.lit(0.0))


PairScorer = Callable[[list[str], list[str]], list[float]]


def pair_model(load: Callable[[], PairScorer]) -> Callable[[Column, Column], Column]:
    """Any model that scores (query, text) pairs, called once per Arrow batch."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in batches:
            yield pd.Series(model(q.fillna("").tolist(), t.fillna("").tolist()), dtype="float64")

    return score


def rerank_model(
    found: DataFrame, queries: DataFrame, articles: DataFrame, k: int = FINAL,
    scorer: Callable[[Column, Column], Column] = token_overlap,
) -> DataFrame:
    """Score the candidates' full texts against their query and keep the best k."""
    texts = articles.select("article_id", "content")
    pairs = found.select("query_id", "article_id").join(queries, "query_id").join(texts, "article_id")
    scored = pairs.select("query_id", "article_id", r6(scorer(F.col("text"), F.col("content"))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "article_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


CONTEXT_CHARS = 1000


def context_block(ranked: DataFrame, articles: DataFrame, key: str) -> DataFrame:
    """Numbered article texts of each key, in rank order. ranked: (key, article_id, rank)."""
    shown = articles.select(
        "article_id", "title", "source", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.substring("content", 1, CONTEXT_CHARS).alias("content"),
    )
    block = F.format_string(
        "[%d] Title: %s\n    Source: %s\n    Date: %s\n    Content: %s...\n\n",
        F.col("rank"), F.col("title"), F.col("source"), F.col("date"), F.col("content"),
    )
    parts = ranked.join(shown, "article_id").select(key, F.struct("rank", block.alias("text")).alias("_p"))
    return parts.groupBy(key).agg(F.array_sort(F.collect_list("_p")).alias("_p")).select(
        key, F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("context")
    )


RESERVED_TOKENS = 500


def context_budget(
    questions: DataFrame, ranked: DataFrame, articles: DataFrame, max_tokens: int = 6000
) -> DataFrame:
    """Articles that fit the prompt, taken in rank order until the first that does not.

    questions: (conversation_id, turn, content, history_tokens); ranked: (conversation_id,
    article_id, rank) with a handful of ranks per conversation.
    """
    sized = articles.select(
        "article_id",
        X.word_count(F.concat("title", F.lit("\n"), F.substring("content", 1, CONTEXT_CHARS))).alias("tokens"),
    )
    room = F.lit(max_tokens) - (X.word_count(F.col("content")) + F.col("history_tokens") + RESERVED_TOKENS)
    w = Window.partitionBy("conversation_id", "turn").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return (
        questions.withColumn("available", room)
        .join(ranked.join(sized, "article_id"), "conversation_id")
        .withColumn("used", F.sum("tokens").over(w))
        .where(F.col("used") < F.col("available"))
        .select("conversation_id", "turn", "article_id", "rank", "tokens", "used", "available")
    )


def history_tokens(messages: DataFrame) -> DataFrame:
    """Messages with the number of words said before in the conversation."""
    counted = messages.withColumn("_words", X.word_count(F.col("content")))
    return sum_before(counted, ["conversation_id"], "turn", "_words", "history_tokens").drop("_words")


def extract_citations(answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """Every [n] of every answer in order, with the n-th retrieved article.

    A number outside 1..n retrieved is invalid and has no article.
    """
    found = answers.select(
        "conversation_id", "turn",
        F.posexplode(F.regexp_extract_all("content", F.lit(r"\[(\d+)\]"), F.lit(1))).alias("position", "_c"),
    ).withColumn("citation", F.expr("try_cast(_c AS bigint)"))
    listed = ranked.select("conversation_id", F.col("rank").cast("bigint").alias("citation"), "article_id")
    return found.join(listed, ["conversation_id", "citation"], "left").select(
        "conversation_id", "turn", "position", "citation", "article_id", F.col("article_id").isNotNull().alias("valid")
    )


def citation_accuracy(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Valid share of all citations, and answers that cite nothing."""
    cited = citations.select("conversation_id", "turn", F.lit(1).alias("_c")).distinct()
    plain = answers.join(cited, ["conversation_id", "turn"], "left").agg(
        F.count(F.lit(1)).alias("answers"), F.count_if(F.col("_c").isNull()).alias("uncited")
    )
    totals = citations.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("v"))).scalar()
    return plain.withColumn("_t", totals).select(
        "answers", "uncited", F.col("_t.n").alias("citations"), F.col("_t.v").alias("valid"),
        ratio(F.col("_t.v"), F.col("_t.n")).alias("accuracy"),
    )


def source_usage(citations: DataFrame) -> DataFrame:
    """How often each article backed an answer."""
    pair = F.struct("conversation_id", "turn")
    return citations.where("valid").groupBy("article_id").agg(
        F.count(F.lit(1)).alias("citations"), F.countDistinct(pair).alias("answers")
    )


def query_cache_hits(log: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Cache hits per query text, ignoring case. log: (text, ts)."""
    keyed = log.select(F.md5(F.lower("text").cast("binary")).alias("key"), "ts")
    return cache_hits(keyed, "key", "ts", ttl_seconds)


def retrieval_eval(judged: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """Mean precision@k, recall@k and context precision over the queries.

    judged: (query_id, rank, relevant) up to rank k; totals: (query_id, relevant_total).
    Context precision is the mean of precision@i over the ranks i that hold a relevant article.
    """
    hit = F.col("relevant").cast("int")
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    per_query = (
        judged.where(F.col("rank") <= k)
        .withColumn("_hits", F.sum(hit).over(so_far))
        .groupBy("query_id")
        .agg(
            F.sum(hit).alias("hits"),
            F.sum(F.when(F.col("relevant"), F.col("_hits") / F.col("rank"))).alias("_cp"),
        )
        .join(totals, "query_id")
    )
    zero = F.lit(0.0)
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"),
        r6(F.avg(F.col("hits") / F.lit(float(k)))).alias("precision_at_k"),
        r6(F.avg(F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("relevant_total")), zero))).alias(
            "recall_at_k"
        ),
        r6(F.avg(F.coalesce(F.try_divide(F.col("_cp"), F.col("hits")), zero))).alias("context_precision"),
    )
