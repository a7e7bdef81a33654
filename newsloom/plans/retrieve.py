"""Named queries: retrieval (I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.operators import recommend as H, retrieve as R, vectors as G
from newsloom.plans.articles import compacted
from newsloom.plans.registry import CTES, query
from newsloom.sources import tables as S, views as V

WORDS = r"regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+')"
BY_QUERY = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id)"

CTES["semantic20"] = f"""
SELECT * FROM (SELECT *, cast({BY_QUERY} AS int) AS rank FROM (
  SELECT query_id, article_id, round(coalesce(any_value(s), 0.0), 6) AS score
  FROM (SELECT q.item_id AS query_id, c.article_id, sum(q.v * c.v) AS s
    FROM benchmark_vectors q JOIN content_vectors c ON c.dim = q.dim GROUP BY 1, 2) GROUP BY 1, 2)) WHERE rank <= 20
"""
CTES["postings"] = f"""
SELECT article_id, t, count(*) AS tf FROM (SELECT article_id, unnest({WORDS.format(t='content')}) AS t FROM articles)
WHERE t <> '' GROUP BY 1, 2
"""
CTES["doc_length"] = f"""
SELECT article_id, len(list_filter({WORDS.format(t='content')}, lambda x: x <> '')) AS dl FROM articles
"""
CTES["query_words"] = f"""
SELECT DISTINCT item_id AS query_id, t FROM (SELECT item_id, unnest({WORDS.format(t='text')}) AS t FROM benchmark)
WHERE t <> ''
"""
CTES["keyword20"] = f"""
SELECT * FROM (SELECT *, cast({BY_QUERY} AS int) AS rank FROM (
  SELECT query_id, p.article_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM query_words q JOIN postings p USING (t)
  JOIN (SELECT t, count(*)::double AS df FROM postings GROUP BY t) f USING (t)
  JOIN doc_length l ON l.article_id = p.article_id,
  (SELECT count(*)::double AS n, avg(dl) AS avgdl FROM doc_length) GROUP BY 1, 2)) WHERE rank <= 20
"""
AGE = "(epoch_us(as_of) - epoch_us(published_at)) / 86400000000.0::double"
CTES["article_recency"] = f"SELECT article_id, round(1.0 / (1.0 + greatest({AGE}, 0.0)), 6) AS recency FROM articles, clock"


def in_query(source: str) -> str:
    return f"""SELECT query_id, article_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
      ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM {source}
      WINDOW w AS (PARTITION BY query_id)"""


CTES["hybrid"] = f"""
SELECT * FROM (SELECT *, cast({BY_QUERY} AS int) AS rank FROM (
  SELECT query_id, b.article_id, round(a, 6) AS semantic, round(k, 6) AS keyword, coalesce(recency, 0.0) AS recency,
    round(0.6::double * a + 0.3::double * k + 0.1::double * coalesce(recency, 0.0), 9) AS score
  FROM (SELECT coalesce(s.query_id, k.query_id) AS query_id, coalesce(s.article_id, k.article_id) AS article_id,
      coalesce(s.s, 0.0) AS a, coalesce(k.s, 0.0) AS k
    FROM ({in_query('semantic20')}) s
    FULL JOIN ({in_query('keyword20')}) k ON s.query_id = k.query_id AND s.article_id = k.article_id) b
  LEFT JOIN article_recency r ON r.article_id = b.article_id)) WHERE rank <= 5
"""
CTES["retrieved"] = """
SELECT c.conversation_id, c.user_id, p.article_id, p.rank, p.dist FROM
  (SELECT DISTINCT conversation_id, user_id FROM messages) c
JOIN (SELECT query_id, article_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, article_id) AS rank
      FROM all_pairs WHERE query_id <> article_id) p ON p.query_id = c.conversation_id % 100
WHERE p.rank <= 20
"""
CTES["cited"] = r"""
SELECT c.conversation_id, c.turn, c.position, c.citation, r.article_id, r.article_id IS NOT NULL AS valid FROM (
  SELECT conversation_id, turn, unnest(m)::bigint AS citation, cast(unnest(range(len(m))) AS int) AS position
  FROM (SELECT conversation_id, turn, regexp_extract_all(content, '\[(\d+)\]', 1) AS m FROM messages
        WHERE role = 'assistant')) c
LEFT JOIN retrieved r ON r.conversation_id = c.conversation_id AND r.rank = c.citation AND r.rank <= 5
"""


def questions(spark, d) -> DataFrame:
    return S.read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def semantic20(spark, d) -> DataFrame:
    return R.semantic_topk(questions(spark, d), V.article_texts(spark, d))


def keyword20(spark, d) -> DataFrame:
    """From the stored index, which the first query that needs it builds."""
    path = S.stored_once(spark, d, V.ARTICLE_TABLES, "keyword-index", lambda p: R.build_index(V.article_texts(spark, d), p))
    return R.indexed_topk(questions(spark, d), path)


def recency(spark, d) -> DataFrame:
    return H.recency_scores(V.articles(spark, d), compacted(spark, d))


def retrieved(spark, d, k: int = 5) -> DataFrame:
    """Articles given to each conversation: the nearest ones of a seed article."""
    chats = V.messages(spark, d).select("conversation_id", "user_id").distinct()
    seeded = chats.withColumn("query_id", F.col("conversation_id") % 100)
    v = V.vectors(spark, d)
    seeds = v.join(seeded.select(F.col("query_id").alias("article_id")), "article_id", "left_semi")
    near = G.knn_search(G.as_queries(seeds, "article_id"), v, k, exclude_self=True)
    return seeded.join(near, "query_id").select("conversation_id", "user_id", "article_id", "rank", "dist")


def answers(spark, d) -> DataFrame:
    return V.messages(spark, d).where("role = 'assistant'")


def citations(spark, d) -> DataFrame:
    return R.extract_citations(answers(spark, d), retrieved(spark, d))


@query("semantic_topk", "SELECT query_id, article_id, score, rank FROM semantic20")
def semantic_topk(spark, d) -> DataFrame:
    return semantic20(spark, d)


@query("bm25_topk", "SELECT query_id, article_id, score, rank FROM keyword20")
def bm25_topk(spark, d) -> DataFrame:
    return keyword20(spark, d)


@query("bm25_topk_grid", "SELECT query_id, article_id, score, rank FROM keyword20")
def bm25_topk_grid(spark, d) -> DataFrame:
    """The layout for query sets too large to share with every task."""
    return R.bm25_topk(questions(spark, d), V.articles(spark, d), shared_words=0)


@query(
    "retrieval_filters",
    """
WITH p AS (SELECT DISTINCT user_id, topic FROM topic_prefs),
  gone AS (SELECT DISTINCT m.user_id, c.article_id FROM cited c JOIN messages m
    ON m.conversation_id = c.conversation_id AND m.turn = c.turn WHERE c.valid)
SELECT r.conversation_id, r.user_id, r.article_id, r.rank, a.topic, a.published_at
FROM retrieved r JOIN articles a ON a.article_id = r.article_id, clock
WHERE published_at >= as_of - INTERVAL 20 DAYS
  AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = r.user_id AND g.article_id = r.article_id)
  AND (r.user_id NOT IN (SELECT user_id FROM p)
       OR EXISTS (SELECT 1 FROM p WHERE p.user_id = r.user_id AND p.topic = a.topic))
""",
)
def retrieval_filters(spark, d) -> DataFrame:
    i, a = compacted(spark, d), V.articles(spark, d)
    users = answers(spark, d).select("conversation_id", "turn", "user_id")
    discussed = citations(spark, d).where("valid").join(users, ["conversation_id", "turn"])
    oldest = i.agg((F.max("ts") - F.expr("INTERVAL 20 DAYS")).alias("t")).scalar()
    kept = R.retrieval_filters(retrieved(spark, d, 20), discussed, a, H.user_topic_prefs(i, a), oldest)
    return kept.select("conversation_id", "user_id", "article_id", F.col("rank").cast("bigint").alias("rank"), "topic", "published_at")


@query("hybrid_search", "SELECT query_id, article_id, semantic, keyword, recency, score, rank FROM hybrid")
def hybrid_search(spark, d) -> DataFrame:
    return R.hybrid_search(semantic20(spark, d), keyword20(spark, d), recency(spark, d))


CTES["click_share"] = """
SELECT article_id, round(CASE WHEN max(n) OVER () = min(n) OVER () THEN 1.0
  ELSE (n - min(n) OVER ())::double / (max(n) OVER () - min(n) OVER ()) END, 6) AS popularity
FROM (SELECT article_id, count(*) AS n FROM interactions WHERE interaction_type = 'click' GROUP BY 1)
"""


def click_share(spark, d) -> DataFrame:
    """Clicks per article, min-max scaled over the clicked articles."""
    n = H.user_item_matrix(compacted(spark, d)).groupBy("article_id").agg(F.sum("clicks").alias("n"))
    span = n.agg(F.struct(F.min("n").alias("lo"), F.max("n").alias("hi"))).scalar()
    return n.withColumn("_s", span).select(
        "article_id", F.round(R.minmax(F.col("n"), F.col("_s.lo"), F.col("_s.hi")), 6).alias("popularity")
    )


@query(
    "rerank_signals",
    """
SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY conversation_id ORDER BY score DESC, article_id) AS int)
    AS rank FROM (
  SELECT r.conversation_id, r.user_id, r.article_id,
    round(((1 - dist / 2) + coalesce(recency, 0.0) + coalesce(popularity, 0.0) + coalesce(pref, 0.0)) / 4, 9)
      AS score
  FROM retrieved r LEFT JOIN article_recency n ON n.article_id = r.article_id
  LEFT JOIN click_share c ON c.article_id = r.article_id LEFT JOIN articles a ON a.article_id = r.article_id
  LEFT JOIN topic_prefs t ON t.user_id = r.user_id AND t.topic = a.topic)) WHERE rank <= 5
""",
)
def rerank_signals(spark, d) -> DataFrame:
    i, a = compacted(spark, d), V.articles(spark, d)
    found = retrieved(spark, d, 20).select(
        "conversation_id", "user_id", "article_id", (1 - F.col("dist") / 2).alias("similarity")
    )
    best = R.rerank_signals(
        found, H.recency_scores(a, i), click_share(spark, d), a, H.user_topic_prefs(i, a), "conversation_id"
    )
    return best.select("conversation_id", "user_id", "article_id", "score", "rank")


@query(
    "rerank_model",
    f"""
SELECT * FROM (SELECT *, cast({BY_QUERY} AS int) AS rank FROM (
  SELECT s.query_id, s.article_id, round(count(p.t)::double / count(*), 6) AS score
  FROM semantic20 s JOIN query_words q ON q.query_id = s.query_id
  LEFT JOIN postings p ON p.article_id = s.article_id AND p.t = q.t GROUP BY 1, 2)) WHERE rank <= 5
""",
)
def rerank_model(spark, d) -> DataFrame:
    return R.rerank_model(semantic20(spark, d), questions(spark, d), V.articles(spark, d))


@query(
    "context_block",
    """
SELECT conversation_id, string_agg('[' || rank || '] Title: ' || title || chr(10) || '    Source: ' || source || chr(10)
  || '    Date: ' || strftime(published_at, '%Y-%m-%d %H:%M:%S') || chr(10) || '    Content: ' || substr(content, 1, 1000)
  || '...' || chr(10) || chr(10), '' ORDER BY rank) AS context
FROM retrieved r JOIN articles a ON a.article_id = r.article_id WHERE rank <= 5 GROUP BY conversation_id
""",
)
def context_block(spark, d) -> DataFrame:
    return R.context_block(retrieved(spark, d), V.articles(spark, d), "conversation_id")


WORD_COUNT = r"len(list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> ''))"
CTES["spoken"] = f"""
SELECT *, cast(coalesce(sum(words) OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS bigint) AS history_tokens
FROM (SELECT *, {WORD_COUNT.format(t='content')} AS words FROM messages)
"""


@query(
    "context_budget",
    f"""
SELECT * FROM (
  SELECT m.conversation_id, m.turn, r.article_id, cast(r.rank AS int) AS rank, tokens,
    cast(sum(tokens) OVER (PARTITION BY m.conversation_id, m.turn ORDER BY r.rank ROWS UNBOUNDED PRECEDING) AS bigint)
      AS used, 1000 - (m.words + history_tokens + 500) AS available
  FROM spoken m JOIN retrieved r ON r.conversation_id = m.conversation_id AND r.rank <= 5
  JOIN (SELECT article_id, {WORD_COUNT.format(t="title || chr(10) || substr(content, 1, 1000)")} AS tokens FROM articles) a
    ON a.article_id = r.article_id WHERE m.role = 'user') WHERE used < available
""",
)
def context_budget(spark, d) -> DataFrame:
    asked = R.history_tokens(V.messages(spark, d)).where("role = 'user'")
    return R.context_budget(asked, retrieved(spark, d), V.articles(spark, d), max_tokens=1000)


@query("extract_citations", "SELECT conversation_id, turn, position, citation, article_id, valid FROM cited")
def extract_citations(spark, d) -> DataFrame:
    return citations(spark, d)


@query(
    "citation_accuracy",
    """
SELECT (SELECT count(*) FROM messages WHERE role = 'assistant') AS answers,
  (SELECT count(*) FROM messages m WHERE role = 'assistant' AND NOT EXISTS (
    SELECT 1 FROM cited c WHERE c.conversation_id = m.conversation_id AND c.turn = m.turn)) AS uncited,
  count(*) AS citations, count(*) FILTER (valid) AS valid, round(count(*) FILTER (valid)::double / count(*), 6) AS accuracy
FROM cited
""",
)
def citation_accuracy(spark, d) -> DataFrame:
    return R.citation_accuracy(answers(spark, d), citations(spark, d))


@query(
    "source_usage",
    """
SELECT article_id, count(*) AS citations, count(DISTINCT (conversation_id, turn)) AS answers
FROM cited WHERE valid GROUP BY article_id
""",
)
def source_usage(spark, d) -> DataFrame:
    return R.source_usage(citations(spark, d))


@query(
    "query_cache_hits",
    """
WITH RECURSIVE log AS (
  SELECT md5(lower('News about article ' || json_extract_string(props, '$.k'))) AS key, ts FROM events),
misses AS (
  SELECT key, min(ts) AS missed FROM log GROUP BY key
  UNION ALL
  SELECT m.key, (SELECT min(l.ts) FROM log l WHERE l.key = m.key AND epoch_us(l.ts) >= epoch_us(m.missed) + 3600000000) AS missed
  FROM misses m WHERE m.missed IS NOT NULL)
SELECT key, requests, misses, requests - misses AS hits, round((requests - misses)::double / requests, 6) AS hit_rate
FROM (SELECT key, count(*) AS requests FROM log GROUP BY key)
JOIN (SELECT key, count(missed) AS misses FROM misses GROUP BY key) USING (key)
""",
)
def query_cache_hits(spark, d) -> DataFrame:
    """Every event as a question about its article."""
    asked = F.concat(F.lit("News about article "), F.get_json_object("props", "$.k"))
    return R.query_cache_hits(S.read_table(spark, d, "events").select(asked.alias("text"), "ts"))


@query(
    "retrieval_eval",
    """
WITH j AS (SELECT n.query_id, n.rank, q.label = a.label AS relevant FROM (
    SELECT query_id, article_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, article_id) AS rank
    FROM all_pairs WHERE query_id <> article_id) n
  JOIN embeddings q ON q.vec_id = n.query_id JOIN embeddings a ON a.vec_id = n.article_id WHERE n.rank <= 10),
 h AS (SELECT *, sum(relevant::int) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM j),
 t AS (SELECT query_id, sum(relevant::int) AS hits, sum(CASE WHEN relevant THEN hits::double / rank END) AS cp
   FROM h GROUP BY query_id),
 n AS (SELECT vec_id AS query_id, count(*) OVER (PARTITION BY label) - 1 AS total FROM embeddings)
SELECT count(*) AS queries, round(avg(hits / 10.0::double), 6) AS precision_at_k,
  round(avg(coalesce(hits::double / nullif(total, 0), 0)), 6) AS recall_at_k,
  round(avg(coalesce(cp / nullif(hits, 0), 0)), 6) AS context_precision FROM t JOIN n USING (query_id)
""",
)
def retrieval_eval(spark, d) -> DataFrame:
    """Nearest neighbours of every vector; those of the same label are relevant."""
    v, e = V.vectors(spark, d), S.read_table(spark, d, "embeddings").select("vec_id", "label")
    mine = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("_q"))
    other = e.select(F.col("vec_id").alias("article_id"), F.col("label").alias("_a"))
    judged = G.similar_articles(v, 10).join(mine, "query_id").join(other, "article_id").select(
        "query_id", "rank", (F.col("_q") == F.col("_a")).alias("relevant")
    )
    sizes = e.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("relevant_total"))
    totals = e.join(sizes, "label").select(F.col("vec_id").alias("query_id"), "relevant_total")
    return R.retrieval_eval(judged, totals, 10)
