"""Named queries: embedding and similarity (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.functions import vectors as L
from newsloom.operators import embed as E
from newsloom.plans.registry import CTES, query
from newsloom.sources import views as V


def hashed_sql(source: str, key: str, text: str) -> str:
    """Long-form unit vectors of a text column: (key, dim, v) without rounding."""
    return rf"""
SELECT {key}, dim, s / sqrt(sum(s * s) OVER (PARTITION BY {key})) AS v FROM (
  SELECT {key}, cast(('0x' || substr(h, 1, 8)) AS bigint) % 384 AS dim,
    sum(CASE WHEN cast(('0x' || substr(h, 9, 1)) AS bigint) % 2 = 0 THEN 1 ELSE -1 END)::double AS s
  FROM (SELECT {key}, md5(t) AS h FROM (
    SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+')) AS t FROM {source}) WHERE t <> '')
  GROUP BY 1, 2) WHERE s <> 0
"""


CTES["content_vectors"] = hashed_sql("articles", "article_id", "content")
CTES["title_vectors"] = hashed_sql("articles", "article_id", "title")
CTES["benchmark_vectors"] = hashed_sql("benchmark", "item_id", "text")


@query(
    "embedding_text",
    """
SELECT article_id, CASE WHEN length(title || chr(10) || chr(10) || content) <= 2000
    THEN title || chr(10) || chr(10) || content
  WHEN 2000 - length(title) - 10 > 0
    THEN title || chr(10) || chr(10) || substr(content, 1, 2000 - length(title) - 10) || '...'
  ELSE title END AS text FROM articles
""",
)
def embedding_text(spark, d) -> DataFrame:
    return V.articles(spark, d).select("article_id", E.embedding_text(F.col("title"), F.col("content")).alias("text"))


@query("embed_text", "SELECT article_id, cast(dim AS int) AS dim, round(v, 6) AS v FROM content_vectors")
def embed_text(spark, d) -> DataFrame:
    return E.long_form(E.embed_batch(V.articles(spark, d), "content"), "article_id", "embedding")


@query(
    "embed_batch",
    """
SELECT a.article_id, cast(384 AS int) AS dim, count(v.dim) AS nonzero, coalesce(round(sum(v * v), 6), 0.0) AS norm
FROM articles a LEFT JOIN content_vectors v ON v.article_id = a.article_id GROUP BY a.article_id
""",
)
def embed_batch(spark, d) -> DataFrame:
    e = E.embed_batch(V.articles(spark, d).select("article_id", "content"), "content")
    v = F.col("embedding")
    return e.select(
        "article_id",
        F.size(v).alias("dim"),
        F.size(F.filter(v, lambda x: x != 0)).cast("bigint").alias("nonzero"),
        F.round(L.dot(v, v), 6).alias("norm"),
    )


@query(
    "l2_normalize",
    """
SELECT article_id, cast(dim AS int) AS dim, round(x / n, 6) AS v FROM (
  SELECT article_id, unnest(embedding) * 3 AS x, unnest(range(64)) AS dim,
    sqrt(list_sum(list_transform(embedding, lambda e: e * 3 * e * 3))) AS n FROM vectors)
WHERE round(x / n, 6) <> 0
""",
)
def l2_normalize(spark, d) -> DataFrame:
    tripled = F.transform(L.as_double(F.col("embedding")), lambda x: x * 3)
    unit = V.vectors(spark, d).select("article_id", L.l2_normalize(tripled).alias("v"))
    return E.long_form(unit, "article_id", "v").where("v <> 0")


@query(
    "pair_similarity",
    """
SELECT a.article_id, b.article_id AS other_id,
  round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1] * p[2])), 6) AS similarity
FROM vectors a JOIN vectors b ON b.article_id = a.article_id + 1
""",
)
def pair_similarity(spark, d) -> DataFrame:
    """Each article with the next one."""
    v = V.vectors(spark, d)
    nxt = v.select(
        (F.col("article_id") - 1).alias("article_id"),
        F.col("article_id").alias("other_id"),
        F.col("embedding").alias("other"),
    )
    return E.pair_similarity(v.join(nxt, "article_id"), "embedding", "other").select(
        "article_id", "other_id", "similarity"
    )


@query(
    "similarity_ranking",
    """
SELECT b.article_id,
  round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1] * p[2])), 6) AS similarity
FROM (SELECT * FROM vectors ORDER BY article_id DESC LIMIT 1) a, vectors b
""",
)
def similarity_ranking(spark, d) -> DataFrame:
    """All articles against the newest one."""
    v = V.vectors(spark, d)
    return E.similarity_ranking(v.orderBy(F.col("article_id").desc()), v)


@query(
    "title_weighted_embedding",
    """
SELECT article_id, cast(dim AS int) AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY article_id)), 6) AS v FROM (
  SELECT coalesce(t.article_id, c.article_id) AS article_id, coalesce(t.dim, c.dim) AS dim,
    0.3::double * coalesce(t.v, 0) + 0.7::double * coalesce(c.v, 0) AS v
  FROM title_vectors t FULL JOIN content_vectors c ON t.article_id = c.article_id AND t.dim = c.dim)
QUALIFY round(v / sqrt(sum(v * v) OVER (PARTITION BY article_id)), 6) <> 0
""",
)
def title_weighted_embedding(spark, d) -> DataFrame:
    a = V.articles(spark, d).select(
        "article_id", E.embed_text(F.col("title")).alias("t"), E.embed_text(F.col("content")).alias("c")
    )
    mixed = a.select("article_id", E.title_weighted_embedding(F.col("t"), F.col("c")).alias("v"))
    return E.long_form(mixed, "article_id", "v").where("v <> 0")


@query(
    "embedding_quality",
    """
SELECT count(*) AS vectors, count(*) FILTER (n = 0) AS zero, count(*) FILTER (n > 0 AND abs(n - 1) > 0.001) AS off_unit,
  min(n) AS min_norm, max(n) AS max_norm
FROM (SELECT round(sqrt(list_sum(list_transform(embedding, lambda e: e * e))), 6) AS n FROM vectors)
""",
)
def embedding_quality(spark, d) -> DataFrame:
    return E.embedding_quality(V.vectors(spark, d))
