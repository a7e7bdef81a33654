"""Named queries: vector index (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.operators import ivf as I, vectors as G
from newsloom.plans.registry import CTES, query
from newsloom.session import scratch_dir
from newsloom.sources import tables as S, views as V

L2 = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

CTES["all_pairs"] = f"""
SELECT q.article_id AS query_id, v.article_id, round({L2}, 6) AS dist FROM vectors q, vectors v
"""


def _nearest(k: int, where: str = "true", source: str = "all_pairs") -> str:
    return f"""
SELECT * FROM (SELECT query_id, article_id, dist,
  cast(row_number() OVER (PARTITION BY query_id ORDER BY dist, article_id) AS int) AS rank
  FROM {source} WHERE {where}) WHERE rank <= {k}
"""


# The batch that index_upsert adds: two rows per article id, in order of vec_id.
BATCH_SQL = "SELECT vec_id AS seq, cast(floor(vec_id / 2) AS bigint) AS article_id, embedding FROM embeddings"


def _upsert_batch(spark, d) -> DataFrame:
    return S.read_table(spark, d, "embeddings").select(
        F.col("vec_id").alias("seq"), F.floor(F.col("vec_id") / 2).cast("bigint").alias("article_id"), "embedding"
    )


@query(
    "index_upsert",
    f"""
WITH batch AS ({BATCH_SQL}),
  placed AS (SELECT article_id, row_number() OVER (ORDER BY seq) - 1 + (SELECT max(position) + 1 FROM vectors)
    AS position, embedding FROM batch),
  newest AS (SELECT article_id, max(position) AS position, arg_max(embedding, position) AS embedding
    FROM placed GROUP BY article_id)
SELECT article_id, position, round(embedding[1]::double, 6) AS first_value FROM newest
UNION ALL SELECT article_id, position, round(embedding[1], 6) FROM vectors
WHERE article_id NOT IN (SELECT article_id FROM newest)
""",
)
def index_upsert(spark, d) -> DataFrame:
    index, _ = G.index_upsert(V.vectors(spark, d), _upsert_batch(spark, d))
    return index.select(
        "article_id", "position", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value")
    )


@query("knn_search", _nearest(10))
def knn_search(spark, d) -> DataFrame:
    """Every stored vector as a query, itself included."""
    v = V.vectors(spark, d)
    return G.knn_search(G.as_queries(v, "article_id"), v, 10)


@query("similar_articles", _nearest(10, "query_id <> article_id"))
def similar_articles(spark, d) -> DataFrame:
    return G.similar_articles(V.vectors(spark, d), 10)


@query("knn_search_grid", _nearest(10))
def knn_search_grid(spark, d) -> DataFrame:
    """The same by blocks of queries and vectors, as for query sets too large to be sent to every task."""
    v = V.vectors(spark, d)
    return G.knn_search(G.as_queries(v, "article_id"), v, 10, broadcast_bytes=0)


@query("similar_to", _nearest(10, "query_id = 7 AND article_id <> 7"))
def similar_to(spark, d) -> DataFrame:
    """Nearest articles of one article."""
    return G.similar_to(V.vectors(spark, d), 7, 10)


CTES["live_pairs"] = """
SELECT * FROM all_pairs WHERE query_id <> article_id
  AND query_id NOT IN (SELECT article_id FROM articles WHERE processing_status <> 'completed')
  AND article_id NOT IN (SELECT article_id FROM articles WHERE processing_status <> 'completed')
"""


@query("index_remove", _nearest(5, source="live_pairs"))
def index_remove(spark, d) -> DataFrame:
    """Search after the vectors of articles that are not completed were removed."""
    gone = V.articles(spark, d).where("processing_status <> 'completed'")
    return G.similar_articles(G.index_remove(V.vectors(spark, d), gone), 5)


@query(
    "index_roundtrip",
    "SELECT article_id, position, len(embedding)::int AS dim, round(list_sum(embedding), 6) AS total FROM vectors",
)
def index_roundtrip(spark, d) -> DataFrame:
    root = scratch_dir(spark, "index")
    G.save_index(V.vectors(spark, d), root)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return G.load_index(spark, root).select(
        "article_id", "position", F.size("embedding").alias("dim"), F.round(total, 6).alias("total")
    )


@query(
    "index_stats",
    """
SELECT count(*) AS total_vectors, count(DISTINCT article_id) AS id_map_size, max(len(embedding))::int AS dimension,
  max(position) + 1 AS next_position, 'flat' AS index_type FROM vectors
""",
)
def index_stats(spark, d) -> DataFrame:
    return G.index_stats(V.vectors(spark, d))


@query(
    "index_clear",
    """
SELECT 'before' AS state, count(*) AS total_vectors, max(len(embedding))::int AS dimension FROM vectors
UNION ALL SELECT 'after', 0::bigint, 0::int
""",
)
def index_clear(spark, d) -> DataFrame:
    v = V.vectors(spark, d)
    stats = lambda name, df: G.index_stats(df).select(F.lit(name).alias("state"), "total_vectors", "dimension")
    return stats("before", v).unionByName(stats("after", G.index_clear(v)))


CELLS = 12
#: Share of the true neighbours that approximate search has to find, and that it is tuned for on held-out queries.
RECALL = 0.9
TUNED_RECALL = 0.95
HELD_OUT = 500


def stored_ivf(spark, d) -> I.StoredIvf:
    path = S.stored_once(spark, d, V.ARTICLE_TABLES, "ivf", lambda p: I.build_ivf(V.vectors(spark, d), p, CELLS))
    return I.read_ivf(spark, path)


@query("knn_ivf")
def knn_ivf(spark, d) -> DataFrame:
    """All vectors as queries, in as many cells as a sample of bounded size needs."""
    index, v = stored_ivf(spark, d), V.vectors(spark, d)
    held_out = G.as_queries(v.orderBy(F.xxhash64("article_id")).limit(HELD_OUT), "article_id")
    return I.search_ivf(index, G.as_queries(v, "article_id"), 10, I.choose_nprobe(index, held_out, 10, TUNED_RECALL))


@query("knn_ivf_exact", _nearest(10))
def knn_ivf_exact(spark, d) -> DataFrame:
    """The exact neighbours from the stored cells that can hold them."""
    return I.search_ivf_exact(stored_ivf(spark, d), G.as_queries(V.vectors(spark, d), "article_id"), 10)


@query(
    "ann_recall",
    f"""
SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, {RECALL}::double AS bound, true AS reached
FROM ({_nearest(10)})
""",
)
def ann_recall(spark, d) -> DataFrame:
    """Whether approximate search finds enough of the true neighbours of all vectors."""
    exact = S.materialize(knn_search(spark, d), "exact")
    sizes = exact.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"))
    return sizes.select(
        "queries", "neighbours", F.lit(RECALL).alias("bound"), I.recall_reached(knn_ivf(spark, d), exact, RECALL).alias("reached")
    )


CTES["completed_pairs"] = """
SELECT * FROM all_pairs WHERE query_id NOT IN (SELECT article_id FROM articles WHERE processing_status <> 'completed')
  AND article_id NOT IN (SELECT article_id FROM articles WHERE processing_status <> 'completed')
"""


@query("ivf_update", _nearest(5, source="completed_pairs"))
def ivf_update(spark, d) -> DataFrame:
    """Exact search after articles that are not completed were taken out and half of the others written again."""
    path, v, a = scratch_dir(spark, "ivf"), V.vectors(spark, d), V.articles(spark, d)
    I.build_ivf(v, path, CELLS)
    index = I.read_ivf(spark, path)
    gone = a.where("processing_status <> 'completed'").select("article_id")
    I.update_ivf(index, v.where(F.pmod(F.xxhash64("article_id"), F.lit(2)) == 0), gone)
    live = v.join(gone, "article_id", "left_anti")
    return I.search_ivf_exact(index, G.as_queries(live, "article_id"), 5)
