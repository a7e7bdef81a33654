"""The vector index: upsert, search, remove, statistics, snapshots, inverted-file search.

An index is a DataFrame (article_id, position, embedding) with one live row per article.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.functions.scale import dense_positions
from newsloom.functions.topk import sort_keys, to_matrix, top_k
from newsloom.schemas import VECTOR
from newsloom.sources import tables as S


def next_position(index: DataFrame, column: str = "position") -> Column:
    """First free position, as a scalar subquery."""
    return index.agg(F.coalesce(F.max(column) + 1, F.lit(0)).cast("bigint").alias("p")).scalar()


def index_upsert(index: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new index, rejected rows). batch: (seq, article_id, embedding) in arrival order.

    Every valid row takes the next position; the newest position of an article is the live one.
    Rows without id or vector are rejected.
    """
    ok = F.col("article_id").isNotNull() & F.col("embedding").isNotNull()
    placed = dense_positions(batch.where(ok), "seq", "offset").select(
        "article_id", (F.col("offset") + next_position(index)).alias("position"), "embedding"
    )
    newest = placed.groupBy("article_id").agg(
        F.max("position").alias("position"), F.max_by("embedding", "position").alias("embedding")
    )
    kept = index.select("article_id", "position", "embedding").join(newest, "article_id", "left_anti")
    return kept.unionByName(newest), batch.where(~ok)


def as_queries(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    return df.select(F.col(key).alias("query_id"), F.col(vector).alias("vector"))


def as_vectors(index: DataFrame) -> DataFrame:
    return index.select("article_id", F.col("embedding").alias("vector"))


def knn_search(queries: DataFrame, index: DataFrame, k: int = 10, **options) -> DataFrame:
    """Nearest live vectors by squared distance; fewer than k when the index is smaller."""
    found = top_k(queries, as_vectors(index), k, "l2", **options)
    return found.withColumnRenamed("score", "dist")


def similar_articles(index: DataFrame, k: int = 10, exclude_self: bool = True, **options) -> DataFrame:
    """Nearest other articles for every article of the index."""
    return knn_search(as_queries(index, "article_id"), index, k, exclude_self=exclude_self, **options)


def similar_to(index: DataFrame, article_id: int, k: int = 10, exclude_self: bool = True) -> DataFrame:
    """Nearest other articles of one article; an unknown id is an error."""
    query = index.where(F.col("article_id") == article_id)
    if query.isEmpty():
        raise KeyError(f"article {article_id} is not in the index")
    return knn_search(as_queries(query, "article_id"), index, k, exclude_self=exclude_self)


def index_remove(index: DataFrame, removed: DataFrame) -> DataFrame:
    """Take articles out before any search sees them."""
    return index.join(removed.select("article_id"), "article_id", "left_anti")


def index_clear(index: DataFrame) -> DataFrame:
    return index.where(F.lit(False))


def index_stats(index: DataFrame, kind: str = "flat") -> DataFrame:
    return index.agg(
        F.count(F.lit(1)).alias("total_vectors"),
        F.countDistinct("article_id").alias("id_map_size"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"),
        F.coalesce(F.max("position") + 1, F.lit(0)).alias("next_position"),
    ).withColumn("index_type", F.lit(kind))


def save_index(index: DataFrame, root: str) -> int:
    return S.write_snapshot(index.select(*VECTOR.fieldNames()), root)


def load_index(spark: SparkSession, root: str) -> DataFrame:
    return S.read_snapshot(spark, root, VECTOR)


@dataclass
class Cells:
    """Coarse cells of an inverted file: a bounded table of centroids."""

    centroids: np.ndarray

    def nearest(self, spark: SparkSession, vector: Column, n: int) -> Column:
        """The n nearest cells of a vector, nearest first."""
        if self.centroids.nbytes > CENTROID_BYTES:
            raise ValueError(f"{self.centroids.nbytes} bytes of centroids are too many to be sent to every executor")
        shared = spark.sparkContext.broadcast(self.centroids)
        n = min(n, len(self.centroids))

        @F.arrow_udf("array<int>")
        def cells(v: pa.Array) -> pa.Array:
            order = np.argsort(sort_keys(to_matrix(v), shared.value, "l2"), axis=1, kind="stable")[:, :n]
            return pa.ListArray.from_arrays(
                np.arange(0, order.size + 1, n, dtype=np.int32), order.astype(np.int32).ravel()
            )

        return cells(vector)


MAX_CELLS = 65536
#: Centroids are sent to every executor.
CENTROID_BYTES = 256 << 20


def train_cells(index: DataFrame, nlist: int = 100, seed: int = 42) -> Cells:
    """k-means cells. Fewer vectors than cells are an error: the caller chooses the number, whatever the size."""
    if not 1 <= nlist <= MAX_CELLS:
        raise ValueError(f"nlist must be between 1 and {MAX_CELLS}")
    n = index.count()
    if n < nlist:
        raise ValueError(f"{n} vectors are too few for {nlist} cells")
    points = index.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if nlist == 1:
        from pyspark.ml.stat import Summarizer

        return Cells(np.array([points.select(Summarizer.mean(F.col("features"))).first()[0].toArray()]))
    model = KMeans(k=nlist, seed=seed, maxIter=10).fit(points)
    return Cells(np.array(model.clusterCenters()))


def knn_ivf(queries: DataFrame, index: DataFrame, cells: Cells, k: int = 10, nprobe: int = 8) -> DataFrame:
    """Approximate search: each query is compared only with the vectors of its nearest cells."""
    spark = index.sparkSession
    v = as_vectors(index).withColumn("cell", F.get(cells.nearest(spark, F.col("vector"), 1), F.lit(0)))
    q = queries.withColumn("cell", F.explode(cells.nearest(spark, F.col("vector"), nprobe)))
    return top_k(q, v, k, "l2").withColumnRenamed("score", "dist")


def ann_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the true neighbours that were found, over all queries."""
    hit = found.select("query_id", "article_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "article_id"], "left").agg(
        F.countDistinct("query_id").alias("queries"),
        F.count(F.lit(1)).alias("neighbours"),
        F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"),
    )
