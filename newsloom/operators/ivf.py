"""A stored inverted-file index: vectors in folders by cell, probed without reading other cells, updated cell by cell.

Beside the vectors lie the centroids. A search reads the folders of the cells that its queries probe (dynamic partition pruning). The
exact form probes, after the nearest cells, every cell that can still hold a nearer vector: no member of a cell is nearer than
the query's distance to the centroid less the cell's radius.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.functions.topk import ranked, to_matrix, top_k
from newsloom.operators.vectors import Cells, knn_search, train_cells
from newsloom.sources.tables import materialize

STORED = "article_id bigint, position bigint, embedding array<float>, far double, cell int"
#: Distances are compared with this much room, since sort keys are rounded.
ROOM = 2e-6


@dataclass(frozen=True)
class StoredIvf:
    spark: SparkSession
    path: str
    cells: Cells

    def rows(self) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(f"{self.path}/cells")

    def radii(self) -> np.ndarray:
        """Largest distance of a member to the centroid of each cell; minus infinity for an empty one."""
        found = np.full(len(self.cells.centroids), -np.inf)
        for r in self.rows().groupBy("cell").agg(F.max("far").alias("r")).collect():  # one row per cell
            found[r.cell] = r.r
        return found


def _distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    squared = (vectors * vectors).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2.0 * vectors @ centroids.T
    return np.sqrt(np.maximum(squared, 0.0))


def _assigned(index: DataFrame, cells: Cells) -> DataFrame:
    """Rows of STORED: each vector with its nearest cell and the distance to its centroid."""
    shared = index.sparkSession.sparkContext.broadcast(cells.centroids)

    @F.arrow_udf("struct<cell: int, far: double>")
    def nearest(v: pa.Array) -> pa.Array:
        d = _distances(to_matrix(v), shared.value)
        best = d.argmin(1) if len(d) else np.zeros(0, int)
        return pa.StructArray.from_arrays(
            [pa.array(best.astype(np.int32)), pa.array(d[np.arange(len(d)), best] if len(d) else np.zeros(0))], ["cell", "far"]
        )

    placed = index.where(F.col("embedding").isNotNull()).select("article_id", "position", F.col("embedding").cast("array<float>").alias("embedding"))
    return placed.withColumn("_c", nearest.asNondeterministic()(F.col("embedding"))).select(
        "article_id", "position", "embedding", "_c.far", "_c.cell"
    )


def build_ivf(index: DataFrame, path: str, nlist: int, seed: int = 42) -> None:
    """Train `nlist` cells on `index` (article_id, position, embedding) and store the vectors by cell under `path`.

    Rows are rebalanced by cell: a crowded one is split over several tasks and files. Vectors that are null are left out.
    """
    spark = index.sparkSession
    cells = train_cells(index.where(F.col("embedding").isNotNull()), nlist, seed)
    centroids = spark.createDataFrame(
        [(i, c.tolist()) for i, c in enumerate(cells.centroids)], "cell int, centroid array<double>"
    )
    centroids.coalesce(1).write.parquet(f"{path}/centroids")
    _assigned(index, cells).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/cells")


def read_ivf(spark: SparkSession, path: str) -> StoredIvf:
    rows = spark.read.schema("cell int, centroid array<double>").parquet(f"{path}/centroids").orderBy("cell").collect()
    return StoredIvf(spark, path, Cells(np.array([r.centroid for r in rows])))


def _probe(index: StoredIvf, queries: DataFrame, k: int) -> DataFrame:
    """The k best of the cells that `queries` (query_id, vector, cell) probe."""
    queries = materialize(queries.select("query_id", "vector", "cell"), "probes")
    # At most one number per cell; other folders are not even listed.
    probed = [r.cell for r in queries.select("cell").distinct().collect()]
    vectors = index.rows().where(F.col("cell").isin(probed)).select("article_id", F.col("embedding").alias("vector"), "cell")
    return top_k(queries, vectors, k, "l2").withColumnRenamed("score", "dist")


def search_ivf(index: StoredIvf, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """(query_id, article_id, dist, rank): nearest vectors in the `nprobe` nearest cells of each query."""
    cells = index.cells.nearest(index.spark, F.col("vector"), nprobe)
    return _probe(index, queries.where(F.col("vector").isNotNull()).withColumn("cell", F.explode(cells)), k)


def search_ivf_exact(index: StoredIvf, queries: DataFrame, k: int, nprobe: int = 1) -> DataFrame:
    """As an exact search, from the cells that can matter."""
    queries = queries.where(F.col("vector").isNotNull())
    first = materialize(search_ivf(index, queries, k, nprobe).select("query_id", "article_id", "dist"), "probed")
    reached = first.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("dist") + F.lit(ROOM)) + F.lit(ROOM)).alias("reach")
    )
    shared = index.spark.sparkContext.broadcast((index.cells.centroids, index.radii(), min(nprobe, len(index.cells.centroids))))

    @F.arrow_udf("array<int>")
    def others(v: pa.Array, reach: pa.Array) -> pa.Array:
        centroids, radii, done = shared.value
        d = _distances(to_matrix(v), centroids) if len(v) else np.zeros((0, len(centroids)))
        limit = np.array([np.inf if r is None else r for r in reach.to_pylist()])[:, None]
        near = (d - radii <= limit) & np.isfinite(radii)
        if len(v):  # the cells that were probed already
            np.put_along_axis(near, np.argsort(d, axis=1, kind="stable")[:, :done], False, axis=1)
        row, cell = np.nonzero(near)
        ends = np.searchsorted(row, np.arange(len(v) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int32)))

    left = queries.join(reached, "query_id", "left").withColumn("cell", F.explode(others(F.col("vector"), F.col("reach"))))
    more = _probe(index, left.select("query_id", "vector", "cell"), k).select("query_id", "article_id", "dist")
    return ranked(first.unionByName(more), k, [F.col("dist").asc(), F.col("article_id").asc()])


def choose_nprobe(index: StoredIvf, held_out: DataFrame, k: int, recall: float) -> int:
    """The fewest cells that reach `recall` for the queries `held_out`, a sample of bounded size.

    True neighbours are found by an exact search; a neighbour is found if its cell is among those probed.
    """
    everything = len(index.cells.centroids)
    vectors = index.rows()
    exact = knn_search(held_out, vectors, k).join(vectors.select("article_id", "cell"), "article_id")
    order = held_out.select("query_id", F.posexplode(index.cells.nearest(index.spark, F.col("vector"), everything)).alias("place", "cell"))
    found = exact.join(order, ["query_id", "cell"]).groupBy("place").count().orderBy("place").collect()  # one row per cell at most
    total, seen = sum(r["count"] for r in found), 0
    for r in found:
        seen += r["count"]
        if seen >= recall * total:
            return r["place"] + 1
    return everything


def update_ivf(index: StoredIvf, changed: DataFrame, removed: DataFrame) -> None:
    """Replace or add the vectors of `changed` (article_id, position, embedding; one row per id) and take out the ids of `removed`.

    Only cells that hold one of the ids, or get one, are read as a whole and written anew; running it again leaves the same.
    """
    new = materialize(_assigned(changed, index.cells), "changed")
    gone = materialize(removed.select("article_id").unionByName(new.select("article_id")).distinct(), "gone")
    held = index.rows().select("article_id", "cell").join(gone, "article_id", "left_semi").select("cell")
    touched = materialize(held.unionByName(new.join(removed, "article_id", "left_anti").select("cell")).distinct(), "touched")
    kept = index.rows().join(F.broadcast(touched), "cell").join(gone, "article_id", "left_anti")
    columns = kept.columns
    rows = materialize(
        kept.unionByName(new.join(removed.select("article_id"), "article_id", "left_anti").select(*columns)), "cells"
    )
    rows.hint("rebalance", "cell").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("cell").parquet(
        f"{index.path}/cells"
    )
    # Cells that lost their last vector are not overwritten, since nothing is written to them.
    for r in touched.join(rows.select("cell").distinct(), "cell", "left_anti").collect():
        folder = index.spark._jvm.org.apache.hadoop.fs.Path(f"{index.path}/cells/cell={r.cell}")
        folder.getFileSystem(index.spark._jsc.hadoopConfiguration()).delete(folder, True)


def recall_reached(found: DataFrame, exact: DataFrame, bound: float) -> Column:
    """Whether the share of true neighbours that were found reaches a bound, as a scalar."""
    hit = found.select("query_id", "article_id", F.lit(1).alias("hit"))
    share = exact.join(hit, ["query_id", "article_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    return share.scalar() >= bound
