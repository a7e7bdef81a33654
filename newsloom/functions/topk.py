"""Exact top-k scoring of query vectors against stored vectors, in blocks.

A score is computed for every (query, vector) pair that must be compared, but pairs never become
rows: each block is one matrix product inside a task, and only its k best rows per query leave it.

Two layouts, chosen by a check of the query side:
- few queries (at most BROADCAST_BYTES of numbers): they go to every task, the stored vectors are
  only scanned, and each task emits k rows per query;
- otherwise a grid: queries and vectors are hashed into blocks of bounded size, every block pair is
  one task-sized group, and the k best per block pair are merged with a window.

`cell` limits the comparison to equal cells (inverted-file search). A cell of any size is split into
as many blocks as its row count asks for, so one crowded cell cannot end in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BROADCAST_BYTES = 64 << 20
QUERY_BLOCK = 4096
VECTOR_BLOCK = 65536
PAIRS_AT_ONCE = 1 << 22
PLACES = 6

RESULT = "query_id bigint, article_id bigint, score double"


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column of equal lengths to a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def to_ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy())


def first_k(groups: np.ndarray, keys: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k rows with the lowest (key, id) in each group."""
    order = np.lexsort((ids, keys, groups))
    g = groups[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[place < k]


def best_per_row(keys: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k lowest finite keys per row, ties by the column's id."""
    if not keys.size:
        return np.zeros(0, int), np.zeros(0, int)
    kk = min(k, keys.shape[1])
    worst = np.partition(keys, kk - 1, axis=1)[:, kk - 1 : kk]
    rows, cols = np.nonzero((keys <= worst) & np.isfinite(keys))
    keep = first_k(rows, keys[rows, cols], ids[cols], k)
    return rows[keep], cols[keep]


def sort_keys(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Rounded sort key per pair, lower is better: squared distance, or minus dot / cosine."""
    if metric == "cosine":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    products = q @ v.T
    if metric == "l2":
        squared = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2.0 * products
        return np.round(np.maximum(squared, 0.0), PLACES)
    return -np.round(products, PLACES)


def block_best(
    qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, metric: str, exclude_self: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, vector ids, keys) of the k best vectors per query in one block."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, PAIRS_AT_ONCE // max(1, len(vid)))
    for at in range(0, len(qid) if len(vid) else 0, step):
        ids = qid[at : at + step]
        keys = sort_keys(q[at : at + step], v, metric)
        if exclude_self:
            keys[ids[:, None] == vid[None, :]] = np.inf
        rows, cols = best_per_row(keys, vid, k)
        out.append((ids[rows], vid[cols], keys[rows, cols]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(parts) for parts in zip(*out))  # type: ignore[return-value]


def _scores(keys: np.ndarray, metric: str) -> np.ndarray:
    return keys if metric == "l2" else np.where(keys == 0, 0.0, -keys)


def _record(qid, vid, keys, metric) -> dict:
    return {"query_id": qid, "article_id": vid, "score": _scores(keys, metric)}


def ranked(scored: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Keep the k best per query with their rank."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scan(queries: DataFrame, vectors: DataFrame, k: int, metric: str, exclude_self: bool) -> DataFrame:
    small = queries.select("query_id", "vector").toArrow()
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((to_ids(small["query_id"]), to_matrix(small["vector"])))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        room = max(4 * k * len(qid), 1 << 16)
        for batch in batches:
            if not batch.num_rows or not len(qid):
                continue
            vid, v = to_ids(batch["article_id"]), to_matrix(batch["vector"])
            new = block_best(qid, q, vid, v, k, metric, exclude_self)
            held = [np.concatenate(pair) for pair in zip(held, new)]
            if len(held[0]) > room:
                keep = first_k(held[0], held[2], held[1], k)
                held = [h[keep] for h in held]
        keep = first_k(held[0], held[2], held[1], k)
        yield pa.RecordBatch.from_pydict(_record(*[h[keep] for h in held], metric))

    return vectors.select("article_id", "vector").mapInArrow(task, RESULT)


def _grid(queries: DataFrame, vectors: DataFrame, k: int, metric: str, exclude_self: bool) -> DataFrame:
    """Blocks of queries meet blocks of vectors, within a cell if the rows have one."""
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    part = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    if "cell" in queries.columns:
        key = ["cell", "qb", "vb"]

        def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
            return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

        sizes = blocks(queries, QUERY_BLOCK, "q_blocks").join(blocks(vectors, VECTOR_BLOCK, "v_blocks"), "cell")
        queries, vectors = queries.join(sizes, "cell"), vectors.join(sizes, "cell")
        q_blocks, v_blocks = F.col("q_blocks"), F.col("v_blocks")
    else:
        key = ["qb", "vb"]
        q_blocks, v_blocks = F.lit(-(-queries.count() // QUERY_BLOCK) or 1), F.lit(-(-vectors.count() // VECTOR_BLOCK) or 1)
    q = queries.withColumn("qb", part("query_id", q_blocks)).withColumn("vb", every(v_blocks)).select(
        *key, "query_id", "vector"
    )
    v = vectors.withColumn("vb", part("article_id", v_blocks)).withColumn("qb", every(q_blocks)).select(
        *key, "article_id", "vector"
    )

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table(_record(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), metric))
        best = block_best(
            to_ids(left["query_id"]), to_matrix(left["vector"]), to_ids(right["article_id"]),
            to_matrix(right["vector"]), k, metric, exclude_self,
        )
        return pa.table(_record(*best, metric))

    return q.groupBy(*key).cogroup(v.groupBy(*key)).applyInArrow(task, RESULT)


def top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    metric: str = "l2",
    exclude_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(query_id, article_id, score, rank): the k best stored vectors of each query, ties by id.

    queries: (query_id, vector); vectors: (article_id, vector). With a `cell` column on both sides
    only rows of one cell are compared; a query may then appear once per cell it probes.
    """
    queries = queries.where(F.col("vector").isNotNull())
    vectors = vectors.where(F.col("vector").isNotNull())
    if "cell" in queries.columns:
        scored = _grid(queries, vectors, k, metric, exclude_self)
    else:
        size = queries.agg((F.count(F.lit(1)) * F.coalesce(F.max(F.size("vector")), F.lit(0)) * 8).alias("b")).first()
        if size["b"] <= broadcast_bytes:
            scored = _scan(queries, vectors, k, metric, exclude_self)
        else:
            scored = _grid(queries, vectors, k, metric, exclude_self)
    best = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    return ranked(scored, k, [best, F.col("article_id").asc()])
