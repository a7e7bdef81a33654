"""BM25 scoring of many short queries against whole texts, in blocks.

Words are split and hashed in the JVM. A task turns a chunk of documents into a (document, query
word) matrix of saturated counts and multiplies it with the (query word, query) matrix of weights;
only the k best documents per query leave it. Neither a posting list of a common word nor the
(query, document) pairs it touches ever become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions import text as X
from newsloom.functions.topk import RESULT, best_per_row, first_k, ranked, to_ids

K1 = 1.2
B = 0.75
CELLS_AT_ONCE = 1 << 22
# Query words that may be shared with every task; more go through the grid.
SHARED_WORDS = 1 << 18
QUERY_BLOCK = 256
DOC_BLOCK = 16384


class Queries:
    """Query words of one block: hashes, weights and the word-by-query matrix."""

    def __init__(self, qid: np.ndarray, word: np.ndarray, idf: np.ndarray, avgdl: float):
        self.ids, column = np.unique(qid, return_inverse=True)
        self.words, row = np.unique(word, return_inverse=True)
        self.matrix = np.zeros((len(self.words), len(self.ids)))
        self.matrix[row, column] = idf
        self.avgdl = avgdl


def best_documents(q: Queries, ids: np.ndarray, flat: np.ndarray, sizes: np.ndarray, k: int):
    """(query ids, document ids, keys) of the k best documents per query in a chunk of documents."""
    ends = np.cumsum(sizes)
    step = max(1, CELLS_AT_ONCE // max(1, len(q.words) + len(q.ids)))
    out = []
    for at in range(0, len(ids) if len(q.words) else 0, step):
        n = min(step, len(ids) - at)
        part = flat[(ends[at] - sizes[at]) : ends[at + n - 1]]
        rows = np.repeat(np.arange(n), sizes[at : at + n])
        cols = np.minimum(np.searchsorted(q.words, part), len(q.words) - 1)
        known = q.words[cols] == part
        tf = np.bincount(rows[known] * len(q.words) + cols[known], minlength=n * len(q.words)).reshape(n, -1)
        norm = K1 * (1.0 - B + B * sizes[at : at + n] / q.avgdl)
        scores = np.round((tf * (K1 + 1.0) / (tf + norm[:, None])) @ q.matrix, 6)
        keys = np.where(scores > 0, -scores, np.inf).T
        found = ids[at : at + n]
        query, doc = best_per_row(keys, found, k)
        out.append((q.ids[query], found[doc], keys[query, doc]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(p) for p in zip(*out))


def _documents(ids: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if isinstance(words, pa.ChunkedArray):
        words = pa.concat_arrays(words.chunks) if words.num_chunks else pa.array([], words.type)
    sizes = np.asarray(words.value_lengths().fill_null(0)).astype(np.int64)
    return to_ids(ids), words.flatten().to_numpy(zero_copy_only=False), sizes


def _queries(t: pa.Table) -> Queries:
    avgdl = float(t["avgdl"][0].as_py()) if t.num_rows else 1.0
    return Queries(to_ids(t["query_id"]), to_ids(t["word"]), to_ids(t["idf"]).astype(float), avgdl)


def _result(qid, did, keys) -> dict:
    return {"query_id": qid, "article_id": did, "score": np.abs(keys)}


def word_hashes(text: Column) -> Column:
    return F.transform(X.tokens(text), lambda t: F.xxhash64(t))


def weighted_query_words(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, word, idf, avgdl) with words as hashes; one pass over the documents.

    The empty word stands for the document itself and carries its length, so that document count,
    total length and document frequencies come out of one aggregate over the query words.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(word_hashes(F.col("text")))).alias("word"))
    vocabulary = asked.select("word").distinct()
    words = word_hashes(F.col("text"))
    document = F.xxhash64(F.lit(""))
    marked = docs.select(
        F.size(words).alias("_len"), F.explode(F.array_append(F.array_distinct(words), document)).alias("word")
    )
    none = docs.sparkSession.range(1).select(document.alias("word"))
    stats = (
        marked.join(vocabulary.unionByName(none), "word", "left_semi")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("_len").alias("len"))
    )
    whole = stats.where(F.col("word") == document).agg(
        F.struct(F.first("df").alias("n"), (F.first("len") / F.first("df")).alias("avgdl"))
    ).scalar()
    df = F.col("df")
    return (
        asked.join(stats, "word")
        .withColumn("_w", whole)
        .select(
            "query_id",
            "word",
            F.log(1 + (F.col("_w.n") - df + 0.5) / (df + 0.5)).alias("idf"),
            F.col("_w.avgdl").alias("avgdl"),
        )
    )


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, shared_words: int = SHARED_WORDS) -> DataFrame:
    """(query_id, article_id, score, rank): documents with at least one query word, best first.

    docs: (article_id, text); queries: (query_id, text).
    """
    weighted = weighted_query_words(docs, queries)
    hashed = docs.select("article_id", word_hashes(F.col("text")).alias("words"))
    asked = queries.select(F.sum(F.size(F.array_distinct(X.tokens(F.col("text"))))).alias("n"), F.count(F.lit(1)).alias("q"))
    size = asked.first()
    if (size["n"] or 0) <= shared_words and (size["n"] or 0) * size["q"] <= 8 * shared_words * 4:
        scored = _scan(weighted, hashed, k)
    else:
        scored = _grid(weighted, hashed, k, -(-size["q"] // QUERY_BLOCK))
    return ranked(scored, k, [F.col("score").desc(), F.col("article_id").asc()])


def _scan(weighted: DataFrame, hashed: DataFrame, k: int) -> DataFrame:
    shared = hashed.sparkSession.sparkContext.broadcast(weighted.toArrow())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = _queries(shared.value)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            new = best_documents(q, *_documents(batch["article_id"], batch["words"]), k)
            held = [np.concatenate(pair) for pair in zip(held, new)]
            keep = first_k(held[0], held[2], held[1], k)
            held = [h[keep] for h in held]
        yield pa.RecordBatch.from_pydict(_result(*held))

    return hashed.mapInArrow(task, RESULT)


def _grid(weighted: DataFrame, hashed: DataFrame, k: int, query_blocks: int) -> DataFrame:
    doc_blocks = hashed.agg(F.greatest(F.ceil(F.count(F.lit(1)) / DOC_BLOCK), F.lit(1)).cast("int")).scalar()
    block = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    q = (
        weighted.withColumn("_n", doc_blocks)
        .withColumn("qb", block("query_id", F.lit(query_blocks)))
        .withColumn("db", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .drop("_n")
    )
    d = (
        hashed.withColumn("_n", doc_blocks)
        .withColumn("db", block("article_id", F.col("_n")))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        .drop("_n")
    )

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table(_result(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
        return pa.table(_result(*best_documents(_queries(left), *_documents(right["article_id"], right["words"]), k)))

    return q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInArrow(task, RESULT)
