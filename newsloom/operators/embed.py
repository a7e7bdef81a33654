"""Text to unit vectors, and similarity of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions import text as X, vectors as L

DIM = 384
MAX_EMBED_CHARS = 2000
#: Words and rows of an Arrow batch that are added up at once; only memory depends on them.
CODES = 1 << 18
ROWS = 1 << 10


def embedding_text(title: Column, content: Column) -> Column:
    """Title and content; when too long, the content is cut and marked, or left out."""
    whole = F.concat(title, F.lit("\n\n"), content)
    room = F.lit(MAX_EMBED_CHARS) - F.length(title) - 10
    cut = F.concat(title, F.lit("\n\n"), F.substring(content, F.lit(1), room), F.lit("..."))
    return F.when(F.length(whole) <= MAX_EMBED_CHARS, whole).when(room > 0, cut).otherwise(title)


def feature_codes(text: Column, dim: int = DIM) -> Column:
    """One number per word: 2 * dimension + sign bit, read from the first nine hex digits of its md5.

    The first eight digits choose the dimension, the parity of the ninth the sign.
    """
    digits = F.transform(
        X.tokens(text), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 9), 16, 10).cast("bigint")
    )
    return F.transform(digits, lambda x: (F.shiftright(x, 4) % dim * 2 + x.bitwiseAND(F.lit(1))).cast("int"))


def _histogram(dim: int):
    @F.arrow_udf("array<double>")
    def unit_histogram(codes: pa.Array) -> pa.Array:
        n = len(codes)
        counts = pc.fill_null(pc.list_value_length(codes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends = codes.flatten().to_numpy(zero_copy_only=False), np.cumsum(counts)
        unit, start = np.zeros((n, dim)), 0
        while start < n:
            # As many rows as have CODES words together, one at least.
            before = ends[start] - counts[start]
            end = min(max(start + 1, int(np.searchsorted(ends, before + CODES, "right"))), start + ROWS, n)
            part = flat[before : ends[end - 1]]
            slots = np.repeat(np.arange(end - start, dtype=np.int64) * dim, counts[start:end]) + part // 2
            weights = 1.0 - 2.0 * (part % 2)
            sums = np.bincount(slots, weights=weights, minlength=(end - start) * dim).reshape(end - start, dim).astype(float, copy=False)
            length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            np.divide(sums, length, out=unit[start:end], where=length > 0)
            start = end
        return pa.ListArray.from_arrays(np.arange(0, n * dim + 1, dim, dtype=np.int32), unit.ravel())

    # Kept from being copied into filters and generators, which would embed every text twice.
    return unit_histogram.asNondeterministic()


def embed_text(text: Column, dim: int = DIM) -> Column:
    """Hashed bag of words as a unit vector; null and blank text give the zero vector.

    Words are split and hashed in the JVM; one Arrow call per batch adds them up per row, so the
    whole step is a projection without a shuffle.
    """
    return _histogram(dim)(feature_codes(text, dim))


def embed_batch(df: DataFrame, text: str, out: str = "embedding", dim: int = DIM) -> DataFrame:
    return df.withColumn(out, embed_text(F.col(text), dim))


Encoder = Callable[[list[str]], np.ndarray]


def embed_with_model(df: DataFrame, text: str, load: Callable[[], Encoder], out: str = "embedding") -> DataFrame:
    """Embed with any encoder. `load` runs once per Python worker, then sees one Arrow batch at a
    time; set spark.sql.execution.arrow.maxRecordsPerBatch to the batch the model wants."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(list(np.asarray(model(batch.fillna("").tolist()), dtype=np.float64)))

    return df.withColumn(out, encode(F.col(text)))


def nonzero(vector: Column) -> Column:
    return F.exists(vector, lambda x: x != 0)


def half_up_6(v: Column) -> Column:
    """Round to six places in plain double arithmetic; `round` goes through decimals, row by row."""
    return F.signum(v) * F.floor(F.abs(v) * 1e6 + 0.5) / 1e6


def long_form(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, dim, v) for the components that are not zero."""
    return (
        df.select(key, F.posexplode(vector).alias("dim", "v"))
        .where(F.col("v") != 0)
        .select(key, "dim", half_up_6(F.col("v")).alias("v"))
    )


def pair_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("similarity", F.round(L.dot(F.col(a), F.col(b)), 6))


def similarity_ranking(query: DataFrame, candidates: DataFrame) -> DataFrame:
    """All candidates by their dot product with the one query vector, best first.

    The query is a scalar subquery, so candidates are scanned and sorted, not joined.
    """
    both = candidates.withColumn("_query", query.select("embedding").limit(1).scalar())
    similarity = F.round(L.dot(F.col("embedding"), F.col("_query")), 6).alias("similarity")
    return both.select("article_id", similarity).orderBy(F.col("similarity").desc(), "article_id")


def title_weighted_embedding(title_vec: Column, content_vec: Column, title_weight: float = 0.3) -> Column:
    return L.l2_normalize(L.weighted_sum(title_vec, title_weight, content_vec, 1.0 - title_weight))


def embedding_quality(vectors: DataFrame) -> DataFrame:
    """Counts of zero vectors and of vectors that are neither zero nor of length 1."""
    length = F.round(L.norm(F.col("embedding")), 6)
    off = (length > 0) & (F.abs(length - 1.0) > 1e-3)
    return vectors.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_if(length == 0).alias("zero"),
        F.count_if(off).alias("off_unit"),
        F.min(length).alias("min_norm"),
        F.max(length).alias("max_norm"),
    )
