"""Item-item cosine on clicks as a blocked sparse Gram product.

The cosine of two articles is the number of users who clicked both over the square root of the product of their clickers. A
task takes a cell of articles with the click lists of their clickers and adds up a row of the Gram matrix for each of its articles in
NumPy; only an article's best neighbours leave it, so pairs of co-clicked articles never become rows. Cells are cut by work: the
list entries that their articles meet. A long list is dealt out in segments, and an article with too much work for one cell is cut by
user into several cells, whose counts are added up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from newsloom.functions.scale import PLACES
from newsloom.sources.tables import materialize

#: List entries that a cell meets, about; longest piece of a click list; pairs that are counted at once.
CELL_ENTRIES = 1 << 23
SEGMENT = 1 << 13
PAIRS_AT_ONCE = 1 << 22
CELL_SCHEMA = "article_id bigint, neighbour_id bigint, both bigint, clickers bigint, neighbour_clickers bigint, whole boolean"


def ragged_pairs(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the flattened lists a and b) of all pairs of an element of a[r] and one of b[r], row after row."""
    pairs = sizes_a * sizes_b
    row = np.repeat(np.arange(len(pairs)), pairs)
    inside = np.arange(len(row)) - (np.cumsum(pairs) - pairs)[row]
    first_a, first_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
    return first_a[row] + inside // sizes_b[row], first_b[row] + inside % sizes_b[row]


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, place = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(place, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64)


def rank_order(cosine: np.ndarray, article: np.ndarray, neighbour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by article, falling cosine and neighbour, and the place within the article."""
    order = np.lexsort((neighbour, -cosine, article))
    starts = np.flatnonzero(np.r_[True, article[order][1:] != article[order][:-1]]) if len(order) else np.zeros(0, int)
    return order, np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))


def _cell(table: pa.Table, k: int) -> pa.Table:
    """Neighbours of a cell's articles: the k best, or all if other cells hold more of the article's clickers."""
    own, own_sizes = _flat(table.column("own"))
    other, other_sizes = _flat(table.column("list"))
    own_clickers, _ = _flat(table.column("own_clickers"))
    other_clickers, _ = _flat(table.column("list_clickers"))
    own_ids, own_first, own_code = np.unique(own, return_index=True, return_inverse=True)
    ids, first, code = np.unique(other, return_index=True, return_inverse=True)
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    own_ends, other_ends, ends = np.cumsum(own_sizes), np.cumsum(other_sizes), np.cumsum(own_sizes * other_sizes)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        a, b = ragged_pairs(own_sizes[at:stop], other_sizes[at:stop])
        a += own_ends[at] - own_sizes[at]
        b += other_ends[at] - other_sizes[at]
        some, n = np.unique(own_code[a].astype(np.int64) * len(ids) + code[b], return_counts=True)
        keys.append(some)
        counts.append(n)
        if sum(map(len, keys)) > 2 * PAIRS_AT_ONCE:
            some, n = _counted(keys, counts)
            keys, counts = [some], [n]
        at = stop
    key, both = _counted(keys, counts)
    row, column = key // max(1, len(ids)), key % max(1, len(ids))
    different = own_ids[row] != ids[column]
    row, column, both = row[different], column[different], both[different]
    article, neighbour = own_ids[row], ids[column]
    clickers, neighbour_clickers = own_clickers[own_first][row], other_clickers[first][column]
    whole = bool(table.column("whole")[0].as_py())
    if whole:
        cosine = np.round(both / np.sqrt(clickers * neighbour_clickers), PLACES)
        order, place = rank_order(cosine, article, neighbour)
        kept = order[place < k]
        article, neighbour, both = article[kept], neighbour[kept], both[kept]
        clickers, neighbour_clickers = clickers[kept], neighbour_clickers[kept]
    return pa.table(
        {
            "article_id": article, "neighbour_id": neighbour, "both": both, "clickers": clickers,
            "neighbour_clickers": neighbour_clickers, "whole": np.full(len(article), whole),
        }
    )


def item_neighbours(
    matrix: DataFrame, k: int, cell_entries: int = CELL_ENTRIES, segment: int = SEGMENT
) -> DataFrame:
    """(article_id, neighbour_id, both, cosine, rank): the k articles with the highest click cosine, ties to the smaller id.

    `matrix` has one row per (user_id, article_id) that was clicked; rows with a null in either are left out. Exact, whatever the number
    of clicks of a user or of an article.
    """
    clicked = matrix.select("user_id", "article_id").dropna()
    clickers = clicked.groupBy("article_id").agg(F.count(F.lit(1)).alias("clickers"))
    clicks = clicked.groupBy("user_id").agg(F.count(F.lit(1)).alias("clicks"))
    pairs = materialize(clicked.join(clickers, "article_id").join(clicks, "user_id"), "clicked")
    work = pairs.groupBy("article_id").agg(F.sum("clicks").alias("work"))
    cells = work.agg(F.ceil(F.sum("work") / cell_entries).cast("bigint")).scalar()
    h = lambda c, n: F.pmod(F.xxhash64(c), n)
    placed = pairs.join(work, "article_id").withColumn("parts", F.ceil(F.col("work") / cell_entries))
    alone = F.col("parts") > 1
    own = (
        placed.withColumn("whole", ~alone)
        .withColumn("cell", F.when(alone, F.col("article_id")).otherwise(h("article_id", F.coalesce(cells, F.lit(1)))))
        .withColumn("part", F.when(alone, h("user_id", F.col("parts"))).otherwise(-1))
        .groupBy("cell", "part", "whole", "user_id")
        .agg(F.collect_list(F.struct("article_id", "clickers")).alias("_own"))
    )
    lists = (
        pairs.withColumn("segment", h("article_id", F.ceil(F.col("clicks") / segment)))
        .groupBy("user_id", "segment")
        .agg(F.collect_list(F.struct("article_id", "clickers")).alias("_list"))
    )
    met = own.join(lists, "user_id").select(
        "cell", "part", "whole", F.col("_own.article_id").alias("own"), F.col("_own.clickers").alias("own_clickers"),
        F.col("_list.article_id").alias("list"), F.col("_list.clickers").alias("list_clickers"),
    )

    def run(table: pa.Table) -> pa.Table:
        return _cell(table, k)

    found = materialize(met.groupBy("cell", "part", "whole").applyInArrow(run, CELL_SCHEMA), "neighbours")
    parts = found.where("not whole").groupBy("article_id", "neighbour_id").agg(
        F.sum("both").alias("both"), F.first("clickers").alias("clickers"), F.first("neighbour_clickers").alias("neighbour_clickers")
    )
    both = found.where("whole").drop("whole").unionByName(parts)
    cosine = F.round(F.col("both") / F.sqrt(F.col("clickers") * F.col("neighbour_clickers")), PLACES)
    best = Window.partitionBy("article_id").orderBy(F.col("cosine").desc(), "neighbour_id")
    ranked = both.withColumn("cosine", cosine).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("article_id", "neighbour_id", "both", "cosine", "rank")


def neighbour_scores(matrix: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(user_id, article_id, collab): summed cosines of an article to the articles a user clicked, as far as it is among their
    neighbours; a clicked article counts 1 for itself."""
    clicked = matrix.select("user_id", "article_id").dropna()
    near = clicked.join(neighbours.select("article_id", "neighbour_id", "cosine"), "article_id").select(
        "user_id", F.col("neighbour_id").alias("article_id"), "cosine"
    )
    all_ = near.unionByName(clicked.withColumn("cosine", F.lit(1.0)))
    return all_.groupBy("user_id", "article_id").agg(F.round(F.sum("cosine"), PLACES).alias("collab"))
