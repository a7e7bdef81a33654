"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.llm.rows import drop_folder
from newsloom.session import scratch_dir


def components(links: DataFrame) -> DataFrame:
    """node, root for each node of `links` (columns a, b of one ordered type): root is the component's smallest node.

    Each round replaces links by links to smaller nodes; the number of rounds grows with the logarithm of a component's
    size. A round is a stored table in the shared folder, so no round depends on lost executors' blocks. No step
    gathers a node's neighbours: they are reduced to their minimum, and joins on a frequent node can be split.
    """
    spark = links.sparkSession

    def store(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = scratch_dir(spark, "links")
        df.write.parquet(path)
        stored = spark.read.schema(df.schema).parquet(path)
        mark = stored.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return stored, path, tuple(mark)

    pairs = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current, path, mark = store(pairs.distinct())
    while True:
        moved, moved_path, moved_mark = store(_small_star(_large_star(current)))
        if moved_mark == mark:
            break
        drop_folder(spark, path)
        current, path, mark = moved, moved_path, moved_mark
    # Stars now: every node but the root has one link, to the root.
    roots = moved.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return moved.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to its smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(
        F.col("b").alias("a"), F.col("m").alias("b")
    ).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    others = links.join(least, F.col("a") == F.col("u")).where(F.col("b") != F.col("m")).select(
        F.col("b").alias("a"), F.col("m").alias("b")
    )
    return others.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
