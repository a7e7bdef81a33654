"""Reading and writing tables: parquet with declared schemas, versioned snapshots, dated logs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsloom.schemas import TABLES
from newsloom.session import scratch_dir, shared_dir


def read_table(spark: SparkSession, folder: str, name: str, spread_text: bool = True) -> DataFrame:
    df = spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")
    return spread(df) if spread_text and name in TEXT_TABLES else df


TEXT_TABLES = ("documents", "pages")


def spread(df: DataFrame) -> DataFrame:
    """Share out a scan with fewer pieces than cores, so that costly text work uses them all.

    A table of many files already has enough pieces and is left alone, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_snapshot(df: DataFrame, root: str) -> int:
    """Write a whole table as a new version and return its number.

    A version counts only once Spark has committed it (its _SUCCESS file exists), so a lost
    executor or a failed job never leaves a half-written table to readers.
    """
    taken = _versions(df.sparkSession, root, committed=False)
    version = max(taken, default=0) + 1
    df.write.mode("errorifexists").parquet(f"{root}/v={version}")
    return version


def read_snapshot(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The given version, or the newest committed one."""
    if version is None:
        done = _versions(spark, root, committed=True)
        if not done:
            raise FileNotFoundError(f"no committed version under {root}")
        version = max(done)
    return spark.read.schema(schema).parquet(f"{root}/v={version}")


def _versions(spark: SparkSession, root: str, committed: bool) -> list[int]:
    """Version numbers under `root`, through the Hadoop file system the path belongs to."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("v="):
            if not committed or fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append(int(name[2:]))
    return found


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, in the file system it belongs to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Compute a table once that several parts of a job read: write it to the shared scratch
    folder and read it back. Unlike cached blocks it outlives executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_once(spark: SparkSession, folder: str, names: list[str], label: str, build: Callable[[str], None]) -> str:
    """Path of a stored structure that is built from tables of `folder`, once for each state of their files.

    It lies in the shared folder under a name that follows the files' names, sizes and times, so it is built anew when a table
    changes, and a build that failed leaves no marker and is repeated elsewhere.
    """
    jvm = spark._jvm
    state = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files = fs.listFiles(path, True)
        while files.hasNext():
            status = files.next()
            state.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    key = hashlib.sha256(repr(sorted(state)).encode()).hexdigest()[:20]
    marks = f"{shared_dir(spark)}/{label}-{key}"
    mark = jvm.org.apache.hadoop.fs.Path(marks)
    fs = mark.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(mark):
        return spark.read.text(marks).first()[0]
    path = scratch_dir(spark, label)
    build(path)
    spark.createDataFrame([(path,)], "value string").coalesce(1).write.mode("overwrite").text(marks)
    return path


def write_batch(df: DataFrame, root: str, batch_id: int) -> None:
    """Append a micro-batch under its own folder; writing the same batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")


def read_batches(spark: SparkSession, root: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """All rows appended so far, with their batch_id; `before` leaves out later batches."""
    full = T.StructType(schema.fields + [T.StructField("batch_id", T.LongType())])
    df = spark.read.schema(full).option("basePath", root).parquet(root)
    return df if before is None else df.where(F.col("batch_id") < before)


def read_batch(spark: SparkSession, root: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """The rows of one batch; no other folder is listed."""
    return spark.read.schema(schema).parquet(f"{root}/batch_id={batch_id}")


def write_interactions_by_date(interactions: DataFrame, path: str) -> None:
    """Log partitioned by event date.

    Rows are rebalanced by date: a date that holds most of the rows is split over as many tasks and files as its size
    asks for, small dates share a task, and each has few files.
    """
    dated = interactions.withColumn("dt", F.date_format("ts", "yyyy-MM-dd"))
    dated.hint("rebalance", "dt").write.mode("overwrite").partitionBy("dt").parquet(path)


def read_interactions_by_date(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType(schema.fields + [T.StructField("dt", T.StringType())])
    return spark.read.schema(full).parquet(path)


def archive_before(log: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(rows to archive, rows to keep); the test is on the partition column, so it prunes folders."""
    return log.where(F.col("dt") < cutoff), log.where(F.col("dt") >= cutoff)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """Read a database table in parallel key ranges."""
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", key)
        .option("lowerBound", low)
        .option("upperBound", high)
        .option("numPartitions", parts)
        .load()
    )


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append") -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).mode(mode).save()


