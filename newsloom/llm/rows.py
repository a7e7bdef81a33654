"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column | str) -> Column:
    """Number of words; null counts as the empty text."""
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that `df` does not have (names compare without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder through the file system it is on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns (maps cannot be hashed and are left out), so rows with one key and id are alike."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()))


def take_rows(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of `docs` as often as `plan` (key, doc_id, rows, copies) says: rows with that key and id, and how many
    of them are wanted. Rows that are alike are told apart by counting only. Rows that `plan` does not name go.

    `plan` has one row per key and id; it is read more than once, so it is a stored table.
    """
    key, own, rows, copies, one = fresh(docs, "key", "own", "rows", "copies", "one")
    wanted = plan.where("copies > 0").select("key", "doc_id", "rows", "copies").toDF(key, own, rows, copies)
    joined = docs.withColumn(key, row_key(docs)).join(wanted, key).where(
        F.col(own).eqNullSafe(F.col("doc_id").cast("long"))
    )
    single = joined.where(F.col(rows) == 1)
    alike = joined.where(F.col(rows) > 1).dropDuplicates([key, own])
    return single.unionByName(alike).withColumn(
        one, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))
    ).select(*(F.col(f"`{c}`") for c in docs.columns))
