"""Scaling, rounding and dense numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.sources.tables import materialize

PLACES = 6


def r6(value: Column) -> Column:
    return F.round(value.cast("double"), PLACES)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null when whole is 0."""
    return r6(F.try_divide(part.cast("double"), whole.cast("double")))


def minmax(value: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low); 1.0 when the range is empty; null stays null."""
    return F.when(value.isNull(), F.lit(None).cast("double")).when(high == low, F.lit(1.0)).otherwise(
        (value - low) / (high - low)
    )


def dense_positions(df: DataFrame, key: str, out: str) -> DataFrame:
    """Number rows 0, 1, 2, ... in order of a key, without sorting them in one task.

    Rows are range-partitioned by the key, whatever its values are, and sorted within; only the number of rows per
    partition, one row a task, is summed in order. The sorted rows are stored, so both uses see the same partitions.
    """
    ranged = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_id", F.monotonically_increasing_id())
    stored = materialize(ranged, "positions")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    return (
        stored.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn(out, (F.col("_start") + place).cast("bigint"))
        .drop("_part", "_start", "_id")
    )
