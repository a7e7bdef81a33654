"""Order-dependent results per key that do not put a whole key into one task.

A key (a user, a conversation) may hold a large part of all rows, so a plain window per key is
avoided: rows are first reduced or cut by time or ordinal, and only the pieces are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.sources.tables import materialize


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def session_buckets(df: DataFrame, keys: list[str], ts: str, gap_seconds: int, *extra: Column) -> DataFrame:
    """Rows grouped by key and time bucket as long as the gap.

    Two events of one bucket are closer than the gap, so they share a session. The aggregate
    merges before the shuffle and leaves at most one row per key and gap of time.
    """
    bucket = F.floor(micros(F.col(ts)) / (gap_seconds * 1_000_000)).cast("bigint")
    return (
        df.withColumn("_bucket", bucket)
        .groupBy(*keys, "_bucket")
        .agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.count(F.lit(1)).alias("_n"), *extra)
    )


def number_sessions(buckets: DataFrame, keys: list[str], gap_seconds: int) -> DataFrame:
    """Add session_no (from 1): a silence of at least the gap starts a new session."""
    w = Window.partitionBy(*keys).orderBy("_bucket")
    before = F.lag("_to").over(w)
    starts = before.isNull() | (micros(F.col("_from")) - micros(before) >= gap_seconds * 1_000_000)
    flagged = buckets.withColumn("_new", starts.cast("int"))
    return flagged.withColumn("session_no", F.sum("_new").over(w).cast("int")).drop("_new")


def sum_before(df: DataFrame, keys: list[str], ordinal: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """Sum of `value` over the rows of the key with a lower ordinal, in two levels of blocks."""
    cut = df.withColumn("_block", F.floor(F.col(ordinal) / block).cast("bigint"))
    per_block = cut.groupBy(*keys, "_block").agg(F.sum(value).alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select(*keys, "_block", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(starts, [*keys, "_block"])
        .withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_block", "_before")
    )


def last_before(
    df: DataFrame, keys: list[str], ordinal: str, value: Column, n: int, out: str, block: int = 1024
) -> DataFrame:
    """Array of `value` of the n rows before each row in order of an integer, which may have gaps.

    Rows are counted through per key; keys are cut into blocks of these numbers, and the last n rows of a block are
    also given to the next.
    """
    df = sum_before(df.withColumn("_one", F.lit(1)), keys, ordinal, "_one", "_place", block)
    own, reached = F.floor(F.col("_place") / block), F.floor((F.col("_place") + n) / block)
    w = Window.partitionBy(*keys, "_block").orderBy("_place").rowsBetween(-n, -1)
    return (
        df.withColumn("_block", F.explode(F.array_distinct(F.array(own, reached))))
        .withColumn(out, F.collect_list(value).over(w))
        .where(F.col("_block") == own)
        .drop("_block", "_place", "_one")
    )


def exact_quantiles(df: DataFrame, group: str, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group without sorting a group in one task.

    Values are counted, then counts are summed per value range; running totals over the ranges
    tell which ranges hold the wanted ranks, and only their values are ordered. The ranges follow the data: 1/512 of
    the mean absolute value up to 8 times that, where at least 7 of 8 values are, and as wide as that beyond.
    """
    seen = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_v"))
    unit = seen.agg(F.coalesce(F.nullif(F.avg(F.abs("_v")), F.lit(0.0)), F.lit(1.0))).scalar()
    fine = F.floor(F.col("_v") / (F.col("_unit") / 512))
    wide = F.floor(F.col("_v") / (F.col("_unit") * 8)) * 4096
    counts = (
        seen.withColumn("_unit", unit)
        .withColumn("_range", F.when(F.abs("_v") <= F.col("_unit") * 8, fine).otherwise(wide).cast("bigint"))
        .groupBy(group, "_range", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranges = counts.groupBy(group, "_range").agg(F.sum("_n").alias("_rn"))
    up_to = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranges.select(
        group, "_range", "_rn", F.sum("_rn").over(up_to).alias("_end"),
        F.sum("_rn").over(Window.partitionBy(group)).alias("_total"),
    )
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()])
    rank = (F.col("_total") - 1) * F.col("_w.p")
    ranks = (
        placed.withColumn("_w", F.explode(wanted))
        .withColumn("_low", F.floor(rank))
        .withColumn("_high", F.ceil(rank))
        .withColumn("_start", F.col("_end") - F.col("_rn"))
        .where((F.col("_low") < F.col("_end")) & (F.col("_high") >= F.col("_start")))
        .withColumn("_part", rank - F.col("_low"))
        .select(group, "_range", "_start", "_low", "_high", "_part", F.col("_w.name").alias("_name"))
    )
    inside = Window.partitionBy(group, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = counts.withColumn("_cum", F.sum("_n").over(inside))
    hit = ordered.join(ranks, [group, "_range"])
    last, first = F.col("_start") + F.col("_cum"), F.col("_start") + F.col("_cum") - F.col("_n")
    holds = lambda r: (r >= first) & (r < last)
    return (
        hit.groupBy(group, "_name")
        .agg(
            F.max(F.when(holds(F.col("_low")), F.col("_v"))).alias("_a"),
            F.max(F.when(holds(F.col("_high")), F.col("_v"))).alias("_b"),
            F.max("_part").alias("_part"),
        )
        .select(
            group, F.col("_name").alias("quantile"),
            F.round(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part"), 6).alias("value"),
        )
    )


#: Accuracy of quantile sketches, and how far a bracket reaches on either side of a wanted rank: several times their error.
SKETCH_K = 800
REACH = 0.012


def bracketed_quantiles(df: DataFrame, groups: DataFrame, group: str, value: str, probs: dict[str, float]) -> DataFrame:
    """As `exact_quantiles`, from a sketch of each group: (group, _sketch, _n) in `groups`, n without nulls.

    The sketch brackets the wanted ranks. One pass counts the values below each bracket and keeps those inside, a few in a
    hundred, which are then ordered. A bracket that turns out not to hold its rank is left to `exact_quantiles`.
    """
    at = lambda share: F.kll_sketch_get_quantile_double("_sketch", F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    bracket = lambda name, p: F.struct(
        F.lit(name).alias("name"), ((F.col("_n") - 1) * F.lit(float(p))).alias("rank"),
        F.when(F.lit(p - REACH) > 0, at(F.lit(p - REACH))).otherwise(float("-inf")).alias("low"),
        F.when(F.lit(p + REACH) < 1, at(F.lit(p + REACH))).otherwise(float("inf")).alias("high"),
    )
    brackets = materialize(
        groups.where("_n > 0").select(group, F.explode(F.array(*[bracket(n, p) for n, p in probs.items()])).alias("_b")).select(group, "_b.*"),
        "brackets",
    )
    seen = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_v"))
    met = seen.join(brackets, group).where(F.col("_v") <= F.col("high"))
    counts = met.groupBy(group, "name", "rank", F.when(F.col("_v") >= F.col("low"), F.col("_v")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    up_to = Window.partitionBy(group, "name").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_last", F.sum("_n").over(up_to))
    holds = lambda r: F.col("_v").isNotNull() & (r >= F.col("_last") - F.col("_n")) & (r < F.col("_last"))
    found = materialize(
        placed.groupBy(group, "name", "rank").agg(
            F.max(F.when(holds(F.floor("rank")), F.col("_v"))).alias("_a"), F.max(F.when(holds(F.ceil("rank")), F.col("_v"))).alias("_b")
        ),
        "quantiles",
    )
    known = found.where("_a IS NOT NULL AND _b IS NOT NULL").select(
        group, F.col("name").alias("quantile"),
        F.round(F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("rank") - F.floor("rank")), 6).alias("value"),
    )
    missed = brackets.join(known.withColumnRenamed("quantile", "name"), [group, "name"], "left_anti").select(group).distinct()
    if missed.isEmpty():
        return known
    again = exact_quantiles(df.join(missed, group, "left_semi"), group, value, probs)
    return known.join(missed, group, "left_anti").unionByName(again)
