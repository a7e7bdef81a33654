"""Mixing sources to target weights with cube-method balanced sampling.

Each source gets a target number of words. A document of a source is expected target / source size times in the mix: so many
whole copies, and one more with the fractional rest as its probability. The cube method draws that one: it moves the
probabilities of three documents at a time along the direction that changes neither the expected number of words nor the expected
number of documents, until at most two documents of a block are undecided. These meet again in new blocks, until a source has a
single block; there the two and a few documents kept for it are landed on the outcome nearest to the target.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.rows import drop_folder, row_key, take_rows, word_count
from newsloom.session import scratch_dir

WEIGHTS = (1.0, 2.0, 3.0)
#: A source gives at most so many times its size, and no document is taken more often.
MOST = 3.0
#: Documents that one task moves together.
BLOCK_ROWS = 4_096
#: Documents of a source's last block that are left to the landing, besides the two of the flight. All outcomes are tried.
LANDING_ROWS = 12
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target, from rows (source, size): all words, shared out by weight.

    Sources in code-point order, null last, weigh `weights` in turn. A target stops at `most` times its source's size; what is
    over is shared out again by weight, until no target is above. A source without words has the target 0.
    Only sums travel to the driver, three numbers a round.
    """
    spark = sizes.sparkSession
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Position of a source: range partitions in order, the number of sources in earlier partitions, the place within.
    ranged = per_source.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(
        F.col("source").asc_nulls_last()
    ).withColumn("id", F.monotonically_increasing_id())
    path = scratch_dir(spark, "source-sizes")
    ranged.write.parquet(path)
    stored = spark.read.schema(ranged.schema).parquet(path)
    part = F.shiftright("id", 33)
    counts = {r.part: r.n for r in stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(counts):  # one number per range of sources, that is per task
        offsets.append((p, before - (p << 33)))
        before += counts[p]
    shift = spark.createDataFrame(offsets or [(0, 0)], "part long, shift long")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("id") + F.col("shift"), F.lit(len(weights))).cast("int") + 1)
    weighed = stored.withColumn("part", part).join(shift, "part").select(
        "source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("most")
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    per_weight, capped = 0.0, -1
    while True:
        # With `per_weight` words for each unit of weight, sources at or above their bound give the bound.
        over = F.col("weight") * per_weight > F.col("most")
        sums = weighed.agg(
            F.sum(F.when(over, F.col("most"))).alias("given"),
            F.sum(F.when(~over, F.col("weight"))).alias("weights"),
            F.count(F.when(over, 1)).alias("capped"),
        ).first()
        if sums["capped"] == capped or not sums["weights"]:
            break
        capped, per_weight = sums["capped"], (total - (sums["given"] or 0.0)) / sums["weights"]
    target = F.least(F.col("weight") * F.lit(float(per_weight)), F.col("most"))
    return weighed.select("source", "source_size", target.alias("target"))


def _step(p: list[float], w: list[float], draw: float) -> list[float]:
    """Move three probabilities along the direction that keeps sum(p) and sum(p * w), to where one becomes 0 or 1.

    Which of the two ends is drawn so that each probability keeps its expectation.
    """
    u = (w[2] - w[1], w[0] - w[2], w[1] - w[0])
    if abs(u[0]) + abs(u[1]) + abs(u[2]) < EPS:  # equal sizes: any move that keeps the sum will do
        u = (1.0, -1.0, 0.0)
    ahead = min((1 - q) / v if v > 0 else q / -v for q, v in zip(p, u) if v)
    back = min(q / v if v > 0 else (1 - q) / -v for q, v in zip(p, u) if v)
    far = ahead if draw * (ahead + back) < back else -back
    return [q + far * v for q, v in zip(p, u)]


def flight(words: list[float], p: list[float], rng: random.Random) -> list[float]:
    """Move the probabilities until at most two lie strictly between 0 and 1."""
    p, scale, undecided = list(p), max(words, default=0.0) or 1.0, []
    for i in range(len(words)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        undecided.append(i)
        while len(undecided) == 3:
            moved = _step([p[j] for j in undecided], [words[j] / scale for j in undecided], rng.random())
            for j, q in zip(undecided, moved):
                p[j] = float(round(q)) if q < EPS or q > 1 - EPS else q
            undecided = [j for j in undecided if 0 < p[j] < 1]
    return p


def land(words: list[float], p: list[float]) -> list[float]:
    """Decide the few documents that are left: the outcome nearest to the expected words and number of documents."""
    p, left = list(p), [i for i, q in enumerate(p) if 0 < q < 1]
    if not left:
        return p
    w, q = np.array([words[i] for i in left]), np.array([p[i] for i in left])
    outcomes = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
    off_words = np.abs(outcomes @ w - q @ w) / max(1.0, w.sum())
    off_number = np.abs(outcomes.sum(axis=1) - q.sum()) / len(left)
    best = outcomes[np.argmin(np.round(off_words + 0.05 * off_number, 12))]
    for i, taken in zip(left, best):
        p[i] = float(taken)
    return p


def draw_copies(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The rows of the narrow table (doc_id, source, size, key) with source_size, target and copies (0 to `most`).

    `key` is any number that tells rows apart; rows that share all of these are interchangeable. The draw depends on the rows
    and `seed` only, not on how they are partitioned.
    """
    spark = docs.sparkSession
    shares = source_targets(docs.select("source", "size"), weights, most)
    totals = docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    path = scratch_dir(spark, "mix-sources")
    shares.join(totals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").write.parquet(path)
    known = spark.read.parquet(path).withColumnRenamed("source", "s")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = docs.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("expected", expected).select(
        "doc_id", "source", "size", "key", "source_size", "target", "rows",
        F.floor("expected").alias("whole"), (F.col("expected") - F.floor("expected")).alias("p"),
    )
    levels, level = [], 0
    while True:
        # Blocks of about BLOCK_ROWS rows of one source; a source of any size is moved by many tasks at once.
        blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("long")
        dealt = start.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "key"), blocks)).withColumn(
            "last", blocks == 1
        )
        out = scratch_dir(spark, f"mix-level{level}")
        dealt.groupBy("source", "block").applyInArrow(
            _mover(seed, level), dealt.drop("block", "last").schema.add("open", "boolean")
        ).write.parquet(out)
        moved = spark.read.parquet(out)
        levels.append(moved.where(~F.col("open")))
        rest = moved.where("open").drop("open")
        left = rest.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        if rest.isEmpty():
            break
        narrow = left.withColumnRenamed("source", "s").withColumnRenamed("n", "now")
        start = rest.join(narrow, F.col("source").eqNullSafe(F.col("s"))).drop("s", "rows").withColumnRenamed("now", "rows")
        start = start.select("doc_id", "source", "size", "key", "source_size", "target", "rows", "whole", "p")
        level += 1
    result = levels[0]
    for more in levels[1:]:
        result = result.unionByName(more)
    drop_folder(spark, path)
    return result.withColumn("copies", (F.col("whole") + F.round("p")).cast("int")).drop("rows", "whole", "p", "open")


def _mover(seed: int, level: int):
    def move(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("key", "ascending"), ("doc_id", "ascending")])
        rng = random.Random(f"{seed} {level} {key[0].as_py()!r} {key[1].as_py()}")
        words, p = [float(w) for w in group["size"].to_pylist()], group["p"].to_pylist()
        if group["last"][0].as_py():
            # Documents of all sizes, evenly chosen, so that their sums come near any number.
            kept = set(np.linspace(0, len(p) - 1, min(LANDING_ROWS, len(p)), dtype=int).tolist())
            flown = [i for i in range(len(p)) if i not in kept]
            p = [float(round(q)) if q < EPS or q > 1 - EPS else q for q in p]
            for i, q in zip(flown, flight([words[i] for i in flown], [p[i] for i in flown], rng)):
                p[i] = q
            p = land(words, p)
        else:
            p = flight(words, p, rng)
        out = group.drop_columns(["block", "last", "p"])
        out = out.append_column("p", pa.array(p, pa.float64()))
        return out.append_column("open", pa.array([0 < q < 1 for q in p], pa.bool_()))

    return move


def narrow_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and key of each row of `docs`."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count("text").cast("long").alias("size"), row_key(docs).alias("key"),
    )


def mix(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of each row of `docs` (repeated rows are drawn one by one).

    A null text is empty: size 0, taken 0. A null source is a source of its own, the last in order; an empty table gives an empty
    result. Null ids take part. Each source's words in the mix differ from its target by the landing alone, which decides
    LANDING_ROWS + 2 documents. Other columns are not looked at.
    """
    drawn = draw_copies(narrow_rows(docs), seed, weights, most)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The rows of `docs`, all columns, as often as the mix takes them."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "mix-copies")
    drawn = draw_copies(narrow_rows(docs), seed, weights, most)
    drawn.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies")).write.parquet(path)
    return take_rows(docs, spark.read.parquet(path))
