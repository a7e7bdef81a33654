"""Replay of a time-to-live cache over a query log.

An entry is set on a miss and lives for a fixed time; hits do not extend it. Which requests miss
depends on the miss before, so the log of a key is a chain. To keep a very popular key out of one
task, its log is cut into days. For every time at which the cache may still be filled when a day
begins, the day's chain is followed once: how many misses, and when the entry then expires. Chains
of nearby starts soon meet, so a day shrinks to a few steps, and only those are joined per key.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsloom.functions.ordered import micros

DAY = 86_400_000_000
STEPS = "key string, day bigint, upto bigint, expires bigint, misses bigint"
TOTALS = "key string, misses bigint"


def day_steps(group: np.ndarray, t: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, upto, expires, misses) for rows sorted by (group, t), a group being one key's day.

    A cache filled until e acts by the group's first step with upto >= e. All groups are followed
    at once: times are shifted so that groups lie further apart than the time to live.
    """
    inside = t % DAY
    shifted = group * (2 * DAY) + inside
    following = np.searchsorted(shifted, shifted + ttl, side="left")
    ends = np.searchsorted(group, group, side="right")
    # Starts: whatever may come first after an entry from the day before, which lasts at most ttl.
    first_late = np.searchsorted(shifted, group * (2 * DAY) + ttl, side="left")
    entry = np.flatnonzero(np.arange(len(t)) <= first_late)
    at, misses = entry.copy(), np.ones(len(entry), dtype=np.int64)
    while True:
        go = following[at] < ends[at]
        if not go.any():
            break
        at = np.where(go, np.minimum(following[at], len(t) - 1), at)
        misses += go
    expires, g = t[at] + ttl, group[entry]
    keep = np.r_[(expires[1:] != expires[:-1]) | (misses[1:] != misses[:-1]) | (g[1:] != g[:-1]), True][: len(entry)]
    return entry[keep], t[entry][keep], expires[keep], misses[keep]


def _partition(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _groups(*columns: pa.ChunkedArray) -> np.ndarray:
    """Group number of each row of a table that is sorted by the columns."""
    codes = [np.asarray(c.combine_chunks().dictionary_encode().indices) if pa.types.is_string(c.type) else c.to_numpy() for c in columns]
    changed = np.zeros(len(codes[0]) - 1, dtype=bool)
    for c in codes:
        changed |= c[1:] != c[:-1]
    return np.r_[0, np.cumsum(changed)]


def cache_hits(log: DataFrame, key: str, ts: str, ttl_seconds: int = 3600) -> DataFrame:
    """(key, requests, misses, hits, hit_rate) per key."""
    ttl = ttl_seconds * 1_000_000
    if ttl > DAY:
        raise ValueError("time to live must not exceed a day")
    moments = log.select(F.col(key).alias("key"), micros(F.col(ts)).alias("t")).groupBy("key", "t").agg(
        F.count(F.lit(1)).alias("n")
    )
    requests = moments.groupBy("key").agg(F.sum("n").alias("requests"))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _partition(batches)
        if table is not None:
            t = table["t"].to_numpy()
            row, upto, expires, misses = day_steps(_groups(table["key"], table["day"]), t, ttl)
            out = table.select(["key", "day"]).take(pa.array(row))
            for name, values in (("upto", upto), ("expires", expires), ("misses", misses)):
                out = out.append_column(name, pa.array(values))
            yield from out.to_batches()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _partition(batches)
        if table is None:
            return
        upto, expires, misses = (table[c].to_pylist() for c in ("upto", "expires", "misses"))
        keys, days = _groups(table["key"]), _groups(table["key"], table["day"])
        starts = np.flatnonzero(np.r_[True, days[1:] != days[:-1]]).tolist() + [len(days)]
        totals = [0] * (int(keys[-1]) + 1)
        filled, current = 0, -1
        for a, b in zip(starts, starts[1:]):
            if keys[a] != current:
                filled, current = -(1 << 62), int(keys[a])
            i = bisect_left(upto, filled, a, b)
            if i < b:
                filled = expires[i]
                totals[current] += misses[i]
        firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        out = table.select(["key"]).take(pa.array(firsts)).append_column("misses", pa.array(totals, pa.int64()))
        yield from out.to_batches()

    days = moments.select("key", F.floor(F.col("t") / DAY).cast("bigint").alias("day"), "t")
    per_day = days.repartition("key", "day").sortWithinPartitions("key", "day", "t").mapInArrow(steps, STEPS)
    per_key = per_day.repartition("key").sortWithinPartitions("key", "day", "upto")
    misses = per_key.mapInArrow(chain, TOTALS)
    hits = F.col("requests") - F.col("misses")
    return requests.join(misses, "key").select(
        "key", "requests", "misses", hits.alias("hits"), F.round(hits / F.col("requests"), 6).alias("hit_rate")
    )
