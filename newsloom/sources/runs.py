"""A stored table of keyed rows that grows batch by batch and is looked up by key.

A batch writes one run: its rows sorted by a hash of the key, in Parquet files with small pages, column indexes and a Bloom filter on
that hash. A lookup of few keys reads the pages that can hold their hashes only, whatever the table has grown to. Every
`fanout` runs are merged into a larger one, and every `fanout` of those again, so there are few runs and each row is rewritten a
logarithmic number of times. A run's folder names the batches it covers; a merged run takes the place of those inside it once it is
committed, so a batch that runs again, or a job that stops half-way, leaves the same table.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

HASH = "key_hash"
#: Keys that are looked up by their hashes; more are joined, and then most pages hold one of them anyway.
FEW_KEYS = 4_096
PAGE_BYTES = 16 << 10
GROUP_BYTES = 4 << 20
_RUN = re.compile(r"run=(-?\d+)\.\.(-?\d+)")


@dataclass(frozen=True)
class RunTable:
    spark: SparkSession
    path: str
    schema: T.StructType
    key: tuple[str, ...]
    fanout: int = 8

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, first: int, last: int) -> str:
        return f"{self.path}/run={first}..{last}"

    def _committed(self) -> list[tuple[int, int]]:
        path, fs = self.spark._jvm.org.apache.hadoop.fs.Path, self._fs()
        if not fs.exists(path(self.path)):
            return []
        found = []
        for status in fs.listStatus(path(self.path)):
            name = _RUN.fullmatch(status.getPath().getName())
            if name and fs.exists(path(status.getPath(), "_SUCCESS")):
                found.append((int(name[1]), int(name[2])))
        return found

    def runs(self, before: int | None = None) -> list[tuple[int, int]]:
        """The runs that make up the table, without those that a merged run replaces."""
        all_ = [r for r in self._committed() if before is None or r[1] < before]
        inside = lambda r, s: r != s and s[0] <= r[0] and r[1] <= s[1]
        return sorted(r for r in all_ if not any(inside(r, s) for s in all_))

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        full = T.StructType([T.StructField(HASH, T.LongType()), *self.schema.fields])
        if not runs:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(*(self._folder(*r) for r in runs))

    def _hash(self) -> Column:
        return F.xxhash64(*self.key)

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        sorted_ = rows.select(self._hash().alias(HASH), *self.schema.fieldNames()).repartitionByRange(HASH).sortWithinPartitions(HASH)
        (
            sorted_.write.mode("overwrite")
            .option("parquet.page.size", PAGE_BYTES).option("parquet.block.size", GROUP_BYTES)
            .option(f"parquet.bloom.filter.enabled#{HASH}", "true").option("parquet.page.row.count.limit", 1_000)
            .option(f"parquet.enable.dictionary#{HASH}", "false")
            .parquet(self._folder(first, last))
        )

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Add the rows of a batch; writing it again replaces them."""
        self._write(rows, batch_id, batch_id)

    def read(self, before: int | None = None) -> DataFrame:
        return self._read(self.runs(before)).drop(HASH)

    def lookup(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Rows with one of the keys (rows of the key columns)."""
        stored, wanted = self._read(self.runs(before)), keys.select(*self.key).distinct()
        few = [r[0] for r in wanted.select(self._hash()).limit(FEW_KEYS + 1).collect()]
        if len(few) <= FEW_KEYS:
            # Pushed down as a list, not as the range of its values.
            self.spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(FEW_KEYS))
            stored = stored.where(F.col(HASH).isin(few))
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"w.{c}")) for c in self.key]
        return stored.drop(HASH).alias("s").join(wanted.alias("w"), same, "left_semi")

    def compact(self, batch_id: int, merge: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Merge runs before a batch where it ends a group of `fanout`; `merge` may combine rows of one key.

        Called when a batch begins: the batches before are finished and will not be written again.
        """
        size = self.fanout
        while batch_id > 0 and batch_id % size == 0:
            span = (batch_id - size, batch_id - 1)
            parts = [r for r in self.runs(batch_id) if span[0] <= r[0] and r[1] <= span[1]]
            if len(parts) > 1:
                self._write(merge(self._read(parts).drop(HASH)), *span)
            size *= self.fanout
        path, fs, kept = self.spark._jvm.org.apache.hadoop.fs.Path, self._fs(), self.runs()
        for run in self._committed():
            if run not in kept:
                fs.delete(path(self._folder(*run)), True)
