from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from newsloom.sources import runs as R

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])


def rows(spark, items):
    return spark.createDataFrame(list(items), SCHEMA)


def scanned(df) -> int:
    """Rows that left the file scans of a query that was collected."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.nodeName() else plan
    todo, found = [plan], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_batches_lookups_and_merges_equal_a_dictionary(spark, tmp_path):
    table = R.RunTable(spark, str(tmp_path / "t"), SCHEMA, ("k",), fanout=3)
    assert table.read().count() == 0 and table.lookup(rows(spark, [("a", 0)])).count() == 0
    rng, want = np.random.default_rng(1), []
    for batch in range(11):
        table.compact(batch)
        new = [(f"k{rng.integers(30)}", int(batch)) for _ in range(6)] + [(None, batch)] * (batch == 4)
        before = sorted(map(tuple, table.lookup(rows(spark, new), before=batch).collect()), key=str)
        keys = {k for k, _ in new}
        assert before == sorted((r for r in want if r[0] in keys), key=str)
        table.write(rows(spark, new), batch)
        if batch % 4 == 0:  # a batch that runs again
            table.compact(batch)
            assert table.lookup(rows(spark, new), before=batch).count() == len(before)
            table.write(rows(spark, new), batch)
        want += new
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted(want, key=str)
    assert table.runs() == [(0, 8), (9, 9), (10, 10)] == sorted(table._committed())


def test_merging_combines_rows_of_a_key(spark, tmp_path):
    table = R.RunTable(spark, str(tmp_path / "t"), SCHEMA, ("k",), fanout=2)
    for batch in range(5):
        table.compact(batch, lambda r: r.groupBy("k").agg(F.sum("n").alias("n")))
        table.write(rows(spark, [("a", 1), (f"b{batch}", 10)]), batch)
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("a", 4), *((f"b{i}", 10) for i in range(5))]


def test_a_half_written_run_does_not_count(spark, tmp_path):
    table = R.RunTable(spark, str(tmp_path / "t"), SCHEMA, ("k",))
    table.write(rows(spark, [("a", 1)]), 0)
    rows(spark, [("b", 2)]).write.parquet(str(tmp_path / "t" / "run=1..1"))
    (tmp_path / "t" / "run=1..1" / "_SUCCESS").unlink()
    assert [r.k for r in table.read().collect()] == ["a"]


def test_what_a_lookup_reads_does_not_grow_with_the_table(spark, tmp_path):
    read = []
    for size in (20_000, 200_000):
        table = R.RunTable(spark, str(tmp_path / f"t{size}"), SCHEMA, ("k",))
        table.write(spark.range(size).selectExpr("concat('url', id) AS k", "id AS n"), 0)
        found = table.lookup(rows(spark, [(f"url{i * 997}", 0) for i in range(5)] + [("none", 0)]))
        assert sorted(r.k for r in found.collect()) == sorted(f"url{i * 997}" for i in range(5))
        read.append(scanned(found))
    assert 5 <= read[0] <= 12_000 and read[1] <= 1.5 * read[0] + 2_000, read


def test_many_keys_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "FEW_KEYS", 3)
    table = R.RunTable(spark, str(tmp_path / "t"), SCHEMA, ("k",))
    table.write(rows(spark, [(f"k{i}", i) for i in range(50)]), 0)
    got = table.lookup(rows(spark, [(f"k{i}", 0) for i in range(0, 60, 2)]))
    assert sorted(r.n for r in got.collect()) == list(range(0, 50, 2))
