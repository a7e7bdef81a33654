from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions import topk
from newsloom.operators import ivf as I, vectors as G
from newsloom.schemas import VECTOR


def unit(n, dim=16, seed=42):
    m = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def index(spark, m, first=100):
    return spark.createDataFrame([(first + i, i, v.tolist()) for i, v in enumerate(m)], VECTOR)


def brute(m, k, first=100, exclude_self=False):
    m = m.astype(np.float64)
    want = set()
    for i, q in enumerate(m):
        d = np.round(((m - q) ** 2).sum(1), 6)
        order = sorted((x, first + j) for j, x in enumerate(d) if not (exclude_self and i == j))[:k]
        want |= {(first + i, j, r + 1) for r, (_, j) in enumerate(order)}
    return want


def found(df):
    return {(r.query_id, r.article_id, r.rank) for r in df.collect()}


def test_self_is_nearest_at_distance_zero(spark):
    v = index(spark, unit(50))
    best = G.knn_search(G.as_queries(v, "article_id"), v, 1).collect()
    assert len(best) == 50 and all(r.query_id == r.article_id and r.dist == 0 for r in best)


@pytest.mark.parametrize("exclude", [False, True])
def test_search_equals_brute_force_in_both_layouts(spark, monkeypatch, exclude):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 17)
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 23)
    monkeypatch.setattr(topk, "PAIRS_AT_ONCE", 100)
    m = unit(120)
    m[40:80] = m[3]  # a third of all vectors are copies: ties must go by id
    v = index(spark, m)
    want = brute(m, 7, exclude_self=exclude)
    q = G.as_queries(v, "article_id")
    assert found(G.knn_search(q, v, 7, exclude_self=exclude)) == want
    assert found(G.knn_search(q, v, 7, exclude_self=exclude, broadcast_bytes=0)) == want


def test_k_above_size_and_empty_index(spark):
    v = index(spark, unit(1))
    q = G.as_queries(v, "article_id")
    assert G.knn_search(q, v, 100).count() == 1
    for options in ({}, {"broadcast_bytes": 0}):
        assert G.knn_search(q, G.index_clear(v), 10, **options).count() == 0


def test_unknown_article_is_an_error(spark):
    with pytest.raises(KeyError):
        G.similar_to(index(spark, unit(3)), 999)
    assert G.similar_to(index(spark, unit(3)), 101, k=5).count() == 2


def test_upsert_keeps_newest_and_rejects_missing(spark):
    old = index(spark, unit(3), first=1)
    rows = [(0, 2, [1.0] * 4), (1, 9, None), (2, 2, [2.0] * 4), (3, None, [1.0] * 4), (4, 7, [3.0] * 4)]
    batch = spark.createDataFrame(rows, "seq bigint, article_id bigint, embedding array<float>")
    new, rejected = G.index_upsert(old, batch)
    live = {r.article_id: (r.position, r.embedding[0]) for r in new.collect()}
    assert {k: v[0] for k, v in live.items()} == {1: 0, 3: 2, 2: 4, 7: 5}
    assert live[2][1] == 2.0 and rejected.count() == 2


def test_removed_vectors_do_not_eat_slots(spark):
    m = unit(20)
    v = index(spark, m)
    gone = spark.createDataFrame([(100 + i,) for i in range(0, 20, 2)], "article_id bigint")
    left = G.index_remove(v, gone)
    assert {r.article_id % 2 for r in G.similar_articles(left, 9).collect()} == {1}
    assert G.similar_articles(left, 9).count() == 90


def test_snapshot_roundtrip(spark, tmp_path):
    v = index(spark, unit(20))
    root = str(tmp_path / "index")
    G.save_index(v, root)
    again = G.load_index(spark, root)
    assert found(G.similar_articles(again, 5)) == found(G.similar_articles(v, 5))
    stats = G.index_stats(again).first()
    assert (stats.total_vectors, stats.dimension, stats.next_position) == (20, 16, 20)


def test_inverted_file_finds_all_when_all_cells_are_probed(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 30)
    m = unit(200)
    m[:80] = m[0] + 0.001 * unit(80, seed=1)  # one crowded cell, cut into several blocks
    v = index(spark, m)
    cells = G.train_cells(v, nlist=5)
    q = G.as_queries(v, "article_id")
    exact = G.knn_search(q, v, 10)
    assert G.ann_recall(G.knn_ivf(q, v, cells, 10, nprobe=5), exact).first().recall == 1.0
    assert G.ann_recall(G.knn_ivf(q, v, cells, 10, nprobe=2), exact).first().recall > 0.6


def crowded(spark):
    m = unit(200)
    m[:80] = m[0] + 0.001 * unit(80, seed=1)
    return m, index(spark, m)


@pytest.mark.parametrize("nprobe,k", [(1, 10), (2, 3), (9, 500)])
def test_exact_search_in_stored_cells(spark, tmp_path, nprobe, k):
    _, v = crowded(spark)
    I.build_ivf(v.unionByName(spark.createDataFrame([(5, 900, None)], v.schema)), str(tmp_path / "ivf"), 9)
    stored = I.read_ivf(spark, str(tmp_path / "ivf"))
    q = G.as_queries(v, "article_id")
    got, want = I.search_ivf_exact(stored, q, k, nprobe), G.knn_search(q, v, k)
    key = lambda df: sorted((r.query_id, r.rank, r.article_id, round(r.dist, 5)) for r in df.collect())
    assert key(got) == key(want)


def test_probes_prune_folders_and_reach_the_recall(spark, tmp_path):
    _, v = crowded(spark)
    I.build_ivf(v, str(tmp_path / "ivf"), 9)
    stored = I.read_ivf(spark, str(tmp_path / "ivf"))
    q = G.as_queries(v, "article_id")
    n = I.choose_nprobe(stored, q, 10, 0.95)
    exact = G.knn_search(q, v, 10)
    assert 1 <= n <= 9 and G.ann_recall(I.search_ivf(stored, q, 10, n), exact).first().recall >= 0.95
    assert n == 1 or G.ann_recall(I.search_ivf(stored, q, 10, n - 1), exact).first().recall < 0.95
    one = I.search_ivf(stored, q.limit(1), 3, 1)
    assert "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().toString() and one.count() == 3
    assert spark.range(1).select(I.recall_reached(exact, exact, 0.9)).first()[0]


def test_an_update_writes_touched_cells_only(spark, tmp_path):
    m, v = crowded(spark)
    path = tmp_path / "ivf"
    I.build_ivf(v, str(path), 9)
    stored = I.read_ivf(spark, str(path))
    first = v.select("article_id").first().article_id
    alone = stored.rows().groupBy("cell").count().orderBy("count").first()
    lost = [r.article_id for r in stored.rows().where(F.col("cell") == alone["cell"]).collect()]
    moved = [first + 150, first + 151]
    untouched = {f for f in path.glob("cells/cell=*/*.parquet")}
    changed = spark.createDataFrame([(moved[0], 7, [2.0] * 16), (9_999, 8, [-2.0] * 16), (lost[0], 9, [1.0] * 16)], "article_id bigint, position bigint, embedding array<float>")
    gone = spark.createDataFrame([(a,) for a in [*lost, moved[1]]], "article_id bigint")
    for _ in range(2):  # running it again leaves the same
        I.update_ivf(stored, changed, gone)
        rows = {r.article_id: r.embedding for r in stored.rows().collect()}
        assert len(rows) == stored.rows().count() == 200 - len(lost) - (moved[1] not in lost) + 1
        assert rows[9_999] == [-2.0] * 16 and lost[0] not in rows and moved[1] not in rows
    assert untouched & {f for f in path.glob("cells/cell=*/*.parquet")}
    live = stored.rows()
    q = G.as_queries(live, "article_id")
    key = lambda df: sorted((r.query_id, r.rank, r.article_id) for r in df.collect())
    assert key(I.search_ivf_exact(stored, q, 4)) == key(G.knn_search(q, live.select("article_id", "position", "embedding"), 4))


def test_blocks_without_a_cross_join(spark):
    """Neither the scan nor the grid plans one, with broadcasting off as well."""
    rng = np.random.default_rng(3)
    rows = [(i, i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(40, 4)))]
    v = spark.createDataFrame(rows, "article_id bigint, position bigint, embedding array<float>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [
            G.knn_search(G.as_queries(v, "article_id"), v, 3, **options) for options in ({}, {"broadcast_bytes": 0})
        ]
        texts = [p._jdf.queryExecution().toString() for p in plans]
        assert not any("Cartesian" in t or "NestedLoop" in t for t in texts)
        assert sorted(plans[0].collect()) == sorted(plans[1].collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_too_few_vectors_for_the_cells(spark):
    v = spark.createDataFrame([(1, 0, [1.0])], "article_id bigint, position bigint, embedding array<float>")
    with pytest.raises(ValueError):
        G.train_cells(v, nlist=2)
