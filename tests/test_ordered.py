from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions import ordered as O, scale
from newsloom.functions.ttlcache import cache_hits
from newsloom.operators import metrics as K

T0 = dt.datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(u, a, T0 + dt.timedelta(seconds=s)) for u, a, s in rows], "user_id bigint, article_id bigint, ts timestamp_ntz")


def test_sessions_equal_a_walk_over_each_user(spark):
    rnd = random.Random(1)
    rows = [(1 if rnd.random() < 0.5 else rnd.randint(2, 4), rnd.randint(1, 5), rnd.randint(0, 60) * 600) for _ in range(300)]
    rows += [(9, 1, 0), (9, 2, 1799), (9, 1, 1799 + 1800), (9, 1, 10_000)]  # just inside, just at the gap
    want = {}
    for user in {r[0] for r in rows}:
        number, last = 0, None
        for _, a, s in sorted((r for r in rows if r[0] == user), key=lambda r: r[2]):
            number += last is None or s - last >= 1800
            last = s
            x = want.setdefault((user, number), [s, s, 0, set()])
            x[1], x[2] = s, x[2] + 1
            x[3].add(a)
    got = {
        (r.user_id, r.session_no): (r.seconds, r.events, r.articles) for r in K.user_sessions(log(spark, rows)).collect()
    }
    assert got == {k: (float(v[1] - v[0]), v[2], len(v[3])) for k, v in want.items()}


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_sums_and_neighbours_across_blocks(spark, block):
    rows = [(k, i, float(i * i)) for k in (1, 2) for i in range(11)]
    df = spark.createDataFrame(rows, "k int, i bigint, v double")
    sums = O.sum_before(df, ["k"], "i", "v", "s", block=block)
    assert all(r.s == sum(j * j for j in range(r.i)) for r in sums.collect())
    near = O.last_before(df, ["k"], "i", F.col("i"), 3, "n", block=max(block, 4)).collect()
    assert len(near) == 22 and all(r.n == list(range(max(0, r.i - 3), r.i)) for r in near)


def test_quantiles_are_exact_with_a_hot_value(spark):
    rnd = np.random.default_rng(3)
    values = np.r_[rnd.gamma(2, 30, 400), np.full(200, 17.5), [-3.25]]
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 5.0), ("b", None)], "g string, v double")
    got = {(r.g, r.quantile): r.value for r in O.exact_quantiles(df, "g", "v", {"p0": 0, "p50": 0.5, "p95": 0.95, "p1": 1}).collect()}
    for name, p in {"p0": 0, "p50": 0.5, "p95": 0.95, "p1": 1}.items():
        assert abs(got["a", name] - np.quantile(values, p)) < 1e-5 and got["b", name] == 5.0


def test_dense_positions_have_no_gaps(spark):
    ids = random.Random(5).sample(range(100_000), 500)
    df = spark.createDataFrame([(i,) for i in ids], "i bigint").repartition(7)
    got = {r.i: r.p for r in scale.dense_positions(df, "i", "p").collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids))}


def test_dense_positions_of_sparse_ids(spark):
    rnd = random.Random(6)
    ids = [rnd.getrandbits(63) - (1 << 62) for _ in range(400)] + [0, 1, 2]
    df = spark.createDataFrame([(i,) for i in ids], "i bigint").repartition(5)
    got = {r.i: r.p for r in scale.dense_positions(df, "i", "p").collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids))}


@pytest.mark.parametrize("unit", [1e-6, 1.0, 1e9])
def test_quantiles_at_any_scale(spark, unit):
    values = np.random.default_rng(4).lognormal(0, 3, 300) * unit * np.array([1, -1, 1] * 100)
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, v double")
    got = {r.quantile: r.value for r in O.exact_quantiles(df, "g", "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    for name, p in {"p10": 0.1, "p50": 0.5, "p99": 0.99}.items():
        assert abs(got[name] - np.quantile(values, p)) < 1e-6 + 1e-12 * unit * 1e6


@pytest.mark.parametrize("block", [4, 1000])
def test_neighbours_with_gaps(spark, block):
    places = {1: [0, 5000, 5001], 2: [-7, 3, 4, 9, 10_000, 10_001, 20_000]}
    df = spark.createDataFrame([(k, i) for k, v in places.items() for i in v], "k int, i bigint")
    got = {(r.k, r.i): r.n for r in O.last_before(df, ["k"], "i", F.col("i"), 3, "n", block=block).collect()}
    assert got == {(k, i): v[max(0, n - 3) : n] for k, v in places.items() for n, i in enumerate(v)}


def walk_cache(times, ttl):
    misses, until = 0, None
    for t in sorted(times):
        if until is None or t >= until:
            misses, until = misses + 1, t + ttl
    return misses


@pytest.mark.parametrize("seed", range(3))
def test_cache_replay_equals_a_walk_with_a_hot_key(spark, seed):
    rnd = random.Random(seed)
    rows = [("hot", rnd.randint(0, 86400 * 4)) for _ in range(3000)]
    rows += [(rnd.choice("abcdef"), rnd.randint(0, 86400 * 6)) for _ in range(400)]
    rows += [("edge", s) for s in (0, 3599, 3600, 86399, 86400 + 3598, 86400 + 3599, 86400 * 3)]
    df = spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s)) for k, s in rows], "key string, ts timestamp_ntz")
    got = {r.key: (r.requests, r.misses) for r in cache_hits(df, "key", "ts").collect()}
    times = {k: [s for q, s in rows if q == k] for k in {r[0] for r in rows}}
    assert got == {k: (len(v), walk_cache(v, 3600)) for k, v in times.items()}


def test_exposure_gini_against_the_definition(spark):
    counts = [1, 1, 2, 5, 5, 9]
    feeds = spark.createDataFrame([(u, a) for a, n in enumerate(counts) for u in range(n)], "user_id bigint, article_id bigint")
    x = np.array(counts, float)
    want = np.abs(x[:, None] - x[None, :]).sum() / (2 * len(x) ** 2 * x.mean())
    assert abs(K.exposure_gini(feeds).first().gini - want) < 1e-6


def test_retention_counts_days_one_to_seven(spark):
    day = 86400
    rows = [(1, 1, 0), (1, 1, day * 7), (2, 1, 0), (2, 1, day * 8), (3, 1, 10), (3, 1, 20)]
    r = K.retention(log(spark, rows)).first()
    assert (r.users, r.returned, r.retention) == (3, 1, 0.333333)


@pytest.mark.parametrize("k", [8, 800])
def test_bracketed_quantiles_equal_numpy(spark, monkeypatch, k):
    """Heavy ties, negative and huge values, nulls, tiny groups; a poor sketch misses brackets, which are then done anew."""
    rng = np.random.default_rng(6)
    groups = {
        "a": rng.normal(size=3_000), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([7.5]), "two": np.array([1.0, 2.0]),
        "wide": rng.pareto(0.5, 2_000) * 1e6 - 1e5,
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    if k == 8:
        monkeypatch.setattr(O, "REACH", 0.0005)
    sketches = df.groupBy("g").agg(F.count("v").alias("_n"), F.kll_sketch_agg_double("v", k).alias("_sketch"))
    probs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p1": 1.0}
    got = {(r.g, r.quantile): r.value for r in O.bracketed_quantiles(df, sketches, "g", "v", probs).collect()}
    assert got.keys() == {(g, n) for g in groups for n in probs}
    for g, values in groups.items():
        for name, p in probs.items():
            want = np.quantile(values, p)
            assert abs(got[g, name] - want) <= 1e-6 * max(1, abs(want)), (g, name)
