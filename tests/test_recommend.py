from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.functions import cooccurrence, feedblocks
from newsloom.functions.feedblocks import score_feeds
from newsloom.operators import recommend as H
from newsloom.plans import recommend as P

RND = np.random.default_rng(11)
N_USERS, N_ARTICLES, DIM = 13, 90, 8
PROFILES, VECTORS = RND.normal(size=(N_USERS, DIM)), RND.normal(size=(N_ARTICLES, DIM))
X, Y = RND.normal(size=(N_USERS, 5)), RND.normal(size=(N_ARTICLES, 5))
PREFS = RND.random((N_USERS, 4))
TOPIC = RND.integers(0, 5, N_ARTICLES)  # 4 stands for an unknown topic
POP = np.round(RND.random(N_ARTICLES), 6)
SEEN = {(u, a) for u in range(N_USERS) for a in range(N_ARTICLES) if u != 3 and RND.random() < (0.9 if u == 0 else 0.1)}
NO_PROFILE, NO_FACTOR, NO_ITEM = {2}, {5}, set(range(0, 90, 7))


def frames(spark):
    users = [
        (u, None if u in NO_PROFILE else PROFILES[u].tolist(), None if u in NO_FACTOR else X[u].tolist(),
         [None if (u + t) % 5 == 0 else float(PREFS[u, t]) for t in range(4)], list(H.WEIGHTS))
        for u in range(N_USERS)
    ]
    items = [
        (a, VECTORS[a].tolist(), None if a in NO_ITEM else Y[a].tolist(), int(TOPIC[a]), float(POP[a])) for a in range(N_ARTICLES)
    ]
    arr = "array<double>"
    return (
        spark.createDataFrame(users, f"user_id bigint, profile {arr}, factor {arr}, prefs {arr}, weights {arr}"),
        spark.createDataFrame(items, f"article_id bigint, vector {arr}, factor {arr}, topic_index int, popularity double"),
        spark.createDataFrame(sorted(SEEN), "user_id bigint, article_id bigint"),
    )


def brute(n, per_topic):
    def scale(values):
        there = [v for v in values.values() if v is not None]
        if not there:
            return {a: 0.0 for a in values}
        lo, hi = min(there), max(there)
        return {a: 0.0 if v is None else 1.0 if hi == lo else (v - lo) / (hi - lo) for a, v in values.items()}

    out = {}
    for u in range(N_USERS):
        open_ = [a for a in range(N_ARTICLES) if (u, a) not in SEEN]
        cos = lambda a: round(float(PROFILES[u] @ VECTORS[a] / np.linalg.norm(PROFILES[u]) / np.linalg.norm(VECTORS[a])), 6)
        c = scale({a: None if u in NO_PROFILE else cos(a) for a in open_})
        k = scale({a: None if u in NO_FACTOR or a in NO_ITEM else round(float(X[u] @ Y[a]), 6) for a in open_})
        t = scale({a: None if TOPIC[a] == 4 or (u + TOPIC[a]) % 5 == 0 else round(float(PREFS[u, TOPIC[a]]), 6) for a in open_})
        w = H.WEIGHTS
        score = {a: round(w[0] * c[a] + w[1] * k[a] + w[2] * t[a] + w[3] * POP[a], 6) for a in open_}
        order = sorted(open_, key=lambda a: (-score[a], a))
        must = [a for topic in range(4) for a in [x for x in order if TOPIC[x] == topic][:per_topic]]
        rest = [a for a in order if a not in must]
        picked = (sorted(must, key=lambda a: (-score[a], a)) + rest)[:n] if per_topic else order[:n]
        out[u] = [(a, score[a]) for a in sorted(picked, key=lambda a: (-score[a], a))]
    return out


@pytest.mark.parametrize("options", [{}, {"article_block": 20, "user_block": 4}])
@pytest.mark.parametrize("per_topic", [0, 2])
def test_block_scores_equal_brute_force(spark, options, per_topic):
    scored = score_feeds(*frames(spark), 10, per_topic, **options)
    feed = H.diversify(scored, 10, per_topic) if per_topic else H.top_n(scored, 10)
    got = {}
    for r in feed.orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append((r.article_id, r.score))
    want = brute(10, per_topic)
    assert {u: [a for a, _ in v] for u, v in got.items()} == {u: [a for a, _ in v] for u, v in want.items() if v}
    for u, rows in got.items():
        assert np.allclose([s for _, s in rows], [s for _, s in want[u]], atol=2e-6)


def test_the_grid_sends_each_side_a_bounded_number_of_times():
    """Blocks of a fixed small size would send 90,000 users 547 times and 82,000 articles 1,800 times."""
    for articles, users in ((8_200, 9_000), (82_000, 90_000), (492_000, 540_000)):
        a, u = feedblocks.grid_blocks(articles, users, 64, 150, 50)
        assert articles <= a * feedblocks.ARTICLE_BLOCK and users <= u * feedblocks.USER_BLOCK_MOST
        assert a <= 8 and u <= 9 and a * u >= feedblocks.GRID_BLOCKS
    assert feedblocks.grid_blocks(90, 13, 8, 20, 4) == (5, 4) and feedblocks.grid_blocks(1, 0, 0, 150, 50) == (1, 1)


@pytest.mark.parametrize("per_topic", [0, 2])
def test_tiles_of_any_size_give_the_same_rows(monkeypatch, per_topic):
    """Equal scores, articles without popularity, vectors with holes and values of pairs; pairs are also scored before the end."""
    rng = np.random.default_rng(8)
    n, m, arr = 9, 120, pa.list_(pa.float64())
    vectors = np.repeat(rng.normal(size=(m // 4, 6)), 4, axis=0).tolist()
    vectors[7][2], vectors[8] = float("nan"), None
    articles = pa.table({
        "article_id": rng.permutation(m), "vector": pa.array(vectors, arr), "factor": pa.array([[] if i % 3 else None for i in range(m)], arr),
        "topic_index": rng.integers(0, 5, m), "popularity": np.where(np.arange(m) == 5, np.nan, np.repeat(np.round(rng.random(m // 4), 6), 4)),
    })
    near = [[{"article_id": int(a), "collab": round(float(a) / 7, 6)} for a in rng.choice(m, 20, False)] if u % 4 else None for u in range(n)]
    users = pa.table({
        "user_id": np.arange(n), "profile": pa.array([None if u == 2 else rng.normal(size=6).tolist() for u in range(n)], arr),
        "factor": pa.array([None if u == 5 else [] for u in range(n)], arr),
        "prefs": pa.array([None if u == 3 else [None, *rng.random(3).tolist()] for u in range(n)], arr),
        "weights": pa.array([list(H.WEIGHTS)] * n, arr),
        "seen": pa.array([rng.choice(m, 117 if u == 0 else 9, False).tolist() for u in range(n)], pa.list_(pa.int64())),
        "near": pa.array(near, pa.list_(pa.struct({"article_id": pa.int64(), "collab": pa.float64()}))),
    })
    run = lambda: feedblocks._score(users, feedblocks.Candidates(articles), 10, per_topic, False).sort_by(
        [("user_id", "ascending"), ("article_id", "ascending")]
    ).to_pylist()
    whole = run()
    for name, value in (("USERS_AT_ONCE", 2), ("ARTICLES_AT_ONCE", 7), ("PAIRS_HELD", 30)):
        monkeypatch.setattr(feedblocks, name, value)
    assert run() == whole and len({r["user_id"] for r in whole}) == n
    # No chunk of pairs is larger than a tile, whatever the number of candidates.
    assert max(end - first for first, end, _ in feedblocks.Candidates(articles).tiles) <= 7


def test_als_is_repeatable_and_leaves_out_read_articles(spark, small):
    i, a, v = P.inputs(spark, small)
    c = H.candidate_articles(a, v)
    one, two = (H.als_scores(i, c, 10, iterations=3).orderBy("user_id", "rank").collect() for _ in range(2))
    assert one and one == two
    assert H.exclude_read(spark.createDataFrame(one), i).count() == len(one)


def test_folding_in_is_one_half_step_for_ids_of_any_size(spark):
    rng = np.random.default_rng(2)
    rows = sorted({(int(u) * 2**33 - 5, int(a) * 2**40, int(u + a) % 3 + 1) for u, a in zip(rng.integers(0, 30, 300), rng.integers(0, 20, 300))})
    m = spark.createDataFrame([*rows, (None, 1, 1), (1, None, 1)], "user_id bigint, article_id bigint, clicks bigint")
    users, articles = H.als_factors(m, rank=4, iterations=3)
    users, articles = users.cache(), articles.cache()
    want = {r.user_id: np.array(r.factor) for r in users.collect()}
    assert set(want) == {u for u, _, _ in rows} and {r.article_id for r in articles.collect()} == {a for _, a, _ in rows}
    got = {r.user_id: np.array(r.factor) for r in H.fold_in_users(m, articles).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[u], want[u], atol=1e-3) for u in want)
    # By hand for one user.
    y = {r.article_id: np.array(r.factor) for r in articles.collect()}
    one = rows[0][0]
    mine = [(y[a], n) for u, a, n in rows if u == one]
    left = sum(np.outer(v, v) for v in y.values()) + sum(10.0 * n * np.outer(v, v) for v, n in mine) + 0.05 * len(mine) * np.eye(4)
    assert np.allclose(got[one], np.linalg.solve(left, sum((1 + 10.0 * n) * v for v, n in mine)), atol=1e-6)
    new = spark.createDataFrame([(7, rows[0][1], 2), (8, 3, 1)], m.schema)  # user 8 clicked an article without a factor
    assert [r.user_id for r in H.fold_in_users(new, articles).collect()] == [7]
    assert H.fold_in_users(m, articles.where("false")).count() == 0


def test_sketch_tracks_co_click_cosine(spark):
    clicks = [(u, a, 1) for u in range(60) for a in range(4) if (u // 30 == a // 2) or u % 29 == 0]
    m = spark.createDataFrame(clicks, "user_id bigint, article_id bigint, clicks bigint")
    _, items = H.sketch_factors(m)
    y = {r.article_id: np.array(r.factor) for r in items.collect()}
    assert y[0] @ y[1] > 0.8 > 0.4 > y[0] @ y[2]


def clicks_with_hot_keys():
    """User 0 clicks everything and everyone clicks article 0; the rest is random, with some nulls and lone clicks."""
    rng = np.random.default_rng(5)
    pairs = {(0, a) for a in range(60)} | {(u, 0) for u in range(80)}
    pairs |= {(int(u), int(a)) for u, a in zip(rng.integers(1, 80, 400), rng.zipf(1.4, 400) % 60)} | {(500, 500), (2**40, 2**41), (2**40, 3)}
    return sorted(pairs)


@pytest.mark.parametrize("options", [{}, {"cell_entries": 40, "segment": 7}])
def test_item_neighbours_equal_brute_force(spark, monkeypatch, options):
    monkeypatch.setattr(cooccurrence, "PAIRS_AT_ONCE", 50)
    pairs = clicks_with_hot_keys()
    users = {}
    for u, a in pairs:
        users.setdefault(a, set()).add(u)
    rows = [(u, a, 1) for u, a in pairs] + [(None, 3, 1), (4, None, 2)]
    m = spark.createDataFrame(rows, "user_id bigint, article_id bigint, clicks bigint").repartition(3)
    want = set()
    for a, x in users.items():
        found = [(-round(len(x & y) / (len(x) * len(y)) ** 0.5, 6), b, len(x & y)) for b, y in users.items() if b != a and x & y]
        want |= {(a, b, n, -c, rank) for rank, (c, b, n) in enumerate(sorted(found)[:5], 1)}
    got = H.item_neighbours(m, 5, **options)
    assert {tuple(r) for r in got.collect()} == want
    near, value = {(a, b): c for a, b, _, c, _ in want}, {}
    for u, a in pairs:
        value[u, a] = value.get((u, a), 0) + 1
        for (x, b), c in near.items():
            if x == a:
                value[u, b] = value.get((u, b), 0) + c
    got = {(r.user_id, r.article_id): r.collab for r in H.neighbour_scores(m, got).collect()}
    assert got.keys() == value.keys() and all(abs(got[k] - v) < 2e-6 for k, v in value.items())
    assert H.item_neighbours(m.where("false"), 5).count() == 0


@pytest.mark.parametrize("options", [{}, {"article_block": 20, "user_block": 4}])
def test_values_of_pairs_take_the_place_of_factors(spark, options):
    """A pair without a value is 0 where both sides have clicks, and missing elsewhere."""
    none = F.array().cast("array<double>")
    users, candidates, seen = frames(spark)
    users = users.withColumn("factor", F.when(F.col("user_id") % 3 > 0, none))
    candidates = candidates.withColumn("factor", F.when(F.col("article_id") % 5 > 0, none))
    near = users.select("user_id").crossJoin(candidates.select("article_id")).where("(user_id * 7 + article_id) % 4 = 0").withColumn(
        "collab", ((F.col("user_id") * 31 + F.col("article_id") * 17) % 11).cast("double")
    )
    dense = {(r.user_id, r.article_id): r.collab for r in near.collect()}
    scored = score_feeds(users, candidates, seen, 60, near=near, **options).collect()
    by_user = {}
    for r in scored:
        clicked = r.user_id % 3 > 0 and r.article_id % 5 > 0
        by_user.setdefault(r.user_id, []).append((dense.get((r.user_id, r.article_id), 0.0) if clicked else None, r.collab))
    assert by_user
    for rows in by_user.values():
        raw = [x for x, _ in rows if x is not None]
        low, high = min(raw, default=0.0), max(raw, default=0.0)
        for x, scaled in rows:
            assert abs(scaled - (0.0 if x is None else 1.0 if high == low else (x - low) / (high - low))) < 2e-6


def test_cache_returns_newest_valid_generation(spark):
    t = dt.datetime(2024, 1, 1, 12)
    feeds = spark.createDataFrame([(1, 5), (2, 6)], "user_id bigint, article_id bigint")
    at = lambda m: F.lit(t + dt.timedelta(minutes=m)).cast("timestamp_ntz")
    cache = H.cached_feed(feeds, at(0)).unionByName(H.cached_feed(feeds.where("user_id = 1").withColumn("article_id", F.lit(7)), at(10)))
    read = lambda m: {(r.user_id, r.article_id) for r in H.read_cached(cache, at(m)).collect()}
    assert read(5) == {(1, 5), (2, 6)} and read(15) == {(1, 7), (2, 6)}
    assert read(30) == {(1, 7)} and read(40) == set()
