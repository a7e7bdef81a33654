from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions import keyword_index as K
from newsloom.operators import retrieve as R
from newsloom.sources import tables as S


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, queries, k):
    bags = {a: Counter(words(t)) for a, t in docs.items()}
    df = Counter(w for bag in bags.values() for w in bag)
    n = len(bags)
    avgdl = sum(sum(b.values()) for b in bags.values()) / max(n, 1)
    out = []
    for q, text in queries.items():
        scores = {}
        for a, bag in bags.items():
            dl = sum(bag.values())
            s = sum(
                math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * dl / avgdl))
                for w in set(words(text)) if bag[w]
            )
            if s:
                scores[a] = round(s, 6)
        out += [(q, a, s, i) for i, (a, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return out


def corpus(n):
    """Zipf-distributed words, copies (ties), and texts without words."""
    rng = np.random.default_rng(4)
    docs = {int(i) * 7 - 50: " ".join(f"w{v}" for v in rng.zipf(1.3, rng.integers(1, 60)) % 500) for i in range(n)}
    some = sorted(docs)
    docs |= {some[-1] + 1 + i: docs[some[i % 5]] for i in range(12)}
    docs |= {10**12: None, 10**12 + 1: "", 10**12 + 2: " .. "}
    queries = {i: " ".join(docs[some[i]].split()[:9]) + " W1 w2 unheard" for i in range(0, 30)}
    return docs, queries | {90: "unheard", 91: "", 92: None, 93: "w1"}


def build(spark, docs, path):
    table = spark.createDataFrame(list(docs.items()), "article_id bigint, content string").repartition(5)
    R.build_index(table, path)


@pytest.mark.parametrize("ranges,k", [(32, 20), (3, 4), (1, 1), (32, 1000)])
def test_search_equals_scoring_every_document(spark, monkeypatch, tmp_path, ranges, k):
    monkeypatch.setattr(K, "RANGE_DOCS", ranges)
    docs, queries = corpus(300)
    build(spark, docs, str(tmp_path / "i"))
    asked = spark.createDataFrame(list(queries.items()), "query_id bigint, text string")
    got = [tuple(r) for r in R.indexed_topk(asked, str(tmp_path / "i"), k).orderBy("query_id", "rank").collect()]
    want = brute(docs, queries, k)
    assert [(q, a, r) for q, a, _, r in got] == [(q, a, r) for q, a, _, r in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)


def test_ranges_that_cannot_reach_the_best_are_not_read(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(K, "RANGE_DOCS", 4)
    docs = {i: f"common filler{i % 50} " * 3 for i in range(2_000)} | {i: f"common needle{i}" for i in range(2_000, 2_004)}
    build(spark, docs, str(tmp_path / "i"))
    index = K.read_keyword_index(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "needle2001 common")], "query_id bigint, text string")
    read = []
    score = K._score_ranges
    monkeypatch.setattr(K, "_score_ranges", lambda i, a, ranges, k: read.append(ranges.count()) or score(i, a, ranges, k))
    top = K.search_keyword_index(index, asked, 1, S.materialize).collect()
    assert [r.article_id for r in top] == [2001] and sum(read) <= 0.05 * index.blocks.select("range").distinct().count()


def test_no_documents_or_queries(spark, tmp_path):
    build(spark, {}, str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, "a")], "query_id bigint, text string")
    assert R.indexed_topk(asked, str(tmp_path / "none")).count() == 0
    build(spark, {1: "a"}, str(tmp_path / "one"))
    assert [tuple(r) for r in R.indexed_topk(asked, str(tmp_path / "one")).collect()] == [(1, 1, round(math.log(1 + 0.5 / 1.5), 6), 1)]
    assert R.indexed_topk(asked.where("false"), str(tmp_path / "one")).count() == 0


def test_a_bucket_is_pruned_by_its_folder(spark, tmp_path):
    docs, _ = corpus(60)
    build(spark, docs, str(tmp_path / "i"))
    one = K.read_keyword_index(spark, str(tmp_path / "i")).postings.where(F.col("bucket") == 3)
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()


def test_stored_once_follows_the_files(spark, tmp_path):
    folder, built = str(tmp_path), []
    table = lambda n: spark.range(n).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    make = lambda path: built.append(path) or spark.range(1).write.parquet(path)
    table(3)
    first = S.stored_once(spark, folder, ["t"], "thing", make)
    assert S.stored_once(spark, folder, ["t"], "thing", make) == first and len(built) == 1
    table(4)
    assert S.stored_once(spark, folder, ["t"], "thing", make) != first and len(built) == 2
    with pytest.raises(ZeroDivisionError):
        S.stored_once(spark, folder, ["t"], "other", lambda path: 1 / 0)
    assert S.stored_once(spark, folder, ["t"], "other", make) and len(built) == 3


@pytest.mark.parametrize("name,value", [("SHARED_PAIRS", 40), ("GROUP_RANGES", 2), ("GROUP_WORDS", 50), ("RANGE_DOCS", 400)])
def test_parts_of_any_size_give_the_same(spark, monkeypatch, tmp_path, name, value):
    monkeypatch.setattr(K, name, value, raising=False)
    docs, queries = corpus(300)
    build(spark, docs, str(tmp_path / "i"))
    asked = spark.createDataFrame(list(queries.items()), "query_id bigint, text string")
    got = [tuple(r) for r in R.indexed_topk(asked, str(tmp_path / "i"), 5).orderBy("query_id", "rank").collect()]
    want = brute(docs, queries, 5)
    assert [(q, a, r) for q, a, _, r in got] == [(q, a, r) for q, a, _, r in want]


@pytest.mark.parametrize("at_once", [1, 40, 1 << 21])
def test_values_are_added_up_for_any_number_of_queries_at_once(monkeypatch, at_once):
    monkeypatch.setattr(K, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    weights = np.where(rng.random((9, 12)) < 0.4, rng.random((9, 12)), 0.0)
    weights[4] = 0
    weights[4, 11] = 1
    query, word = np.nonzero(weights)
    asked = K.Asked(query * 10, word, weights[query, word])
    values = np.where(rng.random((12, 7)) < 0.5, rng.random((12, 7)), 0.0)
    values[11] = 0
    rows, cells = np.nonzero(values)
    found, sizes = np.unique(rows, return_counts=True)
    places = np.searchsorted(asked.words, found)
    some = np.array([0, 2, 4, 8])
    parts = list(K._add_up(asked, some, places, sizes, cells, values[rows, cells], 7))
    assert (len(parts) == len(some)) == (at_once == 1) and np.concatenate([p[0] for p in parts]).tolist() == some.tolist()
    assert np.allclose(np.concatenate([p[1] for p in parts]), weights[some] @ values)


def test_a_search_moves_neither_postings_nor_bounds(spark, monkeypatch, tmp_path):
    """What a search stores and shuffles are the queries' words and the best of each task, not rows per query and range."""
    monkeypatch.setattr(K, "RANGE_DOCS", 2)
    docs, queries = corpus(600)
    build(spark, docs, str(tmp_path / "i"))
    index = K.read_keyword_index(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame(list(queries.items()), "query_id bigint, text string")
    plans, rows = [], {}

    def store(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        stored = S.materialize(df, label)
        rows[label] = stored.count()
        return stored

    found = K.search_keyword_index(index, asked, 2, store)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    pairs = sum(len(set(words(t))) for t in queries.values())
    tasks = index.postings.rdd.getNumPartitions()
    assert max(rows.values()) <= max(pairs, 2 * tasks * len(queries)) < len(queries) * index.blocks.select("range").distinct().count() / 4
    assert not [p for p in plans if re.search("Join|Repartition", p)]


def test_the_index_is_smaller_than_its_texts(spark, tmp_path):
    rng = np.random.default_rng(7)
    names = np.array([f"{int(i):x}word" for i in rng.integers(1 << 20, 1 << 24, 5_000)])
    docs = {i: " ".join(names[rng.zipf(1.2, 200) % 5_000]) for i in range(2_000)}
    build(spark, docs, str(tmp_path / "i"))
    size = sum(p.stat().st_size for p in (tmp_path / "i").rglob("*.parquet"))
    assert size < 0.18 * sum(map(len, docs.values()))


def test_blocks_hold_the_largest_impact_of_a_range(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(K, "RANGE_DOCS", 3)
    docs, _ = corpus(40)
    table = spark.createDataFrame(list(docs.items()), "article_id bigint, content string").coalesce(1).sortWithinPartitions("article_id")
    R.build_index(table, str(tmp_path / "i"))
    lengths = {a: len(words(t)) for a, t in docs.items()}
    avgdl = sum(lengths.values()) / len(docs)
    want = {}
    for i, a in enumerate(sorted(docs)):
        for w, n in Counter(words(docs[a])).items():
            df, best = want.get((w, i // 3), (0, 0.0))
            want[w, i // 3] = df + 1, max(best, n * 2.2 / (n + 1.2 * (0.25 + 0.75 * lengths[a] / avgdl)))
    hashed = spark.createDataFrame([(w,) for w in sorted({w for w, _ in want})], "w string").select("w", F.xxhash64("w").alias("word"))
    got = K.read_keyword_index(spark, str(tmp_path / "i")).blocks.join(hashed, "word").collect()
    assert {(r.w, r.range): r.df for r in got} == {k: v[0] for k, v in want.items()}
    assert all(abs(r.best - want[r.w, r.range][1]) < 1e-9 for r in got)


def test_scores_of_documents_that_share_an_id_are_added_up_wherever_they_lie(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(K, "RANGE_DOCS", 2)
    docs = [(i, f"w{i % 7} common") for i in range(40)]
    table = lambda rows: spark.createDataFrame(rows, "article_id bigint, content string").repartition(4)
    # Five copies of one document with an id each, or with one id.
    R.build_index(table(docs + [(100 + i, "needle common") for i in range(5)]), str(tmp_path / "apart"))
    R.build_index(table(docs + [(100, "needle common")] * 5 + [(None, "needle")]), str(tmp_path / "one"))
    asked = spark.createDataFrame([(1, "needle"), (None, "needle")], "query_id bigint, text string")
    apart = R.indexed_topk(asked, str(tmp_path / "apart")).collect()
    one = R.indexed_topk(asked, str(tmp_path / "one")).collect()
    assert len(apart) == 5 and [(r.query_id, r.article_id, r.rank) for r in one] == [(1, 100, 1)]
    assert abs(one[0].score - sum(r.score for r in apart)) < 1e-5


def test_a_score_may_be_rounded_to_zero(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(K, "PLACES", 1)
    build(spark, {i: "common" for i in range(30)}, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "common")], "query_id bigint, text string")
    got = R.indexed_topk(asked, str(tmp_path / "i"), 3).orderBy("rank").collect()
    assert [(r.article_id, r.score) for r in got] == [(0, 0.0), (1, 0.0), (2, 0.0)]
