from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from newsloom.functions import keywords as KW
from newsloom.operators import chat as J, retrieve as R
from newsloom.sources import views as V

WORDS = [f"w{i}" for i in range(40)]


def corpus(seed=2):
    rnd = random.Random(seed)
    docs = [(i, " ".join(["the"] * rnd.randint(0, 5) + rnd.choices(WORDS, k=rnd.randint(1, 30)))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(60)] + [(300, ""), (301, "...")]  # many copies: ties by id
    queries = [(i, " ".join(["the"] + rnd.choices(WORDS, k=4))) for i in range(9)] + [(50, "unheard"), (51, "")]
    return docs, queries


def brute_bm25(docs, queries, k):
    toks = {i: re.findall(r"\w+", t.lower()) for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = set()
    for q, text in queries:
        scores = {}
        for i, t in toks.items():
            s = 0.0
            for w in set(text.split()):
                if w in t:
                    tf = t.count(w)
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    s += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
            if s > 0:
                scores[i] = round(s, 6)
        for rank, (i, _) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, i, rank))
    return out


@pytest.mark.parametrize("shared", [KW.SHARED_WORDS, 0])
def test_bm25_equals_brute_force_in_both_layouts(spark, monkeypatch, shared):
    monkeypatch.setattr(KW, "QUERY_BLOCK", 4)
    monkeypatch.setattr(KW, "DOC_BLOCK", 50)
    docs, queries = corpus()
    d = spark.createDataFrame(docs, "article_id bigint, text string")
    q = spark.createDataFrame(queries, "query_id bigint, text string")
    got = {(r.query_id, r.article_id, r.rank) for r in KW.bm25_top_k(d, q, 8, shared_words=shared).collect()}
    assert got == brute_bm25(docs, queries, 8)


def test_citations_outside_the_list_are_invalid(spark):
    answers = spark.createDataFrame([(1, 1, "a [1] b [0][3] [99999999999999999999] [2]"), (1, 3, "none")], "conversation_id bigint, turn bigint, content string")
    ranked = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "conversation_id bigint, article_id bigint, rank int")
    c = R.extract_citations(answers, ranked)
    rows = [(r.article_id, r.valid) for r in c.orderBy("position").collect()]
    assert rows == [(10, True), (None, False), (None, False), (None, False), (20, True)]
    a = R.citation_accuracy(answers, c).first()
    assert (a.answers, a.uncited, a.citations, a.valid, a.accuracy) == (2, 1, 5, 2, 0.4)
    assert {r.article_id: r.answers for r in R.source_usage(c).collect()} == {10: 1, 20: 1}


def test_budget_stops_at_the_first_article_that_does_not_fit(spark):
    text = lambda n: " ".join(["x"] * n)
    articles = spark.createDataFrame([(1, "t", text(99)), (2, "t", text(399)), (3, "t", text(9))], "article_id bigint, title string, content string")
    ranked = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 3)], "conversation_id bigint, article_id bigint, rank int")
    said = [(7, 0, "user", text(10)), (7, 1, "assistant", text(20)), (7, 2, "user", text(5))]
    m = spark.createDataFrame(said, "conversation_id bigint, turn bigint, role string, content string")
    asked = R.history_tokens(m).where("role = 'user'")
    got = R.context_budget(asked, ranked, articles, max_tokens=1000).collect()
    assert {(r.turn, r.article_id, r.used, r.available) for r in got} == {(0, 1, 100, 490), (2, 1, 100, 465)}
    assert {r.article_id for r in R.context_budget(asked, ranked, articles).collect()} == {1, 2, 3}


def test_rerank_default_and_plug_in_scorer(spark):
    found = spark.createDataFrame([(1, 10), (1, 11)], "query_id bigint, article_id bigint")
    q = spark.createDataFrame([(1, "red car red")], "query_id bigint, text string")
    a = spark.createDataFrame([(10, "a red bus"), (11, "car, RED!")], "article_id bigint, content string")
    assert [(r.article_id, r.score) for r in R.rerank_model(found, q, a).orderBy("rank").collect()] == [(11, 1.0), (10, 0.5)]
    longest = R.pair_model(lambda: lambda qs, ts: [float(len(t)) - len(q) for q, t in zip(qs, ts)])
    assert R.rerank_model(found, q, a, 1, longest).first().article_id == 10


def test_filters_keep_users_without_topics(spark):
    found = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10), (2, 11)], "user_id bigint, article_id bigint")
    articles = spark.sql(
        "SELECT * FROM VALUES (10L, 'World', TIMESTAMP_NTZ'2024-01-05'), (11L, 'Sports', TIMESTAMP_NTZ'2024-01-05'), "
        "(12L, 'World', TIMESTAMP_NTZ'2023-01-05') AS t(article_id, topic, published_at)"
    )
    prefs = spark.createDataFrame([(1, "World", 1.0)], "user_id bigint, topic string, pref double")
    gone = spark.createDataFrame([(2, 11)], "user_id bigint, article_id bigint")
    kept = R.retrieval_filters(found, gone, articles, prefs, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert {(r.user_id, r.article_id) for r in kept.collect()} == {(1, 10), (2, 10)}


def test_live_session_boundary_is_exactly_one_hour(spark):
    m = spark.sql(
        "SELECT 1L AS conversation_id, 1L AS user_id, id AS turn, TIMESTAMP_NTZ'2024-01-01 00:30:00' + "
        "make_dt_interval(0, 0, 0, CASE id WHEN 0 THEN 0 WHEN 1 THEN 3599 WHEN 2 THEN 7199 ELSE 10800 END) AS created_at FROM range(4)"
    )
    rows = J.chat_live_sessions(m).orderBy("session_no").collect()
    # Gaps of 3599, 3600 and 3601 seconds.
    assert [r.messages for r in rows] == [2, 1, 1]


def test_article_texts_are_those_of_articles_and_are_not_shuffled(spark, tmp_path):
    d = str(tmp_path)
    docs = [(i, f"text {i}", "en", "s", 6) for i in range(20)] + [(3, "again", "en", "s", 5), (4, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    vectors = lambda ids: spark.createDataFrame([(i, [1.0], 1) for i in ids], "vec_id bigint, embedding array<float>, label int")
    vectors(range(10)).write.parquet(f"{d}/embeddings.parquet")
    plan = V.article_texts(spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    vectors([*range(10), 3, 5, 5, 99, 99, None, None]).write.mode("overwrite").parquet(f"{d}/embeddings.parquet")
    rows = lambda df: sorted((r.article_id, r.content or "") for r in df.select("article_id", "content").collect())
    assert rows(V.article_texts(spark, d)) == rows(V.articles(spark, d)) and len(rows(V.article_texts(spark, d))) == 26


def test_hybrid_joins_only_the_articles_that_were_found(spark):
    found = lambda rows: spark.createDataFrame(rows, "query_id bigint, article_id bigint, score double")
    recency = spark.range(200_000).select(F.col("id").alias("article_id"), (F.col("id") / 1e6).alias("recency")).where("article_id <> 8")
    got = R.hybrid_search(found([(1, 5, 0.5), (1, 6, 0.25)]), found([(1, 6, 3.0), (1, 7, 2.0), (2, 8, 1.0)]), recency.repartition(4))
    assert [tuple(r)[:5] for r in got.orderBy("query_id", "article_id").collect()] == [
        (1, 5, 1.0, 0.0, 5e-6), (1, 6, 0.0, 1.0, 6e-6), (1, 7, 0.0, 0.0, 7e-6), (2, 8, 0.0, 1.0, 0.0)
    ]
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
