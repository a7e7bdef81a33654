from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from newsloom.operators import classify as E, processing as D
from newsloom.plans.classify import labelled
from newsloom.schemas import ARTICLE, TOPICS

TRAIN = [
    (0, "the president and the prime minister signed a peace treaty at the summit"), (0, "voters in the country elect a new parliament"),
    (1, "the team scored a late goal and won the match"), (1, "the player won the tennis final and the cup"),
    (2, "shares fell as the bank reported lower profit"), (2, "the company raised its revenue forecast and stocks rose"),
    (3, "scientists launched a new satellite and computer chip"), (3, "the software update fixes the phone and internet bug"),
]
HELD_OUT = [
    (0, "parliament and the president discuss the treaty"), (0, "the minister of the country at a summit"),
    (1, "a goal won the match for the team"), (1, "the player and the cup final"),
    (2, "the bank reported profit and shares rose"), (2, "stocks fell on company revenue"),
    (3, "a new computer chip and software"), (3, "satellite internet and phone update"),
]


@pytest.fixture(scope="module")
def model(spark):
    return E.train_nb(spark.createDataFrame(TRAIN, "label int, text string"), "text", "label")


def test_labelled_sentences(spark, model):
    df = spark.createDataFrame([(i, y, t) for i, (y, t) in enumerate(HELD_OUT)], "id int, label int, text string")
    got = E.classify_nb(df, "id", "text", model)
    assert got.where("label = topic_id").count() >= 6


def test_edge_cases_keep_every_row(spark, model):
    texts = [None, "", " \t\n", "zzz qqq", "goal"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r for r in E.classify_nb(df, "id", "text", model).collect()}
    assert len(got) == 5
    for i in (0, 1, 2):
        assert (got[i].topic, got[i].confidence, got[i].topic_id) == ("Unknown", 0.0, -1)
    assert (got[3].topic_id, got[3].confidence) == (0, 0.25)  # no known word: equal priors, lowest id
    assert got[4].topic == "Sports"
    assert all(abs(sum(got[i].probs) - 1) < 1e-5 for i in (3, 4))


def test_a_class_without_training_rows_is_never_chosen(spark):
    model = E.train_nb(spark.createDataFrame([r for r in TRAIN if r[0] != 3], "label int, text string"), "text", "label")
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(HELD_OUT)] + [(99, "zzz")], "id int, text string")
    got = {r.id: r for r in E.classify_nb(df, "id", "text", model).collect()}
    assert all(got[i].topic_id == y for i, (y, _) in enumerate(HELD_OUT[:6]))
    assert all(r.topic_id in (0, 1, 2) and r.probs[3] == 0 for r in got.values())


def test_unscorable_text_is_error(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", [float("nan")] * 4)], "id int, text string, probs array<double>")
    assert {(r.topic, r.confidence, r.topic_id) for r in E.with_contract(df, "text").collect()} == {("Error", 0.0, -1)}


def test_plug_in_model_and_failing_model(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "id int, text string")
    good = {r.id: r.topic for r in E.classify_batch(df, "text", lambda: lambda texts: [(2, 0.9) for _ in texts]).collect()}
    assert good == {1: "Business", 2: "Unknown", 3: "Unknown"}

    def load():
        def broken(texts):
            raise RuntimeError("no model")

        return broken

    assert {r.id: r.topic for r in E.classify_batch(df, "text", load).collect()} == {1: "Error", 2: "Unknown", 3: "Unknown"}


def test_score_map_holds_every_label(spark, model):
    df = spark.createDataFrame([(1, "goal match")], "id int, text string")
    scores = E.all_scores_map(E.classify_nb(df, "id", "text", model)).first().all_scores
    assert set(scores) == set(TOPICS.values()) and abs(sum(scores.values()) - 1) < 1e-5


def test_spark_ml_model_holds_out(spark, small):
    docs = labelled(spark, small)
    scored = E.classify_ml(E.train_topic_model(docs.where("split = 'train'"), "text", "label"), docs, "text")
    report = {r.split: r.accuracy for r in E.eval_metrics(scored.withColumnRenamed("topic_id", "predicted")).collect()}
    assert report["test"] >= 0.75
    assert scored.count() == docs.count()


def articles(spark, rows):
    blank = dict.fromkeys(ARTICLE.fieldNames())
    return spark.createDataFrame([tuple({**blank, **r}.values()) for r in rows], ARTICLE)


def test_processing_edges(spark, model):
    base = {"title": "t", "processing_status": "pending"}
    table = articles(
        spark,
        [
            {**base, "article_id": 1, "content": "the team won"}, {**base, "article_id": 2, "content": None},
            {**base, "article_id": 3, "content": " \t"}, {**base, "article_id": 4, "content": "bank profit"},
            {"article_id": 5, "title": "t", "content": "x", "processing_status": "completed", "embedding_id": 7},
        ],
    )
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    done = D.process_batch(table, D.nb_classifier(model), now, limit=None)
    got = {r.article_id: r for r in done.articles.collect()}
    assert len(got) == 5 and not {r.processing_status for r in got.values()} & {"pending", "processing"}
    assert {i: got[i].embedding_id for i in got} == {1: 8, 2: None, 3: None, 4: 9, 5: 7}
    assert (got[2].processing_status, got[2].processing_error, got[2].topic) == ("failed", D.NULL_CONTENT, None)
    assert got[1].topic == "Sports" and got[4].topic == "Business" and got[1].processed_at is not None
    assert {r.article_id: r.position for r in done.vectors.collect()} == {1: 8, 4: 9}
    limited = D.process_batch(table, D.nb_classifier(model), now, limit=1).articles
    assert {r.article_id: r.processing_status for r in limited.collect()} == {
        1: "completed", 2: "pending", 3: "pending", 4: "pending", 5: "completed",
    }
    stats = D.process_result_stats(D.pending_batch(table, None), done.articles).first()
    assert (stats.processed, stats.failed, stats.total, stats.success_rate) == (3, 1, 4, 75.0)
    reset = {r.article_id: r.processing_status for r in D.reset_failed(done.articles).collect()}
    assert reset[2] == "pending" and reset[1] == "completed"
    assert {r.status: r.articles for r in D.processing_stats(table).collect()}["processing"] == 0


def test_words_of_a_large_table_are_counted_in_their_row(spark, model, monkeypatch):
    """The same scores as by a broadcast word table, and no task groups or sorts the words of many texts."""
    texts = [None, "", " \t\n", "goal goal Match zzz the THE the", *(t for _, t in HELD_OUT), "the match " * 3_000]
    df = spark.createDataFrame([*enumerate(texts), (3, "the goal"), (None, "goal")], "id int, text string")
    counted = df.select("text", E.X.counted_tokens(F.col("text")).alias("c"), E.X.tokens(F.col("text")).alias("t")).collect()
    for r in counted:
        assert r.c is None if r.text is None else sorted(map(tuple, r.c)) == sorted((w, r.t.count(w)) for w in set(r.t))
    words = model.words.localCheckpoint()
    key = lambda rows: sorted((str(r.id), str(r.text)[:40], r.scores) for r in rows)
    shared = key(E.nb_scores(df, "id", "text", E.NaiveBayes(words, model.priors, words.count())).collect())
    monkeypatch.setattr(E, "SHARED_WORDS", 0)
    large = E.nb_scores(df, "id", "text", E.NaiveBayes(words, model.priors, words.count()))
    assert key(large.collect()) == shared
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in line and "word#" in line.split("]")[0] for line in plan.splitlines())
    assert "shuffle_hash" in plan


def test_fits_read_counts_and_no_texts(spark, monkeypatch):
    """The split and the fits get hashed counts; the models still take texts, with the accuracies of a search over texts."""
    rows = [(i, *TRAIN[i % len(TRAIN)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, label int, text string").repartition(2, "id")
    read = []
    for kind in (E.TrainValidationSplit, E.Pipeline):
        fit = kind.fit
        monkeypatch.setattr(kind, "fit", lambda self, data, *params, fit=fit: read.append(data.columns) or fit(self, data, *params))
    search = E.TrainValidationSplit(
        estimator=E.topic_pipeline(), estimatorParamMaps=[{}], evaluator=E.MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy"),
        trainRatio=0.8, seed=42,
    )
    whole = search.fit(df).validationMetrics
    read.clear()
    tuned, scores = E.tune_topic_model(df, "text", "label", (1e-3,))
    trained = E.train_topic_model(df, "text", "label")
    assert read and not any("text" in columns or "_words" in columns for columns in read)
    assert [a for _, a in scores] == whole
    for model in (tuned, trained):
        assert len(model.stages) == 4
        assert E.classify_ml(model, df, "text").where("topic_id = label").count() == 80
