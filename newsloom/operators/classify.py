"""Topic classification: training, scoring, evaluation.

Two models share one contract (topic, confidence, topic_id): a relational multinomial naive Bayes,
trained and scored with joins and sums only, and a Spark ML pipeline. Other models plug in through
`classify_batch`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.functions import text as X
from newsloom.functions.scale import r6
from newsloom.schemas import TOPICS
from newsloom.sources.tables import materialize

CLASSES = tuple(sorted(TOPICS))
CLASSIFY_CHARS = 1000
NEVER = -1e9


def classification_text(title: Column, content: Column, chars: int | None = None) -> Column:
    """What the model reads of an article: all of it, or the first `chars` of its content; null when the content is null."""
    return F.concat(title, F.lit("\n"), content if chars is None else F.substring(content, 1, chars))


def topic_name(topic_id: Column) -> Column:
    name = F.when(topic_id == CLASSES[0], TOPICS[CLASSES[0]])
    for c in CLASSES[1:]:
        name = name.when(topic_id == c, TOPICS[c])
    return name


# --- naive Bayes -----------------------------------------------------------------------------


@dataclass
class NaiveBayes:
    """words: (word, ll0, ll1, ...) log-likelihood per class; priors: one row (lp0, lp1, ...); n_words: rows of words, if known."""

    words: DataFrame
    priors: DataFrame
    n_words: int | None = None


#: Words of a model that may be sent to every task.
SHARED_WORDS = 1 << 18


def save_nb(model: NaiveBayes, path: str) -> None:
    model.words.write.parquet(f"{path}/words")
    model.priors.write.parquet(f"{path}/priors")


def load_nb(spark: SparkSession, path: str) -> NaiveBayes:
    columns = lambda name: ", ".join(f"{name}{c} double" for c in CLASSES)
    words = spark.read.schema(f"word string, {columns('ll')}").parquet(f"{path}/words")
    return NaiveBayes(words, spark.read.schema(columns("lp")).parquet(f"{path}/priors"), words.count())


def train_nb(labelled: DataFrame, text: str, label: str) -> NaiveBayes:
    """Add-one smoothed multinomial model. Word counts are combined before the shuffle and stored,
    since they are read for the class totals, for the word table and for every scoring run."""
    counted = materialize(
        labelled.select(label, F.explode(X.tokens(F.col(text))).alias("word"))
        .groupBy("word")
        .agg(*[F.count_if(F.col(label) == c).alias(f"tf{c}") for c in CLASSES]),
        "word-counts",
    )
    totals = counted.agg(
        F.struct(
            F.count(F.lit(1)).alias("v"), *[F.sum(f"tf{c}").alias(f"t{c}") for c in CLASSES]
        ).alias("s")
    ).scalar()
    sized = counted.withColumn("_s", totals)
    words = sized.select(
        "word",
        *[
            F.log((F.col(f"tf{c}") + 1) / (F.col(f"_s.t{c}") + F.col("_s.v"))).alias(f"ll{c}")
            for c in CLASSES
        ],
    )
    sizes = labelled.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(label) == c).alias(f"n{c}") for c in CLASSES]
    )
    # A class without any document is out of the question, but its logarithm must not be null.
    prior = lambda c: F.when(F.col(f"n{c}") > 0, F.log(F.col(f"n{c}") / F.col("n"))).otherwise(NEVER)
    priors = sizes.select(*[prior(c).alias(f"lp{c}") for c in CLASSES])
    return NaiveBayes(words, priors)


def nb_scores(docs: DataFrame, key: str, text: str, model: NaiveBayes) -> DataFrame:
    """docs plus `scores`, one per class: log prior + sum of word log-likelihoods; unknown words count nothing.

    A document's words meet the word table in one join; sums per document merge in the task that
    read it. For a word table that is too big to broadcast, words are counted inside their row and dealt by word; the few model words
    that a task gets are hashed, and the documents' words stream past them, so no task sorts or holds these. Adaptive execution splits
    the partition of a very common word.
    """
    if model.n_words is not None and model.n_words <= SHARED_WORDS:
        words = docs.select(key, F.explode(X.tokens(F.col(text))).alias("word"))
        known = words.withColumn("_n", F.lit(1)).join(F.broadcast(model.words), "word")
    else:
        counted = docs.select(key, F.inline(X.counted_tokens(F.col(text)))).withColumnRenamed("n", "_n")
        known = counted.join(model.words.hint("shuffle_hash"), "word")
    sums = known.groupBy(key).agg(*[F.sum(F.col("_n") * F.col(f"ll{c}")).alias(f"_w{c}") for c in CLASSES])
    prior = model.priors.select(F.struct(*[f"lp{c}" for c in CLASSES]).alias("p")).scalar()
    scored = docs.join(sums, key, "left").withColumn("_p", prior)
    return scored.select(
        *docs.columns,
        F.array(
            *[F.round(F.col(f"_p.lp{c}") + F.coalesce(F.col(f"_w{c}"), F.lit(0.0)), 6) for c in CLASSES]
        ).alias("scores"),
    )


def softmax(scores: Column) -> Column:
    """Probabilities from an array of log scores, rounded. Maximum and total are computed once per row."""
    powers = F.transform(F.array(F.array_max(scores)), lambda m: F.transform(scores, lambda x: F.exp(x - m)))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    shares = F.transform(
        powers,
        lambda p: F.get(F.transform(F.array(total(p)), lambda t: F.transform(p, lambda x: F.round(x / t, 6))), F.lit(0)),
    )
    return F.get(shares, F.lit(0))


def classify_nb(docs: DataFrame, key: str, text: str, model: NaiveBayes) -> DataFrame:
    """docs plus scores, probs, topic_id, topic and confidence.

    Blank text is ('Unknown', 0.0, -1); text that cannot be scored is ('Error', 0.0, -1). Every
    input row comes out once. Ties go to the lowest topic id.
    """
    # Whether a text is blank is decided before the join, which then carries texts only if they are asked for.
    scored = nb_scores(docs.withColumn("_blank", X.is_blank(F.col(text))), key, text, model)
    return _contract(scored.withColumn("probs", softmax(F.col("scores"))), F.col("_blank")).drop("_blank")


def with_contract(scored: DataFrame, text: str) -> DataFrame:
    """topic, confidence and topic_id from the array of class probabilities, with the edge cases."""
    return _contract(scored, X.is_blank(F.col(text)))


def _contract(scored: DataFrame, blank: Column) -> DataFrame:
    best = F.array_max("probs")
    failed = best.isNull() | F.isnan(best)
    state = F.when(blank, "Unknown").when(failed, "Error")
    winner = (F.array_position("probs", best) - 1).cast("int")
    picked = scored.withColumn("topic_id", F.when(blank | failed, F.lit(-1)).otherwise(winner))
    return picked.select(
        "*",
        F.coalesce(topic_name(F.col("topic_id")), state).alias("topic"),
        F.when(F.col("topic_id") < 0, F.lit(0.0)).otherwise(best).alias("confidence"),
    )


def all_scores(classified: DataFrame, key: str) -> DataFrame:
    """(key, topic_id, topic, score) for every class of every row that was scored."""
    long = classified.where("topic_id >= 0").select(key, F.posexplode("probs").alias("topic_id", "score"))
    return long.select(key, "topic_id", topic_name(F.col("topic_id")).alias("topic"), "score")


def all_scores_map(classified: DataFrame) -> DataFrame:
    """The same as one map column per row."""
    names = F.array(*[F.lit(TOPICS[c]) for c in CLASSES])
    return classified.withColumn("all_scores", F.map_from_arrays(names, "probs"))


def classify_by_id(articles: DataFrame, wanted: DataFrame, model: NaiveBayes) -> DataFrame:
    """article_id, outcome, topic, confidence, all_scores for each id of `wanted`, from the article's whole content.

    outcome: ok, no_content (null or empty) or not_found; only ok has a topic and scores.
    """
    found = wanted.select("article_id").join(
        articles.select("article_id", "content", F.lit(True).alias("_there")), "article_id", "left"
    )
    empty = F.col("content").isNull() | (F.col("content") == "")
    outcome = F.when(F.col("_there").isNull(), "not_found").when(empty, "no_content").otherwise("ok")
    scored = all_scores_map(classify_nb(found.withColumn("outcome", outcome), "article_id", "content", model))
    ok = F.col("outcome") == "ok"
    return scored.select(
        "article_id", "outcome", *[F.when(ok, F.col(c)).alias(c) for c in ("topic", "confidence", "all_scores")]
    )


# --- Spark ML --------------------------------------------------------------------------------


def topic_pipeline(text: str = "text", label: str = "label", features: int = 1 << 16, reg: float = 1e-3) -> Pipeline:
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=X.WORD_BREAK, toLowercase=True),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_features"),
            LogisticRegression(featuresCol="_features", labelCol=label, maxIter=20, regParam=reg, family="multinomial"),
        ]
    )


#: Pieces of the training rows per core. A step of the fit sends one gradient (classes times features) per piece.
PIECES_PER_CORE = 2


def _pieces(rows: DataFrame) -> int:
    return PIECES_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism


def train_topic_model(labelled: DataFrame, text: str, label: str) -> PipelineModel:
    """Words are cut and hashed once; what the fits read again are stored counts instead of texts."""
    stages = topic_pipeline(text, label).getStages()
    counts = PipelineModel(stages[:2]).transform(labelled.select(label, text)).select(label, "_tf")
    fitted = Pipeline(stages=stages[2:]).fit(materialize(counts, "hashed-words").coalesce(_pieces(labelled)))
    return PipelineModel([*stages[:2], *fitted.stages])


def classify_ml(model: PipelineModel, docs: DataFrame, text: str) -> DataFrame:
    """Score with a fitted pipeline under the same contract as naive Bayes."""
    safe = docs.withColumn("_given", F.col(text)).withColumn(text, F.coalesce(text, F.lit("")))
    probs = F.transform(vector_to_array("probability"), lambda p: F.round(p, 6))
    scored = model.transform(safe).select(
        *[c for c in docs.columns if c != text], F.col("_given").alias(text), probs.alias("probs")
    )
    return with_contract(scored, text)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def tune_topic_model(labelled: DataFrame, text: str, label: str, regs: tuple[float, ...], seed: int = 42):
    """Grid over regularisation, best by accuracy: (best model, [(reg, accuracy)]).

    The split sorts, and keeps, words as counts; the fits read no texts. Each fit reads the kept rows in a bounded number of pieces.
    """
    stages = topic_pipeline(text, label).getStages()
    grid = ParamGridBuilder().addGrid(stages[-1].regParam, list(regs)).build()
    scorer = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    pieces = SQLTransformer(statement=f"SELECT /*+ COALESCE({_pieces(labelled)}) */ * FROM __THIS__")
    search = TrainValidationSplit(
        estimator=Pipeline(stages=[pieces, *stages[2:]]), estimatorParamMaps=grid, evaluator=scorer, trainRatio=0.8, seed=seed, parallelism=2
    )
    # The other columns stay, since the split is drawn from the rows in their order.
    counts = PipelineModel(stages[:2]).transform(labelled).select(*[c for c in labelled.columns if c != text], "_tf")
    fitted = search.fit(counts)
    return PipelineModel([*stages[:2], *fitted.bestModel.stages[1:]]), list(zip(regs, fitted.validationMetrics))


# --- plug-in models --------------------------------------------------------------------------

Prediction = tuple[int, float]
Predictor = Callable[[list[str]], list[Prediction]]


def classify_batch(docs: DataFrame, text: str, load: Callable[[], Predictor]) -> DataFrame:
    """Classify with any model. `load` runs once per Python worker; a batch that raises gives Error rows.

    spark.sql.execution.arrow.maxRecordsPerBatch sets the batch size the model sees.
    """

    @F.pandas_udf("topic_id int, confidence double, state string")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            out = pd.DataFrame({"topic_id": -1, "confidence": 0.0, "state": "Unknown"}, index=batch.index)
            filled = batch[batch.notna() & (batch.fillna("").str.strip() != "")]
            if len(filled):
                try:
                    ids, scores = zip(*model(filled.tolist()))
                    out.loc[filled.index, "topic_id"] = ids
                    out.loc[filled.index, "confidence"] = scores
                    out.loc[filled.index, "state"] = "ok"
                except Exception:
                    out.loc[filled.index, "state"] = "Error"
            yield out.astype({"topic_id": "int32"})

    scored = docs.withColumn("_m", predict(F.col(text)))
    name = F.when(F.col("_m.state") == "ok", topic_name(F.col("_m.topic_id"))).otherwise(F.col("_m.state"))
    return scored.select(
        *docs.columns,
        F.col("_m.topic_id").alias("topic_id"),
        name.alias("topic"),
        F.round("_m.confidence", 6).alias("confidence"),
    )


# --- evaluation ------------------------------------------------------------------------------
# Every measure starts from counts per (split, label, predicted): at most a few rows per split,
# whatever the number of predictions.


def outcome_counts(predicted: DataFrame, by: str = "split") -> DataFrame:
    return predicted.groupBy(by, "label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def class_distribution(labelled: DataFrame, label: str) -> DataFrame:
    counts = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n")).scalar()
    return counts.select(
        F.col(label).alias("topic_id"), topic_name(F.col(label)).alias("topic"), "n",
        r6(F.col("n") * 100.0 / whole).alias("percent"),
    )


def classification_report(predicted: DataFrame, by: str = "split") -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a ratio has nothing to divide by."""
    return _report(outcome_counts(predicted, by), by)


def _report(counts: DataFrame, by: str) -> DataFrame:
    rows = counts.groupBy(by, F.col("label").alias("topic_id")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit")
    )
    cols = counts.groupBy(by, F.col("predicted").alias("topic_id")).agg(F.sum("n").alias("guessed"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = rows.join(cols, [by, "topic_id"], "full").select(
        by, "topic_id", zero(F.col("support")).alias("support"), zero(F.col("hit")).alias("hit"),
        zero(F.col("guessed")).alias("guessed"),
    )
    p = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("guessed")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return both.select(
        by, "topic_id", topic_name(F.col("topic_id")).alias("topic"), r6(p).alias("precision"), r6(r).alias("recall"),
        r6(f1).alias("f1"), "support",
    )


def eval_metrics(predicted: DataFrame, by: str = "split") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    # A few rows that are read three times; so the predictions are made once.
    counts = materialize(outcome_counts(predicted, by), "outcomes")
    report = _report(counts, by)
    weighted = lambda c: r6(F.sum(F.col(c) * F.col("support")) / F.sum("support"))
    right = F.col("label") == F.col("predicted")
    hits, judged = F.sum(F.when(right, F.col("n")).otherwise(0)), F.sum(F.when(right.isNotNull(), F.col("n")))
    accuracy = counts.groupBy(by).agg(r6(F.try_divide(hits.cast("double"), judged)).alias("accuracy"))
    sums = report.groupBy(by).agg(*[weighted(c).alias(c) for c in ("precision", "recall", "f1")])
    return accuracy.join(sums, by)


def confusion_matrix(predicted: DataFrame, by: str = "split") -> DataFrame:
    """One row per label, one column per predicted class."""
    pivot = outcome_counts(predicted, by).groupBy(by, "label").pivot("predicted", list(CLASSES)).agg(F.sum("n"))
    return pivot.select(
        by, "label", *[F.coalesce(F.col(str(c)), F.lit(0)).cast("bigint").alias(f"as_{c}") for c in CLASSES]
    )


def per_class_accuracy(predicted: DataFrame, by: str = "split") -> DataFrame:
    right = (F.col("label") == F.col("predicted")).cast("double")
    return predicted.groupBy(by, "label").agg(r6(F.avg(right) * 100.0).alias("accuracy"))


def misclassified_sample(predicted: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """The first n wrong predictions with the start of their text."""
    return (
        predicted.where(F.col("label") != F.col("predicted"))
        .orderBy(key)
        .limit(n)
        .select(key, "label", "predicted", F.substring(text, 1, 150).alias("text"))
    )


def predicted_distribution(predicted: DataFrame, by: str = "split") -> DataFrame:
    return predicted.groupBy(by, "predicted").agg(F.count(F.lit(1)).alias("n"))


def combine_labelled_sets(sets: list[DataFrame], mappings: list[DataFrame]) -> DataFrame:
    """Map each set's own labels to topics and put the sets under each other.

    sets: (id, text, label); mappings: (label, topic_id), one row per foreign label.
    """
    mapped = [
        s.join(m, "label").select("id", "text", "topic_id") for s, m in zip(sets, mappings, strict=True)
    ]
    whole = mapped[0]
    for part in mapped[1:]:
        whole = whole.unionByName(part)
    return whole
