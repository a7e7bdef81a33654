"""Toxicity by a chain of linear classifiers over words.

Categories are predicted one after the other. The model of a category sees a document's words and the probabilities of the
categories before it; in training those probabilities come from models that did not see the document (out of fold), so that a later
model does not trust them more than it may.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.rows import drop_folder
from newsloom.session import scratch_dir

#: Labelled documents that the models are fitted on, about: a sample by a hash of the id. Everything else covers all data.
TRAIN_ROWS = 20_000
#: Words in fewer documents of the sample are no features, whatever its size. Which of the others count is left to the penalty.
MIN_DOCS = 3
#: The fit takes so many words, those whose gradients exceed the penalty most, and CHECKS times as many more of the words left out that the
#: penalty would let in by the models fitted so far.
WORKING_WORDS = 8_192
CHECKS = 1
#: Tasks of a step of a fit.
FIT_PARTS = 4
STEM_CHARS = 5
FOLDS = 2
ITERATIONS = 20
#: Of absolute coefficients, over the square root of the rarer class's rows: words that go with a category by chance get none.
REGULARISATION = 0.4
GRID = [i / 20 for i in range(1, 20)]


def words(text: Column) -> Column:
    """Runs of letters, marks and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))


def features(text: Column) -> Column:
    """Different words, and for each of the longer ones its beginning, which inflected and compound words share."""
    found = F.array_distinct(words(text))
    stems = F.transform(
        F.filter(found, lambda w: F.char_length(w) > STEM_CHARS), lambda w: F.concat(F.left(w, F.lit(STEM_CHARS)), F.lit("*"))
    )
    return F.concat(found, stems)


@dataclass
class Link:
    """One category: its model (none if the sample has one class only, then a fixed probability) and its threshold."""

    category: str
    model: LogisticRegressionModel | None
    fixed: float = 0.0
    threshold: float = 0.5


@dataclass
class Chain:
    vectoriser: CountVectorizerModel | None
    links: list[Link] = field(default_factory=list)


def _penalty(rarer: float) -> float:
    return REGULARISATION / rarer**0.5


def _fit(rows: DataFrame, label: str, having: float, others: float) -> tuple[LogisticRegressionModel | None, float]:
    """The model of `rows`, of which so many have the category and do not; with one class only, none and its probability."""
    if not having or not others:
        return None, 1.0 if having else 0.0
    # Both classes weigh the same altogether, so a rare category is not drowned.
    total = having + others
    rows = rows.withColumn("weight", F.when(F.col(label) == 1, total / (2.0 * having)).otherwise(total / (2.0 * others)))
    model = LogisticRegression(
        featuresCol="features", labelCol=label, weightCol="weight", maxIter=ITERATIONS,
        regParam=_penalty(min(having, others)), elasticNetParam=1.0,
        probabilityCol="probability", rawPredictionCol="raw", predictionCol="prediction",
    ).fit(rows)
    return model, 0.0


def _probability(rows: DataFrame, model: LogisticRegressionModel | None, fixed: float, name: str) -> DataFrame:
    """`rows` with the probability of the category."""
    if model is None:
        return rows.withColumn(name, F.lit(fixed))
    kept = [F.col(c) for c in rows.columns]
    return model.transform(rows).select(*kept, vector_to_array("probability")[1].alias(name))


def _with_features(rows: DataFrame, earlier: list[str]) -> DataFrame:
    """`rows` with features: the words and the probabilities of the categories before."""
    if not earlier:
        return rows.withColumn("features", F.col("vector"))
    return VectorAssembler(inputCols=["vector", *earlier], outputCol="features").transform(rows)


@dataclass
class _Screen:
    """What the choice of features needs of each fit: a fit is a category and the fold it leaves out (or None, for all rows).

    A word's coefficient is zero if the gradient of the loss by it, on the scale of its deviation, is within the penalty. At the
    model without words the gradient is known from counts; after a fit the gradients of the words left out are computed from
    the fitted probabilities. So a fit on few words can be shown to be the fit on all.
    """

    names: list[str]
    all_sizes: dict[tuple, tuple[float, float]]  # documents with and without the category
    sizes: dict[tuple, tuple[float, float]] = field(init=False)  # the same, of the fits that have both

    def __post_init__(self):
        self.sizes = {fit: n for fit, n in self.all_sizes.items() if min(n) > 0}

    @staticmethod
    def of(stored: DataFrame, names: list[str]) -> _Screen:
        per_fold = {r["fold"]: r for r in stored.groupBy("fold").agg(F.count(F.lit(1)).alias("all"), *(F.sum(n).alias(n) for n in names)).collect()}
        sizes = {}
        for name in names:
            for out in (None, *range(FOLDS)):
                rows = [r for fold, r in per_fold.items() if fold != out]
                having = float(sum(r[name] for r in rows))
                sizes[name, out] = having, float(sum(r["all"] for r in rows)) - having
        return _Screen(names, sizes)

    def counts(self, stored: DataFrame) -> DataFrame:
        """word with its documents: in each fold, and of each category in each fold."""
        seen = stored.select("fold", *self.names, F.explode("words").alias("word"))
        return seen.groupBy("word").agg(
            F.count(F.lit(1)).alias("docs"),
            *(F.count(F.when(F.col("fold") == f, 1)).alias(f"all_{f}") for f in range(FOLDS)),
            *(F.sum(F.when(F.col("fold") == f, F.col(n)).otherwise(0.0)).alias(f"{n}_{f}") for n in self.names for f in range(FOLDS)),
        ).where(F.col("docs") >= MIN_DOCS)

    def share(self, fit: tuple) -> tuple[Column, Column]:
        """A word's weighted shares of the documents with and without the category: both classes weigh a half."""
        name, out = fit
        folds = [f for f in range(FOLDS) if f != out]
        having = sum((F.col(f"{name}_{f}") for f in folds), F.lit(0.0))
        others = sum((F.col(f"all_{f}") for f in folds), F.lit(0)) - having
        return having / (2 * self.sizes[fit][0]), others / (2 * self.sizes[fit][1])

    def excess(self, gradients: dict[tuple, Column]) -> Column:
        """The largest of a word's gradients as a multiple of the penalty of its fit."""
        found = [F.lit(0.0)]
        for fit, gradient in gradients.items():
            having, others = self.share(fit)
            spread = F.sqrt((having + others) * (1 - having - others))
            found.append(F.coalesce(F.try_divide(F.abs(gradient), _penalty(min(self.sizes[fit])) * spread), F.lit(0.0)))
        return F.greatest(*found, F.lit(0.0))

    def first(self) -> Column:
        """The excess at the model without words."""
        return self.excess({fit: 0.5 * (self.share(fit)[1] - self.share(fit)[0]) for fit in self.sizes})

    def residual(self, fit: tuple, probability: Column) -> Column:
        """A document's part of the gradient, in the weights of the fit."""
        name, out = fit
        having, others = self.sizes[fit]
        weight = F.when(F.col(name) == 1, 1 / (2 * having)).otherwise(1 / (2 * others))
        part = (probability - F.col(name)) * weight
        return part if out is None else F.when(F.col("fold") != out, part).otherwise(0.0)

    def missed(self, counts: DataFrame, residuals: DataFrame, fits: list[tuple]) -> DataFrame:
        """word, excess of the words of `counts`, from the documents' words and residuals r0, r1, ... of the fits."""
        sums = residuals.select("words", *(f"r{i}" for i in range(len(fits)))).withColumn("word", F.explode("words"))
        gradients = sums.groupBy("word").agg(*(F.sum(f"r{i}").alias(f"g{i}") for i in range(len(fits))))
        found = counts.drop("excess").join(gradients, "word")
        return found.select("word", self.excess({fit: F.col(f"g{i}") for i, fit in enumerate(fits)}).alias("excess"))


def _working(words: DataFrame) -> list[str]:
    """The words that exceed the penalty most."""
    most = words.where("excess > 1").groupBy("word").agg(F.max("excess").alias("excess"))
    return [r.word for r in most.orderBy(F.col("excess").desc(), "word").limit(WORKING_WORDS).collect()]


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], train_rows: int = TRAIN_ROWS) -> Chain:
    """A chain over `categories` (name to a 0/1 column of `labels`, in the order of the chain).

    Labels without an id or a category are left out; an id that is labelled several times has a category if any of its rows has. Documents
    without text count as empty. Without any labelled document the chain has probability 0 everywhere; if no word can have a
    coefficient, it is the share of the category.

    Words are counted and screened by Spark (see _Screen); the driver gets the working words, at most CHECKS + 1 times WORKING_WORDS.
    """
    spark = docs.sparkSession
    names = list(categories)
    known = labels.select("doc_id", *(c.cast("double").alias(n) for n, c in categories.items())).dropna()
    known = known.groupBy("doc_id").agg(*(F.max(n).alias(n) for n in names))
    share = train_rows / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 32)) < int(share * (1 << 32)))
    path = scratch_dir(spark, "toxicity-sample")
    sample = known.join(docs.select("doc_id", "text"), "doc_id").select(
        F.monotonically_increasing_id().alias("row"), *names, features(F.col("text")).alias("words"),
        F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).alias("fold"),
    )
    sample.write.parquet(path)
    stored = spark.read.schema(sample.schema).parquet(path)
    screen = _Screen.of(stored, names)
    path = scratch_dir(spark, "toxicity-words")
    screen.counts(stored).withColumn("excess", screen.first()).write.parquet(path)
    counts = spark.read.parquet(path)
    chosen = sorted(_working(counts))
    if not chosen:
        # Nothing to fit: the share of the category, so that the majority decides.
        got = stored.agg(*(F.avg(n).alias(n) for n in names)).first()
        return Chain(None, [Link(n, None, got[n] or 0.0) for n in names])
    for _ in range(CHECKS):
        missed = _missed_words(stored, names, chosen, screen, counts)
        if not missed:
            break
        chosen = sorted({*chosen, *missed})
    return _fit_links(stored, names, chosen, screen)


def _vectors(stored: DataFrame, vocabulary: list[str]) -> tuple[CountVectorizerModel, DataFrame, str]:
    """The sample as vectors over a vocabulary, stored without words.

    A bounded sample in few pieces, so that a step of a fit is one stage without a shuffle.
    """
    spark = stored.sparkSession
    vectoriser = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol="vector")
    path = scratch_dir(spark, "toxicity-vectors")
    vectoriser.transform(stored).drop("words").coalesce(FIT_PARTS).write.parquet(path)
    return vectoriser, spark.read.parquet(path), path


def _missed_words(stored: DataFrame, names: list[str], vocabulary: list[str], screen: _Screen, counts: DataFrame) -> set[str]:
    """Words beyond the vocabulary that the penalty would let in, by the models of all rows over the vocabulary."""
    spark = stored.sparkSession
    _, rows, path = _vectors(stored, vocabulary)
    earlier, residuals, fits = [], [], []
    for name in names:
        stage = _with_features(rows, earlier)
        model, fixed = _fit(stage, name, *screen.all_sizes[name, None])
        rows = _probability(stage, model, fixed, f"p_{name}").drop("features")
        earlier.append(f"p_{name}")
        if (name, None) in screen.sizes:
            fits.append((name, None))
            residuals.append(screen.residual(fits[-1], F.col(f"p_{name}")))
    if not fits:
        return set()
    known = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    parts = rows.select("row", *(r.alias(f"r{i}") for i, r in enumerate(residuals)))
    words = screen.missed(counts.join(known, "word", "left_anti"), parts.join(stored.select("row", "words"), "row"), fits)
    found = set(_working(words))
    drop_folder(spark, path)
    return found


def _fit_links(stored: DataFrame, names: list[str], vocabulary: list[str], screen: _Screen) -> Chain:
    """The chain over a vocabulary; later categories see probabilities of models that did not see the row.

    The rows are stored with each category's probabilities, so that the steps of the next fits are scans: no join and no exchange,
    whose plans, threads and tables would be on the driver once more for each of them.
    """
    spark = stored.sparkSession
    vectoriser, rows, path = _vectors(stored, vocabulary)
    chain, earlier, paths = Chain(vectoriser), [], [path]
    for name in names:
        stage = _with_features(rows, earlier)
        model, fixed = _fit(stage, name, *screen.all_sizes[name, None])
        scored, chosen = stage, F.lit(None).cast("double")
        for fold in range(FOLDS):
            inner, inner_fixed = _fit(stage.where(F.col("fold") != fold), name, *screen.all_sizes[name, fold])
            scored = _probability(scored, inner, inner_fixed, f"p_{name}_{fold}")
            chosen = F.when(F.col("fold") == fold, F.col(f"p_{name}_{fold}")).otherwise(chosen)
        paths.append(scratch_dir(spark, "toxicity-folds"))
        scored.select(*rows.columns, chosen.alias(f"p_{name}")).write.parquet(paths[-1])
        rows = spark.read.parquet(paths[-1])
        chain.links.append(Link(name, model, fixed, _best_threshold(rows, f"p_{name}", name)))
        earlier.append(f"p_{name}")
    for path in paths:
        drop_folder(spark, path)
    return chain


def _best_threshold(rows: DataFrame, probability: str, label: str) -> float:
    """The threshold of a grid with the best F1 on the out-of-fold probabilities; the middle one of equals."""
    hits = [F.sum(F.when(F.col(probability) >= t, F.col(label))).alias(f"h{i}") for i, t in enumerate(GRID)]
    said = [F.count(F.when(F.col(probability) >= t, 1)).alias(f"s{i}") for i, t in enumerate(GRID)]
    got = rows.agg(F.sum(label).alias("all"), *hits, *said).first()
    scores = [2 * (got[f"h{i}"] or 0.0) / max(1.0, (got["all"] or 0.0) + got[f"s{i}"]) for i in range(len(GRID))]
    best = [t for t, s in zip(GRID, scores) if s >= max(scores) - 1e-12]
    return best[len(best) // 2]


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """row (all columns of `docs`) with p_<category> and <category> (0/1) of each category. No shuffle."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    if chain.vectoriser is not None:
        rows = rows.withColumn("words", features(F.col("row.text").cast("string")))
        rows = chain.vectoriser.transform(rows).drop("words")
    earlier: list[str] = []
    for link in chain.links:
        if link.model is not None:
            rows = _with_features(rows, earlier)
        rows = _probability(rows, link.model, link.fixed, f"p_{link.category}")
        rows = rows.drop("features")
        earlier.append(f"p_{link.category}")
    decided = [(F.col(f"p_{n.category}") >= n.threshold).cast("int").alias(n.category) for n in chain.links]
    return rows.select("row", *earlier, *decided)


#: The categories of the table `labels`, in the order of the chain.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def label_chain(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Chain:
    return fit_chain(docs, labels, {n: F.expr(e) for n, e in CATEGORIES.items()}, train_rows)


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, p_low_quality, low_quality, p_toxic, toxic of each row of `docs`, whole texts.

    A null text is the empty text: it has the probability of a document without words. Null ids and repeated rows are scored like
    any other; other columns are not looked at; an empty table gives an empty result.
    """
    scored = score(docs.select("doc_id", "text"), label_chain(docs, labels, train_rows))
    return scored.select("row.doc_id", "p_low_quality", "low_quality", "p_toxic", "toxic")


def without_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of `docs` that are not toxic, all columns."""
    return score(docs, label_chain(docs, labels, train_rows)).where("toxic = 0").select("row.*")
