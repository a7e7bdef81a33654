from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from llm.common import AWKWARD, documents, prose
from newsloom.llm import bpe, queries, toxicity

BAD = ["vilest", "scumbag", "wretch", "loserish", "fiendish"]


def labelled(spark, n=240):
    """Documents of which every fourth holds two or three bad words, and labels of most of them."""
    rng = np.random.default_rng(7)
    texts = prose(41, n, 80)
    for i in range(0, n, 4):
        words = texts[i].split()
        for w in rng.choice(BAD, rng.integers(2, 4), replace=False):
            words.insert(rng.integers(len(words) + 1), str(w))
        texts[i] = " ".join(words)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), "x") for i in range(n) if i % 3], "doc_id long, quality int, toxic int, text string")
    return texts, labels


@pytest.fixture(scope="module")
def scored(spark):
    texts, labels = labelled(spark)
    docs = documents(spark, texts + AWKWARD)
    docs = docs.union(docs.where("doc_id = 4"))
    return texts, labels, docs, toxicity.label_chain(docs, labels)


def test_held_out_documents_are_told_apart(spark, scored):
    texts, labels, docs, chain = scored
    rows = toxicity.score(docs, chain).select("row.doc_id", "p_toxic", F.col("toxic").alias("said")).collect()
    assert len(rows) == len(texts) + len(AWKWARD) + 1
    held = [r for r in rows if r.doc_id < len(texts) and r.doc_id % 3 == 0]
    right = np.mean([r.said == (r.doc_id % 4 == 0) for r in held])
    assert right >= 0.95
    assert all(0 <= r.p_toxic <= 1 and r.said == 0 for r in rows if r.doc_id >= len(texts))
    assert chain.links[0].model is None and chain.links[0].fixed == 0.0  # one class only


def test_later_models_see_earlier_categories(spark):
    """The second category is the first one, seen through the words of a part of the documents only."""
    texts, labels = labelled(spark)
    categories = {"first": F.col("toxic"), "second": F.col("toxic")}
    chain = toxicity.fit_chain(documents(spark, texts), labels, categories)
    names = [*chain.vectoriser.vocabulary, "p_first"]
    assert chain.links[1].model.numFeatures == len(names) == chain.links[0].model.numFeatures + 1
    assert chain.links[1].model.coefficients[len(names) - 1] > 0


def test_rows_of_later_fits_are_scans(spark, monkeypatch):
    """A step of a fit or of a choice of threshold joins nothing, so that the driver plans and broadcasts nothing for it."""
    texts, labels = labelled(spark)
    plans, best = [], toxicity._best_threshold
    monkeypatch.setattr(toxicity, "_best_threshold", lambda rows, *names: plans.append(rows._jdf.queryExecution().toString()) or best(rows, *names))
    toxicity.fit_chain(documents(spark, texts), labels, {"first": F.col("toxic"), "second": F.col("toxic")})
    assert len(plans) == 2 and not any("Join" in plan or "Exchange" in plan for plan in plans)


def test_without_labels_or_documents(spark, scored):
    _, labels, docs, chain = scored
    none = toxicity.toxicity(docs, labels.where("false"))
    assert none.count() == docs.count() and none.where("toxic = 1 or p_toxic > 0").count() == 0
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, nulls).where("toxic = 1").count() == 0
    assert toxicity.score(docs.where("false"), chain).count() == 0


def test_toxic_documents_go_and_columns_stay(spark, scored):
    texts, labels, docs, chain = scored
    kept = toxicity.without_toxic(docs, labels)
    assert kept.schema == docs.schema
    ids = [r.doc_id for r in kept.collect()]
    clean = {i for i in range(len(texts)) if i % 4} | set(range(len(texts), len(texts) + len(AWKWARD)))
    assert clean <= set(ids) and len(set(ids) - clean) <= 3


def test_words_of_a_rare_category_stay_features(spark):
    """1 % are toxic and each of their words is in 0.2 % of the labelled documents."""
    rng, n = np.random.default_rng(8), 3_600
    common = [f"plain{i}" for i in range(200)]
    bad = [f"vile{c}{c}{c}" for c in "abcdefghij"]
    texts = [" ".join(rng.choice(common, 12)) for _ in range(n)]
    for at, i in enumerate(range(0, n, 100)):
        texts[i] += f" {bad[at % 10]} {bad[(at * 3 + 1) % 10]}"
    labels = [(i, 1, int(i % 100 == 0)) for i in range(n) if i % 300]  # a third of the toxic ones is held out
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chain = toxicity.label_chain(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sum(w.startswith("vile") and not w.endswith("*") for w in chain.vectoriser.vocabulary) == len(bad)
    said = {r.doc_id for r in toxicity.score(docs, chain).where("toxic = 1").select("row.doc_id").collect()}
    toxic = set(range(0, n, 100))
    assert len(said & toxic) >= 0.9 * len(toxic) and len(said - toxic) <= 3


def test_few_labelled_documents_without_a_frequent_word(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert {(r.p_toxic, r.toxic, r.p_low_quality) for r in toxicity.toxicity(docs, labels).collect()} == {(1.0, 1, 0.0)}


def test_whole_pipeline(spark, tmp_path):
    texts, labels = labelled(spark)
    texts = texts + AWKWARD + [texts[1], texts[2] + " end"]
    docs = documents(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == docs.columns, name
        path = str(tmp_path / name.split()[0])
        after.write.parquet(path)
        before = spark.read.parquet(path)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before.select("doc_id").collect())
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.n_tokens == len(known.encode_ordinary(text)) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert not {len(texts) - 2} & {r.doc_id for r in rows}  # the exact copy went
    assert corpus_pipeline.STAGES[0][1](spark, docs.where("false"), str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    import re

    numbers = {int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES}
    assert numbers == set(range(1, 14)) and set(queries.ORACLE) <= set(queries.QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
