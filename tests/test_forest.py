from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from weekpanel.operators import forest
from weekpanel.operators.textml import classifiers, clean_tokens, fit_counts, in_few_parts


def sparse_rows(spark, n, width, seed=1):
    """Three classes that a few of the features tell apart; empty rows, equal values and a feature of every row among them."""
    rng, data = np.random.default_rng(seed), []
    for _ in range(n):
        f = sorted({0, *rng.choice(width, rng.integers(0, 12), replace=False).tolist()}) if rng.random() < 0.95 else []
        v = [round(float(rng.random()), int(rng.integers(1, 4))) + 0.01 for _ in f]
        label = float((7 in f) + (3 in f) + rng.random() > 1.0) + float(11 in f and rng.random() > 0.3)
        data.append((label, Vectors.sparse(width, f, v)))
    return spark.createDataFrame(data, ["label", "features"]).repartition(3).cache()


def predictions(model, data):
    return [r.prediction for r in model.transform(data).select("prediction").collect()]


@pytest.mark.parametrize("n, depth", [(500, 5), (20, 3)])
def test_a_tree_without_draws_is_that_of_mllib(spark, n, depth):
    data = sparse_rows(spark, n, 40)
    theirs = DecisionTreeClassifier(maxDepth=depth).fit(data)
    ours = forest.SparseForest(trees=1, depth=depth, bootstrap=False, per_node=40).fit(data)
    assert (ours.trees.feature >= 0).sum() == theirs.numNodes // 2 > 0
    assert predictions(ours, data) == predictions(theirs, data)


def test_forest_of_many_features_keeps_non_zero_values_only(spark):
    """MLlib would hold 2,600 MB for these 300 rows."""
    rng, width = np.random.default_rng(2), 2**21 + 2**17
    rows = [(i % 2.0, Vectors.sparse(width, dict.fromkeys([i % 2, *rng.choice(width, 5, replace=False).tolist()], 1.0))) for i in range(300)]
    data = spark.createDataFrame(rows, ["label", "features"]).repartition(2)
    model = classifiers()["random_forest"].fit(data)
    assert isinstance(model, forest.ForestModel) and len(model.trees.feature) == 100
    assert set(predictions(model, data)) <= {0.0, 1.0}


def test_forest_learns_and_draws_the_same_trees_again(spark):
    data = sparse_rows(spark, 500, 40)
    one, two = (forest.SparseForest(trees=30).fit(data) for _ in range(2))
    assert (one.trees.feature == two.trees.feature).all()
    assert np.mean([p == r.label for p, r in zip(predictions(one, data), data.collect())]) > 0.75
    drawn = forest.weights(np.arange(50_000), 4, 42)
    assert abs(drawn.mean() - 1) < 0.02 and abs(drawn.var() - 1) < 0.03


def test_slices_hold_all_rows_and_few_values(monkeypatch):
    monkeypatch.setattr(forest, "SLICE_ROWS", 3)
    monkeypatch.setattr(forest, "SLICE_ITEMS", 10)
    parts = list(forest.slices(np.array([0, 4, 8, 12, 40, 40, 40, 40, 41])))
    assert [a for a, _ in parts[1:]] == [b for _, b in parts[:-1]] and parts[0][0] == 0 and parts[-1][1] == 8
    assert parts == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 8)]


def test_gaussian_bayes_scores_as_mllib(spark):
    data = sparse_rows(spark, 400, 40)
    model = classifiers()["gaussian_nb"].fit(data)
    assert "prediction" in model.transform(data).columns and "rawPrediction" not in model.transform(data).columns
    assert predictions(model, data) == predictions(NaiveBayes(modelType="gaussian").fit(data), data)


def test_words_of_letters_only(spark):
    odd = [i for i in range(1, 0x300) if chr(i) not in "@#"] + [0x2028, 0x3000, 0xFFFD, 0x1F600, 0x10FFFF]
    text = "".join(f"a{chr(i)}b" for i in odd) + " no-one's it"
    tokens = spark.createDataFrame([(text,)], "text string").select(clean_tokens("text", ["it"])).first()[0]
    assert tokens == [w for w in re.sub(r"[^a-zA-Z \t\n\x0b\f\r]+", "", text).lower().split() if w != "it"] and len(tokens) > 5


def test_dense_vectors_are_read_as_sparse_ones(spark):
    data = sparse_rows(spark, 60, 12)
    dense = spark.createDataFrame([(r.label, Vectors.dense(r.features.toArray())) for r in data.collect()], ["label", "features"])
    model = forest.SparseForest(trees=5).fit(data)
    sizes = dense.select(*[c.alias(n) for c, n in zip(forest.sparse_parts(), "siv")]).agg(F.min("s"), F.max(F.size("i"))).first()
    assert tuple(sizes) == (12, 12) and predictions(model, dense) == predictions(model, data)


def test_vocabulary_bound_is_a_number_of_documents(spark):
    docs = spark.createDataFrame([(i, ["all", f"w{i % 4}", "most"] if i else ["all", "w0"]) for i in range(20)], "id int, t array<string>")
    model = fit_counts(docs, "id", "t")
    assert model.getMaxDF() == 18.0 and sorted(model.vocabulary) == ["w0", "w1", "w2", "w3"]
    assert sorted(fit_counts(docs, "id", "t", max_df=0.95).vocabulary) == ["most", "w0", "w1", "w2", "w3"]
    assert sorted(fit_counts(docs.limit(1), "id", "t", min_df=1, max_df=1.0).vocabulary) == ["all", "w0"]


def test_vectors_lie_in_few_parts(spark):
    data = spark.range(60).repartition(12)
    assert in_few_parts(data, 100, 50).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert in_few_parts(data, 16 * 50 * 9, 50).rdd.getNumPartitions() == 9 and in_few_parts(data, 10**6, 50) is data
    assert in_few_parts(data, 100, 50).count() == 60
