"""Tokens, counts, TF-IDF and text classifiers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LinearSVC, NaiveBayes, NaiveBayesModel, OneVsRest
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, ElementwiseProduct, IDF, Normalizer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.functions.text import without_links
from weekpanel.operators.forest import RandomForest, with_prediction
from weekpanel.operators.heavy import LEAST_ROWS, SHARE, salted_lookup
from weekpanel.session import freeze

# Negations that stay in the text, and the vocabulary bounds.
NEGATIONS = ["not", "no", "nor", "n't"]
MIN_DF, MAX_DF = 3, 0.9
# All but letters and blanks, as ranges: Java takes many times as long for the same set written as [^a-zA-Z\s].
NO_LETTERS = r"[\x00-\x08\x0E-\x1F!-@\[-`{-\x{10FFFF}]+"
WORDS_PER_TERM = 16  # at least, in a partition of vectors, unless there are fewer partitions than cores
SMALL_VOCABULARY = 500_000  # terms that are sent to every task; of more, counts and terms meet by a shuffle


def stop_words(spark) -> list[str]:
    """English stop words of Spark without the negations."""
    return [w for w in StopWordsRemover.loadDefaultStopWords("english") if w not in NEGATIONS]


def clean_tokens(text: Column | str, stops: Sequence[str] = ()) -> Column:
    """Lower-case words of letters only, in order, without stop words."""
    c = without_links(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    c = F.lower(F.regexp_replace(c, NO_LETTERS, ""))
    tokens = F.array_remove(F.split(c, r"\s+"), "")
    if not stops:
        return tokens
    return F.filter(tokens, lambda w: ~w.isin(list(stops)))


def term_counts(docs: DataFrame, doc: str, tokens: str, min_length: int = 2) -> DataFrame:
    """Occurrences of each term in each document (long form). Terms have at least two letters.

    The documents are spread by id before their words are exploded: texts are smaller than their
    word rows, and the counts per document then need no further shuffle.
    """
    return (
        docs.select(doc, tokens).repartition(doc)
        .select(doc, F.explode(tokens).alias("term"))
        .filter(F.length("term") >= min_length)
        .groupBy(doc, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def vocabulary(counts: DataFrame, n_docs: Column, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """Terms found in at least ``min_df`` documents and at most a share ``max_df`` of them."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(
        (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs)
    )


def on_vocabulary(counts: DataFrame, vocab: DataFrame, share: float = SHARE, least: int = LEAST_ROWS) -> DataFrame:
    """Counts of the terms of a vocabulary, with its columns; a term of a large share of all documents is dealt over many tasks.

    The counts are many times the vocabulary: they stay where they are if its terms, counted first, can be sent to every task.
    """
    vocab = freeze(vocab)
    if vocab.count() <= SMALL_VOCABULARY:
        return counts.join(F.broadcast(vocab), "term")
    total = vocab.agg(F.sum("df")).scalar()
    heavy = vocab.filter((F.col("df") > least) & (F.col("df") > share * total)).select("term")
    return salted_lookup(counts, vocab, ["term"], "inner", heavy)


def bag_of_words_long(docs: DataFrame, doc: str, tokens: str, vocab: DataFrame | None = None,
                      min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """Counts on the vocabulary of the same documents, or on one learnt elsewhere."""
    counts = freeze(term_counts(docs, doc, tokens))  # read twice: for the vocabulary and for the result
    if vocab is None:
        vocab = vocabulary(counts, docs.agg(F.count(F.lit(1))).scalar(), min_df, max_df)
    return on_vocabulary(counts, vocab).select(*counts.columns)


def tfidf_long(docs: DataFrame, doc: str, tokens: str, vocab: DataFrame | None = None, n_docs: Column | None = None,
               min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """``tf * (ln((1 + n) / (1 + df)) + 1)``, scaled to length 1 per document.

    The window for the length holds the distinct terms of one document, at most one input row's text.
    """
    counts = freeze(term_counts(docs, doc, tokens))
    n = n_docs if n_docs is not None else docs.agg(F.count(F.lit(1))).scalar()
    terms = vocab if vocab is not None else vocabulary(counts, n, min_df, max_df)
    raw = on_vocabulary(counts, terms).select(
        doc, "term", (F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)).alias("w")
    )
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return raw.select(doc, "term", (F.col("w") / length).alias("weight"))


def fit_counts(docs: DataFrame, doc: str, tokens: str, min_df: int = MIN_DF, max_df: float = MAX_DF) -> CountVectorizerModel:
    """Vectoriser over the whole vocabulary: its size is counted first, so no term is cut off.

    The upper bound is given as a number of documents where it is one or more: for a share MLlib would keep and count all words once more.
    """
    n = docs.count()
    size = vocabulary(term_counts(docs, doc, tokens), F.lit(n), min_df, max_df).count()
    words = docs.select(F.filter(tokens, lambda w: F.length(w) >= 2).alias("_words"))
    return CountVectorizer(inputCol="_words", outputCol="counts", minDF=min_df, maxDF=max_df * n if max_df < 1 <= max_df * n else max_df,
                           vocabSize=max(size, 1)).fit(words)


def count_vectors(model: CountVectorizerModel, docs: DataFrame, tokens: str) -> DataFrame:
    return model.transform(docs.withColumn("_words", F.filter(tokens, lambda w: F.length(w) >= 2))).drop("_words")


def tfidf_vectors(train_counts: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """TF-IDF vectors of the training documents and of others, with the weights of the first."""
    idf = IDF(inputCol="counts", outputCol="_idf").fit(train_counts).idf
    scale = ElementwiseProduct(scalingVec=Vectors.dense([v + 1.0 for v in idf]), inputCol="counts", outputCol="_w")
    norm = Normalizer(p=2.0, inputCol="_w", outputCol="features")
    return [norm.transform(scale.transform(d)).drop("_w") for d in (train_counts, *others)]


def in_few_parts(vectors: DataFrame, words: int, terms: int) -> DataFrame:
    """Vectors of ``words`` words in fewer partitions: in every step of a linear model each of them sends a number for every term."""
    parts = max(vectors.sparkSession.sparkContext.defaultParallelism, words // (WORDS_PER_TERM * max(terms, 1)))
    return vectors.coalesce(parts) if vectors.rdd.getNumPartitions() > parts else vectors


class GaussianBayes:
    """MLlib's Gaussian naive Bayes, scored from the non-zero values of a row: MLlib's own scores walk through every feature of every row."""

    def fit(self, data: DataFrame) -> GaussianBayesModel:
        return GaussianBayesModel(NaiveBayes(modelType="gaussian").fit(data))


class GaussianBayesModel:
    def __init__(self, model: NaiveBayesModel):
        self.model = model

    def transform(self, data: DataFrame) -> DataFrame:
        """The squared distance of a row is that of a row of zeros and a correction for each value of its own."""
        mean, spread = (m.toArray() for m in (self.model.theta, self.model.sigma))
        if not (spread > 0).all():  # no feature varies
            return self.model.transform(data)
        start = self.model.pi.toArray() - (mean * mean / spread + np.log(spread)).sum(1) / 2
        once, squared = mean / spread, -0.5 / spread

        def predict(offsets: np.ndarray, indices: np.ndarray, values: np.ndarray) -> np.ndarray:
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            scores = [s + np.bincount(row, values * (a[indices] + values * b[indices]), len(offsets) - 1) for s, a, b in zip(start, once, squared)]
            return np.argmax(scores, 0)

        return with_prediction(data, predict)


def classifiers() -> dict[str, object]:
    """Untrained text classifiers by name."""
    return {
        "linear_svm": OneVsRest(classifier=LinearSVC(maxIter=50, regParam=0.01), parallelism=1),
        "random_forest": RandomForest(),
        "gaussian_nb": GaussianBayes(),
        "complement_nb": NaiveBayes(modelType="complement"),
    }


def cross_validate(data: DataFrame, fold: str, build, points: list[dict], k: int = 5) -> DataFrame:
    """Accuracy of every grid point on every fold (long form); the folds are a column of the data."""
    rows = []
    for i, params in enumerate(points):
        for f in range(k):
            model = build(**params).fit(data.filter(F.col(fold) != f))
            hit = (F.col("prediction") == F.col("label")).cast("double")
            acc = model.transform(data.filter(F.col(fold) == f)).agg(F.avg(hit)).first()[0]
            rows.append((i, {a: str(b) for a, b in params.items()}, f, float(acc) if acc is not None else None))
    return data.sparkSession.createDataFrame(rows, "point int, params map<string,string>, fold int, accuracy double")

