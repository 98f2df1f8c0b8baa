"""Exact k nearest neighbours and their vote.

Distances are matrix products inside tasks. Every task emits at most k candidates per test row and
block of the training set, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.operators.rows import top_per_group

BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 20_000
SAMPLE_ROWS = 2_000  # rows of each side from which the width of a bucket is taken
CELLS = 1 << 21  # distances held at once by one task
_SCHEMA = "test_id {t}, train_id {r}, label {l}, distance double"


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1.0, norm)


def _nearest(test_ids, test, train_ids, labels, train, k: int, step: int = 512) -> pd.DataFrame:
    """The k smallest (distance, train id) per test row.

    The fast product picks candidates with a margin for rounding; their distances are then computed
    directly, so ties and near ties are decided exactly. The more training rows, the fewer test rows are taken at once.
    """
    out = []
    step = max(1, min(step, CELLS // max(1, len(train))))
    sq = (train * train).sum(axis=1)
    for s in range(0, len(test), step):
        part = test[s:s + step]
        own = (part * part).sum(axis=1)
        d2 = part @ train.T
        d2 *= -2.0
        d2 += sq[None, :]
        d2 += own[:, None]
        if k < len(train):
            cut = np.partition(d2, k - 1, axis=1)[:, k - 1] + 1e-9 * (1.0 + own + sq.max())
        else:
            cut = np.full(len(part), np.inf)
        for i in range(len(part)):
            idx = np.flatnonzero(d2[i] <= cut[i])
            exact = np.sqrt(((train[idx] - part[i]) ** 2).sum(axis=1))
            first = np.lexsort((train_ids[idx], exact))[:k]
            out.append((np.repeat(test_ids[s + i], len(first)), train_ids[idx][first], labels[idx][first], exact[first]))
    if not out:
        return pd.DataFrame(columns=["test_id", "train_id", "label", "distance"], dtype=object)
    a, b, c, d = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"test_id": a, "train_id": b, "label": c, "distance": d})


def _matrix(column: pd.Series, cosine: bool) -> np.ndarray:
    x = np.vstack(column.to_list()).astype("float64")
    return _unit(x) if cosine else x


def nearest(test: DataFrame, train: DataFrame, k: int, id_column: str, vector: str, label: str,
            metric: str = "euclidean", broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest training rows of every test row: ``test_id, train_id, label, distance``.

    A training set whose counted size is within ``broadcast_bytes`` is sent to all tasks; the test
    rows are then not shuffled at all. A larger one is cut into blocks, each block meets each chunk of
    test rows once, and the candidates of the blocks are merged. ``cosine`` is the Euclidean distance
    of unit vectors, which has the same order. Ids are unique and can be ordered.
    """
    cosine = metric == "cosine"
    t, r = test.schema[id_column].dataType.simpleString(), train.schema[id_column].dataType.simpleString()
    schema = _SCHEMA.format(t=t, r=r, l=train.schema[label].dataType.simpleString())
    probe = train.select(id_column, F.col(vector), label)
    size = train.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    n_train, width = int(size[0]), int(size[1] or 0)
    if n_train * (width + 2) * 8 <= broadcast_bytes:
        pdf = probe.toPandas()
        data = test.sparkSession.sparkContext.broadcast(
            (pdf[id_column].to_numpy(), pdf[label].to_numpy(), _matrix(pdf[vector], cosine) if n_train else np.zeros((0, width)))
        )

        def run(batches):
            ids, labels, matrix = data.value
            for b in batches:
                if len(b) and len(ids):
                    yield _nearest(b[id_column].to_numpy(), _matrix(b[vector], cosine), ids, labels, matrix, k)

        return test.select(id_column, vector).mapInPandas(run, schema)

    n_test = test.count()
    blocks, chunks = math.ceil(n_train / block_rows), max(1, math.ceil(n_test / block_rows))
    block = F.pmod(F.xxhash64(id_column), F.lit(blocks))
    chunk = F.pmod(F.xxhash64(id_column), F.lit(chunks))
    left = test.select(id_column, vector, chunk.cast("int").alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    right = probe.withColumn("_b", block.cast("int")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["test_id", "train_id", "label", "distance"], dtype=object)
        return _nearest(a[id_column].to_numpy(), _matrix(a[vector], cosine), b[id_column].to_numpy(),
                        b[label].to_numpy(), _matrix(b[vector], cosine), k)

    found = left.groupBy("_c", "_b").cogroup(right.groupBy("_c", "_b")).applyInPandas(meet, schema)
    return top_per_group(found, ["test_id"], [F.col("distance"), F.col("train_id")], k)


def nearest_in_buckets(test: DataFrame, train: DataFrame, k: int, id_column: str, vector: str, label: str, metric: str = "euclidean",
                       tables: int = 6, projections: int = 2, width: float = 4.0, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest training rows of every test row among those that share a bucket with it: for training sets that no task can hold.

    Rows are hashed by random projections; ``projections`` of them name a bucket of one table, and a row stands in one bucket of each of
    the ``tables``. A bucket is ``width`` times as wide as the distance to the k-th neighbour in a bounded sample, which is no smaller than
    in the whole, so a true neighbour shares at least one bucket with high probability; its distance is then exact. A training row is sent
    once for each table; a bucket of more than ``block_rows`` rows of a side is cut into parts, and each part of its training rows meets
    each part of its test rows in a task of its own.
    """
    cosine = metric == "cosine"
    t, r = test.schema[id_column].dataType.simpleString(), train.schema[id_column].dataType.simpleString()
    schema = _SCHEMA.format(t=t, r=r, l=train.schema[label].dataType.simpleString())
    sample = [_sampled(df, id_column, vector, SAMPLE_ROWS, cosine) for df in (test, train)]
    if not (len(sample[0]) and len(sample[1])):
        return test.sparkSession.createDataFrame([], schema)
    near = np.sort(((sample[0][:200, None] - sample[1][None]) ** 2).sum(axis=2), axis=1)[:, : k + 1][:, -1]
    reach = float(np.sqrt(np.median(near))) or 1.0
    hasher = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=width * reach, numHashTables=tables * projections, seed=seed)
    as_vector = array_to_vector(F.col(vector).cast("array<double>"))
    if cosine:
        as_vector = array_to_vector(F.transform(F.col(vector).cast("array<double>"), lambda x: F.try_divide(x, F.sqrt(F.aggregate(
            F.col(vector).cast("array<double>"), F.lit(0.0), lambda a, y: a + y * y)))))
    model = hasher.fit(train.limit(1).select(as_vector.alias("_v")))

    def bucketed(df: DataFrame, *columns: str) -> DataFrame:
        hashed = model.transform(df.select(id_column, vector, *columns, as_vector.alias("_v")))
        one = [F.struct(F.lit(i).alias("table"), F.xxhash64(*[vector_to_array(F.get("_h", F.lit(i * projections + j)))[0] for j in range(projections)]).alias("key"))
               for i in range(tables)]
        named = [F.col(f"`{c}`").alias(c) for c in (id_column, vector, *columns)]  # names of its own where both sides come from one table
        return hashed.select(*named, F.explode(F.array(*one)).alias("_b")).select(id_column, vector, *columns, "_b.*")

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("table", "key").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias(name))

    def dealt(name: str, size: str) -> Column:
        return F.pmod(F.xxhash64(id_column), size).alias(name)

    def each(name: str, size: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(size) - 1)).alias(name)

    right, left = bucketed(train, label), bucketed(test)
    both = sizes(right, "_parts").join(sizes(left, "_chunks"), ["table", "key"])
    right = right.join(both, ["table", "key"]).select(id_column, vector, label, "table", "key", dealt("part", "_parts"), each("chunk", "_chunks"))
    left = left.join(both, ["table", "key"]).select(id_column, vector, "table", "key", each("part", "_parts"), dealt("chunk", "_chunks"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["test_id", "train_id", "label", "distance"], dtype=object)
        return _nearest(a[id_column].to_numpy(), _matrix(a[vector], cosine), b[id_column].to_numpy(), b[label].to_numpy(), _matrix(b[vector], cosine), k)

    keys = ["table", "key", "part", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema).dropDuplicates(["test_id", "train_id"])
    return top_per_group(found, ["test_id"], [F.col("distance"), F.col("train_id")], k)


def _sampled(df: DataFrame, id_column: str, vector: str, rows: int, cosine: bool) -> np.ndarray:
    """At most ``rows`` vectors, the same ones in each run."""
    picked = df.select(id_column, vector).orderBy(F.xxhash64(id_column), id_column).limit(rows).toPandas()
    return _matrix(picked[vector], cosine) if len(picked) else np.empty((0, 0))


def vote(neighbours: DataFrame) -> DataFrame:
    """Most frequent label among the neighbours; the smallest label wins a tie."""
    counts = neighbours.groupBy("test_id", "label").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("label").alias("label")))
    return counts.groupBy("test_id").agg(best.alias("b")).select("test_id", F.col("b.label").alias("predicted"))


def knn_classify(test: DataFrame, train: DataFrame, k: int, id_column: str, vector: str, label: str,
                 metric: str = "euclidean", in_buckets: bool = False) -> DataFrame:
    """Vote of the k nearest, found exactly or ``in_buckets``."""
    return vote((nearest_in_buckets if in_buckets else nearest)(test, train, k, id_column, vector, label, metric))
