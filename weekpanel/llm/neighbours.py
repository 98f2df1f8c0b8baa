"""Approximate nearest neighbours by learned partitions.

A sample's neighbour graph is cut into balanced parts and a small network learns which part a vector belongs to. Every row is stored under its
most probable part; a query looks into its several most probable parts and ranks what it finds there by exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.session import freeze

#: Vectors that the partitions are learned from, at most.
SAMPLE = 8192
DEGREE, HIDDEN = 10, 96
#: Rows and queries that meet in one block, about.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


def neighbour_graph(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The nearest ``degree`` other vectors of each."""
    out, square = [], (x**2).sum(1)
    for at in range(0, len(x), 256):
        d = square[None] - 2 * x[at : at + 256] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out.append(np.argpartition(d, degree, axis=1)[:, :degree])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Cut the graph: halves along main directions, then moves that keep more edges inside, within ``slack`` of equal sizes."""
    label = np.zeros(len(x), dtype=np.int64)

    def halve(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            label[rows] = first
            return
        c = x[rows] - x[rows].mean(0)
        direction = np.linalg.eigh(c.T @ c)[1][:, -1]
        at = np.argsort(c @ direction, kind="stable")
        cut = len(rows) * (n // 2) // n
        halve(rows[at[:cut]], first, n // 2)
        halve(rows[at[cut:]], first + n // 2, n - n // 2)

    halve(np.arange(len(x)), 0, parts)
    size, room = np.bincount(label, minlength=parts), slack * len(x) / parts
    rows, ends = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        inside = np.zeros((len(x), parts), dtype=np.int32)
        np.add.at(inside, (rows, label[ends]), 1)
        np.add.at(inside, (ends, label[rows]), 1)
        goal = inside.argmax(1)
        gain = inside[np.arange(len(x)), goal] - inside[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[goal[i]] < room and size[label[i]] > len(x) / parts / slack / 2:
                size[label[i]] -= 1
                size[goal[i]] += 1
                label[i] = goal[i]
                moved += 1
        if not moved:
            break
    return label


@dataclass(frozen=True)
class Router:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(0, ((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2


def learn_router(x: np.ndarray, parts: int, epochs: int = 25, seed: int = 5) -> Router:
    """Partition the sample and train the network on it; a fixed seed, so a rerun learns the same."""
    label = balanced_parts(x, neighbour_graph(x, min(DEGREE, len(x) - 1)), parts) if parts > 1 else np.zeros(len(x), dtype=np.int64)
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z, d = (x - mean) / scale, x.shape[1]
    p = [rng.normal(0, np.sqrt(2 / max(1, d)), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs if parts > 1 else 0):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            b = order[at : at + 256]
            h = np.maximum(0, z[b] @ p[0] + p[1])
            o = h @ p[2] + p[3]
            o = np.exp(o - o.max(1, keepdims=True))
            o /= o.sum(1, keepdims=True)
            o[np.arange(len(b)), label[b]] -= 1
            o /= len(b)
            back = (o @ p[2].T) * (h > 0)
            step += 1
            for i, g in enumerate([z[b].T @ back, back.sum(0), h.T @ o, o.sum(0)]):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, *p)


def _usable(v: Column) -> Column:
    """Neither NULL nor zero, and every component a finite number."""
    whole = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(whole & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _sample(good: DataFrame) -> np.ndarray:
    """About ``SAMPLE`` vectors with the smallest hashes of their keys, all repeats of a key or none."""
    hashed = good.withColumn("h", F.xxhash64("id"))
    last = hashed.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    packed = hashed.where(F.col("h") <= F.lit(last)).orderBy("h", "v").limit(2 * SAMPLE).select(F.transform("v", lambda x: x.cast("float")).alias("v"))
    return np.array(packed.toArrow()["v"].to_pylist(), dtype=np.float64)


def nearest(
    rows: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", share: float = 0.75, least: int = 3,
) -> DataFrame:
    """(query_id, rank, ``key``, score): for each query its ``k`` nearest other rows found, by Euclidean distance in double precision.

    Vectors that are NULL, zero, hold NULL or non-finite components, or are not of the most frequent length, take no part; nor do rows
    with a NULL key. Ties go to the smaller key. A row never is its own neighbour, and neither are repeats of it under the same key;
    other repeated rows are found as often as they occur, and a query given twice is searched once, with its
    smallest vector. The number of parts grows with the root of the rows. A query looks into at least ``share`` of the parts
    (``least`` at least), and into more while these hold fewer than 20 rows per neighbour. Names in ``rows`` cannot clash: only two columns are read.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    good = rows.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v"), is_query.alias("q")).where(_usable(F.col("v")) & F.col("id").isNotNull())
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return good.limit(0).select(
            F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(key), F.lit(0.0).alias("score"))
    d, n = sizes["d"], sizes["count"]
    good = good.where(F.size("v") == d)
    parts = int(max(1, min(round(n**0.5 / 4), SAMPLE // 64)))
    router = learn_router(_sample(good), parts)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = np.argsort(-router.log_odds(_matrix(b.column(1))), axis=1, kind="stable").astype(np.int32)
            ranked = pa.array([o if q else o[:1] for o, q in zip(order.tolist(), b.column(2).to_pylist(), strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ranked], ["id", "v", "q", "parts"])

    stored = freeze(good.withColumn("q", F.coalesce("q", F.lit(False))).mapInArrow(routed, "id long, v array<double>, q boolean, parts array<int>"))
    held = {r["part"]: r["count"] for r in stored.groupBy(F.get("parts", F.lit(0)).alias("part")).count().collect()}  # a number per part
    probes = min(parts, max(least, int(np.ceil(share * parts))))
    rows_in = F.create_map(*[F.lit(x) for p in range(parts) for x in (p, held.get(p, 0))])
    queries = stored.where("q").groupBy("id").agg(F.min_by(F.struct("v", "parts"), F.col("v")).alias("s")).select("id", "s.v", "s.parts")
    running = F.transform("parts", lambda p: F.element_at(rows_in, p))
    needed = F.expr(f"filter(sequence(1, {parts}), i -> i >= {probes} and aggregate(slice(running, 1, i), 0L, (a, x) -> a + x) >= {20 * k})")
    queries = queries.withColumn("running", running).withColumn("_n", F.coalesce(F.get(needed, F.lit(0)), F.lit(parts)))
    looked = freeze(queries.select("id", "v", F.explode(F.slice("parts", F.lit(1), F.col("_n"))).alias("part")))
    asked = {r["part"]: r["count"] for r in looked.groupBy("part").count().collect()}

    def split(counts: dict[int, int], size: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for p in range(parts) for x in (p, max(1, -(-counts.get(p, 0) // size)))]), F.col("part"))

    base = stored.select("id", "v", F.get("parts", F.lit(0)).alias("part"))
    row_blocks, query_blocks = split(held, BLOCK_ROWS), split(asked, BLOCK_QUERIES)

    def every(blocks: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), blocks - 1))

    left = looked.withColumn("qb", F.pmod(F.xxhash64("id"), query_blocks).cast("int")).withColumn("rb", every(row_blocks))
    right = base.withColumn("rb", F.pmod(F.xxhash64("id"), row_blocks).cast("int")).withColumn("qb", every(query_blocks))

    def best(asking: pa.Table, found: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if asking.num_rows and found.num_rows:
            q, x = (_matrix(t["v"].combine_chunks()) for t in (asking, found))
            ids = found["id"].to_numpy()
            for qid, row in zip(asking["id"].to_pylist(), q, strict=True):
                score = np.sqrt(((x - row) ** 2).sum(1))
                score[ids == qid] = np.inf
                top = np.flatnonzero(score <= np.partition(score, min(k, len(score)) - 1)[min(k, len(score)) - 1])
                top = top[np.lexsort((ids[top], score[top]))][:k]
                top = top[np.isfinite(score[top])]
                out[0] += [qid] * len(top)
                out[1] += ids[top].tolist()
                out[2] += score[top].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "id", "score"])

    pairs = left.groupBy("part", "rb", "qb").cogroup(right.groupBy("part", "rb", "qb")).applyInArrow(best, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
