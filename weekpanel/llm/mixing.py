"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken ``target / source size`` times. The whole part is certain. The fractions are rounded in
pairs: words move at random from one side of a pair to the other, until the fraction of one side is 0 or 1. The
words of a source stay the same in every such step and each fraction keeps its expectation. In a leaf of about
``LEAF_ROWS`` documents, the largest open document is paired with all smaller ones taken as one, so a small document is left open. The open
documents of the leaves are then paired one by one in a tree of groups of ``FAN_IN``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.session import freeze

LEAF_ROWS = 512
FAN_IN = 512
KEY = ["_key", "_null"]


def pivot(sizes: np.ndarray, fractions: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Round the fractions of one group, largest sizes first; also the index of the fraction that stays open, or -1."""
    p, rng, open_at = fractions.astype(float).tolist(), np.random.default_rng(seed & (2**63 - 1)), -1
    draws, s = rng.random(len(p)), sizes.tolist()
    for j in range(len(p)):
        if p[j] < 1e-9 or p[j] > 1 - 1e-9 or s[j] <= 0:
            p[j] = float(round(p[j]))
            continue
        if open_at < 0:
            open_at = j
            continue
        i = open_at
        up, down = min(s[i] * (1 - p[i]), s[j] * p[j]), min(s[i] * p[i], s[j] * (1 - p[j]))
        move = up if draws[j] * (up + down) < down else -down
        p[i], p[j] = p[i] + move / s[i], p[j] - move / s[j]
        done_i, done_j = (min(x, 1 - x) < 1e-9 for x in (p[i], p[j]))
        p[i], p[j] = (float(round(x)) if done else x for x, done in ((p[i], done_i), (p[j], done_j)))
        open_at = (-1 if done_j else j) if done_i else i
    return np.array(p, dtype=float), open_at


def pivot_equal(sizes: np.ndarray, fraction: float, seed: int) -> tuple[np.ndarray, int]:
    """As ``pivot`` for equal fractions: each document, largest first, is paired with all that follow, which keep one fraction."""
    p, rng = np.zeros(len(sizes)), np.random.default_rng(seed & (2**63 - 1))
    s, after = sizes.tolist(), (sizes.sum() - np.cumsum(sizes)).tolist()
    draws, f = rng.random(len(s)).tolist(), float(fraction)
    for i in range(len(s)):
        if f < 1e-9 or f > 1 - 1e-9 or s[i] <= 0:
            p[i:] = round(f)
            return p, -1
        if after[i] <= 0:
            p[i] = f
            p[i + 1 :] = round(f)
            return p, i
        up, down = min(s[i] * (1 - f), after[i] * f), min(s[i] * f, after[i] * (1 - f))
        move = up if draws[i] * (up + down) < down else -down
        p[i], f = f + move / s[i], f - move / after[i]
        if 1e-9 < p[i] < 1 - 1e-9:  # the rest is settled, this one stays open
            p[i + 1 :] = round(f)
            return p, i
        p[i] = round(p[i])
    return p, -1


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(_key, _null, source_size, target) from (_key, _null, source_size).

    Sources by code point, NULL last, take the weights in turn and share the total of all sizes. A target stops at
    ``most`` times its source's size; what is above is shared again by weight, until none is above.
    """
    ordered = freeze(_numbered(sizes).withColumn("_weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    ))
    cap = F.col("source_size") * float(most)
    total = ordered.agg(F.sum("source_size")).first()[0] or 0
    level, last = float("inf"), None
    while level != last:
        over = cap <= F.lit(level) * F.col("_weight") if last is not None else F.lit(False)
        capped, weight = ordered.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("_weight")))).first()
        last, level = level, ((total - (capped or 0.0)) / weight if weight else level)
    target = F.least(cap, F.lit(level) * F.col("_weight")) if total else F.lit(0.0)
    return ordered.select(*KEY, "source_size", target.cast("double").alias("target"))


def _numbered(sizes: DataFrame) -> DataFrame:
    """``_n``: the place of a source in code point order, NULL last, by offsets of range partitions."""
    part = F.spark_partition_id()
    ranged = freeze(sizes.repartitionByRange("_null", "_key").sortWithinPartitions("_null", "_key").withColumn("_part", part))
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())  # a row per partition
    before, seen = [], 0
    for k, n in counts:
        before.append((k, seen))
        seen += n
    offset = F.coalesce(*[F.when(F.col("_part") == k, F.lit(n)) for k, n in before], F.lit(0)) if before else F.lit(0)
    return ranged.withColumn("_id", F.monotonically_increasing_id()).select(
        *KEY, "source_size", (offset + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("_n")
    )


def mix(
    docs: DataFrame, size: Column, source: str = "source", order: str = "doc_id",
    weights: Sequence[float] = (5, 2, 1), most: float = 3.0,
) -> DataFrame:
    """(row, size, source_size, target, copies): ``row`` holds all columns of ``docs``, ``copies`` how often to take it.

    ``size`` must not be NULL. Documents of size 0 weigh nothing: their copies are the rounded factor of their source. The last open
    fraction of a source goes to the nearer whole number, so a source misses its target by half a document at most.
    Draws follow hashes of source, leaf and level, so reruns agree. Repeated rows are rounded one by one; NULL sources form one
    source; an empty table gives no rows. Names in ``docs`` cannot clash, as they stay inside ``row``.
    """
    s = F.col(f"`{source}`").cast("string")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.cast("long").alias("size"),
        F.coalesce(s, F.lit("")).alias("_key"), s.isNull().alias("_null"), F.xxhash64(F.col(f"`{order}`")).alias("_order"),
    )
    sums = freeze(rows.groupBy(*KEY).agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")))
    leaves = max(1, -(-(sums.agg(F.sum("_rows")).first()[0] or 0) // LEAF_ROWS))
    targets = source_targets(sums.select(*KEY, "source_size"), weights, most)
    factors = targets.withColumn("_leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(leaves - 1).cast("long"))))
    rows = rows.withColumn("_leaf", F.pmod(F.xxhash64("_order", "size"), F.lit(leaves)))

    def with_factor(df: DataFrame) -> DataFrame:
        factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        return df.join(factors, [*KEY, "_leaf"]).withColumn("_factor", factor)

    def rounded(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        sizes, factor = t["size"].to_numpy(), t["_factor"].to_numpy()
        at = np.lexsort((t["_order"].to_numpy(), -sizes))
        key = f"{t['_key'][0].as_py()}\0{t['_null'][0].as_py()}\0{t['_leaf'][0].as_py()}"
        whole = np.floor(factor + 1e-9)  # one factor for all documents of a source
        p, open_at = pivot_equal(sizes[at], max(0.0, factor[0] - whole[0]), _seed(key, 0))
        return at, whole, p, open_at

    def open_fraction(t: pa.Table) -> pa.Table:
        at, _, p, open_at = rounded(t)
        one = t.slice(0, 1).select([*KEY, "_leaf"]) if open_at >= 0 else t.slice(0, 0).select([*KEY, "_leaf"])
        found = [open_at] if open_at >= 0 else []
        return one.append_column("size", pa.array([t["size"][int(at[i])].as_py() for i in found], pa.int64())).append_column(
            "p", pa.array([float(p[i]) for i in found], pa.float64()))

    narrow = with_factor(rows.select(*KEY, "_leaf", "size", "_order")).groupBy(*KEY, "_leaf").applyInArrow(
        open_fraction, "_key string, _null boolean, _leaf long, size long, p double"
    )
    decided = _reduce(freeze(narrow), leaves)

    def settled(t: pa.Table) -> pa.Table:
        at, whole, p, open_at = rounded(t)
        if open_at >= 0:
            p[open_at] = t["_decided"][0].as_py()
        copies = np.empty(len(at))
        copies[at] = p
        row = t["row"].cast(_loose(t["row"].type))
        return t.select(["size", "source_size", "target"]).add_column(0, "row", row).append_column(
            "copies", pa.array(np.rint(copies + whole).astype(np.int64)))

    kind = rows.schema["row"].dataType.simpleString()
    full = with_factor(rows).join(decided, [*KEY, "_leaf"], "left")
    return full.groupBy(*KEY, "_leaf").applyInArrow(
        settled, f"row {kind}, size long, source_size long, target double, copies long"
    )


def _loose(kind: pa.DataType) -> pa.DataType:
    """The same type with no field required, as a schema given by text has it."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _loose(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, _loose(kind.value_type)))
    if pa.types.is_map(kind):
        return pa.map_(kind.key_type, _loose(kind.item_type))
    return kind


def _seed(key: str, level: int) -> int:
    return int.from_bytes(blake2b(f"{level}\0{key}".encode(), digest_size=8).digest(), "little")


def _meeting(level: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Round the open fractions that meet in one group of the tree."""
    def meet(t: pa.Table) -> pa.Table:
        sizes, leaf = t["size"].to_numpy(), t["_leaf"].to_numpy()
        at = np.lexsort((leaf, -sizes))
        key = f"{t['_key'][0].as_py()}\0{t['_null'][0].as_py()}\0{t['_group'][0].as_py()}"
        p, open_at = pivot(sizes[at], t["p"].to_numpy()[at], _seed(key, level))
        if last and open_at >= 0:
            p[open_at], open_at = float(round(p[open_at])), -1
        new, still = np.empty(len(at)), np.zeros(len(at), dtype=bool)
        new[at] = p
        if open_at >= 0:
            still[at[open_at]] = True
        return t.select([*KEY, "_leaf", "size"]).append_column("p", pa.array(new)).append_column("open", pa.array(still))

    return meet


def _reduce(found: DataFrame, leaves: int) -> DataFrame:
    """(_key, _null, _leaf, _decided): the open fractions of all leaves, rounded up a tree of groups of ``FAN_IN``."""
    level, width, done = 1, FAN_IN, None
    while True:
        last = width >= leaves
        met = freeze(
            found.withColumn("_group", F.floor(F.col("_leaf") / width)).groupBy(*KEY, "_group")
            .applyInArrow(_meeting(level, last), "_key string, _null boolean, _leaf long, size long, p double, open boolean")
        )
        closed = met.where(~F.col("open")).select(*KEY, "_leaf", F.col("p").alias("_decided"))
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        found, level, width = met.where("open").drop("open"), level + 1, width * FAN_IN
