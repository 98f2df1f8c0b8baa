"""Shards of near equal bytes: a minimax partition of ordered groups of equal texts.

Only built-in functions touch rows. The driver holds one number for each of the ``CELLS`` hash cells, whatever the
number of rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.session import freeze

CELL_BITS = 16
CELLS = 1 << CELL_BITS
#: Rows of a cell are numbered in so many parts, so a group with a third of all rows is spread over as many keys.
PARTS = 1024


def smallest_capacity(sizes: Sequence[int], shards: int) -> int:
    """The smallest capacity with which a greedy pass over the ordered sizes fills no more than ``shards`` shards."""
    ends = list(accumulate(sizes))
    if not ends:
        return 0

    def feasible(capacity: int) -> bool:
        at = used = 0
        while at < len(ends) and used < shards:
            at = bisect_right(ends, (ends[at - 1] if at else 0) + capacity, lo=at)
            used += 1
        return at == len(ends)

    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def contiguous_cuts(sizes: Sequence[int], shards: int) -> list[int]:
    """First index of every shard but shard 0.

    No shard exceeds the smallest feasible capacity. Within it, a shard ends where it comes nearest to an equal share of
    what is left, as long as the rest still fits the shards that follow.
    """
    capacity, ends = smallest_capacity(sizes, shards), [0, *accumulate(sizes)]
    n = len(sizes)
    need = [0] * (n + 1)  # shards that a greedy pass needs from each index on
    for i in range(n - 1, -1, -1):
        need[i] = 1 + need[min(n, max(i + 1, bisect_right(ends, ends[i] + capacity) - 1))]
    cuts, at = [], 0
    for left in range(shards, 1, -1):
        most = bisect_right(ends, ends[at] + capacity) - 1
        least = bisect_left(need, -(left - 1), lo=at, hi=n + 1, key=lambda x: -x)  # need falls with the index
        goal = ends[at] + (ends[n] - ends[at]) / left
        j = bisect_left(ends, goal, lo=at)
        if j > at and goal - ends[j - 1] <= (ends[j] if j <= n else ends[n]) - goal:
            j -= 1
        at = min(max(j, least, at), most)
        cuts.append(at)
    return cuts


def shard_by_bytes(docs: DataFrame, shards: int = 24, text: str = "text", order: str = "doc_id") -> DataFrame:
    """(``order``, size, text_crc32, shard, slot) of every row.

    Equal texts form a group and share a shard; NULL counts as the empty text. Groups are ordered by a 64-bit hash of the text, and
    the atoms of the partition are the runs of whole groups whose hash shares its leading 16 bits. Size: UTF-8 bytes
    plus 8. Slots run from 0 without gaps in each shard. Repeated rows each take a slot; an empty table gives no rows.
    Other columns are left out, so clashing names do not matter.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.xxhash64(t)
    rows = freeze(docs.select(
        F.col(f"`{order}`").alias(order), (F.octet_length(t) + 8).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"), key.alias("_key"),
        F.shiftrightunsigned(key, 64 - CELL_BITS).cast("int").alias("_cell"),
        F.pmod(F.xxhash64(F.col(f"`{order}`"), key), F.lit(PARTS)).cast("int").alias("_part"),
    ))
    parts = rows.groupBy("_cell", "_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    cells = freeze(parts.groupBy("_cell").agg(F.sum("_bytes").alias("_bytes"), F.sum("_rows").alias("_rows")))
    found = sorted((r["_cell"], r["_bytes"]) for r in cells.select("_cell", "_bytes").collect())  # CELLS rows at most
    starts = [found[i][0] if i < len(found) else CELLS for i in contiguous_cuts([b for _, b in found], shards)]

    shard = sum(((F.col("_cell") >= s).cast("int") for s in starts), F.lit(0))
    in_shard = Window.partitionBy("shard").orderBy("_cell")  # CELLS rows in all
    in_cell = Window.partitionBy("_cell").orderBy("_part")  # PARTS rows at most
    before = cells.withColumn("shard", shard).select("_cell", "shard", (F.sum("_rows").over(in_shard) - F.col("_rows")).alias("_before"))
    offsets = (
        parts.withColumn("_earlier", F.sum("_rows").over(in_cell) - F.col("_rows"))
        .join(before, "_cell")
        .select("_cell", "_part", "shard", (F.col("_before") + F.col("_earlier")).alias("_offset"))
    )
    in_part = Window.partitionBy("_cell", "_part").orderBy(F.col(f"`{order}`"), "_key")
    return (
        rows.withColumn("_n", F.row_number().over(in_part) - 1)
        .join(offsets, ["_cell", "_part"])
        .select(F.col(f"`{order}`"), "size", "text_crc32", "shard", (F.col("_offset") + F.col("_n")).cast("long").alias("slot"))
    )
