"""Ranked lexical search over bit-sliced Bloom signatures.

Documents of similar size share a block. Each has a Bloom signature of its terms and of how often they occur (a term that occurs
five times is entered at the levels 1, 2, 3 and 4), and the block keeps the signatures by slices: slice ``b`` is the bitmap of the
documents whose bit ``b`` is set. The slices of a term, joined by AND, show all documents that may hold it, and the highest level shown
bounds how often. The weighted sum of these bounds is never below a document's score, so a document whose bound is below the
k-th best score found so far is excluded for certain; every other one is scored exactly from its text, which lies in the same block.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.llm.common import WordHashes
from weekpanel.session import shared_dir
from weekpanel.sources.upsert import fresh_path

LEVELS = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512, 1024]
BITS, HASHES = 10, 4  # bits of a signature for each entry that its block has room for; bits set by an entry
CELLS, ROWS, BLOCK_BYTES = 1 << 23, 1024, 1 << 21  # bits, documents and text of a block
ITEMS, ITEM_BYTES = 1000, 1 << 22  # items, and bytes of their texts, that are searched at once
KEPT_WORDS = 400_000
SCORE_COLUMNS = 256  # documents whose bounds are held at once

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case."""
    return (text or b"").translate(_TERM).split()


def _bits(hashes: np.ndarray, level: int, m: int) -> np.ndarray:
    """The bits that entries set, HASHES for each."""
    h = (hashes ^ np.uint64(level * 0x9E3779B1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (((h & np.uint64(0xFFFFFFFF))[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(m)).astype(np.int64)


INDEX = ("ids array<long>, sizes array<long>, m long, slices binary, texts array<binary>, n_docs long, n_terms long, "
         "found array<struct<term: int, docs: long>>")


def _index(vocabulary: dict[bytes, int]):
    """Blocks of signatures; with each, in how many of its documents the terms of the vocabulary occur."""
    def block(rows: list[tuple], m: int) -> pa.RecordBatch:
        width = -(-len(rows) // 8) * 8
        cells, docs = np.zeros((m, width), dtype=bool), Counter()
        for at, (_, _, _, entries, known) in enumerate(rows):
            docs.update(known)
            for level, hashes in entries:
                cells[_bits(hashes, level, m).ravel(), at] = True
        sizes = [r[1] for r in rows]
        found = [{"term": t, "docs": n} for t, n in docs.items()]
        return pa.RecordBatch.from_arrays([
            pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([m], pa.int64()),
            pa.array([np.packbits(cells, axis=1).tobytes()], pa.binary()), pa.array([[r[2] for r in rows]], pa.list_(pa.binary())),
            pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64()),
            pa.array([found], pa.list_(pa.struct([("term", pa.int32()), ("docs", pa.int64())]))),
        ], ["ids", "sizes", "m", "slices", "texts", "n_docs", "n_terms", "found"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of, open_, held = WordHashes(), defaultdict(list), Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                if len(hash_of) > KEPT_WORDS:
                    hash_of = WordHashes()
                counts = Counter(terms(text))
                if not counts:  # no term, no score
                    continue
                hashes = np.fromiter(map(hash_of.__getitem__, counts), dtype=np.uint64, count=len(counts))
                tf = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                entries = [(level, hashes[tf >= level]) for level in LEVELS if level <= tf.max()]
                room = 1 << max(5, (sum(len(h) for _, h in entries) - 1).bit_length())
                known = [vocabulary[t] for t in counts.keys() & vocabulary.keys()]
                open_[room].append((doc_id, int(tf.sum()), text, entries, known))
                held[room] += len(text)
                full = max(8, min(ROWS, CELLS // (BITS * room)))
                if len(open_[room]) >= full or held[room] > BLOCK_BYTES:
                    held.pop(room)
                    yield block(open_.pop(room), BITS * room)
        for room, rows in open_.items():
            yield block(rows, BITS * room)
    return index


def term_bounds(slices: np.ndarray, hashes: np.ndarray, m_doc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each term and document, the most that ``(1000000000 * tf) div (1000 * tf + 20 * m)`` can be; 0 where the term is absent for certain."""
    bounds = np.zeros((len(hashes), len(sizes)), dtype=np.int64)
    active, before = np.arange(len(hashes)), None
    for level, above in zip(LEVELS, [*LEVELS[1:], None], strict=True):
        shown = np.bitwise_and.reduce(slices[_bits(hashes[active], level, len(slices))], axis=1)
        shown = shown if before is None else shown & before
        some = shown.any(axis=1)
        active, before = active[some], shown[some]
        if not len(active):
            break
        most = sizes if above is None else np.minimum(sizes, above - 1)
        most = np.maximum(most, 1)
        reach = 1_000_000_000 * most // (1000 * most + 20 * m_doc)
        present = np.unpackbits(before, axis=1)[:, : len(sizes)].astype(bool)
        bounds[active] = np.where(present, reach, bounds[active])
    return bounds


def _search(items: list[tuple[int | None, list[int]]], vocabulary: dict[bytes, int], weights: list[int], n: int, length: int, k: int):
    """The ``k`` best documents of each item among the blocks of a task."""
    names = list(vocabulary)
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in names], dtype=np.uint64)
    weight = np.array(weights, dtype=np.int64)
    wanted = [np.array(t, dtype=np.int64) for _, t in items]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]
        for b in batches:
            for row in range(b.num_rows):
                ids, sizes, m, slices, texts = (b.column(c)[row].as_py() for c in range(5))
                packed = np.frombuffer(slices, dtype=np.uint8).reshape(m, -1)
                m_docs = [50 + (50 * s * n) // length for s in sizes]
                for at in range(0, len(ids), SCORE_COLUMNS):
                    to = min(len(ids), at + SCORE_COLUMNS)
                    part = term_bounds(packed[:, at // 8 : -(-to // 8)], hashes, np.array(m_docs[at:to], dtype=np.int64),
                                       np.array(sizes[at:to], dtype=np.int64)) * weight[:, None]
                    counts: dict[int, dict[int, int]] = {}
                    for i, own in enumerate(wanted):
                        bound = part[own].sum(axis=0)
                        least = best[i][0][0] if len(best[i]) == k else 1
                        open_ = np.flatnonzero(bound >= max(least, 1))
                        for d in open_[np.argsort(-bound[open_], kind="stable")]:
                            if len(best[i]) == k and bound[d] < best[i][0][0]:
                                break
                            here = at + int(d)
                            if here not in counts:
                                found = Counter(terms(texts[here]))
                                counts[here] = {vocabulary[t]: found[t] for t in found.keys() & vocabulary.keys()}
                            tf, slow = counts[here], 20 * m_docs[here]
                            score = sum(weights[t] * (1_000_000_000 * tf[t] // (1000 * tf[t] + slow)) for t in items[i][1] if t in tf)
                            if score > 0:
                                entry = (score, -math.inf if ids[here] is None else -ids[here])
                                (heapq.heappush if len(best[i]) < k else heapq.heappushpop)(best[i], entry)
        out = [(items[i][0], None if d == -math.inf else -d, s) for i, top in enumerate(best) for s, d in top]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])
    return search


def weight_of(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` best documents (doc_id, text) of every item (item_id, text): (item_id, rank, doc_id, score).

    Terms, weights and scores are whole numbers as in ``weight_of`` and ``term_bounds``, with ``m = 50 + (50 * size * N) div L``. Equal scores
    are ranked by ascending doc_id, NULL last. NULL and texts without a term match nothing, an item without terms or without a match has
    no rows; rows that repeat an item_id are one item with all their terms; rows that repeat a doc_id are documents of their own,
    each with its own rank. Empty tables give no rows; other columns are left out.

    Items are searched in blocks of bounded number and size, and each block reads the documents once to index them and the index
    once to search it. A task keeps ``k`` entries for each item of the block and nothing but those is shuffled.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long"), F.col("text").cast("binary"))
    count, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // ITEMS), -(-size // ITEM_BYTES))
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        of_item: dict[int | None, set[bytes]] = defaultdict(set)
        for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():  # bounded by ITEMS and ITEM_BYTES
            of_item[r["item_id"]].update(terms(bytes(r["text"] or b"")))
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*of_item.values())))}
        if not vocabulary:
            continue
        path = fresh_path(shared_dir(spark))
        source.mapInArrow(_index(vocabulary), INDEX).write.option("compression", "zstd").parquet(path)
        index = spark.read.parquet(path)
        n, length = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        if not n:
            continue
        found = index.select(F.explode("found").alias("f")).groupBy("f.term").agg(F.sum("f.docs").alias("docs"))
        df = {r["term"]: r["docs"] for r in found.collect()}  # a number for each term of the block of items
        weights = [weight_of(n, df.get(t, 0)) for t in range(len(vocabulary))]
        wanted = [(i, [vocabulary[t] for t in sorted(ts)]) for i, ts in of_item.items()]
        best = index.select("ids", "sizes", "m", "slices", "texts").mapInArrow(
            _search(wanted, vocabulary, weights, n, length, k), "item_id long, doc_id long, score long")
        out = out.unionByName(best)
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
