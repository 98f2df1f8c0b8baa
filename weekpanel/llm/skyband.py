"""Source divergence audit: how far the word use of each source lies from its language and from the other sources of it.

The terms of a group (a source within a language) are ranked by how much more it uses them than its language does. The measure rises
with the group's count and falls with the count of the language, and equal measures are ranked by the term. So a term that ``k`` others
dominate (group count at least as high, language count at least as low, term earlier) can't be among the first ``k``. Partitions
retain the skyband of each group, the terms dominated by fewer than ``k`` others; skybands of skybands are merged, and what is left is
ranked exactly.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.operators.joins import broadcast_if_small
from weekpanel.session import freeze

HELD_TERMS = 500_000  # counted terms that a task holds before it passes them on
BLOCK = 128  # sources of a language that are compared at once
SLICE_TERMS = 4096  # terms of a language whose pair sums are made together
MERGES = 64  # partial skybands of a group are merged in so many parts first
SCALE = 1_000_000_000

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch], held_terms: int = HELD_TERMS) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents of a part of the rows; a group without terms gives a row with a NULL term."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurs, docs) in held.items():
            found = [None, *occurs]
            yield pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(lang, pa.string()), len(found)), pa.repeat(pa.scalar(source, pa.string()), len(found)), pa.array(found, pa.binary()),
                pa.array([0, *occurs.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, occurs)], pa.int64()),
            ], ["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in range(2)), b.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
            occurs, docs = held[lang, source]
            size -= len(occurs)
            found = text.translate(_TERM).split()
            occurs.update(found)
            docs.update(set(found))
            size += len(occurs)
            if size > held_terms:
                yield from rows()
                held.clear()
                size = 0
    yield from rows()


def skyband(high: np.ndarray, low: np.ndarray, terms: list[bytes], k: int) -> list[int]:
    """Places of the rows that fewer than ``k`` others dominate: ``high`` no less, ``low`` no more and the term earlier."""
    order = sorted(range(len(terms)), key=lambda i: (-int(high[i]), int(low[i]), terms[i]))
    place = {i: r for r, i in enumerate(sorted(range(len(terms)), key=terms.__getitem__))}
    kept: list[int] = []
    lows, places = np.empty(len(terms), dtype=np.int64), np.empty(len(terms), dtype=np.int64)
    for i in order:  # whatever dominates a row comes before it, and if k rows do, k retained ones do
        m = len(kept)
        if m < k or np.count_nonzero((lows[:m] <= low[i]) & (places[:m] < place[i])) < k:
            lows[m], places[m] = low[i], place[i]
            kept.append(i)
    return kept


BAND = "lang string, source string, term binary, n long, lang_n long, p long, q long"


def _retain(k: int):
    """The skyband of each group among the rows of a task, kept up batch by batch."""
    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands: dict[tuple[str, str], list[tuple]] = {}
        for b in batches:
            fresh = defaultdict(list)
            for lang, source, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fresh[lang, source].append(tuple(row))
            for key, rows in fresh.items():
                rows = bands.get(key, []) + rows
                n, lang_n = (np.array([r[c] for r in rows], dtype=np.int64) for c in (1, 2))
                bands[key] = [rows[i] for i in skyband(n, lang_n, [r[0] for r in rows], k)]
        flat = [(*key, *r) for key, rows in bands.items() for r in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in flat], t) for c, t in enumerate((pa.string(), pa.string(), pa.binary(), *[pa.int64()] * 4))],
            ["lang", "source", "term", "n", "lang_n", "p", "q"])
    return retain


def _share(count: str, total: str, size: str) -> Column:
    """``1 + (1000000000 * (count + 2)) div (total + 2 * size)``, exactly: beyond 64 bits in between."""
    wide = "cast({} as decimal(19, 0))"
    above = f"cast({SCALE} as decimal(10, 0)) * ({wide.format(count)} + 2)"
    return F.expr(f"1 + ({above}) div greatest({wide.format(total)} + 2 * {wide.format(size)}, 1)")


def _measure(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pair_sums(block: int):
    """Sums of the measure over the terms of a slice, for all pairs of sources of two blocks, and how many terms there were."""
    def pair_sums(groups: pa.Table, cells: pa.Table) -> pa.Table:
        a, b, lang = (groups[c][0].as_py() for c in ("a", "b", "lang"))
        places, absent = groups["place"].to_numpy(), groups["absent"].to_numpy()
        row = {t: i for i, t in enumerate(dict.fromkeys(cells["term"].to_pylist()))}
        column = {g: i for i, g in enumerate(places.tolist())}
        p = np.repeat(absent[None, :], len(row), axis=0)
        p[[row[t] for t in cells["term"].to_pylist()], [column[g] for g in cells["place"].to_pylist()]] = cells["p"].to_numpy()
        out, right = [], np.flatnonzero(places // block == b)
        for i in np.flatnonzero(places // block == a):
            own, others = p[:, i : i + 1], p[:, right]
            sums = ((own - others) ** 2 // (own + others)).sum(axis=0)
            out += [(int(places[i]), int(places[j]), int(v)) for j, v in zip(right, sums, strict=True) if places[i] < places[j]]
        return pa.table({
            "lang": pa.array([lang] * len(out), pa.string()), **{name: pa.array([r[c] for r in out], pa.int64()) for c, name in enumerate("xy")},
            "value": pa.array([r[2] for r in out], pa.int64()), "seen": pa.array([len(row)] * len(out), pa.int64()),
        })
    return pair_sums


def _pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language.

    Sources meet block by block and terms slice by slice, so no task holds a whole language; a term that neither source of a pair
    uses adds the same value each time and is only counted.
    """
    block = F.col("place") / BLOCK
    blocks = F.ceil(F.col("n_groups") / BLOCK)
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.struct(
        F.least(x, F.floor(block)).alias("a"), F.greatest(x, F.floor(block)).alias("b"))))
    slices = F.greatest(F.ceil(F.col("size") / SLICE_TERMS), F.lit(1))
    placed = groups.select("lang", "place", "absent", slices.alias("slices"), pair.alias("pair")).select(
        "lang", "pair.*", "place", "absent", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    met = cells.select("lang", "term", "place", "p", F.pmod(F.xxhash64("term"), slices).alias("slice"), pair.alias("pair")).select(
        "lang", "pair.*", "slice", "term", "place", "p")
    keys = ["lang", "a", "b", "slice"]
    sums = placed.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(_pair_sums(BLOCK), "lang string, x long, y long, value long, seen long")
    known = sums.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    side = [groups.select("lang", F.col("place").alias(c), F.col("source").alias(f"{c}_source"), F.col("absent").alias(f"{c}_absent"), *more)
            for c, more in (("x", ["size"]), ("y", []))]
    whole = known.join(side[0], ["lang", "x"]).join(side[1], ["lang", "y"]).select(
        "lang", "x_source", "y_source", (F.col("value") + (F.col("size") - F.col("seen")) * _measure("x_absent", "y_absent")).alias("value"))
    both = F.explode(F.array(F.struct(F.col("x_source").alias("source"), F.col("y_source").alias("item")),
                             F.struct(F.col("y_source").alias("source"), F.col("x_source").alias("item"))))
    return whole.select("lang", "value", both.alias("s")).select("lang", "s.source", "s.item", "value")


def divergence_audit(docs: DataFrame, k: int = 10, min_docs: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source) of ``docs`` (text, lang, source).

    Part ``pair``: the other sources of the language, by their divergence from the group, all of them. Part ``term``: the ``k`` terms that the
    group uses most above its language. Shares are ``1 + (1000000000 * (count + 2)) div (N + 2 * V)`` over the V terms in at least
    ``min_docs`` documents of the language, the measure is ``(p - q) ** 2 div (p + q)``, all in whole numbers. Ranks run by
    value, highest first, then by UTF-8.

    NULL in any of the three columns counts as ''. A group without terms has pairs all the same, a language with one source has none, and
    where no term is kept values are 0 and there is no part ``term``. Repeated rows count each time. An empty table gives no rows; other
    columns are left out.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = docs.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").cast("binary").alias("text"))
    counted = source.mapInArrow(partial(_counted, held_terms=HELD_TERMS), "lang string, source string, term binary, n long, docs long")
    table = freeze(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = freeze(
        table.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("d"))
        .where(F.col("d") >= min_docs).select("lang", "term", "lang_n")
    )
    used = freeze(table.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("lang_n").alias("lang_total"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = Window.partitionBy("lang")  # the sources of a language: every pair of them is a row of the result
    groups = freeze(
        table.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        .na.fill(0, ["total", "size", "lang_total"])
        .select("*", (F.row_number().over(of_lang.orderBy("source")) - 1).cast("long").alias("place"), F.count("*").over(of_lang).alias("n_groups"))
        .withColumn("absent", _share("0", "total", "size"))
    )
    cells = freeze(used.join(broadcast_if_small(groups), ["lang", "source"]).select(
        "lang", "source", "place", "n_groups", "size", "term", "n", "lang_n",
        _share("n", "total", "size").alias("p"), _share("lang_n", "lang_total", "size").alias("q")))

    band = cells.where("p > q").select("lang", "source", "term", "n", "lang_n", "p", "q")
    merged = band.mapInArrow(_retain(k), BAND).repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(MERGES)))
    merged = merged.mapInArrow(_retain(k), BAND).repartition("lang", "source").mapInArrow(_retain(k), BAND)
    terms = merged.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), _measure("p", "q").alias("value"))
    pairs = _pairs(groups, cells).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = terms.unionByName(pairs).withColumn("rank", F.row_number().over(by))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= k)).select("lang", "source", "part", "item", "value", "rank")
