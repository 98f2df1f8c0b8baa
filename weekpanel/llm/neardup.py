"""MinHash near-duplicates by an LSH forest.

Each text becomes a set of word shingles and a MinHash signature of ``TREES`` labels of ``DEPTH`` values. A tree orders the texts by one
label; texts that share the first ``FIRST`` values of it form a region. A region that is too large is entered deeper, value by value, and its random
parts are looked at as well. Inside a region, signatures are compared and pairs that may reach the similarity become candidates: all of them where they are
few; in a dense region at first only those of the longest agreement and with the members that most others agree with. Candidates are confirmed on
full sets. When the confirmed links are joined to components, dense regions are gone through again for every candidate between different
components, so no pair that a region shows is passed over. Regions that are too large even at the last depth follow: where their members
belong to several components, all parts of such a region are compared with each other, part against part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.session import freeze

TREES, DEPTH, FIRST = 24, 6, 3
REGION = 768  # members of a region that are compared with each other
PART_TREES = 4  # in one of so many trees the random parts of a large region are compared as well
PART = 2048  # members of a part of a region that is too large at the last depth
NEAREST, HUBS = 1, 1  # first candidates of a member of a dense region
ERRORS = 3.5  # standard errors that an estimate may lie below the wanted similarity
FINE = 1024  # values of the finer signature, for the members of dense regions
BLOCK_PAIRS = 3000
HASHED = 1 << 17  # hashes held at once
KEPT_WORDS = 100_000
#: Up to so many ids (8 bytes each) are broadcast to find the texts of candidates; beyond it the texts are shuffled to them.
BROADCAST_IDS = 2_000_000
SALTS = 8
PARTITION_ROWS = 50_000  # narrow rows of a link or a label to a partition

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_FINE_A = _rng.integers(0, 1 << 63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FINE_B = _rng.integers(0, 1 << 63, FINE, dtype=np.uint64)
_PLACES = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return a ^ (a >> np.uint64(32))


class Shingles:
    """Sorted 64-bit numbers of the distinct shingles of a text; a worker keeps the numbers of its last words."""

    def __init__(self, width: int):
        self.width, self.known = width, _Words()

    def __call__(self, text: bytes | None) -> np.ndarray:
        found = (text or b"").lower().split()
        if len(self.known) > KEPT_WORDS:
            self.known = _Words()
        h = np.fromiter(map(self.known.__getitem__, found), dtype=np.uint64, count=len(found))
        if not len(h):
            return h
        width = min(self.width, len(h))
        sums = (sliding_window_view(h, width) * _PLACES[:width]).sum(axis=1, dtype=np.uint64)
        return np.unique(_mixed(sums + np.uint64(width)))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def signature(shingles: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """16 bits of the smallest value under each of the hashes, TREES * DEPTH in all if none are given."""
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, HASHED // len(a))
    for at in range(0, len(shingles), step):
        least = np.minimum(least, (shingles[None, at : at + step] * a[:, None] + b[:, None]).min(axis=1))
    return _mixed(least).astype("<u2")


def _least_agreement(similarity: float, values: int) -> float:
    return similarity - ERRORS * (similarity * (1 - similarity) / values) ** 0.5


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    digest = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), dtype="<i8")
    return int(digest[0]), int(digest[1])


def _sketch(width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = Shingles(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                n, keys, signatures, short = [], [], [], []
                for t in b.column(1).cast(pa.large_binary()).to_pylist():
                    s = shingles_of(t)
                    n.append(len(s))
                    keys.append(_set_key(s) if len(s) else (None, None))
                    values = signature(s) if len(s) else None
                    signatures.append(values.tobytes() if len(s) else None)
                    short.append(values.astype(np.uint8).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([k for k, _ in keys], pa.int64()),
                     pa.array([k for _, k in keys], pa.int64()), pa.array(signatures, pa.binary()), pa.array(short, pa.binary())],
                    ["id", "h", "n", "k1", "k2", "sig", "short"])
    return sketch


def _few(df: DataFrame, rows: int) -> DataFrame:
    """As many partitions as ``rows`` narrow rows fill, so small tables do not spread over many tiny files; not for the rows of a join,
    which would run in so few tasks."""
    return df.coalesce(max(1, -(-rows // PARTITION_ROWS)))


def _regions(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(region, cid): the members of every region, ``REGION`` at most, for all trees; a class stands in several regions.

    And (region, tree, cid) of the regions that are larger at the last depth, if any, of which the first table holds random parts only.
    """
    def prefix(depth: int) -> Column:
        return F.xxhash64("tree", F.substring(F.col("sig"), F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * depth)))

    rows = classes.select("cid", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    found, current, depth, large = [], rows, FIRST, None
    while True:
        tagged = current.select("cid", "tree", prefix(depth).alias("region"))
        sizes = freeze(tagged.groupBy("region").count().where("count > 1"))
        largest = sizes.agg(F.max("count")).first()[0] or 0
        members = tagged.join(sizes, "region")
        if largest <= REGION:
            found.append(members.select("region", "cid"))
            break
        members = freeze(members)
        found.append(members.where(F.col("count") <= REGION).select("region", "cid"))
        over = members.where(F.col("count") > REGION)
        part = F.pmod(F.xxhash64("cid", "tree"), F.ceil(F.col("count") / (REGION / 2)))
        parts = over.select("tree", F.xxhash64("region", part).alias("region"), "cid")
        if depth == DEPTH:
            found.append(parts.select("region", "cid"))
            large = over.select("region", "tree", "cid")
            break
        if depth == FIRST:  # a large group of copies is joined in its random parts, long before its small regions are looked at
            found.append(parts.where(F.col("tree") % PART_TREES == 0).select("region", "cid"))
        current, depth = over.select("cid", "tree").join(classes, "cid"), depth + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, large


def _blocks(large: DataFrame, labels: DataFrame) -> DataFrame:
    """(region, side, tree, cid, label): blocks of two parts of a region, under the name of a region, that together hold all pairs of
    members of different components.

    Members of a component that fills a part stand in parts of their own, which are not compared with each other. ``side`` is 0 and 1 for the
    parts of a block, 2 where a part meets itself.
    """
    rows = large.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    n = large.count()
    rows = freeze(rows)
    several = freeze(rows.groupBy("region").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("region"))
    rows = rows.join(several, "region", "left_semi")
    owned = freeze(_few(rows.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n")), n))
    big = freeze(owned.where(F.col("n") > PART))
    rest = freeze(owned.where(F.col("n") <= PART).groupBy("region").agg(F.sum("n").alias("rest")))
    dealt = rows.join(big, ["region", "label"], "left").join(rest, "region", "left").withColumn("pure", F.when(F.col("n").isNotNull(), F.col("label")))
    alone = F.xxhash64("region", "label", F.pmod(F.xxhash64("cid"), F.ceil(F.col("n") / PART)))
    part = F.when(F.col("pure").isNotNull(), alone).otherwise(F.xxhash64("region", F.pmod(F.xxhash64("label"), F.ceil(F.col("rest") / PART))))
    dealt = freeze(dealt.select("region", "tree", "cid", "label", "pure", part.alias("part")))
    parts = freeze(_few(dealt.select("region", "part", "pure").distinct(), n))
    others = parts.select("region", F.col("part").alias("other"), F.col("pure").alias("other_pure"))
    pairs = parts.join(others, "region").where("part <= other and not coalesce(pure = other_pure, false)")
    block = F.xxhash64("region", "part", "other").alias("block")
    sides = pairs.select(block, "part", F.when(F.col("part") == F.col("other"), 2).otherwise(0).alias("side")).unionByName(
        pairs.where("part <> other").select(block, F.col("other").alias("part"), F.lit(1).alias("side")))
    return dealt.join(sides, "part").select(F.col("block").alias("region"), "side", "tree", "cid", "label")


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one region each, from batches sorted by region."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        region = t["region"].to_numpy()
        first = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
        for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield t.slice(s, e - s)
        rest = t.slice(int(first[-1])) if len(first) else None
    if rest is not None and rest.num_rows:
        yield rest


def _candidates(similarity: float, again: bool):
    """Pairs of one region whose signatures agree; ``again``: all that join different components, else the first ones."""
    least, least_fine = (_least_agreement(similarity, v) for v in (TREES * DEPTH, FINE))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]
        size = 0
        for t in _sorted_groups(batches):
            m = t.num_rows
            if m < 2:
                continue
            sig = np.frombuffer(b"".join(t["short"].to_pylist()), dtype=np.uint8).reshape(m, -1)
            n, cid = t["n"].to_numpy(), t["cid"].to_numpy()
            agree = np.empty((m, m), dtype=np.float32)
            for at in range(0, m, 64):
                agree[at : at + 64] = (sig[at : at + 64, None] == sig[None]).mean(axis=2, dtype=np.float32)
            fit = (agree >= least) & (np.minimum(n[:, None], n[None]) >= similarity * np.maximum(n[:, None], n[None]))
            np.fill_diagonal(fit, False)
            if again:
                label = t["label"].to_numpy()
                fit &= label[:, None] != label[None]
                dense = False
            else:
                dense = fit.sum() > 2 * (NEAREST + HUBS) * m
            if dense:
                chosen = np.zeros_like(fit)
                hubs = np.argsort(-(agree * fit).sum(1), kind="stable")[:HUBS]
                chosen[:, hubs] = chosen[hubs] = True
                top = np.argpartition(-(agree * fit), NEAREST, axis=1)[:, :NEAREST]
                chosen[np.repeat(np.arange(m), top.shape[1]), top.ravel()] = True
                fit &= chosen | chosen.T
            i, j = np.nonzero(np.triu(fit, 1))
            if again and len(i):
                fine = np.frombuffer(b"".join(t["fine"].to_pylist()), dtype=np.uint8).reshape(m, -1)
                near = np.concatenate([(fine[i[k : k + 2048]] == fine[j[k : k + 2048]]).mean(axis=1) for k in range(0, len(i), 2048)]) >= least_fine
                i, j, here = i[near], j[near], t["region"][0].as_py()
                own = {k: frozenset(t["regions"][k].as_py()) for k in {*i.tolist(), *j.tolist()}}
                once = np.array([min(own[x] & own[y]) == here for x, y in zip(i.tolist(), j.tolist(), strict=True)], dtype=bool)
                i, j = i[once], j[once]  # a pair that stands in several regions comes from the first
            if len(i):
                out[0].append(np.minimum(cid[i], cid[j]))
                out[1].append(np.maximum(cid[i], cid[j]))
                out[2].append(np.full(len(i), t["region"][0].as_py() if dense else 0))
                size += len(i)
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b", "dense"])
                out, size = [[], [], []], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b", "dense"])
    return pairs


def _across(similarity: float):
    """Pairs of different components from a block of parts whose signatures agree; a pair of several regions comes from its first tree."""
    least, least_fine = (_least_agreement(similarity, v) for v in (TREES * DEPTH, FINE))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _sorted_groups(batches):
            m = t.num_rows
            sig, fine = (np.frombuffer(b"".join(t[c].to_pylist()), dtype=np.uint8).reshape(m, -1) for c in ("short", "fine"))
            n, cid, label, side, tree = (t[c].to_numpy() for c in ("n", "cid", "label", "side", "tree"))
            homes, listed = np.zeros((m, TREES), dtype=np.int64), t["homes"].combine_chunks()
            of = np.repeat(np.arange(m), listed.value_lengths().to_numpy())
            homes[of, listed.flatten().field("tree").to_numpy()] = listed.flatten().field("region").to_numpy()
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            values = np.ascontiguousarray(sig[right].T)
            for at in range(0, len(left), 64):
                rows = left[at : at + 64]
                agree = np.zeros((len(rows), len(right)), dtype=np.uint8)  # TREES * DEPTH < 256
                for k, v in enumerate(values):
                    agree += sig[rows, k, None] == v[None]
                small, big = np.minimum(n[rows, None], n[None, right]), np.maximum(n[rows, None], n[None, right])
                i, j = np.nonzero((agree >= least * TREES * DEPTH) & (small >= similarity * big) & (label[rows, None] != label[None, right]))
                i, j = rows[i], right[j]
                if side[0] == 2:
                    i, j = i[i < j], j[i < j]
                for k in range(0, len(i), 2048):
                    x, y = i[k : k + 2048], j[k : k + 2048]
                    near = (fine[x] == fine[y]).mean(axis=1) >= least_fine
                    x, y = x[near], y[near]
                    first = ((homes[x] == homes[y]) & (homes[x] != 0)).argmax(axis=1) == tree[0]
                    x, y = cid[x[first]], cid[y[first]]
                    if len(x):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.zeros(len(x), dtype=np.int64))], ["a", "b", "dense"])
    return pairs


def _in_regions(members: DataFrame, classes: DataFrame, function) -> DataFrame:
    rows = members.join(classes, "cid")  # a member of a region meets its signature, then the region its members
    parts = max(2, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "region").sortWithinPartitions("region", "cid").mapInArrow(function, "a long, b long, dense long")


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fine = [signature(np.frombuffer(s, dtype=np.uint64), _FINE_A, _FINE_B).astype(np.uint8).tobytes() for s in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fine, pa.binary())], ["cid", "fine"])


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links enough to join all pairs whose full sets reach the similarity: of each block, its members with their smallest one.

    Pairs meet in blocks by their smaller member, and a block gets every set it needs once. A member with more than
    ``BLOCK_PAIRS`` pairs is spread over several blocks.
    """
    n = pairs.count()
    blocks = max(1, -(-n // BLOCK_PAIRS))
    pairs = _few(pairs, n)
    heavy = pairs.groupBy("a").count().where(F.col("count") > BLOCK_PAIRS).withColumnRenamed("count", "n_a")
    part = F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("n_a", F.lit(1)) / BLOCK_PAIRS))
    block = F.pmod(F.xxhash64("a", part), F.lit(blocks))
    blocked = freeze(pairs.join(heavy, "a", "left").select(block.alias("block"), "a", "b"))
    needed = _few(blocked.select(F.col("block").alias("at"), F.explode(F.array("a", "b")).alias("cid")).distinct(), 2 * n).join(sets, "cid")
    hundredths = round(100 * similarity)

    def compare(asked: pa.Table, found: pa.Table) -> pa.Table:
        own = {c: np.frombuffer(s, dtype=np.uint64) for c, s in zip(found["cid"].to_pylist(), found["set"].to_pylist(), strict=True)}
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = c = root[root[c]]
            return c

        for a, b in zip(asked["a"].to_pylist(), asked["b"].to_pylist(), strict=True):
            if find(a) == find(b):  # joined through others already
                continue
            x, y = own[a], own[b]
            both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            if 100 * both >= hundredths * (len(x) + len(y) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
        links = [(find(c), c) for c in root if find(c) != c]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return blocked.groupBy("block").cogroup(needed.groupBy("at")).applyInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(cid, label) of every node with an edge: the smallest node it reaches. Labels spread along edges and jump to labels of labels."""
    n = 2 * edges.count()
    both = freeze(_few(_few(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), n).distinct(), n))
    labels = freeze(_few(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cid"), F.least("a", "m").alias("label")), n))
    while True:
        roots = labels.select(F.col("cid").alias("root"), F.col("label").alias("further"))
        told = both.join(labels.withColumnRenamed("cid", "b"), "b").select(F.col("a").alias("cid"), "label", F.lit(None).cast("long").alias("old"))
        jumped = labels.join(roots, labels["label"] == roots["root"]).select("cid", F.col("further").alias("label"), F.col("label").alias("old"))
        heard = told.unionByName(jumped).groupBy("cid").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        after = freeze(_few(heard, n))
        labels = after.select("cid", "label")
        if after.where("label <> old").isEmpty():
            return labels


def _joined(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Labels after new links between components: only the labels are joined."""
    if new.isEmpty():
        return labels
    of = labels.select(F.col("cid").alias("at"), F.col("label").alias("to"))
    for side in ("a", "b"):
        new = new.join(of, new[side] == of["at"], "left").withColumn(side, F.coalesce("to", side)).drop("at", "to")
    joined = components(freeze(new.where("a <> b"))).select(F.col("cid").alias("label"), F.col("label").alias("further"))
    alone = joined.select(F.col("label").alias("cid"), "label").join(labels, "cid", "left_anti")
    return freeze(labels.unionByName(alone).join(joined, "label", "left").select("cid", F.coalesce("further", "label").alias("label")))


def near_duplicates(docs: DataFrame, similarity: float = 0.75, width: int = 5, order: str = "doc_id", text: str = "text") -> DataFrame:
    """(``order``, n_shingles, component_id, kept, text_hash) of every row; ``text_hash`` is ``xxhash64`` of the text.

    Words are runs without ASCII blanks, A-Z in lower case. Rows with equal sets are one class and are linked through it; texts with fewer
    words than ``width`` are one shingle; NULL and empty texts have no set and are linked with nothing. ``component_id`` is the smallest
    id reachable. Rows repeated under one id are all kept or not; rows of one id with different texts are judged each by its own text. Rows
    with a NULL id take no part, have no component and are kept. An empty table gives no rows. Other columns are left out.
    """
    source = docs.select(F.col(f"`{order}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = freeze(source.withColumn("h", F.xxhash64("text")).mapInArrow(_sketch(width), "id long, h long, n long, k1 long, k2 long, sig binary, short binary"))
    some = rows.where("n > 0 and id is not null")
    classes = freeze(some.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("short").alias("short"))
                     .withColumnRenamed("k1", "cid").drop("k2"))
    members, large = _regions(classes.select("cid", "sig"))
    members = freeze(members)
    shown = classes.select("cid", "n", "short")
    first = freeze(_in_regions(members, shown, _candidates(similarity, again=False)))
    shown_pairs = first.count()
    pairs = freeze(_few(_few(first.select("a", "b"), shown_pairs).distinct(), shown_pairs))

    # Every text that a candidate pair of a dense region may need later has a pair now, so the sets are made once.
    paired = pairs.select(F.explode(F.array("a", "b")).alias("cid"))
    paired = paired if large is None else paired.unionByName(large.select("cid"))
    wanted = freeze(paired.distinct().join(classes.select("cid", "rep"), "cid"))
    ids = wanted.select(F.col("rep").alias("id")).distinct()
    texts = source.join(F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids, "id")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = Shingles(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                found = [shingles_of(t) for t in whole.column(1).slice(at, 1024).cast(pa.large_binary()).to_pylist()]
                found = [s for s in found if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_set_key(s)[0] for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["cid", "set"])

    sets = freeze(texts.select("id", "text").mapInArrow(full_sets, "cid long, set binary"))
    sets = sets.dropDuplicates(["cid"]) if sets.count() > wanted.count() else sets
    links = freeze(_confirm(pairs, sets, similarity))
    labels = components(links)
    dense = first.where("dense <> 0").select(F.col("dense").alias("region")).distinct()
    if not dense.isEmpty():
        inner = freeze(members.join(dense, "region", "left_semi"))
        finer = sets.join(inner.select("cid").distinct(), "cid", "left_semi").mapInArrow(_finer, "cid long, fine binary")
        places = inner.groupBy("cid").agg(F.collect_set("region").alias("regions"))  # a few for each tree at most
        labelled = shown.join(finer, "cid").join(places, "cid").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        more = _in_regions(inner, labelled, _candidates(similarity, again=True)).select("a", "b")
        more = freeze(more.join(pairs, ["a", "b"], "left_anti"))
        labels = _joined(labels, freeze(_confirm(more, sets, similarity)))
    if large is not None:
        blocks = freeze(_blocks(large, labels))
        if not blocks.isEmpty():
            of = blocks.select("cid").distinct()
            finer = sets.join(of, "cid", "left_semi").mapInArrow(_finer, "cid long, fine binary")
            homes = large.groupBy("cid").agg(F.collect_list(F.struct("tree", "region")).alias("homes"))  # one for each tree at most
            more = _in_regions(blocks, shown.join(finer, "cid").join(homes, "cid"), _across(similarity)).select("a", "b")
            more = freeze(more.join(pairs, ["a", "b"], "left_anti"))
            labels = _joined(labels, freeze(_confirm(more, sets, similarity)))

    found = classes.select("cid", "rep").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    smallest = found.groupBy("label").agg(F.min("rep").alias("component_id"))
    known = freeze(found.join(smallest, "label").select("cid", "component_id"))
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.select(
        "id", "h", "n", F.when(F.col("id").isNotNull(), F.col("k1")).alias("cid"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
    ).join(salted, ["cid", "salt"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(order), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.col("h").alias("text_hash"),
    )
