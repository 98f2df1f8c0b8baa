"""Removal of repeated passages by matching statistics over suffix automata.

A passage counts as repeated when a window of ``window`` words also starts in a document with a smaller id. The reference is the first
copy of every such passage; it is dealt to shards of bounded size, each shard becomes a suffix automaton whose states know the smallest
document they occur in, and the automaton's text goes to every task that holds documents of the shard. There the documents are streamed
through it: at each word the automaton tells the longest match that ends there and its smallest document, and the maximal spans of matches
of at least ``window`` words are removed.

Which passages can repeat is found by anchors: of each window, the smallest hashes of its short word runs under two orders. Equal windows have
equal anchors, so only windows whose anchors occur in two documents are looked at, and the anchors lead a window and its reference
to the same shard. Exact copies are set apart before, by a digest of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.common import WordHashes
from weekpanel.operators.joins import broadcast_if_small
from weekpanel.session import freeze, shared_dir
from weekpanel.sources.upsert import fresh_path

GRAM = 8  # words of a run that may become an anchor
SHARD_WORDS = 50_000  # words of the reference in an automaton
STREAM_WORDS = 400_000  # words of documents that a task streams through one automaton
KEPT_WORDS = 400_000

_rng = np.random.default_rng(31)
_PLACES = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return a ^ (a >> np.uint64(32))


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of every run of ``width``."""
    n, size = len(a) - width + 1, 1
    while 2 * size <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[:n], a[width - size : width - size + n])


class Windows:
    """Words of a text and the anchors of its windows; a worker keeps the hashes of its last words."""

    def __init__(self, window: int):
        self.window, self.gram, self.known = window, min(GRAM, window), WordHashes()

    def grams(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KEPT_WORDS:
            self.known = WordHashes()
        h = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = len(h) - self.gram + 1
        sums = np.zeros(n, dtype=np.uint64)
        for j in range(self.gram):
            sums += h[j : j + n] * _PLACES[j]
        return _mixed(sums)

    def anchors(self, words: list[bytes]) -> np.ndarray:
        """A number for each window, of its smallest runs under two orders; none for texts that are too short."""
        if len(words) < self.window:
            return np.empty(0, dtype=np.int64)
        g, width = self.grams(words), self.window - self.gram + 1
        pair = _least(g, width) * np.uint64(3) + _least(_mixed(g * _PLACES[9]), width)
        return _mixed(pair).view(np.int64)

    def digests(self, words: list[bytes]) -> np.ndarray:
        """Two numbers for each window, of all its words."""
        g, n = self.grams(words), len(words) - self.window + 1
        places = sorted({*range(0, self.window - self.gram + 1, self.gram), self.window - self.gram})
        out = np.zeros((2, n), dtype=np.uint64)
        for i, at in enumerate(places):
            out[0] += g[at : at + n] * _PLACES[10 + i % 27]
            out[1] = _mixed(out[1] + g[at : at + n])
        return np.stack([_mixed(out[0]), out[1]]).view(np.int64)


def _runs(mask: np.ndarray, keys: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Runs of set places (of one key), as (first, last + 1)."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    new = np.diff(at) > 1
    if keys is not None:
        new |= keys[at[1:]] != keys[at[:-1]]
    cuts = np.flatnonzero(new) + 1
    return list(zip(at[np.r_[0, cuts]].tolist(), (at[np.r_[cuts - 1, len(at) - 1]] + 1).tolist(), strict=True))


def _sketch(window: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Windows(window)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b, n, keys = whole.slice(at, 1024), [], []
                for text in b.column(3).cast(pa.large_binary()).to_pylist():
                    words = (text or b"").split()
                    n.append(len(words))
                    keys.append(np.unique(of.anchors(words)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "k1", "k2", "n", "keys"])
    return sketch


def _cut(window: int):
    """Runs of windows whose anchors are wanted, with their words: one piece for each run of one anchor."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Windows(window)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = []
                ids, k1, k2, texts, wanted = (whole.slice(at, 256).column(c) for c in range(5))
                for i, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
                    words = text.split()
                    keys = of.anchors(words)
                    for a, b in _runs(np.isin(keys, wanted[i].values.to_numpy()), keys):
                        out.append((ids[i].as_py(), k1[i].as_py(), k2[i].as_py(), int(keys[a]), a, b - a, b" ".join(words[a : b + window - 1])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in out], t) for c, t in enumerate((*[pa.int64()] * 6, pa.binary()))],
                    ["id", "k1", "k2", "key", "at", "n", "words"])
    return cut


def _digested(window: int):
    """The digests of all windows; the words of many pieces are digested as one text, without the windows that cross a border."""
    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Windows(window)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                sizes = b.column(2).to_numpy()
                starts = np.cumsum(sizes + window - 1) - (sizes + window - 1)
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                w, v = of.digests(b" ".join(b.column(3).to_pylist()).split())[:, np.repeat(starts, sizes) + place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (w, v, np.repeat(b.column(0).to_numpy(), sizes), np.repeat(b.column(1).to_numpy(), sizes), place)],
                    ["w", "v", "id", "at", "place"])
    return digested


def _referred(window: int):
    """The words of the wanted windows of a piece."""
    def referred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, doc_id, words, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words, mask = words.split(), np.zeros(len(words), dtype=bool)
                mask[places] = True
                out += [(key, doc_id, e - a + window - 1, b" ".join(words[a : e + window - 1])) for a, e in _runs(mask)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out], t) for c, t in enumerate((*[pa.int64()] * 3, pa.binary()))], ["key", "id", "size", "words"])
    return referred


class Automaton:
    """A suffix automaton of several texts; each state knows the smallest id among the texts it occurs in."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, moves: dict[bytes, int], link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(None)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state of the longest text that ends in ``p`` followed by ``word``; it is cut off from a longer one if need be."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = own
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = own
            p = self.link[p]
        return own

    def add(self, words: list[bytes], doc_id: int) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word)
            else:
                new, p = self._state({}, 0, self.length[last] + 1), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word)
                last = new
            if self.first[last] is None or doc_id < self.first[last]:
                self.first[last] = doc_id

    def close(self) -> None:
        """Every state hears of the texts that its longer states occur in."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up, own = self.link[s], self.first[s]
            if up > 0 and own is not None and (self.first[up] is None or own < self.first[up]):
                self.first[up] = own

    def spans(self, words: list[bytes], doc_id: int, window: int) -> list[tuple[int, int]]:
        """Maximal spans of ``words`` covered by matches of ``window`` words with a text of a smaller id, as (first, last + 1)."""
        moves, link, length, first = self.next, self.link, self.length, self.first
        state, matched, out = 0, 0, []
        for i, word in enumerate(words):
            while state and word not in moves[state]:
                state = link[state]
                matched = length[state]
            if word in moves[state]:
                state = moves[state][word]
                matched += 1
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                    matched = length[state]
                if first[state] < doc_id:
                    if out and i + 1 - window <= out[-1][1]:
                        out[-1] = (out[-1][0], i + 1)
                    else:
                        out.append((i + 1 - window, i + 1))
        return out


def _streamed(window: int):
    """All pieces of a shard through the automaton of its reference."""
    def streamed(reference: pa.Table, pieces: pa.Table) -> pa.Table:
        automaton, known, out = Automaton(), {}, []
        if reference.num_rows:
            for doc_id, words in zip(reference["ref_id"].to_pylist(), reference["ref_words"].to_pylist(), strict=True):
                automaton.add(words.split(), doc_id)
            automaton.close()
            for row in zip(*(pieces[c].to_pylist() for c in ("id", "k1", "k2", "at", "words")), strict=True):
                doc_id, k1, k2, at, words = row
                if (doc_id, words) not in known:
                    known[doc_id, words] = automaton.spans(words.split(), doc_id, window)
                out += [(doc_id, k1, k2, at + a, at + b) for a, b in known[doc_id, words]]
        return pa.table({name: pa.array([r[c] for r in out], pa.int64()) for c, name in enumerate(("id", "k1", "k2", "a", "b"))})
    return streamed


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            b, n, gone, kept = whole.slice(at, 512), [], [], []
            texts, copies, spans = b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            for text, copy, ranges in zip(texts, copies, spans, strict=True):
                words = (text or b"").split()
                n.append(len(words))
                if copy:
                    words = []
                elif ranges:
                    keep = np.ones(len(words), dtype=bool)
                    for r in ranges:
                        keep[r["a"] : r["b"]] = False
                    words = [words[i] for i in np.flatnonzero(keep)]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.large_binary()).cast(pa.binary())],
                ["row", "n_words", "n_removed", "kept"])


def _stored(df: DataFrame) -> DataFrame:
    path = fresh_path(shared_dir(df.sparkSession))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_repeats(docs: DataFrame, window: int = 50, order: str = "doc_id", text: str = "text") -> DataFrame:
    """(``row``, n_words, n_removed, kept_text) of every row; ``row`` holds all columns of ``docs`` but ``text``.

    Words are runs without ASCII blanks, taken as they are. Each word is removed that lies in a window of ``window`` words which also starts in a
    document with a smaller ``order``; windows are judged on the input. ``kept_text`` joins the other words by one space.

    NULL and empty texts have no words, and texts with fewer words than ``window`` lose none. Rows with a NULL id are neither earlier nor
    later than others: they lose nothing and nothing is lost for them. Rows that repeat an id do not count for each other, so repeated
    rows give equal results. An empty table gives no rows; columns of any name may follow.
    """
    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.col(f"`{order}`").cast("long").alias("id"),
        F.xxhash64(F.col(f"`{text}`")).alias("k1"), F.xxhash64(F.lit(window), F.col(f"`{text}`")).alias("k2"),
        F.col(f"`{text}`").cast("binary").alias("text"),
    )
    doc = ["id", "k1", "k2"]
    sketched = _stored(source.select(*doc, "text").where("id is not null").mapInArrow(_sketch(window), "id long, k1 long, k2 long, n long, keys array<long>"))
    long_ = sketched.where(F.col("n") >= window)
    firsts = freeze(long_.groupBy("k1", "k2").agg(F.min("id").alias("first")))

    # Anchors in two different texts, and of each text those that it shares.
    own = long_.join(firsts.withColumnRenamed("first", "id"), doc).select(*doc, F.explode("keys").alias("key"))
    shared = own.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    wanted = own.join(shared, "key").groupBy(*doc).agg(F.collect_set("key").alias("wanted"))
    pieces = _stored(source.select(*doc, "text").join(wanted, doc).mapInArrow(
        _cut(window), "id long, k1 long, k2 long, key long, at long, n long, words binary"))

    # The reference: of each window that occurs in two documents, the first one.
    digests = pieces.select("id", "at", "n", "words").mapInArrow(_digested(window), "w long, v long, id long, at long, place long")
    first = digests.groupBy("w", "v").agg(F.min(F.struct("id", "at", "place")).alias("f"), F.max("id").alias("high")).where("f.id < high")
    places = first.groupBy("f.id", "f.at").agg(F.collect_list("f.place").alias("places"))
    reference = _stored(pieces.select("key", "id", "at", "words").join(places, ["id", "at"]).select("key", "id", "words", "places").mapInArrow(
        _referred(window), "key long, id long, size long, words binary"))
    shards = max(1, -(-(reference.agg(F.sum("size")).first()[0] or 0) // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    own_words = F.col("n") + window - 1
    heavy = freeze(pieces.groupBy(shard).agg(F.ceil(F.sum(own_words) / STREAM_WORDS).alias("tasks")).where("tasks > 1"))
    heavy = broadcast_if_small(heavy)
    tasks = F.coalesce("tasks", F.lit(1))
    sent = reference.select(shard, F.col("id").alias("ref_id"), F.col("words").alias("ref_words")).join(heavy, "shard", "left").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("task"), "ref_id", "ref_words")
    dealt = pieces.select(shard, *doc, "at", "words").join(heavy, "shard", "left").withColumn("task", F.pmod(F.xxhash64("id", "at"), tasks))
    found = sent.groupBy("shard", "task").cogroup(dealt.groupBy("shard", "task")).applyInArrow(
        _streamed(window), "id long, k1 long, k2 long, a long, b long")
    spans = found.groupBy(*doc).agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    copies = long_.select(*doc).distinct().join(firsts, ["k1", "k2"]).where("id > first").select(*doc, F.lit(True).alias("copy"))
    verdicts = freeze(spans.select(*doc, F.lit(False).alias("copy"), "spans").unionByName(copies.withColumn(
        "spans", F.array().cast("array<struct<a: long, b: long>>"))))
    judged = source.join(verdicts, doc, "left").select("row", "text", "copy", "spans")
    row_type = judged.schema["row"].dataType.simpleString()
    out = judged.mapInArrow(_kept, f"row {row_type}, n_words long, n_removed long, kept binary")
    return out.select("row", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))
