"""Language-model scores by Katz backoff over word pairs.

Texts become blocks of word numbers, a row per block. Blocks exchange sorted runs of distinct words and pairs with the tables of counts,
which are partitioned by hash: a block sends each distinct item once, however often and in however many of its documents it stands, and gets
the item's count back. So a frequent word costs a table no more than one entry per block. Followers of a frequent context are spread over several
partitions and their sums are added up.

P(w | h) = d(c) c(h,w) / c(h) where the pair was seen, else a(h) P(w); P(w) = d(c) c(w) / N, and what the discounts of
Good and Turing set free goes to all unknown words together, which count as one word. a(h) makes the sum over the
vocabulary and the unknown word exactly 1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.session import freeze

BLOCK_TOKENS = 3_000_000
STEP_TOKENS = 1 << 18  # words of a block whose scores are added up at once
#: Bytes of text for each partition of the count tables, and the least and largest number of partitions.
TABLE_BYTES, LEAST_TABLES, MOST_TABLES = 8 << 20, 256, 1 << 16
DISCOUNTED = 5  # counts up to this one are discounted
END, START = xxhash.xxh64_intdigest(b"\n"), 0  # no word holds a newline; word numbers start at 1


def squeeze(a: np.ndarray) -> bytes:
    """Whole numbers, byte planes side by side, compressed."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def expand(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    a ^= a >> np.uint64(29)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    return a ^ (a >> np.uint64(32))


def discounts(n: Sequence[int]) -> np.ndarray:
    """d(r) for r = 0..DISCOUNTED from the numbers n[r] of items seen r times (n[1] to n[DISCOUNTED + 1]).

    Where the counts of counts give no ratio between 0 and 1, a constant n1 / (n1 + 2 n2) is taken off instead.
    """
    k = DISCOUNTED
    constant = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    d, cut = np.ones(k + 1), (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        turing = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut != 1 else 0.0
        d[r] = turing if 0.01 < turing < 0.999 else (r - constant) / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c <= DISCOUNTED, d[np.minimum(c, DISCOUNTED).astype(np.int64)], 1.0)


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Unigrams:
    """P(w) from counts; ``n`` holds tokens, distinct words and the numbers of words seen once, twice and so on."""

    def __init__(self, tokens: int, distinct: int, n: Sequence[int]):
        self.tokens, self.distinct, self.d = tokens, distinct, discounts([0, *n])
        low = sum(n[r - 1] * r * (1 - self.d[r]) for r in range(1, DISCOUNTED + 1))
        self.unknown = max(low / tokens, 1 / (tokens + 1)) if tokens else 1.0
        self.scale = (1 - self.unknown) / max(tokens - low, 1e-300)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c.astype(float), self.d) * self.scale, self.unknown)


def _blocks(kind: str, tables: int):
    """Texts to blocks: one row with the word numbers of every text, and a row of distinct words for each table."""
    names = ["k", "table", "block", "ids", "held", "lens", "a", "b"]
    schema = f"k long, table int, block long, ids array<{kind}>, held array<boolean>, lens array<int>, a binary, b binary"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, held, streams, index, size = [], [], [], _Index(), 0
        id_type = None

        def flush() -> Iterator[pa.RecordBatch]:
            lens = np.array([len(s) for s in streams], dtype=np.int64)
            tokens = np.concatenate(streams)
            digest = np.array([END if w == b"\n" else xxhash.xxh64_intdigest(w) for w in index], dtype=np.uint64)
            words, place = np.unique(digest, return_inverse=True)
            tokens = place.astype(np.uint32)[tokens]
            learned = np.bincount(tokens[~np.repeat(np.array(held), lens)], minlength=len(words))
            block = part << 24 | made
            table = ((words >> np.uint64(32)) * np.uint64(tables) >> np.uint64(32)).astype(np.int64)
            own, first = np.unique(table, return_index=True)
            ends = [*first[1:].tolist(), len(words)]
            m = len(own)
            yield pa.RecordBatch.from_arrays([
                pa.array([tables + block, *own.tolist()], pa.int64()), pa.array([-1, *own.tolist()], pa.int32()),
                pa.array([block] * (m + 1), pa.int64()), pa.array([ids, *[None] * m], pa.list_(id_type)),
                pa.array([held, *[None] * m], pa.list_(pa.bool_())), pa.array([lens.tolist(), *[None] * m], pa.list_(pa.int32())),
                pa.array([squeeze(tokens), *[words[s:e].tobytes() for s, e in zip(first, ends, strict=True)]], pa.binary()),
                pa.array([None, *[squeeze(learned[s:e]) for s, e in zip(first, ends, strict=True)]], pa.binary()),
            ], names)

        for batch in batches:
            id_type = batch.column(0).type
            for i, t, h in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = (t or b"").lower().split()
                found.append(b"\n")
                streams.append(np.fromiter(map(index.__getitem__, found), dtype=np.uint32, count=len(found)))
                ids.append(i)
                held.append(h)
                size += len(found)
                if size >= BLOCK_TOKENS:
                    yield from flush()
                    ids, held, streams, index, size, made = [], [], [], _Index(), 0, made + 1
        if ids:
            yield from flush()

    return rows, schema


def _count_words(t: pa.Table) -> pa.Table:
    """One partition of the word table: total counts and numbers of its words, answered to every block that asked."""
    asked = [np.frombuffer(b, dtype=np.uint64) for b in t["a"].to_pylist()]
    table, tables = t["table"][0].as_py(), t["tables"][0].as_py()
    words, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.rint(np.bincount(place, weights=np.concatenate([expand(b) for b in t["b"].to_pylist()]))).astype(np.int64)
    number = np.empty(len(words), dtype=np.uint64)  # frequent words get small numbers
    number[np.argsort(-total, kind="stable")] = np.arange(len(words), dtype=np.uint64)
    number = number * np.uint64(tables) + np.uint64(table + 1)
    ends = np.cumsum([len(a) for a in asked])
    parts = [place[e - len(a) : e] for a, e in zip(asked, ends, strict=True)]
    stats = [int(total.sum()), int((total > 0).sum()), *[int((total == r).sum()) for r in range(1, DISCOUNTED + 2)]]
    return _answers(
        [tables + b for b in t["block"].to_pylist()], [table] * len(parts), 0,
        [[squeeze(total[p]) for p in parts], [squeeze(number[p]) for p in parts]], stats,
    )


ANSWER = "k long, table int, kind int, a binary, b binary, c binary, d binary, stats array<long>"


def _answers(k: list, table: list, kind: int, blobs: list[list[bytes]], stats: list[int], last: bytes | None = None) -> pa.Table:
    """Answers to blocks, and one more row with the statistics of the partition."""
    n = len(k)
    columns = [*blobs, *[[None] * n] * (4 - len(blobs))]
    return pa.table({
        "k": pa.array([*k, None], pa.int64()), "table": pa.array([*table, None], pa.int32()), "kind": pa.array([kind] * (n + 1), pa.int32()),
        **{name: pa.array([*column, last if name == "a" else None], pa.binary()) for name, column in zip("abcd", columns, strict=True)},
        "stats": pa.array([*[None] * n, stats], pa.list_(pa.int64())),
    })


class _Block:
    """A block with the counts of its words: its distinct pairs, in the order in which the pair tables see them.

    Words are places in ``number``, which rises; the start of a text is place 0. Arrays as long as the block or its pairs hold 4 bytes an
    item; what the pair tables are asked and what they answer is spread out for one table at a time.
    """

    def __init__(self, block: pa.Table, answers: pa.Table, tables: int, tokens: int, texts: int):
        self.ids, self.lens = block["ids"][0].values, block["lens"][0].values.to_numpy().astype(np.int64)
        self.held = block["held"][0].values.to_numpy(zero_copy_only=False)
        tabled = answers["table"].to_numpy()
        own = np.flatnonzero(answers["kind"].to_numpy() == 0)
        own = own[np.argsort(tabled[own])].tolist()
        number = np.concatenate([np.array([START], dtype=np.uint64), *[expand(answers["b"][i].as_buffer()) for i in own]])
        count = np.concatenate([np.array([texts], dtype=np.uint64), *[expand(answers["a"][i].as_buffer()) for i in own]]).astype(np.int64)
        order = np.argsort(number)
        self.number, self.count = number[order], count[order]  # the count of place 0 is that of the texts
        at = np.empty(len(order), dtype=np.uint32)
        at[order] = np.arange(len(order), dtype=np.uint32)
        self.stream = at[1:][expand(block["a"][0].as_buffer()).view(np.int64)]
        n = len(order)
        key = np.empty(len(self.stream), dtype=np.int64)
        key[1:] = self.stream[:-1]
        key[np.cumsum(self.lens) - self.lens] = 0
        key *= n
        key += self.stream
        order = np.argsort(key)
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        place = np.empty(len(key), dtype=np.uint32)
        place[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        key = key[new]
        del order, new
        h, w = (key // n).astype(np.uint32), (key % n).astype(np.uint32)
        del key
        self.is_hot = 4.0 * tables * self.count >= tokens  # of a word as a context
        spread = np.where(self.is_hot, np.maximum(1, np.ceil(4.0 * tables * self.count / max(1, tokens))), 1).astype(np.uint64)
        mixed = _mixed(self.number)
        table = ((mixed[h] + mixed[w] % spread[h]) % np.uint64(tables)).astype(np.uint16)  # MOST_TABLES of them at most
        order = np.argsort(table, kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        self.place, self.h, self.w = rank[place], h[order], w[order]
        self.tables, self.first = np.unique(table[order], return_index=True)
        self.ends = [*self.first[1:].tolist(), len(order)]

    def seen(self) -> np.ndarray:
        """How often each pair stands in the texts that are learned from."""
        return np.bincount(self.place[np.repeat(~self.held, self.lens)], minlength=len(self.h)).astype(np.uint32)

    def per_text(self, values: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Sums of ``values[places]`` over each text, some texts at a time."""
        out, stop, at = np.empty(len(self.lens)), np.cumsum(self.lens), 0
        while at < len(out):
            begin = stop[at] - self.lens[at]
            end = max(at + 1, int(np.searchsorted(stop, begin + STEP_TOKENS, side="right")))
            owner = np.repeat(np.arange(end - at), self.lens[at:end])
            out[at:end] = np.bincount(owner, weights=values[places[begin : stop[end - 1]]], minlength=end - at)
            at = end
        return out


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of every run of equal values."""
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(h)])


def _count_pairs(unigrams: Unigrams):
    """One partition of the pair table: counts of its pairs, and of each context what its backoff weight needs."""
    def count(t: pa.Table) -> pa.Table:
        rows = t.select(["k", "a", "b", "c", "d"]).to_pylist()
        tables, table = t["tables"][0].as_py(), t["table"][0].as_py()
        packed = [(expand(r["a"]), expand(r["b"])) for r in rows]
        h = np.concatenate([np.repeat(a >> np.uint64(1), b.astype(np.int64)) for a, b in packed])
        hot = np.concatenate([np.repeat(a & np.uint64(1), b.astype(np.int64)) for a, b in packed]).astype(bool)
        flat = [expand(r["c"]) for r in rows]
        w = np.concatenate(flat)
        both = [expand(r["d"]) for r in rows]
        seen = np.concatenate([x[: len(x) // 2] for x in both])
        words = np.concatenate([x[len(x) // 2 :] for x in both])
        order = np.lexsort((w, h))
        hs, ws = h[order], w[order]
        new = np.r_[True, (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])]
        pair = np.empty(len(order), dtype=np.int64)
        pair[order] = np.cumsum(new) - 1
        total = np.rint(np.bincount(pair, weights=seen)).astype(np.int64)
        ph, pw, phot = hs[new], words[order][new].astype(np.int64), hot[order][new]
        first, lens = _groups(ph)
        owner = np.repeat(np.arange(len(first)), lens)
        known = total > 0
        sums = np.stack([
            *[np.bincount(owner[total == r], minlength=len(first)) for r in range(1, DISCOUNTED + 1)],
            np.bincount(owner[known], weights=unigrams(pw[known]), minlength=len(first)),
        ]).astype(float)  # followers seen 1..5 times, and P(w) of all followers
        at, out = 0, [[], [], [], []]
        for (a, b), c in zip(packed, flat, strict=True):
            own = pair[at : at + len(c)]
            at += len(c)
            runs = np.cumsum(b.astype(np.int64)) - b.astype(np.int64)
            context = owner[own[runs]]
            missing = np.add.reduceat((total[own] == 0).astype(np.int64), runs) > 0
            asked = np.flatnonzero(missing & ((a & np.uint64(1)) == 0))
            out[0].append(squeeze(total[own]))
            out[1].append(squeeze((sums[:DISCOUNTED, context].sum(0) == 0).astype(np.int64)))
            out[2].append(squeeze(asked))
            out[3].append(sums[:, context[asked]].tobytes())
        stats = [int(known.sum()), *[int((total == r).sum()) for r in range(1, DISCOUNTED + 2)]]
        hot_rows = np.flatnonzero(phot[first]) if len(first) else np.zeros(0, np.int64)
        last = ph[first[hot_rows]].tobytes() + sums[:, hot_rows].tobytes()
        return _answers([r["k"] for r in rows], [table] * len(rows), 1, out, stats, last)

    return count


def score_texts(docs: DataFrame, held: Column, text: str = "text", order: str = "doc_id") -> DataFrame:
    """(``order``, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Words are runs without ASCII blanks, A-Z in lower case; every text ends with one end token, which NULL and empty texts consist
    of. Rows with ``held`` are scored but not learned from. ``base_score``: log10 of add-0.1 unigrams. Repeated rows are learned from and scored
    as often as they occur; with nothing to learn from all scores are 0; an empty table gives no rows. Other columns are left out.
    """
    kind = docs.schema[order].dataType.simpleString()
    source = docs.select(F.col(f"`{order}`").alias("_id"), F.coalesce(held, F.lit(False)).alias("_held"), F.col(f"`{text}`").alias("_text"))
    size = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    tables = int(min(MOST_TABLES, max(LEAST_TABLES, -(-size // TABLE_BYTES))))
    rows, schema = _blocks(kind, tables)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    stored = freeze(source.mapInArrow(rows, schema).repartition(parts, "k"))
    asked = stored.where("table >= 0").select("k", "table", "block", "a", "b", F.lit(tables).alias("tables"))
    word_answers = freeze(asked.groupBy("k").applyInArrow(_count_words, ANSWER))

    def summed(df: DataFrame, n: int) -> list[int]:
        return [x or 0 for x in df.where("stats is not null").agg(*[F.sum(F.get("stats", F.lit(i))) for i in range(n)]).first()]

    tokens, distinct, *n = summed(word_answers, DISCOUNTED + 3)
    unigrams = Unigrams(tokens, distinct, n)
    blocks = stored.where("table < 0")
    texts = blocks.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0

    def ask_pairs(block: pa.Table, answers: pa.Table) -> pa.Table:
        b, k = _Block(block, answers, tables, tokens, texts), block["k"][0].as_py()
        out: list[list] = [[], [], [], []]
        seen = b.seen()
        for s, e in zip(b.first.tolist(), b.ends, strict=True):
            h, w = b.h[s:e], b.w[s:e]
            first, lens = _groups(h)
            out[0].append(squeeze(b.number[h[first]] << np.uint64(1) | b.is_hot[h[first]]))
            out[1].append(squeeze(lens))
            out[2].append(squeeze(b.number[w]))
            out[3].append(squeeze(np.concatenate([seen[s:e], b.count[w]])))
        m = len(b.tables)
        return pa.table({
            "k": pa.array([k] * m, pa.int64()), "table": pa.array(b.tables.tolist(), pa.int32()),
            **{name: pa.array(v, pa.binary()) for name, v in zip("abcd", out, strict=True)}, "tables": pa.array([tables] * m, pa.int32()),
        })

    word_replies = word_answers.where("k is not null").drop("stats")
    pairs = blocks.groupBy("k").cogroup(word_replies.groupBy("k")).applyInArrow(
        ask_pairs, "k long, table int, a binary, b binary, c binary, d binary, tables int"
    )
    pair_answers = freeze(pairs.groupBy("table").applyInArrow(_count_pairs(unigrams), ANSWER))
    d2 = discounts([0, *summed(pair_answers, DISCOUNTED + 2)[1:]])
    hot_sums: dict[int, np.ndarray] = {}  # 4 * tables contexts at most, since each has that share of all tokens
    for r in pair_answers.where("stats is not null").select("a").toLocalIterator():
        m = len(r["a"]) // (8 * (DISCOUNTED + 2))
        own, sums = np.frombuffer(r["a"], dtype=np.uint64, count=m), np.frombuffer(r["a"], offset=8 * m).reshape(DISCOUNTED + 1, m)
        for i, h in enumerate(own.tolist()):
            hot_sums[h] = hot_sums.get(h, 0) + sums[:, i]

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(block, answers, tables, tokens, texts)
        pair_rows = np.flatnonzero(answers["kind"].to_numpy() == 1)
        found = dict(zip(answers["table"].to_numpy()[pair_rows].tolist(), pair_rows.tolist(), strict=True))
        logs = np.empty(len(b.h))
        for table, s, e in zip(b.tables.tolist(), b.first.tolist(), b.ends, strict=True):
            reply = [answers[name][found[table]].as_buffer() for name in "abcd"]
            h, w = b.h[s:e], b.w[s:e]
            first, lens = _groups(h)
            contexts = h[first]
            total = expand(reply[0]).astype(np.int64)
            flag, asked = expand(reply[1]).astype(bool), expand(reply[2]).astype(np.int64)
            sums = np.frombuffer(reply[3]).reshape(DISCOUNTED + 1, -1)
            weight = np.ones(len(first))
            weight[asked] = _backoff(sums, b.count[contexts[asked]], d2, unigrams)
            for i in np.flatnonzero(b.is_hot[contexts]).tolist():
                hot = hot_sums[int(b.number[contexts[i]])]
                flag[i] = not hot[:DISCOUNTED].any()
                weight[i] = _backoff(hot[:, None], b.count[contexts[i]][None], d2, unigrams)[0]
            backed = np.repeat(weight, lens) * unigrams(b.count[w])
            direct = discounted(total.astype(float), d2) / np.maximum(1, b.count[h] + np.repeat(flag, lens))
            logs[s:e] = np.log10(np.where(total > 0, direct, backed))
        base = np.log10((b.count + 0.1) / (tokens + 0.1 * (distinct + 1)))
        known = (b.count > 0).astype(float)

        return pa.table({
            order: b.ids, "held_out": pa.array(b.held), "n_tokens": pa.array(b.lens),
            "n_known": pa.array(np.rint(b.per_text(known, b.stream)).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(b.lens), tokens)), "base_score": pa.array(b.per_text(base, b.stream)),
            "score": pa.array(b.per_text(logs, b.place)),
        })

    replies = word_replies.unionByName(pair_answers.where("k is not null").drop("stats"))
    return blocks.groupBy("k").cogroup(replies.groupBy("k")).applyInArrow(
        score, f"`{order}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _backoff(sums: np.ndarray, context: np.ndarray, d: np.ndarray, unigrams: Unigrams) -> np.ndarray:
    """a(h): the mass that discounts set free, over P(w) of all words that never followed h."""
    r = np.arange(1, DISCOUNTED + 1)
    freed = ((1 - d[1:]) * r) @ sums[:DISCOUNTED]
    left = np.where(freed > 0, freed / np.maximum(1, context), 1 / (context + 1))
    return np.where(context > 0, left / np.maximum(1 - sums[DISCOUNTED], unigrams.unknown), 1.0)
