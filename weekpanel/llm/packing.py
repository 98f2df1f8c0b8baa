"""Concatenate and cut: token streams packed into sequences of one length.

Documents are tokenised once and their ids stored with the running total of their partition. The partitions' totals,
summed in order, give every document its place in one long stream, which is cut every ``length`` tokens.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.session import freeze

#: Words whose ids a worker keeps during a task and between tasks; its memory bounds, not limits of what is tokenised.
KEPT_WORDS, KEPT_IDLE = 600_000, 150_000
LONG_WORD = 64
RUN_WORDS, MARKS = 512, b".,;:!?"
MARKED = [b"", *(bytes([m]) for m in MARKS)]
#: Words of Latin letters, of which lower case is that of A-Z alone, with one mark at most.
SIMPLE = re.compile(rb"(?:[A-Za-z]|\xc3[\x9f-\xb6\xb8-\xbf])+[.,;:!?]?").fullmatch
#: The steps before the merges of which ``WordIds`` knows what they do to a word of Latin letters: lower case and bytes as characters.
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}], [
    {"type": "Split", "pattern": {"Regex": LETTERS}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]

_encoders: dict[str, WordIds] = {}


def _byte_characters() -> str:
    """The character that byte-level tokenizers write for each byte; the blank stays, since it parts the words."""
    own = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    return "".join(chr(b if own[b] or b == 32 else 255 + b + 1 - sum(own[:b])) for b in range(256))


_CHARACTERS = _byte_characters()


def _as_characters(words: bytes) -> str:
    return codecs.charmap_decode(words, "strict", _CHARACTERS)[0]


class WordIds:
    """Ids of whole texts, put together from ids of single words.

    The tokenizer drops blanks and never joins across them, so a text's ids are those of its words in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        suffix = config["model"].get("end_of_word_suffix")
        self.ends = None  # which ids end a word, where the vocabulary tells
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.plain = None  # the merges alone, for words that need no other step
        steps = tuple((config.get(k) or {}).get(v) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        if suffix and steps == PLAIN_STEPS:
            bare = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
            self.plain = Tokenizer.from_str(json.dumps(config | bare))
        self.known: dict[bytes, bytes] = {b"": b""}
        self.met: set[bytes] = set()  # known words that came again

    def _encode(self, found: list[bytes]) -> dict[bytes, bytes]:
        """Each word with its ids. Words of letters, alone or with one mark behind, are encoded in runs and told apart by their ends."""
        out: dict[bytes, bytes] = {}
        rest = found
        if self.plain is not None:
            simple, rest = [], []
            for w in found:
                (simple if SIMPLE(w) else rest).append(w)
            lower = [w.lower() for w in simple]
            stems = [w.rstrip(MARKS) for w in lower]
            ids = {t: self.known.get(t) for t in stems}
            left: list[bytes] = []
            ids.update(self._runs(self.plain, [t for t, i in ids.items() if i is None], 1, left, _as_characters))
            ids.update(self._alone(left))
            marks = {w: i.tobytes() for w, i in zip(MARKED, map(self._ids, MARKED), strict=True)}
            out.update(zip(simple, [ids[t] + marks[w[len(t) :]] for w, t in zip(lower, stems, strict=True)], strict=True))
        runs, left = {1: [], 2: []}, []
        for w in rest:
            t = w.decode()
            pieces = 0 if self.ends is None else 1 if t.isalpha() else 2 if w[-1] in MARKS and t[:-1].isalpha() else 0
            (runs[pieces] if pieces else left).append(w)
        for pieces, run in runs.items():
            out.update(self._runs(self.tokenizer, run, pieces, left, bytes.decode))
        out.update(self._alone(left))
        return out

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4")

    def _alone(self, found: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in found], add_special_tokens=False)
        return ((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(found, encoded, strict=True))

    def _runs(self, tokenizer, found: list[bytes], pieces: int, left: list[bytes], text: Callable[[bytes], str]) -> Iterator[tuple[bytes, bytes]]:
        """Words with their ids, each of ``pieces`` pieces; a run whose ends do not fit its words goes to ``left``."""
        for at in range(0, len(found), RUN_WORDS):
            part = found[at : at + RUN_WORDS]
            ids = np.array(tokenizer.encode_batch_fast([text(b" ".join(part))], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids])[pieces - 1 :: pieces] + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                left += part
                continue
            raw, bounds = ids.tobytes(), (4 * stops).tolist()
            yield from zip(part, map(raw.__getitem__, map(slice, [0, *bounds], bounds)), strict=False)

    def forget(self, stay: Iterable[bytes] | None = None) -> None:
        """Words other than ``stay`` go; if not given, those that came again stay. Most words stand in one text only."""
        self.known = {b"": b""} | {w: self.known[w] for w in (self.met if stay is None else stay)}
        self.met = set()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind one another, and how many each text has. NULL has none."""
        found = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = found.flatten().dictionary_encode()
        every = words.dictionary.cast(pa.large_binary()).to_pylist()  # each word once; also the empty one, around blanks
        new = [w for w in every if w not in self.known]
        own = [w for w in every if w in self.known]
        if len(self.known) + len(new) > KEPT_WORDS:
            self.forget(self.met.union(own) if len(self.met) + len(every) <= KEPT_WORDS else own)
        self.met.update(own)
        self.known.update(self._encode(new))
        raw = [self.known[w] for w in every]
        for w in new:
            if len(w) > LONG_WORD:
                del self.known[w]
        ids, sizes = np.frombuffer(b"".join(raw), dtype="<u4"), np.array([len(r) for r in raw], dtype=np.int64) // 4
        word = words.indices.to_numpy()
        n = sizes[word]
        stop = np.append(0, np.cumsum(n))
        ids = ids[np.arange(stop[-1]) + np.repeat((np.cumsum(sizes) - sizes)[word] - stop[:-1], n)]
        return ids, np.diff(stop[np.append(0, np.cumsum(pc.list_value_length(found).to_numpy()))])


def encoder(path: str) -> WordIds:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def _slices(batch: pa.RecordBatch, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of their last column."""
    sizes = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1).cast(pa.large_binary())).fill_null(0).to_numpy())
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def pack(
    docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, order: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Pieces of documents in sequences: (``order``, start, length, doc_tokens, sequence_id, offset, ids).

    ``tokenizer`` is a file whose tokens never span blanks. Each document is its ids and ``end_id``; NULL texts count as empty, so every row
    gives one token at least. ``ids`` are little-endian unsigned 32-bit numbers. All sequences are full but the last. Repeated rows are
    packed as often as they occur; an empty table gives no pieces. Other columns are left out, so names cannot clash.
    """
    kind = docs.schema[order].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, ids_of = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        small = max(ids_of.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        for whole in batches:
            for batch in _slices(whole):
                ids, n = ids_of(batch.column(1))
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<u2" if small else "<u4")
                n += 1
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                bounds = np.append(0, np.cumsum(n) * ids.itemsize).astype(np.int32)
                streams = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(n), part)), pa.array(starts), pa.array(n), streams],
                    ["_order", "part", "before", "n", "stream"],
                )
        if len(ids_of.known) > KEPT_IDLE:  # the worker goes on to other work
            ids_of.forget()
        pa.default_memory_pool().release_unused()

    stored = freeze(docs.select(F.col(f"`{order}`").alias("_order"), F.col(f"`{text}`").alias("_text")).mapInArrow(
        tokenise, f"_order {kind}, part long, before long, n long, stream binary"
    ))
    base, seen = {}, 0  # a number for each partition
    for part, n in sorted((r["part"], r["n"]) for r in stored.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        base[part], seen = seen, seen + n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                n, part = batch.column(3).to_numpy(), batch.column(1).to_numpy()
                first = np.array([base[p] for p in part.tolist()], dtype=np.int64) + batch.column(2).to_numpy()
                pieces = (first + n - 1) // length - first // length + 1
                row = np.repeat(np.arange(len(n)), pieces)
                k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                sequence = first[row] // length + k
                begin = np.maximum(sequence * length, first[row])
                stop = np.minimum((sequence + 1) * length, first[row] + n[row])
                streams = batch.column(4).to_pylist()
                wide = [len(s) // int(m) for s, m in zip(streams, n, strict=True)]
                ids = [
                    np.frombuffer(streams[r], dtype=f"<u{wide[r]}", count=m, offset=b * wide[r]).astype("<u4").tobytes()
                    for r, b, m in zip(row.tolist(), (begin - first[row]).tolist(), (stop - begin).tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(begin - first[row]), pa.array(stop - begin), pa.array(n[row]),
                     pa.array(sequence), pa.array(begin - sequence * length), pa.array(ids, pa.binary())],
                    ["_order", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    pieces = stored.mapInArrow(
        cut, f"_order {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    return pieces.withColumnRenamed("_order", order)
