"""Toxicity: a support vector machine on sentences with a gap-weighted subsequence kernel and Nyström landmarks.

The kernel of two words compares their subsequences of three characters, weighted down by the characters they skip and
scaled to 1 for equal words, so a letter put in or left out keeps most of it. The kernel of two sentences sums the ``POWER``-th power of it over
all pairs of words. Landmarks are the words most typical of labelled documents. A document carries one label for many sentences: sentences of
clean documents are clean, those of toxic ones are labelled anew by each fit, with at least one toxic sentence each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.common import labelled_sample, remainder
from weekpanel.session import freeze

LANDMARKS, CANDIDATES = 128, 600
POWER = 3
DECAY = 0.6
#: Places of the second and third character after the first: up to two skipped characters.
GAPS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
COST = 300.0  # of all errors together, against the length of the weights
LEAST = 0.6  # kernel values below this count as 0
#: Labelled ids of each class to learn from, at most, and the sentences of one text among them that come nearest to the landmarks.
#: Their texts are read whole, however long. Scoring has no such limit.
PER_CLASS, PER_TEXT = 2500, 32
#: Tokens and near words that a scorer remembers; its memory bounds, not limits of what is scored.
KEPT_WORDS, KEPT_HITS = 300_000, 20_000
CHUNK = 10_000  # words compared at once
SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n+")
SPELLED = re.compile(r"(?<!\w)(?:\w[^\w\n]{1,2}){3,}\w(?!\w)")  # letters one by one
EDGE = " \t\r\n\x0b\x0c.,;:!?\"'()[]{}|#$%&*<>@^~=+_-/\\`\u201c\u201d\u2018\u2019\u00ab\u00bb\u2026"


def _triples(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, code and weight of every subsequence of three characters of every word."""
    flat = np.frombuffer(("\n".join(found) + "\n").encode("utf-32-le"), dtype="<u4")
    chars = np.where(flat == 10, 0, flat % 63 + 1).astype(np.int32)
    word = (np.cumsum(chars == 0) - (chars == 0)).astype(np.int32)
    owners, codes, weights = [], [], []
    for a, b in GAPS:
        if len(chars) <= b:
            continue
        inside = (word[:-b] == word[b:]) & (chars[b:] > 0)
        i = np.flatnonzero(inside)
        owners.append(word[i])
        codes.append((chars[i] << 12) | (chars[i + a] << 6) | chars[i + b])
        weights.append(np.full(len(i), DECAY ** (b - 2), dtype=np.float32))
    if not owners:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate(owners), np.concatenate(codes), np.concatenate(weights)


def _joined(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triples with equal ones of a word added up, scaled to length 1 for each word."""
    owner, code, weight = _triples(found)
    key, at = np.unique(owner.astype(np.int64) << 18 | code, return_inverse=True)
    value = np.bincount(at, weights=weight, minlength=len(key))
    owner, code = key >> 18, key & ((1 << 18) - 1)
    norm = np.sqrt(np.bincount(owner, weights=value**2, minlength=len(found)))
    return owner, code, value / norm[owner]


class Landmarks:
    def __init__(self, chosen: list[str]):
        self.chosen = chosen
        owner, code, value = _joined(chosen)
        self.codes = np.unique(code)
        self.row = np.full(1 << 18, -1, dtype=np.int32)
        self.row[self.codes] = np.arange(len(self.codes))
        self.table = np.zeros((len(self.codes), len(chosen)))
        self.table[self.row[code], owner] = value

    def near(self, found: list[str]) -> dict[str, np.ndarray]:
        """Powers of the kernel with every landmark, for the words that come near any."""
        if not found or not self.chosen:
            return {}
        if len(found) > CHUNK:
            return {w: k for at in range(0, len(found), CHUNK) for w, k in self.near(found[at : at + CHUNK]).items()}
        owner, code, weight = _triples(found)
        known = self.row[code] >= 0
        share = np.bincount(owner[known], weights=weight[known], minlength=len(found))
        total = np.bincount(owner, weights=weight, minlength=len(found))
        some = [found[i] for i in np.flatnonzero(share > 0.33 * total)]
        out = {}
        step = max(32, 100_000 // len(self.chosen))  # bounds the matrix of triples by landmarks
        for at in range(0, len(some), step):
            part = some[at : at + step]
            owner, code, value = _joined(part)
            keep = self.row[code] >= 0
            owner, rows = owner[keep], value[keep, None] * self.table[self.row[code[keep]]]
            k, first = np.zeros((len(part), len(self.chosen))), np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])[: len(owner)]
            if len(owner):
                k[owner[first]] = np.add.reduceat(rows, first)
            k[k < LEAST] = 0
            out |= {part[i]: k[i] ** POWER for i in np.flatnonzero(k.any(1))}
        return out


def units(token: str) -> list[str]:
    """A word without marks at its edges, and without any; in overlapping windows where very long; none under three characters."""
    w = token.strip(EDGE)
    both = [w] if w.isalnum() else [w, re.sub(r"[\W_]", "", w)]
    return [p for w in both if len(w) > 2 for p in ([w] if len(w) <= 32 else [w[i : i + 32] for i in range(0, len(w) - 16, 16)])]


def spelled(sentence: str) -> list[str]:
    """Words that are spelled letter by letter, in overlapping windows where very long."""
    return [u for m in SPELLED.finditer(sentence) for u in units(re.sub(r"\W", "", m.group()))]


def sentences(text: str | None) -> Iterator[str]:
    return (s for s in SENTENCE.split((text or "").lower()) if s)


def parts(text: str | None) -> Iterator[frozenset[str]]:
    """The words of every sentence; a word spelled over the ends of sentences, as letters with dots and blanks are, stands as one of its own."""
    for s in sentences(text):
        yield frozenset({u for x in s.split() for u in units(x)} | {*spelled(s)})
    for w in spelled((text or "").lower()):
        yield frozenset([w])


@dataclass(frozen=True)
class SentenceSVM:
    landmarks: tuple[str, ...]
    weights: np.ndarray  # on the kernel values with each landmark
    bias: float
    slope: float  # margin to log-odds
    shift: float


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Squared hinge loss by Newton steps; the last weight is the bias."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        return 0.5 * (ridge * w * w).sum() + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    for _ in range(30):
        open_ = 1 - y * (x @ w) > 0
        g = ridge * w - 2 * x[open_].T @ (cost[open_] * (y[open_] * (1 - y[open_] * (x[open_] @ w))))
        h = np.diag(ridge) + 2 * x[open_].T @ (cost[open_, None] * x[open_])
        step, size, now = np.linalg.solve(h, g), 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, clean): in how many documents of either class a word stands, so that long ones weigh no more."""
    for b in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts[label].update(set().union(*parts(text)))
        found = list(counts[1].keys() | counts[0].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.string()), *[pa.array([counts[c][w] for w in found], pa.int64()) for c in (1, 0)]], ["word", "toxic", "clean"]
        )


def typical_words(counts: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """Words that toxic documents hold far more often than clean ones, most typical first, from (word, toxic, clean).

    A word counts together with its kernel neighbours: variants of an insult support each other, and a word that is put together of everyday
    parts has clean neighbours against it. ``CANDIDATES`` words and two sums for each come to the driver.
    """
    gain = (F.col("toxic") - F.col("clean") * F.lit(n_toxic / n_clean)) / F.sqrt(F.col("toxic") + F.col("clean") + 1)
    first = counts.where((F.col("toxic") >= 2) & (F.length("word") >= 4)).select("word", gain.alias("gain")).where("gain > 1")
    some = [r["word"] for r in first.orderBy(F.desc("gain"), "word").limit(CANDIDATES).collect()]
    if not some:
        return []

    def supported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Landmarks(some)
        for b in batches:
            toxic, clean, at = np.zeros(len(some)), np.zeros(len(some)), {w: i for i, w in enumerate(b.column(0).to_pylist())}
            of = [b.column(i).to_numpy() for i in (1, 2)]
            for w, k in marks.near(list(at)).items():
                toxic += k * of[0][at[w]]
                clean += k * of[1][at[w]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(some)), pa.int32()), pa.array(toxic), pa.array(clean)], ["mark", "toxic", "clean"])

    near = counts.where("toxic + clean >= 2").mapInArrow(supported, "mark int, toxic double, clean double")
    smooth = {some[r["mark"]]: r["gain"] for r in near.groupBy("mark").agg(
        F.round(F.sum("toxic"), 6).alias("toxic"), F.round(F.sum("clean"), 6).alias("clean")).select("mark", gain.alias("gain")).collect()}
    best = sorted(some, key=lambda w: (-smooth[w], w))
    return [w for w in best if smooth[w] > 2][:LANDMARKS] or best[:8]


def _vectors(chosen: list[str]):
    """Kernel sums of the ``PER_TEXT`` sentences of every text that come nearest to the landmarks, as 32-bit numbers."""
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Landmarks(chosen)
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                own = set(parts(text))
                near = marks.near(sorted(set().union(*own)))
                met = sorted({tuple(sorted(near.keys() & p)) for p in own} - {()})
                sums = sorted((np.sum([near[w] for w in ws], axis=0) for ws in met), key=lambda v: -v.sum())[:PER_TEXT]
                rows.append(np.array(sums, dtype="<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(rows, pa.binary())], ["label", "doc", "near"])

    return mapped


def fit(found: list[tuple[int, bytes, int]], chosen: list[str], rounds: int = 5) -> SentenceSVM:
    """Learn from the label and the sentences of documents; alternates between fitting and choosing the toxic sentences of toxic documents."""
    marks, y = Landmarks(chosen), np.array([label for label, _, _ in found])
    n = [int((y == c).sum()) for c in (0, 1)]
    each = [np.frombuffer(v, dtype="<f4").reshape(-1, len(chosen)) for _, v, _ in found]
    bag = np.repeat(np.arange(len(y)), [len(v) for v in each])
    z = np.vstack([*each, np.zeros((1, len(chosen)))]).astype(float)  # the last stands for sentences far from all
    k = np.array([marks.near([w]).get(w, np.zeros(len(chosen))) for w in chosen])
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T  # Nyström map
    mapped, of_toxic = z @ root, np.append(y[bag] == 1, False)
    label = np.where(of_toxic, 1.0, -1.0)
    for _ in range(rounds):
        cost = np.where(label > 0, 1.0 / max(1, (label > 0).sum()), 0.5 / max(1, (label < 0).sum()))
        cost[-1] = 0.5
        w = _svm(mapped, label, COST * cost)
        margin = mapped @ w[:-1] + w[-1]
        best = np.full(len(y), margin[-1])
        np.maximum.at(best, bag, margin[:-1])
        new = np.where(of_toxic & ((margin > 0) | (margin >= np.append(best[bag], np.inf))), 1.0, -1.0)
        if (new == label).all():
            break
        label = new
    slope, shift = 2.0, 0.0
    weight = np.where(y == 1, 0.3 / n[1], 0.7 / n[0])
    for _ in range(500):  # margins to probabilities, as if three documents in ten were toxic
        p = 1 / (1 + np.exp(-np.clip(slope * best + shift, -30, 30)))
        slope -= 4 * ((weight * (p - y) * best).sum() + 1e-3 * slope)
        shift -= 4 * (weight * (p - y)).sum()
    return SentenceSVM(tuple(chosen), root @ w[:-1], float(w[-1]), float(max(slope, 0.1)), float(shift))


class Scorer:
    """Scores whole texts; keeps which words are far from every landmark, up to a bound."""

    def __init__(self, model: SentenceSVM):
        self.model, self.marks = model, Landmarks(list(model.landmarks))
        self.known: set[str] = set()
        self.near: set[str] = set()  # tokens, as they stand in texts, that come near a landmark
        self.hits: dict[str, np.ndarray] = {}

    def __call__(self, texts: Iterable[str | None]) -> np.ndarray:
        lower = [(t or "").lower() for t in texts]
        tokens = [set(t.split()) for t in lower]
        letters = [spelled(t) for t in lower]
        every = set().union(*tokens)
        if len(self.known) + len(every) > KEPT_WORDS:
            self.known &= every  # frequent words stand among all texts
            if len(self.hits) > KEPT_HITS:
                self.known, self.hits, self.near = set(), {}, set()
        new = every - self.known
        self.known |= new
        found = sorted({u for x in new for u in units(x)} | {w for ws in letters for w in ws})
        self.hits |= self.marks.near(found)
        self.near |= {x for x in new if any(u in self.hits for u in units(x))}
        margins = np.full(len(lower), self.model.bias)
        for i, own in enumerate(tokens):
            if letters[i] or not self.near.isdisjoint(own):
                near = ({u for x in self.near.intersection(s.split()) for u in units(x)} | {*(spelled(s) if letters[i] else ())}
                        for s in sentences(lower[i]))
                for words in [*near, *({w} for w in letters[i])]:
                    values = [self.hits[w] for w in words if w in self.hits]
                    if values:
                        margins[i] = max(margins[i], float(np.sum(values, axis=0) @ self.model.weights) + self.model.bias)
        return 1 / (1 + np.exp(-np.clip(self.model.slope * margins + self.model.shift, -50, 50)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> SentenceSVM:
    """Fit on the whole texts of at most ``per_class`` ids of each class; equal texts of one label count once.

    Words are counted and sentences compared in tasks; the driver gets the landmarks and at most ``PER_TEXT`` sentences a text, as numbers.
    Where one class is missing or no word tells them apart, every text is clean.
    """
    none = SentenceSVM((), np.zeros(0), -1.0, 4.0, 0.0)
    found = labelled_sample(docs.where("text is not null"), labels, label, per_class).withColumn("doc", F.xxhash64("text"))
    sample = freeze(found.repartition(32, "doc").dropDuplicates(["text", "label", "doc"]).select("text", "label", "doc"))
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:  # nothing to tell apart
        return none
    counts = sample.select("text", "label").mapInArrow(_counted, "word string, toxic long, clean long")
    chosen = typical_words(freeze(counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))), n[1], n[0])
    if not chosen:
        return none
    near = sample.mapInArrow(_vectors(chosen), "label int, doc long, near binary")
    return fit(sorted((r["label"], bytes(r["near"]), r["doc"]) for r in near.collect()), chosen)


def score_toxicity(docs: DataFrame, model: SentenceSVM, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score``, ``predicted`` (score of 0.5 or more).

    A document scores as its worst sentence, over its whole text. NULL and empty texts have no sentence near a landmark and score low; repeated
    rows score alike; an empty table gives no rows. Columns named like an added one are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            scores = [scorer(texts.slice(at, 1024).to_pylist()) for at in range(0, b.num_rows, 1024)]
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], names=[*kept, "score"])
        pa.default_memory_pool().release_unused()

    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text")).mapInArrow(scored, f"{schema}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled part of ``docs`` and score all of it; adds ``held_out``, ``score`` and ``predicted``."""
    held = docs.withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    return score_toxicity(held, learn(docs, labels))
