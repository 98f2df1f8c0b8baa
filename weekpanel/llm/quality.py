"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.common import labelled_sample, remainder

HASHED = 1024
FACTORS = 8
#: Labelled rows of each class to learn from, at most.
PER_CLASS = 3000
ROWS = 1024  # rows scored at once

_BYTES = np.arange(256)
_CLASSES = np.stack([
    np.isin(_BYTES, list(b"abcdefghijklmnopqrstuvwxyz")), np.isin(_BYTES, list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    np.isin(_BYTES, list(b"0123456789")), np.isin(_BYTES, list(b" \t\n\x0b\x0c\r")), np.isin(_BYTES, list(b".,;:?")),
    np.isin(_BYTES, list(b"!")), np.isin(_BYTES, list(b"#*$%&<>@^~=+_\\")), np.isin(_BYTES, list(b"|")), _BYTES >= 128,
]).astype(np.float32)
STATISTICS = len(_CLASSES) + 9


def document_features(text: bytes | None) -> np.ndarray:
    """Hashed words of unit length, then statistics of the whole text and its size as the only metadata."""
    text = text or b""
    x = np.zeros(HASHED + STATISTICS, dtype=np.float32)
    found = text.split()
    n = len(found)
    if n:
        counts = np.bincount(np.fromiter(map(crc32, found), dtype=np.int64, count=n) % HASHED, minlength=HASHED)
        hashed = np.sqrt(counts)
        x[:HASHED] = hashed / np.sqrt(n)
        top = counts.max() / n
    else:
        top = 0.0
    shares = _CLASSES @ np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) / max(1, len(text))
    lines = [y for y in text.split(b"\n") if y.strip()]
    x[HASHED:] = [
        *np.sqrt(shares), len(set(found)) / max(1, n) ** 0.8, top, len(text) / max(1, n) / 20, len(lines) / max(1, n) * 10,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(n) / 10, np.log1p(len(text)) / 12, float(n < 10),
        sum(y.rstrip()[-1:] in b".!?" for y in lines) / max(1, len(lines)),
    ]
    return x


@dataclass(frozen=True)
class FactorisationMachine:
    bias: float
    weights: np.ndarray  # one per feature
    factors: np.ndarray  # features x FACTORS

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Linear part, then all pairs at once: half of the squared sums less the sums of squares."""
        sums = x @ self.factors
        return self.bias + x @ self.weights + 0.5 * ((sums**2).sum(1) - (x**2) @ (self.factors**2).sum(1))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """Logistic loss by Adam over shuffled batches; a fixed seed, so a rerun learns the same."""
    rng = np.random.default_rng(seed)
    p = [np.zeros(1), np.zeros(x.shape[1]), rng.normal(0, 0.05, (x.shape[1], FACTORS))]
    if len(y) == 0 or y.min() == y.max():  # nothing to tell apart
        return FactorisationMachine(4.0 if len(y) == 0 or y[0] else -4.0, p[1].astype(np.float32), 0 * p[2].astype(np.float32))
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 256):
            b = order[at : at + 256]
            xb = x[b].astype(float)
            sums = xb @ p[2]
            f = p[0] + xb @ p[1] + 0.5 * ((sums**2).sum(1) - (xb**2) @ (p[2] ** 2).sum(1))
            g = (1 / (1 + np.exp(-f)) - y[b]) / len(b)
            grads = [
                np.array([g.sum()]), xb.T @ g + decay * p[1],
                xb.T @ (g[:, None] * sums) - ((xb**2).T @ g)[:, None] * p[2] + decay * p[2],
            ]
            step += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return FactorisationMachine(float(p[0][0]), p[1].astype(np.float32), p[2].astype(np.float32))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> FactorisationMachine:
    """Fit on at most ``per_class`` rows of each class; the driver gets their feature vectors, never their texts."""
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [document_features(t).tobytes() for t in b.column(0).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column(1)], ["x", "y"])

    rows = labelled_sample(docs, labels, label, per_class).select("text", F.col("label").cast("double")).mapInArrow(vectors, "x binary, y double")
    found = sorted((r["y"], bytes(r["x"])) for r in rows.collect())
    x = np.frombuffer(b"".join(v for _, v in found), dtype=np.float32).reshape(-1, HASHED + STATISTICS)
    return fit(x, np.array([y for y, _ in found]))


def score_quality(docs: DataFrame, model: FactorisationMachine, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` and ``score``, ``predicted``.

    Every whole text is scored for itself: NULL and empty texts by their statistics, repeated rows alike; an empty table gives no
    rows. Columns named like an added one are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, scores = b.column(b.num_columns - 1).cast(pa.large_binary()), []
            for at in range(0, b.num_rows, ROWS):
                x = np.stack([document_features(t) for t in texts.slice(at, ROWS).to_pylist()])
                scores.append(1 / (1 + np.exp(-np.clip(model.margin(x).astype(float), -50, 50))))
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], names=[*kept, "score"])

    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text")).mapInArrow(scored, f"{schema}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled part of ``docs`` and score all of it; adds ``held_out``, ``score`` and ``predicted``."""
    held = docs.withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    return score_quality(held, learn(docs, labels))
