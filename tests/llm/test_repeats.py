"""Removal of repeated passages: odd rows, empty tables, and small brute-force versions."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tests.llm.conftest import ODD
from weekpanel.llm import repeats


def removed(docs, window):
    """(doc_id, n_words, n_removed, kept text) of every row by definition."""
    split = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in docs]
    first = {}
    for d, ws in split:
        for i in range(len(ws) - window + 1):
            if d is not None:
                g = tuple(ws[i : i + window])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, ws in split:
        gone = set()
        for i in range(len(ws) - window + 1):
            if d is not None and first[tuple(ws[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("window", [50, 9])
def test_odd_rows(odd, none, window):
    out = repeats.remove_repeats(odd, window)
    assert set(out.select("row.*").columns) == set(odd.columns) - {"text"}
    assert got(out) == removed([(r[0], r[1]) for r in ODD], window)
    assert repeats.remove_repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_against_all_windows(spark, seed):
    """Near copies, a passage in a third of all documents, a common line, exact copies, and one id with two texts."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    passage, line, base = fresh(40), fresh(9), fresh(150)
    docs = []
    for i in range(240):
        words = fresh(rng.choice([5, 30, 90]))
        if i % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = passage[rng.randint(0, 8) : rng.randint(30, 40)]
        elif i % 3 == 1:
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(150)] = f"e{rng.randint(0, 3)}"
        words[3:3] = line if i % 2 else []
        docs.append((rng.randint(-50, 300), " ".join(words)))
    docs += docs[:30] + [(docs[i][0] + 1, docs[i][1]) for i in range(40)] + [(7, "a " * 200), (8, "a " * 60 + "b")]
    out = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), 12)
    assert got(out) == removed(docs, 12)


def test_spread_over_shards_and_tasks(spark, monkeypatch):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    docs = [(i, " ".join([f"x{rng.randint(0, 999)}" for _ in range(20)] + passage[: rng.randint(15, 60)])) for i in range(120)]
    monkeypatch.setattr(repeats, "SHARD_WORDS", 40)
    monkeypatch.setattr(repeats, "STREAM_WORDS", 300)
    assert got(repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 10)) == removed(docs, 10)


@pytest.mark.parametrize("seed", range(6))
def test_automaton_knows_matches_and_first_documents(seed):
    rng = random.Random(seed)
    texts = [(rng.randint(0, 9), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 25))]) for _ in range(8)]
    automaton = repeats.Automaton()
    for d, ws in texts:
        automaton.add(ws, d)
    automaton.close()
    for d in range(11):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(60)]
        gone = np.zeros(60, dtype=bool)
        for i in range(60 - 4 + 1):
            if any(words[i : i + 4] == ws[j : j + 4] for e, ws in texts if e < d for j in range(len(ws) - 3)):
                gone[i : i + 4] = True
        spans = automaton.spans(words, d, 4)
        covered = np.zeros(60, dtype=bool)
        for a, b in spans:
            covered[a:b] = True
        assert (covered == gone).all() and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_least_of_runs():
    a = np.random.default_rng(0).integers(0, 1 << 40, 200).astype(np.uint64)
    for width in (1, 2, 3, 8, 43, 200):
        assert (repeats._least(a, width) == np.array([a[i : i + width].min() for i in range(200 - width + 1)])).all()
