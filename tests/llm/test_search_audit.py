"""Lexical search and the divergence audit: odd rows, empty tables, and small brute-force versions."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import ODD, TEXT
from weekpanel.llm import lexical, skyband

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found(pattern, text):
    return re.findall(pattern, (text or "").translate(LOWER))


def in_id_order(score_and_id):
    score, doc_id = score_and_id
    return -score, doc_id is None, doc_id or 0


def best(docs, items, k):
    """The ranking by its definition."""
    pattern = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
    counted = [(r[0], Counter(found(pattern, r[1]))) for r in docs]
    counted = [(d, c) for d, c in counted if c]
    n, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(found(pattern, text))
    out = set()
    for item, ts in asked.items():
        scored = []
        for d, c in counted:
            m = 50 + 50 * c.total() * n // length
            score = sum(lexical.weight_of(n, df[t]) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                scored.append((score, d))
        out |= {(item, rank + 1, d, s) for rank, (s, d) in enumerate(sorted(scored, key=in_id_order)[:k])}
    return out


ITEMS = [(1, "The quick brown FOX"), (2, None), (3, ""), (4, "nothing-of_this zebra"), (None, "line café wörd"), (5, "dog"), (5, "a b c"), (6, "sir " * 5000)]


def test_search_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical.search(odd, items, 3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in got.collect()} == best(ODD, ITEMS, 3)
    assert lexical.search(none, items).count() == 0
    assert lexical.search(odd, items.limit(0)).count() == 0


@pytest.mark.parametrize("items_at_once", [1000, 4])
def test_search_against_all_documents(spark, monkeypatch, items_at_once):
    rng = random.Random(5)
    names = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    docs = [(i % 290, " ".join(rng.choice(names) for _ in range(rng.choice([3, 30, 300])))) for i in range(300)] + [(400 + i, "w1 w2 w3") for i in range(80)]
    items = [(i, " ".join(rng.sample(names, 8))) for i in range(12)]
    monkeypatch.setattr(lexical, "ITEMS", items_at_once)
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 20)
    assert {tuple(r) for r in got.collect()} == best(docs, items, 20)


def test_bounds_are_never_below(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(lexical, "ROWS", 16)
    pa = lexical.pa
    texts = [" ".join(f"w{int(rng.expovariate(0.1))}" for _ in range(200)).encode() for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])
    names = [f"w{i}".encode() for i in range(60)]
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in names], dtype=np.uint64)
    seen, above = 0, 0
    for b in lexical._index({})(iter([batch])):
        ids, sizes, m, slices = (b.column(c)[0].as_py() for c in range(4))
        packed = np.frombuffer(slices, dtype=np.uint8).reshape(m, -1)
        bounds = lexical.term_bounds(packed, hashes, np.full(len(ids), 100), np.array(sizes))
        for at, d in enumerate(ids):
            tf = Counter(texts[d].split())
            exact = np.array([10**9 * tf[t] // (1000 * tf[t] + 2000) for t in names])
            assert (bounds[:, at] >= exact).all()
            seen, above = seen + 1, above + int((bounds[:, at] > 0).sum() - (exact > 0).sum())
    assert seen == 40 and above < 0.05 * 40 * 60


def audit(docs, k, min_docs):
    """All rows of the audit by its definition: (text, lang, source) in."""
    docs = [tuple(x or "" for x in d) for d in docs]
    counted = [(lang, source, Counter(found("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text))) for text, lang, source in docs]
    out = set()
    for lang in {d[1] for d in docs}:
        own = [(s, c) for x, s, c in counted if x == lang]
        df, all_n = Counter(t for _, c in own for t in c), sum((c for _, c in own), Counter())
        kept = [t for t in df if df[t] >= min_docs]
        groups = {s: sum((c for x, c in own if x == s), Counter()) for s, _ in own}
        f = lambda p, q: (p - q) ** 2 // (p + q)

        def shares(n, kept=kept):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(n) for s, n in groups.items()}, shares(all_n)
        for s in groups:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found_, most in (("pair", pairs, None), ("term", terms, k)):
                ranked = sorted(found_, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, v, r + 1) for r, (item, v) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("min_docs", [2, 10])
def test_audit_of_odd_rows(odd, none, min_docs):
    got = skyband.divergence_audit(odd, 10, min_docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == audit([(r[1], r[2], r[3]) for r in ODD], 10, min_docs)
    assert skyband.divergence_audit(none).count() == 0


def test_audit_against_all_terms(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(skyband, "BLOCK", 3)
    monkeypatch.setattr(skyband, "SLICE_TERMS", 20)
    monkeypatch.setattr(skyband, "HELD_TERMS", 50)
    def name():
        i = int(rng.paretovariate(0.6)) % 150
        return chr(97 + i % 26) + "éz"[i % 2] * (i // 26)
    docs = [(" ".join(name() for _ in range(rng.choice([2, 40]))), rng.choice("ab"), f"s{int(rng.expovariate(0.4))}") for _ in range(400)]
    got = skyband.divergence_audit(spark.createDataFrame([(TEXT, "c", "x"), *docs], "text string, lang string, source string").repartition(5), 4, 3)
    assert {tuple(r) for r in got.collect()} == audit([(TEXT, "c", "x"), *docs], 4, 3)


@pytest.mark.parametrize("seed", range(4))
def test_skyband_keeps_what_fewer_than_k_dominate(seed):
    rng = np.random.default_rng(seed)
    high, low = rng.integers(0, 8, 120), rng.integers(0, 8, 120)
    names = [bytes(rng.integers(97, 100, 6).tolist()) + str(i).encode() for i in range(120)]
    wanted = {i for i in range(120) if sum(high[j] >= high[i] and low[j] <= low[i] and names[j] < names[i] for j in range(120)) < 3}
    assert set(skyband.skyband(high, low, names, 3)) == wanted
