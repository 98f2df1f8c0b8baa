"""Operators on documents: odd rows, empty tables, and small brute-force versions."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.conftest import ODD
from weekpanel.llm import katz, mixing, neardup, packing, quality, rules, sharding, toxicity
from weekpanel.llm.common import remainder, words

WORD = re.compile("[^\x20\x09-\x0d]+")


def lowered(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r[0] is None, r[0] or 0))


# mixing

def test_targets_stop_at_three_times_the_source(spark):
    sizes = {"a": 100, "b": 5, "c": 7, "d": 1000, "e": 0, None: 50}
    rows = [(k or "", k is None, v) for k, v in sizes.items()]
    got = {(r["_key"], r["_null"]): r["target"] for r in mixing.source_targets(
        spark.createDataFrame(rows, "_key string, _null boolean, source_size long")).collect()}
    names = sorted(k for k in sizes if k) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, total = {}, sum(sizes.values())
    while True:
        free = [k for k in names if k not in target]
        left = total - sum(target.values())
        over = [k for k in free if left * weight[k] / sum(weight[f] for f in free) > 3 * sizes[k]]
        if not over:
            target |= {k: left * weight[k] / sum(weight[f] for f in free) for k in free}
            break
        target |= {k: 3 * sizes[k] for k in over}
    for k in names:
        assert got[k or "", k is None] == pytest.approx(target[k])


@pytest.mark.parametrize("seed", range(5))
def test_pivots_keep_the_words(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.integers(0, 90, 40))[::-1].copy()
    for p, at in (mixing.pivot_equal(sizes, 0.3, seed), mixing.pivot(sizes, np.full(40, 0.3), seed)):
        assert (p * sizes).sum() == pytest.approx(0.3 * sizes.sum())
        closed = np.delete(p, at) if at >= 0 else p
        assert set(np.round(closed, 9)) <= {0.0, 1.0}


def test_pivots_keep_expectations():
    sizes = np.array([9, 5, 4, 2, 1])
    mean = np.mean([mixing.pivot_equal(sizes, 0.4, s)[0] for s in range(4000)], axis=0)
    assert np.abs(mean - 0.4).max() < 0.04


def test_mix_of_odd_rows(odd, none):
    out = mixing.mix(odd, F.size(words(F.col("text"))))
    rows = out.collect()
    assert len(rows) == len(ODD)
    assert {r["row"]["doc_id"] for r in rows} == {r[0] for r in ODD}
    assert all(0 <= r["copies"] <= 3 for r in rows) and all(set(r["row"].asDict()) == set(odd.columns) for r in rows)
    assert sorted((r["row"]["doc_id"] or 0, r["copies"]) for r in rows) == sorted((r["row"]["doc_id"] or 0, r["copies"]) for r in out.collect())
    assert mixing.mix(none, F.size(words(F.col("text")))).count() == 0


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaabcd"), rng.randint(1, 60)) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, n int"), F.col("n")).groupBy("row.source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 4 and all(abs(r["taken"] - r["target"]) <= 60 for r in got)


# packing

def test_pieces_give_the_stream_back(odd, none, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = odd.union(odd.sparkSession.createDataFrame(
        [(20, "It's they'll <|endoftext|> <|startoftext|>x don't! café, 3rd été. a.b,c ... ǅ K", "en", "a", 1, 1)], odd.schema))
    pieces = packing.pack(docs, path, length=64).collect()
    wanted = Counter((r[0], tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in docs.select("doc_id", "text").collect())
    stream = sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))
    whole, current = Counter(), []
    place = 0
    for r in stream:
        assert r["sequence_id"] * 64 + r["offset"] == place and r["length"] * 4 == len(r["ids"]) and r["start"] == len(current)
        place += r["length"]
        current += np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist()
        if len(current) == r["doc_tokens"]:
            whole[r["doc_id"], tuple(current)] += 1
            current = []
    assert not current and whole == wanted
    assert packing.pack(none, path).count() == 0


def test_spellings_of_a_word_are_merged_once(monkeypatch):
    """Capitals and marks cost no further merges; the ids are those of the whole text, whatever the letters."""
    sent, runs = [], packing.WordIds._runs

    def spy(self, tokenizer, found, *rest):
        sent.extend((tokenizer is self.plain, w) for w in found)
        return runs(self, tokenizer, found, *rest)

    monkeypatch.setattr(packing.WordIds, "_runs", spy)
    ids_of = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["vorel Vorel VOREL, vorel. étéß! Étéß", None, "", " \x0b\n", "Vorel; w\u030a W\u030a x\x85y \xd7, <|ENDOFTEXT|> it's A.. \u212a \u01c5" + 70 * "Ab"]
    ids, n = ids_of(pa.array(texts))
    wanted = [ids_of.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in wanted] and ids.tolist() == [i for w in wanted for i in w]
    assert sorted(w for plain, w in sent if plain) == [b"vorel", "étéß".encode()]
    assert ids_of(pa.array(["voreL?"]))[0].tolist() == ids_of.tokenizer.encode("voreL?", add_special_tokens=False).ids and len(sent) == len(set(sent))


def test_kept_words_are_few_and_come_again(monkeypatch):
    """At the bound, words that came again stay and those of one text go, as they do at the end of a task; the ids are the same."""
    sent, encode = [], packing.WordIds._encode

    def spy(self, found):
        sent.extend(found)
        return encode(self, found)

    monkeypatch.setattr(packing.WordIds, "_encode", spy)
    monkeypatch.setattr(packing, "KEPT_WORDS", 30)
    ids_of = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(20):
        text = "tako midan rovel, " + " ".join(f"{k}x{i}" for i in range(10))
        assert ids_of(pa.array([text]))[0].tolist() == ids_of.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(ids_of.known) <= 30
    assert len(sent) == len(set(sent)) == 203
    ids_of.forget()
    assert ids_of.known.keys() == {b"", b"tako", b"midan", b"rovel,"}
    many = " ".join(f"y{i}" for i in range(100))  # more than the bound at once
    assert ids_of(pa.array([many, many]))[0].tolist() == 2 * ids_of.tokenizer.encode(many, add_special_tokens=False).ids


# sharding

def test_smallest_capacity_is_the_optimum():
    rng = random.Random(1)
    for _ in range(60):
        sizes, k = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))], rng.randint(1, 5)
        best = {0: [sum(sizes[i:]) for i in range(len(sizes) + 1)]}
        for s in range(1, k):
            best[s] = [min(max(sum(sizes[i:j]), best[s - 1][j]) for j in range(i, len(sizes) + 1)) for i in range(len(sizes) + 1)]
        assert sharding.smallest_capacity(sizes, k) == best[k - 1][0]
        cuts = [0, *sharding.contiguous_cuts(sizes, k), len(sizes)]
        assert cuts == sorted(cuts) and max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) == best[k - 1][0]


def test_shards_of_odd_rows(odd, none):
    rows = sharding.shard_by_bytes(odd, 4).collect()
    texts = {r[0]: r[1] or "" for r in ODD}
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw)) and 0 <= r["shard"] < 4
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    groups = {}
    for r in rows:
        groups.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(g) == 1 for g in groups.values())
    assert sharding.shard_by_bytes(none).count() == 0


# quality rules

def base_counts(text):
    found, lines = WORD.findall(text or ""), [y for y in (text or "").split("\n") if WORD.search(y)]
    places = {}
    for i in range(len(found) - 4):
        places.setdefault(tuple(found[i : i + 5]), []).append(i)
    repeated = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_rules_of_odd_rows(odd, none):
    rows = rules.quality_rules(odd).collect()
    assert len(rows) == len(ODD)
    texts = {r[0]: r[1] for r in ODD}
    for r in rows:
        want = base_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert 0 <= r["char_divergence"] <= 1 and 0 <= r["word_divergence"] <= 1 and not (r["base_failed"] and r["kept"])
        assert r["score"] == dict((x[0], x[5]) for x in ODD)[r["doc_id"]]  # a column that is none of its own stays
    assert rules.quality_rules(none).count() == 0


def test_divergence_against_numpy(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["the", "of", "Zap", "9", "und", "ok!"], 80)) for _ in range(20)]
    rows = rules.quality_rules(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")).collect()

    def histograms(t):
        found, n = t.split(), len(t)
        upper, digit, marks = (sum(map(f, t)) for f in (str.isupper, str.isdigit, lambda c: c == "!"))
        blank = n - sum(map(len, found))
        hits = [found.count(w) for w in rules.COMMON["en"]]
        return np.array([n - blank - upper - digit - marks, upper, digit, marks, 0, blank]), np.array([*hits, len(found) - sum(hits)])

    def distance(p, q):
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        part = [sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0) for a in (p, q)]
        return math.sqrt(max(0, sum(part) / 2))

    each = [histograms(t) for t in texts]
    all_chars, all_words = (sum(e[k] for e in each) for k in (0, 1))
    for r in rows:
        chars, found = each[r["doc_id"]]
        assert r["char_divergence"] == pytest.approx(distance(chars, all_chars), abs=1e-9)
        assert r["word_divergence"] == pytest.approx(distance(found, all_words), abs=1e-9)


# classifiers

@pytest.mark.parametrize("classify", [quality.classify_quality, toxicity.classify_toxicity])
def test_classifiers_take_odd_rows(spark, odd, none, classify):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (2, 0, 1), (3, None, None), (6, 0, 1), (7, 1, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    rows = classify(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] == 1} == {zlib.crc32(b"1") % 5 == 0}
    assert classify(none, labels).count() == 0
    assert len(classify(odd, labels.limit(0)).collect()) == len(ODD)


@pytest.mark.parametrize(("name", "classify"), [("quality", quality.classify_quality), ("toxic", toxicity.classify_toxicity)])
def test_held_out_accuracy(spark, name, classify):
    folder = DATA.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = classify(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([(r["score"] >= 0.5) == (r[name] == 1) for r in rows])
    assert right >= {"quality": 0.95, "toxic": 0.75}[name]


def test_factorisation_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    model = quality.FactorisationMachine(0.5, rng.normal(size=6), rng.normal(size=(6, 3)))
    x = rng.normal(size=(4, 6))
    pairs = [sum(model.factors[i] @ model.factors[j] * v[i] * v[j] for i in range(6) for j in range(i)) for v in x]
    assert np.allclose(model.margin(x), 0.5 + x @ model.weights + pairs)


def brute_kernel(s, t):
    def features(w):
        out = Counter()
        for i in range(len(w)):
            for a, b in toxicity.GAPS:
                if i + b < len(w):
                    out[w[i], w[i + a], w[i + b]] += toxicity.DECAY ** (b - 2)
        return out

    x, y = features(s), features(t)
    return sum(v * y[k] for k, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_subsequence_kernel_against_brute_force():
    marks = toxicity.Landmarks(["idiot", "stupid"])
    for w in ["idiot", "idiiot", "stupidd", "stuppid", "idioten", "banana"]:
        got = marks.near([w]).get(w, np.zeros(2))
        for k, mark in zip(got, marks.chosen, strict=True):
            want = brute_kernel(w, mark)
            assert k == pytest.approx(want**toxicity.POWER if want >= toxicity.LEAST else 0, abs=1e-6)  # weights are 32-bit


def insulted(spark, long=0):
    """80 documents with an insult, longer by ``long`` clean words, and 80 without; the model that learns from them."""
    rng = random.Random(5)
    clean = [f"{a}{b}" for a in ("ta", "mi", "ro", "len", "sar") for b in ("ko", "dan", "vel", "tis", "mor")]
    docs = [[rng.choice(clean) for _ in range(40 + long * (i < 80))] for i in range(160)]
    for d in docs[:80]:
        d[rng.randrange(len(d))] = rng.choice(["blockhead", "numbskull"])
    rows = [(i, ". ".join(" ".join(d[at : at + 20]) for at in range(0, len(d), 20)), int(i < 80)) for i, d in enumerate(docs)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic")), [t for _, t, _ in rows]


def test_toxicity_finds_changed_insults(spark):
    model, _ = insulted(spark)
    score = toxicity.Scorer(model)([f"tako midan {x} rovel" for x in (
        "blockhead", "block-head", "blockhhead", "b l o c k h e a d", "b.l.o.c.k.h.e.a.d", "numbskulll", "Blockhead!!",
        "b. l. o. c. k. h. e. a. d.", "n. u. m. b. s. k. u. l. l", "miko", "", "t. a. k. o. m.", "a b c d e f")])
    assert (score[:9] > 0.5).all() and (score[9:] < 0.5).all()


def test_toxicity_compares_frequent_words_once(spark, monkeypatch):
    """At the bound the words of other texts go, not those at hand or those near an insult; scores are the same."""
    model, _ = insulted(spark)
    slices = [[f"tako midan rovel {' '.join(f'{a}{b}mi{k}' for a in 'bcd' for b in 'aeiou')}", "blockhead miko" if k % 3 else "miko"] for k in range(12)]
    wanted = [s for part in slices for s in toxicity.Scorer(model)(part)]
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 40)
    scorer, sent = toxicity.Scorer(model), []
    near = scorer.marks.near
    monkeypatch.setattr(scorer.marks, "near", lambda found: sent.extend(found) or near(found))
    assert [s for part in slices for s in scorer(part)] == wanted and len(scorer.known) <= 40
    assert sent.count("tako") == 1
    monkeypatch.setattr(toxicity, "KEPT_HITS", 0)
    assert [s for part in slices for s in scorer(part)] == wanted and len(scorer.known) <= 40


def test_toxicity_learns_from_long_texts(spark):
    """The toxic documents are all far longer than the clean ones; none is passed over."""
    model, texts = insulted(spark, long=4000)
    score = toxicity.Scorer(model)(texts)
    assert (score[:80] > 0.5).all() and (score[80:] < 0.5).all()


# language model

def test_katz_against_brute_force(spark, odd):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("the The of a b c d e rare%d" .split() if i % 7 else ["x%d" % i, "the"]) for _ in range(rng.randint(0, 30))) for i in range(60)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    rows = katz.score_texts(docs, remainder(F.col("doc_id"), 10) == 0).collect()
    source = [(r[0], lowered(r[1]) + ["\n"]) for r in docs.collect()]
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, _ in source}
    ones, pairs, context, after = Counter(), Counter(), Counter(), {}
    for i, t in source:
        if not held[i]:
            ones.update(t)
            for h, w in zip([None, *t], t, strict=False):
                pairs[h, w] += 1
                context[h] += 1
                after.setdefault(h, set()).add(w)
    total, distinct = sum(ones.values()), len(ones)
    uni = katz.Unigrams(total, distinct, [sum(c == r for c in ones.values()) for r in range(1, 7)])
    d2 = katz.discounts([0, *(sum(c == r for c in pairs.values()) for r in range(1, 7))])
    p1 = {w: float(uni(np.array([c]))[0]) for w, c in ones.items()}
    assert sum(p1.values()) + uni.unknown == pytest.approx(1)

    def p(h, w):
        c = pairs[h, w]
        if c:
            plain = all(pairs[h, v] > katz.DISCOUNTED for v in after[h])
            return c * (d2[c] if c <= katz.DISCOUNTED else 1) / (context[h] + plain)
        if h not in after:
            return p1.get(w, uni.unknown)
        freed = sum((1 - d2[pairs[h, v]]) * pairs[h, v] for v in after[h] if pairs[h, v] <= katz.DISCOUNTED)
        left = freed / context[h] if freed > 0 else 1 / (context[h] + 1)
        return left / max(1 - sum(p1[v] for v in after[h]), uni.unknown) * p1.get(w, uni.unknown)

    for h in list(after)[:8]:
        assert sum(p(h, w) for w in ones) + p(h, "not a word") == pytest.approx(1)
    wanted = {i: (len(t), sum(w in ones for w in t), sum(math.log10((ones[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t),
                  sum(math.log10(p(h, w)) for h, w in zip([None, *t], t, strict=False))) for i, t in source}
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in source)
    for r in rows:
        n, known, base, score = wanted[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held[r["doc_id"]])
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_katz_of_nothing(none, odd):
    assert katz.score_texts(none, F.lit(False)).count() == 0
    assert {r["score"] for r in katz.score_texts(odd, F.lit(True)).collect()} == {0.0}


def test_katz_blocks_hold_few_bytes_a_word():
    """What a task holds of a block of words is bounded; a table's pairs are spread out one table at a time."""
    rng, n, size = np.random.default_rng(3), 20_000, 200_000
    stream, lens = rng.integers(0, n, size), [size // 100] * 100
    block = pa.table({"ids": [list(range(100))], "held": [[i % 7 == 0 for i in range(100)]], "lens": pa.array([lens], pa.list_(pa.int32())),
                      "a": pa.array([katz.squeeze(stream)], pa.binary())})
    answers = pa.table({"table": pa.array([3], pa.int32()), "kind": pa.array([0], pa.int32()),
                        "a": pa.array([katz.squeeze(np.bincount(stream, minlength=n))], pa.binary()),
                        "b": pa.array([katz.squeeze(rng.permutation(n) + 1)], pa.binary())})
    tracemalloc.start()
    made = katz._Block(block, answers, 256, size, 100)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(made.h) > 0.9 * size and held < 30 * size and most < 70 * size


# near-duplicates

def test_signature_holds_few_hashes_at_once():
    shingles = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    for a, b in ((neardup._A, neardup._B), (neardup._FINE_A, neardup._FINE_B)):
        tracemalloc.start()
        got = neardup.signature(shingles, a, b)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        wanted = np.array([(shingles * x + y).min() for x, y in zip(a, b, strict=True)], dtype=np.uint64)
        assert (got == neardup._mixed(wanted).astype("<u2")).all() and peak < 4e6


def test_near_duplicates_against_brute_force(spark, odd, none, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 60))] for _ in range(25)]
    rows = [(r[0], r[1]) for r in ODD if r[0] is not None]
    for i in range(240):
        t = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        rows.append((1000 + i, (" " if i % 3 else "\n").join(t).upper() if i % 5 == 0 else " ".join(t)))
    monkeypatch.setattr(neardup, "REGION", 6)  # regions are entered deeper and split
    got = neardup.near_duplicates(spark.createDataFrame([*rows, (None, "w1 w2")], "doc_id long, text string")).collect()

    def shingles(t):
        w = lowered(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    assert len(got) == len(rows) + 1
    sizes = dict((i, len(s)) for i, s in sets)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[r["doc_id"]], find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    assert neardup.near_duplicates(none).count() == 0


def test_one_id_with_two_texts(spark):
    """Each text of an id is judged by itself, in the operator and in the stage of the pipeline."""
    import corpus_pipeline

    copy, own = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, copy, "a"), (5, copy, "b"), (5, own, "c"), (5, own, "c"), (6, own, "d"), (7, None, "e"), (None, copy, "f")], "doc_id long, text string, _hash string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(1, 1, True), (5, 1, False), (5, 5, True), (6, 5, False), (7, 7, True), (None, None, True)}
    left = sorted((r["_hash"] for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()))
    assert left == ["a", "c", "e", "f"]


@pytest.mark.parametrize("part", [50, 2048])
def test_near_duplicates_around_one_passage(spark, monkeypatch, part):
    """Pairs that are each other's only near copy, in regions too large at the last depth since all texts share a long passage."""
    monkeypatch.setattr(neardup, "REGION", 4)
    monkeypatch.setattr(neardup, "PART", part)
    passage, rows = [f"p{k}" for k in range(400)], []
    for i in range(300):  # texts 0 and 1, 2 and 3 to 78 and 79 are alike to 0.77, all others to 0.72
        shared = [f"s{i // 2 if i < 80 else i + 1000}_{k}" for k in range(16)]
        rows.append((i, " ".join([*passage, *shared, *[f"o{i}_{k}" for k in range(60)]])))
    rows += [(500 + i, " ".join([*passage, *[f"g{k}" for k in range(76)], f"c{i}"])) for i in range(60)]  # and one group of copies
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 if i < 80 else 500 if i >= 500 else i for i, _ in rows}


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 102), (101, 102)]
    got = dict(tuple(r) for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102)}
