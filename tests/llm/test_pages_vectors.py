"""Extraction of pages and search of vectors, and the pipeline as a whole."""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from weekpanel.llm import extraction, neighbours
from weekpanel.llm.mixing import mix

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header><a href=/>Site name</a></header><nav><ul><li><a>Home</a><li><a>More</a></ul></nav>
<div class="cookie-notice">We use cookies on this page</div>
{begin}<h1>Big &amp; small</h1><div class='ad-box'><p>Buy now</p></div><p>First   para<b>graph</b>
 with&nbsp;text that goes on for a while.<p>Second one, which is also a sentence of words.<form><input>Search this</form>
<blockquote>Quoted &lt;words&gt; here</blockquote>{end}
<section id=comments><p>Nice article, thank you so much</p></section><aside>Read also this</aside><footer>&copy; Someone</footer></body></html>"""
TEXT = "Big & small\nFirst paragraph with text that goes on for a while.\nSecond one, which is also a sentence of words.\nQuoted <words> here"


def test_main_text_of_pages(spark):
    pages = spark.createDataFrame([
        (1, "u", PAGE.format(begin="<article>", end="</article>"), 1), (1, "u", PAGE.format(begin="<article>", end="</article>"), 1),
        (2, "u", PAGE.format(begin="<div>", end="</div>"), 2), (3, None, None, 3), (4, "u", "", 4), (None, "u", "<<<p>a < b & c", 5),
        (6, "u", "<p>" + "long word " * 50_000, 6), (7, "u", "<article><h1>cut off</h1><p>in the midd", 7), (8, "u", "<script>never closed", 8),
    ], "page_id long, url string, html string, text int")
    got = extraction.extract(pages)
    texts = [(r["page_id"], r["text"]) for r in got.collect()]
    assert got.columns == ["page_id", "url", "text"]
    assert Counter(texts) == Counter([
        (1, TEXT), (1, TEXT), (2, TEXT), (3, ""), (4, ""), (None, "<<\na < b & c"), (6, ("long word " * 50_000).strip()),
        (7, "cut off\nin the midd"), (8, ""),
    ])
    assert extraction.extract(pages.limit(0)).count() == 0


def test_run_is_the_best_of_all():
    page = PAGE.format(begin="<div>", end="</div>")
    weights = {"tag:": -0.4, "text:body": 0.3}
    parts = [(w, v) for w, v, _ in extraction.scan(page)]
    scores = [len(v.split()) * weights.get(w, -1.0) if w[:4] == "text" else -0.4 for w, v in parts]
    best = max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))
    total, top = 0.0, 0.0
    for s in scores:
        total = max(0.0, total) + s
        top = max(top, total)
    assert abs(best - top) < 1e-9 and extraction.main_text(page, weights)


def test_teaser_articles_are_not_the_main_text():
    """Articles in a sidebar, menu or footer, beside and within the main article, are left out with what they stand in."""
    card = "<article><p>five or more words of a teaser</p></article>"
    weights = {"text:body": 4.0, "text:outside": -1.0, "text:sidebar": -1.0, "tag:": -0.1}
    for tag in ("aside", "nav", "footer", "div class=sidebar"):
        cards = f"<{tag}>{card * 3}</{tag.split()[0]}>"
        for page in (f"<article><p>The one text here</p></article>{cards}", f"<article><p>The one text</p>{cards}<p>here</p></article><p>no</p>"):
            assert " ".join(extraction.main_text(page, weights).split()) == "The one text here"
    two = "<article><p>The first</p></article><article><p>and the second</p></article>"
    assert extraction.main_text(two, weights) == "The first\nand the second"
    assert extraction.main_text(f"<nav><a>Home</a>{two}", weights) == "The first\nand the second"  # a menu that is never closed


@pytest.mark.parametrize("kind", ["ad", "cookie-notice", "social", "page-header", "newsletter"])
def test_articles_within_adverts_and_notices_are_not_the_main_text(kind):
    card = f'<div class="{kind}"><article><p>buy five or more of our things</p></article></div>'
    assert extraction.main_text(f"<body>{card}<article><p>The story of the day</p></article>{card}</body>", {"text:body": 4.0}) == "The story of the day"


def test_a_form_around_the_whole_page_holds_its_article():
    assert extraction.main_text("<form><article><p>The story of the day</p></article></form>", {"text:body": 4.0}) == "The story of the day"


def test_whole_table_against_its_articles(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = extraction.extract(pages.withColumn("copy", F.col("html"))).collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", r["copy"], re.S).group(1)
        lines = re.sub(r"<[^>]*(>|$)", lambda m: "\n" if re.match(r"</?(p|h1|br)\b", m.group()) else "", inner).split("\n")
        assert r["text"] == "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in lines) if x)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 12)).astype(np.float32).astype(float)
    x[100:160] = x[100]  # one vector many times: ties go to the smaller id
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)] + [
        (5000, None, "n"), (5100, [0.0] * 12, "z"), (5200, [float("nan")] * 12, "f"), (5300, [1.0] * 3, "short"), (None, [1.0] * 12, "no id"),
        (5400, [float("inf")] + [1.0] * 11, "i"), (5500, [None] + [1.0] * 11, "c"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 3000, 100))
    hits = 0
    for q, out in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        out.sort()
        assert [k for k, _, _ in out] == list(range(1, 11)) and all(s == d[v] for _, v, s in out)
        assert [(s, v) for _, v, s in out] == sorted((s, v) for _, v, s in out)
        hits += len({v for _, v, _ in out} & set(best.tolist()))
        if q == 100:
            assert [v for _, v, _ in out] == list(range(101, 111))
    assert hits >= 0.9 * 10 * len(found)


def test_neighbours_of_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0])], schema)
    got = [tuple(r) for r in neighbours.nearest(few, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 2**0.5), (0, 2, 3, 2**0.5)]


def test_balanced_parts():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 5)) + rng.integers(0, 4, 800)[:, None] * 6
    sizes = np.bincount(neighbours.balanced_parts(x, neighbours.neighbour_graph(x), 8), minlength=8)
    assert sizes.min() >= 40 and sizes.max() <= 1.1 * 100 + 1


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("size", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        rows, before = out.collect(), docs.collect()
        if name == "packing":
            assert sum(r["length"] for r in rows if r["doc_id"] == rows[0]["doc_id"]) % rows[0]["doc_tokens"] == 0
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before}
            break
        assert out.columns == docs.columns and {tuple(r) for r in rows} <= {tuple(r) for r in before}
        if name == "near_duplicates":
            sets = []
            for r in before:
                w = re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or "")
                w = re.findall("[^\x20\x09-\x0d]+", w)
                sets.append((r["doc_id"], {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
            kept = {r["doc_id"] for r in rows}
            linked = [(i, j) for x, (i, a) in enumerate(sets) for j, b in sets[:x] if a and b and 100 * len(a & b) >= 75 * len(a | b)]
            assert not any(i in kept and j in kept for i, j in linked) and len(kept) == len(rows)
            assert {i for i, _ in sets} - {i for p in linked for i in p} <= kept
        if name == "mixing":
            copies = {r["row"]["doc_id"]: r["copies"] for r in mix(docs, F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))).collect()}
            assert Counter(r["doc_id"] for r in rows) == Counter({i: n for i, n in copies.items() if n})
        docs = spark.createDataFrame(rows, docs.schema)


def test_pipeline_takes_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:4]:
            docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        assert corpus_pipeline.STAGES[4][1](spark, docs, DATA).count() >= docs.count()
