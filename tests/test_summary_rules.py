"""Summary classes with all rules on, entities and similarity too, against a plain version."""

from __future__ import annotations

import difflib
import hashlib
import html
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tests.conftest import DATA
from weekpanel.plans import summary_quality as S
from weekpanel.workload.fixtures import Tables

LONG = "Quarterly revenue of the northern company rises more than analysts expected before winter holidays"
HAND = [
    ("nearly", LONG, LONG.replace("winter", "summer"), "headline_like"),
    ("entity", "Profits &amp; losses", "Profits &amp; losses were announced by &quot;North&quot; during the long conference yesterday evening.", "usable"),
    ("short", "Entities", "&#65; &#66; &#67; &#68; &#69;", "too_short"),
    ("ends", "Entities", "The company announced its yearly figures during the conference&hellip;", "truncated"),
    ("other", LONG, "An independent text about something that nobody wrote into any headline whatsoever yesterday.", "usable"),
]


def normal(x):
    return " ".join(html.unescape(x or "").split())


def canon(x):
    x = re.sub(r"@\w+|#", "", re.sub(r"http\S+|www\S+", "", x))
    return " ".join(re.sub("[^a-zA-Z ]+", " ", x).lower().split())


def plain(headline, summary):
    s = normal(summary)
    c, h = canon(s), canon(normal(headline))
    w = c.split()
    if not s:
        kind = "missing"
    elif len(s) < 25 or len(w) < 5:
        kind = "too_short"
    elif c in S.GENERIC_SOURCES:
        kind = "generic_source_only"
    elif any(b in s.lower() for b in S.BOILERPLATE):
        kind = "boilerplate"
    elif c.startswith(tuple(S.GENERIC_PREFIXES)) and len(w) <= 9 or c.endswith(tuple(S.GENERIC_SUFFIXES)) and len(w) <= 12:
        kind = "generic_feed_phrase"
    elif s.endswith(("...", "…")) or s[-1].isalnum() and len(w) >= 6 and len(w[-1]) <= 4:
        kind = "truncated"
    elif h and (set(w) <= set(h.split()) and len(w) <= 10 or alike(c, h)):
        kind = "headline_like"
    else:
        kind = "usable"
    return kind, len(s), len(w)


def alike(a, b):
    return 2 * min(len(a), len(b)) >= 0.92 * (len(a) + len(b)) and (a == b or difflib.SequenceMatcher(None, a, b).ratio() >= 0.92)


def test_rules_on_entities_and_near_headlines(spark):
    news = spark.createDataFrame([x[:3] for x in HAND], "ID string, Headline string, Summary string")
    assert {r["ID"]: r["IssueType"] for r in S.classify_summary(news).collect()} == {i: kind for i, _, _, kind in HAND}
    assert all(plain(h, s)[0] == kind for _, h, s, kind in HAND)


@pytest.fixture(scope="module")
def expected(spark):
    docs = Tables(spark, DATA).fixture("documents").select("ID", "Headline", "Summary").collect()
    return {r["ID"]: (r["Headline"], r["Summary"], *plain(r["Headline"], r["Summary"])) for r in docs}


def test_registered_classes(spark, expected):
    got = entry_module.queries()["summary_classes_whole"](spark, DATA).collect()
    assert {r["ID"]: (r["IssueType"], r["SummaryChars"], r["SummaryWords"]) for r in got} == {i: x[2:] for i, x in expected.items()}


def test_registered_counts(spark, expected):
    got = entry_module.queries()["summary_issue_counts_whole"](spark, DATA).collect()
    counts = Counter(x[2] for x in expected.values())
    assert {r["IssueType"]: r["n"] for r in got} == {i: counts[i] for i in S.ISSUES}


def test_registered_imputation(spark, expected):
    got = entry_module.queries()["impute_summary_whole"](spark, DATA).select("ID", "digest", F.col("same").cast("int")).collect()
    texts = {i: (normal(h), normal(s if kind == "usable" else h)) for i, (h, s, kind, *_) in expected.items()}
    assert {r["ID"]: (r["digest"], r["same"]) for r in got} == {i: (hashlib.md5(t.encode()).hexdigest(), int(t == h)) for i, (h, t) in texts.items()}
