"""Main text of HTML pages as the maximum-scoring run of words and tags.

Words score by where they stand, tags cost by their name; both weights are log-odds from labelled pages. One linear scan
finds the run with the largest sum, and its text blocks without menus, adverts and the like are the main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the weights are learned from, at most.
LEARN_PAGES = 2000

# Elements of HTML by their role.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "title", "head"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend",
    "li", "main", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
INLINE = {"a", "abbr", "b", "cite", "code", "em", "font", "i", "img", "input", "label", "q", "s", "small", "span", "strong", "sub", "sup", "u"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
KINDS = {
    "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "button": "form",
    "select": "form", "textarea": "form", "dialog": "notice", "fieldset": "form",
}
NAMES = {
    "menu": "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination pager toc skip",
    "header": "header masthead topbar site-header page-header",
    "footer": "footer site-footer page-footer copyright colophon legal",
    "sidebar": "sidebar side aside widget widgets related recommended recommendations more-stories teaser teasers tags",
    "notice": "cookie cookies consent gdpr notice notices banner alert popup modal overlay paywall subscribe newsletter signup",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsbygoogle",
    "comments": "comment comments disqus replies reply respond discussion",
    "form": "form search login share social sharing",
}
ROLES = {
    "navigation": "menu", "banner": "header", "contentinfo": "footer", "complementary": "sidebar", "search": "form",
    "alert": "notice", "dialog": "notice", "alertdialog": "notice", "form": "form", "menu": "menu", "menubar": "menu",
}
KIND_OF = {name: kind for kind, names in NAMES.items() for name in names.split()}
#: An article within these stays what they are: it is a teaser, an advert or the like. A ``form`` element may hold a whole page, though.
KEEPING = {"comments", "sidebar", "menu", "footer", "header", "notice", "advert", "form"}
BODY_WORD, TAG_COST = 1.0, 0.05  # without labelled pages

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def _kind(tag: str, attributes: str, inside: bool) -> str | None:
    """What an element holds beside the main text, if anything. ``inside``: within an article or main element."""
    if tag in ("body", "html", "article", "main"):
        return None
    if tag in KINDS and not (tag == "header" and inside):
        return KINDS[tag]
    if "=" in attributes:
        for name, *values in NAMED.findall(attributes):
            for value in "".join(values).lower().split():
                if name.lower() == "role":
                    kind = ROLES.get(value)
                else:
                    kind = KIND_OF.get(value) or next((KIND_OF[p] for p in re.split(r"[-_]+", value) if p in KIND_OF), None)
                if kind and not (kind == "header" and inside):
                    return kind
        if HIDDEN.search(attributes):
            return "notice"
    return None


def scan(page: str | None) -> Iterator[tuple[str, str, bool]]:
    """Texts and tags in page order: ("text", its raw text) or (tag name, its kind), each with what it stands in.

    Yields (what, value, inside): ``what`` is "text:<kind>" or "tag:<name>", ``inside`` tells whether an article or main element is open.
    """
    page, at, skip_to, kind, kind_tag, depth, open_main = page or "", 0, None, None, "", 0, Counter()
    closes, within = {}, Counter()  # where a tag is closed for the last time; articles that are open within an element of some kind
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            yield f"text:{kind or 'body'}", page[at : m.start()], bool(open_main)
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        tag, closing = name.lower(), bool(m.group(1) or m.group(4))
        attributes = (m.group(3) or m.group(6) or "")
        if tag in RAW and not closing and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if end or tag != "head":
                at = end.end() if end else len(page)
            continue
        if kind is not None:
            if tag == kind_tag:
                depth += -1 if closing else 1
                if kind_tag == "p" and not closing:
                    depth = 0
                if depth <= 0:
                    kind = None
                    if closing:
                        yield f"tag:{tag}", "", bool(open_main)
                        continue
            elif not closing and tag in ("article", "main") and kind != "comments":
                if kind_tag not in closes:
                    closes[kind_tag] = max((c.start() for c in re.finditer(rf"</{re.escape(kind_tag)}\b", page, re.I)), default=-1)
                if tag == "main" or kind_tag == "p" or kind_tag == "form" or kind not in KEEPING or closes[kind_tag] < at:  # an element that is never closed holds no article
                    kind = None
            elif kind_tag == "p" and tag in BLOCKS and tag != "br":
                kind = None
        if tag in ("article", "main"):
            if closing:
                yield f"tag:{tag}", "", bool(open_main)
                if kind is not None and within[tag]:
                    within[tag] -= 1
                else:
                    open_main = +(open_main - Counter([tag]))
                continue
            if kind is None:
                open_main[tag] += 1
            else:
                within[tag] += 1
        elif kind is None and not closing and tag not in VOID:
            kind = _kind(tag, attributes, bool(open_main))
            if kind is not None:
                kind_tag, depth, within = tag, 1, Counter()
        yield f"tag:{tag}", kind or "", bool(open_main)
    if at < len(page):
        yield f"text:{kind or 'body'}", page[at:], bool(open_main)


def parts_of(page: str | None) -> list[tuple[str, str, bool]]:
    """The parts of a page; where it marks an article or main element, plain words beside that are told from those within."""
    parts = list(scan(page))
    if any(inside for _, _, inside in parts):
        parts = [("text:outside" if what == "text:body" and not inside else what, value, inside) for what, value, inside in parts]
    return parts


def page_counts(page: str | None) -> Counter:
    """How often each kind of word and each tag stands inside and outside the labelled part; none without a label."""
    counts, labelled = Counter(), False
    for what, value, inside in parts_of(page):
        content = inside and (not value if what.startswith("tag:") else what == "text:body")
        labelled |= inside
        counts[what if what[:4] == "text" or what[4:] in BLOCKS or what[4:] in INLINE else "tag:", content] += (
            len(value.split()) if what[:4] == "text" else 1
        )
    return counts if labelled else Counter()


def learn_weights(pages: DataFrame, page: str = "html", order: str = "page_id") -> dict[str, float]:
    """Log-odds of words by place and of tags by name, from pages that mark their article.

    The pages are those with the ``LEARN_PAGES`` smallest hashes of their key; one number per kind and tag name comes to the driver.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = sum(map(page_counts, b.column(0).to_pylist()), Counter())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in total], pa.string()), pa.array([c for _, c in total], pa.bool_()), pa.array(list(total.values()), pa.int64())],
                ["what", "content", "n"],
            )

    picked = pages.select(F.col(f"`{page}`").alias("page"), F.xxhash64(F.col(f"`{order}`")).alias("h")).where(
        F.col("page").rlike("(?i)<(article|main)[\\s>]")
    )
    last = picked.select("h").orderBy("h").limit(LEARN_PAGES).agg(F.max("h")).first()[0]
    some = picked.where(F.col("h") <= F.lit(last).cast("long")).select("page").mapInArrow(counted, "what string, content boolean, n long")
    inner, outer = Counter(), Counter()
    for r in some.groupBy("what", "content").agg(F.sum("n").alias("n")).collect():
        (inner if r["content"] else outer)[r["what"]] += r["n"]
    weights = {}
    for what in {*inner, *outer}:
        odds = max(-4.0, min(4.0, log((inner[what] + 1) / (outer[what] + 1))))
        weights[what] = (max(odds, BODY_WORD) if what == "text:body" else min(odds, -BODY_WORD)) if what[:4] == "text" else min(odds, -TAG_COST)
    return weights


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best run of one page, blocks joined by a newline. What is left out within an article costs the run nothing."""
    parts, scores = [], []
    for what, value, inside in parts_of(page):
        parts.append((what, value))
        if inside and what != "text:body" and (value or what[:4] == "text"):
            scores.append(0.0)
        elif what[:4] == "text":
            n = len(value.split())
            scores.append(n * weights.get(what, BODY_WORD if what == "text:body" else -BODY_WORD))
        else:
            scores.append(weights.get(what, weights.get("tag:", -TAG_COST)))
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, begin, end = total, start, i + 1
    blocks, block = [], []
    for what, value in [*parts[begin:end], ("tag:p", "")]:
        if what == "text:body":
            block.append(html.unescape(value))
        elif what[:4] == "tag:" and what[4:] in BLOCKS:
            blocks.append(" ".join("".join(block).split()))
            block = []
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame, weights: dict[str, float] | None = None, page: str = "html", order: str = "page_id") -> DataFrame:
    """All columns of ``pages`` but ``html``, and ``text``: the main text of every whole page.

    NULL and empty pages give an empty text, repeated rows give repeated rows, an empty table none. A column named
    ``text`` is replaced.
    """
    kept = [c for c in pages.columns if c not in (page, "text")]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)
    learned = learn_weights(pages, page, order) if weights is None else weights

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = [main_text(p, learned) for p in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*kept, "text"])

    return pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{page}`").alias("_page")).mapInArrow(extracted, f"{schema}, text string")
