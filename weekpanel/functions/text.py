"""Text normalisation and the small text predicates, as native expressions."""

from __future__ import annotations

import difflib
import html
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Java's \s knows ASCII blanks only; Unicode blanks count as blanks here.
BLANK = r"\s\p{Z}\x{1C}-\x{1F}\x{85}"
# Runs of blanks that are not already one plain space, so clean text is scanned but not rewritten.
BLANK_RUNS = rf"[{BLANK}&&[^ ]][{BLANK}]*| [{BLANK}]+"
# Runs without letters that are not already one plain space, likewise.
OTHER_RUNS = r"[^a-zA-Z ][^a-zA-Z]*| [^a-zA-Z]+"
LINKS = r"http[^\s\p{Z}]+|www[^\s\p{Z}]+"
MENTIONS = r"@[\p{L}\p{N}_]+|#"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x: Column | str) -> Column:
    """Missing as empty, runs of blanks as one blank, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(_c(x).cast("string"), F.lit("")), BLANK_RUNS, " "))


def is_blank(x: Column | str) -> Column:
    return F.coalesce(F.trim(_c(x)) == "", F.lit(True))


def unescape_html(x: Column | str) -> Column:
    """HTML entities as characters. Texts without an ampersand reach the Python worker as NULL.

    Marked as non-deterministic so the optimizer keeps it in its own projection: inlined into every
    later use it would run many times and bloat the generated code. Rows are sent in batches of 100, not of 10,000 whole texts.
    """

    @F.udf(T.StringType(), useArrow=False)
    def unescape(s: str | None) -> str | None:
        return None if s is None else html.unescape(s)

    c = _c(x)
    marked = F.contains(c, F.lit("&"))
    return F.when(marked, unescape.asNondeterministic()(F.when(marked, c))).otherwise(c)


def normalize_text(x: Column | str, unescape: bool = True) -> Column:
    """Readable text: entities resolved, blanks collapsed, missing as empty."""
    c = _c(x).cast("string")
    return collapse(unescape_html(c) if unescape else c)


def without_links(x: Column) -> Column:
    """Links and mentions removed. The plain substring tests spare most texts the two patterns."""
    linked = F.contains(x, F.lit("http")) | F.contains(x, F.lit("www"))
    c = F.when(linked, F.regexp_replace(x, LINKS, "")).otherwise(x)
    marked = F.contains(x, F.lit("@")) | F.contains(x, F.lit("#"))
    return F.when(marked, F.regexp_replace(c, MENTIONS, "")).otherwise(c)


def canonical(x: Column | str, collapsed: bool = False) -> Column:
    """Comparison form: no links, mentions, digits or punctuation; lower case.

    ``collapsed`` says that blanks are already single.
    """
    c = without_links(_c(x) if collapsed else collapse(x))
    return F.trim(F.lower(F.regexp_replace(c, OTHER_RUNS, " ")))


def words(x: Column | str) -> Column:
    """Words of a single-blank text; none for the empty text."""
    c = _c(x)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


# Texts that mean a missing id.
MISSING_IDS = ["", "nan", "none", "<na>"]


def normalize_id(x: Column | str) -> Column:
    """Trimmed id; every spelling of missing is the empty string."""
    c = F.trim(F.coalesce(_c(x).cast("string"), F.lit("")))
    return F.when(F.lower(c).isin(MISSING_IDS), F.lit("")).otherwise(c)


def text_or_headline(summary: Column | str, headline: Column | str) -> Column:
    """Summary when it says something, else the headline, else empty."""

    def clean(x):
        c = F.trim(_c(x))
        return F.when(c.isin("", "nan"), F.lit(None)).otherwise(c)

    return F.coalesce(clean(summary), clean(headline), F.lit(""))


def any_prefix(x: Column, prefixes: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(x, F.lit(p))
    return out


def any_suffix(x: Column, suffixes: Iterable[str]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | F.endswith(x, F.lit(s))
    return out


def label_column(prefix: str, label: Column | str) -> Column:
    """Column name of a score label: blanks to underscores, first letter upper, rest lower."""
    c = F.replace(_c(label), F.lit(" "), F.lit("_"))
    return F.concat(F.lit(prefix + "_"), F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def tokens_contained(small: Column, large: Column) -> Column:
    """True when the first word list is not empty and all its words are in the second."""
    return (F.size(small) > 0) & (F.size(F.array_except(small, large)) == 0)


def _grams_allow(a: str, b: str, threshold: float, q: int = 3) -> bool:
    """False when two texts share too few q-grams to reach the ratio.

    The matched characters are a common subsequence, so at most ``(1 - t)(|a| + |b|)`` characters are
    deleted or inserted, and each of them breaks at most q grams.
    """
    edits = (1.0 - threshold) * (len(a) + len(b))
    wanted = max(len(a), len(b)) - q + 1 - edits * q
    if wanted <= 0:
        return True
    left = Counter(a[i:i + q] for i in range(len(a) - q + 1))
    right = Counter(b[i:i + q] for i in range(len(b) - q + 1))
    return sum((left & right).values()) >= wanted


def _similar(a: str, b: str, threshold: float) -> bool:
    """Match ratio at least the threshold. All tests before the last are bounds and only save time."""
    if a == b:
        return True
    m = difflib.SequenceMatcher(None, a, b)
    return (
        m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and _grams_allow(a, b, threshold)
        and m.ratio() >= threshold
    )


def similar(a: Column, b: Column, threshold: float) -> Column:
    """True when the match ratio of two texts reaches the threshold.

    The ratio is at most ``2 * shorter / (sum of lengths)``. Pairs beyond that bound reach the
    Python worker as NULL and cost nothing there. Rows are sent in batches of 100, not of 10,000 whole texts.
    """

    @F.udf(T.BooleanType(), useArrow=False)
    def ratio(p: str | None, q: str | None) -> bool:
        return p is not None and q is not None and _similar(p, q, threshold)

    la, lb = F.length(a), F.length(b)
    possible = (la + lb > 0) & (2.0 * F.least(la, lb) >= threshold * (la + lb))
    return F.coalesce(possible & ratio(F.when(possible, a), F.when(possible, b)), F.lit(False))
