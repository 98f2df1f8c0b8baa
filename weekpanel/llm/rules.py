"""Quality rules by distribution divergence: a text against the usual histograms of its language.

Only built-in functions run here. One pass over the texts leaves a row of counts per document; the references are sums of
those rows, five at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.common import words
from weekpanel.session import freeze

# Frequent function words of each language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with", "as", "on", "are", "this"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "una"],
}
SYMBOLS = "#*$%&|<>"
BLANK_CHARS = " \t\n\x0b\x0c\r"
WINDOW = 5


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c))
    return text


def text_counts(docs: DataFrame) -> DataFrame:
    """Counts of every whole text beside all columns of ``docs`` but ``text``.

    Adds ``counts``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ``chars`` (characters by class) and
    ``common`` (how often each common word of the language occurs, then all other words).
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    lang = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise("other")
    known = F.map_from_arrays(F.array(*map(F.lit, COMMON)), F.array(*[F.array(*map(F.lit, w)) for w in COMMON.values()]))
    base = docs.select(
        F.struct(*kept).alias("row"), text.alias("t"), words(F.col("text")).alias("w"), lang.alias("ref"),
        F.try_element_at(known, lang).alias("list"),
    )
    windows = base.withColumn("n", F.size("w")).withColumn("h", F.expr(
        f"case when n < {WINDOW} then cast(array() as array<bigint>) else transform(sequence(0, n - {WINDOW}), i -> xxhash64("
        + ", ".join(f"w[i + {k}]" for k in range(WINDOW)) + ")) end"
    ))
    # Places of windows that occur again: neighbours in hash order. Only texts with a repeat pay for the sort.
    ordered = windows.withColumn("s", F.expr(
        "case when size(array_distinct(h)) < size(h) then sort_array(transform(h, (x, i) -> struct(x, i))) end"
    ))
    places = ordered.withColumn("p", F.expr(
        "sort_array(transform(filter(sequence(0, size(s) - 1), j -> (j > 0 and s[greatest(j - 1, 0)].x = s[j].x) or "
        "(j < size(s) - 1 and s[least(j + 1, size(s) - 1)].x = s[j].x)), j -> s[j].i))"
    ))
    covered = F.expr(
        f"case when s is null then 0 else aggregate(transform(sequence(0, size(p) - 1), k -> "
        f"if(k = size(p) - 1, {WINDOW}, least({WINDOW}, p[least(k + 1, size(p) - 1)] - p[k]))), 0, (a, x) -> a + x) end"
    )
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")
    solid, plain = _without(F.col("t"), BLANK_CHARS), _without(F.col("t"), SYMBOLS)
    measured = places.select(
        "row", "ref", F.col("n").cast("long").alias("n_words"), covered.cast("long").alias("n_repeat_words"),
        F.length("t").cast("long").alias("n"), F.length(solid).cast("long").alias("word_chars"),
        (F.octet_length("t") - F.octet_length(plain)).cast("long").alias("n_symbols"),
        lines.alias("l"),
        *[(F.length("t") - F.length(F.regexp_replace("t", pattern, ""))).cast("long").alias(name) for name, pattern in (
            ("upper", r"\p{Lu}+"), ("digit", r"\p{Nd}+"), ("marks", r"[\p{P}\p{S}&&[^#*$%&|<>]]+"))],
        F.filter("w", lambda x: x.isin(sorted({w for ws in COMMON.values() for w in ws}))).alias("m"), "list",
    )
    hits = F.transform(F.coalesce("list", F.array().cast("array<string>")), lambda c: F.size(F.filter("m", lambda x: x == c)).cast("long"))
    last = measured.withColumn("hits", hits)
    return last.select(
        "row.*", F.col("ref").alias("_ref"),
        F.struct(
            "n_words", "word_chars", "n_symbols", (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
            "n_repeat_words",
            F.array(
                F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("marks") - F.col("n_symbols"),
                "upper", "digit", "marks", "n_symbols", F.col("n") - F.col("word_chars"),
            ).alias("chars"),
            F.concat("hits", F.array(F.col("n_words") - F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x))).alias("common"),
        ).alias("_counts"),
    )


def _divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, square root) of two histograms of counts; 0 where either is empty."""
    def share(h: Column) -> Column:
        total = F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
        return F.transform(h, lambda x: F.try_divide(x.cast("double"), total))

    def part(x: Column, mean: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / mean)).otherwise(0.0)

    terms = F.zip_with(share(p), share(q), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.coalesce(total, F.lit(0.0)), F.lit(0.0)))


def quality_rules(
    docs: DataFrame, max_char_divergence: float = 0.22, max_word_divergence: float = 0.31,
    min_chars: int = 200, min_words: int = 60,
) -> DataFrame:
    """Judge every document; all columns but ``text`` stay, ``counts``, divergences and verdict are added.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_divergence, word_divergence, base_failed and kept.
    The references are the histograms of all documents of a language (``lang``; anything but the four known ones forms a fifth
    group, which has no common words and so no word divergence). Texts under ``min_chars`` characters or ``min_words`` words are too
    short for the respective histogram and are not judged by it. NULL and empty texts have 0 words and fail the base
    rule. Rows are judged one by one: repeated rows come out repeated, an empty table gives no rows. Columns named like
    an added one are replaced by it.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    drop = {*added, "char_divergence", "word_divergence", "base_failed", "kept", "_ref", "_counts"}
    rows = freeze(text_counts(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in drop])))

    def summed(field: str, n: int) -> Column:
        return F.array(*[F.sum(F.get(F.col(f"_counts.{field}"), F.lit(i))) for i in range(n)])

    references = rows.groupBy("_ref").agg(
        summed("chars", 6).alias("_chars"), summed("common", len(COMMON["en"]) + 1).alias("_common"),
    ).withColumn("_common", F.filter("_common", lambda x: x.isNotNull()))
    judged = rows.join(F.broadcast(references), "_ref")  # a row for each known language and one for the rest: five at most
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    n_chars = F.aggregate("_counts.chars", F.lit(0).cast("long"), lambda a, x: a + x)
    return judged.withColumns(
        {c: F.col(f"_counts.{c}") for c in added}
        | {
            "char_divergence": F.when(n_chars >= min_chars, _divergence(F.col("_counts.chars"), F.col("_chars"))).otherwise(0.0),
            "word_divergence": F.when(
                F.col("_counts.n_words") >= min_words, _divergence(F.col("_counts.common"), F.col("_common"))
            ).otherwise(0.0),
        }
    ).withColumns({
        "base_failed": failed,
        "kept": ~failed & (F.col("char_divergence") <= max_char_divergence) & (F.col("word_divergence") <= max_word_divergence),
    }).drop("_ref", "_counts", "_chars", "_common")
