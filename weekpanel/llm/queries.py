"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.llm.common import read, remainder, words
from weekpanel.llm.extraction import extract
from weekpanel.llm.katz import score_texts
from weekpanel.llm.lexical import search
from weekpanel.llm.mixing import mix
from weekpanel.llm.neardup import near_duplicates
from weekpanel.llm.neighbours import nearest
from weekpanel.llm.packing import pack
from weekpanel.llm.quality import classify_quality
from weekpanel.llm.repeats import remove_repeats
from weekpanel.llm.rules import COMMON, quality_rules
from weekpanel.llm.sharding import shard_by_bytes
from weekpanel.llm.skyband import divergence_audit
from weekpanel.llm.toxicity import classify_toxicity
from weekpanel.session import freeze

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = freeze(read(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(F.col("text"))).alias("n")))
    return mix(sized, F.col("n")).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
    )


@query
def op2_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify_toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted")


@query
def op3_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
    )


@query
def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_by_bytes(read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify_quality(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted")


@query
def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) == 0)


@query
def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op8_best_run_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op9_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op10_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("char_divergence", 6).alias("char_divergence"), F.round("word_divergence", 6).alias("word_divergence"),
    )


@query
def op11_automaton_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op12_skyband_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(read(spark, sf_dir, "documents").select("text", "lang", "source"))


@query
def op13_bloom_slice_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SQL["op7_lsh_forest"] = f"""
with recursive w as (select doc_id, {_WORDS.format(_LOWER)} as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                                          when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w),
n as (select doc_id, count(*) as n from s group by 1),
i as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b using (sh) where a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from i join n x on a = x.doc_id join n y on b = y.doc_id where 100 * shared >= 75 * (x.n + y.n - shared)),
r(doc_id, c) as (select doc_id, doc_id from documents union select e.b, r.c from r join e on r.doc_id = e.a),
m as (select doc_id, min(c) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from documents d join m using (doc_id) left join n using (doc_id)"""


def _rules_sql() -> str:
    """The counts, histograms and verdict of the rules, with their default limits."""
    listed = ", ".join(f"'{k}': [{', '.join(repr(w) for w in v)}]" for k, v in COMMON.items())

    def cut(text: str, chars: str) -> str:
        for c in chars:
            text = f"replace({text}, chr({ord(c)}), '')"
        return text

    blank, symbols = " \t\n\x0b\x0c\r", "#*$%&|<>"

    def distance(p: str, q: str) -> str:
        part = "(case when {0} > 0 then {0} * log2({0} / (({0} + {1}) / 2)) else 0 end)"
        x, y = f"({p}[k] / list_sum({p})::double)", f"({q}[k] / list_sum({q})::double)"
        return (f"case when list_sum({p}) = 0 or list_sum({q}) = 0 then 0 else sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), "
                f"lambda k: ({part.format(x, y)} + {part.format(y, x)}) / 2)), 0)) end")

    return f"""
with d as (select doc_id, coalesce(text, '') as t, case when lang in ({', '.join(map(repr, COMMON))}) then lang else 'other' end as ref from documents),
w as (select *, {_WORDS.format('t')} as ws from d),
c as (select doc_id, ref, ws, len(ws) as n_words, length({cut('t', blank)}) as word_chars, length(t) as n, length(t) - length({cut('t', symbols)}) as n_symbols,
        length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g')) as upper, length(t) - length(regexp_replace(t, '\\p{{Nd}}+', '', 'g')) as digit,
        length({cut('t', symbols)}) - length(regexp_replace({cut('t', symbols)}, '[\\p{{P}}\\p{{S}}]+', '', 'g')) as marks,
        list_filter(string_split(t, chr(10)), lambda l: length({cut('l', blank)}) > 0) as ls,
        coalesce((map {{{listed}}})[ref], []) as words from w),
g as (select doc_id, i, count(*) over (partition by doc_id, g) as n from (
        select doc_id, unnest(range(1, len(ws) - 3)) as i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) as g from c where n_words >= 5)),
p as (select doc_id, count(distinct i + k) as n_repeat_words from g, range(5) v(k) where n > 1 group by 1),
h as (select doc_id, ref, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, n,
        [word_chars - upper - digit - marks - n_symbols, upper, digit, marks, n_symbols, n - word_chars] as chars,
        list_append(hits, n_words - coalesce(list_sum(hits), 0)) as common
      from (select *, list_transform(words, lambda x: len(list_filter(ws, lambda y: y = x))) as hits from c) left join p using (doc_id)),
r as (select ref, list(s order by k) as all_chars from (select ref, k, sum(chars[k]) as s from h, range(1, 7) v(k) group by 1, 2) group by 1),
q as (select ref, list(s order by k) as all_common from (select ref, k, sum(common[k]) as s from h, range(1, 18) v(k) where k <= len(common) group by 1, 2) group by 1),
v as (select h.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
        case when n >= 200 then {distance('chars', 'all_chars')} else 0 end as char_divergence,
        case when n_words >= 60 then {distance('common', 'all_common')} else 0 end as word_divergence
      from h join r using (ref) join q using (ref))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and char_divergence <= 0.22 and word_divergence <= 0.31 as kept,
  round(char_divergence, 6) as char_divergence, round(word_divergence, 6) as word_divergence from v"""


SQL["op10_divergence_rules"] = _rules_sql()


SQL["op11_automaton_repeats"] = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
w as (select r, doc_id, i, array_to_string(ws[i:i+49], ' ') as g
      from (select r, doc_id, ws, unnest(range(1, len(ws) - 48)) as i from d where len(ws) >= 50 and doc_id is not null)),
m as (select r, i, doc_id > min(doc_id) over (partition by g) as again from w),
c as (select r, list(distinct i + k) as gone from m, range(50) v(k) where again group by 1),
k as (select doc_id, len(ws) as n_words, coalesce(len(gone), 0) as n_removed,
        case when gone is null then ws else list_transform(list_filter(range(1, len(ws) + 1), lambda i: not list_contains(gone, i)), lambda i: ws[i]) end as kept
      from d left join c using (r))
select doc_id, n_words::bigint as n_words, n_removed::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k"""

SQL["op12_skyband_audit"] = f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
             regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
t as (select r, lang, source, unnest(ts) as term from d),
k as (select lang, term, count(*) as lang_n from t group by 1, 2 having count(distinct r) >= 10),
v as (select lang, count(*) as size, sum(lang_n) as lang_total from k group by 1),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t join k using (lang, term) group by 1, 2, 3),
x as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.lang_n, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as total, size, lang_total
      from g join k using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // (total + 2 * size) as p,
        1 + (1000000000::hugeint * (lang_n + 2)) // (lang_total + 2 * size) as q from x),
w as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
u as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(w.value, 0) as value
      from g a join g b on a.lang = b.lang and a.source <> b.source left join w on w.lang = a.lang and w.source = a.source and w.item = b.source
      union all select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from p where n > 0 and p > q),
z as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from u)
select lang, source, part, item, value::bigint as value, rank::int as rank from z where part = 'pair' or rank <= 10"""

SQL["op13_bloom_slice_search"] = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
n as (select count(*) as n, sum(len(ts)) as l from d where len(ts) > 0),
t as (select r, term, count(*) as tf from (select r, unnest(ts) as term from d) group by 1, 2),
q as (select distinct item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
w as (select term, floor(1000 * ln((2 * n + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from t group by 1), n),
s as (select q.item_id, d.doc_id, d.r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ts) * n) // l)))) as score
      from q join w using (term) join t using (term) join d on d.r = t.r, n group by 1, 2, 3),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score::bigint as score from k where rank <= 50"""
