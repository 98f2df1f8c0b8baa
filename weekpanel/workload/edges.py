"""Queries on rows that once were lost or depended on a size: missing ids, NULL in lists, constants, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekpanel.operators.aggregates import correlation_pairs
from weekpanel.operators.joins import unmatched
from weekpanel.operators.reshape import pivot_wide
from weekpanel.operators.rows import INLINE_VALUES, filter_not_in
from weekpanel.plans.scoring import analysis_text, distinct_texts, score_with_cache
from weekpanel.session import shared_dir
from weekpanel.sources.upsert import fresh_path
from weekpanel.streaming.jobs import stream_dedup_news, write_batches
from weekpanel.workload.registry import query

_VALID = "lower(trim(coalesce(ID, ''))) not in ('', 'nan', 'none', '<na>')"


@query("stream_dedup_missing_ids", "K2", "Ticker:s valid:s n:l",
       f"""select Ticker, case when v then 'yes' else 'no' end as valid, count(*) as n from (
             select distinct Ticker, {_VALID} as v, case when {_VALID} then ID end as i, case when not {_VALID} then Date end as d,
                    case when not {_VALID} then Headline end as h, case when not {_VALID} then Summary end as s from f_articles) group by 1, 2""")
def _(t):
    """Three files; each repeats articles of the file before, with and without a valid id."""
    base = fresh_path(shared_dir(t.spark))
    a = t.fixture("articles").select("ID", "Ticker", "Date", "Headline", "Summary")
    year = F.year("Date")
    for low, high in ((1900, 1999), (1999, 2001), (2000, 2100)):
        a.where((year >= low) & (year <= high)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = t.spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    write_batches(stream_dedup_news(stream, "4000 days"), f"{base}/out", f"{base}/state").start().awaitTermination()
    valid = F.lower(F.trim(F.coalesce("ID", F.lit("")))).isin("", "nan", "none", "<na>")
    return t.spark.read.parquet(f"{base}/out").groupBy("Ticker", F.when(valid, "no").otherwise("yes").alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_not_in_missing", "B2", "form:s ID:s n:l",
       """select f.form, ID, count(*) as n from f_articles cross join (select 'long' as form union all select 'short') f
          where ID is null or ID not in ('nan', '2', '4') group by 1, 2""")
def _(t):
    """A NULL in the list, below and above the length from which the list is joined."""
    a = t.fixture("articles").select("ID")
    short = [None, "nan", "2", "4"]
    long = [*short, *[f"no such id {i}" for i in range(INLINE_VALUES)]]
    both = filter_not_in(a, "ID", short).withColumn("form", F.lit("short")).unionByName(filter_not_in(a, "ID", long).withColumn("form", F.lit("long")))
    return both.groupBy("form", "ID").agg(F.count(F.lit(1)).alias("n"))


@query("correlation_constant_and_nan", "D12 P18", "form:s a:s b:s r:d",
       """with x as (select l_quantity as q, l_discount as d, case when l_linenumber % 3 = 0 then null else l_tax end as n from lineitem),
               c as (select corr(q, d) as qd, corr(q, n) as qn, corr(d, n) as dn from x)
          select f.form, v.a, v.b, v.r from (select 'blocked' as form union all select 'native') f cross join (
            select 'q' as a, 'd' as b, qd as r from c union all select 'q', 'k', null from c union all select 'q', 'n', qn from c
            union all select 'd', 'k', null from c union all select 'd', 'n', dn from c union all select 'k', 'n', null from c) v""")
def _(t):
    """A constant column and one with NaN, in both forms."""
    x = t.raw("lineitem").select(
        F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.lit(0.1).alias("k"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("l_tax").cast("double")).alias("n"))
    columns = ["q", "d", "k", "n"]
    return correlation_pairs(x, columns).withColumn("form", F.lit("native")).unionByName(
        correlation_pairs(x, columns, native_pairs=0).withColumn("form", F.lit("blocked")))


@query("cache_with_duplicates", "P10", "ID:s n:l FINBERT_Positive:d",
       "select cast(doc_id as varchar) as ID, count(*) as n, max(case when trim(text) in ('', 'nan') then null else 0.75 end) as FINBERT_Positive from documents group by 1")
def _(t):
    """Every text twice in the cache: the later batch counts and no article is multiplied."""
    d = t.raw("documents").select(
        F.col("doc_id").cast("string").alias("ID"), F.col("source").alias("Ticker"), F.lit(None).cast("timestamp_ntz").alias("Date"),
        F.col("text").alias("Summary"), F.lit("").alias("Headline"))
    texts = distinct_texts(analysis_text(d))
    cache = texts.select("AnalysisText", F.explode(F.array(F.lit(1), F.lit(2))).alias("batch_id")).select(
        "*", F.lit(0.1).alias("TEXTBLOB_Polarity"), (F.col("batch_id") * 0.5 - 0.25).alias("FINBERT_Positive"), F.lit(0.5).alias("EMO_Joy"))
    scored, _ = score_with_cache(d, cache)
    return scored.groupBy("ID").agg(F.count(F.lit(1)).alias("n"), F.max("FINBERT_Positive").alias("FINBERT_Positive"))


@query("coefficients_newest", "I1 C15", "Ticker:s beta_neutral_lag_1:d beta_neutral_lag_2:d",
       """select Ticker, max(case when lag = 1 then beta_neutral - 1 end) as beta_neutral_lag_1, max(case when lag = 2 then beta_neutral - 1 end) as beta_neutral_lag_2
          from f_coeff group by 1""")
def _(t):
    """Each (ticker, lag) twice: the newer row counts, though its value is smaller; lags beyond the list drop out."""
    c = t.fixture("coeff").select("Ticker", "lag", "beta_neutral")
    twice = c.withColumn("loaded", F.lit(1)).unionByName(c.select("Ticker", "lag", (F.col("beta_neutral") - 1).alias("beta_neutral"), F.lit(2).alias("loaded")))
    return pivot_wide(twice, "Ticker", "lag", [1, 2], ["beta_neutral"], newest="loaded")


@query("facts_without_dimension", "E20 C9", "n_nationkey:l",
       "select distinct c_nationkey as n_nationkey from customer where c_nationkey % 5 = 2")
def _(t):
    """Natural keys of facts that the dimension does not hold are reported."""
    dim = t.raw("nation").where("n_nationkey % 5 <> 2")
    return unmatched(t.raw("customer"), dim, {"c_nationkey": "n_nationkey"})
