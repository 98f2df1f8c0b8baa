"""Queries on articles, summaries, scores, weekly news features and the modeling table."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekpanel.contracts import MODEL_NEWS_COLUMNS
from weekpanel.functions.dates import market_week, parse_mixed_date
from weekpanel.functions.numeric import sentiment
from weekpanel.functions.text import (
    canonical, collapse, label_column, normalize_id, normalize_text, similar, text_or_headline, tokens_contained, words,
)
from weekpanel.operators.joins import anti, first_match
from weekpanel.operators.ranking import occurrence_index
from weekpanel.operators.reshape import pivot_wide, scores_to_columns, to_long
from weekpanel.operators.rows import count_out_of_range, filter_date_range
from weekpanel.operators.sets import upsert
from weekpanel.plans.news import clean_news, dedup_news, fill_summary
from weekpanel.plans.reports import missing_profile
from weekpanel.plans.scoring import analysis_text, distinct_texts, lexicon_scores, missing_texts, score_texts, score_with_cache, usable_cache
from weekpanel.plans.summary_quality import classify_summary, impute_summary, summary_quality_report, top_issues
from weekpanel.plans.weekly_news import attach_headline, coefficients_wide, granger_weekly_score, modeling_table, weekly_news_features
from weekpanel.session import freeze
from weekpanel.sources.files import labeled_sentences, prune_entities
from weekpanel.workload.fundamentals import PANEL, PANEL_COLUMNS, PANEL_OUT, panel_of
from weekpanel.workload.prices import FRI
from weekpanel.workload.registry import query

START, END = "1999-01-01", "2002-01-01"
BLANK = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]+"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{BLANK}', ' ', 'g'))"


def canon(x: str) -> str:
    c = f"regexp_replace({collapsed(x)}, 'http[^\\s\\p{{Z}}]+|www[^\\s\\p{{Z}}]+', '', 'g')"
    c = f"regexp_replace({c}, '@[\\p{{L}}\\p{{N}}_]+|#', '', 'g')"
    c = f"lower(regexp_replace({c}, '[^a-zA-Z ]', ' ', 'g'))"
    return f"trim(regexp_replace({c}, ' +', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"case when {x} = '' then []::varchar[] else string_split({x}, ' ') end"


_VALID = "lower(trim(coalesce(ID, ''))) not in ('', 'nan', 'none', '<na>')"
_FILLED = "case when Summary is null or trim(Summary) = '' then coalesce(Headline, '') else Summary end"


def _dedup(src: str) -> str:
    return f"""
      select ID, Ticker, Date, Headline, Summary from (select *, row_number() over (
          partition by case when {_VALID} then ID end, Ticker, case when {_VALID} then null else Date end,
            case when {_VALID} then null else Headline end, case when {_VALID} then null else Summary end
          order by ID nulls first, Ticker, Date, Headline, Summary) as rn from ({src})) where rn = 1"""


_BOUNDED = f"""select ID, Ticker, Date, Headline, {_FILLED} as Summary from f_articles
               where Date >= timestamp '{START}' and Date < timestamp '{END}'"""
_ART = "ID:s Ticker:s day:t Headline:s Summary:s"


def _with_day(df):
    return df.withColumn("day", F.col("Date").cast("date"))


@query("news_bounds_dedup", "B3 G5 P7 H5 B11", _ART,
       f"select *, Date as day from ({_dedup(_BOUNDED + ' and Ticker in (select Ticker from f_companies where SectorCode <> 3)')})")
def _(t):
    universe = t.fixture("companies").filter("SectorCode <> 3")
    return _with_day(clean_news(t.fixture("articles"), universe, START, END))


@query("news_two_branch_dedup", "G5", _ART,
       f"select *, Date as day from ({_dedup('select * from f_articles')})")
def _(t):
    return _with_day(dedup_news(t.fixture("articles").select("ID", "Ticker", "Date", "Headline", "Summary")))


@query("date_bound_counts", "B3", "kept:l dropped:l",
       f"""select count(*) filter (Date >= timestamp '{START}' and Date < timestamp '{END}') as kept,
                  count(*) filter (not (Date >= timestamp '{START}' and Date < timestamp '{END}')) as dropped from f_articles""")
def _(t):
    return count_out_of_range(t.fixture("articles"), "Date", START, END)


@query("prune_universe", "A11 C5", "Ticker:s n:l",
       """select Ticker, count(*) as n from f_articles where Ticker in (select Ticker from f_companies where SectorCode = 2)
          group by Ticker""")
def _(t):
    kept = prune_entities(t.fixture("articles"), t.fixture("companies").filter("SectorCode = 2"))
    return kept.groupBy("Ticker").agg(F.count(F.lit(1)).alias("n"))


@query("news_upsert", "G6 C6", "Ticker:s source:s n:l",
       """select Ticker, 'old' as source, count(*) as n from f_articles where Date < timestamp '2001-06-01' and Ticker not in
            (select Ticker from f_articles where Date >= timestamp '2001-06-01' and Headline like 'error%') group by 1
          union all select Ticker, 'new', count(*) from f_articles where Date >= timestamp '2001-06-01' and Headline like 'error%' group by 1""")
def _(t):
    a = t.fixture("articles")
    cut = F.lit("2001-06-01").cast("timestamp_ntz")
    old = a.filter(F.col("Date") < cut).withColumn("source", F.lit("old"))
    new = a.filter((F.col("Date") >= cut) & F.startswith("Headline", F.lit("error"))).withColumn("source", F.lit("new"))
    return upsert(old, new, ["Ticker"]).groupBy("Ticker", "source").agg(F.count(F.lit(1)).alias("n"))


@query("filled_summaries", "H5 H1", "Ticker:s filled:l n:l",
       """select Ticker, count(*) filter (Summary is null or trim(Summary) = '') as filled, count(*) as n from f_articles group by 1""")
def _(t):
    a = t.fixture("articles").withColumn("_old", F.col("Summary"))
    f = fill_summary(a)
    return f.groupBy("Ticker").agg(F.count_if(F.trim("_old") == "").alias("filled"), F.count(F.lit(1)).alias("n"))


_ANALYSIS = "coalesce(nullif(nullif(trim(Summary), ''), 'nan'), nullif(nullif(trim(Headline), ''), 'nan'), '')"


@query("analysis_texts", "H5 D5", "AnalysisText:s",
       f"select distinct {_ANALYSIS} as AnalysisText from f_articles where {_ANALYSIS} <> ''")
def _(t):
    return distinct_texts(analysis_text(t.fixture("articles")))


@query("normalized_texts", "H1 H3 H4 H6", "ID:s text:s n_words:l n_chars:l",
       f"""select ID, md5(c) as text, len({tokens('c')}) as n_words, length(s) as n_chars from
           (select ID, {canon('Summary')} as c, {collapsed('Summary')} as s from f_documents)""")
def _(t):
    d = t.fixture("documents").withColumns({"c": canonical("Summary"), "s": collapse("Summary")})
    return d.select("ID", F.md5(F.col("c").cast("binary")).alias("text"), F.size(words("c")).alias("n_words"), F.length("s").alias("n_chars"))


@query("normalized_ids", "H3", "key:s n:l",
       """select case when lower(trim(coalesce(ID, ''))) in ('', 'nan', 'none', '<na>') then '' else trim(ID) end as key, count(*) as n
          from f_articles group by 1""")
def _(t):
    return t.fixture("articles").groupBy(normalize_id("ID").alias("key")).agg(F.count(F.lit(1)).alias("n"))


_BOILER = "headline only article|benzinga pro traders|benzinga does not provide investment advice|all rights reserved|to add benzinga news as your preferred source on google|never miss a trade again"
_PREFIX = " or ".join(f"starts_with(c, '{p}')" for p in ["according to", "shares of", "the stock", "stocks of"])
_SUFFIX = " or ".join(f"ends_with(c, '{p}')" for p in [
    "reported", "according to", "after a report emerged that", "following a report that", "following report", "amid reports", "on report"])
CLASSES = rf"""
  select *, case when s = '' then 'missing'
      when length(s) < 25 or len(w) < 5 then 'too_short'
      when c in ('benzinga', 'bloomberg', 'reuters', 'upgrades', 'downgrades', 'the', 'u.s.', 'us') then 'generic_source_only'
      when regexp_matches(lower(s), '{_BOILER}') then 'boilerplate'
      when ({_PREFIX}) and len(w) <= 9 then 'generic_feed_phrase'
      when ({_SUFFIX}) and len(w) <= 12 then 'generic_feed_phrase'
      when ends_with(s, '...') or ends_with(s, '…') then 'truncated'
      when regexp_matches(s, '[\p{{L}}\p{{N}}]$') and len(w) >= 6 and length(w[-1]) <= 4 then 'truncated'
      when hc <> '' and len(w) > 0 and list_has_all(string_split(hc, ' '), w) and len(w) <= 10 then 'headline_like'
      else 'usable' end as IssueType
  from (select *, {tokens('c')} as w from (select ID, Ticker, {collapsed('Headline')} as h, {collapsed('Summary')} as s,
        {canon('Summary')} as c, {canon('Headline')} as hc from f_documents))"""


@query("summary_classes", "P8 H6 H7 H8 H10 L1", "ID:s IssueType:s SummaryChars:l SummaryWords:l",
       f"select ID, IssueType, length(s) as SummaryChars, len(w) as SummaryWords from ({CLASSES})")
def _(t):
    return classify_summary(t.fixture("documents"), similarity=False, unescape=False)


@query("summary_issue_counts", "P9 H22 F6", "position:l IssueType:s n:l pct:d",
       f"""select g.position, g.IssueType, count(c.IssueType) as n, round(100.0 * count(c.IssueType) / (select count(*) from f_documents), 1) as pct
           from (select unnest(range(8)) as position, unnest(['missing', 'too_short', 'generic_source_only', 'boilerplate',
                 'generic_feed_phrase', 'truncated', 'headline_like', 'usable']) as IssueType) g
           left join ({CLASSES}) c using (IssueType) group by 1, 2""")
def _(t):
    return summary_quality_report(classify_summary(t.fixture("documents"), similarity=False, unescape=False))


@query("impute_summary", "P8", "ID:s digest:s same:l",
       f"""select ID, md5(case when IssueType = 'usable' then s else h end) as digest, cast(IssueType <> 'usable' or s = h as int) as same
           from ({CLASSES})""")
def _(t):
    fixed = impute_summary(t.fixture("documents"), similarity=False, unescape=False)
    return fixed.select("ID", F.md5(F.col("Summary").cast("binary")).alias("digest"), (F.col("Summary") == collapse("Headline")).cast("int").alias("same"))


@query("summary_classes_whole", "P8 H2 H6 H7 H8 H9 H10 L1", "ID:s IssueType:s SummaryChars:l SummaryWords:l")
def _(t):
    return classify_summary(t.fixture("documents"))


@query("summary_issue_counts_whole", "P9 H2 H9 H22 F6", "position:l IssueType:s n:l pct:d")
def _(t):
    return summary_quality_report(classify_summary(t.fixture("documents")))


@query("impute_summary_whole", "P8 H2 H9", "ID:s digest:s same:l")
def _(t):
    fixed = impute_summary(t.fixture("documents"))
    same = (F.col("Summary") == normalize_text("Headline")).cast("int")
    return fixed.select("ID", F.md5(F.col("Summary").cast("binary")).alias("digest"), same.alias("same"))


@query("summary_issues_with_similarity", "P8 P9 H2 H9 L1", "IssueType:s n:l pct:d")
def _(t):
    return top_issues(summary_quality_report(classify_summary(t.fixture("documents"))))


@query("similar_headlines", "H9 H2", "ID:s close:l")
def _(t):
    d = t.fixture("documents")
    s, h = canonical(normalize_text("Summary")), canonical(normalize_text("Headline"))
    return d.select("ID", similar(s, h, 0.92).cast("int").alias("close"))


@query("contained_headlines", "H10", "ID:s inside:l",
       f"""select ID, cast(len(w) > 0 and list_has_all({tokens('hc')}, w) as int) as inside from ({CLASSES})""")
def _(t):
    return t.fixture("documents").select(
        "ID", tokens_contained(words(canonical("Summary")), words(canonical("Headline"))).cast("int").alias("inside"))


NY = "(Date at time zone 'UTC' at time zone 'America/New_York')"
WEEK = f"""case when (isodow({NY}) = 5 and hour({NY}) >= 16) or isodow({NY}) in (6, 7)
                then {FRI.format(f'cast({NY} as date)')} + 7 else {FRI.format(f'cast({NY} as date)')} end"""
WEEK_NEXT = f"""case when isodow({NY}) = 5 and hour({NY}) >= 16 then {FRI.format(f'cast({NY} as date)')} + 7
                     else {FRI.format(f'cast({NY} as date)')} end"""


@query("market_week_counts", "H15 D2 H18", "Ticker:s week:t n:l", f"select Ticker, {WEEK} as week, count(*) as n from f_articles group by 1, 2")
def _(t):
    return t.fixture("articles").groupBy("Ticker", market_week("Date").alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("market_week_next_friday", "H15", "Ticker:s week:t n:l", f"select Ticker, {WEEK_NEXT} as week, count(*) as n from f_articles group by 1, 2")
def _(t):
    return t.fixture("articles").groupBy("Ticker", market_week("Date", "next_friday").alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("mixed_dates", "H13", "o_orderkey:l day:t",
       "select o_orderkey, cast(case when o_orderkey % 4 = 3 then null else o_orderdate end as date) as day from orders")
def _(t):
    d = F.col("o_orderdate")
    m = F.col("o_orderkey") % 4
    text = F.when(m == 0, F.date_format(d, "yyyy-MM-dd")).when(m == 1, F.date_format(d, "MM/dd/yyyy")).when(
        m == 2, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("not a date"))
    return t.raw("orders").select("o_orderkey", parse_mixed_date(text).alias("day"))


@query("day_parts", "H18", "month:s weekday:l hour:l n:l",
       "select strftime(ts, '%Y-%m') as month, dayofweek(ts) + 1 as weekday, hour(ts) as hour, count(*) as n from events group by 1, 2, 3")
def _(t):
    ts = F.col("ts")
    return t.raw("events").groupBy(F.date_format(ts, "yyyy-MM").alias("month"), F.dayofweek(ts).alias("weekday"), F.hour(ts).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"))


@query("event_properties", "H26", "event_type:s k:s n:l",
       "select event_type, json_extract_string(props, '$.k') as k, count(*) as n from events group by 1, 2")
def _(t):
    return t.raw("events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("score_labels", "I2 H25 H21 L3", "event_id:l EMO_Very_happy:d EMO_Calm:d",
       "select event_id, round(value / 100, 4) as EMO_Very_happy, round(1 - value / 100, 4) as EMO_Calm from events")
def _(t):
    v = F.col("value") / 100
    pair = F.array(F.struct(F.lit("Very Happy").alias("label"), v.alias("score")), F.struct(F.lit("calm").alias("label"), (1 - v).alias("score")))
    return scores_to_columns(t.raw("events").select("event_id", pair.alias("s")), "s", "EMO", ["very happy", "calm"])


@query("label_names", "H25", "event_type:s name:s",
       "select distinct event_type, 'EMO_' || upper(event_type[1]) || lower(event_type[2:]) as name from events")
def _(t):
    return t.raw("events").select("event_type", label_column("EMO", "event_type").alias("name")).distinct()


@query("article_sentiment", "H23", "ID:s Ticker:s s:d",
       "select ID, Ticker, FINBERT_Positive - FINBERT_Negative as s from f_articles")
def _(t):
    return t.fixture("articles").select("ID", "Ticker", sentiment("FINBERT_Positive", "FINBERT_Negative").alias("s"))


@query("coefficients_wide", "I1", "Ticker:s " + " ".join(f"{b}_lag_{k}:d" for b in ("beta_negative", "beta_neutral", "beta_positive") for k in (1, 2, 3)),
       "select Ticker, " + ", ".join(f"max({b}) filter (lag = {k}) as {b}_lag_{k}" for b in ("beta_negative", "beta_neutral", "beta_positive") for k in (1, 2, 3))
       + " from f_coeff group by Ticker")
def _(t):
    return coefficients_wide(t.fixture("coeff"))


@query("coefficients_long_again", "I1 I3", "Ticker:s name:s value:d",
       " union all ".join(f"select Ticker, 'beta_neutral_lag_{k}' as name, beta_neutral as value from f_coeff where lag = {k}" for k in (1, 2, 3)))
def _(t):
    wide = pivot_wide(t.fixture("coeff"), "Ticker", "lag", [1, 2, 3], ["beta_neutral"])
    return to_long(wide, ["Ticker"], [f"beta_neutral_lag_{k}" for k in (1, 2, 3)], "name", "value")


_OCC = """row_number() over (partition by Ticker, Date, case when lower(trim(coalesce(ID, ''))) in ('', 'nan', 'none', '<na>')
          then '' else trim(ID) end order by {o}) - 1"""


@query("article_occurrence", "E13 S14", "Ticker:s Headline:s occurrence:l n:l",
       f"""select Ticker, Headline, occurrence, count(*) as n from (select *, {_OCC.format(o='Headline, FINBERT_Negative')} as occurrence
           from (select * exclude (Date), cast(Date as date) as Date from f_articles)) group by 1, 2, 3""")
def _(t):
    a = t.fixture("articles").withColumns({"Date": F.col("Date").cast("date"), "_id": normalize_id("ID")})
    o = occurrence_index(a, ["Ticker", "Date", "_id"], [F.col("Headline"), F.col("FINBERT_Negative")])
    return o.groupBy("Ticker", "Headline", "occurrence").agg(F.count(F.lit(1)).alias("n"))


@query("headline_by_occurrence", "C7 E13", "Ticker:s Headline:s n:l score:d",
       f"""with l as (select *, {_OCC.format(o='FINBERT_Negative')} as k from (select ID, Ticker, cast(Date as date) as Date, FINBERT_Negative from f_articles)),
                r as (select *, {_OCC.format(o='Headline')} as k from (select ID, Ticker, cast(Date as date) as Date, Headline from f_articles))
           select l.Ticker, r.Headline, count(*) as n, max(FINBERT_Negative) as score from l left join r on l.Ticker = r.Ticker and l.Date = r.Date
             and (case when lower(trim(coalesce(l.ID, ''))) in ('', 'nan') then '' else l.ID end)
               = (case when lower(trim(coalesce(r.ID, ''))) in ('', 'nan') then '' else r.ID end) and l.k = r.k group by 1, 2""")
def _(t):
    a = t.fixture("articles").withColumn("Date", F.col("Date").cast("date"))
    out = attach_headline(a.select("ID", "Ticker", "Date", "FINBERT_Negative"), a.select("ID", "Ticker", "Date", "Headline"))
    return out.groupBy("Ticker", "Headline").agg(F.count(F.lit(1)).alias("n"), F.max("FINBERT_Negative").alias("score"))


@query("first_score_per_company", "C8", "Ticker:s companyName:s score:d",
       """select c.Ticker, c.companyName, arg_min(FINBERT_Negative, (Date, FINBERT_Negative)) as score from f_companies c
          left join f_articles a on a.Ticker = c.Ticker and a.Date >= timestamp '2000-01-01' group by 1, 2""")
def _(t):
    a = filter_date_range(t.fixture("articles"), "Date", "2000-01-01", "2100-01-01")
    a = a.withColumn("score", F.col("FINBERT_Negative"))
    return first_match(t.fixture("companies"), a, ["Ticker"], [F.col("Date"), F.col("score")], ["score"])


SHARE = ["FINBERT_Negative", "FINBERT_Neutral", "FINBERT_Positive"]
WEEKLY = f"""
  with a as (select Ticker, Headline, Date, {', '.join(SHARE)}, {WEEK} as week from f_articles),
       d as (select Ticker, week, Headline, count(*) as n, min((Date, {', '.join(SHARE)})) as r from a group by 1, 2, 3),
       c as (select Ticker, {', '.join(f"max({b}) filter (lag = {k}) as {b}_{k}" for b in ('beta_negative', 'beta_neutral', 'beta_positive') for k in (1, 2, 3))}
             from f_coeff group by Ticker),
       e as (select d.Ticker, week, n, r[2] as neg, r[3] as neu, r[4] as pos, c.* exclude (Ticker) from d left join c on c.Ticker = d.Ticker)
  select Ticker, week as WeekEndingFriday, avg(neg) as NEWS_FINBERT_Negative_Mean, avg(neu) as NEWS_FINBERT_Neutral_Mean,
         avg(pos) as NEWS_FINBERT_Positive_Mean, avg(pos - neg) as NEWS_Sentiment_Mean,
         {', '.join(f"avg(beta_negative_{k} * neg + beta_neutral_{k} * neu + beta_positive_{k} * pos) as NEWS_FINBERT_GrangerArticleScore_Lag{k}_Mean" for k in (1, 2, 3))},
         count(*) as NEWS_ArticleCount, sum(n) as NEWS_RawArticleCount
  from e group by 1, 2"""
WEEKLY_OUT = ("WeekEndingFriday:t Ticker:s NEWS_FINBERT_Negative_Mean:d NEWS_FINBERT_Neutral_Mean:d NEWS_FINBERT_Positive_Mean:d "
              "NEWS_Sentiment_Mean:d " + " ".join(f"NEWS_FINBERT_GrangerArticleScore_Lag{k}_Mean:d" for k in (1, 2, 3))
              + " NEWS_ArticleCount:l NEWS_RawArticleCount:l")


def weekly_of(t):
    return weekly_news_features(t.fixture("articles"), t.fixture("coeff"), SHARE)


@query("weekly_news_features", "P11 C15 D1 D2 H23", WEEKLY_OUT, WEEKLY)
def _(t):
    return weekly_of(t)


_L = [f"lag(NEWS_FINBERT_GrangerArticleScore_Lag{k}_Mean, {k}) over w" for k in (1, 2, 3)]
GRANGER = f"""
  select * exclude (x), case when x is null then null when coalesce(stddev_samp(x) over g, 0) = 0 then 0.0
           else (x - avg(x) over g) / stddev_samp(x) over g end as NEWS_FINBERT_Granger_Score
  from (select *, {_L[0]} + {_L[1]} + {_L[2]} as x from (
          select k.Ticker, k.WeekEndingFriday, n.* exclude (Ticker, WeekEndingFriday)
          from (select distinct Ticker, WeekEndingFriday from ({PANEL})) k left join ({WEEKLY}) n using (Ticker, WeekEndingFriday))
        window w as (partition by Ticker order by WeekEndingFriday)) window g as (partition by Ticker)"""


@query("granger_weekly_score", "P12 E14 E15 S11 S12 L4", "Ticker:s WeekEndingFriday:t NEWS_Sentiment_Mean:d NEWS_FINBERT_Granger_Score:d", GRANGER)
def _(t):
    return granger_weekly_score(weekly_of(t), panel_of(t))


MODELING = f"""
  select * from (select p.*, {', '.join(f'g.{c}' for c in MODEL_NEWS_COLUMNS)} from ({PANEL}) p left join ({GRANGER}) g using (Ticker, WeekEndingFriday))
  where """ + " and ".join(f'"{c}" is not null' for c in [*PANEL_COLUMNS, *MODEL_NEWS_COLUMNS])
MODELING_OUT = PANEL_OUT + " " + " ".join(f"{c}:d" for c in MODEL_NEWS_COLUMNS)


def modeling_of(t):
    """The panel is stored once: its keys align the news, its rows make the table."""
    panel = freeze(panel_of(t))
    return modeling_table(panel, granger_weekly_score(weekly_of(t), panel))


@query("modeling_table", "P13 B8 B6", MODELING_OUT, MODELING)
def _(t):
    return modeling_of(t)


@query("missing_news_by_ticker", "P16", "Ticker:s TotalRows:l RowsWithAnyNewsMissing:l RowsWithAllNewsMissing:l RowsWithAnyNonNewsMissing:l PctAllNewsMissing:d",
       f"""with x as (select p.*, {', '.join(f'g.{c}' for c in MODEL_NEWS_COLUMNS)} from ({PANEL}) p left join ({GRANGER}) g using (Ticker, WeekEndingFriday)),
               y as (select Ticker, ({' or '.join(f'{c} is null' for c in MODEL_NEWS_COLUMNS)}) as a, ({' and '.join(f'{c} is null' for c in MODEL_NEWS_COLUMNS)}) as b,
                     ({' or '.join(f'"{c}" is null' for c in PANEL_COLUMNS)}) as o from x)
           select Ticker, count(*) as TotalRows, count(*) filter (a) as RowsWithAnyNewsMissing, count(*) filter (b) as RowsWithAllNewsMissing,
                  count(*) filter (o) as RowsWithAnyNonNewsMissing, round(100.0 * count(*) filter (b) / count(*), 2) as PctAllNewsMissing
           from y group by Ticker""")
def _(t):
    from weekpanel.operators.rows import select_features

    panel = panel_of(t)
    news = select_features(granger_weekly_score(weekly_of(t), panel), prefix="NEWS_", keep_prefixed=MODEL_NEWS_COLUMNS)
    return missing_profile(panel.join(news, ["WeekEndingFriday", "Ticker"], "left"))


@query("labeled_sentences", "A7 B13", "digest:s label:s label_id:l",
       """select md5(trim(text)) as digest, case quality when 1 then 'positive' else 'negative' end as label,
                 case quality when 1 then 2 else 0 end as label_id from labels join documents using (doc_id)""")
def _(t):
    d = t.raw("labels").join(t.raw("documents"), "doc_id")
    line = F.concat("text", F.lit("@"), F.when(F.col("quality") == 1, "Positive ").otherwise(" negative"))
    rows = labeled_sentences(d.select(line.alias("line")), "line")
    return rows.select(F.md5(F.col("sentence").cast("binary")).alias("digest"), "label", "label_id")


_POS = "['gain','gains','profit','profits','growth','beat','beats','strong','rise','rises','record','up']"
_NEG = "['loss','losses','drop','drops','fall','falls','weak','miss','misses','lawsuit','risk','down']"
_LEX = f"""
  select x, n, len(list_filter(w, lambda v: list_contains({_POS}, v))) as p, len(list_filter(w, lambda v: list_contains({_NEG}, v))) as m
  from (select x, {tokens('c')} as w, len({tokens('c')}) as n from (select x, {canon('x')} as c from
    (select distinct {_ANALYSIS} as x from f_documents where {_ANALYSIS} <> '')))"""


@query("lexicon_scores", "L2 P10", "digest:s FINBERT_Positive:d FINBERT_Negative:d TEXTBLOB_Polarity:d",
       f"""select md5(x) as digest, coalesce(round(p / nullif(n, 0), 4), 0) as FINBERT_Positive, coalesce(round(m / nullif(n, 0), 4), 0) as FINBERT_Negative,
                  coalesce(round((p - m) / nullif(p + m, 0), 4), 0) as TEXTBLOB_Polarity from ({_LEX})""")
def _(t):
    s = lexicon_scores(distinct_texts(analysis_text(t.fixture("documents"))))
    return s.withColumn("digest", F.md5(F.col("AnalysisText").cast("binary")))


@query("texts_not_in_cache", "C6 P10", "digest:s",
       f"""select distinct md5({_ANALYSIS}) as digest from f_documents where {_ANALYSIS} <> ''
           and {_ANALYSIS} not in (select {_ANALYSIS} from f_documents where lang = 'en')""")
def _(t):
    d = t.fixture("documents")
    cache = distinct_texts(analysis_text(d.filter("lang = 'en'")))
    return missing_texts(distinct_texts(analysis_text(d)), cache).select(F.md5(F.col("AnalysisText").cast("binary")).alias("digest"))


def _length_scorer(texts):
    """Stands for a plugged-in model: one mapping of metric to value for each text of a batch."""
    return [{"TEXTBLOB_Polarity": (len(x) % 13) / 13 - 0.5, "FINBERT_Positive": (x.count("e") % 7) / 7, "EMO_Joy": None if len(x) % 5 == 0 else len(x) / 7} for x in texts]


@query("plugged_in_scores", "L2 P10", "digest:s TEXTBLOB_Polarity:d FINBERT_Positive:d EMO_Joy:d",
       """select md5(x) as digest, round((length(x) % 13) / 13.0e0 - 0.5e0, 4) as TEXTBLOB_Polarity, round(((length(x) - length(replace(x, 'e', ''))) % 7) / 7.0e0, 4) as FINBERT_Positive,
                 case when length(x) % 5 <> 0 then round(length(x) / 7.0e0, 4) end as EMO_Joy
          from (select distinct case when trim(Summary) = '' then trim(Headline) else trim(Summary) end as x from f_articles)""")
def _(t):
    metrics = ["TEXTBLOB_Polarity", "FINBERT_Positive", "EMO_Joy"]
    scored = score_texts(distinct_texts(analysis_text(t.fixture("articles"))), _length_scorer, metrics)
    return scored.select(F.md5(F.col("AnalysisText").cast("binary")).alias("digest"), *metrics)


@query("scores_with_cache", "P10 L2 G6 C6", "ID:s Ticker:s FINBERT_Positive:d EMO_Joy:d",
       f"""select d.ID, d.Ticker, case when a = '' then null when lang_en then 0.25 else coalesce(round(p / nullif(n, 0), 4), 0) end as FINBERT_Positive,
                  case when a = '' then null when lang_en then 0.5 else coalesce(round(j / nullif(n, 0), 4), 0) end as EMO_Joy
           from (select ID, Ticker, {_ANALYSIS} as a, {_ANALYSIS} in (select {_ANALYSIS} from f_documents where lang = 'en') as lang_en from f_documents) d
           left join (select x, n, p, len(list_filter({tokens(canon('x'))}, lambda v: list_contains(['happy','glad','win','wins','record'], v))) as j from ({_LEX})) s on d.a = s.x""")
def _(t):
    d = t.fixture("documents").withColumn("Date", F.lit(None).cast("timestamp_ntz"))
    known = distinct_texts(analysis_text(d.filter("lang = 'en'")))
    cache = known.select("AnalysisText", F.lit(0.1).alias("TEXTBLOB_Polarity"), F.lit(0.25).alias("FINBERT_Positive"), F.lit(0.5).alias("EMO_Joy"))
    scored, _ = score_with_cache(d, cache)
    return scored


@query("usable_cache_rows", "P10", "digest:s",
       f"select distinct md5({_ANALYSIS}) as digest from f_documents where {_ANALYSIS} <> '' and length({_ANALYSIS}) % 2 = 0")
def _(t):
    texts = distinct_texts(analysis_text(t.fixture("documents")))
    even = F.length("AnalysisText") % 2 == 0
    cache = texts.select("AnalysisText", F.lit(0.0).alias("TEXTBLOB_Polarity"), F.when(even, F.lit(0.3)).alias("FINBERT_Positive"), F.lit(0.1).alias("EMO_Joy"))
    return usable_cache(cache).select(F.md5(F.col("AnalysisText").cast("binary")).alias("digest"))


@query("articles_without_scores", "C6", "ID:s",
       "select cast(doc_id as varchar) as ID from documents where doc_id not in (select doc_id from labels)")
def _(t):
    return anti(t.raw("documents"), t.raw("labels"), ["doc_id"]).select(F.col("doc_id").cast("string").alias("ID"))


@query("text_source", "H5", "ID:s digest:s", f"select ID, md5({_ANALYSIS}) as digest from f_documents")
def _(t):
    return t.fixture("documents").select("ID", F.md5(text_or_headline("Summary", "Headline").cast("binary")).alias("digest"))
