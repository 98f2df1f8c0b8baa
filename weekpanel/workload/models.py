"""Queries on splits, samples, model tables, text features and neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.contracts import TARGET
from weekpanel.operators import models as M
from weekpanel.operators.aggregates import accuracy, box_stats, classification_report, confusion, mode_of
from weekpanel.operators.joins import broadcast_if_small
from weekpanel.operators.neighbours import knn_classify, nearest, nearest_in_buckets
from weekpanel.operators.ranking import largest_remainder
from weekpanel.operators.regression import granger_table, lag_coefficients, var_fit
from weekpanel.operators.reshape import split_xy
from weekpanel.operators.sampling import balance_binary, fold_assign, stratified_split, temporal_split
from weekpanel.operators.textml import (
    bag_of_words_long, clean_tokens, count_vectors, cross_validate, fit_counts, classifiers, in_few_parts, stop_words, term_counts, tfidf_long, tfidf_vectors,
)
from weekpanel.plans.evaluation import evaluate
from weekpanel.plans.training import train_and_rank

from weekpanel.workload.news import MODELING, modeling_of
from weekpanel.workload.prices import PRICE, PRICE_OUT
from weekpanel.plans.prices import price_features, weekly_bars
from weekpanel.session import freeze, shared_dir
from weekpanel.sources.upsert import fresh_path
from weekpanel.workload.registry import query

# Years of the input tables, in the roles of the original split.
YEARS = {"train": (1995, 1999), "validation": (2000, 2000), "test": (2001, 2001)}


def prices_of(t):
    return price_features(weekly_bars(t.fixture("daily")))


@query("temporal_split_counts", "J1 I6 H18", "part:s n:l first:t last:t",
       f"""select case when year(WeekEndingFriday) between 1995 and 1999 then 'train' when year(WeekEndingFriday) = 2000 then 'validation'
                  else 'test' end as part, count(*) as n, min(WeekEndingFriday) as first, max(WeekEndingFriday) as last
           from ({PRICE}) where year(WeekEndingFriday) between 1995 and 2001 group by 1""")
def _(t):
    parts = temporal_split(prices_of(t), **YEARS)
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n"), F.min("WeekEndingFriday").alias("first"), F.max("WeekEndingFriday").alias("last"))
        one = one.filter("n > 0").withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("target_and_features", "I6", "up:l n:l",
       f"""select "AdjClosePrice_t+1_Up" as up, count(*) as n from ({PRICE}) group by 1""")
def _(t):
    _, y = split_xy(prices_of(t), TARGET)
    return y.groupBy(F.col(f"`{TARGET}`").alias("up")).agg(F.count(F.lit(1)).alias("n"))


def _balanced_sql(base: str, per: str) -> str:
    """The balanced sample step by step, rows picked with a list of positions."""
    return f"""
      with b as materialized (select *, year(WeekEndingFriday) as y, {per} as k from ({base})),
           cls as (select k, up, count(*) as size from b group by 1, 2),
           rule as (select k, arg_max(up, (size, up)) as major, min(size) as keep from cls group by k
                    having count(*) = 2 and min(size) < max(size)),
           grp as (select b.k, Ticker, y, count(*) as n, any_value(keep) as keep from b join rule r on b.k = r.k and b.up = r.major group by 1, 2, 3),
           g2 as (select *, count(*) over (partition by k) as g from grp),
           g3 as (select *, case when keep >= g then n - 1 else n end as w, case when keep >= g then 1 else 0 end as base_rows,
                         case when keep >= g then keep - g else keep end as total from g2),
           g4 as (select *, w / sum(w) over (partition by k) * total as exact from g3),
           g5 as (select *, floor(exact) as fl, exact - floor(exact) as fr from g4),
           g6 as (select *, row_number() over (partition by k order by fr desc, w desc, Ticker, y) as r,
                         total - sum(fl) over (partition by k) as rest from g5),
           quota as (select k, Ticker, y, n, cast(base_rows + fl + case when r <= rest then 1 else 0 end as bigint) as q from g6),
           picked as (select k, Ticker, y, unnest(list_transform(range(least(q, n)), lambda i:
                        case when q >= n then i else cast(floor((i + 0.5) * n / q) as bigint) end)) as pos from quota),
           num as (select b.*, row_number() over (partition by b.k, b.up, Ticker, y order by WeekEndingFriday) - 1 as pos from b)
      select num.* from num left join rule on num.k = rule.k where rule.k is null or num.up <> rule.major
      union all
      select num.* from num join rule on num.k = rule.k and num.up = rule.major
        join picked p on num.k = p.k and num.Ticker = p.Ticker and num.y = p.y and num.pos = p.pos"""


_UP = f"""select *, "AdjClosePrice_t+1_Up" as up from ({PRICE})"""


@query("balanced_sample", "J2 E18 E19", PRICE_OUT, _balanced_sql(_UP, "0"))
def _(t):
    return balance_binary(prices_of(t), TARGET)


# A rarer class: the upward weeks that end above the weekly mean by a margin.
_RARE = f"""select *, case when WeeklyReturn_1W > 8 then 1 else 0 end as up from ({PRICE})"""


@query("balanced_sample_rare_class", "J2 E18 E19", "Ticker:s WeekEndingFriday:t up:l", _balanced_sql(_RARE, "0"))
def _(t):
    p = prices_of(t).withColumn("up", (F.col("WeeklyReturn_1W") > 8).cast("int"))
    return balance_binary(p, "up")


_BY_SECTOR = f"""select p.*, "AdjClosePrice_t+1_Up" as up, c.SectorCode from ({PRICE}) p join f_companies c using (Ticker)"""


@query("balanced_sample_per_sector", "J2 J18", "Ticker:s WeekEndingFriday:t SectorCode:l up:l", _balanced_sql(_BY_SECTOR, "SectorCode"))
def _(t):
    p = prices_of(t).join(t.fixture("companies").select("Ticker", "SectorCode"), "Ticker")
    return balance_binary(p, TARGET, per=["SectorCode"]).withColumn("up", F.col(f"`{TARGET}`"))


@query("largest_remainder_quotas", "E19", "c_mktsegment:s n:l quota:l",
       """with s as (select c_mktsegment, count(*) as n from customer group by 1),
               e as (select *, n / sum(n) over () * 97 as x from s),
               f as (select *, floor(x) as fl, row_number() over (order by x - floor(x) desc, n desc, c_mktsegment) as r, 97 - sum(floor(x)) over () as rest from e)
          select c_mktsegment, n, fl + case when r <= rest then 1 else 0 end as quota from f""")
def _(t):
    s = t.raw("customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return largest_remainder(s, [], "n", F.lit(97), ["c_mktsegment"])


@query("stratified_split_sizes", "J3", "part:s quality:l n:l",
       """with s as (select quality, count(*) as n from labels group by 1), t as (select ceil(0.2 * sum(n)) as total, sum(n) as a from s),
               e as (select *, n / a * total as x from s, t),
               f as (select *, floor(x) as fl, row_number() over (order by x - floor(x) desc, n desc, quality) as r, total - sum(floor(x)) over () as rest from e),
               q as (select quality, n, fl + case when r <= rest then 1 else 0 end as k from f)
          select 'test' as part, quality, k as n from q union all select 'train', quality, n - k from q""")
def _(t):
    train, test = stratified_split(t.raw("labels"), "quality", ["doc_id"])
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("fold_sizes", "J4", "quality:l fold:l n:l",
       """with s as (select quality, count(*) as n from labels group by 1)
          select quality, fold, cast(floor((n - fold + 4) / 5) as bigint) as n from s, (select unnest(range(5)) as fold) f""")
def _(t):
    return fold_assign(t.raw("labels"), "quality", ["doc_id"]).groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("standardised_features", "J5", "Ticker:s WeekEndingFriday:t Momentum_12W:d Volatility_12W:d",
       f"""select Ticker, WeekEndingFriday, (Momentum_12W - avg(Momentum_12W) over ()) / stddev_pop(Momentum_12W) over () as Momentum_12W,
                  (Volatility_12W - avg(Volatility_12W) over ()) / stddev_pop(Volatility_12W) over () as Volatility_12W from ({PRICE})""")
def _(t):
    p = prices_of(t)
    return M.standardise(p, M.standardise_fit(p, ["Momentum_12W", "Volatility_12W"]))


@query("accuracy_by_group", "D10", "sector:s accuracy:d n:l",
       "select sector, avg(cast(label = predicted as int)) as accuracy, count(*) as n from f_predictions group by 1")
def _(t):
    return accuracy(t.fixture("predictions"), "label", "predicted", ["sector"])


@query("confusion_counts", "D11", "sector:s label:l predicted:l n:l",
       "select sector, label, predicted, count(*) as n from f_predictions group by 1, 2, 3")
def _(t):
    return confusion(t.fixture("predictions"), "label", "predicted", ["sector"])


@query("confusion_report", "D11 J26", "sector:s class:s precision:d recall:d f1:d support:l",
       """with c as (select distinct sector, c from (select sector, label as c from f_predictions union select sector, predicted from f_predictions)),
               p as (select c.sector, c.c, count(*) filter (label = c.c and predicted = c.c) as tp, count(*) filter (predicted = c.c) as pr,
                            count(*) filter (label = c.c) as su from c join f_predictions f on f.sector = c.sector group by 1, 2),
               r as (select sector, cast(c as varchar) as class, coalesce(tp / nullif(pr, 0), 0) as precision, coalesce(tp / nullif(su, 0), 0) as recall,
                            coalesce(2 * tp / nullif(pr + su, 0), 0) as f1, su as support from p)
          select * from r union all select sector, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from r group by sector
          union all select sector, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), sum(support) from r group by sector""")
def _(t):
    return classification_report(t.fixture("predictions"), "label", "predicted", ["sector"])


@query("rank_models", "J15 F9", "sector:s model:s test_accuracy:d rank:l position:l is_best:l",
       """select *, rank() over (partition by sector order by test_accuracy desc) as rank,
                 row_number() over (partition by sector order by test_accuracy desc, execution_order) as position,
                 cast(test_accuracy = max(test_accuracy) over (partition by sector) as int) as is_best from f_results""")
def _(t):
    return M.rank_models(t.fixture("results"), order="execution_order")


@query("best_vs_baselines", "J16 J14", "sector:s best_model:s test_accuracy:d delta_null_model:d delta_always_one:d delta_always_zero:d",
       """with b as (select sector, model as best_model, test_accuracy from (select *, row_number() over (partition by sector
                 order by test_accuracy desc, execution_order) as r from f_results where model not in ('null_model', 'always_one_model', 'always_zero_model'))
               where r = 1),
               l as (select sector, max(test_accuracy) filter (model = 'null_model') as n, max(test_accuracy) filter (model = 'always_one_model') as o,
                     max(test_accuracy) filter (model = 'always_zero_model') as z from f_results group by 1)
          select sector, best_model, test_accuracy, test_accuracy - n as delta_null_model, test_accuracy - o as delta_always_one,
                 test_accuracy - z as delta_always_zero from b join l using (sector)""")
def _(t):
    return M.best_vs_baselines(t.fixture("results"), order="execution_order")


@query("baseline_accuracy", "J14 D6", "kind:s accuracy:d",
       f"""with h as (select "AdjClosePrice_t+1_Up" as up, year(WeekEndingFriday) as y from ({PRICE})),
                m as (select up from h where y between 1995 and 2000 group by up order by count(*) desc, up limit 1)
           select 'null_model' as kind, avg(cast(up = (select up from m) as int)) as accuracy from h where y = 2001
           union all select 'always_one_model', avg(cast(up = 1 as int)) from h where y = 2001
           union all select 'always_zero_model', avg(cast(up = 0 as int)) from h where y = 2001""")
def _(t):
    parts = temporal_split(prices_of(t), **YEARS)
    history = parts["train"].unionByName(parts["validation"])
    out = None
    for kind in ("null_model", "always_one_model", "always_zero_model"):
        p = M.baseline(parts["test"], kind, history=history)
        one = accuracy(p, TARGET, "predicted").withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("majority_class", "D6 J14", "quality:l n:l",
       "select quality, count(*) as n from labels group by 1 order by n desc, quality limit 1")
def _(t):
    return mode_of(t.raw("labels"), "quality")


@query("lasso_candidate", "J7", "sector:s model:s test_accuracy:d",
       """select sector, model, test_accuracy from f_results order by (execution_order > 2) desc, test_accuracy desc, execution_order, sector limit 1""")
def _(t):
    r = t.fixture("results").withColumns({
        "n_coefficients": F.when(F.col("execution_order") > 2, F.col("execution_order")).otherwise(0), "validation_accuracy": F.col("test_accuracy"),
    })
    return M.select_candidate(r, "sector")


@query("fold_summary", "J27", "sector:s mean_accuracy:d std_accuracy:d mean_error:d",
       """select sector, avg(test_accuracy) as mean_accuracy, stddev_pop(test_accuracy) as std_accuracy, 1 - avg(test_accuracy) as mean_error
          from f_results group by 1""")
def _(t):
    return M.cv_summary(t.fixture("results"), ["sector"], "test_accuracy")


_CLEAN = r"lower(regexp_replace(regexp_replace(regexp_replace(text, 'http[^\s\p{Z}]+|www[^\s\p{Z}]+', '', 'g'), '@[\p{L}\p{N}_]+|#', '', 'g'), '[^a-zA-Z\s]', '', 'g'))"


_TOK = rf"""
  select doc_id, unnest(list_filter(string_split_regex({_CLEAN}, '\s+'), lambda w: w <> '' and len(w) >= 2)) as term from documents"""


def _docs(t):
    return t.raw("documents").select("doc_id", clean_tokens("text", []).alias("tokens"))


@query("term_counts", "J21 J22 H4", "doc_id:l term:s tf:l", f"select doc_id, term, count(*) as tf from ({_TOK}) group by 1, 2")
def _(t):
    return term_counts(_docs(t), "doc_id", "tokens")


@query("bag_of_words", "J22", "doc_id:l term:s tf:l",
       f"""with c as (select doc_id, term, count(*) as tf from ({_TOK}) group by 1, 2),
                v as (select term from c group by term having count(*) >= 3 and count(*) <= 0.9 * (select count(*) from documents))
           select c.* from c join v using (term)""")
def _(t):
    return bag_of_words_long(_docs(t), "doc_id", "tokens")


@query("tfidf_long", "J23", "doc_id:l term:s weight:d",
       f"""with c as (select doc_id, term, count(*) as tf from ({_TOK}) group by 1, 2),
                n as (select count(*) as n from documents),
                v as (select term, count(*) as df from c group by term having count(*) >= 3 and count(*) <= 0.9 * (select n from n)),
                w as (select doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) as w from c join v using (term) cross join n)
           select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from w""")
def _(t):
    return tfidf_long(_docs(t), "doc_id", "tokens")


@query("tokens_without_stop_words", "J21", "doc_id:l n:l n_unique:l")
def _(t):
    d = t.raw("documents").select("doc_id", clean_tokens("text", stop_words(t.spark)).alias("w"))
    return d.select("doc_id", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("n_unique"))


def _halves(t):
    e = t.raw("embeddings")
    odd = F.col("vec_id") % 2 == 1
    return e.filter(odd), e.filter(~odd)


@query("knn_vote", "J25", "test_id:l predicted:l",
       """with d as (select a.vec_id as test_id, b.vec_id, b.label, list_distance(a.embedding::double[], b.embedding::double[]) as d
                     from embeddings a join embeddings b on a.vec_id % 2 = 1 and b.vec_id % 2 = 0),
               n as (select * from (select *, row_number() over (partition by test_id order by d, vec_id) as r from d) where r <= 5),
               v as (select test_id, label, count(*) as n from n group by 1, 2)
          select test_id, label as predicted from (select *, row_number() over (partition by test_id order by n desc, label) as r from v) where r = 1""")
def _(t):
    test, train = _halves(t)
    return knn_classify(test, train, 5, "vec_id", "embedding", "label")


@query("knn_vote_cosine", "J25", "test_id:l predicted:l",
       """with d as (select a.vec_id as test_id, b.vec_id, b.label, 1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as d
                     from embeddings a join embeddings b on a.vec_id % 2 = 1 and b.vec_id % 2 = 0),
               n as (select * from (select *, row_number() over (partition by test_id order by d, vec_id) as r from d) where r <= 3),
               v as (select test_id, label, count(*) as n from n group by 1, 2)
          select test_id, label as predicted from (select *, row_number() over (partition by test_id order by n desc, label) as r from v) where r = 1""")
def _(t):
    test, train = _halves(t)
    return knn_classify(test, train, 3, "vec_id", "embedding", "label", "cosine")


@query("knn_buckets_recall", "J25", "metric:s n_test:l recall_reached:l",
       "select m as metric, count(*) as n_test, 1 as recall_reached from embeddings, (values ('euclidean'), ('cosine')) v(m) where vec_id % 2 = 1 group by 1")
def _(t):
    """Neighbours found in buckets against all neighbours: at least nine of ten are found, for both metrics."""
    test, train = _halves(t)
    out = None
    for metric in ("euclidean", "cosine"):
        whole = nearest(test, train, 5, "vec_id", "embedding", "label", metric)
        found = nearest_in_buckets(test, train, 5, "vec_id", "embedding", "label", metric).select("test_id", "train_id", F.lit(1).alias("hit"))
        one = whole.join(found, ["test_id", "train_id"], "left").agg(
            F.count_distinct("test_id").alias("n_test"), (F.count("hit") >= 0.9 * F.count("*")).cast("int").alias("recall_reached")).withColumn("metric", F.lit(metric))
        out = one if out is None else out.unionByName(one)
    return out


_SERIES = ["Volatility_4W", "Drawdown_12W", "Momentum_12W"]


@query("var_coefficients", "J19 L5", "Ticker:s lag:l alpha:d beta_a:d beta_b:d n_obs_used:l")
def _(t):
    fitted = var_fit(prices_of(t), "Ticker", "WeekEndingFriday", "WeeklyReturn_1W", _SERIES, 3)
    return lag_coefficients(fitted, "Ticker", [1, 2, 3], {"beta_a": _SERIES[0], "beta_b": _SERIES[1]})


@query("granger_pvalues", "J19 J20 E16", "Ticker:s f_lag1:d pvalue_lag1:d f_lag2:d pvalue_lag2:d")
def _(t):
    return granger_table(prices_of(t), "Ticker", "WeekEndingFriday", "AdjClosePrice", _SERIES)


@query("regression_one_lag", "J19", "Ticker:s alpha:d slope:d",
       f"""select Ticker, regr_intercept(y, x) as alpha, regr_slope(y, x) as slope from (select Ticker, WeeklyReturn_1W as y,
             lag(WeeklyReturn_1W) over (partition by Ticker order by WeekEndingFriday) as x from ({PRICE})) where x is not null group by 1""")
def _(t):
    fitted = var_fit(prices_of(t), "Ticker", "WeekEndingFriday", "WeeklyReturn_1W", [], 1)
    return fitted.select("Ticker", F.try_element_at("coefficients", F.lit("const")).alias("alpha"),
                         F.try_element_at("coefficients", F.lit("L1.WeeklyReturn_1W")).alias("slope"))


@query("boxplot_stats", "D13", "p_brand:s q1:d median:d q3:d whisker_low:d whisker_high:d n_outliers:l n:l",
       """with q as (select p_brand, quantile_cont(p_retailprice, 0.25) as q1, quantile_cont(p_retailprice, 0.5) as median,
                            quantile_cont(p_retailprice, 0.75) as q3 from part group by 1)
          select p.p_brand, q1, median, q3, min(p_retailprice) filter (p_retailprice >= q1 - 1.5 * (q3 - q1) and p_retailprice <= q3 + 1.5 * (q3 - q1)) as whisker_low,
                 max(p_retailprice) filter (p_retailprice >= q1 - 1.5 * (q3 - q1) and p_retailprice <= q3 + 1.5 * (q3 - q1)) as whisker_high,
                 count(*) filter (not (p_retailprice >= q1 - 1.5 * (q3 - q1) and p_retailprice <= q3 + 1.5 * (q3 - q1))) as n_outliers, count(*) as n
          from part p join q using (p_brand) group by 1, 2, 3, 4""")
def _(t):
    return box_stats(t.raw("part"), "p_brand", "p_retailprice")


SMALL_GRID = {"c_grid": [1, 0.1, 0.01], "forest_grid": [{"numTrees": 20, "maxDepth": 3, "minInstancesPerNode": 10}],
              "boost_grid": [{"maxIter": 5, "maxDepth": 3, "stepSize": 0.1}], "net_grid": [{"hidden1": 8, "hidden2": 4, "max_iter": 30}]}
_YEARS_NEWS = {"train": (1999, 1999), "validation": (2000, 2000), "test": (2001, 2001)}


def _price_parts(t):
    """Balanced training rows and the later year, as vectors of standardised price features."""
    parts = temporal_split(prices_of(t), **YEARS)
    train = freeze(balance_binary(parts["train"], TARGET))
    fitted = M.standardise_fit(train, _PRICE_X)
    return [M.vectors(M.standardise(p, fitted), _PRICE_X, keep=("Ticker", "WeekEndingFriday")).cache() for p in (train, parts["validation"])]


_PRICE_X = ["AdjClosePrice", "WeeklyReturn_1W", "WeeklyReturn_4W", "Momentum_12W", "Volatility_4W", "Volatility_12W", "Drawdown_12W"]


@query("lasso_selected", "J6 J7 J8 J13", "feature:s coefficient:d")
def _(t):
    train, validation = _price_parts(t)
    n = train.count()
    points = [{"C": c} for c in M.C_GRID]
    found = M.grid_search(train, validation, lambda C: M.l1_logistic(n, C), points)
    best = M.select_candidate(found.withColumn("C", F.col("params")["C"].cast("double"))).first()
    model = M.l1_logistic(n, best["C"]).fit(train)
    return M.selected_variables(M.coefficient_table(t.spark, _PRICE_X, model.coefficients.toArray()))


@query("logistic_coefficients", "J9 F6", "feature:s coefficient:d")
def _(t):
    train, _v = _price_parts(t)
    model = M.plain_logistic(train.count()).fit(train)
    return M.coefficient_table(t.spark, _PRICE_X, model.coefficients.toArray())


@query("forest_accuracy", "J10 J13", "point:l validation_accuracy:d")
def _(t):
    train, validation = _price_parts(t)
    points = M.grid({"numTrees": [20], "maxDepth": [3, 5], "minInstancesPerNode": [10, 30]})
    return M.grid_search(train, validation, M.forest, points)


@query("boosted_accuracy", "J11 J13", "point:l validation_accuracy:d")
def _(t):
    train, validation = _price_parts(t)
    points = M.grid({"maxIter": [5], "stepSize": [0.1], "maxDepth": [3], "minInstancesPerNode": [5], "subsamplingRate": [0.5, 1.0]})
    return M.grid_search(train, validation, M.boosted, points)


@query("net_predictions", "J12 J17", "Ticker:s WeekEndingFriday:t label:l predicted:l predicted_probability:d")
def _(t):
    train, validation = _price_parts(t)
    model = M.two_layer_net(len(_PRICE_X), 8, 4, 50).fit(train)
    return M.predict_with_confidence(model, validation, ("Ticker", "WeekEndingFriday"))


def _trained(t, store=None):
    modeling = freeze(modeling_of(t))
    return modeling, train_and_rank(modeling, None, years=_YEARS_NEWS, threads=4, store=store, **SMALL_GRID)


@query("train_and_rank", "P14 J13 J15 J18", "sector:l model:s test_accuracy:d rank:l position:l")
def _(t):
    return _trained(t)[1]


_OF_YEAR = "select SectorCode from m where year(WeekEndingFriday) = {} group by 1"


@query("best_model_predictions", "P14 P15 J12 J16 J17 J18", "Ticker:s WeekEndingFriday:t sector:l label:l one_best_model:l probability_in_range:l accuracy_matches:l",
       f"""with m as ({MODELING})
           select Ticker, WeekEndingFriday, SectorCode as sector, "AdjClosePrice_t+1_Up" as label, 1 as one_best_model, 1 as probability_in_range, 1 as accuracy_matches
           from m where year(WeekEndingFriday) = 2001 and SectorCode in ({_OF_YEAR.format(1999)} having count(distinct "AdjClosePrice_t+1_Up") = 2)
             and SectorCode in ({_OF_YEAR.format(2000)})""")
def _(t):
    modeling, results = _trained(t, fresh_path(shared_dir(t.spark)))
    results = freeze(results)
    predictions, summary = evaluate(temporal_split(modeling, **_YEARS_NEWS)["test"], results)
    predictions = freeze(predictions)
    again = accuracy(predictions, "label", "predicted", ["sector"]).select("sector", "accuracy")
    told = summary.select("sector", F.col("best_model").alias("told"), "test_accuracy")
    return predictions.join(told, "sector", "left").join(again, "sector").select(
        "Ticker", "WeekEndingFriday", "sector", "label", (F.col("best_model") == F.col("told")).cast("int").alias("one_best_model"),
        F.col("predicted_probability").between(0.5, 1.0).cast("int").alias("probability_in_range"),
        (F.abs(F.col("accuracy") - F.col("test_accuracy")) < 1e-9).cast("int").alias("accuracy_matches"))


def _labelled(t):
    """Labelled documents with their words, cleaned once: splits, vocabulary and vectors read them many times."""
    labels = broadcast_if_small(t.raw("labels"), 500_000)  # the texts of all documents stay where they are then
    docs = labels.join(t.raw("documents"), "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("label"), clean_tokens("text", stop_words(t.spark)).alias("tokens"))
    return freeze(docs)


@query("text_classifier_accuracy", "J22 J23 J24 J3", "model:s accuracy:d n:l")
def _(t):
    """Each model is scored as soon as it is fitted: one row of it is kept, not its plan."""
    docs = _labelled(t)
    train, test = stratified_split(docs, "label", ["doc_id"])
    counter = fit_counts(train, "doc_id", "tokens")
    a, b = (v.select("label", "features") for v in tfidf_vectors(*[count_vectors(counter, d, "tokens") for d in (train, test)]))
    a, b = in_few_parts(a, train.agg(F.sum(F.size("tokens"))).first()[0], len(counter.vocabulary)).cache(), b.cache()
    scores = [freeze(accuracy(model.fit(a).transform(b), "label", "prediction").withColumn("model", F.lit(name)))
              for name, model in classifiers().items()]
    for v in (a, b):
        v.unpersist()
    return reduce(DataFrame.unionByName, scores)


@query("text_cross_validation", "J4 J24 J27", "point:l mean_accuracy:d mean_error:d")
def _(t):
    folds = freeze(fold_assign(_labelled(t), "label", ["doc_id"], 3))
    vectors = count_vectors(fit_counts(folds, "doc_id", "tokens"), folds, "tokens").withColumnRenamed("counts", "features").cache()

    def build(smoothing):
        return classifiers()["complement_nb"].copy().setSmoothing(smoothing)

    scores = cross_validate(vectors, "fold", build, [{"smoothing": 0.5}, {"smoothing": 1.0}], 3)
    return M.cv_summary(scores, ["point"])
