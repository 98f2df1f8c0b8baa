"""Views that give the input tables the shape of prices, statements, news and results.

Each text runs unchanged in Spark SQL and in DuckDB; only the table names in braces are filled in.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES: dict[str, str] = {
    "f_daily": """
        select n_name as Ticker, cast(l_shipdate as date) as ActualTradingDate,
               max(l_extendedprice / l_quantity) as ClosePrice,
               max(l_extendedprice / l_quantity * (1 - l_discount)) as AdjClosePrice
        from {lineitem} join {supplier} on l_suppkey = s_suppkey join {nation} on s_nationkey = n_nationkey
        group by n_name, cast(l_shipdate as date)""",
    "f_candidates": """
        select concat('C', cast(c_custkey as varchar(20))) as symbol,
               concat('Company ', cast(c_custkey % 400 as varchar(20))) as companyName,
               c_mktsegment as sector, n_name as industry, c_acctbal as marketCap,
               case when c_custkey % 10 = 3 then 'post_2021_delisted' else 'active_screener' end as universeSource
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "f_caps": """
        select concat('C', cast(o_custkey as varchar(20))) as symbol, cast(o_orderdate as date) as cap_date,
               max(o_totalprice) as marketCap
        from {orders} group by o_custkey, cast(o_orderdate as date)""",
    "f_lifetimes": """
        select concat('C', cast(o_custkey as varchar(20))) as symbol,
               concat('Company ', cast(o_custkey as varchar(20))) as companyName,
               case o_custkey % 3 when 0 then 'NYSE' when 1 then 'NASDAQ' else 'LSE' end as exchange,
               cast(min(o_orderdate) as date) as ipoDate, cast(max(o_orderdate) as date) as delistedDate
        from {orders} group by o_custkey""",
    "f_statements": """
        select symbol, dt as date, cast(dt + cast(20 + k as int) as date) as filingDate,
               case when k % 5 = 0 then cast(null as date) when k % 7 = 0 then cast(dt - 3 as date)
                    else cast(dt + cast(22 + k as int) as date) end as acceptedDate,
               mx as revenue, mx - mn as grossProfit, mn as operatingIncome, mn * 0.5e0 as netIncome,
               mx * 10 as totalAssets, mx * 4 as totalStockholdersEquity, mx * 3 as totalCurrentAssets,
               mn * 2 as totalCurrentLiabilities,
               case when mc % 9 = 0 then 0.0e0 else mn * 3 end as totalDebt,
               mn * 0.7e0 as operatingCashFlow,
               case when mc % 4 = 0 then mn * 0.1e0 when mc % 11 = 0 then 0.0e0 else -(mn * 0.1e0) end as capitalExpenditure,
               case when mc % 13 = 0 then 0.0e0 else mn * 0.6e0 end as freeCashFlow,
               case when mc % 17 = 0 then cast(null as double) else mx * 20 end as marketCap, 1 as version
        from f_quarters
        union all
        select symbol, dt, cast(dt + cast(40 + k as int) as date), cast(dt + cast(45 + k as int) as date),
               mx, mx - mn, mn, mn * 0.55e0, mx * 10, mx * 4, mx * 3, mn * 2, mn * 3, mn * 0.7e0, -(mn * 0.1e0),
               mn * 0.6e0, mx * 21, 2
        from f_quarters where mc % 23 = 0""",
    "f_quarters": """
        select n_nationkey as k, n_name as symbol,
               cast(date_trunc('quarter', o_orderdate) + interval '3' month - interval '1' day as date) as dt,
               max(o_totalprice) as mx, min(o_totalprice) as mn, count(*) as n, max(o_custkey) as mc
        from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
        group by n_nationkey, n_name, date_trunc('quarter', o_orderdate)""",
    "f_articles": """
        select case when event_id % 19 = 0 then 'nan' when event_id % 17 = 0 then cast(null as varchar(20))
                    else cast(event_id - event_id % 2 as varchar(20)) end as ID,
               n_name as Ticker, ts - interval '9492' day + ((event_id % 300) * 7) * interval '1' day as Date,
               concat(event_type, ' ', cast(user_id % 7 as varchar(20))) as Headline,
               case when event_id % 3 = 0 then '' else concat('  ', event_type, '   report ', props, ' ') end as Summary,
               value / 997.0e0 as FINBERT_Negative, 0.3e0 as FINBERT_Neutral, 0.7e0 - value / 997.0e0 as FINBERT_Positive
        from {events} join {nation} on user_id % 25 = n_nationkey""",
    "f_coeff": """
        select n_name as Ticker, g.lag, (0.1e0 * g.lag - 0.01e0 * n_nationkey) / 7.0e0 as beta_negative,
               g.lag / 13.0e0 as beta_neutral, n_nationkey / 47.0e0 as beta_positive
        from {nation} cross join (select 1 as lag union all select 2 union all select 3) g
        where n_nationkey % 6 <> 5""",
    "f_documents": """
        select cast(doc_id as varchar(20)) as ID, source as Ticker, lang, split_part(text, chr(10), 1) as Headline,
               case when doc_id % 5 = 0 then split_part(text, chr(10), 1) when doc_id % 7 = 0 then ''
                    when doc_id % 11 = 0 then concat(text, '...') when doc_id % 13 = 0 then 'Reuters'
                    else text end as Summary
        from {documents}""",
    "f_predictions": """
        select doc_id, lang as sector, quality as label,
               case when d.n_chars % 3 = 0 then toxic else quality end as predicted,
               0.5e0 + (doc_id % 50) / 100.0e0 as predicted_probability
        from {labels} join {documents} d using (doc_id)""",
    "f_results": """
        select c_mktsegment as sector, m.model, m.execution_order,
               cast(count(case when c_custkey % m.k = 0 then 1 end) as double) / count(*) as test_accuracy
        from {customer} cross join (
          select 'null_model' as model, 2 as k, 0 as execution_order union all select 'always_one_model', 2, 1
          union all select 'always_zero_model', 3, 2 union all select 'logistic_regression', 4, 3
          union all select 'random_forest', 3, 4 union all select 'xgboost', 5, 5) m
        group by c_mktsegment, m.model, m.execution_order""",
    "f_companies": """
        select n_name as Ticker, concat(n_name, ' Corp') as companyName, r_name as sector,
               r_regionkey + 1 as SectorCode, concat('Industry ', cast(n_nationkey % 4 as varchar(20))) as industry
        from {nation} join {region} on n_regionkey = r_regionkey""",
    "f_best": """
        select r_name as sector,
               case r_regionkey % 3 when 0 then 'random_forest' when 1 then 'xgboost' else 'lasso_logistic' end as best_model,
               0.5e0 + r_regionkey / 50.0e0 as test_accuracy, 0.02e0 * r_regionkey as delta_null_model,
               -0.01e0 * r_regionkey as delta_always_one, 0.03e0 as delta_always_zero
        from {region}""",
}


def needed(sql: str) -> list[str]:
    """Fixture views a text names, those they use first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bf_\w+\b", text):
            if name in FIXTURES and name not in out:
                visit(FIXTURES[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


class Tables:
    """Input tables and fixture views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def fixture(self, name: str) -> DataFrame:
        text = FIXTURES[f"f_{name}"]
        inner = {f: self.fixture(f[2:]) for f in set(re.findall(r"\bf_\w+\b", text)) if f in FIXTURES}
        for f in inner:
            text = re.sub(rf"\b{f}\b", "{" + f + "}", text)
        used = set(re.findall(r"\{(\w+)\}", text))
        frames = {n: inner[n] if n in inner else self.raw(n) for n in used}
        return self.spark.sql(text, **frames)
