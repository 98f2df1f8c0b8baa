"""Queries on the company universe and on plain filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekpanel.contracts import duplicate_keys, unknown_values
from weekpanel.functions.numeric import safe_divide, to_double
from weekpanel.operators.aggregates import group_mean, group_size, mode_of, share_of_total, sum_and_count
from weekpanel.operators.joins import anti, as_of, keep_universe, left_lookup, semi
from weekpanel.operators.rows import (
    add_missing_columns, best_per_key, drop_blank, filter_alive_on, filter_from, first_per_key, filter_in, filter_not_in, filter_selected, map_code,
    page, pick_field, rename_reorder, ties_of_best, top_per_group,
)
from weekpanel.operators.sets import key_difference, key_intersection, union_all
from weekpanel.plans.universe import active_candidates, attach_market_caps, combine_candidates, delisted_candidates, enterprises
from weekpanel.workload.registry import query

# Codes of the market segments, in place of the sector codes.
SEGMENTS = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4, "MACHINERY": 5}
EXCLUDED = ["C10", "C20", "C30"]
REF = "1998-02-01"

_FINAL = """
  select symbol as Ticker, companyName, sector, industry, marketCap from (
    select *, row_number() over (partition by sector order by marketCap desc, symbol) as rs from (
      select *, row_number() over (partition by companyName order by marketCap desc, symbol desc) as rc
      from {src} where symbol not in ('C10', 'C20', 'C30')) where rc = 1) where rs <= 10"""


@query("universe_top10", "F4 F5 B2 P1", "Ticker:s companyName:s sector:s industry:s marketCap:d", _FINAL.format(src="f_candidates"))
def _(t):
    return enterprises(t.fixture("candidates"), 10, EXCLUDED)


@query("universe_dedup_company", "F5", "symbol:s companyName:s marketCap:d",
       """select * from (select *, row_number() over (partition by companyName order by marketCap desc, symbol desc) as r
          from f_candidates) where r = 1""")
def _(t):
    return best_per_key(t.fixture("candidates"), ["companyName"], [F.col("marketCap")], ["symbol"])


_ASOF = f"""
  select symbol, coalesce(arg_min(marketCap, cap_date) filter (cap_date >= date '{REF}'),
                          arg_max(marketCap, cap_date) filter (cap_date < date '{REF}')) as marketCap,
         coalesce(min(cap_date) filter (cap_date >= date '{REF}'), max(cap_date) filter (cap_date < date '{REF}')) as cap_date
  from f_caps group by symbol"""


@query("asof_market_cap", "C12", "symbol:s marketCap:d cap_date:t", _ASOF)
def _(t):
    return as_of(t.fixture("caps"), ["symbol"], "cap_date", "marketCap", REF)


@query("select_universe", "P1 F4 F5 C12 B5 G1 G4", "Ticker:s companyName:s sector:s marketCap:d historicalMarketCapDate:t universeSource:s",
       f"""with act as (select * from (select symbol, companyName, sector, row_number() over
                 (partition by sector order by marketCap desc, symbol) as r from f_candidates) where r <= 100),
            dl as (select l.symbol, l.companyName, 'DELISTED' as sector from f_lifetimes l
                   where ipoDate <= date '{REF}' and delistedDate >= date '{REF}' and exchange in ('NYSE', 'NASDAQ')),
            u as (select symbol, companyName, sector, 'active_screener' as src from act union all
                  select symbol, companyName, sector, 'delisted' from dl where symbol not in (select symbol from act)),
            c as (select u.*, a.marketCap, a.cap_date from u join ({_ASOF}) a using (symbol)
                  where symbol not in ('C10', 'C20', 'C30')),
            n as (select *, row_number() over (partition by companyName order by marketCap desc, symbol desc) as rc from c)
          select symbol as Ticker, companyName, sector, marketCap, cap_date as historicalMarketCapDate, src as universeSource
          from (select *, row_number() over (partition by sector order by marketCap desc, symbol) as rs from n where rc = 1)
          where rs <= 10""")
def _(t):
    active = active_candidates(t.fixture("candidates"))
    gone = delisted_candidates(t.fixture("lifetimes"), REF).withColumns(
        {"sector": F.lit("DELISTED"), "universeSource": F.lit("delisted")}
    )
    capped = attach_market_caps(combine_candidates(active, gone), t.fixture("caps"), REF, None, "cap_date")
    return enterprises(capped, 10, EXCLUDED)


@query("active_candidates", "F4 B6 B7", "symbol:s sector:s marketCap:d",
       """select * from (select *, row_number() over (partition by sector order by marketCap desc, symbol) as r
          from f_candidates) where r <= 100""")
def _(t):
    return active_candidates(t.fixture("candidates"))


@query("alive_on", "B5", "symbol:s ipoDate:t delistedDate:t",
       f"""select * from f_lifetimes where ipoDate <= date '{REF}' and delistedDate >= date '{REF}'
           and exchange in ('NYSE', 'NASDAQ')""")
def _(t):
    return filter_alive_on(t.fixture("lifetimes"), "ipoDate", "delistedDate", REF, "exchange", ["NYSE", "NASDAQ"])


@query("members_by_segment", "B1 B2 D2 B14", "c_mktsegment:s n:l",
       """select c_mktsegment, count(*) as n from customer where c_mktsegment in ('BUILDING', 'MACHINERY')
          and c_nationkey not in (1, 2, 3) group by c_mktsegment""")
def _(t):
    c = filter_selected(t.raw("customer"), ["c_mktsegment", "c_nationkey"])
    kept = filter_not_in(filter_in(c, "c_mktsegment", ["BUILDING", "MACHINERY"]), "c_nationkey", [1, 2, 3])
    return kept.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("orders_from_date", "B4 A1 A2", "o_orderstatus:s n:l total:d",
       """select o_orderstatus, count(*) as n, max(o_totalprice) as total from orders
          where o_orderdate >= timestamp '2000-06-01' group by o_orderstatus""")
def _(t):
    o = filter_from(t.raw("orders"), "o_orderdate", "2000-06-01")
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("total"))


@query("sector_codes", "B13", "symbol:s SectorCode:l",
       """select symbol, case sector when 'AUTOMOBILE' then 1 when 'BUILDING' then 2 when 'FURNITURE' then 3
          when 'HOUSEHOLD' then 4 when 'MACHINERY' then 5 end as SectorCode from f_candidates""")
def _(t):
    return t.fixture("candidates").withColumn("SectorCode", map_code("sector", SEGMENTS))


@query("unknown_sectors", "B9", "sector:s",
       "select distinct sector from f_candidates where sector not in ('BUILDING', 'MACHINERY')")
def _(t):
    return unknown_values(t.fixture("candidates"), "sector", ["BUILDING", "MACHINERY"])


@query("duplicate_line_keys", "B9", "l_orderkey:l l_linenumber:l n_rows:l",
       "select l_orderkey, l_linenumber, count(*) as n_rows from lineitem group by 1, 2 having count(*) > 1")
def _(t):
    return duplicate_keys(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query("company_labels", "C2", "Ticker:s companyName:s SectorCode:l ClosePrice:d",
       """select d.Ticker, companyName, SectorCode, max(ClosePrice) as ClosePrice from f_daily d
          left join f_companies c on d.Ticker = c.Ticker group by 1, 2, 3""")
def _(t):
    top = t.fixture("daily").groupBy("Ticker").agg(F.max("ClosePrice").alias("ClosePrice"))
    return left_lookup(top, t.fixture("companies"), ["Ticker"], ["companyName", "SectorCode"])


@query("counts_for_universe", "C4 D2", "symbol:s n:l",
       """select u.symbol, coalesce(c.n, 0) as n from (select distinct symbol from f_candidates) u
          left join (select symbol, count(*) as n from f_caps where cap_date >= date '2000-01-01' group by symbol) c using (symbol)""")
def _(t):
    caps = filter_from(t.fixture("caps"), "cap_date", "2000-01-01")
    counts = caps.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return keep_universe(counts, t.fixture("candidates"), "symbol", ["n"])


@query("with_and_without_orders", "C5 C6", "side:s c_mktsegment:s n:l",
       """select 'with' as side, c_mktsegment, count(*) as n from customer where c_custkey in (select o_custkey from orders) group by 2
          union all select 'without', c_mktsegment, count(*) from customer
          where not exists (select 1 from orders where o_custkey = c_custkey) group by 2""")
def _(t):
    keys = t.raw("orders").select(F.col("o_custkey").alias("c_custkey"))
    c = t.raw("customer")
    def count(df, side):
        return df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
    return count(semi(c, keys, ["c_custkey"]), "with").unionByName(count(anti(c, keys, ["c_custkey"]), "without"))


@query("best_and_tied", "F9", "p_brand:s p_partkey:l p_size:l",
       "select * from (select *, rank() over (partition by p_brand order by p_size desc) as r from part) where r = 1")
def _(t):
    return ties_of_best(t.raw("part"), ["p_brand"], "p_size")


@query("priciest_page", "F1 F8", "o_orderkey:l o_totalprice:d",
       "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey asc limit 25 offset 10")
def _(t):
    return page(t.raw("orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10, 25)


@query("closest_to_value", "F3", "o_orderkey:l gap:d",
       "select o_orderkey, abs(o_totalprice - 250000) as gap from orders order by gap, o_orderkey limit 10")
def _(t):
    o = t.raw("orders").select("o_orderkey", F.abs(F.col("o_totalprice") - 250000).alias("gap"))
    return o.orderBy("gap", "o_orderkey").limit(10)


@query("top_orders_per_status", "F4", "o_orderstatus:s o_orderkey:l o_totalprice:d",
       """select * from (select *, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as r
          from orders) where r <= 5""")
def _(t):
    return top_per_group(t.raw("orders"), ["o_orderstatus"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)


@query("union_of_parties", "G1", "kind:s nation:l name:s balance:d segment:s",
       """select 'customer' as kind, c_nationkey as nation, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer
          union all select 'supplier', s_nationkey, s_name, s_acctbal, null from supplier""")
def _(t):
    c = t.raw("customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"),
                                 F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t.raw("supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"),
                                 F.col("s_acctbal").alias("balance"))
    return union_all(c, s)


@query("key_changes", "G2", "k:l change:s",
       """select coalesce(a.k, b.k) as k, case when a.k is null then 'added' else 'removed' end as change
          from (select distinct o_custkey as k from orders where o_orderdate < timestamp '1999-01-01') a
          full join (select distinct o_custkey as k from orders where o_orderdate >= timestamp '2001-01-01') b on a.k = b.k
          where a.k is null or b.k is null""")
def _(t):
    o = t.raw("orders").select(F.col("o_custkey").alias("k"), "o_orderdate")
    early = o.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return key_difference(early, filter_from(o, "o_orderdate", "2001-01-01"), "k")


@query("key_overlap", "G3", "k:l",
       "select s_nationkey as k from supplier intersect select c_nationkey from customer where c_acctbal < 0")
def _(t):
    c = t.raw("customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))
    return key_intersection(t.raw("supplier").select(F.col("s_nationkey").alias("k")), c, "k")


@query("distinct_counts", "D4 D5 D7", "n_customers:l n_days:l first_day:t last_day:t",
       """select count(distinct o_custkey) as n_customers, count(distinct cast(o_orderdate as date)) as n_days,
                 min(o_orderdate) as first_day, max(o_orderdate) as last_day from orders""")
def _(t):
    day = F.col("o_orderdate").cast("date")
    return t.raw("orders").agg(F.count_distinct("o_custkey").alias("n_customers"), F.count_distinct(day).alias("n_days"),
                               F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query("common_segment", "D6", "c_nationkey:l c_mktsegment:s n:l",
       """select c_nationkey, c_mktsegment, n from (select *, row_number() over (partition by c_nationkey order by n desc, c_mktsegment) as r
          from (select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2)) where r = 1""")
def _(t):
    return mode_of(t.raw("customer"), "c_mktsegment", ["c_nationkey"])


@query("segment_shares", "H22 D6", "c_mktsegment:s n:l pct:d",
       """select c_mktsegment, count(*) as n, round(100.0 * count(*) / (select count(*) from customer), 2) as pct
          from customer group by 1""")
def _(t):
    counts = t.raw("customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return share_of_total(counts, "n")


@query("lines_per_brand", "D17 D3", "p_brand:s total:l n:l",
       "select p_brand, sum(p_size) as total, count(*) as n from part group by p_brand order by total desc, p_brand")
def _(t):
    return sum_and_count(t.raw("part"), "p_brand", "p_size")


@query("flag_sums", "D3", "l_returnflag:s n:l full_price:l late:l",
       """select l_returnflag, count(*) as n, count(*) filter (l_discount = 0) as full_price,
                 count(*) filter (l_shipdate >= timestamp '2001-01-01') as late from lineitem group by 1""")
def _(t):
    late = F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz")
    return t.raw("lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("l_discount") == 0).cast("int")).alias("full_price"),
        F.sum(late.cast("int")).alias("late"))


@query("safe_ratios", "H11 H12", "o_orderkey:l ratio:d parsed:d",
       """select o_orderkey, o_totalprice / nullif(o_custkey % 5, 0) as ratio,
                 try_cast(split_part(o_orderpriority, '-', 1) as double) as parsed from orders""")
def _(t):
    return t.raw("orders").select("o_orderkey", safe_divide("o_totalprice", F.col("o_custkey") % 5).alias("ratio"),
                                  to_double(F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).alias("parsed"))


@query("renamed_parts", "B10 B11 B12", "key:l label:s note:s size:l",
       "select p_partkey as key, p_name as label, null as note, p_size as size from part")
def _(t):
    from pyspark.sql import types as T

    p = rename_reorder(t.raw("part"), {"p_partkey": "key", "p_size": "size"}, ["key"], ["P_RETAILPRICE"])
    named = p.withColumn("label", pick_field(p, ["p_label", "p_name"]))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("label", T.StringType()),
                           T.StructField("note", T.StringType()), T.StructField("size", T.IntegerType())])
    return add_missing_columns(named, schema)


@query("nonblank_articles", "B7 B6", "Ticker:s n:l",
       "select Ticker, count(*) as n from f_articles where trim(Summary) <> '' and ID is not null group by Ticker")
def _(t):
    return drop_blank(t.fixture("articles"), ["Summary"]).na.drop(subset=["ID"]).groupBy("Ticker").agg(F.count(F.lit(1)).alias("n"))


@query("segment_means", "D1 D2", "c_mktsegment:s mean:d n:l", "select c_mktsegment, avg(c_acctbal) as mean, count(*) as n from customer group by 1")
def _(t):
    c = t.raw("customer")
    means = group_mean(c, ["c_mktsegment"], ["c_acctbal"]).withColumnRenamed("c_acctbal", "mean")
    return means.join(group_size(c, ["c_mktsegment"]), "c_mktsegment")


@query("cheapest_order", "F5 G4", "o_custkey:l o_orderkey:l o_totalprice:d",
       "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as r from orders) where r = 1")
def _(t):
    return first_per_key(t.raw("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice"), F.col("o_orderkey")])
