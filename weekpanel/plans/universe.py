"""Company universe at a reference date."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.contracts import EXCLUDED_TICKERS, SECTOR_CODES, assert_known
from weekpanel.operators.joins import as_of
from weekpanel.operators.rows import best_per_key, drop_blank, drop_incomplete, filter_alive_on, filter_not_in, map_code, top_per_group

# Reference day and the window searched for market caps.
REFERENCE_DATE = "2021-01-04"
CAP_WINDOW = ("2020-12-28", "2021-01-15")
EXCHANGES = ["NASDAQ", "NYSE"]


def active_candidates(screened: DataFrame, per_sector: int = 100) -> DataFrame:
    """Complete rows, the largest companies of each sector."""
    named = drop_blank(drop_incomplete(screened, ["symbol", "companyName", "sector"]), ["symbol"])
    order = [F.col("marketCap").desc_nulls_last(), F.col("symbol").asc()]
    return top_per_group(named, ["sector"], order, per_sector).withColumn("universeSource", F.lit("active_screener"))


def delisted_candidates(delisted: DataFrame, reference: str = REFERENCE_DATE, exchange: str = "exchange") -> DataFrame:
    """Companies listed on the reference day that left later."""
    alive = filter_alive_on(delisted, "ipoDate", "delistedDate", reference, exchange, EXCHANGES)
    return drop_incomplete(alive, ["symbol", "companyName"])


def combine_candidates(active: DataFrame, delisted: DataFrame) -> DataFrame:
    """One row per symbol; an active listing wins over a delisted one."""
    both = active.withColumn("_rank", F.lit(1)).unionByName(delisted.withColumn("_rank", F.lit(0)), allowMissingColumns=True)
    tie = [c for c in both.columns if c not in ("symbol", "_rank")]
    return best_per_key(both, ["symbol"], [F.col("_rank")], tie).drop("_rank")


def attach_market_caps(candidates: DataFrame, caps: DataFrame, reference: str = REFERENCE_DATE,
                       window: Sequence[str] | None = CAP_WINDOW, day: str = "date") -> DataFrame:
    """Market cap on or first after the reference day, else the last before it; symbols without one drop out."""
    within = caps if window is None else caps.filter(F.col(day).between(F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date")))
    chosen = as_of(within, ["symbol"], day, "marketCap", reference).withColumnRenamed(day, "historicalMarketCapDate")
    return candidates.drop("marketCap").join(chosen, "symbol").withColumn(
        "selectionReferenceDate", F.lit(reference).cast("date")
    )


def attach_sector_codes(df: DataFrame, codes: Mapping[str, int] = SECTOR_CODES, check: bool = True) -> DataFrame:
    trimmed = df.withColumn("sector", F.trim("sector"))
    if check:
        assert_known(trimmed, "sector", codes)
    return trimmed.withColumn("SectorCode", map_code("sector", codes))


def enterprises(candidates: DataFrame, per_sector: int = 10, excluded: Sequence[str] = tuple(EXCLUDED_TICKERS)) -> DataFrame:
    """Final choice: no excluded symbol, the largest listing per company name, the largest names per sector."""
    named = filter_not_in(
        candidates.withColumn("symbol", F.upper(F.trim("symbol"))).filter("symbol != ''"), "symbol", excluded
    )
    one = best_per_key(named, ["companyName"], [F.col("marketCap")], ["symbol"])
    top = top_per_group(one, ["sector"], [F.col("marketCap").desc_nulls_last(), F.col("symbol").asc()], per_sector)
    return top.withColumnRenamed("symbol", "Ticker")


def select_universe(active: DataFrame, delisted: DataFrame, caps: DataFrame, reference: str = REFERENCE_DATE,
                    per_sector: int = 10, excluded: Sequence[str] = tuple(EXCLUDED_TICKERS),
                    codes: Mapping[str, int] = SECTOR_CODES, window: Sequence[str] | None = CAP_WINDOW) -> DataFrame:
    """From screened and delisted companies to the final universe; ``window`` bounds the days of the market caps."""
    both = combine_candidates(active_candidates(active), delisted_candidates(delisted, reference))
    capped = attach_market_caps(both, caps, reference, window)
    return enterprises(attach_sector_codes(capped, codes), per_sector, excluded)
