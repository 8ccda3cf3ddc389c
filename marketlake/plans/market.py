"""Close of day, seeding of new tickers, and the user reports, over stored tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.operators import portfolio as P
from marketlake.operators.bars import daily_bars
from marketlake.operators.calendar import dense_calendar
from marketlake.operators.reference import close_of_day, seed_rows, wanted_dates
from marketlake.operators.ticks import cached_ticks
from marketlake.operators.universe import tracked_universe
from marketlake.session import one_day
from marketlake.sources.cache import CacheTable
from marketlake.sources.lake import read_silver


def run_close_of_day(
    spark: SparkSession,
    silver_path: str,
    calendar: DataFrame,
    user_tickers: DataFrame,
    positions: DataFrame,
    cache: CacheTable,
    as_of: dt.date,
    session: str | None = "market",
) -> int:
    """The nightly job: reference closes, latest price and performance of all tracked tickers
    into the cache. Of silver, only the dozen dates in question are read."""
    day, dense = one_day(spark, as_of), dense_calendar(calendar)
    bars = daily_bars(silver_on(read_silver(spark, silver_path), day, dense, 5), session)
    rows = close_of_day(bars, day, dense, 5, tracked_universe(user_tickers, positions))
    return cache.merge(rows.drop("as_of"), as_of)


def seed_tickers(
    spark: SparkSession,
    silver_path: str,
    calendar: DataFrame,
    tickers: DataFrame,
    cache: CacheTable,
    as_of: dt.date,
    session: str | None = "market",
) -> int:
    """Cache rows for newly added tickers, previous close by bar order."""
    day, dense = one_day(spark, as_of), dense_calendar(calendar)
    bars = daily_bars(silver_on(read_silver(spark, silver_path), day, dense, 10), session)
    rows = seed_rows(bars, day, dense, 10, tickers)
    return cache.merge_seeds(rows.drop("as_of"), as_of)


def silver_on(silver: DataFrame, day: DataFrame, dense: DataFrame, lookback: int) -> DataFrame:
    """Silver cut to the partitions one as_of day needs: eight reference dates and the look-back,
    listed on the driver, so that the scan is pruned before it starts."""
    dates = wanted_dates(day, dense, lookback).select(F.col("ref_date").cast("string")).distinct()
    return silver.where(F.col("date").isin([row[0] for row in dates.collect()]))


def watchlist_report(cache: CacheTable, user_tickers: DataFrame, users: DataFrame) -> DataFrame:
    return P.watchlist_order(P.watchlist_report(user_tickers, users, cached_ticks(cache.read())))


def positions_report(cache: CacheTable, positions: DataFrame, users: DataFrame) -> DataFrame:
    return P.positions_order(P.positions_report(positions, users, cached_ticks(cache.read())))


def portfolio_totals(cache: CacheTable, positions: DataFrame, users: DataFrame) -> DataFrame:
    return P.portfolio_totals(P.positions_report(positions, users, cached_ticks(cache.read())))

