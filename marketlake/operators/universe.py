"""The set of tickers anyone follows, and how it changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tracked_universe(user_tickers: DataFrame, positions: DataFrame) -> DataFrame:
    """Distinct tickers of watchlists and positions, in order."""
    tickers = user_tickers.select("ticker").union(positions.select("ticker"))
    return tickers.distinct().orderBy("ticker")


def restrict(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows of tracked tickers only."""
    return bars.join(universe.select("ticker"), "ticker", "left_semi")


def universe_diff(current: DataFrame, new: DataFrame) -> DataFrame:
    """(ticker, action): ``add`` for new tickers, ``remove`` for those no longer listed.

    One pass: both sides are marked, united and reduced per ticker, instead of two anti joins.
    """
    sides = current.select("ticker", F.lit(True).alias("old")).unionByName(
        new.select("ticker", F.lit(False).alias("old"))
    )
    marks = sides.groupBy("ticker").agg(
        F.bool_or("old").alias("had"), F.bool_or(~F.col("old")).alias("has")
    )
    return marks.where("had <> has").select(
        "ticker", F.when(F.col("has"), "add").otherwise("remove").alias("action")
    )
