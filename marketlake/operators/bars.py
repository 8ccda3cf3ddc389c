"""Bars: open/high/low/close/volume over any key, from ticks or from finer bars.

All aggregates are partial-aggregatable, so a ticker holding a third of the rows is reduced on
the map side before the shuffle. With a primitive order column (``window_start``) every buffer
has a fixed width and Spark keeps the hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions.times import epoch_micros

NS_PER_MINUTE = 60_000_000_000


def minute_bars(trades: DataFrame, order: list[str]) -> DataFrame:
    """Minute bars in the bronze layout from (ticker, ts as UTC, price, volume) rows.

    ``order`` lists the columns that order trades within a minute.
    """
    minute = F.call_function("div", epoch_micros(F.col("ts")), F.lit(60_000_000))
    rank = _order_key(order)
    return (
        trades.withColumn("window_start", minute * NS_PER_MINUTE)
        .groupBy("ticker", "window_start")
        .agg(
            F.sum("volume").cast("double").alias("volume"),
            F.min_by("price", rank).alias("open"),
            F.max_by("price", rank).alias("close"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.count(F.lit(1)).alias("transactions"),
        )
        .withColumn("otc", F.lit(None).cast("string"))
    )


def daily_bars(silver: DataFrame, session: str | None = "market") -> DataFrame:
    """One bar per ticker and trading date; ``session=None`` takes all sessions."""
    bars = silver if session is None else silver.where(F.col("session") == session)
    return _roll_up(bars, ["ticker", "date"])


def rolled_bars(
    silver: DataFrame, multiplier: int, timespan: str, session: str | None = None
) -> DataFrame:
    """Bars of ``multiplier`` x ``timespan`` on New York time, keyed by ``bucket`` (its start).

    Minutes and hours count from midnight, longer spans from 1970-01-01 (weeks from the Monday
    of that week).
    """
    bars = silver if session is None else silver.where(F.col("session") == session)
    bucket = _bucket(F.col("timestamp"), multiplier, timespan)
    return _roll_up(bars.withColumn("bucket", bucket), ["ticker", "bucket"])


def latest_bar(bars: DataFrame, as_of: Column, lookback_days: int) -> DataFrame:
    """Last daily bar of each ticker in the look-back window: price, volume, timestamp (ms)."""
    day = F.to_date("date")
    recent = bars.where(day.between(F.date_sub(as_of, lookback_days), as_of))
    return recent.groupBy("ticker").agg(
        F.max_by("close", day).alias("price"),
        F.max_by(F.coalesce(F.col("volume").cast("bigint"), F.lit(0)), day).alias("volume"),
        F.max_by(F.coalesce("timestamp_ms", F.lit(0)), day).alias("timestamp"),
    )


def previous_bar_close(bars: DataFrame) -> DataFrame:
    """Adds the close of the bar before, by bar order. Daily bars only: a ticker's window is
    bounded by the number of trading days."""
    window = Window.partitionBy("ticker").orderBy("date")
    return bars.withColumn("prev_close", F.lag("close").over(window))


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """The ``n`` latest daily bars of each ticker (row_number filter: Spark prunes per group
    before the shuffle)."""
    window = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return bars.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def _roll_up(bars: DataFrame, keys: list[str]) -> DataFrame:
    return bars.groupBy(*keys).agg(
        F.expr("min_by(open, window_start) as open"),
        F.expr("max(high) as high"),
        F.expr("min(low) as low"),
        F.expr("max_by(close, window_start) as close"),
        F.expr("sum(volume) as volume"),
        F.expr("sum(transactions) as transactions"),
        F.expr("min(window_start) div 1000000 as timestamp_ms"),
    )


def _bucket(wall: Column, multiplier: int, timespan: str) -> Column:
    day = F.to_date(wall)
    midnight = day.cast("timestamp_ntz")
    epoch = F.lit("1970-01-01").cast("date")
    if timespan in ("minute", "hour"):
        size = multiplier * (60 if timespan == "hour" else 1)
        m = F.hour(wall) * 60 + F.minute(wall)
        return F.timestamp_add("MINUTE", m - m % size, midnight)
    if timespan in ("day", "week"):
        size = multiplier * (7 if timespan == "week" else 1)
        start = F.lit("1969-12-29").cast("date") if timespan == "week" else epoch
        return F.date_sub(day, F.pmod(F.datediff(day, start), F.lit(size))).cast("timestamp_ntz")
    months = {"month": 1, "quarter": 3, "year": 12}[timespan] * multiplier
    since = (F.year(day) - 1970) * 12 + F.month(day) - 1
    return F.add_months(epoch, since - F.pmod(since, F.lit(months))).cast("timestamp_ntz")


def _order_key(order: list[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)
