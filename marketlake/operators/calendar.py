"""Calendar look-ups: as-of joins become equi-joins on a dense, broadcast calendar.

A ``date <= target`` join would be planned as a nested loop. The dense calendar holds the
answer for every calendar day instead, so a look-up is one hash join, and the calendar is
bounded by its span of days (checked in ``sources.calendar``), so it may always be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions import sessions as S
from marketlake.functions.times import minute_of_day, ny_epoch_seconds, ny_from_utc
from marketlake.schemas import HORIZONS

# How far look-ups may reach, in calendar days.
LOOK_AHEAD_DAYS = 10
LOOK_BACK_DAYS = 1200
HOLIDAY_NAME = "Market Holiday"


def dense_calendar(calendar: DataFrame) -> DataFrame:
    """One row per calendar day, from the first to the last trading day, with the trading days
    around it.

    ``last_trading_day`` is on or before the day, ``prev_trading_day`` the one before that,
    ``next_trading_day`` on or after the day, ``following_trading_day`` strictly after.
    Forward look-ups reach ten days; beyond that they give the start day itself. After the last
    trading day nothing is known, so there the times of the following one are null.

    Each trading day is spread over the days until the next one. The window runs over trading
    days only (a few thousand rows, bounded by the calendar), so a single task is right for it.
    """
    ordered = Window.orderBy("date")
    sessions = (
        calendar.where("close_minute is not null")
        .coalesce(1)
        .select(
            F.col("date").alias("t"),
            F.col("close_minute").alias("t_close"),
            F.lag("date").over(ordered).alias("prev_trading_day"),
            F.lead("date").over(ordered).alias("after"),
            F.lead("close_minute").over(ordered).alias("after_close"),
        )
    )
    days = sessions.withColumn(
        "day", F.explode(F.sequence("t", F.coalesce(F.date_sub("after", 1), "t")))
    )
    day, t, after = F.col("day"), F.col("t"), F.col("after")
    tomorrow = F.date_add(day, 1)
    in_reach = F.datediff(after, tomorrow) <= LOOK_AHEAD_DAYS
    return days.select(
        "day",
        (day == t).alias("is_trading_day"),
        F.when(day == t, F.col("t_close")).alias("close_minute"),
        t.alias("last_trading_day"),
        "prev_trading_day",
        F.when((day == t) | (F.datediff(after, day) > LOOK_AHEAD_DAYS), day)
        .otherwise(after)
        .alias("next_trading_day"),
        F.when(in_reach, after).otherwise(tomorrow).alias("following_trading_day"),
        F.when(in_reach, F.col("after_close")).alias("following_close_minute"),
        after.isNotNull().alias("_known"),
    ).withColumns(
        {
            # unix seconds, so that no row of a fact table needs a zone conversion for them
            "opens_at": ny_epoch_seconds(day, F.lit(S.PRE_OPEN)),
            "closes_at": ny_epoch_seconds(day, _post_end(F.col("close_minute"))),
            "following_opens_at": F.when(
                F.col("_known"), ny_epoch_seconds(F.col("following_trading_day"), F.lit(S.PRE_OPEN))
            ),
            "following_closes_at": F.when(
                F.col("_known"),
                ny_epoch_seconds(F.col("following_trading_day"), _post_end(F.col("following_close_minute"))),
            ),
        }
    ).drop("_known")


def look_up(df: DataFrame, dense: DataFrame, day: Column, *columns: str) -> DataFrame:
    """Adds calendar columns for the date in ``day``; days outside the calendar give null."""
    side = F.broadcast(dense.select(F.col("day").alias("_day"), *columns))
    return df.join(side, day == F.col("_day"), "left").drop("_day")


def last_trading_day(df: DataFrame, dense: DataFrame, day: str) -> DataFrame:
    """As-of backward: latest trading day on or before ``day``."""
    return look_up(df, dense, F.col(day), "last_trading_day")


def next_trading_day(df: DataFrame, dense: DataFrame, day: str) -> DataFrame:
    """As-of forward: first trading day on or after ``day``."""
    return look_up(df, dense, F.col(day), "next_trading_day")


def trading_day_flag(df: DataFrame, dense: DataFrame, utc: str) -> DataFrame:
    """Whether the New York date of a UTC timestamp is a trading day (date level, not clock); null outside the calendar."""
    return look_up(df, dense, F.to_date(ny_from_utc(F.col(utc))), "is_trading_day")


def reference_dates(as_of: DataFrame, dense: DataFrame) -> DataFrame:
    """For each ``as_of`` date: (as_of, label, ref_date) for ``prev`` and the seven horizons.

    Horizons are calendar offsets from the last trading day, resolved backward; ``ytd`` counts
    from the year of ``as_of`` itself. Dates with fewer than two sessions before them, and
    horizons older than the look-back, give no row.
    """
    base = look_up(
        as_of.select("as_of").distinct(), dense, F.col("as_of"), "last_trading_day", "prev_trading_day"
    ).where("prev_trading_day is not null")
    last = "last_trading_day"
    targets = {
        "prev": "prev_trading_day",
        "5d": f"date_sub({last}, 5)",
        "1m": f"add_months({last}, -1)",
        "3m": f"add_months({last}, -3)",
        "6m": f"add_months({last}, -6)",
        "1y": f"add_months({last}, -12)",
        "3y": f"add_months({last}, -36)",
        "ytd": "make_date(year(as_of) - 1, 12, 31)",
    }
    pairs = ", ".join(f"struct('{k}' as label, {v} as target)" for k, v in targets.items())
    long = base.selectExpr("as_of", f"inline(array({pairs}))")
    resolved = look_up(long, dense, F.col("target"), "last_trading_day")
    return resolved.where(
        F.col("last_trading_day") >= F.date_sub("as_of", LOOK_BACK_DAYS)
    ).select("as_of", "label", F.col("last_trading_day").alias("ref_date"))


def trading_dates(as_of: DataFrame, dense: DataFrame) -> DataFrame:
    """One row per ``as_of`` with the eight reference dates as columns."""
    labels = ["prev", *HORIZONS]
    return (
        reference_dates(as_of, dense)
        .groupBy("as_of")
        .agg(*[F.expr(f"max(case when label = '{k}' then ref_date end) as d_{k}") for k in labels])
    )


def market_status(df: DataFrame, dense: DataFrame, utc: str) -> DataFrame:
    """Session, holiday flag and next open/close (unix seconds) at a UTC timestamp column.

    Days outside the calendar give nulls, and so does the next session after its last day.
    """
    out = df.withColumn("_ny", ny_from_utc(F.col(utc)))
    out = look_up(
        out.withColumn("_date", F.to_date("_ny")),
        dense,
        F.col("_date"),
        "is_trading_day",
        "close_minute",
        "opens_at",
        "closes_at",
        "following_opens_at",
        "following_closes_at",
    )
    trading = F.col("is_trading_day")
    m = minute_of_day(F.col("_ny"))
    close = F.coalesce("close_minute", F.lit(S.CLOSE))
    session = (
        F.when(~trading | (m < S.PRE_OPEN), "closed")
        .when(m < S.OPEN, "pre-market")
        .when(m < F.least(close, F.lit(S.CLOSE)), "open")
        .when((m < S.CLOSE) | (m < _post_end(F.col("close_minute"))), "post-market")
        .otherwise("closed")
    )
    before_open = trading & (m < S.PRE_OPEN)
    holiday = ~trading & F.weekday("_date").between(0, 4)
    out = out.withColumns(
        {
            "session": F.when(trading.isNotNull(), session),
            "is_holiday": F.when(trading.isNotNull(), holiday),
            "_before_open": before_open,
        }
    )
    stays_today = F.col("_before_open") | (F.col("session") != "closed")
    return out.select(
        *df.columns,
        "session",
        "is_holiday",
        F.when(F.col("is_holiday"), HOLIDAY_NAME).alias("holiday_name"),
        F.when(F.col("_before_open"), F.col("opens_at"))
        .otherwise(F.col("following_opens_at"))
        .alias("next_open"),
        F.when(stays_today, F.col("closes_at"))
        .otherwise(F.col("following_closes_at"))
        .alias("next_close"),
    )


def _post_end(close_minute: Column) -> Column:
    """End of the post-market: three hours after an early close, else 20:00."""
    return F.when(
        close_minute < S.CLOSE, close_minute + S.EARLY_POST_MINUTES
    ).otherwise(S.POST_CLOSE)
