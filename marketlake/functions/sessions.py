"""Trading-session names by wall clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.times import minute_of_day, ny_from_epoch_ns

# Session bounds in minutes of the New York day.
PRE_OPEN = 4 * 60
OPEN = 9 * 60 + 30
CLOSE = 16 * 60
POST_CLOSE = 20 * 60
EARLY_POST_MINUTES = 3 * 60


def bar_session(wall: Column) -> Column:
    """Clock-only class of a bar; weekends, holidays and early closes are not looked at."""
    m = minute_of_day(wall)
    return (
        F.when(m < PRE_OPEN, "closed")
        .when(m < OPEN, "pre_market")
        .when(m < CLOSE, "market")
        .when(m < POST_CLOSE, "post_market")
        .otherwise("closed")
    )


def with_timestamp(bars: DataFrame) -> DataFrame:
    """Adds New York wall time from ``window_start``."""
    return bars.withColumn("timestamp", ny_from_epoch_ns(F.col("window_start")))


def with_session(bars: DataFrame) -> DataFrame:
    """Adds the session of ``timestamp``."""
    return bars.withColumn("session", bar_session(F.col("timestamp")))
