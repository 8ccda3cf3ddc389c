"""Load reports and completeness checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def load_report(parsed: DataFrame, *by: str) -> DataFrame:
    """Rows read, bad rows and status per date of a parsed load, or by other columns."""
    return (
        parsed.groupBy(*(by or ["date"]))
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("row_ok")).alias("bad_rows"))
        .withColumn("status", F.when(F.col("bad_rows") > 0, "failed").otherwise("ok"))
    )


def counts_per_date(bars: DataFrame) -> DataFrame:
    return bars.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


def missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Trading days between the first and last loaded date that have no bar.

    Only ``date`` is read, and it is reduced to distinct dates before it meets the calendar.
    """
    loaded = bars.select(F.to_date("date").alias("date")).distinct()
    first = loaded.select(F.min("date")).scalar()
    last = loaded.select(F.max("date")).scalar()
    days = calendar.where("close_minute is not null").select("date")
    return days.where(F.col("date").between(first, last)).join(loaded, "date", "left_anti")


def ticker_gaps(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Gaps of each ticker between its first and last bar: (ticker, last_before, first_after, missing), one row per
    run of trading days without a bar.

    Trading days are numbered, so a gap is a step of more than one in a ticker's numbers. Bars are reduced to their
    distinct days before that, so a ticker's window is bounded by the calendar. Days that are no trading day do not count.
    """
    sessions = calendar.where("close_minute is not null").select("date").coalesce(1)
    numbered = sessions.withColumn("n", F.row_number().over(Window.orderBy("date")))
    loaded = bars.select("ticker", F.to_date("date").alias("date")).distinct().join(F.broadcast(numbered), "date")
    days = Window.partitionBy("ticker").orderBy("n")
    steps = loaded.withColumns({"last_before": F.lag("date").over(days), "missing": F.col("n") - F.lag("n").over(days) - 1})
    return steps.where("missing > 0").select("ticker", "last_before", F.col("date").alias("first_after"), "missing")


def compare_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Dates whose loaded row count differs from the expected one; both (date, rows)."""
    pair = expected.select("date", F.col("rows").alias("expected")).join(
        actual.select("date", F.col("rows").alias("actual")), "date", "full_outer"
    )
    return pair.where(~F.col("expected").eqNullSafe(F.col("actual")))
